"""Approximate nearest neighbours by randomly rotated one-bit codes.

A vector, less the centre, is rotated at random; its code keeps the sign of each coordinate. With two scalars (its norm,
and how well the code points its way) the code gives an unbiased estimate of the inner product with any query, and a
bound on the estimate's error. Only vectors that the bound still lets among the nearest are looked at themselves.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import stage, tasks

#: Most rows of a shard of the index, rows of a pack of queries, of the first sample, growth of the samples.
SHARD, QUERIES, SEED, GROWTH = 1 << 16, 128, 4096, 16
#: Standard errors of an estimate that the bound allows for, and vectors looked at between two looks at the floor.
ERRORS, LOOK = 2.5, 256
#: Seed of the rotation.
TURN = 11


def real_vectors(rows: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, v): vectors as doubles; null ids, null or zero vectors, and null or non-finite components are left out."""
    x = F.col(vector)
    odd = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = rows.where(F.col(vec_id).isNotNull() & x.isNotNull() & ~F.coalesce(odd, F.lit(True)) & F.exists(x, lambda c: c != 0))
    return rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(x, lambda c: c.cast("double")).alias("v"))


def rotation(width: int) -> np.ndarray:
    """A random orthogonal matrix, the same wherever it is made."""
    q, r = np.linalg.qr(np.random.default_rng(TURN).normal(size=(width, width)))
    return q * np.sign(np.diag(r))


def encode(x: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(packed signs by byte and vector, norm of each residual, its inner product with its code as unit vectors)."""
    residual = (x - centre) @ turn
    norm = np.sqrt((residual**2).sum(1))
    signs = residual > 0
    held = np.abs(residual).sum(1) / (np.sqrt(x.shape[1]) * np.where(norm > 0, norm, 1))
    return np.ascontiguousarray(np.packbits(signs, axis=1).T), norm, np.where(norm > 0, held, 1.0)


#: The signs (-1, 1) of each byte, highest bit first.
_SIGNS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(float) * 2 - 1


class Codes:
    """A shard of the index: codes by byte, scalars, and the vectors themselves."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, codes: np.ndarray, norm: np.ndarray, held: np.ndarray, width: int):
        self.ids, self.x, self.codes, self.norm, self.held, self.width = ids, x, codes, norm, held, width
        self.error = ERRORS * np.sqrt(np.maximum(1 - held**2, 0) / np.maximum(held**2, 1e-12) / max(1, width - 1))
        self.looked = 0  # vectors looked at for all queries

    def cosines(self, q: np.ndarray) -> np.ndarray:
        """Estimates of the cosine of each residual with a rotated unit query: sums of table entries, a byte at a time."""
        padded = np.zeros(8 * len(self.codes))
        padded[: self.width] = q
        lut = padded.reshape(-1, 8) @ _SIGNS.T
        total = lut[0].take(self.codes[0])
        for k in range(1, len(self.codes)):
            total += lut[k].take(self.codes[k])
        return total / (np.sqrt(self.width) * self.held)

    def nearest(self, q_id: int, q: np.ndarray, centre: np.ndarray, turn: np.ndarray, floor: float, floor_id: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and exact distances of the k nearest that come up to (floor, floor_id).

        Vectors go by rising lower bound of their distance; those within the floor are looked at, LOOK at a time, until
        the next bound is over the k-th distance found.
        """
        residual = (q - centre) @ turn
        norm = float(np.sqrt((residual**2).sum()))
        cosine = self.cosines(residual / norm if norm > 0 else residual)
        best = np.minimum(1.0, cosine + self.error)
        low = np.sqrt(np.maximum(0, self.norm**2 + norm**2 - 2 * norm * self.norm * best)) * (1 - 1e-9) - 1e-9
        at = np.flatnonzero((low <= floor) & (self.ids != q_id))
        at = at[np.argsort(low[at], kind="stable")]
        place, far = np.zeros(0, np.int64), np.zeros(0)
        for a in range(0, len(at), LOOK):
            own = at[a : a + LOOK]
            if len(place) == k and low[own[0]] > far[-1]:
                break
            d = np.sqrt(((self.x[own].astype(float) - q) ** 2).sum(1))
            self.looked += len(own)
            place, far = np.append(place, own), np.append(far, d)
            best = np.lexsort((self.ids[place], far))[:k]
            place, far = place[best], far[best]
        good = (far < floor) | (far == floor) & (self.ids[place] <= floor_id)
        return place[good], far[good]


def _matrix(vectors, width: int) -> np.ndarray:
    x = np.zeros((len(vectors), width))
    for k, v in enumerate(vectors):
        x[k, : len(v)] = v
    return x


def _slim(x: np.ndarray) -> np.ndarray:
    """As 32-bit floats where these hold the values as they are."""
    small = x.astype(np.float32)
    return small if (small == x).all() else x


def _dealt(rows: DataFrame, most: int, least: int, salt: int) -> tuple[DataFrame, int]:
    n = max(least, -(-rows.count() // most))
    return rows.withColumn("pack", F.pmod(F.xxhash64("vec_id", "v", F.lit(salt)), F.lit(n))), n


def index(rows: DataFrame, centre: np.ndarray) -> tuple[DataFrame, int]:
    """All of ``rows`` (vec_id, v) in shards of codes, scalars and vectors, and how many shards there are."""
    width = len(centre)
    dealt, n = _dealt(rows, SHARD, tasks(rows.sparkSession), 2)

    def packed(pdf: pd.DataFrame) -> pd.DataFrame:
        x = _matrix(pdf["v"], width)
        codes, norm, held = encode(x, centre, rotation(width))
        x = _slim(x)
        out = {"shard": pdf["pack"].iat[0], "ids": pdf["vec_id"].to_numpy(np.int64).tobytes(), "x": x.tobytes(), "kind": x.dtype.str, "codes": codes.tobytes(), "norm": norm.tobytes(), "held": held.tobytes()}
        return pd.DataFrame({c: [v] for c, v in out.items()})

    return stage(dealt.groupBy("pack").applyInPandas(packed, "shard long, ids binary, x binary, kind string, codes binary, norm binary, held binary"), "index"), n


def _packs(asked: DataFrame, width: int) -> DataFrame:
    """Queries with their floors in packs: the matrices of about QUERIES rows each."""
    dealt, _ = _dealt(asked, QUERIES, 1, 3)

    def packed(pdf: pd.DataFrame) -> pd.DataFrame:
        x = _slim(_matrix(pdf["v"], width))
        out = {"ids": pdf["vec_id"].to_numpy(np.int64).tobytes(), "x": x.tobytes(), "kind": x.dtype.str, "floor": pdf["floor"].to_numpy(float).tobytes(), "floor_id": pdf["floor_id"].to_numpy(np.int64).tobytes()}
        return pd.DataFrame({c: [v] for c, v in out.items()})

    return stage(dealt.groupBy("pack").applyInPandas(packed, "ids binary, x binary, kind string, floor binary, floor_id binary"), "packs")


def _pass(asked: DataFrame, shards: DataFrame, n: int, centre: np.ndarray, k: int) -> DataFrame:
    """(query_id, vec_id, score): up to k of each query in each shard, none beyond the floor.

    A task gets a shard and then the packs, one by one: a shard is read once, and one shard and one pack are held.
    """
    width = len(centre)
    none = F.lit(None).cast("binary")
    packs = _packs(asked, width).withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    one = shards.select("shard", F.lit(0).alias("turn"), "ids", "x", "kind", "codes", "norm", "held", none.alias("floor"), none.alias("floor_id"))
    other = packs.select("shard", F.lit(1).alias("turn"), "ids", "x", "kind", none.alias("codes"), none.alias("norm"), none.alias("held"), "floor", "floor_id")

    def found(batches):
        shard, number, turn = None, None, rotation(width)
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                ids = np.frombuffer(r.ids, np.int64)
                x = np.frombuffer(r.x, r.kind).reshape(len(ids), width)
                if r.turn == 0:
                    codes = np.frombuffer(r.codes, np.uint8).reshape(-1, len(ids))
                    shard, number = Codes(ids, x, codes, np.frombuffer(r.norm), np.frombuffer(r.held), width), r.shard
                    continue
                if number != r.shard:
                    continue  # no row of the index has this number
                out, floor, floor_id = [], np.frombuffer(r.floor), np.frombuffer(r.floor_id, np.int64)
                for i, q_id in enumerate(ids.tolist()):
                    at, d = shard.nearest(q_id, x[i].astype(float), centre, turn, float(floor[i]), int(floor_id[i]), k)
                    out.append((np.full(len(at), q_id), shard.ids[at], d))
                yield pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), map(np.concatenate, zip(*out, strict=True)), strict=True)))

    met = one.unionByName(other).repartition(min(n, 8 * tasks(asked.sparkSession)), "shard").sortWithinPartitions("shard", "turn")
    return met.mapInPandas(found, "query_id long, vec_id long, score double")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search(queries: DataFrame, candidates: DataFrame, *, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): the k candidates found nearest, by Euclidean distance, ties to the smaller id.

    Both tables: vec_id, v (see real_vectors). Every candidate is in the index; the score is the distance of the vectors
    themselves, in double precision. The bound holds for all but about one in 160 vectors (ERRORS standard errors, one
    side), so about so many of the nearest are missed. A query's floor is its k-th nearest (distance, id) in a sample by
    hash, which all shards share; samples grow GROWTH-fold up to the whole table. A candidate with the query's id is the
    query's own row. Vectors of different length are padded with zeros. An empty table on either side gives an empty
    table; repeated candidate rows appear as often as they are there, repeated queries once. Driver: the centre, one
    number a component.
    """
    have = stage(candidates, "candidates")
    empty = have.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    head = have.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width")).head()
    asked = queries.dropDuplicates(["vec_id"]).select("vec_id", "v", F.lit(float("inf")).alias("floor"), F.lit((1 << 63) - 1).alias("floor_id"))
    asked = stage(asked, "queries")
    wide = asked.agg(F.max(F.size("v")).alias("width")).head()["width"]
    if not head["n"] or not wide:
        return empty
    width = max(head["width"], wide)
    mean = have.agg(*(F.avg(F.coalesce(F.get("v", F.lit(j)), F.lit(0.0))).alias(f"c{j}") for j in range(width))).head()
    centre = np.array(mean, float)
    share = 1
    while head["n"] > SEED * share:
        share *= GROWTH
    while share > 1:
        sample, n = index(have.where(F.pmod(F.xxhash64("vec_id", "v"), F.lit(share)) == 0), centre)
        last = _ranked(_pass(asked, sample, n, centre, k), k).where(F.col("rank") == k)
        floors = last.select(F.col("query_id").alias("vec_id"), F.col("score").alias("f"), F.col("vec_id").alias("i"))
        asked = asked.join(floors, "vec_id", "left").select("vec_id", "v", F.coalesce("f", "floor").alias("floor"), F.coalesce("i", "floor_id").alias("floor_id"))
        asked = stage(asked, "floors")
        share //= GROWTH
    shards, n = index(have, centre)
    return _ranked(_pass(asked, shards, n, centre, k), k)
