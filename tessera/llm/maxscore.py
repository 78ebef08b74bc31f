"""Exact top-k search by MaxScore: essential postings for all candidates, the others only for those still competitive."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import stage, tasks

#: Rows of a shard of candidates and of a pack of queries, rows of the first sample, growth of the samples.
SHARD, QUERIES, SEED, GROWTH = 4096, 4096, 4096, 4
#: Non-essential terms probed before candidates are dropped again.
PROBE = 8
_LEAST = -(1 << 63)


def integer_vectors(rows: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", scale: int = 64) -> DataFrame:
    """(vec_id, v): floor(scale * component) as longs; null ids or vectors and null or non-finite components are left out."""
    x = F.col(vector)
    odd = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = rows.where(F.col(vec_id).isNotNull() & x.isNotNull() & ~F.coalesce(odd, F.lit(True)))
    return rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("long")).alias("v"))


def _packed(rows: DataFrame, per_pack: int, extra: str) -> tuple[DataFrame, int]:
    """Distinct rows in packs of about ``per_pack``: (pack, ids, v, width and the columns ``extra``), as matrices."""
    n, names = max(1, -(-rows.count() // per_pack)), extra.split()

    def packed(pdf: pd.DataFrame) -> pd.DataFrame:
        width = max(map(len, pdf["v"]))
        m = np.zeros((len(pdf), width), np.int64)
        for k, v in enumerate(pdf["v"]):
            m[k, : len(v)] = v
        out = {"pack": [pdf["pack"].iat[0]], "ids": [pdf["vec_id"].to_numpy(np.int64).tobytes()], "v": [m.tobytes()], "width": [width]}
        return pd.DataFrame(out | {c: [pdf[c].to_numpy(np.int64).tobytes()] for c in names})

    dealt = rows.withColumn("pack", F.pmod(F.xxhash64("vec_id", "v", F.lit(1)), F.lit(n)))
    return stage(dealt.groupBy("pack").applyInPandas(packed, "pack long, ids binary, v binary, width int" + "".join(f", {c} binary" for c in names)), "packs"), n


class Postings:
    """A shard by component: the list of all candidates' values of each, with its bounds."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.columns = ids, np.ascontiguousarray(x.T)
        self.low, self.high = x.min(0), x.max(0)
        self.norm = np.sqrt((x.astype(float) ** 2).sum(1))
        self.read = 0  # values read for all queries

    def top(self, q_id: int, q: np.ndarray, floor: int, floor_id: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the k best for one query that reach (floor, floor_id): a score at least as high, ties by id.

        Terms go by falling spread of what they can add. What all terms after the first e add is bounded by the sum of
        their largest products and by the product of the norms; the first e, at the least e at which that can't reach the
        floor, are the essential terms: nothing gets there on the others alone. Essential postings are traversed; the
        others are probed, a few at a time, for the candidates whose score plus what is left may still reach the floor.
        """
        low, high = np.minimum(q * self.low, q * self.high).astype(float), np.maximum(q * self.low, q * self.high).astype(float)
        order = np.argsort(low - high, kind="stable")
        rest = np.r_[np.cumsum(high[order][::-1])[::-1], 0.0]
        length = np.sqrt(np.r_[np.cumsum((q[order].astype(float) ** 2)[::-1])[::-1], 0.0])
        slack = 1e-9 * (np.abs(low) + np.abs(high)).sum() + 1e-6
        most = np.minimum(rest, length * self.norm.max()) + slack
        e = int(np.argmax(most < floor)) if floor > _LEAST and most[-1] < floor else len(q)
        score = q[order[:e]] @ self.columns[order[:e]] if e < len(q) else q @ self.columns
        self.read += e * len(self.ids)
        at = np.arange(len(self.ids))
        while True:
            if floor > _LEAST:
                near = score + np.minimum(rest[e], length[e] * self.norm[at]) + slack >= floor
                at, score = at[near], score[near]
            if e == len(q) or not len(at):
                break
            terms = order[e : e + PROBE]
            score = score + q[terms] @ self.columns[np.ix_(terms, at)]
            self.read += len(terms) * len(at)
            e += len(terms)
        keep = (self.ids[at] != q_id) & ((score > floor) | (score == floor) & (self.ids[at] <= floor_id))
        at, score = at[keep], score[keep]
        if len(at) > k:
            best = score >= np.partition(score, len(score) - k)[len(score) - k]
            at, score = at[best], score[best]
        best = np.lexsort((self.ids[at], -score))[:k]
        return at[best], score[best].astype(np.int64)


def _aligned(q: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both of one width, in the smallest type in which all sums are whole numbers."""
    width = max(q.shape[1], x.shape[1])
    q, x = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (q, x))
    most = width * float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0))
    kind = np.float32 if most < 2**24 else np.float64 if most < 2**52 else np.int64
    return q.astype(kind), x.astype(kind)


def _pass(asked: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score, copies): of every shard the candidates that reach a query's floor, k at most."""
    shards, n = _packed(candidates, SHARD, "copies")
    packs, _ = _packed(asked, QUERIES, "floor floor_id")
    to = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("pack")
    packs = packs.select(F.col("ids").alias("q_ids"), F.col("v").alias("q"), F.col("width").alias("q_width"), "floor", "floor_id", to)
    names = ["q_ids", "q", "q_width", "floor", "floor_id", "ids", "v", "width", "copies"]

    def scored(batches):
        for pdf in batches:
            for q_ids, q, q_width, floor, floor_id, ids, v, width, copies in pdf.itertuples(index=False):
                q_ids, floor, floor_id, ids, copies = (np.frombuffer(z, np.int64) for z in (q_ids, floor, floor_id, ids, copies))
                q, x = _aligned(np.frombuffer(q, np.int64).reshape(len(q_ids), q_width), np.frombuffer(v, np.int64).reshape(len(ids), width))
                shard, out = Postings(ids, x), []
                for i, q_id in enumerate(q_ids.tolist()):
                    at, s = shard.top(q_id, q[i], int(floor[i]), int(floor_id[i]), k)
                    out.append((np.full(len(at), q_id), ids[at], s, copies[at]))
                yield pd.DataFrame(dict(zip(("query_id", "vec_id", "score", "copies"), map(np.concatenate, zip(*out, strict=True)), strict=True)))

    n_tasks = tasks(asked.sparkSession)  # a pair of packs is much work and few bytes, so partitions aren't to be merged
    met = packs.repartition(n_tasks, "pack").join(shards.repartition(n_tasks, "pack").hint("shuffle_hash"), "pack").select(*names)
    return met.mapInPandas(scored, "query_id long, vec_id long, score long, copies long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query with their ranks; copies count each."""
    each = found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.least("copies", F.lit(k).cast("long")))))
    ranked = each.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search(queries: DataFrame, candidates: DataFrame, *, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): the k candidates of largest inner product, ties to the smaller id.

    Both tables: vec_id, v (see integer_vectors). A query's floor is its k-th best (score, id) in a sample by hash, which
    all shards share; samples grow GROWTH-fold up to the whole table, so each pass finds about GROWTH times k rows a query
    however many shards there are. A pass is a block join: packs of queries meet shards of candidates, both of bounded
    size. A candidate with the query's id is the query's own row. Vectors of different length are padded with zeros. An
    empty table on either side gives an empty table; repeated candidate rows are scored once and appear as often as they
    are there, repeated queries once.
    """
    have = stage(candidates.groupBy("vec_id", "v").agg(F.count("*").alias("copies")), "candidates")
    asked = stage(queries.dropDuplicates(["vec_id"]).select("vec_id", "v", F.lit(_LEAST).alias("floor"), F.lit(_LEAST).alias("floor_id")), "queries")
    share, n = 1, have.count()
    while n > SEED * share:
        share *= GROWTH
    while share > 1:
        sample = have.where(F.pmod(F.xxhash64("vec_id", "v"), F.lit(share)) == 0)
        last = _ranked(_pass(asked, sample, k), k).where(F.col("rank") == k)
        floors = last.select(F.col("query_id").alias("vec_id"), F.col("score").alias("f"), F.col("vec_id").alias("i"))
        asked = asked.join(floors, "vec_id", "left").select("vec_id", "v", F.coalesce("f", "floor").alias("floor"), F.coalesce("i", "floor_id").alias("floor_id"))
        asked = stage(asked, "floors")
        share //= GROWTH
    return _ranked(_pass(asked, have, k), k)
