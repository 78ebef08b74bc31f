"""SimHash near-dedup: fingerprints, vantage-point trees over them, and verified groups of similar documents."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage, tasks
from .components import components

SEED = 42


def fingerprint(text: str | None, shingle: int = 4, words_out: int = 1) -> int:
    """64 bits, each the majority over the XXH64 of the word shingles; zero without words.

    With ``words_out`` over 1 as many words, the first as above and the others from mixed hashes.
    """
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    k = min(shingle, len(words))
    first = np.concatenate([[0], ends[:-1] + 1])[: len(words) - k + 1].tolist()
    hashed = np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in zip(first, ends[k - 1 :].tolist(), strict=True)], np.uint64)
    bits = []
    for word in range(words_out):
        if word:
            hashed = (hashed ^ (hashed >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25)
            hashed ^= hashed >> np.uint64(28)
        ones = np.zeros(64, np.int64)
        for at in range(0, len(hashed), 65_536):
            ones += np.unpackbits(hashed[at : at + 65_536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        bits.append(np.packbits(2 * ones > len(hashed)).tobytes())
    return int.from_bytes(b"".join(bits), "big")


def fingerprints(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = 4) -> DataFrame:
    """(doc_id, fp): the fingerprint's bits as a signed long."""

    @F.pandas_udf("long")
    def coded(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64))

    return docs.select(F.col(doc_id).alias("doc_id"), coded(F.col(text)).alias("fp"))


class _Labels:
    """Components inside one shard."""

    def __init__(self, n: int):
        self.of = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        """Links points a[i] and b[i]."""
        pairs = np.unique(np.stack([self.of[a], self.of[b]], axis=1), axis=0)
        pairs = pairs[pairs[:, 0] != pairs[:, 1]]
        if not len(pairs):
            return
        up: dict[int, int] = {}

        def top(x: int) -> int:
            while (y := up.get(x, x)) != x:
                up[x] = up.get(y, y)
                x = y
            return x

        for x, y in pairs.tolist():
            x, y = top(x), top(y)
            if x != y:
                up[max(x, y)] = min(x, y)
        new = np.arange(len(self.of))
        for x in list(up):
            new[x] = top(x)
        self.of = new[self.of]


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits; fingerprints are the last axis, of one word or more."""
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


#: A level of a tree measures WIDTH bits; a half of the fingerprint has LEVELS of them.
WIDTH, LEVELS = 4, 8
#: Fixed vantage points of the levels that deal fingerprints to shards, one for each half.
VANTAGE = (0x5BD1E995, 0x27D4EB2F)
#: Codes a shard is meant to hold, members above which it is split, and pairs of a leaf.
SHARD, MOST, LEAF = 16_384, 250_000, 100_000


def _ring(half: np.ndarray, vantage: int, level: int) -> np.ndarray:
    """Hamming distance to the vantage point in the bits of one level."""
    return np.bitwise_count((half ^ np.uint64(vantage)) >> np.uint64(WIDTH * level) & np.uint64((1 << WIDTH) - 1)).astype(np.int64)


class VantageTree:
    """Links within ``radius`` between residents, and from residents to visitors, of one shard.

    Each level takes one of the members as its vantage point and splits residents and visitors by their Hamming distance
    to it in the level's own bits. Distances of disjoint bits add up, so triangle bounds do too: a pair of this tree
    differs in ``budget`` bits of the half at most, of which each level uses up the difference of the two distances.
    Branches over budget are pruned; ``compared`` counts the pairs whose whole fingerprints were compared.
    """

    def __init__(self, f: np.ndarray, half: np.ndarray, radius: int):
        self.f, self.half, self.radius = f, half, radius
        self.labels, self.compared = _Labels(len(f)), 0

    def within(self, own: np.ndarray, level: int, budget: int) -> None:
        if level >= LEVELS or len(own) ** 2 <= LEAF:
            return self._compare(own, own)
        of = self._rings(own, own, level)[0]
        parts = [own[of == d] for d in range(WIDTH + 1)]
        for d, part in enumerate(parts):
            if len(part):
                self.within(part, level + 1, budget)
            for gap in range(1, min(budget, WIDTH - d) + 1):
                self.between(part, parts[d + gap], level + 1, budget - gap)

    def between(self, own: np.ndarray, others: np.ndarray, level: int, budget: int) -> None:
        if not len(own) or not len(others):
            return None
        if level >= LEVELS or len(own) * len(others) <= LEAF:
            return self._compare(own, others)
        a, b = self._rings(own, others, level)
        theirs = [others[b == d] for d in range(WIDTH + 1)]
        for d in range(WIDTH + 1):
            mine = own[a == d]
            for e in range(max(0, d - budget), min(WIDTH, d + budget) + 1):
                self.between(mine, theirs[e], level + 1, budget - abs(d - e))

    def _rings(self, own: np.ndarray, others: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        vantage = int(self.half[own[len(own) // 2]])
        return _ring(self.half[own], vantage, level), _ring(self.half[others], vantage, level)

    def _compare(self, own: np.ndarray, others: np.ndarray) -> None:
        self.compared += len(own) * len(others)
        step = max(1, LEAF // max(1, len(others)))
        theirs = self.f[others]
        for at in range(0, len(own), step):
            near = np.bitwise_count(self.f[own[at : at + step], None] ^ theirs) <= self.radius
            x, y = np.divmod(np.flatnonzero(near), len(others))
            if len(x):
                self.labels.join(own[at : at + step][x], others[y])


def _gaps(levels: int, budget: int) -> list[tuple[int, ...]]:
    """Differences of ring vectors whose sizes add up to ``budget`` at most, first nonzero one positive."""
    out = [()]
    for _ in range(levels):
        out = [(*g, d) for g in out for d in range(-budget, budget + 1) if sum(map(abs, g)) + abs(d) <= budget]
    return [g for g in out if next((d for d in g if d), 0) > 0]


def _routed(codes: DataFrame, levels: int, budget: int) -> DataFrame:
    """(key, visits, fp, node): each code in its own shard of either half, and as a visitor where the triangle bound asks."""
    gaps = _gaps(levels, budget)
    place = [(WIDTH + 1) ** k for k in range(levels)]

    def dealt(batches):
        for pdf in batches:
            f, node = pdf["fp"].to_numpy(np.int64), pdf["node"].to_numpy(np.int64)
            for side in (0, 1):
                half = f.view(np.uint64) >> np.uint64(32 * side) & np.uint64(0xFFFFFFFF)
                rings = np.stack([_ring(half, VANTAGE[side], k) for k in range(levels)])
                key = side + 2 * sum(p * r for p, r in zip(place, rings, strict=True))
                yield pd.DataFrame({"key": key, "visits": False, "fp": f, "node": node})
                for gap in gaps:
                    to = rings + np.array(gap)[:, None]
                    ok = ((to >= 0) & (to <= WIDTH)).all(0)
                    yield pd.DataFrame({"key": key[ok] + 2 * sum(p * g for p, g in zip(place, gap, strict=True)), "visits": True, "fp": f[ok], "node": node[ok]})

    return codes.select("fp", "node").mapInPandas(dealt, "key long, visits boolean, fp long, node long")


def _blocks(members: DataFrame) -> DataFrame:
    """Members with a ``block`` each: shards of up to MOST members are one; larger ones meet in pairs of parts."""
    parts = members.groupBy("key").count().where(F.col("count") > MOST).select("key", F.ceil(F.col("count") / MOST).alias("parts"))
    own = F.pmod(F.xxhash64("node"), F.col("parts"))
    met = F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda o: F.struct(F.least(own, o).alias("i"), F.greatest(own, o).alias("j")))
    met = F.when(F.col("parts").isNull(), F.array(F.struct(F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j")))).otherwise(met)
    return members.join(parts, "key", "left").withColumn("block", F.explode(met)).select("key", "block.i", "block.j", "visits", "fp", "node")


def links(codes: DataFrame, radius: int = 4) -> DataFrame:
    """Links (a, b: nodes) that connect all fingerprints within ``radius``; ``codes``: fp and node, fp distinct.

    A pair within the radius differs in half of it at most in one half of the bits, so there is a tree for each half. Its
    upper levels, with fixed vantage points, deal the codes to shards: a shard is a vector of Hamming distances to the
    vantage points. A code lives in one shard and visits those whose distances differ by no more than the bound; the
    lower levels are built and searched inside the shard. How many upper levels there are follows from the number of
    codes; the links don't depend on it. A shard of more than MOST members meets in pairs of parts, each in a task.
    """
    spark, levels, n = codes.sparkSession, 1, codes.count()
    while levels < LEVELS and n > SHARD * 4**levels:
        levels += 1
    budget = radius // 2
    members = _blocks(stage(_routed(codes, levels, budget), "shard-members")).withColumn("where", F.xxhash64("key", "i", "j"))
    dealt = members.repartition(tasks(spark), "where").sortWithinPartitions("where", "key", "i", "j")

    def searched(batches):
        for pdf in _whole_keys(batches, "where"):
            key, i, j = (pdf[c].to_numpy() for c in ("key", "i", "j"))
            ends = np.r_[np.flatnonzero((key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1, len(key)].tolist()
            at = 0
            for end in ends:
                f, visits, node = (pdf[c].to_numpy()[at:end] for c in ("fp", "visits", "node"))
                yield _found(f.view(np.uint64), visits.astype(bool), node, int(key[at]) % 2, levels, budget, radius)
                at = end

    return dealt.mapInPandas(searched, "a long, b long")


def _found(f, visits, node, side, levels, budget, radius) -> pd.DataFrame:
    tree = VantageTree(f, f >> np.uint64(32 * side) & np.uint64(0xFFFFFFFF), radius)
    own, others = np.flatnonzero(~visits), np.flatnonzero(visits)
    tree.within(own, levels, budget)
    tree.between(own, others, levels, budget)
    to = tree.labels.of
    linked = to != np.arange(len(to))
    return pd.DataFrame({"a": node[linked], "b": node[to[linked]]})


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = 4, radius: int = 4) -> DataFrame:
    """(doc_id, fp, component_id) for every row: components of fingerprints that differ in ``radius`` bits or fewer.

    A null or empty text, or one without words, has fingerprint zero and links like any other. Rows without an id form
    no component: theirs is null. Repeated rows get equal results; an empty table gives an empty table. Equal
    fingerprints are one node, so copies are never compared.
    """
    coded = stage(fingerprints(docs, doc_id=doc_id, text=text, shingle=shingle), "fingerprints")
    codes = stage(coded.where("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("node")), "codes")
    roots = components(links(codes, radius))
    named = codes.join(roots, "node", "left").select("fp", F.coalesce("root", "node").alias("component_id"))
    out = coded.join(named, "fp", "left")
    return out.select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


MIX = np.uint64(0x9FB21C651E98DF25)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * MIX
    return h ^ (h >> np.uint64(28))


def shingle_sets(texts, shingle: int = 5):
    """The distinct 64-bit hashes of each text's word shingles, sorted; a text of fewer words is one shingle."""
    from xxhash import xxh64_intdigest

    number: dict[bytes, int] = {}
    for text in texts:
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if len(number) > 150_000:
            number = {}
        for w in set(words):
            if w not in number:
                number[w] = xxh64_intdigest(w, SEED)
        of = np.fromiter(map(number.__getitem__, words), np.uint64, len(words))
        k = min(shingle, len(words))
        h = np.full(len(words) - k + 1, k, np.uint64)
        for i in range(k):
            h = h * MIX + of[i : i + len(h)]
        yield np.unique(_mixed(h))


def _least(size, similarity: float):
    """Shingles that a set of this size shares at least with any other at the similarity."""
    return np.ceil(similarity * size - 1e-9).astype(np.int64)


def _whole_keys(batches, name: str):
    """The rows of sorted batches, dealt anew so that equal keys come together."""
    held: list[pd.DataFrame] = []
    for pdf in batches:
        if not len(pdf):
            continue
        key = pdf[name].to_numpy()
        cut = int(np.searchsorted(key, key[-1], "left"))
        if cut == 0 and held and held[-1][name].iat[-1] == key[-1]:
            held.append(pdf)
            continue
        if held or cut:
            yield pd.concat([*held, pdf.iloc[:cut]], ignore_index=True)
        held = [pdf.iloc[cut:]]
    if held:
        yield pd.concat(held, ignore_index=True)


def plausible_pairs(bits: np.ndarray, size: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Pairs that connect all sets which may be at the similarity: exact, by a bound that no such pair exceeds.

    ``bits``: parities of the members by class. Each differs only where the sets do, so no more of them than members.
    """
    left, open_, out = np.ones(len(size), bool), [], []
    most = (1 - similarity) / (1 + similarity)
    while left.any():
        if not open_:
            open_.append(int(left.argmax()))
            left[open_[0]] = False
        c, own = open_.pop(), np.flatnonzero(left)
        low, high = np.minimum(size[own], size[c]), np.maximum(size[own], size[c])
        near = (_distance(bits[own], bits[c]) <= most * (low + high) + 1e-6) & (low >= _least(high, similarity))
        hit = own[near].tolist()
        left[hit] = False
        open_ += hit
        out += [(c, k) for k in hit]
    return out


def parities(s: np.ndarray) -> np.ndarray:
    """2,048 bits: whether a set of hashes has an odd number of members in each class."""
    return np.packbits(np.bincount((s >> np.uint64(53)).astype(np.int64), minlength=2048) & 1 > 0)


def similar_pairs(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Pairs (a, b) of sets (sorted) at the similarity or over, enough of them to connect all that are: exact, by counting shared members.

    Each set in turn is held against those that nothing has reached yet, so sets alike cost one pass, not one a pair. Sizes
    and parities tell who may be as similar; only these sets are read.
    """
    size = np.array([len(s) for s in sets])
    bits = np.stack([parities(s) for s in sets]).view(np.uint64)
    left, open_, out = np.ones(len(sets), bool), [], []
    most = (1 - similarity) / (1 + similarity)
    while left.any():
        if not open_:
            open_.append(int(left.argmax()))
            left[open_[0]] = False
        c, own = open_.pop(), np.flatnonzero(left)
        low, high = np.minimum(size[own], size[c]), np.maximum(size[own], size[c])
        own, low, high = (x[low >= _least(high, similarity)] for x in (own, low, high))
        own = own[_distance(bits[own], bits[c]) <= most * (low + high) + 1e-6]
        hit = []
        for k in own.tolist():
            both = len(np.intersect1d(sets[c], sets[k], assume_unique=True))
            if both >= similarity * (size[k] + size[c] - both) - 1e-9:
                hit.append(k)
        left[hit] = False
        open_ += hit
        out += [(c, k) for k in hit]
    return out


def similar_groups(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, similarity: float = 0.8, proposed: DataFrame | None = None) -> DataFrame:
    """(doc_id, row, component_id, first) by similarity: documents linked by a Jaccard similarity of ``similarity`` or more of their word shingles.

    Exact but for collisions of 64-bit hashes. Shingles have one order, rare ones first; two sets at the limit share one
    of the first size - least + 1 of each, least being what they must share, so no pair is missed. The smaller set of a
    pair has it even earlier, since it must share 2 s / (1 + s) of its own size: there it leads. Documents that share
    such a shingle form a block with those that lead by it, apart where sizes rule a link out; equal blocks are one. So
    documents of one template, whose own text comes first, form no block unless they are alike enough. Inside a block sizes
    and parities tell which may link; what these connect meets with whole sets, each sent once, and is verified there.
    ``proposed`` (doc_id, component_id), as of near_duplicates: its components are blocks too, verified like the others; what
    fingerprints don't bring near comes from the shingles. Which shingles count as common comes from a sample: it bears on the size of blocks, never on the result. Equal sets
    are one node. ``row`` is a hash of the text, which
    tells rows of one id apart; ``first`` marks the smallest (doc_id, row) of a component. Nulls, empty texts, repeats and empty tables: as in
    near_duplicates.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("row", F.xxhash64("text"))

    def seen(batches):
        for pdf in batches:
            for at in range(0, len(pdf), 1000):
                h, n = np.unique(np.concatenate(list(shingle_sets(pdf["text"].iloc[at : at + 1000], shingle))), return_counts=True)
                yield pd.DataFrame({"h": h[n > 1].view(np.int64), "n": n[n > 1]})

    sample = texts.where(F.pmod(F.xxhash64("doc_id", "row"), F.lit(8)) == 0).select("text").mapInPandas(seen, "h long, n long")
    top = sample.groupBy("h").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "h").limit(200_000).toPandas().sort_values("h")
    shared = spark.sparkContext.broadcast((top["h"].to_numpy(np.int64), top["n"].to_numpy(np.int64)))

    def first(batches):
        common, often = shared.value
        for whole in batches:
            for start in range(0, len(whole), 1000):
                pdf = whole.iloc[start : start + 1000]
                node, size, bits, keys, leads = [], [], [], [], []
                for s in shingle_sets(pdf["text"], shingle):
                    h = s.view(np.int64)
                    n = np.zeros(len(h), np.int64)
                    if len(common):
                        at = np.minimum(np.searchsorted(common, h), len(common) - 1)
                        n = np.where(common[at] == h, often[at], 0)
                    node.append(int(_mixed(_mixed(s).sum(keepdims=True)).view(np.int64)[0]))
                    size.append(len(h))
                    bits.append(parities(s).tobytes())
                    keys.append(h[np.lexsort((h, n))[: len(h) - int(_least(len(h), similarity)) + 1]])
                    leads.append(len(h) - int(_least(len(h), 2 * similarity / (1 + similarity))) + 1)
                yield pd.DataFrame({"doc_id": pdf["doc_id"], "row": pdf["row"], "node": node, "size": size, "bits": bits, "keys": keys, "leads": leads})

    ids = dict(docs.select(F.col(doc_id).alias("doc_id")).dtypes)["doc_id"]
    rows = stage(texts.where("doc_id IS NOT NULL").mapInPandas(first, f"doc_id {ids}, row long, node long, size int, bits binary, keys array<long>, leads int"), "shingle-prefixes")

    def blocks(batches):
        for pdf in _whole_keys(batches, "key"):
            key, size, node, lead = (pdf[c].to_numpy() for c in ("key", "size", "node", "lead"))
            new = np.r_[True, (key[1:] != key[:-1]) | (size[1:] != size[:-1]) | (node[1:] != node[:-1])]
            key, size, node, lead = key[new], size[new], node[new], lead[new]
            # who doesn't lead meets those that do and are no larger, as far as sizes allow
            own = np.cumsum(np.r_[True, key[1:] != key[:-1]]) - 1
            span = int(size.max()) + 1
            leaders = (own * span + size)[lead]
            use = lead | (np.searchsorted(leaders, own * span + size, "right") > np.searchsorted(leaders, own * span + _least(size, similarity), "left"))
            key, size, node = key[use], size[use], node[use]
            if not len(key):
                continue
            start = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (_least(size[1:], similarity) > size[:-1])])
            n = np.diff(np.r_[start, len(key)])
            block = np.repeat(np.add.reduceat(_mixed(node.view(np.uint64)), start).view(np.int64), n)
            yield pd.DataFrame({"block": block, "node": node})[np.repeat(n > 1, n)].drop_duplicates()

    nodes = stage(rows.select("node", "size", "bits", "keys", "leads").dropDuplicates(["node"]), "shingle-nodes")
    keyed = nodes.select(F.posexplode("keys").alias("at", "key"), "size", "node", "leads").select("key", "size", "node", (F.col("at") < F.col("leads")).alias("lead"))
    keyed = keyed.repartition(tasks(spark), "key").sortWithinPartitions("key", "size", "node")
    found = keyed.mapInPandas(blocks, "block long, node long")
    if proposed is not None:
        near = proposed.where("component_id IS NOT NULL").select("doc_id", F.xxhash64("component_id", F.lit("fingerprints")).alias("block"))
        near = stage(near.join(rows.select("doc_id", "node"), "doc_id").select("block", "node").distinct(), "proposed-blocks")
        found = found.unionByName(near.join(near.groupBy("block").count().where("count > 1").select("block"), "block", "left_semi"))
    met = stage(found.distinct(), "blocks")
    one = nodes.select("node", "size", "bits")

    def plausible(batches):
        for pdf in _whole_keys(batches, "block"):
            block, node, size = (pdf[c].to_numpy() for c in ("block", "node", "size"))
            bits = np.frombuffer(b"".join(pdf["bits"]), np.uint64).reshape(len(pdf), -1)
            ends = np.r_[np.flatnonzero(block[1:] != block[:-1]) + 1, len(block)].tolist()
            found, at = [], 0
            for end in ends:
                found += [(node[at + a], node[at + b]) for a, b in plausible_pairs(bits[at:end], size[at:end], similarity)]
                at = end
            yield pd.DataFrame(found, columns=["a", "b"], dtype=np.int64).drop_duplicates()

    meeting = met.join(one, "node").repartition(tasks(spark), "block").sortWithinPartitions("block")
    near = components(meeting.mapInPandas(plausible, "a long, b long"))
    met = near.select("node", F.col("root").alias("block")).unionByName(near.select(F.col("root").alias("node"), F.col("root").alias("block")).distinct())
    own = rows.join(met.select("node"), "node", "left_semi").groupBy("node").agg(F.min(F.struct("doc_id", "row")).alias("own"))
    own = own.select("node", "own.doc_id", "own.row")

    def whole(batches):
        for pdf in batches:
            for at in range(0, len(pdf), 1000):
                part = pdf.iloc[at : at + 1000]
                yield pd.DataFrame({"node": part["node"], "shingles": [s.tobytes() for s in shingle_sets(part["text"], shingle)]})

    sets = texts.join(own, ["doc_id", "row"]).select("node", "text").mapInPandas(whole, "node long, shingles binary")

    def verified(batches):
        for pdf in _whole_keys(batches, "block"):
            pdf = pdf.drop_duplicates("node")  # a repeated row
            block, node = pdf["block"].to_numpy(), pdf["node"].to_numpy()
            ends = np.r_[np.flatnonzero(block[1:] != block[:-1]) + 1, len(block)].tolist()
            found, at = [], 0
            for end in ends:
                members = [np.frombuffer(s, np.uint64) for s in pdf["shingles"].iloc[at:end]]
                found += [(node[at + a], node[at + b]) for a, b in similar_pairs(members, similarity)]
                at = end
            yield pd.DataFrame(found, columns=["a", "b"], dtype=np.int64).drop_duplicates()

    meeting = met.join(sets, "node").repartition(tasks(spark), "block").sortWithinPartitions("block")
    roots = components(meeting.mapInPandas(verified, "a long, b long"))
    rooted = rows.select("doc_id", "row", "node").join(roots, "node", "left").select("doc_id", "row", F.coalesce("root", "node").alias("root"))
    rooted = stage(rooted, "similar-roots")
    named = rooted.groupBy("root").agg(F.min(F.struct("doc_id", "row")).alias("first"))
    first = F.struct("doc_id", "row").eqNullSafe(F.col("first"))
    out = rooted.join(named, "root").select("doc_id", "row", F.col("first.doc_id").alias("component_id"), first.alias("first"))
    return out.unionByName(texts.where("doc_id IS NULL").select("doc_id", "row", F.lit(None).cast(ids).alias("component_id"), F.lit(True).alias("first")))


def hex_of(fp: str = "fp"):
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
