"""Removal of repeated 100-byte strings by prefix-free parsing.

Rolling-hash triggers cut every text into phrases: the trigger of a 100-byte window is its 16-byte substring with the
smallest hash (the leftmost of equals), a phrase is a run of window starts with one trigger, and its entry is the bytes
that its windows cover. Equal windows have equal triggers, so what repeats is parsed alike wherever it stands. The
dictionary holds each distinct entry once, with its first place; all other places of the parse repeat it as a whole.
What is left are entries that agree in part: they share a trigger and 42 bytes on one side of it with another entry.
Their bytes meet by trigger and side, a suffix array of these dictionary entries ranks their windows, and ranks and
first places of the parse together give corpus order: in a run of equal ranks all windows but the first repeat.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_long, stage, tasks

LENGTH, TRIGGER = 100, 16
#: A window reaches SIDE bytes beyond its trigger on the left or on the right.
SIDE = (LENGTH - TRIGGER) // 2
BUFFER = 1 << 21
#: A place is a document, the key of its row (0 unless document ids repeat) and a byte.
_LOW = np.uint64((1 << 24) - 1)
_random = np.random.Generator(np.random.PCG64(20_240_101))
_BYTES = _random.integers(0, 1 << 63, (2, 256), np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def _rolled(buf: np.ndarray, length: int, kind: int) -> np.ndarray:
    """A hash of every substring of ``length`` bytes, by doubling."""
    parts, n, h, done, step = [], length, _BYTES[kind][buf], 1, _STEP[kind]
    at = 0
    while n:
        if n & 1:
            parts.append((h, at, done))
            at += done
        n >>= 1
        if n:
            h = h[:-done] * np.uint64(pow(step, done, 1 << 64)) + h[done:]
            done *= 2
    size = len(buf) - length + 1
    out = np.zeros(size, np.uint64)
    for h, at, done in parts:
        out = out * np.uint64(pow(step, done, 1 << 64)) + h[at : at + size]
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return out


def _segments(texts: list[bytes], most: int = BUFFER):
    """Runs of texts of about ``most`` bytes; of longer ones pieces that overlap by a window less a byte."""
    held, size = [], 0
    for k, text in enumerate(texts):
        if len(text) < LENGTH:
            continue
        for at in range(0, max(1, len(text) - LENGTH + 1), most):
            part = text[at : at + most + LENGTH - 1]
            if held and size + len(part) > most:
                yield held
                held, size = [], 0
            held.append((k, at, part))
            size += len(part)
    if held:
        yield held


def phrases(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """(text, first window start, info, hash of the trigger, hash of the entry) of all phrases.

    info: last window start less first (7 bits), trigger less first (7), and 16 bits each of the hashes of the trigger
    with SIDE bytes on its left and on its right (0 where no window of the phrase reaches so far).
    """
    from xxhash import xxh3_64_intdigest

    out: list[tuple] = []
    for held in _segments(texts):
        raw = b"".join(p for _, _, p in held)
        buf = np.frombuffer(raw, np.uint8)
        sizes = np.array([len(p) for _, _, p in held])
        ends = np.cumsum(sizes)
        g = _rolled(buf, TRIGGER, 0)
        v = (g & ~_LOW) | np.arange(len(g), dtype=np.uint64)
        span, want = 1, LENGTH - TRIGGER + 1
        while span < want:
            step = min(span, want - span)
            v = np.minimum(v[:-step], v[step:])
            span += step
        t = (v & _LOW).astype(np.int32)
        own = np.repeat(np.arange(len(held), dtype=np.int32), sizes)[: len(t)]
        good = np.arange(len(t)) + LENGTH <= ends[own]
        cut = np.ones(len(t) + 1, bool)
        cut[1:-1] = (t[1:] != t[:-1]) | (good[1:] != good[:-1]) | (own[1:] != own[:-1])
        at = np.flatnonzero(cut)
        lo, hi = at[:-1], at[1:]
        keep = good[lo]
        lo, hi = lo[keep], hi[keep]
        view = memoryview(raw)
        entry = np.fromiter((xxh3_64_intdigest(view[a:b]) for a, b in zip(lo.tolist(), (hi + LENGTH - 1).tolist(), strict=True)), np.uint64, len(lo))
        which = own[lo]
        text, base = np.array([k for k, _, _ in held]), np.array([a for _, a, _ in held]) - (ends - sizes)
        at, last = t[lo].astype(np.int64), hi - 1
        sides = _rolled(buf, TRIGGER + SIDE, 1) & np.uint64(0xFFFF) | np.uint64(1)
        left = np.where(lo <= at - SIDE, sides[np.maximum(at - SIDE, 0)], 0).astype(np.int64)
        right = np.where(last >= at - SIDE, sides[np.minimum(at, len(sides) - 1)], 0).astype(np.int64)
        info = (last - lo) | (at - lo) << 7 | left << 14 | right << 30
        out.append((text[which], lo + base[which], info, g[at], entry))
    if not out:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _first_of(keys: list[np.ndarray], place: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by keys and place; which rows start a key; which are at the key's first place."""
    order = np.lexsort((*place[::-1], *keys[::-1]))
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    first = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    here = np.ones(len(order), bool)
    for p in place:
        here &= p[order] == p[order][first]
    return order, new, here


#: Kinds of rows: TRAVELS to its key's task, REPEATS an earlier place, NEEDS its windows compared (a: where they meet).
TRAVELS, REPEATS, NEEDS = 0, 1, 2
_PLACE = ["doc", "key", "pos"]
_ROW = "a long, b long, doc long, key long, pos long, info long, kind int"


def _frame(a, b, place, info, kind) -> pd.DataFrame:
    signed = lambda x: x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64)
    columns = {"a": a, "b": b, **dict(zip(_PLACE, place, strict=True)), "info": info}
    return pd.DataFrame({**{k: signed(v) for k, v in columns.items()}, "kind": np.full(len(a), kind, np.int32)})


def _local(a, b, place, info) -> pd.DataFrame:
    """Of equal keys inside a task only the first place travels; the others are known to repeat it."""
    order, new, here = _first_of([a, b], place)
    go, known = order[new & here], order[~here]  # the very same place twice is one
    none = np.zeros(len(known), np.int64)
    parts = [_frame(a[go], b[go], [p[go] for p in place], info[go], TRAVELS), _frame(none, none, [p[known] for p in place], info[known] & 127, REPEATS)]
    return pd.concat(parts, ignore_index=True)


def _deal(rows: DataFrame) -> DataFrame:
    """Travelling rows to the task of their first key, known repeats anywhere; each task sorted by keys and place."""
    where = F.when(F.col("kind") == TRAVELS, F.xxhash64("a")).otherwise(F.xxhash64(*_PLACE))
    return rows.repartition(tasks(rows.sparkSession), where).sortWithinPartitions("kind", "a", "b", *_PLACE)


def _by_key(batches, handle):
    """Calls ``handle`` on runs of whole values of a; known repeats pass."""
    held: list[pd.DataFrame] = []
    for pdf in batches:
        passing = pdf["kind"] != TRAVELS
        if passing.any():
            yield pdf[passing]
            pdf = pdf[~passing]
        if not len(pdf):
            continue
        a = pdf["a"].to_numpy()
        cut = int(np.searchsorted(a, a[-1], "left"))
        if held and cut == 0 and held[-1]["a"].iat[-1] == a[-1]:
            held.append(pdf)
            continue
        if held or cut:
            yield handle(pd.concat([*held, pdf[:cut]]))
        held = [pdf[cut:]]
    if held:
        yield handle(pd.concat(held))


def _shared(group: np.ndarray, side: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Which rows have their side (not 0) in common with another row of their group."""
    out = np.zeros(len(group), bool)
    at = np.flatnonzero(among & (side > 0))
    _, back, n = np.unique(group[at] << 16 | side[at], return_inverse=True, return_counts=True)
    out[at] = n[back] > 1
    return out


def _dictionary(pdf: pd.DataFrame) -> pd.DataFrame:
    """Places of one trigger: all but the first of an entry repeat; windows of entries with a side in common need a look.

    The window at ``middle`` reaches SIDE bytes to either side of the trigger. Windows up to it hold the left side, those
    after it the right one; each part meets those with which it shares that side.
    """
    a, b, info = (pdf[c].to_numpy() for c in ("a", "b", "info"))
    place = [pdf[c].to_numpy() for c in _PLACE]
    order, new, here = _first_of([a, b], place)
    a, place, info = a[order], [p[order] for p in place], info[order]
    start = np.r_[True, a[1:] != a[:-1]][: len(a)]
    group = np.cumsum(start) - 1
    entry = new & (np.bincount(group, new, minlength=1) > 1)[group] if len(a) else new
    span, middle = info & 127, (info >> 7 & 127) - SIDE
    none = np.zeros((~here).sum(), np.int64)
    out = [_frame(none, none, [p[~here] for p in place], span[~here], REPEATS)]
    for k, (first, last) in enumerate(((np.zeros_like(middle), np.minimum(middle, span)), (np.maximum(middle + 1, 0), span))):
        side = info >> (14 + 16 * k) & 0xFFFF
        m = _shared(group, side, entry) & (first <= last)
        meet = (a[m].view(np.uint64) ^ (side[m] * 2 + k + 1).astype(np.uint64) * np.uint64(_STEP[0])).view(np.int64)
        out.append(_frame(meet, np.zeros(len(meet), np.int64), [place[0][m], place[1][m], place[2][m] + first[m]], (last - first)[m], NEEDS))
    return pd.concat(out, ignore_index=True)


def window_ranks(buf: np.ndarray) -> np.ndarray:
    """The place of every window of ``buf`` in its suffix array, as far as LENGTH bytes tell: equal windows, equal ranks.

    Prefix doubling, on the bytes themselves: 8 bytes as a number, then pairs of ranks at the distance reached.
    """
    words = np.zeros(len(buf) - 7, np.uint64)
    for k in range(8):
        words = words << np.uint64(8) | buf[k : k + len(words)]
    rank, have = np.unique(words, return_inverse=True)[1].reshape(-1), 8
    while have < LENGTH:
        step = min(have, LENGTH - have)
        n = len(rank) - step
        pair = rank[:n].astype(np.uint64) << np.uint64(32) | rank[step:].astype(np.uint64)
        rank, have = np.unique(pair, return_inverse=True)[1].reshape(-1), have + step
    return rank


def _equals(pdf: pd.DataFrame) -> pd.DataFrame:
    """Windows of the entries of one or more meeting points, in corpus order: all but the first of equals repeat."""
    raw = pdf["raw"].to_list()
    size = np.array([len(r) for r in raw])
    rank = window_ranks(np.frombuffer(b"".join(raw), np.uint8))
    n, start = size - LENGTH + 1, np.cumsum(size) - size
    of = np.repeat(np.arange(len(raw)), n)
    offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    place = [pdf[c].to_numpy()[of] for c in _PLACE]
    place[2] = place[2] + offset
    order, _, here = _first_of([rank[start[of] + offset]], place)
    order = order[~here]
    none = np.zeros(len(order), np.int64)
    return _frame(none, none, [p[order] for p in place], none, REPEATS)


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc (null: the smallest long), key (a hash of the text where ids repeat; negative where there is no id), raw text."""
    own = F.col(doc_id).cast("long")
    doc = F.coalesce(own, F.lit(-(1 << 63)))
    rows = docs.select(doc.alias("doc"), own.isNull().alias("none"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("raw"))
    repeated = bool(docs.groupBy(own).count().where("count > 1").limit(1).count())
    tie = F.shiftrightunsigned(F.xxhash64("raw"), 1) if repeated else F.lit(0).cast("long")
    return rows.select("doc", F.when(F.col("none"), -1 - tie).otherwise(tie).alias("key"), "raw")


def _zipped(rows: DataFrame) -> DataFrame:
    """Texts as zstd frames: a third less to move than as Spark compresses them."""

    @F.pandas_udf("binary")
    def zipped(raw: pd.Series) -> pd.Series:
        import zstandard

        return raw.map(zstandard.ZstdCompressor(level=3).compress)

    return rows.select("doc", "key", zipped("raw").alias("z"))


def repeated_places(rows: DataFrame) -> DataFrame:
    """(doc, key, pos, span): all window starts pos .. pos + span that repeat an earlier place; ``rows``: see _keyed."""

    def parsed(batches):
        for pdf in batches:
            text, lo, info, trigger, entry = phrases(pdf["raw"].to_list())
            yield _local(trigger, entry, [pdf["doc"].to_numpy()[text], pdf["key"].to_numpy()[text], lo], info)

    entries = stage(_deal(rows.select("doc", "key", "raw").mapInPandas(parsed, _ROW)).mapInPandas(lambda b: _by_key(b, _dictionary), _ROW), "entries")
    needs = entries.where(F.col("kind") == NEEDS).groupBy("doc", "key").agg(F.collect_list(F.struct("a", "pos", "info")).alias("spots"))

    def parts(batches):
        import zstandard

        unzip = zstandard.ZstdDecompressor().decompress
        for pdf in batches:
            out, seen = [], set()
            for doc, key, z, spots in zip(pdf["doc"], pdf["key"], pdf["z"], pdf["spots"], strict=True):
                if (doc, key) in seen:
                    continue
                seen.add((doc, key))
                raw = unzip(z)
                out += [(s["a"], doc, key, s["pos"], raw[s["pos"] : s["pos"] + s["info"] + LENGTH], TRAVELS) for s in spots]
            yield pd.DataFrame(out, columns=["a", "doc", "key", "pos", "raw", "kind"])

    spans = needs.join(_zipped(rows), ["doc", "key"]).select("doc", "key", "z", "spots")
    spans = spans.mapInPandas(parts, "a long, doc long, key long, pos long, raw binary, kind int")
    met = spans.repartition(tasks(rows.sparkSession), "a").sortWithinPartitions("a")
    found = met.mapInPandas(lambda b: _by_key(b, _equals), _ROW)
    place = [*_PLACE, F.col("info").cast("int").alias("span")]
    return entries.where(F.col("kind") == REPEATS).select(*place).unionByName(found.select(*place))


def remove_repeats(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the remaining bytes) of every row.

    Removed is each byte that lies in a 100-byte string that also starts earlier: in a document with a smaller id, or
    earlier in the same one; judged on the input. Texts are taken as UTF-8, nulls as empty; a null id comes before all
    others. Repeated equal rows are one document, and both lose the same; rows that share an id but not a text, those
    without an id too, are told apart and ordered by a 63-bit hash of the text. Texts under 100 bytes never change, very
    long ones are cut in overlapping buffers. Only id and text are read. An empty table gives an empty table.
    """
    rows = _keyed(docs, doc_id, text)
    spots = repeated_places(rows).groupBy("doc", "key").agg(F.collect_list("pos").alias("lo"), F.collect_list("span").alias("span"))

    def kept(batches):
        import zstandard

        unzip = zstandard.ZstdDecompressor().decompress
        for pdf in batches:
            out = []
            for doc, key, z, lo, span in zip(pdf["doc"], pdf["key"], pdf["z"], pdf["lo"], pdf["span"], strict=True):
                raw = unzip(z)
                change = np.zeros(len(raw) + 1, np.int32)
                if lo is not None:
                    lo = np.asarray(lo, np.int64)
                    np.add.at(change, lo, 1)
                    np.add.at(change, lo + np.asarray(span, np.int64) + LENGTH, -1)
                gone = np.cumsum(change[:-1]) > 0
                left = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                runs = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
                out.append((None if key < 0 else str(doc), len(raw), int(gone.sum()), runs, hashlib.sha256(left).hexdigest(), left))
            yield pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    joined = _zipped(rows).join(spots, ["doc", "key"], "left").select("doc", "key", "z", "lo", "span")
    return as_long(joined.mapInPandas(kept, "doc_id string, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"))
