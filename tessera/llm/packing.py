"""Best-fit packing: a configuration linear program over the length histogram, solved by multiplicative weights."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import as_long, as_text, stage, tokenizer_path, word_coder

#: Rows of one length are ranked inside this many hash classes.
CLASSES = 256


def pieces(docs: DataFrame, *, path: str, doc_id: str = "doc_id", text: str = "text", size: int = 4096, end: int = 1) -> DataFrame:
    """A row per piece of each document: doc_id, row (tells apart rows of one id), piece, start, length, ids_crc32."""
    rows = docs.select(as_text(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def cut(batches):
        coder = word_coder(path)
        for pdf in batches:
            texts = pdf["text"].to_list()
            ids_of, out = pdf["doc_id"], []
            for at, ids, counts in coder.batches(texts):
                stop = np.cumsum(counts)
                for k, (a, b) in enumerate(zip(stop - counts, stop, strict=True)):
                    own = np.append(ids[a:b], end).astype("<u4")
                    row = zlib.crc32(texts[at + k].encode("utf-8", "surrogatepass"))
                    for piece, first in enumerate(range(0, len(own), size)):
                        part = own[first : first + size]
                        out.append((ids_of.iat[at + k], row, piece, first, len(part), zlib.crc32(part.tobytes())))
            yield pd.DataFrame(out, columns=["doc_id", "row", "piece", "start", "length", "ids_crc32"])

    return as_long(rows.mapInPandas(cut, "doc_id string, row long, piece int, start long, length long, ids_crc32 long"))


def price(value: np.ndarray, size: int, most: np.ndarray | None = None) -> tuple[float, dict[int, int]]:
    """The most valuable filling of one sequence with at most ``most[l]`` pieces of length l: dynamic program over its room.

    value[l]: what a piece of length l counts. Copies of a length are taken in lots of 1, 2, 4, ... and a rest.
    """
    lots = []
    for length in np.flatnonzero(value[1:] > 0)[::-1].tolist():
        length += 1
        n, lot = min(size // length, size if most is None else int(most[length])), 1
        while n > 0:
            lots.append((length, min(lot, n)))
            n, lot = n - lot, 2 * lot
    best, took, space = np.zeros(size + 1), np.zeros((len(lots), size + 1), bool), np.empty(size + 1)
    worth = value.tolist()
    for i, (length, k) in enumerate(lots):
        room = length * k
        got, own = space[room:], best[room:]
        np.add(best[: size + 1 - room], worth[length] * k, got)
        np.greater(got, own, took[i, room:])
        np.maximum(own, got, own)
    config: dict[int, int] = {}
    room = size
    for i in range(len(lots) - 1, -1, -1):
        if took[i, room]:
            length, k = lots[i]
            config[length] = config.get(length, 0) + k
            room -= length * k
    return float(best[size]), config


def configurations(counts: np.ndarray, size: int, *, levels: int = 10, rest: float = 0.02, **how):
    """Yields (plan, counts it leaves) after each level; a plan lists (how many sequences, pieces by length in each).

    Covering program: the fewest sequences such that every length is covered counts[l] times. Its solution uses all
    lengths in proportion; so the program is covered in ``levels`` equal shares of every count (rounded by a fixed
    fraction of each length's own, so that single pieces are spread over the levels), each by multiplicative weights
    (see covering). What a level can't fill stays for the next one. ``rest`` of every count isn't covered: it is a like
    picture of the whole histogram, from which best fit closes what room is left.
    """
    own = np.arange(len(counts)) * ((5**0.5 - 1) / 2) % 1
    left, plan = counts.astype(np.int64).copy(), []
    for k in range(1, levels + 1):
        share = np.minimum(counts, np.floor(min(k / levels, 1 - rest) * counts + own).astype(np.int64)) - (counts - left)
        got, over = covering(share, size, **how)
        plan = plan + got
        left = left - (share - over)
        yield plan, left


def covering(counts: np.ndarray, size: int, *, step: float = 0.3, tilt: float = 0.002, partial: int = 96, gap: float = 0.0003) -> tuple[list[tuple[int, dict[int, int]]], np.ndarray]:
    """Like configurations, for one share: multiplicative weights with knapsack pricing.

    A length's weight falls as it gets covered. Each round prices the most valuable filling of a sequence, a piece
    counting its share of the room and up to ``tilt`` of that more by weight and length, from ``partial`` lengths (half of
    them those of the largest weight, half spread evenly over all that are left, so that sums come out), from four times
    as many where these don't fill it, and at last from all. Shares of the room are a solution of the dual program, so a
    filling without room left is an optimal column, whatever its weights; these choose among such. Use goes by powers of
    two, from the largest count down to one: at ``unit``, a filling takes of each length no more copies than are left for
    ``unit`` sequences, so it is used a whole number of times, ``unit`` or until its least covered length has moved one
    step. A unit ends when nothing fills a sequence to within ``gap``.
    """
    left = counts.astype(np.int64).copy()
    plan: list[tuple[int, dict[int, int]]] = []
    unit = 1 << max(0, int(left.max()).bit_length() - 1)
    while unit and left.any():
        most = left // unit
        have = np.flatnonzero(most)
        weight = np.exp((left[have] / counts[have] - 1) / step * np.log(2))
        value = np.zeros(len(counts))
        value[have] = have / size * (1 + tilt * (weight + have / size) / 2)
        order = have[np.lexsort((-have, -weight))]
        for n in (partial, 4 * partial, len(order)):
            some, even = np.zeros(len(counts)), np.linspace(0, len(have) - 1, n - n // 2).astype(int)
            among = np.append(order[: n // 2], have[even]) if n < len(have) else have
            some[among] = value[among]
            _, config = price(some, size, most)
            if full := sum(n * k for n, k in config.items()) >= (1 - gap) * size:
                break
        if not full:
            unit //= 2
            continue
        often = max(unit, int(min(step * left[n] / k for n, k in config.items())))
        plan.append((often, config))
        for n, k in config.items():
            left[n] -= often * k
    return plan, left


def solve(counts: np.ndarray, size: int) -> list[tuple[int, dict[int, int]]]:
    """(how many sequences, pieces by length in each) for a histogram of lengths below ``size``.

    The configuration program's sequences; what it leaves is placed by best fit, longest first, on the histogram. Where
    large pieces find no partners, the deeper levels take what best fit needs: of the last two depths and the first the
    one with the fewest sequences counts, of equals the deepest.
    """
    first, *_, before, last = configurations(counts, size)
    full = [_best_fit(list(plan), left, size) for plan, left in (last, before, first)]
    return min(full, key=lambda groups: sum(n for n, _ in groups))


def _best_fit(plan: list[tuple[int, dict[int, int]]], left: np.ndarray, size: int) -> list[tuple[int, dict[int, int]]]:
    """Place what is left, longest first, each in the fullest group of equal sequences that has room."""
    by_room: dict[int, list] = {}
    for n, config in plan:
        by_room.setdefault(size - sum(k * v for k, v in config.items()), []).append((n, config))
    rooms = np.zeros(size + 1, bool)
    rooms[list(by_room)] = True

    def put(room: int, n: int, config: dict) -> None:
        by_room.setdefault(room, []).append((n, config))
        rooms[room] = True

    for length in np.flatnonzero(left)[::-1].tolist():
        n = int(left[length])
        while n:
            fit = np.flatnonzero(rooms[length:])
            if not len(fit):
                each = size // length
                whole, rest = divmod(n, each)
                if whole:
                    put(size - each * length, whole, {length: each})
                if rest:
                    put(size - rest * length, 1, {length: rest})
                break
            room = int(fit[0]) + length
            group = by_room[room].pop()
            if not by_room[room]:
                rooms[room] = False
            each = min(room // length, n)
            take = min(group[0], n // each)
            if take < group[0]:
                put(room, group[0] - take, group[1])
            put(room - each * length, take, {**group[1], length: group[1].get(length, 0) + each})
            n -= each * take
    return [g for own in by_room.values() for g in own]


def places(plan: list[tuple[int, dict[int, int]]]) -> dict[str, np.ndarray]:
    """For each (length, run of ranks): first rank, pieces in a sequence, first sequence, offset of the first."""
    out, at, sequence = [], {}, 0
    for n, config in plan:
        offset = 0
        for length, k in sorted(config.items(), reverse=True):
            rank = at.get(length, 0)
            out.append((length, rank, k, sequence, offset))
            at[length] = rank + n * k
            offset += k * length
        sequence += n
    table = np.array(sorted(out), np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank", "each", "sequence", "offset"), table.T, strict=True))


def pack(docs: DataFrame, *, path: str | None = None, doc_id: str = "doc_id", text: str = "text", size: int = 4096, end: int = 1) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece.

    Null texts are empty and give the end id alone; an empty table gives an empty table; repeated rows are packed each.
    Only the length histogram (at most ``size`` counts) reaches the driver, and only the places by length (a few runs
    per length, independent of the number of rows) come back. Ranks inside a length are taken per hash class, so a
    length that most documents share isn't ranked in one task.
    """
    cut = stage(pieces(docs, path=path or tokenizer_path("word_bpe_49k.json"), doc_id=doc_id, text=text, size=size, end=end), "pieces")
    keyed = cut.withColumn("class", F.pmod(F.xxhash64("doc_id", "row", "piece"), F.lit(CLASSES)).cast("int"))
    per_class = stage(keyed.groupBy("length", "class").agg(F.count("*").alias("n")), "piece-counts")
    counts = np.zeros(size + 1, np.int64)
    for r in per_class.groupBy("length").agg(F.sum("n").alias("n")).collect():
        counts[r["length"]] = r["n"]
    whole, counts[size] = int(counts[size]), 0
    runs = places(solve(counts, size) + ([(whole, {size: 1})] if whole else []))
    base = F.coalesce(F.sum("n").over(W.partitionBy("length").orderBy("class").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranked = (
        keyed.join(per_class.select("length", "class", base.alias("base")), ["length", "class"])
        .withColumn("rank", F.col("base") + F.row_number().over(W.partitionBy("length", "class").orderBy("doc_id", "row", "piece")) - 1)
        .select("doc_id", "piece", "start", "length", "ids_crc32", "rank")
    )
    shared = docs.sparkSession.sparkContext.broadcast(runs)

    def placed(batches):
        r = shared.value
        span = np.int64(1) << 48
        key = r["length"] * span + r["rank"]
        for pdf in batches:
            length, rank = pdf["length"].to_numpy(), pdf.pop("rank").to_numpy()
            k = np.searchsorted(key, length * span + rank, "right") - 1
            sequence, place = np.divmod(rank - r["rank"][k], r["each"][k])
            yield pdf.assign(sequence_id=r["sequence"][k] + sequence, offset=r["offset"][k] + place * length)

    ranked = ranked.withColumn("doc_id", as_text("doc_id"))
    return as_long(ranked.mapInPandas(placed, "doc_id string, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"))
