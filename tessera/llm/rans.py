"""Token-id output: static range asymmetric numeral system (rANS) with a shared frequency table.

The format. A folder with two Parquet tables:

* ``table``: one row (scale, symbols, frequencies, crc32): symbols unsigned little-endian 32-bit frequencies that sum to
  2**scale, and their checksum;
* ``blocks``: blocks in ascending document order, rows (shard, block, docs, ids, payload); ``docs`` and ``ids`` count the
  documents and ids of the block.

A payload is, little-endian:

    magic "RNS2", then unsigned 32-bit: scale bits, documents, segments
    documents x (byte: 1 for a document without an id, signed 64-bit id, unsigned 32-bit number of ids)
    segments x checkpoint: ids, lanes, offset of its words (from the end of the checkpoints), words, crc32 of its ids
    for each segment: lanes x unsigned 64-bit final states, then its unsigned 32-bit words

Ids of a segment go round its lanes (id i to lane i mod lanes), so all lanes decode in step. A segment needs nothing but
the shared table and its checkpoint; blocks and the segments of a long document decode in parallel.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_long, as_text, byte_coder, shared_dir, stage, tasks, tokenizer_path

SCALE, LANES, SEGMENT, BLOCK = 20, 2048, 1 << 18, 1 << 18
_LOW = np.uint64(1 << 31)


def normalise(counts: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """Frequencies that sum to 2**scale, at least 1 for each symbol, seen or not."""
    room = (1 << scale) - len(counts)
    share = counts / max(1, counts.sum()) * room
    f = np.floor(share).astype(np.int64)
    rest = room - int(f.sum())
    order = np.lexsort((np.arange(len(f)), -(share - f)))
    f += rest // len(f)
    f[order[: rest % len(f)]] += 1
    return f + 1


class Table:
    """Frequencies, starts and the symbol of each slot."""

    def __init__(self, f: np.ndarray, scale: int = SCALE):
        self.f, self.scale = f.astype(np.uint64), scale
        self.start = np.concatenate([[0], np.cumsum(f)[:-1]]).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(f), dtype=np.uint32), f)

    def encode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Final states by lane and the words in the order in which the decoder reads them."""
        lanes = max(1, min(LANES, -(-len(ids) // 16)))
        x = np.full(lanes, _LOW, np.uint64)
        f, start = self.f[ids], self.start[ids]
        words: list[np.ndarray] = []
        shift, scale = np.uint64(32), np.uint64(self.scale)
        top = np.uint64(63 - self.scale)
        for at in range((max(0, len(ids) - 1) // lanes) * lanes, -1, -lanes):
            own_f, own_s = f[at : at + lanes], start[at : at + lanes]
            y = x[: len(own_f)]
            full = y >= (own_f << top)
            if full.any():
                words.append(y[full].astype(np.uint32)[::-1])
                y = np.where(full, y >> shift, y)
            q = y // own_f
            x[: len(own_f)] = (q << scale) + (y - q * own_f) + own_s
        return x, (np.concatenate(words)[::-1] if words else np.zeros(0, np.uint32)).astype("<u4")

    def decode(self, states: np.ndarray, words: np.ndarray, n: int) -> np.ndarray:
        x, at, lanes = states.astype(np.uint64), 0, len(states)
        out = np.empty(n, np.uint32)
        mask, scale, shift = np.uint64((1 << self.scale) - 1), np.uint64(self.scale), np.uint64(32)
        wide = words.astype(np.uint64)
        for first in range(0, n, lanes):
            y = x[: min(lanes, n - first)]
            slot = y & mask
            s = self.symbol[slot]
            out[first : first + lanes] = s
            y = self.f[s] * (y >> scale) + slot - self.start[s]
            low = np.flatnonzero(y < _LOW)
            if len(low):
                y[low] = (y[low] << shift) | wide[at : at + len(low)]
                at += len(low)
            x[: len(y)] = y
        return out


_DOC = struct.Struct("<BqI")


def pack_block(doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray, table: Table) -> bytes:
    points, body, at = [], [], 0
    for first in range(0, len(ids), SEGMENT):
        own = ids[first : first + SEGMENT]
        states, words = table.encode(own)
        points.append(struct.pack("<5I", len(own), len(states), at, len(words), zlib.crc32(own.astype("<u4").tobytes())))
        body += [states.astype("<u8").tobytes(), words.tobytes()]
        at += 8 * len(states) + 4 * len(words)
    docs = b"".join(_DOC.pack(d is None, d or 0, n) for d, n in zip(doc_ids, counts.tolist(), strict=True))
    return b"".join([b"RNS2", struct.pack("<3I", table.scale, len(doc_ids), len(points)), docs, *points, *body])


def unpack_block(payload: bytes, table: Table) -> tuple[list[int | None], list[int], np.ndarray]:
    """(document ids, number of ids of each, all ids); a damaged block is an error."""
    scale, n_docs, n_points = struct.unpack_from("<3I", payload, 4)
    if payload[:4] != b"RNS2" or scale != table.scale:
        raise ValueError("not a block of this format and table")
    docs = [_DOC.unpack_from(payload, 16 + _DOC.size * k) for k in range(n_docs)]
    head = 16 + _DOC.size * n_docs
    out = []
    for k in range(n_points):
        n, lanes, at, n_words, crc = struct.unpack_from("<5I", payload, head + 20 * k)
        at += head + 20 * n_points
        states = np.frombuffer(payload, "<u8", lanes, at)
        ids = table.decode(states, np.frombuffer(payload, "<u4", n_words, at + 8 * lanes), n)
        if zlib.crc32(ids.astype("<u4").tobytes()) != crc:
            raise ValueError(f"checksum of segment {k} fails")
        out.append(ids)
    return [None if none else d for none, d, _ in docs], [n for _, _, n in docs], np.concatenate(out) if out else np.zeros(0, np.uint32)


def _token_ids(rows: DataFrame, path: str, end: int, width: str) -> DataFrame:
    """(doc_id, tie, ids): the ids of every whole text and the end id, little-endian; each text is tokenized once."""

    def coded(batches):
        coder = byte_coder(path)
        for pdf in batches:
            texts = pdf.pop("text").to_list()
            for at, ids, counts in coder.batches(texts):
                stop = np.cumsum(counts)
                small = ids.astype(width)
                own = [np.append(small[b - n : b], np.array(end, width)).tobytes() for b, n in zip(stop.tolist(), counts.tolist(), strict=True)]
                yield pdf.iloc[at : at + len(counts)].assign(ids=own)

    coded_rows = rows.select(as_text("doc_id").alias("doc_id"), F.xxhash64("text").alias("tie"), "text").mapInPandas(coded, "doc_id string, tie long, ids binary")
    return as_long(coded_rows)


def frequencies(coded: DataFrame, width: str, vocabulary: int) -> np.ndarray:
    """Counts of all ids; at most ``vocabulary`` sums reach the driver."""

    def counted(batches):
        total = np.zeros(vocabulary, np.int64)
        for pdf in batches:
            for at in range(0, len(pdf), 500):
                total += np.bincount(np.frombuffer(b"".join(pdf["ids"].iloc[at : at + 500]), width), minlength=vocabulary)
        seen = np.flatnonzero(total)
        yield pd.DataFrame({"id": seen, "n": total[seen]})

    got = coded.select("ids").mapInPandas(counted, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(vocabulary, np.int64)
    counts[got["id"].to_numpy(np.int64)] = got["n"].to_numpy(np.int64)
    return counts


def write(docs: DataFrame, *, path: str | None = None, doc_id: str = "doc_id", text: str = "text", end: int = 0, vocabulary: int = 50_257, folder: str | None = None) -> str:
    """Encode every whole text and write the files of the format; the folder they are in.

    Texts are tokenized once; their ids (two bytes each in a vocabulary of up to 65,536) are staged, counted, and dealt by
    ranges of (id, hash of text), so shards ascend and a repeated id stays together. Documents without an id come first.
    A block ends with the first document that brings it to BLOCK ids; a long document is a block of several segments.
    """
    spark = docs.sparkSession
    width = "<u2" if vocabulary <= 1 << 16 else "<u4"
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    ids_of = stage(_token_ids(rows, path or tokenizer_path("byte_bpe_50k.json"), end, width), "token-ids")
    f = normalise(frequencies(ids_of, width, vocabulary))
    folder = folder or f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    raw = f.astype("<u4").tobytes()
    head = spark.createDataFrame([(SCALE, len(f), bytearray(raw), zlib.crc32(raw))], "scale int, symbols int, frequencies binary, crc32 long")
    head.write.parquet(f"{folder}/table")
    shared = spark.sparkContext.broadcast(f)

    def coded(batches):
        from pyspark import TaskContext

        shard, block, table = TaskContext.get().partitionId(), 0, Table(shared.value)
        held: list[tuple] = []
        n_held = 0

        def closed():
            own = np.concatenate([h[1] for h in held])
            counts = np.array([len(h[1]) for h in held])
            return pd.DataFrame({"shard": [shard], "block": [block], "docs": [len(held)], "ids": [len(own)], "payload": [pack_block([h[0] for h in held], counts, own, table)]})

        for pdf in batches:
            for key, ids in zip(pdf["doc_id"], pdf["ids"], strict=True):
                held.append((None if pd.isna(key) else int(key), np.frombuffer(ids, width).astype(np.uint32)))
                n_held += len(held[-1][1])
                if n_held >= BLOCK:
                    yield closed()
                    held, n_held, block = [], 0, block + 1
        if held:
            yield closed()

    dealt = ids_of.repartitionByRange(tasks(spark), "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    dealt = dealt.select(as_text("doc_id").alias("doc_id"), "ids")
    blocks = dealt.mapInPandas(coded, "shard int, block int, docs long, ids long, payload binary")
    blocks.write.option("compression", "none").parquet(f"{folder}/blocks")
    return folder


def read(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32, decoded from the files in ``folder``.

    Starts are prefix sums in two steps: over the shards' totals (one row each) and over the blocks of a shard; inside a
    block the payload has them. Totals are of the size of the cluster's partitions, not of the data.
    """
    from pyspark.sql import Window as W

    head = spark.read.parquet(f"{folder}/table").first()
    if zlib.crc32(head["frequencies"]) != head["crc32"]:
        raise ValueError("checksum of the frequency table fails")
    share = spark.sparkContext.broadcast(np.frombuffer(head["frequencies"], "<u4").astype(np.int64))
    scale = head["scale"]
    blocks = spark.read.schema("shard int, block int, docs long, ids long, payload binary").parquet(f"{folder}/blocks")
    slim = blocks.select("shard", "block", "ids")
    shards = slim.groupBy("shard").agg(F.sum("ids").alias("n"))
    base = F.coalesce(F.sum("n").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    inside = F.coalesce(F.sum("ids").over(W.partitionBy("shard").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    first = slim.withColumn("inside", inside).join(shards.select("shard", base.alias("base")), "shard").select("shard", "block", (F.col("base") + F.col("inside")).alias("first"))

    def decoded(batches):
        own = Table(share.value, scale)
        for pdf in batches:
            for start, payload in zip(pdf["first"], pdf["payload"], strict=True):
                doc_ids, counts, ids = unpack_block(payload, own)
                stop = np.cumsum(counts)
                raw = ids.astype("<u4")
                crc = [zlib.crc32(raw[b - n : b].tobytes()) for b, n in zip(stop, counts, strict=True)]
                yield pd.DataFrame({"doc_id": pd.array(doc_ids, "Int64"), "start": start + stop - counts, "n_tokens": counts, "ids_crc32": crc})

    joined = blocks.select("shard", "block", "payload").join(first, ["shard", "block"])
    return joined.select("first", "payload").mapInPandas(decoded, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(spark: SparkSession, docs: DataFrame, **how) -> DataFrame:
    """Write all texts and read them back.

    A null text is empty and has the end id alone; documents without an id come first and read back without one; rows
    that share an id, repeated ones too, are written each, in the order of a hash of the text. Only id and text are read,
    so other columns don't matter. A text is tokenized whole in one task, its ids may span several segments. An empty
    table writes no block and reads back empty.
    """
    return read(spark, write(docs, **how))
