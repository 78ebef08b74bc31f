"""Fill-in-middle by displacement scatter: one shift per byte takes a batch of texts to its outputs and back.

A batch is one buffer of UTF-8 bytes. Its tokens start where a code point starts and no letter run goes on; scanned cuts
split each text into prefix, middle and suffix, which only move. A difference array of the segments' shifts, summed up,
gives every byte its place in the output buffer: numpy scatters the bytes there, and gathers them back.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free

#: A token is a run of A-Z and a-z, or one other code point. Marks of the three parts.
MARKS = (b"<P>", b"<S>", b"<M>")
PLAIN, PSM, SPM = 0, 1, 2
FORMS = ("plain", "psm", "spm")
#: Bytes that are scattered at once; a longer text is one buffer.
BLOCK = 1 << 22


def _blocks(offsets: np.ndarray):
    """Runs of texts (from, to) of about BLOCK bytes."""
    at = 0
    while at < len(offsets) - 1:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BLOCK, "right")) - 1)
        yield at, to
        at = to


def _marks_in(buf: np.ndarray, ends: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of marks that lie inside one text, and which mark (its middle byte)."""
    at = np.flatnonzero((buf[:-2] == 60) & (buf[2:] == 62)) if len(buf) > 2 else np.zeros(0, np.int64)
    kind = buf[at + 1] if len(at) else np.zeros(0, np.uint8)
    good = np.isin(kind, [m[1] for m in MARKS])
    at, kind = at[good], kind[good]
    good = at + 3 <= ends[of[at]]
    return at[good], kind[good]


def cuts(buf: np.ndarray, sizes: np.ndarray, h: np.ndarray, plain: int, spm: int) -> tuple[np.ndarray, ...]:
    """(tokens, form, first cut, second cut in bytes from the text's start, code points of prefix and of middle) by text."""
    ends = np.cumsum(sizes)
    starts, of = ends - sizes, np.repeat(np.arange(len(sizes)), sizes)
    low = buf | 32
    letter = (low >= 97) & (low <= 122) & (buf < 128)
    point = (buf & 0xC0) != 0x80
    runs_on = np.zeros(len(buf), bool)
    runs_on[1:] = letter[1:] & letter[:-1]
    runs_on[starts[sizes > 0]] = False
    token = point & ~runs_on
    places = np.append(np.flatnonzero(token), len(buf))
    before = np.concatenate([[0], np.cumsum(token)])
    n = before[ends] - before[starts]
    a, b = h[:, 0] % (n + 1), h[:, 1] % (n + 1)
    cut = lambda units: np.where(units < n, places[np.minimum(before[starts] + units, len(places) - 1)], ends) - starts
    first, second = cut(np.minimum(a, b)), cut(np.maximum(a, b))
    held, _ = _marks_in(buf, ends, of)
    marked = np.bincount(of[held], minlength=len(sizes)) > 0
    form = np.where((sizes == 0) | marked | (h[:, 2] % 100 >= plain), PLAIN, np.where(h[:, 3] % 100 < spm, SPM, PSM))
    points = np.concatenate([[0], np.cumsum(point)])
    return n, form, first, second, points[starts + first] - points[starts], points[starts + second] - points[starts + first]


def _shifts(sizes: np.ndarray, form: np.ndarray, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts cut at first and second: each byte's displacement, output sizes, places of the marks (texts not plain x 3)."""
    starts = np.cumsum(sizes) - sizes
    out = sizes + np.where(form == PLAIN, 0, 9)
    base = np.cumsum(out) - out
    prefix, middle, suffix = first, second - first, sizes - second
    psm, spm = form == PSM, form == SPM
    # where each part begins in its output, behind its mark
    p = np.where(psm, 3, np.where(spm, 6 + suffix, 0))
    s = np.where(psm, 6 + prefix, np.where(spm, 3, second))
    m = np.where(psm, 9 + prefix + suffix, np.where(spm, 9 + suffix + prefix, first))
    change = np.zeros(int(sizes.sum()) + 1, np.int64)
    last = np.zeros(1, np.int64)
    at = np.stack([starts, starts + first, starts + second], 1).ravel()
    shift = np.stack([base + p - starts, base + m - starts - first, base + s - starts - second], 1).ravel()
    np.add.at(change, at, np.diff(shift, prepend=last))
    marks = np.stack([base + p, base + s, base + m], 1)[form != PLAIN] - 3
    return np.cumsum(change[:-1]), out, marks


def scatter(buf: np.ndarray, sizes: np.ndarray, form: np.ndarray, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Outputs, one after the other, and their sizes."""
    shift, out, marks = _shifts(sizes, form, first, second)
    done = np.empty(int(out.sum()), np.uint8)
    done[np.arange(len(buf)) + shift] = buf
    for k, mark in enumerate(MARKS):
        for j, byte in enumerate(mark):
            done[marks[:, k] + j] = byte
    return done, out


def gather(done: np.ndarray, out: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts, one after the other, and their sizes, from outputs and forms alone: marks give the cuts."""
    ends = np.cumsum(out)
    base, of = ends - out, np.repeat(np.arange(len(out)), out)
    at, kind = _marks_in(done, ends, of)
    moved = form[of[at]] != PLAIN
    at, kind = at[moved], kind[moved]
    place = {}
    for mark in MARKS:
        place[mark[1]] = np.zeros(len(out), np.int64)
        own = kind == mark[1]
        place[mark[1]][of[at[own]]] = at[own] - base[of[at[own]]]
    p, s, m = (place[mark[1]] for mark in MARKS)
    psm = form == PSM
    sizes = out - np.where(form == PLAIN, 0, 9)
    prefix = np.where(form == PLAIN, 0, np.where(psm, s - p, m - p) - 3)
    middle = np.where(form == PLAIN, 0, out - m - 3)
    shift, _, _ = _shifts(sizes, form, prefix, prefix + middle)
    return done[np.arange(int(sizes.sum())) + shift], sizes


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary column without nulls, and its offsets in them."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), offsets


def _binary(buf: np.ndarray, sizes: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(buf))]).cast(pa.binary())


def _mapped(batch: pa.RecordBatch, text: str, handle) -> list[pa.Table]:
    """``handle(bytes, sizes, rows)`` -> columns, by runs of rows of bounded size; the other columns pass as they are."""
    buf, offsets = _bytes_of(batch.column(batch.schema.get_field_index(text)))
    for a, b in _blocks(offsets):
        rows = batch.slice(a, b - a)
        yield rows, handle(buf[offsets[a] : offsets[b]], np.diff(offsets[a : b + 1]), rows)


def transform(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", seed: int = 1, rate: int = 90, spm: int = 20) -> DataFrame:
    """``docs`` with n, form, prefix_chars, middle_chars and output.

    Cuts and form follow from sha256 of ``seed:`` and the id's digits (nothing for a null id): rows that share an id are
    cut by the same numbers. ``rate`` of a hundred texts are transformed, of these ``spm`` of a hundred with the suffix
    first; empty and null texts, and texts that hold a mark, stay plain, with null prefix_chars and middle_chars. Texts of
    any length are cut whole; a buffer is as large as its longest text at least. Columns of ``docs`` stay, an added one
    has underscores behind its name where it is taken (see free). An empty table gives an empty table.
    """
    names = {}
    for c in ("n", "form", "prefix_chars", "middle_chars", "output"):
        names[c] = free(c, docs.columns)
    key, raw = free("key", [*docs.columns, *names.values()]), free("raw", [*docs.columns, *names.values()])
    number = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
    rows = docs.withColumn(key, F.substring(F.unhex(F.sha2(number, 256)), 1, 16)).withColumn(raw, F.coalesce(F.col(text), F.lit("")).cast("binary"))
    kept = docs.columns
    schema = docs.select(*kept).withColumns({names["n"]: F.lit(0).cast("long"), names["form"]: F.lit(""), names["prefix_chars"]: F.lit(0).cast("long"), names["middle_chars"]: F.lit(0).cast("long"), names["output"]: F.lit(b"")}).schema
    for f in schema.fields:
        f.nullable = True

    def formatted(batches):
        def handle(buf, sizes, own):
            h = np.frombuffer(b"".join(own.column(own.schema.get_field_index(key)).to_pylist()), ">u4").reshape(-1, 4).astype(np.int64)
            n, form, first, second, before, inside = cuts(buf, sizes, h, rate, spm)
            done, out = scatter(buf, sizes, form, first, second)
            none = form == PLAIN
            return [pa.array(n), pa.array([FORMS[k] for k in form], pa.string()), pa.array(before, mask=none), pa.array(inside, mask=none), _binary(done, out)]

        for batch in batches:
            for own, added in _mapped(batch, raw, handle):
                columns = [own.column(own.schema.get_field_index(c)) for c in kept]
                yield pa.RecordBatch.from_arrays([*columns, *added], names=[*kept, *(names[c] for c in ("n", "form", "prefix_chars", "middle_chars", "output"))])

    done = rows.mapInArrow(formatted, schema)
    return done.withColumn(names["output"], F.col(names["output"]).cast("string"))


def restore(rows: DataFrame, *, output: str = "output", form: str = "form") -> DataFrame:
    """``rows`` with restored: the text before it was transformed, from ``output`` and ``form`` alone; null for a null output."""
    name = free("restored", rows.columns)
    raw = free("raw", [*rows.columns, name])
    kept = rows.columns
    schema = rows.withColumn(name, F.lit(b"")).schema
    for f in schema.fields:
        f.nullable = True

    def restored(batches):
        def handle(buf, sizes, own):
            forms = own.column(own.schema.get_field_index(form)).to_pylist()
            return [_binary(*gather(buf, sizes, np.array([FORMS.index(f or "plain") for f in forms], np.int64)))]

        for batch in batches:
            for own, added in _mapped(batch, raw, handle):
                yield pa.RecordBatch.from_arrays([*(own.column(own.schema.get_field_index(c)) for c in kept), *added], names=[*kept, name])

    done = rows.withColumn(raw, F.coalesce(F.col(output), F.lit("")).cast("binary")).mapInArrow(restored, schema)
    return done.withColumn(name, F.when(F.col(output).isNotNull(), F.col(name).cast("string")))


def digests(docs: DataFrame, **how) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256 and restored_sha256 of all of ``docs`` (doc_id, text)."""
    back = restore(transform(docs.select("doc_id", "text"), **how).drop("text"))
    return back.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))
