"""What the corpus operators share: tables, the shared folder, staged tables, token lookup."""

from __future__ import annotations

import functools
import re
import tempfile
import uuid
from itertools import chain, islice, repeat

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space; a word is a maximal run of anything else.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


#: Unicode White_Space, as the tokenizers' regular expressions see it.
_WS = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: what the session names, or one of our own where everything runs in one process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        named = spark.sparkContext.getCheckpointDir()
    if named is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if named is None:
        named = tempfile.mkdtemp(prefix="tessera-shared-")
        spark.sparkContext.setCheckpointDir(named)
    return named


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends there and lost executors cost nothing."""
    path = f"{shared_dir(df.sparkSession)}/stage-{uuid.uuid4().hex}/{label}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free(name: str, columns) -> str:
    """``name`` with as many underscores behind it as no column (in any case of letters) has."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def beside(*added: str):
    """For operators (docs, ...) that return docs with the columns ``added``: the caller's own columns of these names stay.

    The operator's column then has an underscore behind its name (see free).
    """

    def wrap(operator):
        @functools.wraps(operator)
        def run(docs: DataFrame, *args, **how) -> DataFrame:
            names = {a.lower() for a in added}
            own = {c: f"__own_{k}" for k, c in enumerate(docs.columns) if c.lower() in names}
            if not own:
                return operator(docs, *args, **how)
            out = operator(docs.withColumnsRenamed(own), *args, **how)
            out = out.withColumnsRenamed({a: free(a, docs.columns) for a in added})
            return out.withColumnsRenamed({v: k for k, v in own.items()})

        return run

    return wrap


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once a row: a lambda variable isn't inlined into inner lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def clean_text(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def as_text(name: str) -> Column:
    """An id for a pandas frame: beside nulls pandas holds longs as floats, and those above 2**53 would lose digits."""
    return F.col(name).cast("long").cast("string")


def as_long(df: DataFrame, name: str = "doc_id") -> DataFrame:
    """Back from ``as_text``."""
    return df.withColumn(name, F.col(name).cast("long"))


def tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


class _Pieces(dict):
    """Numbers pieces by first use and keeps the ids of each."""

    def __init__(self, encode):
        super().__init__()
        self.encode, self.starts, self.flat = encode, np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def __missing__(self, piece) -> int:
        n = self[piece] = len(self)
        return n

    def numbers(self, own: list) -> np.ndarray:
        """Numbers of different pieces, new ones all at once."""
        found = np.fromiter(map(self.get, own, repeat(-1)), np.int64, len(own))
        new = np.flatnonzero(found < 0)
        found[new] = np.arange(len(self), len(self) + len(new))
        self.update(zip(map(own.__getitem__, new.tolist()), found[new].tolist(), strict=True))
        return found

    def ids(self, split: list[list]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, given by their pieces, one after the other, and how many each text has."""
        counts = np.fromiter(map(len, split), np.int64, len(split))
        return self._gathered(np.fromiter(map(self.__getitem__, chain.from_iterable(split)), np.int64, int(counts.sum())), counts)

    def ids_between_blanks(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for texts cut at single blanks: Arrow cuts them, and each different part is looked up once a call.

        A line feed that stands alone, always a piece of its own, begins a part too; no blank goes with that.
        """
        import pyarrow as pa
        import pyarrow.compute as pc

        whole = pc.replace_substring_regex(pa.array(texts, pa.large_string()), r"([^\n])\n([^\n])", "\\1 \n\\2")
        parts = pc.split_pattern(whole, " ")
        coded = parts.flatten().dictionary_encode()
        counts = pc.list_value_length(parts).to_numpy().astype(np.int64)
        own = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        numbers = self.numbers(own)[coded.indices.to_numpy()]
        firsts = ["\0" + t for t in pc.list_element(parts, 0).to_pylist()]
        numbers[np.cumsum(counts) - counts] = np.fromiter(map(self.__getitem__, firsts), np.int64, len(firsts))
        return self._gathered(numbers, counts)

    def ids_of_cut(self, texts: list[str], blanks: bool) -> tuple[np.ndarray, np.ndarray]:
        """The same for texts of the first 256 characters, cut as finely as the pre-tokenizer does (see ``_fine_cuts``)."""
        import pyarrow as pa

        chars = np.frombuffer("".join([t + "\0" for t in texts]).encode("latin-1"), np.uint8)
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1
        starts, kept = _fine_cuts(chars, ends, blanks)
        buffers = [None, pa.py_buffer(np.append(starts, len(chars))), pa.py_buffer(chars)]
        coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), buffers).filter(pa.array(kept)).dictionary_encode()
        counts = np.diff(np.searchsorted(starts[kept], ends), prepend=0)
        own = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        return self._gathered(self.numbers(own)[coded.indices.to_numpy()], counts)

    def _gathered(self, numbers: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if added := len(self) - (len(self.starts) - 1):
            sizes, ids = self.encode(list(islice(reversed(self), added))[::-1])
            self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(sizes)])
            self.flat = np.concatenate([self.flat, ids])
        first = self.starts[numbers]
        size = self.starts[numbers + 1] - first
        ends = np.concatenate([[0], np.cumsum(size)])
        ids = self.flat[np.arange(ends[-1]) + np.repeat(first - ends[:-1], size)]
        return ids, np.diff(ends[np.concatenate([[0], np.cumsum(counts)])])


def _byte_characters() -> dict[int, str]:
    """The characters that stand for the bytes 0 to 255 in a byte-level vocabulary: visible ones for themselves."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(seen)]
    return {b: chr(b) for b in seen} | {b: chr(256 + k) for k, b in enumerate(rest)}


#: Letters and numbers among the first 256 characters, where lower case and composition are the same everywhere.
_LETTER, _NUMBER = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe"
_OTHER, _L, _N, _SPACE, _END = range(5)
_CLASS = np.array([next((k for k, own in ((_L, _LETTER), (_N, _NUMBER), (_SPACE, _WS)) if re.match(f"[{own}]", chr(c))), _OTHER) for c in range(256)], np.uint8)


def _fine_cuts(chars: np.ndarray, ends: np.ndarray, blanks: bool) -> tuple[np.ndarray, np.ndarray]:
    """Where the pre-tokenizer's pieces begin in texts of the first 256 characters, and which of these pieces count.

    The texts stand one after the other with a zero behind each, at ``ends``. Pieces are runs of letters, of numbers or of
    other characters, and contractions where no such run has begun. ``blanks``: white space counts, one blank goes with the
    piece behind it and before a piece the last space of a run stands alone; else it doesn't, and numbers stand by the digit.
    """
    kind = _CLASS[chars]
    kind[ends] = _END
    first = np.ones(len(kind), bool)
    np.not_equal(kind[1:], kind[:-1], out=first[1:])
    first[ends] = True
    if blanks:
        last = np.flatnonzero((kind[:-1] == _SPACE) & (kind[1:] < _SPACE))
        first[last] = True
        first[last[chars[last] == 32] + 1] = False
    else:
        first[kind == _N] = True
    at = np.flatnonzero(chars == 39)
    before = np.where(at > 0, kind[at - 1], _END)
    at = at[(before != _OTHER) & ~((before == _SPACE) & (chars[at - 1] == 32) & blanks)]
    one, two = chars[at + 1], chars[np.minimum(at + 2, len(chars) - 1)]
    short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
    long = (((one == ord("r")) | (one == ord("v"))) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
    first[at[short | long] + 1] = False
    first[at[short] + 2] = True
    first[at[long] + 3] = True
    starts = np.flatnonzero(first)
    return starts, kind[starts] != _END if blanks else kind[starts] < _SPACE


class PieceCoder:
    """Token ids of whole texts by looking up the ids of their pieces.

    The tokenizer's own pre-tokenizer never joins what the patterns separate, so a text's ids are its pieces' ids in
    order. Ids of new pieces come from the tokenizers library and stay in tables of bounded size. Texts of the first
    256 characters are cut as finely as the pre-tokenizer does, all of a batch at once, and new pieces of these go straight
    to the library's model; if the tokenizer keeps ``blanks``, they are cut at blanks before (unless ``odd`` is in them),
    and only new chunks are cut finely. Other texts, and texts with a special token, are cut at white space only and go
    through all of the library.
    """

    LIMIT = 1_600_000
    #: Bytes that UTF-8 doesn't have: one is put behind a piece, no merge of the model has it; one is between lines of pieces.
    MARK, LINE = b"\xc0", b"\xc1"

    def __init__(self, path: str, odd: tuple[str, ...], wide: str, special: str, blanks: bool, limit: int = LIMIT):
        """blanks: white space has ids; else it only separates, and texts are in lower case. limit: pieces held."""
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.model = Tokenizer(self.whole.model)
        self.model.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        self.wide, self.special = (re.compile(p).findall for p in (wide, special))
        self.odd, self.blanks, self.limit = odd, blanks, limit
        of_byte = _byte_characters()
        self.written = np.array([ord(of_byte[b]) for b in range(256)], "<u2")
        self.written[self.LINE[0]] = ord(" ")
        self.suffix = self.whole.model.end_of_word_suffix
        vocabulary = self.whole.get_vocab()
        mark = of_byte[self.MARK[0]]
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for t, i in vocabulary.items() if (t.endswith(self.suffix) if self.suffix else t == mark)]] = True
        if not self.suffix and [t for t in vocabulary if mark in t] != [mark]:
            raise ValueError(f"{path} has no token for the byte {self.MARK} alone, or merges it")
        self.tables: dict[str, _Pieces] = {}
        self.reset("chunks", "narrow", "wide")

    def reset(self, *names: str) -> None:
        """Empty these tables. Chunks are cheap to make again from pieces, pieces are not."""
        made = {"chunks": self._of_chunks, "narrow": self._of_model, "wide": self._of_library}
        self.tables |= {k: _Pieces(made[k]) for k in names}

    def _of_chunks(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids, counts = self.tables["narrow"].ids_of_cut(list(map(_blank_part, new)), self.blanks)
        return counts, ids

    def _of_library(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each new piece has, and all ids."""
        coded = [np.array(e.ids, np.uint32) for e in self.whole.encode_batch_fast(new, add_special_tokens=False)]
        return np.array([len(c) for c in coded], np.int64), np.concatenate(coded)

    def _of_model(self, new: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The same for pieces of the first 256 characters, a byte each.

        A model that marks the ends of words gets each piece as a word; the ids that end with the suffix end the pieces.
        Another gets words of some pieces, a mark behind each, and the marks' ids are taken out.
        """
        own = [p if p.isascii() else p.decode("latin-1").encode() for p in new]
        few, parts = 1 if self.suffix else 32, [np.zeros(0, np.uint32)]
        for at in range(0, len(own), 20_000):
            some = own[at : at + 20_000]
            words = some if self.suffix else [self.MARK.join([*some[k : k + few], b""]) for k in range(0, len(some), few)]
            line = self.written[np.frombuffer(self.LINE.join(words), np.uint8)].tobytes().decode("utf-16-le")
            (one,) = self.model.encode_batch_fast([line], add_special_tokens=False)
            parts.append(np.array(one.ids, np.uint32))
        ids = np.concatenate(parts)
        last = self.last[ids]
        n = np.diff(np.flatnonzero(last), prepend=-1)
        if len(n) != len(new):
            raise ValueError("the model's ids don't tell the pieces apart")
        return (n, ids) if self.suffix else (n - 1, ids[~last])

    def encode_many(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and how many each has."""
        if sum(map(len, self.tables.values())) > self.limit:
            self.reset(*(["chunks"] if len(self.tables["chunks"]) > self.limit // 4 else self.tables))
        kinds, done = [self._kind(t) for t in texts], {}
        for kind in set(kinds):
            own = [t for t, k in zip(texts, kinds, strict=True) if k == kind]
            if kind == "chunks":
                done[kind] = self.tables[kind].ids_between_blanks(own)
            elif kind == "narrow":
                done[kind] = self.tables[kind].ids_of_cut(own if self.blanks else [t.lower() for t in own], self.blanks)
            else:
                done[kind] = self.tables[kind].ids(list(map(self._broadly, own)))
        if len(done) < 2:
            return next(iter(done.values()), (np.zeros(0, np.uint32), np.zeros(0, np.int64)))
        which, counts = np.array(kinds), np.zeros(len(texts), np.int64)
        for kind, (_, n) in done.items():
            counts[which == kind] = n
        ids, of = np.empty(int(counts.sum()), np.uint32), np.repeat(which, counts)
        for kind, (own, _) in done.items():
            ids[of == kind] = own
        return ids, counts

    def _broadly(self, text: str) -> list[str]:
        return (self.special if "<|" in text else self.wide)(text)

    def _kind(self, text: str) -> str:
        if "<|" in text:
            return "wide"
        if not text.isascii():
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                return "wide"
        return "chunks" if self.blanks and not any(x in text for x in self.odd) else "narrow"

    def batches(self, texts: list[str], chars: int = 4_000_000):
        """Like encode_many, by runs of texts of about ``chars`` characters: yields (first text, ids, counts)."""
        at = 0
        while at < len(texts):
            end, held = at, 0
            while end < len(texts) and (end == at or held + len(texts[end]) <= chars):
                held += len(texts[end])
                end += 1
            yield at, *self.encode_many(texts[at:end])
            at = end


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _blank_part(part: str) -> str:
    """The text of a part between single blanks; the first part of a text is marked."""
    return part[1:] if part[:1] == "\0" else part if part[:1] == "\n" else " " + part


@functools.cache
def byte_coder(path: str) -> PieceCoder:
    """For byte_bpe_50k: a blank goes with the word after it; of longer white space all but the last character stand alone."""
    white = rf"[{_WS}]+(?![^{_WS}])|[{_WS}]+"
    special = rf"<\|endoftext\|>| ?(?:(?!<\|endoftext\|>)[^{_WS}])+|{white}"
    return PieceCoder(path, (*"\0\t\r\x0b\x0c\x85\xa0", "  ", " \n", "\n "), rf" ?[^{_WS}]+|{white}", special, True)


@functools.cache
def word_coder(path: str) -> PieceCoder:
    """For word_bpe_49k: lower case; white space is dropped and separates words, numbers stand by the digit."""
    special = r"<\|(?:start|end)oftext\|>"
    return PieceCoder(path, (), rf"[^{_WS}]+", rf"{special}|(?:(?!{special})[^{_WS}])+", False, PieceCoder.LIMIT // 2)
