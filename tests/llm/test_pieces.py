"""Token ids by pieces against the library."""

import random

import pytest

pytest.importorskip("tessera.llm")
from tessera.llm import common  # noqa: E402

TEXTS = ["", " ", "a", "\n", "\na", "a\n", "a\nb\nc", "a\n\nb", "a\n\n\nb\nc", "it.\nOn it's on\nit.", "\nd'été\nÉté 42\n42nd $$$\n###", "a b  c", "a \nb", "a\n b", "\r\nb\n", "x\nnaïve ªº²"]


def test_line_feeds_begin_parts_and_ids_equal_the_library(monkeypatch):
    coder = common.byte_coder.__wrapped__(common.tokenizer_path("byte_bpe_50k.json"))
    ids, counts = coder.encode_many(TEXTS)
    want = [e.ids for e in coder.whole.encode_batch(TEXTS, add_special_tokens=False)]
    assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
    parts = coder.tables["chunks"]
    assert "it." in parts and "\nOn" in parts and "it.\nOn" not in parts
    seen = []
    monkeypatch.setattr(common._Pieces, "__getitem__", lambda own, p: seen.append(p) or dict.__getitem__(own, p), raising=False)
    coder.encode_many(["it. on " * 50] * 4)
    assert len(seen) < 20  # not one look a word


def test_fine_cuts_equal_the_library_on_odd_texts():
    signs = ["'", "'s", "'ll", "'re", "'ve", "'v", "'d", "S", "e", "é", "Ü", "ß", "µ", "ª", "4", "²", "½", "!", "×", "À", "\xad", " ", " ", "  ", "\n", "\t", "\r", "\x85", "\xa0", "\0", "\x01", "\x1c", "\x7f"]
    draw = random.Random(5)
    texts = ["".join(draw.choices(signs, k=draw.randint(0, 12))) for _ in range(6_000)]
    for coder in (common.byte_coder, common.word_coder):
        coder = coder.__wrapped__(common.tokenizer_path("byte_bpe_50k.json" if coder is common.byte_coder else "word_bpe_49k.json"))
        want = [e.ids for e in coder.whole.encode_batch(texts, add_special_tokens=False)]
        for some in (slice(None), slice(0, 40), slice(40, 41)):
            ids, counts = coder.encode_many(texts[some])
            assert counts.tolist() == [len(w) for w in want[some]] and ids.tolist() == [i for w in want[some] for i in w]


def test_full_chunks_are_emptied_and_pieces_stay(monkeypatch):
    asked, model = [], common.PieceCoder._of_model
    monkeypatch.setattr(common.PieceCoder, "_of_model", lambda own, new: asked.extend(new) or model(own, new))
    coder = common.byte_coder.__wrapped__(common.tokenizer_path("byte_bpe_50k.json"))
    coder.limit = 900
    words = [f"{a}{b}" for a in "abcdefghijklmnopqrst" for b in "abcdefghijklmnopqrst"]
    texts = [" ".join(words), " ".join(w + "." for w in words), " ".join(w + "," for w in words), " ".join(words)]
    for t in texts:
        ids, counts = coder.encode_many([t])
        assert ids.tolist() == coder.whole.encode(t, add_special_tokens=False).ids
    assert len(asked) == len(set(asked))  # no piece goes to the model twice
    assert sum(map(len, coder.tables.values())) < 2 * coder.limit
