"""Fill-in-middle against the definition, text by text."""

import hashlib
import re

import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

pytest.importorskip("tessera.llm")
from tessera.llm import infill, queries  # noqa: E402

SF = "/root/testdata/sf0.001"
TEXTS = [None, "", "a", "<P>", "x<S>y", "<p> <P <S<M", "hello wide world", "éß日本 語\U0001f600abc", "ab" * 400_000 + "!", "word " * 3000, " \n\t\x00", "Z<", ">P<", "<M", "M>"]


def naive(doc_id, text):
    text = text or ""
    tokens = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n = len(tokens)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        form, out = "plain", text
    elif h4 % 100 < 20:
        form, out = "spm", f"<S>{suffix}<P>{prefix}<M>{middle}"
    else:
        form, out = "psm", f"<P>{prefix}<S>{suffix}<M>{middle}"
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    plain = form == "plain"
    return doc_id, n, form, None if plain else len(prefix), None if plain else len(middle), sha(out), sha(text)


def result(df):
    return sorted((tuple(r[c] for c in ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")) for r in df.collect()), key=repr)


def test_query_equals_brute_force(spark):
    docs = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    want = sorted((naive(d["doc_id"], d["text"]) for d in docs), key=repr)
    assert result(queries.op12_fill_in_middle(spark, SF)) == want
    assert {w[2] for w in want} == {"plain", "psm", "spm"}


def test_awkward_texts_ids_and_columns(spark, monkeypatch):
    rows = [(i if i % 7 else None, t, "own", 5) for i, t in enumerate(TEXTS * 6)] + [((1 << 53) + 1, "big id here", "own", 5), (None, "big id here", "own", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, output string, n int").coalesce(2)
    assert result(infill.digests(df)) == sorted((naive(i, t) for i, t, *_ in rows), key=repr)
    out = infill.transform(df)
    assert out.columns == ["doc_id", "text", "output", "n", "n_", "form", "prefix_chars", "middle_chars", "output_"]
    assert {(r["output"], r["n"]) for r in out.collect()} == {("own", 5)}
    back = infill.restore(out, output="output_").collect()
    assert all(r["restored"] == (r["text"] or "") for r in back)
    assert infill.digests(df.limit(0)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="abZ <>PSM日é", max_size=12), max_size=6), st.integers(0, 1 << 30))
def test_scatter_and_gather(texts, seed):
    import numpy as np

    raw = [t.encode() for t in texts]
    buf, sizes = np.frombuffer(b"".join(raw), np.uint8), np.array([len(r) for r in raw], np.int64)
    h = np.random.default_rng(seed).integers(0, 1 << 32, (len(texts), 4))
    n, form, first, second, before, inside = infill.cuts(buf, sizes, h, 90, 20)
    done, out = infill.scatter(buf, sizes, form, first, second)
    got, lengths = infill.gather(done, out, form)
    assert bytes(got) == bytes(buf) and (lengths == sizes).all()
    ends = np.cumsum(out)
    for k, t in enumerate(texts):
        tokens = re.findall(r"[A-Za-z]+|[^A-Za-z]", t)
        a, b = sorted((int(h[k, 0]) % (len(tokens) + 1), int(h[k, 1]) % (len(tokens) + 1)))
        p, m, s = ("".join(x) for x in (tokens[:a], tokens[a:b], tokens[b:]))
        want = {0: t, 1: f"<P>{p}<S>{s}<M>{m}", 2: f"<S>{s}<P>{p}<M>{m}"}[int(form[k])]
        assert bytes(done[ends[k] - out[k] : ends[k]]).decode() == want
        assert n[k] == len(tokens) and before[k] == len(p) and inside[k] == len(m)
