"""The near-duplicate stage goes through the SimHash operator, and verifies what that proposes."""

import pytest

pytest.importorskip("tessera.llm")
import corpus_pipeline  # noqa: E402
from tessera.llm import simhash  # noqa: E402
from tests.llm.test_contracts import documents, rows  # noqa: E402


def test_stage_takes_the_fingerprints_groups(spark, monkeypatch):
    made, given = [], []
    near, similar = simhash.near_duplicates, simhash.similar_groups
    monkeypatch.setattr(simhash, "near_duplicates", lambda docs, **how: made.append(near(docs, **how)) or made[-1])
    monkeypatch.setattr(simhash, "similar_groups", lambda docs, proposed=None, **how: given.append(proposed) or similar(docs, proposed=proposed, **how))
    long = " ".join(f"w{k}" for k in range(100))
    docs = documents(spark, [long, long + " end", "quite another text of several words", None, ""], [1, 2, 3, 4, 5])
    assert sorted(r["doc_id"] for r in rows(corpus_pipeline.drop_near_copies(spark, docs, ""))) == [1, 3, 4]
    assert len(made) == 1 and given == made


def test_proposals_are_verified_and_nothing_else_is_lost(spark):
    base = [f"w{k}" for k in range(60)]
    docs = documents(spark, [" ".join(base), " ".join([*base[:-2], "x", "y"]), "a text of its own here", "and one more that is unlike"], [1, 2, 3, 4])
    wrong = spark.createDataFrame([(1, 1), (2, 2), (3, 3), (4, 3)], "doc_id long, component_id long")
    got = {r["doc_id"]: r["component_id"] for r in rows(simhash.similar_groups(docs, proposed=wrong))}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}
    one = spark.createDataFrame([(k, 1) for k in range(1, 5)], "doc_id long, component_id long")
    assert {r["doc_id"]: r["component_id"] for r in rows(simhash.similar_groups(docs, proposed=one))} == got


def test_rows_without_an_id_are_searched_too(spark):
    a, b = ([f"{x}{k}" for k in range(60)] for x in "ab")
    near = lambda words: " ".join([*words[:-2], "other", "end"])
    texts = [" ".join(a), near(a), " ".join(b), near(b), " ".join(b), "quite another text of several words", None, "", "the last of them stands alone"]
    docs = documents(spark, texts, [2**60, None, None, None, None, None, 7, None, None])
    got = rows(corpus_pipeline.drop_near_copies(spark, docs, ""))
    assert sorted((r["doc_id"] or 0, (r["text"] or "")[:3]) for r in got if r["doc_id"] or r["text"][:1] != "b") == [(0, "qui"), (0, "the"), (7, ""), (2**60, "a0 ")]
    assert [r["text"] in texts[2:4] for r in got if (r["text"] or "")[:1] == "b"] == [True]
    top = documents(spark, [" ".join(a), " ".join(b), near(b)], [2**63 - 1, None, None])
    assert corpus_pipeline.drop_near_copies(spark, top, "").count() == 2
    none = documents(spark, texts, [None] * len(texts))
    assert corpus_pipeline.drop_near_copies(spark, none, "").count() == 5
