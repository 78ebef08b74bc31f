"""Ids beyond 2**53 keep their digits beside null ids, and the smallest long is an id like any other."""

import pytest

pytest.importorskip("tessera.llm")
from tessera.llm import boosted, chat, line_dedup, maxscore, mixing, packing, quality_rules, rans, repeats, simhash  # noqa: E402

IDS = [(1 << 53) + 1, None, -(1 << 63), (1 << 63) - 1, (1 << 53) + 2]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, f"some words of document {k}\nand a line", "en", f"s{k}", 10) for k, i in enumerate(IDS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([((1 << 53) + 1, 1, 0), ((1 << 53) + 2, 0, 0)], "doc_id long, quality int, toxic int")


CASES = {
    "op1": lambda d, lab: line_dedup.dedup_lines(d),
    "op3": lambda d, lab: packing.pack(d),
    "op4": lambda d, lab: repeats.remove_repeats(d),
    "op5": lambda d, lab: mixing.mix(d).dropDuplicates(["doc_id"]),
    "op6": lambda d, lab: simhash.near_duplicates(d),
    "op7": lambda d, lab: quality_rules.judge(d, lab),
    "op8": lambda d, lab: rans.round_trip(d.sparkSession, d),
    "op10": lambda d, lab: boosted.classify(d, lab),
    "groups": lambda d, lab: simhash.similar_groups(d),
}


@pytest.mark.parametrize("name", CASES)
def test_ids_keep_their_digits(docs, labels, name):
    got = [r["doc_id"] for r in CASES[name](docs, labels).select("doc_id").collect()]
    key = lambda i: (i is not None, i or 0)
    assert sorted(got, key=key) == sorted(IDS, key=key)


def test_ids_of_conversations(spark):
    rows = [(i, t, "user", f"text {k} {t}") for k, i in enumerate(IDS) for t in range(2)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1)
    got = {r["conv_id"]: r["n_turns"] for r in chat.read_back(chat.format_trees(chat.reply_chains(df))).collect()}
    assert got == dict.fromkeys(IDS, 2)


def test_ids_of_vectors(spark):
    df = spark.createDataFrame([(i, [k, 1, 2]) for k, i in enumerate(IDS) if i is not None], "vec_id long, v array<long>")
    got = {(r["query_id"], r["vec_id"]) for r in maxscore.search(df, df).collect()}
    own = [i for i in IDS if i is not None]
    assert got == {(a, b) for a in own for b in own if a != b}


def test_repeats_tell_the_smallest_id_from_none(spark):
    text = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(-(1 << 63), text), (None, text), (7, text)], "doc_id long, text string").coalesce(1)
    got = {r["doc_id"]: r["n_removed"] for r in repeats.remove_repeats(df).collect()}
    assert got == {None: 0, -(1 << 63): len(text), 7: len(text)}
