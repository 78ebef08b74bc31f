"""The pipeline's stages against brute force and SQL, and the SQL-checked operators' awkward cases."""

from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("tessera.llm")
import corpus_pipeline  # noqa: E402
from tessera.llm import boosted, line_dedup, mixing, quality_rules, simhash  # noqa: E402
from tests.llm.test_contracts import check_packing, documents, rows  # noqa: E402

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def staged(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for k, (name, f) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(k))
        f(spark, docs, SF).write.parquet(path)
        out.append((name, docs, docs := spark.read.parquet(path)))
    return out


def test_stages_keep_the_columns(staged):
    assert [len(corpus_pipeline.STAGES), *[after.columns for _, _, after in staged[:-1]]] == [5, *[COLUMNS] * 4]


def test_classifier_stage_follows_labels(spark, staged):
    _, before, after = staged[0]
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in after.select("doc_id").collect()}
    good = [d for d, q in labels.items() if q]
    bad = [d for d, q in labels.items() if not q]
    assert sum(d in kept for d in good) >= 0.95 * len(good) and sum(d in kept for d in bad) <= 0.3 * len(bad)
    assert set(after.collect()) <= set(before.collect())


def as_view(con, name, df):
    con.register(name, df.toPandas())


def test_line_stage_equals_sql(staged):
    _, before, after = staged[1]
    con = duckdb.connect()
    as_view(con, "before_", before)
    want = dict(con.execute(f"select doc_id, text from ({line_dedup.oracle(docs='before_')})").fetchall())
    got = {r["doc_id"]: r["text"] for r in after.collect()}
    assert got == want
    assert all(r["n_chars"] == len(r["text"]) for r in after.collect() if want[r["doc_id"]] != {x["doc_id"]: x["text"] for x in before.collect()}[r["doc_id"]])


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_near_copies_stage(staged):
    _, before, after = staged[2]
    texts = {r["doc_id"]: shingles(r["text"]) for r in before.collect()}
    kept = {r["doc_id"] for r in after.select("doc_id").collect()}
    assert set(after.collect()) <= set(before.collect())
    alike = lambda a, b: len(a & b) / len(a | b)
    left = [(a, b) for a in kept for b in kept if a < b and alike(texts[a], texts[b]) >= 0.85]
    assert len(left) <= 0.02 * len(kept)
    for d in set(texts) - kept:  # each that went has something alike
        assert max(alike(texts[d], t) for e, t in texts.items() if e != d) >= 0.6


def test_mixing_stage_equals_sql(staged):
    _, before, after = staged[3]
    con = duckdb.connect()
    as_view(con, "before_", before)
    want = Counter(r[0] for r in con.execute(mixing.oracle(docs="before_", columns="doc_id")).fetchall())
    got = Counter(r["doc_id"] for r in after.select("doc_id").collect())
    assert got == want and set(got) == {r["doc_id"] for r in before.collect()}


def test_packing_stage(staged):
    _, before, after = staged[4]
    used, least = check_packing(rows(after), [(r["doc_id"], r["text"]) for r in before.collect()])
    assert used <= least + 1


def test_run_equals_the_stages(spark, staged):
    a = corpus_pipeline.run(spark, SF)
    key = lambda r: (r["doc_id"], r["piece"], r["length"], r["ids_crc32"])
    assert Counter(map(key, a.collect())) == Counter(map(key, staged[-1][2].collect()))


# line dedup


def test_lines_awkward(spark):
    texts = ["top\nown a\n", "top \r\nown b", " top\n\n", None, "", "top\ntop", "top", "own a", "x"]
    docs = documents(spark, texts)
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_removed"]) for r in rows(line_dedup.dedup_lines(docs, min_sites=4))}
    assert got[0] == ("top\nown a\n", 3, 0)
    assert got[1] == ("own b", 2, 1)
    assert got[2] == ("\n", 3, 1)
    assert got[3] == (None, 1, 0)
    assert got[5] == ("", 2, 2) and got[6] == ("", 1, 1) and got[7] == ("own a", 1, 0)
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0
    assert "pos" in line_dedup.dedup_lines(docs).columns


def test_lines_of_repeated_rows_and_null_sites(spark):
    df = spark.createDataFrame([(1, "a", "s1"), (1, "a", "s1"), (2, "a", "s2"), (3, "a", None), (None, "a", "s4")], "doc_id long, text string, source string")
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_removed"]) for r in rows(line_dedup.dedup_lines(df, min_sites=3)))
    assert got == [(False, 1, 1), (False, 1, 1), (False, 2, 1), (False, 3, 1), (True, 0, 0)]


def test_line_spread_near_the_threshold(spark):
    df = spark.createDataFrame([(k * 100 + s, f"line{k}", f"site{s}") for k in range(1, 13) for s in range(k)], "doc_id long, text string, source string")
    got = {r["doc_id"] // 100 for r in rows(line_dedup.dedup_lines(df, min_sites=6)) if r["n_removed"]}
    assert got == set(range(6, 13))


# mixing


def test_mixing_keeps_everything_and_meets_the_limit(spark):
    rng = np.random.default_rng(4)
    data = [(i, " ".join(["w"] * int(n)), s) for i, (n, s) in enumerate(zip(rng.integers(1, 40, 600), rng.choice(["a", "b", "c"], 600, p=[0.7, 0.2, 0.1]), strict=True))]
    df = spark.createDataFrame(data, "doc_id long, text string, source string")
    got = rows(mixing.mix(df, max_repetition=3.0))
    per = Counter(r["doc_id"] for r in got)
    assert set(per) == set(range(600)) and max(per.values()) <= 3
    tokens = Counter()
    for r in got:
        tokens[r["source"]] += r["n_tokens"]
    own = Counter()
    for _, t, s in data:
        own[s] += len(t.split())
    a, z, budget = mixing.find_exponent(mixing.shares(df, "text", "source"), max_repetition=3.0, target_entropy=None, budget=None)
    total = sum(own.values())
    for s in own:
        assert tokens[s] <= (own[s] / total) ** a / z * budget + 1e-6
        assert tokens[s] >= (own[s] / total) ** a / z * budget - 45


def test_mixing_by_entropy_and_budget(spark):
    df = spark.createDataFrame([(i, "w w w", "a" if i < 90 else "b") for i in range(100)], "doc_id long, text string, source string")
    a, z, _ = mixing.find_exponent(mixing.shares(df, "text", "source"), max_repetition=None, target_entropy=0.9, budget=100.0)
    p = [(0.9**a) / z, (0.1**a) / z]
    assert -sum(x * np.log(x) for x in p) >= 0.9 * np.log(2) - 1e-9
    n = sum(r["n_tokens"] for r in rows(mixing.mix(df, max_repetition=None, target_entropy=0.9, budget=100.0)))
    assert 92 <= n <= 100


def test_mixing_awkward(spark):
    df = spark.createDataFrame([(1, None, None), (2, "", "a"), (3, "x y", "b"), (None, "x", "b"), (3, "x y", "b")], "doc_id long, text string, source string")
    assert Counter(r["doc_id"] for r in rows(mixing.mix(df))) == {1: 1, 2: 1, 3: 2, None: 1}
    assert mixing.mix(df.limit(0)).count() == 0


def test_near_copy_stage_keeps_one_of_repeated_rows(spark):
    docs = documents(spark, ["a b c d e f", "a b c d e f", None, "", "q r s"], [4, 4, 5, 6, 7]).select(*COLUMNS)
    kept = sorted(r["doc_id"] for r in rows(corpus_pipeline.drop_near_copies(spark, docs, SF)))
    assert kept == [4, 5, 7]
    assert simhash.similar_groups(docs).count() == 5


def brute_groups(texts, limit=0.8):
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))
    for b in range(len(sets)):
        for a in range(b):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = [new if r == old else r for r in root]
    return root


def test_similar_groups_equal_brute_force_at_the_limit(spark):
    rng = np.random.default_rng(11)
    words = [f"w{i}" for i in range(4000)]
    line = " ".join(rng.choice(words, 30))
    texts = []
    for n in (9, 13, 40, 60, 90, 150, 400):
        for _ in range(12):
            base = rng.choice(words, n).tolist()
            texts.append(" ".join(base))
            for share in (0.01, 0.02, 0.03, 0.04, 0.05, 0.06):
                texts.append(" ".join(w if rng.random() > share else str(rng.choice(words)) for w in base))
            texts.append(" ".join([*base, line]))
    base = rng.choice(words, 13).tolist()
    texts += [" ".join(base), " ".join([*base[:12], "other"]), " ".join([*base[:11], "third", "word"])]  # 8 of 10 and 7 of 11 shingles
    root = brute_groups(texts)
    assert root[-2] == len(texts) - 3
    docs = documents(spark, texts)
    got = {r["doc_id"]: r["component_id"] for r in rows(simhash.similar_groups(docs))}
    assert got == dict(enumerate(root))
    assert simhash.similar_groups(docs.limit(0)).count() == 0


CLASHING = ("n_lines", "N_Removed", "block", "epoch", "n_tokens", "kept", "n_words", "score", "predicted", "row", "first", "piece")


def test_columns_of_the_caller_stay(spark):
    docs = documents(spark)
    for name in CLASHING:
        docs = docs.withColumn(name, F.lit(f"own {name}"))
    labels = spark.createDataFrame([(4, 1), (3, 0)], "doc_id long, quality int")
    made = [line_dedup.dedup_lines(docs), mixing.mix(docs), quality_rules.judge(docs, labels), boosted.classify(docs, labels)]
    for out, added in zip(made, ("n_removed_", "block_", "kept_", "predicted_"), strict=True):
        assert out.columns[: len(docs.columns)] == docs.columns and added in out.columns
        got = out.select(*CLASHING).distinct().collect()
        assert [tuple(r) for r in got] == [tuple(f"own {n}" for n in CLASHING)]


def test_stages_on_awkward_tables(spark):
    docs = documents(spark).unionByName(documents(spark)).withColumn("n_removed", F.lit("own")).withColumn("row", F.lit("own"))
    for own in (docs, docs.limit(0)):
        for _, f in corpus_pipeline.STAGES[:-1]:
            out = f(spark, own, SF)
            assert out.columns == docs.columns and {tuple(r) for r in out.select("n_removed", "row").distinct().collect()} <= {("own", "own")}
        corpus_pipeline.pack(spark, own, SF).count()


def test_near_copies_under_one_id_are_told_apart(spark):
    docs = documents(spark, ["a b c d e f g h", "a b c d e f g h", "x y z one two three four", "other words stand here alone"], [1, 2, 2, 2])
    got = {(r["doc_id"], r["text"][:1]) for r in rows(corpus_pipeline.drop_near_copies(spark, docs, SF))}
    assert got == {(1, "a"), (2, "x"), (2, "o")}


def test_pages_of_one_template_do_not_meet(spark):
    """Unlike pages that share 170 words in 200: a similarity of 0.7, so no two are linked, and no block holds them."""
    import time

    template = " ".join(f"common{i}" for i in range(170))
    own = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(29)), lambda k: F.concat(F.lit("own"), F.col("doc_id"), F.lit("_"), k)), " ")
    pages = spark.range(50_000).withColumnRenamed("id", "doc_id").withColumn("text", F.concat(own, F.lit(" " + template))).repartition(8)
    pages = pages.unionByName(spark.createDataFrame([(60_000, "a b c d e f g h"), (60_001, "a b c d e f g h")], "doc_id long, text string"))
    began = time.time()
    groups = simhash.similar_groups(pages)
    assert groups.where("component_id < doc_id").count() == 1
    assert time.time() - began < 60
