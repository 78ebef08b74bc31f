"""The Merkle manifest against a plain tree in Python."""

import hashlib
import zlib
from collections import defaultdict

import duckdb
import pyarrow.parquet as pq
import pytest

pytest.importorskip("tessera.llm")
from tessera.llm import merkle, queries  # noqa: E402

SF = "/root/testdata/sf0.001"
H = lambda *parts: hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(d, text):
    return H(*(field(d[c]) for c in ("doc_id", "source", "lang", "n_chars")), field(text))


def tree(nodes):
    """(root, siblings of each node as (left, right) by level)."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, i in enumerate(at):
            run = nodes[i // 16 * 16 : i // 16 * 16 + 16]
            paths[k].append(("".join(run[: i % 16]), "".join(run[i % 16 + 1 :])))
        at = [i // 16 for i in at]
        nodes = [H(*nodes[a : a + 16]) for a in range(0, len(nodes), 16)]
    return nodes[0], paths


def naive(docs):
    by = defaultdict(list)
    for d in docs:
        by[d["source"]].append((leaf(d, d["text"]), d))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in sources:
        by[s].sort(key=lambda x: (x[1]["doc_id"] is not None, x[1]["doc_id"] or 0, x[0]))
    trees = [tree([x for x, _ in by[s]]) for s in sources]
    root, tops = tree([t for t, _ in trees])
    out = []
    for s, (subroot, paths), top in zip(sources, trees, tops, strict=True):
        for (own, d), path in zip(by[s], paths, strict=True):
            path, start = path + top, own
            if d["doc_id"] is not None and zlib.crc32(str(d["doc_id"]).encode()) % 5 == 0 and d["text"] is not None:
                start = leaf(d, "".join(c.lower() if "A" <= c <= "Z" else c for c in d["text"]))
            for left, right in path:
                start = H(left, start, right)
            out.append((d["doc_id"], own, subroot, root, H(*(x for p in path for x in p)), start, start == root))
    return sorted(out, key=repr)


def result(df):
    return sorted((tuple(r[c] for c in ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")) for r in df.collect()), key=repr)


def test_query_equals_brute_force_and_sql(spark):
    want = naive(pq.read_table(f"{SF}/documents.parquet").to_pylist())
    assert result(queries.op13_merkle_manifest(spark, SF)) == want
    assert {w[-1] for w in want} == {True, False}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got = con.sql(merkle.oracle())
    assert sorted(map(tuple, (dict(zip(got.columns, r, strict=True)).values() for r in got.fetchall())), key=repr) == want


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, idx string, grp int").repartition(3)


@pytest.mark.parametrize("n", [1, 2, 16, 17, 300])
def test_awkward_rows_and_sizes(spark, n):
    rows = [((1 << 53) + i if i % 9 else None, [None, "", "Abé日" * i, "plain", "X" * 50_000][i % 5], None if i % 4 == 0 else "en", [None, "", "a", "é", "big", "big", "big"][i % 7] if n < 300 or i < 20 else "big", i or None, "x", i) for i in range(n)]
    rows += rows[:3]
    docs = docs_of(spark, rows)
    got = merkle.proofs(merkle.manifest(docs, merkle.lower_some()))
    assert result(got) == naive([r.asDict() for r in docs.collect()])


def test_many_sources_and_an_empty_table(spark):
    rows = [(i, f"Text {i}", "en", f"s{i % 40}", 5, "x", i) for i in range(100)]
    docs = docs_of(spark, rows)
    assert result(merkle.proofs(merkle.manifest(docs, merkle.lower_some()))) == naive([r.asDict() for r in docs.collect()])
    assert merkle.manifest(docs.limit(0), merkle.lower_some()).count() == 0
    assert all(r["verified"] for r in merkle.proofs(merkle.manifest(docs)).collect())


def test_numbers_follow_the_order_in_each_group(spark):
    df = spark.range(5000).selectExpr("IF(id % 3 = 0, 'hot', concat('g', id % 50)) AS g", "hash(id) AS v", "id")
    got = merkle.numbered(df, "g", "v").collect()
    by = defaultdict(list)
    for r in got:
        by[r["g"]].append((r["idx"], r["v"]))
    assert len(got) == 5000
    for own in by.values():
        own.sort()
        assert [i for i, _ in own] == list(range(len(own))) and [v for _, v in own] == sorted(v for _, v in own)
