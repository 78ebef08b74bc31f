"""One-bit codes against distances of all pairs."""

import numpy as np
import pyarrow.parquet as pq
import pytest

pytest.importorskip("tessera.llm")
from tessera.llm import onebit, queries  # noqa: E402

SF = "/root/testdata/sf0.001"


def naive(asked, have, k=10):
    out = {}
    for q, v in asked:
        d = sorted((float(np.sqrt(((np.array(x, float) - np.array(v, float)) ** 2).sum())), i) for i, x in have if i != q)
        out[q] = d[:k]
    return out


def check(df, want, k=10, least=0.9):
    got = {}
    for r in df.collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["score"], r["vec_id"]))
    hits = total = 0
    for q, own in want.items():
        mine = sorted(got.pop(q, []))
        assert [r for r, _, _ in mine] == list(range(1, len(own) + 1))
        assert mine == sorted(mine, key=lambda m: (m[1], m[2]))
        hits += len({i for _, _, i in mine} & {i for _, i in own})
        total += len(own)
    assert not got
    assert hits >= least * total
    return hits / max(1, total)


def rows_of(sf):
    rows = [(r["vec_id"], [float(c) for c in r["embedding"]]) for r in pq.read_table(f"{sf}/embeddings.parquet").to_pylist()]
    return [r for r in rows if r[0] % 100 == 0], rows


def test_query_recall_and_scores(spark, monkeypatch):
    monkeypatch.setattr(onebit, "SEED", 100)
    monkeypatch.setattr(onebit, "GROWTH", 3)
    asked, have = rows_of(SF)
    df = queries.op11_one_bit_search(spark, SF).cache()
    assert check(df, naive(asked, have)) >= 0.97
    vectors = dict(have)
    for r in df.collect():
        want = np.sqrt(((np.array(vectors[r["query_id"]]) - np.array(vectors[r["vec_id"]])) ** 2).sum())
        assert r["score"] == pytest.approx(want, abs=1e-12)


def test_recall_on_the_larger_table(spark):
    asked, have = rows_of("/root/testdata/sf0.1")
    assert check(queries.op11_one_bit_search(spark, "/root/testdata/sf0.1"), naive(asked, have)) >= 0.97


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(6000, 96)) + rng.normal(size=(40, 96))[rng.integers(0, 40, 6000)] * 1.5
    centre, turn = x.mean(0), onebit.rotation(96)
    assert np.allclose(turn @ turn.T, np.eye(96))
    codes, norm, held = onebit.encode(x, centre, turn)
    shard = onebit.Codes(np.arange(6000), x, codes, norm, held, 96)
    over = hits = 0
    for q in range(0, 6000, 200):
        residual = (x[q] - centre) @ turn
        true = (x - centre) @ turn @ residual / (norm * np.linalg.norm(residual))
        over += (true > shard.cosines(residual / np.linalg.norm(residual)) + shard.error).mean() / 30
        at, d = shard.nearest(q, x[q], centre, turn, float("inf"), 1 << 62, 10)
        exact = np.sqrt(((x - x[q]) ** 2).sum(1))
        exact[q] = np.inf
        hits += len(set(at.tolist()) & set(np.argsort(exact)[:10].tolist()))
        assert np.allclose(d, exact[at])
    assert over < 0.012
    assert hits >= 0.97 * 300
    assert shard.looked < 0.35 * 30 * 6000


def test_awkward_vectors(spark):
    big = (1 << 53) + 1
    rows = [(0, [1.0, 2.0]), (100, [1.0, 2.0]), (3, [1.0, 2.0]), (3, [1.0, 2.0]), (4, None), (5, [0.0, 0.0]), (6, [1.0, None]), (7, [float("nan"), 1.0]), (8, [float("inf"), 1.0]), (None, [1.0, 1.0]), (9, []), (big, [1.0, 2.0, 0.0, 4.0]), (200, [0.1, -3.0]), (-(1 << 63), [1.0, 2.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1)
    vectors = onebit.real_vectors(df)
    asked = vectors.where("vec_id % 100 = 0")
    got = [tuple(r) for r in onebit.search(asked, vectors).orderBy("query_id", "rank").collect()]
    assert [g[2] for g in got if g[0] == 0] == [3, 3, 100, -(1 << 63), big, 200]
    assert [g[2] for g in got if g[0] == 100] == [0, 3, 3, -(1 << 63), big, 200]
    assert [g[3] for g in got if g[0] == 0][:4] == [0.0, 0.0, 0.0, 0.5]
    assert onebit.search(asked.limit(0), vectors).count() == 0
    assert onebit.search(asked, vectors.limit(0)).count() == 0
    same = spark.range(300).selectExpr("id AS vec_id", "array(1D, 1D, 2D) AS v")
    hit = onebit.search(same.where("vec_id % 100 = 0"), same).collect()
    assert sorted(r["vec_id"] for r in hit if r["query_id"] == 100) == list(range(10))
