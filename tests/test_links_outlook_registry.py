"""Dictionary links, outlook statistics, user-defined operators."""

import datetime as dt
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import registry as R
from tessera.operators import links as L
from tessera.operators import outlook as O

NAMES = {"Ping An": "601318", "Ping An Bank": "000001", "Bank": "B1", "平安": "P2", "平安银行": "P4", "aa": "A2", "aaa": "A3", "ab": "AB"}
TEXTS = ["Ping An Bank and Ping An", None, "", "平安银行、平安", "aaaa aaab", "nothing", "xBankPing An Bankaab", "Ping AnPing An"]


@pytest.fixture(scope="module")
def names(spark):
    rows = [(f" {n} ", c) for n, c in NAMES.items()] + [("", "x"), ("  ", "x"), (None, "x"), ("aa", "A1"), ("solo", None)]
    return L.dictionary(spark.createDataFrame(rows, "name string, symbol string")).cache()


def brute(text):
    pattern = re.compile("|".join(re.escape(n) for n in sorted(NAMES, key=len, reverse=True)))
    return [(m.start(), m.group()) for m in pattern.finditer(text or "")]


@pytest.mark.parametrize("part", [200_000, 2])
def test_names_from_left_to_right(spark, names, monkeypatch, part):
    monkeypatch.setattr(L, "PART", part)
    assert {r["name"]: r["code"] for r in names.collect()} == NAMES
    df = spark.createDataFrame([((1 << 53) + i, t) for i, t in enumerate(TEXTS)], "id long, body string").repartition(3)
    got = sorted(tuple(r) for r in L.spoken(df, names, key="id", text="body").collect())
    assert got == sorted(((1 << 53) + i, *h) for i, t in enumerate(TEXTS) for h in brute(t))
    assert L.spoken(df, names.limit(0), key="id", text="body").count() == 0
    assert L.spoken(df.limit(0), names, key="id", text="body").count() == 0


def test_symbols_and_industries(spark, names):
    rows = [(1, "Ping An Bank", " and 平安", ["B1"], 1), (2, "x", None, ["Z", "601318"], 0), (3, None, "aa", None, None), (4, None, None, [], 2)]
    news = spark.createDataFrame(rows, "id long, title string, content string, symbols array<string>, quality_flags int")
    got = {r["id"]: (r["symbols"], r["quality_flags"]) for r in L.link_symbols(news, names).collect()}
    assert got == {1: (["B1", "000001", "P2"], 5), 2: (["Z", "601318"], 0), 3: (["A2"], 4), 4: ([], 2)}
    words = spark.createDataFrame([("Ping", "fin"), ("Bank", "bank"), ("An Bank", "big")], "name string, code string")
    of = spark.createDataFrame([("601318", "ins"), ("Z", "zoo")], "symbol string, code string")
    got = {r["id"]: (r["industry_code"], r["quality_flags"]) for r in L.link_industry(news, words, of).collect()}
    assert got == {1: ("big", 5), 2: ("zoo", 4), 3: (None, None), 4: (None, 2)}
    assert sorted(tuple(r) for r in L.items(news).collect()) == [("601318", 2), ("B1", 1), ("Z", 2)]


def test_outlook_stats(spark):
    at = lambda h: dt.datetime(2024, 1, 5, h)
    d = dt.date(2024, 1, 3)
    rows = [(1, 1, d, at(1), "trend", 2.0, "wrong"), (1, 1, d, at(2), "trend", 2.0, "correct"), (1, 2, d, at(1), "trend", 1.0, "partial"), (1, 3, d, at(1), "flow", 4.0, "unknown"), (2, 1, dt.date(2024, 2, 1), at(9), "flow", 1.0, "wrong")]
    df = spark.createDataFrame(rows, "outlook int, item int, trade_date date, validated_at timestamp, dimension string, weight double, verdict string")
    got = {r["dimension"]: r for r in O.outlook_stats(df).collect()}
    assert set(got) == {"trend", "flow", None} and got[None]["is_total"] and not got["flow"]["is_total"]
    assert [got["trend"][c] for c in ("items", "judged", "correct", "partial", "wrong", "unverified", "judged_weight", "score", "coverage")] == [2, 2, 1, 1, 0, 0, 3.0, pytest.approx(250 / 3), 1.0]
    assert [got[None][c] for c in ("outlooks", "items", "judged", "unverified", "total_weight", "score", "coverage")] == [2, 4, 3, 1, 8.0, 62.5, 0.5]
    early = {r["dimension"]: r for r in O.outlook_stats(df, until=at(1), end="2024-01-31").collect()}
    assert (early["trend"]["wrong"], early[None]["items"], early["flow"]["score"], early["flow"]["coverage"]) == (1, 3, None, 0.0)
    with pytest.raises(ValueError):
        O.outlook_stats(df, start="2024-02-01", end="2024-01-01")
    with pytest.raises(Exception, match="lacks its weight"):
        O.outlook_stats(df.withColumn("weight", F.lit(None).cast("double"))).collect()


def test_user_operators_stand_beside_the_built_in_ones(spark):
    rows = [("a", d, float(d * d % 7), 2.0) for d in range(8)] + [("b", 0, None, 1.0), ("b", 1, 3.0, 1.0)]
    df = spark.createDataFrame(rows, "symbol string, trade_date int, close double, x double")

    @R.operator("span", "TS", min_window=2)
    def span(x, n):
        return R.OPERATORS["ts_max"].make(x, n) - R.OPERATORS["ts_min"].make(x, n)

    try:
        R.operator("mad_of", "TS", min_window=1)(R.windowed(lambda s: np.abs(s - s.mean()).mean()))
        got = R.apply(df, a=("span", "close", 3), b=("mad_of", "close", 3), c=("ts_mean", "close", 3)).where("symbol = 'a'").orderBy("trade_date").collect()
        v = [r[2] for r in rows[:8]]
        for i, r in enumerate(got):
            w = v[i - 2 : i + 1] if i > 1 else None
            assert r["a"] == (None if w is None else max(w) - min(w))
            assert r["b"] == (None if w is None else pytest.approx(np.abs(np.array(w) - np.mean(w)).mean()))
            assert r["c"] == (None if w is None else pytest.approx(np.mean(w)))
        assert {r["b"] for r in R.apply(df, b=("mad_of", "close", 2)).where("symbol = 'b'").collect()} == {None}
        with pytest.raises(ValueError):
            R.apply(df, a=("span", "close", 1))
        with pytest.raises(ValueError):
            R.operator("span")(span)
        with pytest.raises(KeyError):
            R.apply(df, a=("nothing", "close"))
    finally:
        R.forget("span")
        R.forget("mad_of")
    assert {"ts_corr", "el_log", "zscore"} <= set(R.OPERATORS)


def test_table_function(spark):
    df = spark.createDataFrame([(1, 9.9, 12.1, 30.0), (2, 5.0, 5.0, 7.0), (3, None, 5.0, 7.0), (4, 6.0, 5.0, 7.0)], "id int, low double, high double, volume double")
    made = df.lateralJoin(R.PriceBins(F.col("low").outer(), F.col("high").outer(), F.col("volume").outer(), F.lit(1.0)).toDF("bin", "from", "to", "part")).select("id", "bin", "from", "to", "part")
    assert sorted(map(tuple, made.collect())) == [(1, 9, 9.0, 10.0, 7.5), (1, 10, 10.0, 11.0, 7.5), (1, 11, 11.0, 12.0, 7.5), (1, 12, 12.0, 13.0, 7.5), (2, 5, 5.0, 6.0, 7.0)]
