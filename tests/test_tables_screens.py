"""Small table operators and screening rules on tables made by hand."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tessera.operators import screens, tables

D = lambda d: dt.date(2024, 1, d)


def test_unions_meet_in_a_type_that_holds_both(spark):
    a = spark.sql("SELECT 1 AS k, 2 AS n, DATE'2024-01-01' AS d")
    b = spark.sql("SELECT 2L AS k, 'x' AS n, TIMESTAMP'2024-01-02 03:00:00' AS d, 1.5D AS more")
    got = tables.union_relaxed([a, b, spark.sql("SELECT 3.5F AS k")])
    assert dict(got.dtypes) == {"k": "double", "n": "string", "d": "timestamp", "more": "double"}
    assert sorted(r["k"] for r in got.collect()) == [1.0, 2.0, 3.5]


def test_last_common_and_filled(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 3, 2.0), ("a", None, 9.0), ("b", 1, None)], "symbol string, v int, x double")
    assert sorted(map(tuple, tables.keep_last(df, ["symbol"], ["v"]).collect())) == [("a", 3, 2.0), ("b", 1, None)]
    assert [r["symbol"] for r in tables.common([df, df.where("v = 3")], ["symbol"]).collect()] == ["a"]
    assert tables.present(df, df.where("x IS NULL"), ["symbol"]).count() == 1
    gaps = spark.createDataFrame([("a", d, v) for d, v in enumerate([None, 1.0, None, None, 4.0])], "symbol string, trade_date int, v double")
    values = lambda d: [r["v"] for r in d.orderBy("trade_date").collect()]
    assert values(tables.filled(gaps, ["v"])) == [None, 1.0, 1.0, 1.0, 4.0]
    assert values(tables.filled(gaps, ["v"], most=1)) == [None, 1.0, 1.0, None, 4.0]
    assert values(tables.filled(gaps, ["v"], backward=True, most=1)) == [1.0, 1.0, None, 4.0, 4.0]


def test_replacement(spark):
    df = spark.createDataFrame([("x",), ("y",), (None,)], "c string")
    assert [r[0] for r in df.select(tables.replaced("c", {"x": 1}, 0)).collect()] == [1, 0, None]
    with pytest.raises(Exception, match="no value for y"):
        df.select(tables.replaced("c", {"x": 1}, strict=True)).collect()


def test_returns_side_by_side(spark):
    r = spark.createDataFrame([("a", D(1), 0.1), ("a", D(2), 0.1), ("b", D(1), -1.0), ("b", D(2), 5.0), ("b", dt.date(2024, 2, 1), None)], "symbol string, trade_date date, ret double")
    assert {(x["symbol"], x["month"]): round(x["ret"], 9) for x in tables.monthly_returns(r, "symbol").collect()} == {("a", 1): 0.21, ("b", 1): -1.0}
    assert [tuple(x) for x in tables.wide_returns(r, ["b", "a"]).where("month(trade_date) = 1").orderBy("trade_date").collect()] == [(D(1), -1.0, 0.1), (D(2), 5.0, 0.1)]


def test_rules_on_the_newest_bar(spark):
    rows = [("up", D(d), 10.0 + d - 0.5, 10.5 + d, 9.0 + d, 10.0 + d, 100.0 if d < 8 else 500.0, None) for d in range(1, 9)]
    rows += [("flat", D(d), 10.0, 10.1, 9.9, 10.0, 100.0, 1.0) for d in range(1, 9)] + [("new", D(8), 1.0, 1.0, 1.0, 1.0, 0.0, 0.0)]
    bars = spark.createDataFrame(rows, "symbol string, trade_date date, open double, high double, low double, close double, volume double, amount double").repartition(3)
    got = {(r["symbol"], r["rule"]): (r["hit"], r["reason"]) for r in screens.screen(bars, min_amount=5000, days=3, mean=6, band=0.2, breakout=5, atr=4, max_atr_pct=5).collect()}
    assert {k: v[0] for k, v in got.items() if k[0] == "up"} == {("up", "volume_surge"): True, ("up", "keep_rising"): True, ("up", "pullback"): True, ("up", "breakout"): True, ("up", "low_atr"): False}
    assert got["flat", "low_atr"] == (True, None) and got["flat", "pullback"] == (True, None)
    assert got["flat", "volume_surge"][1] == "not up" and got["flat", "breakout"][1] == "not over the high" and got["flat", "keep_rising"][1] == "a close did not rise"
    assert {v for k, v in got.items() if k[0] == "new"} == {(False, "too few bars")}
    hits = screens.all_of(screens.screen(bars, min_amount=5000, days=3, breakout=5), ["breakout", "keep_rising"]).collect()
    assert [r["symbol"] for r in hits] == ["up"]
    with pytest.raises(ValueError):
        screens.screen(bars.where(F.lit(True)), days=0)
