"""Adjusted prices by hand."""

import pytest

from tessera.operators import adjust as A

ROWS = [("a", 1, 10.0, None, 5.0, 60.0), ("a", 2, 10.0, 2.0, 0.0, 60.0), ("a", 3, 10.0, -1.0, 5.0, 60.0), ("a", 4, 10.0, 4.0, 5.0, 60.0), ("b", 1, 8.0, None, 5.0, 60.0)]


@pytest.fixture(scope="module")
def bars(spark):
    return spark.createDataFrame(ROWS, "symbol string, trade_date int, close double, adj_factor double, volume double, amount double").repartition(3)


def closes(df):
    return [r["close"] for r in df.orderBy("symbol", "trade_date").collect()]


def test_pre_and_post(bars):
    assert closes(A.adjusted(bars, "pre")) == [10.0, 5.0, 5.0, 10.0, 8.0]
    post = A.adjusted(bars, "post")
    assert closes(post) == [10.0, 20.0, 20.0, 40.0, 8.0] and "adj_factor" not in post.columns
    assert [r["factor_missing"] for r in post.orderBy("symbol", "trade_date").collect()] == [True, False, True, False, True]
    assert A.adjusted(bars, None) is bars
    assert {r["factor_missing"] for r in A.adjusted(bars.drop("adj_factor"), "pre").collect()} == {True}
    assert closes(A.adjusted(bars.where("adj_factor > 0"), "pre", strict=True)) == [5.0, 10.0]


def test_strict_and_wrong_ways(bars):
    with pytest.raises(Exception, match="no adj_factor for"):
        A.adjusted(bars, "pre", strict=True).collect()
    for df, way in ((bars, "both"), (bars.drop("adj_factor"), "pre")):
        with pytest.raises(ValueError):
            A.adjusted(df, way, strict=True)


def test_export(bars):
    got = A.for_export(bars.replace(-1.0, None, ["adj_factor"])).orderBy("symbol", "trade_date").collect()
    assert [r["factor"] for r in got] == [0.5, 0.5, 1.0, 1.0, 1.0]
    assert [r["close"] for r in got] == [5.0, 5.0, 10.0, 10.0, 8.0]
    assert [r["vwap"] for r in got] == [6.0, None, 12.0, 12.0, 12.0]
