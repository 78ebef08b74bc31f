"""Bars come together once, and callbacks and quantiles over their windows cost little a row."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tessera.functions import base, registry, ts
from tessera.plans import panel

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["window_callback", "alpha_rolling_5", "alpha_rolling_30"])
def test_bars_and_their_windows_need_one_shuffle(spark, name):
    text = plan(entry.queries()[name](spark, SF))
    dealt = re.findall(r"Exchange (\w+)\((\w*)", text)
    assert dealt == [("hashpartitioning", "symbol")] and "percentile" not in text


def test_learnt_rows_come_from_lines_shuffled_once(spark):
    d = panel.bars(spark, SF).withColumn("mom", ts.ts_return("close", 3))
    assert re.findall(r"Exchange hashpartitioning\((\w+)", plan(d)) == ["symbol"]


def test_callback_for_many_windows_equals_one_a_row(spark):
    values = [1.0, 4.0, None, 2.0, 2.0, 8.0, -1.0]
    d = spark.createDataFrame([("a", k, v) for k, v in enumerate(values)] + [("b", 0, 1.0)], "symbol string, trade_date int, x double")
    one = registry.windowed(lambda s: float(np.abs(s - s.median()).mean()))("x", 3)
    many = registry.windowed(lambda m: np.abs(m - np.median(m, axis=1, keepdims=True)).mean(axis=1), many=True)("x", 3)
    got = d.select("symbol", "trade_date", one.alias("one"), many.alias("many")).collect()
    assert sum(r["many"] is not None for r in got) == 2
    for r in got:
        assert (r["one"] is None) == (r["many"] is None) and (r["one"] is None or abs(r["one"] - r["many"]) < 1e-12)


@pytest.mark.parametrize("q", [0.0, 0.2, 0.5, 0.8, 1.0])
def test_quantiles_equal_percentile(spark, q):
    rng = np.random.default_rng(3)
    rows = [("a", k, None if k == 9 else float(v)) for k, v in enumerate(rng.integers(0, 9, 40) / 4)]
    d = spark.createDataFrame(rows, "symbol string, trade_date int, x double")
    want = base.full("x", 5, F.percentile("x", F.lit(q)).over(base.ts(5)))
    for r in d.select(ts.ts_quantile("x", 5, q).alias("got"), want.alias("want")).collect():
        assert (r["got"] is None) == (r["want"] is None) and (r["got"] is None or abs(r["got"] - r["want"]) < 1e-12)
