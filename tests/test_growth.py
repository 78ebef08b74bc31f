"""Plans whose memory and shuffles grow no faster than the tables."""

import re

import pytest

import __spark_entry__ as entry
from tessera.functions import registry
from tessera.operators import walkforward
from tessera.plans import panel, q_risk

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_price_bins_from_built_ins_equal_the_table_function(spark):
    rows = [(1, 2.5, 4.0, 9.0), (2, -1.5, 0.5, 6.0), (3, 5.0, 4.0, 1.0), (4, None, 4.0, 1.0), (5, 3.0, 3.0, None), (6, 3.0, 3.0, 2.0)]
    d = spark.createDataFrame(rows, "id int, low double, high double, volume double")
    want = {(k, b, v / len(range(int(lo // 1), int(hi // 1) + 1))) for k, lo, hi, v in rows if None not in (lo, hi, v) and hi >= lo for b in range(int(lo // 1), int(hi // 1) + 1)}
    got = registry.price_bins(d, "low", "high", "volume", 1.0)
    assert {(r["id"], r["bin"], r["part"]) for r in got.collect()} == want
    with pytest.raises(ValueError):
        registry.price_bins(d, "low", "high", "volume", 0.0)


@pytest.mark.parametrize("name, key", [("price_bins", "symbol"), ("trade_turnover", "k")])
def test_nearly_unique_groups_are_made_where_their_key_is(spark, name, key):
    text = plan(entry.queries()[name](spark, "/root/testdata/sf0.1"))
    dealt = re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", text)
    assert "Python" not in text and any(re.fullmatch(rf"{key}#\d+L?", d) for d in dealt)
    assert not any(re.match(rf"{key}#\d+L?, (bin|l_shipdate)", d) for d in dealt)


def test_partitions_follow_the_rows(spark):
    assert panel.together(spark.range(10), "id", spark.range(1_000_001)).rdd.getNumPartitions() == 5


@pytest.mark.parametrize("name", ["walk_forward_predictions", "model_versions", "daily_signals", "candidate_gates"])
def test_learnt_rows_are_made_once(spark, monkeypatch, name):
    made = []
    for module in (q_risk, walkforward):
        monkeypatch.setattr(module, "kept", lambda df, label, keep=module.kept: made.append(label) or keep(df, label))
    text = plan(entry.queries()[name](spark, SF))
    assert made.count("candidates" if name == "candidate_gates" else "learnt") == 1
    assert "lineitem" not in text
