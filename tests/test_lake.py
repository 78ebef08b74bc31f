"""Upserts, deletions, user tables and mapping."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tessera.sources import lake

D = dt.date


def bars(spark, rows):
    return spark.createDataFrame(rows, "symbol string, trade_date date, close double, quality_flags int, source string")


def test_upsert_keeps_others_and_flags(spark, tmp_path):
    root = f"{tmp_path}/daily"
    lake.write_daily(bars(spark, [("A", D(2023, 1, 3), 1.0, 4, "x"), ("A", D(2024, 1, 3), 2.0, 0, "x"), ("B", D(2024, 1, 3), 3.0, 1, "x")]), root)
    lake.write_daily(bars(spark, [("B", D(2024, 1, 3), 9.0, 2, "x"), ("C", D(2024, 1, 3), 5.0, 0, "x")]).withColumn("extra", F.lit(1)), root)
    got = {(r["symbol"], r["trade_date"].year): (r["close"], r["quality_flags"]) for r in lake.read_daily(spark, root).collect()}
    assert got == {("A", 2023): (1.0, 4), ("A", 2024): (2.0, 0), ("B", 2024): (9.0, 3), ("C", 2024): (5.0, 0)}
    with pytest.raises(ValueError):
        lake.write_daily(bars(spark, [("A", D(2024, 1, 3), 0.0, 0, "demo")]), root)
    assert lake.read_daily(spark, root, ["A"], "2024-01-01").count() == 1


def test_delete(spark, tmp_path):
    root = f"{tmp_path}/daily"
    lake.write_daily(bars(spark, [("A", D(2023, 1, 3), 1.0, 0, "x"), ("B", D(2024, 1, 3), 2.0, 0, "x"), ("A", D(2024, 1, 3), 2.0, 0, "x")]), root)
    assert lake.delete_daily(spark, root, ["A"], dry_run=True) == 2
    assert lake.delete_daily(spark, root, ["A"]) == 2
    assert [r["symbol"] for r in lake.read_daily(spark, root).collect()] == ["B"]


def test_user_table(spark, tmp_path):
    root = f"{tmp_path}/user"
    mk = lambda rows: spark.createDataFrame(rows, "symbol string, heat double")
    lake.write_user_table(mk([("A", 1.0), ("B", 2.0)]), root, "2024-01-02")
    lake.write_user_table(mk([("B", 3.0)]), root, "2024-01-02")
    lake.write_user_table(mk([("B", 4.0)]), root, "2024-01-03")
    got = {(r["symbol"], str(r["date"])): r["heat"] for r in spark.read.parquet(root).collect()}
    assert got == {("A", "2024-01-02"): 1.0, ("B", "2024-01-02"): 3.0, ("B", "2024-01-03"): 4.0}


def test_coerce_and_mapping(spark):
    df = spark.createDataFrame([("600000", "12", "yes", "2024-01-02"), ("sz000001", "x", "no", "2024-01-02")], "code string, close string, is_suspended string, trade_date string")
    m = lake.apply_mapping(df, rename={"code": "symbol"}, derive={"volume": "1 + 1"}, fill={"amount": 0.0})
    rows = lake.coerce(m.withColumn("symbol", lake.normal_symbol("symbol")), lake.DAILY).collect()
    assert [(r["symbol"], r["close"], r["is_suspended"], r["volume"], r["open"]) for r in rows] == [("600000.SH", 12.0, True, 2.0, None), ("000001.SZ", None, False, 2.0, None)]


def test_filters_sort_and_json(spark):
    df = spark.createDataFrame([("a", 1), ("b", None), ("ab", 3)], "s string, n int")
    assert {r["s"] for r in lake.apply_filters(df, ["s~a", "n:1|3"]).collect()} == {"a", "ab"}
    assert {r["s"] for r in lake.apply_filters(df, ["n!=1"]).collect()} == {"b", "ab"}
    assert [r["s"] for r in lake.apply_sort(df, "n:desc").collect()] == ["ab", "a", "b"]
    p = spark.createDataFrame([('{"data": {"rows": [{"k": 1}, {"k": 2}]}}',)], "j string")
    assert [r["k"] for r in lake.rows_at(p, "j", "data.rows", "struct<k: int>").collect()] == [1, 2]
