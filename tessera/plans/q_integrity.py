"""Queries of partition integrity: orders by day, as stored and as their lines tell them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import integrity
from .panel import table
from .pairs import near, near_sql, query

_N = near_sql
#: The stored day: a customer's orders. Every seventh customer's are quoted at ten, customers of 11 are left out on the 13th.
_STORED = """s AS (SELECT 'C' || o_custkey AS symbol, o_orderdate::DATE AS trade_date, round(sum(o_totalprice), 2) + CASE WHEN o_custkey % 1000 = 1 THEN 0.01 ELSE 0 END AS close, count(*)::DOUBLE AS volume,
  CASE WHEN o_custkey % 7 = 0 AND day(o_orderdate) < 5 THEN epoch_ms(o_orderdate::DATE) + 36000000 END AS quote_ts FROM orders WHERE NOT (o_custkey % 11 = 0 AND day(o_orderdate) = 13) GROUP BY o_custkey, o_orderdate::DATE, o_orderdate)"""
_OTHER = "a AS (SELECT 'C' || o_custkey AS symbol, o_orderdate::DATE AS trade_date, round(sum(o_totalprice), 2) AS close, (count(*) - CASE WHEN o_custkey % 13 = 0 THEN count(*) ELSE 0 END)::DOUBLE AS volume FROM orders GROUP BY o_custkey, o_orderdate::DATE)"


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o = table(spark, sf_dir, "orders").withColumn("trade_date", F.to_date("o_orderdate"))
    day = o.groupBy("o_custkey", "trade_date").agg(F.round(F.sum("o_totalprice"), 2).alias("close"), F.count("*").cast("double").alias("volume"))
    symbol = F.concat(F.lit("C"), F.col("o_custkey")).alias("symbol")
    quoted = F.when((F.col("o_custkey") % 7 == 0) & (F.dayofmonth("trade_date") < 5), F.unix_millis(F.col("trade_date").cast("timestamp")) + 36_000_000)
    close = F.col("close") + F.when(F.col("o_custkey") % 1000 == 1, 0.01).otherwise(0.0)
    stored = day.where(~((F.col("o_custkey") % 11 == 0) & (F.dayofmonth("trade_date") == 13))).select(symbol, "trade_date", close.alias("close"), "volume", quoted.alias("quote_ts"))
    other = day.select(symbol, "trade_date", "close", F.when(F.col("o_custkey") % 13 == 0, 0.0).otherwise(F.col("volume")).alias("volume"))
    return stored, other


@query(
    f"""WITH {_STORED}, {_OTHER}, q AS (SELECT trade_date, count(*) AS rows_, count(quote_ts) AS odd FROM s GROUP BY 1),
j AS (SELECT coalesce(s.trade_date, a.trade_date) AS trade_date, coalesce(s.symbol, a.symbol) AS symbol, s.close AS x, a.close AS y, coalesce(s.volume <> 0, false) AS own, coalesce(a.volume <> 0, false) AS want FROM s FULL JOIN a USING (trade_date, symbol)),
d AS (SELECT trade_date, count(*) FILTER (x IS NOT NULL AND y IS NOT NULL) AS checked, count(*) FILTER (abs(x - y) > 0.005 + 1e-9) AS mismatches, max(abs(x - y)) FILTER (abs(x - y) > 0.005 + 1e-9) AS max_diff,
  count(*) FILTER (want) AS expected, count(*) FILTER (own) AS actual, count(*) FILTER (want AND NOT own) AS n_missing, count(*) FILTER (own AND NOT want) AS n_extra FROM j GROUP BY 1)
SELECT trade_date, CASE WHEN odd > 0 THEN 'snapshot' ELSE 'authoritative' END AS state, rows_ AS rows, odd AS suspicious_rows, CASE WHEN mismatches > 0 THEN 'mismatch' WHEN checked = 0 THEN 'no_overlap' ELSE 'ok' END AS value_status, checked, mismatches, {_N('max_diff')} AS max_diff,
  CASE WHEN n_missing > 0 THEN 'gap' ELSE 'ok' END AS coverage_status, expected, actual, n_missing, n_extra, odd > 0 OR mismatches > 0 OR n_missing > 0 AS repair FROM q JOIN d USING (trade_date)"""
)
def integrity_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every day's verdicts: quoted or final, values and coverage against an independent table, repair due or not."""
    d = integrity.report(*_sides(spark, sf_dir))
    return d.select("trade_date", "state", "rows", "suspicious_rows", "value_status", "checked", "mismatches", near(F.col("max_diff")).alias("max_diff"), "coverage_status", "expected", "actual", "n_missing", "n_extra", "repair")
