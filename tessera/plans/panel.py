"""Panels derived from the given tables, and the same derivations as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import base


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def together(df: DataFrame, key: str, source: DataFrame) -> DataFrame:
    """``df`` with equal keys in one partition, a partition for every 250,000 rows of the table it is made of, one a core at least: what a task holds doesn't grow."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-source.count() // 250_000)), key)


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly bars per supplier: symbol, trade_date, open, high, low, close, volume, amount, turnover_rate.

    First and last price are by the whole order of a line, since (order, line) isn't unique. A month of a supplier has few
    lines, so sums before the shuffle would save nothing and their wide rows would be sorted twice: a supplier's lines come
    together first, and bars and the windows over them stay where they are.
    """
    order = F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity")
    price = F.col("l_extendedprice") / F.col("l_quantity")
    lines = table(spark, sf_dir, "lineitem")
    return (
        together(lines.withColumn("symbol", F.concat(F.lit("S"), F.col("l_suppkey"))), "symbol", lines)
        .groupBy("symbol", F.trunc("l_shipdate", "month").alias("trade_date"))
        .agg(
            F.min_by(price, order).alias("open"),
            F.max(price).alias("high"),
            F.min(price).alias("low"),
            F.max_by(price, order).alias("close"),
            F.sum("l_quantity").cast("double").alias("volume"),
            F.round(F.sum("l_extendedprice"), 2).alias("amount"),
            F.round(100 * F.avg("l_discount"), 8).alias("turnover_rate"),
        )
    )


BARS = """bars AS (
  SELECT 'S' || l_suppkey AS symbol, date_trunc('month', l_shipdate)::DATE AS trade_date,
    arg_min(l_extendedprice / l_quantity, (l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity)) AS open,
    max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low,
    arg_max(l_extendedprice / l_quantity, (l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity)) AS close,
    sum(l_quantity)::DOUBLE AS volume, round(sum(l_extendedprice), 2) AS amount, round(100 * avg(l_discount), 8) AS turnover_rate
  FROM lineitem GROUP BY 1, 2
)"""


def wide_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """bars with previous close, float market value, industry (the supplier's nation), adjustment factor, suspension."""
    b = bars(spark, sf_dir)
    nation = (
        table(spark, sf_dir, "supplier")
        .join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .select(F.concat(F.lit("S"), F.col("s_suppkey")).alias("symbol"), F.col("n_name").alias("industry"))
    )
    first = F.min("trade_date").over(W.partitionBy("symbol"))
    return (
        b.withColumns(
            {
                "pre_close": F.lag("close").over(base.ts()),
                "float_mv": base.div(F.col("close") * F.col("volume") * 100, "turnover_rate"),
                "adj_factor": F.round(1 + 0.1 * (F.year("trade_date") - F.year(first)), 6),
                "is_suspended": F.col("volume") < 20,
            }
        )
        .join(nation, "symbol", "left")
        .select(*b.columns, "pre_close", "float_mv", "industry", "adj_factor", "is_suspended")
    )


WIDE = (
    BARS
    + """, wide AS (
  SELECT b.*, lag(close) OVER (PARTITION BY symbol ORDER BY trade_date) AS pre_close,
    CASE WHEN turnover_rate <> 0 THEN close * volume * 100 / turnover_rate END AS float_mv, n_name AS industry,
    round(1 + 0.1 * (year(trade_date) - year(min(trade_date) OVER (PARTITION BY symbol))), 6) AS adj_factor, volume < 20 AS is_suspended
  FROM bars b LEFT JOIN (SELECT 'S' || s_suppkey AS ssym, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey) ON symbol = ssym
)"""
)


def evaluated(spark: SparkSession, sf_dir: str, horizons=(1, 3, 6)) -> DataFrame:
    """wide_bars with a factor (5-period mean over close) and forward returns, made before any row is left out."""
    from ..functions import ts

    w = wide_bars(spark, sf_dir)
    w = w.withColumn("factor", base.div(ts.ts_mean("close", 5), "close"))
    return w.withColumns({f"fwd_ret_{h}": base.div(F.lead("close", h).over(base.ts()), "close") - 1 for h in horizons})


EVALUATED = (
    WIDE
    + """, ev AS (
  SELECT *, CASE WHEN count(close) OVER w5 = 5 THEN avg(close) OVER w5 END / close AS factor,
    lead(close, 1) OVER w / close - 1 AS fwd_ret_1, lead(close, 3) OVER w / close - 1 AS fwd_ret_3, lead(close, 6) OVER w / close - 1 AS fwd_ret_6
  FROM wide WINDOW w AS (PARTITION BY symbol ORDER BY trade_date), w5 AS (PARTITION BY symbol ORDER BY trade_date ROWS 4 PRECEDING)
)"""
)


def financial_pit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts per customer, quarter and item (the order priority), published 30 to 89 days after the quarter's end."""
    o = table(spark, sf_dir, "orders")
    stat = F.last_day(F.add_months(F.trunc("o_orderdate", "quarter"), 2))
    return (
        o.groupBy(F.concat(F.lit("C"), F.col("o_custkey")).alias("symbol"), "o_custkey", stat.alias("stat_date"), F.col("o_orderpriority").alias("item"))
        .agg(F.round(F.sum("o_totalprice"), 2).alias("value"))
        .select("symbol", "stat_date", F.date_add("stat_date", (30 + F.col("o_custkey") % 60).cast("int")).alias("pub_date"), "item", "value")
    )


PIT = """pit AS (
  SELECT 'C' || o_custkey AS symbol, last_day((date_trunc('quarter', o_orderdate) + INTERVAL 2 MONTH)::DATE) AS stat_date,
    (last_day((date_trunc('quarter', o_orderdate) + INTERVAL 2 MONTH)::DATE) + (30 + o_custkey % 60)::INT)::DATE AS pub_date,
    o_orderpriority AS item, round(sum(o_totalprice), 2) AS value
  FROM orders GROUP BY o_custkey, 2, 3, 4
)"""


def industry_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' segments from 1995, and for odd keys the nation from 1998."""
    c = table(spark, sf_dir, "customer").withColumn("symbol", F.concat(F.lit("C"), F.col("c_custkey")))
    first = c.select("symbol", F.lit("seg").alias("std"), F.col("c_mktsegment").alias("code"), F.lit("1995-01-01").cast("date").alias("std_date"))
    return first.unionByName(c.where("c_custkey % 2 = 1").select("symbol", F.lit("seg").alias("std"), F.concat(F.lit("N"), F.col("c_nationkey")).alias("code"), F.lit("1998-01-01").cast("date").alias("std_date")))


CLASSIFY = """cls AS (
  SELECT 'C' || c_custkey AS symbol, 'seg' AS std, c_mktsegment AS code, DATE '1995-01-01' AS std_date FROM customer
  UNION ALL SELECT 'C' || c_custkey, 'seg', 'N' || c_nationkey, DATE '1998-01-01' FROM customer WHERE c_custkey % 2 = 1
)"""


def user_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dense daily panel from events: first, max, min, last and sum of value by user and day."""
    order = F.struct("ts", "event_id")
    return (
        table(spark, sf_dir, "events")
        .groupBy(F.concat(F.lit("U"), F.col("user_id")).alias("symbol"), F.to_date("ts").alias("trade_date"))
        .agg(F.min_by("value", order).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", order).alias("close"), F.round(F.sum("value"), 6).alias("volume"))
    )


DAILY = """daily AS (
  SELECT 'U' || user_id AS symbol, ts::DATE AS trade_date, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low,
    arg_max(value, (ts, event_id)) AS close, round(sum(value), 6) AS volume FROM events GROUP BY 1, 2
)"""
