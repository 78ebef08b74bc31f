"""Queries of screening rules and small table operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import adjust, screens, tables
from . import panel
from .pairs import near, near_sql, query
from .q_domain import _RET, _returns

_N = near_sql
_B = "(PARTITION BY symbol ORDER BY trade_date ROWS BETWEEN {} PRECEDING AND {})"
_RULES = (
    f"WITH {panel.BARS}, p AS (SELECT *, lag(close) OVER w AS pre, row_number() OVER w AS n, lag(close, 3) OVER w AS c3 FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY trade_date)), "
    "q AS (SELECT *, CASE WHEN pre IS NOT NULL THEN greatest(high - low, abs(high - pre), abs(low - pre)) END AS tr FROM p), "
    f"r AS (SELECT *, avg(volume) OVER {_B.format(5, '1 PRECEDING')} AS v5, count(*) FILTER (close > pre) OVER {_B.format(2, 'CURRENT ROW')} AS ups, avg(close) OVER {_B.format(23, 'CURRENT ROW')} AS m, max(high) OVER {_B.format(12, '1 PRECEDING')} AS top, avg(tr) OVER {_B.format(5, 'CURRENT ROW')} AS atr, "
    "row_number() OVER (PARTITION BY symbol ORDER BY trade_date DESC) AS k FROM q), l AS (SELECT * FROM r WHERE k = 1), "
    """x AS (SELECT symbol, trade_date, 'volume_surge' AS rule, volume / v5 AS value, CASE WHEN n < 6 THEN 'too few bars' WHEN volume / v5 IS NULL THEN 'a value is missing' WHEN pre IS NULL THEN 'no close before' WHEN close <= open OR close <= pre THEN 'not up' WHEN (close / pre - 1) * 100 < 0 THEN 'rose too little' WHEN volume / v5 < 1.2 THEN 'too little volume' WHEN amount < 1000 THEN 'too small an amount' END AS reason FROM l
UNION ALL SELECT symbol, trade_date, 'keep_rising', (close / c3 - 1) * 100, CASE WHEN n < 4 THEN 'too few bars' WHEN c3 IS NULL THEN 'a value is missing' WHEN ups < 3 THEN 'a close did not rise' END FROM l
UNION ALL SELECT symbol, trade_date, 'pullback', close / m - 1, CASE WHEN n < 24 THEN 'too few bars' WHEN close / m - 1 < 0 THEN 'below the mean' WHEN close / m - 1 > 0.1 THEN 'too far above the mean' END FROM l
UNION ALL SELECT symbol, trade_date, 'breakout', top, CASE WHEN n < 13 THEN 'too few bars' WHEN top IS NULL THEN 'a value is missing' WHEN close <= top THEN 'not over the high' END FROM l
UNION ALL SELECT symbol, trade_date, 'low_atr', atr / close * 100, CASE WHEN n < 7 THEN 'too few bars' WHEN atr IS NULL THEN 'a value is missing' WHEN atr / close * 100 > 60 THEN 'ranges are too wide' END FROM l)"""
)


@query(f"{_RULES} SELECT symbol, trade_date, rule, reason IS NULL AS hit, {_N('value', 5)} AS value, reason FROM x")
def screening_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every screening rule on the newest bar of every symbol, with the reason where it doesn't hit."""
    d = screens.screen(panel.bars(spark, sf_dir), vol_ratio=1.2, min_amount=1000, days=3, mean=24, band=0.1, breakout=12, atr=6, max_atr_pct=60)
    return d.withColumn("value", near(F.col("value"), 5))


@query(_RET + f" SELECT symbol, year(trade_date) // 1 AS year, month(trade_date) AS month, {_N('product(1 + ret) - 1')} AS ret FROM ok GROUP BY 1, 2, 3")
def monthly_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returns compounded by month."""
    d = tables.monthly_returns(_returns(spark, sf_dir), "symbol")
    return d.select("symbol", F.col("year").cast("long").alias("year"), F.col("month").cast("long").alias("month"), near(F.col("ret")).alias("ret"))


@query(f"WITH t AS (SELECT l_suppkey AS k, count(*) AS n_trades, sum(l_extendedprice)::DOUBLE AS total FROM lineitem GROUP BY 1), n AS (SELECT ps AS k, avg(v) AS nav, count(DISTINCT d) AS days FROM (SELECT l_suppkey AS ps, l_shipdate AS d, 1000 + sum(l_quantity)::DOUBLE AS v FROM lineitem GROUP BY 1, 2) GROUP BY 1) SELECT k, n_trades, {_N('total', 2)} AS total_amount, {_N('total / nav / days')} AS turnover FROM t JOIN n USING (k)")
def trade_turnover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traded amount by mean net value and number of dates, by supplier."""
    # a supplier's lines come together once: nearly every date of one is a group, so sums before the shuffle only hold memory
    li = panel.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("k"), "l_shipdate", "l_quantity", "l_extendedprice")
    li = panel.together(li, "k", li)
    nav = li.groupBy("k", F.col("l_shipdate").alias("trade_date")).agg((1000 + F.sum("l_quantity").cast("double")).alias("nav"))
    d = tables.trade_turnover(li.select("k", F.col("l_extendedprice").alias("amount")), nav, "k")
    return d.withColumns({"total_amount": near(F.col("total_amount"), 2), "turnover": near(F.col("turnover"))})


@query("SELECT user_id AS k, event_type AS kind, CAST(value AS DOUBLE) AS amount, NULL::DOUBLE AS balance FROM events UNION ALL SELECT c_custkey, NULL, NULL, CAST(c_acctbal AS DOUBLE) FROM customer")
def union_relaxed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables of unlike columns and types, one above the other."""
    a = panel.table(spark, sf_dir, "events").select(F.col("user_id").alias("k"), F.col("event_type").alias("kind"), F.col("value").alias("amount"))
    b = panel.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").cast("double").alias("balance"))
    return tables.union_relaxed([a, b])


@query("SELECT user_id, event_type, ts, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def keep_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of each user and type."""
    e = panel.table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id", "value")
    return tables.keep_last(e, ["user_id", "event_type"], ["ts", "event_id"])


@query("SELECT o_custkey AS k FROM orders INTERSECT SELECT user_id FROM events INTERSECT SELECT c_custkey FROM customer")
def common_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers who ordered and had an event."""
    t = lambda name, c: panel.table(spark, sf_dir, name).select(F.col(c).alias("k"))
    return tables.common([t("orders", "o_custkey"), t("events", "user_id"), t("customer", "c_custkey")], ["k"])


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT user_id FROM events)")
def present_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of customers who had an event."""
    o = panel.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return tables.present(o, panel.table(spark, sf_dir, "events").select(F.col("user_id").alias("o_custkey")), ["o_custkey"])


@query("WITH g AS (SELECT user_id AS symbol, event_id AS trade_date, CASE WHEN event_type = 'purchase' THEN value END AS v FROM events) SELECT symbol, trade_date, last_value(v IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY trade_date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS v, first_value(v IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY trade_date ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS next FROM g")
def filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last purchase so far, and the next one within three events."""
    e = panel.table(spark, sf_dir, "events").select(F.col("user_id").alias("symbol"), F.col("event_id").alias("trade_date"), F.when(F.col("event_type") == "purchase", F.col("value")).alias("v"))
    return tables.filled(tables.filled(e.withColumn("next", F.col("v")), ["v"]), ["next"], backward=True, most=3)


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 9 END AS status FROM orders")
def replaced_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order states through a table of numbers."""
    return panel.table(spark, sf_dir, "orders").select("o_orderkey", tables.replaced("o_orderstatus", {"F": 1, "O": 2}, 9).alias("status"))


@query("SELECT event_id, user_id FROM events WHERE json_extract_string(props, '$.k') = '7'")
def json_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by a field of their JSON properties."""
    return tables.json_where(panel.table(spark, sf_dir, "events"), "props", "$.k", "7").select("event_id", "user_id")


_ADJ = f"WITH {panel.WIDE}, a AS (SELECT *, CASE WHEN is_suspended THEN NULL ELSE adj_factor END AS f FROM wide), b AS (SELECT *, last_value(f IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY trade_date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM a), n AS (SELECT symbol, arg_max(f, trade_date) FILTER (f IS NOT NULL) AS newest FROM a GROUP BY 1)"


@query(f"{_ADJ} SELECT symbol, trade_date, {_N('close * coalesce(g / newest, 1)', 4)} AS pre, {_N('close * coalesce(g, 1)', 4)} AS post, f IS NULL AS factor_missing FROM b JOIN n USING (symbol)")
def adjusted_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closes adjusted to the newest bar and to the first; suspended bars have no factor."""
    d = panel.wide_bars(spark, sf_dir).withColumn("adj_factor", F.when(~F.col("is_suspended"), F.col("adj_factor"))).select("symbol", "trade_date", "close", "adj_factor")
    pre = adjust.adjusted(d, "pre").select("symbol", "trade_date", near(F.col("close"), 4).alias("pre"), "factor_missing")
    return pre.join(adjust.adjusted(d, "post").select("symbol", "trade_date", near(F.col("close"), 4).alias("post")), ["symbol", "trade_date"])


@query(f"WITH {panel.WIDE}, l AS (SELECT *, adj_factor / arg_max(adj_factor, trade_date) OVER (PARTITION BY symbol) AS factor FROM wide) SELECT symbol, trade_date, {_N('factor')} AS factor, {_N('close * factor', 4)} AS close, {_N('CASE WHEN volume > 0 THEN amount::DOUBLE / volume * factor END', 4)} AS vwap FROM l")
def export_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices, factor and mean price as an export takes them."""
    d = adjust.for_export(panel.wide_bars(spark, sf_dir).select("symbol", "trade_date", "close", "volume", "amount", "adj_factor"))
    return d.select("symbol", "trade_date", near(F.col("factor")).alias("factor"), near(F.col("close"), 4).alias("close"), near(F.col("vwap"), 4).alias("vwap"))
