"""Queries of holders' costs and price levels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chips, levels
from . import panel
from .pairs import near, near_sql, query

_N = near_sql
_HELD = (
    f"WITH {panel.BARS}, t AS (SELECT *, (high + low + 2 * close) / 4 AS p, CASE WHEN turnover_rate > 0 THEN least(turnover_rate / 100, 1) ELSE 0 END AS t FROM bars), "
    "x AS (SELECT *, t * coalesce(product(1 - t) OVER (PARTITION BY symbol ORDER BY trade_date DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS w, product(1 - t) OVER (PARTITION BY symbol ORDER BY trade_date) AS left_ FROM t)"
)


@query(
    f"{_HELD}, b AS (SELECT symbol, min(low) AS lo, (max(high) - min(low)) / 60 AS width FROM bars GROUP BY 1), d AS (SELECT symbol, least(floor((p - lo) / width), 59)::INT AS bin, any_value(lo) AS lo, any_value(width) AS width, sum(w) AS w FROM x JOIN b USING (symbol) WHERE w > 0 GROUP BY 1, 2) "
    f"SELECT symbol, bin, {_N('lo + (bin + 0.5) * width')} AS price, {_N('w / sum(w) OVER (PARTITION BY symbol)')} AS share FROM d"
)
def cost_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the shares afloat were bought at, by symbol and price bin."""
    d = chips.cost_distribution(panel.bars(spark, sf_dir))
    return d.select("symbol", "bin", near(F.col("price")).alias("price"), near(F.col("share")).alias("share"))


@query(f"{_HELD}, c AS (SELECT symbol, arg_max(close, trade_date) AS c FROM bars GROUP BY 1) SELECT symbol, {_N('sum(CASE WHEN p < c THEN w ELSE 0 END) / sum(w)')} AS profit_ratio, 'turnover_rate' AS caliber FROM x JOIN c USING (symbol) GROUP BY 1 HAVING sum(w) > 0")
def profit_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of each symbol's float that was bought below its last close."""
    return chips.profit_ratio(panel.bars(spark, sf_dir)).withColumn("profit_ratio", near(F.col("profit_ratio")))


@query(f"{_HELD} SELECT n.symbol, n.trade_date, {_N('CASE WHEN sum(o.t / o.left_) > 0 THEN sum(CASE WHEN o.p < n.close THEN o.t / o.left_ ELSE 0 END) / sum(o.t / o.left_) END')} AS cyq_profit_ratio FROM x n JOIN x o ON n.symbol = o.symbol AND o.trade_date <= n.trade_date GROUP BY 1, 2")
def rolling_profit_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as of every date."""
    return chips.rolling_profit_ratio(panel.bars(spark, sf_dir)).withColumn("cyq_profit_ratio", near(F.col("cyq_profit_ratio")))


@query()
def price_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All price levels of every symbol as of its last bar."""
    return levels.compute_levels(panel.bars(spark, sf_dir), extremes=(12, 60), lookback=60, fib_window=60, keltner=(("keltner_s", 20, 2.0), ("keltner_m", 40, 2.5)))


@query(
    f"WITH {panel.BARS}, r AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY trade_date DESC) AS k FROM bars), s AS (SELECT symbol, k, high, low, lag(high) OVER w AS ph, lag(low) OVER w AS pl FROM r WHERE k <= 60 WINDOW w AS (PARTITION BY symbol ORDER BY trade_date)), "
    "g AS (SELECT symbol, k, 'up' AS direction, ph AS a, low AS b FROM s WHERE low > ph UNION ALL SELECT symbol, k, 'down', high, pl FROM s WHERE high < pl) "
    f"SELECT symbol, direction, {_N('(a + b) / 2')} AS value FROM g WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.symbol = g.symbol AND s.k < g.k AND s.low <= g.b AND s.high >= g.a)"
)
def unfilled_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps of the last sixty bars that no later bar has touched."""
    return levels.gaps(panel.bars(spark, sf_dir), lookback=60).withColumn("value", near(F.col("value")))
