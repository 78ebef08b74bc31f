"""Group and market analytics: daily group indices, rotation, streaks, regimes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.base import div, grown, ts


def group_daily(bars: DataFrame, group: str) -> DataFrame:
    """Per date and group: mean and median return, members, share of risers, amount, mean turnover."""
    d = bars.withColumn("ret", div("close", F.lag("close").over(ts())) - 1)
    return d.groupBy("trade_date", group).agg(
        F.avg("ret").alias("ret"),
        F.percentile("ret", 0.5).alias("median_ret"),
        F.count("ret").alias("n"),
        F.avg((F.col("ret") > 0).cast("double")).alias("up_ratio"),
        F.sum("amount").alias("amount"),
        F.avg("turnover_rate").alias("turnover"),
    )


def index_level(daily: DataFrame, key: str, base: float = 1.0) -> DataFrame:
    w = W.partitionBy(key).orderBy("trade_date").rowsBetween(W.unboundedPreceding, 0)
    return daily.withColumn("level", base * grown(F.coalesce("ret", F.lit(0.0))).over(w))


def rotation(levels: DataFrame, bench: DataFrame, key: str, look: int, look_mom: int, smooth: int) -> DataFrame:
    """Relative strength ratio and momentum of each group against a benchmark, and the quadrant; full windows only."""
    w = W.partitionBy(key).orderBy("trade_date")
    d = levels.join(bench.select("trade_date", F.col("level").alias("bench")), "trade_date").withColumn("rs", 100 * F.try_divide(F.col("level"), F.col("bench")))

    def smoothed(x: str, lag: int):
        r = 100 * F.try_divide(F.col(x), F.lag(x, lag).over(w))
        span = w.rowsBetween(-(smooth - 1), 0)
        return F.when(F.count(r).over(span) == smooth, F.avg(r).over(span))

    d = d.withColumn("rs_ratio", smoothed("rs", look))
    d = d.withColumn("rs_mom", smoothed("rs_ratio", look_mom))
    a, b = F.col("rs_ratio"), F.col("rs_mom")
    q = F.when((a > 100) & (b > 100), 1).when((a < 100) & (b > 100), 2).when((a < 100) & (b < 100), 3).when((a > 100) & (b < 100), 4)
    return d.withColumn("quadrant", q)


def trailing(daily: DataFrame, key: str, windows) -> DataFrame:
    """Compound return of each group over its newest n rows, for several n."""
    rn = F.row_number().over(W.partitionBy(key).orderBy(F.desc("trade_date")))
    d = daily.withColumn("rn", rn)
    return d.groupBy(key).agg(*[(grown(F.when(F.col("rn") <= n, F.col("ret"))) - 1).alias(f"ret_{n}") for n in windows])


def streaks(pool: DataFrame, calendar: DataFrame) -> DataFrame:
    """Length of each symbol's run of consecutive sessions in the pool (rows: trade_date, symbol)."""
    cal = calendar.select("trade_date").distinct().withColumn("k", F.row_number().over(W.orderBy("trade_date")))
    d = pool.select("trade_date", "symbol").distinct().join(cal, "trade_date")
    d = d.withColumn("island", F.col("k") - F.row_number().over(W.partitionBy("symbol").orderBy("k")))
    return d.withColumn("streak", F.row_number().over(W.partitionBy("symbol", "island").orderBy("k"))).drop("island", "k")


def ladder(streaked: DataFrame) -> DataFrame:
    """Per date: longest streak, how many of each height, and the share promoted from the session before."""
    d = streaked.groupBy("trade_date").agg(F.max("streak").alias("highest"), F.count_if(F.col("streak") == 1).alias("first"), F.count_if(F.col("streak") >= 2).alias("second"), F.count_if(F.col("streak") >= 3).alias("third"), F.count_distinct("streak").alias("rungs"), F.count("*").alias("n"))
    return d.withColumn("promotion", F.try_divide(F.col("second").cast("double"), F.lag("n").over(W.orderBy("trade_date"))))


def component(x, low: float, high: float, invert: bool = False):
    """0 to 100 between two bounds; a missing value is 50."""
    v = F.least(F.greatest((F.col(x) - low) / (high - low), F.lit(0.0)), F.lit(1.0)) * 100
    return F.coalesce(100 - v if invert else v, F.lit(50.0))


def regime(daily: DataFrame, scores: dict) -> DataFrame:
    """Weighted mean of scores (column: weight), and one of five states."""
    total = sum(scores.values())
    s = None
    for name, weight in scores.items():
        part = F.col(name) * (weight / total)
        s = part if s is None else s + part
    d = daily.withColumn("score", s)
    return d.withColumn("state", F.when(F.col("score") >= 80, "strong").when(F.col("score") >= 60, "warm").when(F.col("score") >= 40, "neutral").when(F.col("score") >= 20, "cool").otherwise("cold"))
