"""Trading calendars, tradability and abnormal moves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.base import div, ts
from .quality import hit, or_flags


def sessions(dates: DataFrame) -> DataFrame:
    """The calendar with each session's place and neighbours."""
    w = W.orderBy("trade_date")
    d = dates.select("trade_date").distinct()
    return d.select("trade_date", F.row_number().over(w).alias("k"), F.lag("trade_date").over(w).alias("prev"), F.lead("trade_date").over(w).alias("next"))


def session_lag(rows: DataFrame, date: str, calendar: DataFrame, now) -> DataFrame:
    """Sessions begun after each row's date up to ``now``; a date after ``now`` gives null."""
    cal = calendar.select("trade_date").distinct().where(F.col("trade_date") <= F.lit(now)).agg(F.array_sort(F.collect_list("trade_date")).alias("days"))
    late = F.size(F.filter("days", lambda d: d > F.col(date)))
    return rows.crossJoin(F.broadcast(cal)).withColumn("lag", F.when(F.col(date) <= F.lit(now), late)).drop("days")


def tradability(df: DataFrame, listed: DataFrame | None = None, least_days: int = 60) -> DataFrame:
    """Bits for suspended rows and, with listing dates, for young listings."""
    d = df.join(listed.select("symbol", "list_date"), "symbol", "left") if listed is not None else df.withColumn("list_date", F.lit(None).cast("date"))
    young = F.datediff("trade_date", "list_date") < least_days
    return or_flags(d, hit("SUSPENDED", F.coalesce("is_suspended", F.lit(False))), hit("NEW_LISTING", F.coalesce(young, F.lit(False)))).drop("list_date")


def deviation(bars: DataFrame, index: DataFrame, windows=(3, 10, 30)) -> DataFrame:
    """Moves over n jointly quoted sessions less the index's."""
    j = bars.join(index.select("trade_date", F.col("close").alias("index_close")), "trade_date")
    move = lambda x, n: div(x, F.lag(x, n).over(ts())) - 1
    return j.withColumns({f"dev_{n}": move("close", n) - move("index_close", n) for n in windows})


def proximity(dev: str, up: float, down: float):
    """How near a deviation is to its threshold: 3 reached, 2 from 0.7, 1 from 0.5, else 0."""
    x = F.col(dev)
    ratio = F.when(x >= 0, x / up).otherwise(-x / down)
    return F.when(ratio >= 1, 3).when(ratio >= 0.7, 2).when(ratio >= 0.5, 1).otherwise(0)


def volume_profile(bars: DataFrame, bins: int = 20, top: int = 5) -> DataFrame:
    """Each bar's volume spread evenly over the price bins it covers; the fullest bins of each symbol.

    A row per bar and bin it covers, at most ``bins`` a bar.
    """
    w = W.partitionBy("symbol")
    d = bars.select("symbol", "high", "low", "volume", F.min("low").over(w).alias("a"), F.max("high").over(w).alias("z"))
    width = (F.col("z") - F.col("a")) / bins
    bin_of = lambda x: F.least(F.lit(bins - 1), F.coalesce(F.floor(F.try_divide(F.col(x) - F.col("a"), width)), F.lit(0))).cast("int")
    d = d.withColumns({"lo": bin_of("low"), "hi": bin_of("high")})
    d = d.select("symbol", "a", width.alias("width"), (F.col("volume") / (F.col("hi") - F.col("lo") + 1)).alias("part"), F.explode(F.sequence("lo", "hi")).alias("bin"))
    g = d.groupBy("symbol", "bin").agg(F.sum("part").alias("volume"), F.first("a").alias("a"), F.first("width").alias("width"))
    rn = F.row_number().over(W.partitionBy("symbol").orderBy(F.desc(F.round("volume", 6)), "bin"))
    return g.withColumn("rn", rn).where(F.col("rn") <= top).select("symbol", "bin", (F.col("a") + (F.col("bin") + 0.5) * F.col("width")).alias("price"), "volume", "rn")
