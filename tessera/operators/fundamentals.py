"""Point-in-time fundamentals: what was known at a date, group percentiles, scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def known_at(facts: DataFrame, asof) -> DataFrame:
    """Per symbol and item the newest report published by ``asof``; of its revisions the last. A hash aggregate."""
    return facts.where(F.col("pub_date") <= F.lit(asof)).groupBy("symbol", "item").agg(F.max_by(F.struct("stat_date", "pub_date", "value"), F.struct("stat_date", "pub_date", "value")).alias("x")).select("symbol", "item", "x.*")


def wide(facts: DataFrame, asof, items: list[str]) -> DataFrame:
    return known_at(facts, asof).groupBy("symbol").pivot("item", items).agg(F.first("value"))


def industry_at(classes: DataFrame, asof) -> DataFrame:
    return classes.where(F.col("std_date") <= F.lit(asof)).groupBy("symbol").agg(F.max_by("code", "std_date").alias("code"))


def bands(values: DataFrame, least: int = 5) -> DataFrame:
    """Quartiles by group and item where there are enough samples; ``values``: code, item, value."""
    q = values.where("value IS NOT NULL").groupBy("code", "item").agg(F.percentile("value", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"), F.count("*").alias("n"))
    return q.where(F.col("n") >= least).select("code", "item", F.col("q")[0].alias("p25"), F.col("q")[1].alias("p50"), F.col("q")[2].alias("p75"), "n")


def points(values: DataFrame, banded: DataFrame, full: float = 3.0) -> DataFrame:
    """Points by quartile: above p75 all, above p50 two thirds, above p25 one third, else none."""
    v = F.col("value")
    share = F.when(v >= F.col("p75"), 1.0).when(v >= F.col("p50"), 2 / 3).when(v >= F.col("p25"), 1 / 3).otherwise(0.0)
    return values.join(banded, ["code", "item"]).withColumn("points", share * full)


def score(pointed: DataFrame, full: float = 3.0) -> DataFrame:
    """Per symbol: points, what could be had, their share of 100 and a letter."""
    s = pointed.groupBy("symbol").agg(F.sum("points").alias("points"), (F.count("*") * full).alias("available"))
    s = s.withColumn("normalised", 100 * F.try_divide(F.col("points"), F.col("available")))
    return s.withColumn("letter", F.when(F.col("normalised") >= 80, "A").when(F.col("normalised") >= 60, "B").when(F.col("normalised") >= 40, "C").otherwise("D"))


def growth(facts: DataFrame, quarters: int = 4) -> DataFrame:
    """Change against the same item ``quarters`` quarters earlier, published when both are."""
    a = facts.select("symbol", "item", "stat_date", "pub_date", "value")
    b = a.select("symbol", "item", F.last_day(F.add_months("stat_date", 3 * quarters)).alias("stat_date"), F.col("pub_date").alias("pub0"), F.col("value").alias("value0"))
    j = a.join(b, ["symbol", "item", "stat_date"])
    return j.select("symbol", "item", "stat_date", F.greatest("pub_date", "pub0").alias("pub_date"), (F.try_divide(F.col("value"), F.col("value0")) - 1).alias("growth"))
