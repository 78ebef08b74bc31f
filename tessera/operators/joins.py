"""Joins: as-of, point in time, overlays, fills and comparisons of two sources."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def asof_join(left: DataFrame, right: DataFrame, *, left_on: str, right_on: str, by: list[str], columns: list[str]) -> DataFrame:
    """Each left row with ``columns`` of the newest right row of the same key whose ``right_on`` isn't later; else nulls.

    Both sides are stacked and dealt by key once; the newest right row so far is carried down. Of right rows with one
    key and time the largest counts.
    """
    values = F.struct(*columns)
    a = left.select(*by, F.col(left_on).alias("__t"), F.lit(1).alias("__side"), F.lit(None).cast(right.select(values.alias("x")).schema["x"].dataType).alias("__r"), F.struct(*left.columns).alias("__l"))
    b = right.select(*by, F.col(right_on).alias("__t"), F.lit(0).alias("__side"), values.alias("__r"), F.lit(None).cast(a.schema["__l"].dataType).alias("__l"))
    carried = F.last("__r", ignorenulls=True).over(W.partitionBy(*by).orderBy("__t", "__side", "__r").rowsBetween(W.unboundedPreceding, 0))
    return a.unionByName(b).withColumn("__r", carried).where("__side = 1").select("__l.*", *[F.col("__r")[c].alias(c) for c in columns])


def membership_asof(batches: DataFrame, dates: DataFrame, *, date: str = "trade_date", effective: str = "eff_date", by: str = "index_code") -> DataFrame:
    """Members at each date: the whole newest batch in effect, not the newest row of each member."""
    starts = batches.select(by, effective).distinct()
    span = starts.withColumn("__until", F.lead(effective).over(W.partitionBy(by).orderBy(effective)))
    at = dates.select(date).distinct().join(span, (F.col(date) >= F.col(effective)) & (F.col("__until").isNull() | (F.col(date) < F.col("__until"))))
    return at.drop("__until").join(batches, [by, effective])


def newest(df: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """The newest row of each key by a hash aggregate, not a sort."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("__x")).select(*keys, "__x.*")


def newest_n(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each key in the given order, numbered."""
    return df.withColumn("rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("rn") <= n)


def overlay(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows but those whose key comes anew, and all new rows; columns of either side stay."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def merge_flags(old: DataFrame, new: DataFrame, keys: list[str], flag: str = "quality_flags") -> DataFrame:
    """New rows with the stored bits of their key added."""
    stored = old.groupBy(*keys).agg(F.bit_or(flag).alias("__old"))
    return new.join(stored, keys, "left").withColumn(flag, F.coalesce(F.col(flag), F.lit(0)).bitwiseOR(F.coalesce("__old", F.lit(0)))).drop("__old")


def fill_nulls(left: DataFrame, right: DataFrame, keys: list[str], columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """(left with its nulls, and only these, taken from right; how many cells of each column were filled)."""
    other = right.select(*keys, *[F.col(c).alias(f"__{c}") for c in columns])
    joined = left.join(other, keys, "left")
    filled = joined.agg(*[F.count_if(F.col(c).isNull() & F.col(f"__{c}").isNotNull()).alias(c) for c in columns])
    return joined.withColumns({c: F.coalesce(c, f"__{c}") for c in columns}).drop(*[f"__{c}" for c in columns]), filled


def attach(panel: DataFrame, side: DataFrame, *, snapshot: bool = False, keys=("symbol", "trade_date"), prefix: str = "ext_") -> DataFrame:
    """User columns by exact key, nothing filled; a snapshot only joins to a panel of one date."""
    if snapshot and panel.select("trade_date").distinct().limit(2).count() > 1:
        raise ValueError("a snapshot only joins to a single date: elsewhere it would look ahead")
    on = ["symbol"] if snapshot else list(keys)
    return panel.join(side.select(*on, *[F.col(c).alias(prefix + c) for c in side.columns if c not in keys]), on, "left")


def classify_divergence(primary: DataFrame, peer: DataFrame, fields: list[str], *, keys=("symbol", "trade_date"), tolerance_pct: float = 0.1, amounts=("volume", "amount")) -> DataFrame:
    """A row per key and field of a full outer comparison: level L0 (equal), L1 (tolerable), L2 (apart), L3 (missing).

    Prices are compared at the tolerance, amounts at ten times it.
    """
    a = primary.select(*keys, F.lit(1).alias("__a"), *fields)
    b = peer.select(*keys, F.lit(1).alias("__b"), *[F.col(f).alias(f"__{f}") for f in fields])
    j = a.join(b, list(keys), "full")
    long = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias("left"), F.col(f"__{f}").cast("double").alias("right"), F.lit(10.0 if f in amounts else 1.0).alias("slack")) for f in fields]))
    rows = j.select(*keys, "__a", "__b", long.alias("x")).select(*keys, "__a", "__b", "x.*")
    rel = F.try_divide(F.abs(F.col("left") - F.col("right")), F.greatest(F.abs("left"), F.abs("right"))) * 100
    rel = F.when(F.col("left") == F.col("right"), F.lit(0.0)).otherwise(rel)
    level = (
        F.when(F.col("__a").isNull() | F.col("__b").isNull(), "L3")
        .when(F.col("left").isNull() | F.col("right").isNull(), "L3")
        .when(rel == 0, "L0")
        .when(rel <= F.lit(tolerance_pct) * F.col("slack"), "L1")
        .otherwise("L2")
    )
    return rows.select(*keys, "field", "left", "right", rel.alias("diff_pct"), level.alias("level"))


def compare_trades(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """One row: matched keys, keys of one side only, and the matched share."""
    j = a.select(*keys).distinct().withColumn("__a", F.lit(1)).join(b.select(*keys).distinct().withColumn("__b", F.lit(1)), keys, "full")
    both, left, right = (F.count_if(x) for x in (F.col("__a").isNotNull() & F.col("__b").isNotNull(), F.col("__b").isNull(), F.col("__a").isNull()))
    return j.agg(both.alias("matched"), left.alias("only_left"), right.alias("only_right")).withColumn("rate", F.try_divide(F.col("matched").cast("double"), F.col("matched") + F.col("only_left") + F.col("only_right")))


def full_merge(frames: list[DataFrame], key: str) -> DataFrame:
    """All frames by one key, none left out."""
    return reduce(lambda x, y: x.join(y, key, "full"), frames)
