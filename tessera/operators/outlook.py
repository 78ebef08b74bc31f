"""How outlooks turned out: hit rates and scores by dimension, with total rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What a verdict counts; any other is unverified (fixed values).
CREDIT = {"correct": 1.0, "partial": 0.5, "wrong": 0.0}


def latest(validations: DataFrame, keys: tuple[str, ...] = ("outlook", "item")) -> DataFrame:
    """The newest validation of each item, by ``validated_at`` and, of equal times, the larger verdict."""
    rest = [c for c in validations.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct("validated_at", "verdict"))
    return validations.groupBy(*keys).agg(newest.alias("__x")).select(*keys, "__x.*")


def outlook_stats(validations: DataFrame, *, start=None, end=None, until=None) -> DataFrame:
    """A row per dimension and one for all (``is_total``, null dimension): counts by verdict, weights, score and coverage.

    ``validations``: outlook, item, trade_date, validated_at, dimension, weight, verdict. Only the newest validation of an
    item counts, of those not later than ``until``; outlooks are chosen by their trade_date. score is 100 times the credit
    by the weight judged, coverage the weight judged by all weight. A missing weight or dimension is an error, not a row.
    """
    if start is not None and end is not None and str(start) > str(end):
        raise ValueError(f"{start} is after {end}")
    v = validations
    if start is not None:
        v = v.where(F.col("trade_date") >= F.lit(start).cast("date"))
    if end is not None:
        v = v.where(F.col("trade_date") <= F.lit(end).cast("date"))
    if until is not None:
        v = v.where(F.col("validated_at") <= F.lit(until).cast("timestamp"))
    d = latest(v)
    weight = F.col("weight").cast("double")
    sound = weight.isNotNull() & ~F.isnan(weight) & F.col("dimension").isNotNull()
    weight = F.when(sound, weight).otherwise(F.raise_error(F.lit("a validation lacks its weight or dimension")).cast("double"))
    credit = F.lit(None).cast("double")
    for verdict, worth in CREDIT.items():
        credit = F.when(F.col("verdict") == verdict, F.lit(worth)).otherwise(credit)
    d = d.select("outlook", "dimension", "verdict", weight.alias("w"), credit.alias("credit"))
    judged = F.col("credit").isNotNull()
    jw = F.sum(F.when(judged, F.col("w")).otherwise(F.lit(0.0)))
    of = {x: F.count_if(F.col("verdict") == x).alias(x) for x in CREDIT}
    sets = d.groupingSets([["dimension"], []], "dimension").agg(
        F.grouping("dimension").alias("g"),
        F.count_distinct("outlook").alias("outlooks"),
        F.count("*").alias("items"),
        F.count_if(judged).alias("judged"),
        *of.values(),
        F.count_if(~judged).alias("unverified"),
        jw.alias("judged_weight"),
        F.sum("w").alias("total_weight"),
        F.sum(F.col("credit") * F.col("w")).alias("raw"),
    )
    score = F.try_divide(100 * F.col("raw"), F.when(F.col("judged_weight") != 0, F.col("judged_weight")))
    cover = F.coalesce(F.try_divide("judged_weight", F.when(F.col("total_weight") != 0, F.col("total_weight"))), F.lit(0.0))
    return sets.select("dimension", (F.col("g") == 1).alias("is_total"), "outlooks", "items", "judged", *CREDIT, "unverified", F.coalesce("judged_weight", F.lit(0.0)).alias("judged_weight"), F.coalesce("total_weight", F.lit(0.0)).alias("total_weight"), score.alias("score"), cover.alias("coverage"))
