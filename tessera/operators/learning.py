"""Learning tables: labels, chronological and purged splits, scaling fitted on the training rows only, ridge regression."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.base import div, fin, ts


def labelled(panel: DataFrame, features: list[str], *, horizon: int = 5, entry_lag: int = 1, blocked: str | None = None, clip: float = 0.5, least: int = 5) -> DataFrame:
    """Rows with a label: the return from ``entry_lag`` rows ahead over ``horizon`` rows, clipped.

    Rows that can't be traded at entry, or that lack a feature, go; so do dates with fewer than ``least`` rows left.
    """
    start, stop = F.lead("close", entry_lag).over(ts()), F.lead("close", entry_lag + horizon).over(ts())
    d = panel.withColumn("label", div(stop, start) - 1)
    if blocked:
        d = d.withColumn("label", F.when(~F.coalesce(F.lead(blocked, entry_lag).over(ts()), F.lit(True)), F.col("label")))
    d = d.withColumn("label", F.when(F.col("label").isNotNull(), F.least(F.greatest("label", F.lit(-clip)), F.lit(clip))))
    d = d.where(reduce(lambda a, b: a & b, [fin(x).isNotNull() for x in (*features, "label")]))
    return d.withColumn("__n", F.count("*").over(W.partitionBy("trade_date"))).where(F.col("__n") >= least).drop("__n")


def date_index(df: DataFrame) -> DataFrame:
    """Dates with their place from 0; one row a date, so one task orders them."""
    return df.select("trade_date").distinct().withColumn("k", F.row_number().over(W.orderBy("trade_date")) - 1).withColumn("n", F.count("*").over(W.partitionBy()))


def split(df: DataFrame, *, train: float = 0.7, valid: float = 0.15, purge: int = 0, embargo: int = 0) -> DataFrame:
    """Chronological parts by date; ``purge`` dates before the start of the next part belong to none, nor ``embargo`` dates from there on."""
    d = date_index(df)
    a, b = F.floor(F.col("n") * train), F.floor(F.col("n") * (train + valid))
    part = F.when(F.col("k") < a - purge, "train").when((F.col("k") >= a + embargo) & (F.col("k") < b - purge), "valid").when(F.col("k") >= b + embargo, "test")
    return d.select("trade_date", part.alias("part")).where("part IS NOT NULL")


def purged_kfold(df: DataFrame, folds: int, *, purge: int = 0, embargo: int = 0) -> DataFrame:
    """(fold, trade_date, part): each block of dates tests once; training leaves out ``purge`` dates before and ``embargo`` after it."""
    d = date_index(df).withColumn("block", F.floor(F.col("k") * folds / F.col("n")))
    edges = d.groupBy("block").agg(F.min("k").alias("a"), F.max("k").alias("z")).withColumnRenamed("block", "fold")
    j = d.crossJoin(F.broadcast(edges))
    part = F.when(F.col("block") == F.col("fold"), "test").when((F.col("k") < F.col("a") - purge) | (F.col("k") > F.col("z") + embargo), "train")
    return j.select("fold", "trade_date", part.alias("part")).where("part IS NOT NULL")


def combinatorial(df: DataFrame, folds: int, tests: int) -> DataFrame:
    """(split, trade_date, part) for every choice of ``tests`` blocks out of ``folds``."""
    d = date_index(df).withColumn("block", F.floor(F.col("k") * folds / F.col("n")).cast("int"))
    chosen = list(combinations(range(folds), tests))
    rows = F.explode(F.array(*[F.struct(F.lit(i).alias("split"), F.col("block").isin(*c).alias("hit")) for i, c in enumerate(chosen)]))
    return d.select("trade_date", rows.alias("x")).select("x.split", "trade_date", F.when(F.col("x.hit"), "test").otherwise("train").alias("part"))


def standardised(df: DataFrame, features: list[str], fitted_on: DataFrame) -> DataFrame:
    """Features less mean by deviation of the training rows, which alone are read for it."""
    stats = fitted_on.agg(*[x for f in features for x in (F.avg(f).alias(f"__m_{f}"), F.stddev_samp(f).alias(f"__s_{f}"))])
    d = df.crossJoin(F.broadcast(stats))
    done = {f: F.when(F.col(f"__s_{f}") > 1e-12, (F.col(f) - F.col(f"__m_{f}")) / F.col(f"__s_{f}")).otherwise(F.lit(0.0)) for f in features}
    return d.withColumns(done).drop(*[c for c in d.columns if c.startswith(("__m_", "__s_"))])


def ridge_predictions(train: DataFrame, rows: DataFrame, features: list[str], *, lam: float = 1.0) -> DataFrame:
    """Rows that have all features, with the prediction of a ridge regression fitted on ``train``.

    Least squares plus ``lam`` times the squared weights, the intercept free: closed form from the cross products, which
    one aggregation sums up; the driver solves a system of as many rows as there are features.
    """
    import numpy as np

    usable = reduce(lambda a, b: a & b, [fin(x).isNotNull() for x in features])
    names = [*features, "label"]
    products = [F.covar_pop(a, b) * F.count("*") for i, a in enumerate(names) for b in names[i:]]
    got = train.where(usable & fin("label").isNotNull()).agg(*[F.avg(x) for x in names], *products).first()
    means, p = np.array([x or 0.0 for x in got[: len(names)]]), len(features)
    cross = np.zeros((p + 1, p + 1))
    cross[np.triu_indices(p + 1)] = [x or 0.0 for x in got[len(names) :]]
    cross = np.triu(cross) + np.triu(cross, 1).T
    w = np.linalg.lstsq(cross[:p, :p] + lam * np.eye(p), cross[:p, p], rcond=None)[0]
    linear = sum((F.col(x) * float(v) for x, v in zip(features, w, strict=True)), F.lit(float(means[p] - w @ means[:p])))
    return rows.where(usable).withColumn("prediction", linear)
