"""Walk-forward learning: windows over the calendar, all of them fitted in one pass, versions and their signals.

A day's cross products are a row of sums; prefix sums over the days make any window's sums the difference of two rows. So
however many windows there are, and however they overlap, the panel is read once to fit them all.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.base import fin
from ..sources.shared import kept
from . import evaluate, learning


def windows(df: DataFrame, *, train: int = 24, valid: int = 6, test: int = 6, step: int = 6, purge: int = 0, embargo: int = 0) -> DataFrame:
    """(window, part, first, last, k_first, k_last): closed spans of dates, and of their places in the calendar, from 0.

    Lengths are in months from the first date; a window starts every ``step`` months while its test part ends within the
    dates. A part ends with the last date up to its bound, and the next one starts after it. ``purge`` dates at the end
    of train and valid, whose labels reach over the bound, and ``embargo`` dates at the start of valid and test belong to
    no part. A part that this empties is an error.
    """
    if min(purge, embargo) < 0 or min(train, valid, test, step) < 1:
        raise ValueError("months are positive, purge and embargo not negative")
    days = learning.date_index(df).select("trade_date", "k")
    ends = days.agg(F.min("trade_date").alias("a"), F.max("trade_date").alias("z")).head()
    if ends["a"] is None:
        raise ValueError("no dates")
    count = 0
    add = lambda n: pd.Timestamp(ends["a"]) + pd.DateOffset(months=n)
    while add(count * step + train + valid + test) <= pd.Timestamp(ends["z"]):
        count += 1
    if not count:
        raise ValueError(f"{ends['a']} to {ends['z']} hold no window of {train + valid + test} months")
    start = F.lit(ends["a"])
    at = lambda n: F.add_months(start, F.col("window") * step + n)
    marked = days.withColumn("window", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    d = F.col("trade_date")
    spans = {
        "train": ((d >= at(0)) & (d <= at(train)), 0, purge),
        "valid": ((d > at(train)) & (d <= at(train + valid)), embargo, purge),
        "test": ((d > at(train + valid)) & (d <= at(train + valid + test)), embargo, 0),
    }
    sums = [x for name, (hit, head, tail) in spans.items() for x in ((F.min(F.when(hit, F.col("k"))) + head).alias(f"{name}_a"), (F.max(F.when(hit, F.col("k"))) - tail).alias(f"{name}_z"))]
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("part"), F.col(f"{n}_a").alias("k_first"), F.col(f"{n}_z").alias("k_last")) for n in spans]))
    out = marked.groupBy("window").agg(*sums).select("window", each.alias("s")).select("window", "s.*")
    if not out.where("k_first IS NULL OR k_last IS NULL OR k_first > k_last").isEmpty():
        raise ValueError(f"purge {purge} and embargo {embargo} leave a part without dates")
    named = lambda k, date: days.select(F.col("k").alias(k), F.col("trade_date").alias(date))
    return out.join(named("k_first", "first"), "k_first").join(named("k_last", "last"), "k_last").select("window", "part", "first", "last", "k_first", "k_last")


def _usable(rows: DataFrame, names: list[str]) -> DataFrame:
    return rows.where(reduce(lambda a, b: a & b, [fin(x).isNotNull() for x in names]))


def fits(rows: DataFrame, features: list[str], spans: DataFrame, *, lam: float = 1.0, part: str = "train") -> DataFrame:
    """(window, train_rows, weights, intercept): a ridge regression of ``label`` per window, on features scaled by its own rows.

    Features are taken less their mean, by their deviation in the window (flat ones weigh nothing); ``lam`` times the
    squared weights is the penalty, the intercept is free. Weights and intercept come back in the features' own units.
    """
    names = [*features, "label"]
    p = len(features)
    ok = _usable(rows, names)
    # sums around the means of all rows keep digits
    centre = ok.agg(*[F.avg(x).alias(x) for x in names]).head()
    value = {x: F.col(x) - float(centre[x] or 0.0) for x in names}
    pairs = [(i, j) for i in range(p + 1) for j in range(i, p + 1)]
    sums = {"n": F.count("*").cast("double")} | {f"s{i}": F.sum(value[x]) for i, x in enumerate(names)} | {f"c{i}_{j}": F.sum(value[names[i]] * value[names[j]]) for i, j in pairs}
    # days of the calendar without a usable row count for nothing
    daily = learning.date_index(rows).select("trade_date", "k").join(ok.groupBy("trade_date").agg(*[v.alias(c) for c, v in sums.items()]), "trade_date", "left")
    upto = W.orderBy("k").rowsBetween(W.unboundedPreceding, 0)
    prefix = daily.select("k", *[F.coalesce(F.sum(c).over(upto), F.lit(0.0)).alias(c) for c in sums])
    chosen = spans.where(F.col("part") == part).select("window", "k_first", "k_last")
    last = prefix.select(F.col("k").alias("k_last"), *[F.col(c).alias(f"z_{c}") for c in sums])
    before = prefix.select((F.col("k") + 1).alias("k_first"), *[F.col(c).alias(f"a_{c}") for c in sums])
    whole = chosen.join(last, "k_last").join(before, "k_first", "left").select("window", *[(F.col(f"z_{c}") - F.coalesce(F.col(f"a_{c}"), F.lit(0.0))).alias(c) for c in sums])
    shift = np.array([float(centre[x] or 0.0) for x in names])

    def solved(batches):
        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                n, cross = r["n"], np.zeros((p + 1, p + 1))
                mean = np.array([r[f"s{i}"] for i in range(p + 1)]) / max(n, 1)
                for i, j in pairs:
                    cross[i, j] = cross[j, i] = r[f"c{i}_{j}"] - n * mean[i] * mean[j]
                sd = np.sqrt(np.maximum(np.diag(cross)[:p], 0) / max(n - 1, 1))
                by = np.where(sd > 1e-12, 1 / np.where(sd > 1e-12, sd, 1), 0)
                w = np.linalg.lstsq(cross[:p, :p] * np.outer(by, by) + lam * np.eye(p), cross[:p, p] * by, rcond=None)[0] * by
                mean = mean + shift
                out.append((r["window"], int(n), w.tolist(), float(mean[p] - w @ mean[:p])))
            yield pd.DataFrame(out, columns=["window", "train_rows", "weights", "intercept"])

    return whole.mapInPandas(solved, "window int, train_rows long, weights array<double>, intercept double")


def predictions(rows: DataFrame, features: list[str], spans: DataFrame, models: DataFrame, *, part: str = "test") -> DataFrame:
    """(window, symbol, trade_date, label, prediction) of every usable row in each window's part."""
    days = learning.date_index(rows).select("trade_date", "k")
    of = spans.where(F.col("part") == part).select("window", F.explode(F.sequence("k_first", "k_last")).alias("k")).join(days, "k")
    made = reduce(lambda a, b: a + b, [F.col("weights")[i] * F.col(x) for i, x in enumerate(features)], F.col("intercept"))
    return _usable(rows, features).join(of.join(models, "window"), "trade_date").select("window", "symbol", "trade_date", "label", made.alias("prediction"))


def versions(models: DataFrame, predicted: DataFrame, *, least: int = 5, improvement: float = 0.0) -> DataFrame:
    """``models`` with test_rows, metric (mean daily correlation of prediction and label) and promoted, by window.

    In the order of windows a version is promoted if its metric is known and reaches that of the version in production
    plus ``improvement``, or if there is none in production.
    """
    ic = evaluate.ic_series(predicted, "prediction", "label", least, by=("window",)).groupBy("window").agg(F.avg("ic").alias("metric"))
    d = models.join(predicted.groupBy("window").agg(F.count("*").alias("test_rows")), "window", "left").join(ic, "window", "left")
    # one row a window, so the list is short
    seen = F.collect_list(F.struct("metric")).over(W.orderBy("window").rowsBetween(W.unboundedPreceding, -1))
    standing = F.aggregate(seen, F.lit(None).cast("double"), lambda top, m: F.when(m["metric"].isNotNull() & (top.isNull() | (m["metric"] >= top + improvement)), m["metric"]).otherwise(top))
    top = standing
    promoted = F.col("metric").isNotNull() & (top.isNull() | (F.col("metric") >= top + improvement))
    return d.withColumns({"test_rows": F.coalesce("test_rows", F.lit(0).cast("long")), "promoted": promoted})


def retrain(rows: DataFrame, features: list[str], *, horizon: int, lam: float = 1.0, improvement: float = 0.0, embargo: int = 1, **months) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(spans, versions, predictions): fit, test and promote all windows; the label's horizon is purged."""
    spans = kept(windows(rows, purge=horizon, embargo=embargo, **months), "spans")
    models = kept(fits(rows, features, spans, lam=lam), "models")
    predicted = predictions(rows, features, spans, models)
    return spans, versions(models, predicted, improvement=improvement), predicted


def signals(rows: DataFrame, features: list[str], spans: DataFrame, made: DataFrame) -> DataFrame:
    """(symbol, trade_date, signal, version): each row by the newest promoted version whose test part has begun by its date.

    Rows before the first one get none. An as-of join on the date: a version's first date is carried down the calendar.
    """
    begun = spans.where("part = 'test'").select("window", F.col("first").alias("trade_date")).join(made.where("promoted").select("window", "weights", "intercept"), "window")
    days = rows.select("trade_date").distinct().join(begun.groupBy("trade_date").agg(F.max("window").alias("window")), "trade_date", "left")
    live = days.select("trade_date", F.max("window").over(W.orderBy("trade_date").rowsBetween(W.unboundedPreceding, 0)).alias("window")).where("window IS NOT NULL")
    value = reduce(lambda a, b: a + b, [F.col("weights")[i] * F.col(x) for i, x in enumerate(features)], F.col("intercept"))
    return _usable(rows, features).join(live.join(made.select("window", "weights", "intercept"), "window"), "trade_date").select("symbol", "trade_date", value.alias("signal"), F.col("window").alias("version"))


def newest(stored: DataFrame, keys: tuple[str, ...] = ("symbol", "trade_date")) -> DataFrame:
    """One signal a key, that of the highest version; a hash aggregate, no sort."""
    return stored.groupBy(*keys).agg(F.max_by("signal", "version").alias("signal"), F.max("version").alias("version"))


def paths(splits: DataFrame, tests: int) -> DataFrame:
    """(split, trade_date, part, path) for combinatorial splits: each is on one of ``tests`` paths.

    Splits that share their first tested date take turns, so that every path tests each block as often.
    """
    if tests < 1:
        raise ValueError(f"there is at least one path, not {tests}")
    first = splits.groupBy("split").agg(F.min(F.when(F.col("part") == "test", F.col("trade_date"))).alias("first"))
    turn = F.row_number().over(W.partitionBy("first").orderBy("split")) - 1
    return splits.join(first.select("split", (turn % tests).alias("path")), "split")
