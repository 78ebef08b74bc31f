"""Where holders bought: costs of the shares afloat by symbol, from turnover alone.

A day's turnover t puts t of the shares at the day's price, and leaves 1 - t of what was there before. So a day's weight
at the end is its t times the product of 1 - t of all later days: one running product from the newest day back.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.base import KEY, fin, running, ts

#: Days of mean volume that count as one full turnover where nothing better is known.
PROXY = 20


def price() -> Column:
    """A day's price: high, low and twice the close."""
    return (F.col("high") + F.col("low") + 2 * F.col("close")) / 4


def turnover(df: DataFrame, float_shares: float | str | None = None) -> DataFrame:
    """``df`` with t (share of the float that changed hands, 0 to 1) and caliber (what it was made of).

    A positive number of shares or a column of them (carried forward; rows before the first value fall back) is
    ``explicit``; else turnover_rate in percent, for a symbol that has any; else ``proxy``, volume by PROXY times the mean of
    the PROXY days before (the first day with volume is a full turnover). No volume, or a rate that is missing or not
    positive, is no turnover.
    """
    volume = fin(F.col("volume").cast("double"))
    moved = F.when(volume > 0, volume)
    share = lambda shares: F.when(moved.isNull(), 0.0).otherwise(F.least(moved / shares, F.lit(1.0)))
    if isinstance(float_shares, (int, float)) and not isinstance(float_shares, bool):
        if not 0 < float_shares < float("inf"):
            raise ValueError(f"shares afloat are a positive number, not {float_shares}")
        return df.withColumns({"t": share(F.lit(float(float_shares))), "caliber": F.lit("explicit")})
    before = F.avg(volume).over(ts().rowsBetween(-PROXY, -1))
    t = F.when(moved.isNull(), 0.0).when(F.coalesce(before, F.lit(0.0)) <= 0, 1.0).otherwise(F.least(moved / (PROXY * before), F.lit(1.0)))
    caliber = F.lit("proxy")
    if "turnover_rate" in df.columns:
        rate = fin(F.col("turnover_rate").cast("double"))
        known = F.max(F.col("turnover_rate").isNotNull()).over(W.partitionBy(KEY))
        t = F.when(known, F.coalesce(F.when(rate > 0, F.least(rate / 100, F.lit(1.0))), F.lit(0.0))).otherwise(t)
        caliber = F.when(known, "turnover_rate").otherwise(caliber)
    if float_shares is not None:
        held = fin(F.col(float_shares).cast("double"))
        last = F.last(F.when(held > 0, held), ignorenulls=True).over(running())
        any_ = F.max(held > 0).over(W.partitionBy(KEY))
        return df.withColumns({"__t": t, "__c": caliber, "__l": last, "__a": any_}).withColumns({"t": F.when(F.col("__l").isNotNull(), share(F.col("__l"))).otherwise(F.col("__t")), "caliber": F.when(F.coalesce("__a", F.lit(False)), "explicit").otherwise(F.col("__c"))}).drop("__t", "__c", "__l", "__a")
    return df.withColumns({"t": t, "caliber": caliber})


def weighted(df: DataFrame, float_shares: float | str | None = None) -> DataFrame:
    """``df`` with p (the day's price, null where one is missing), t, caliber and w, what is left of the day's shares at the end."""
    later = W.partitionBy(KEY).orderBy(F.desc("trade_date")).rowsBetween(W.unboundedPreceding, -1)
    d = turnover(df, float_shares).withColumn("p", fin(price()))
    return d.withColumn("w", F.col("t") * F.coalesce(F.product(1 - F.col("t")).over(later), F.lit(1.0)))


def cost_distribution(df: DataFrame, bins: int = 60, float_shares: float | str | None = None) -> DataFrame:
    """(symbol, bin, price, share): shares afloat by the price they were bought at, bins between the symbol's lowest and highest price.

    ``price`` is the middle of a bin; empty bins are left out, the shares of a symbol sum to 1. Days without a price put
    nothing anywhere, though what was there moves on. Linear in the rows: one running product, one aggregation.
    """
    lo, hi = F.min("low").over(W.partitionBy(KEY)), F.max("high").over(W.partitionBy(KEY))
    d = weighted(df, float_shares).withColumns({"__lo": lo, "__hi": hi}).where("p IS NOT NULL AND w > 0")
    width = (F.when(F.col("__hi") <= F.col("__lo"), F.col("__lo") + 1e-9).otherwise(F.col("__hi")) - F.col("__lo")) / bins
    d = d.withColumn("__width", width).withColumn("bin", F.least(F.floor((F.col("p") - F.col("__lo")) / F.col("__width")), F.lit(bins - 1)).cast("int"))
    sums = d.groupBy("symbol", "bin").agg(F.sum("w").alias("__w"), F.first(F.col("__lo")).alias("__lo"), F.first("__width").alias("__width"))
    share = F.col("__w") / F.sum("__w").over(W.partitionBy(KEY))
    return sums.select("symbol", "bin", (F.col("__lo") + (F.col("bin") + 0.5) * F.col("__width")).alias("price"), share.alias("share"))


def profit_ratio(df: DataFrame, float_shares: float | str | None = None) -> DataFrame:
    """(symbol, profit_ratio, caliber): share of the float bought below the last close; null where nothing is known."""
    d = weighted(df, float_shares)
    last = F.max_by("close", "trade_date")
    best = d.groupBy("symbol").agg(last.alias("__c"))
    d = d.join(best, "symbol")
    held = F.when(F.col("p").isNotNull(), F.col("w"))
    total = F.sum(held)
    return d.groupBy("symbol").agg(F.when(F.first("__c").isNotNull() & (total > 0), F.sum(F.when(F.col("p") < F.col("__c"), held).otherwise(F.lit(0.0))) / total).alias("profit_ratio"), F.max("caliber").alias("caliber"))


class _Sums:
    """Sums of weights by the rank of their price, as they come in (a binary indexed tree)."""

    def __init__(self, n: int):
        self.tree = [0.0] * (n + 1)

    def add(self, at: int, w: float) -> None:
        at += 1
        while at < len(self.tree):
            self.tree[at] += w
            at += at & -at

    def below(self, at: int) -> float:
        out = 0.0
        while at:
            out += self.tree[at]
            at -= at & -at
        return out


def _ratios(p: list, c: list, t: list) -> list:
    """For each day the share of weights whose price is below its close; n log n for n days.

    Weights are kept relative to the product of 1 - t so far, so that a day changes only its own; a full turnover, or a
    product near the smallest number, starts afresh with what is left.
    """
    known = sorted({x for x in p if x is not None})
    place = {x: k for k, x in enumerate(known)}
    from bisect import bisect_left

    sums, by, total, out, held = _Sums(len(known)), 1.0, 0.0, [], []
    for x, close, own in zip(p, c, t, strict=True):
        by *= 1 - own
        if by < 1e-100:
            left = [(k, w * by) for k, w in held if w * by > 0]
            sums, by, total, held = _Sums(len(known)), 1.0, 0.0, []
            for k, w in left:
                sums.add(k, w)
                total += w
                held.append((k, w))
        if x is None or close is None:
            out.append(None)
            continue
        if own > 0:
            sums.add(place[x], own / by)
            total += own / by
            held.append((place[x], own / by))
        out.append(sums.below(bisect_left(known, close)) / total if total > 0 else None)
    return out


def rolling_profit_ratio(df: DataFrame, float_shares: float | str | None = None) -> DataFrame:
    """``symbol, trade_date, cyq_profit_ratio``: profit_ratio as of each day, by that day's close; a symbol's history is one group."""
    d = turnover(df, float_shares).select("symbol", "trade_date", fin(price()).alias("p"), fin("close").alias("c"), "t")
    kinds = dict(d.dtypes)

    def each(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("trade_date", ignore_index=True)
        none = lambda s: [None if pd.isna(v) else float(v) for v in s]
        got = _ratios(none(pdf["p"]), none(pdf["c"]), pdf["t"].astype(float).tolist())
        return pd.DataFrame({"symbol": pdf["symbol"], "trade_date": pdf["trade_date"], "cyq_profit_ratio": pd.array(got, "Float64")})

    return d.groupBy("symbol").applyInPandas(each, f"symbol {kinds['symbol']}, trade_date {kinds['trade_date']}, cyq_profit_ratio double")
