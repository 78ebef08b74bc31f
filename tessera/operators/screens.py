"""Rules on each symbol's newest bar: volume surge, rising closes, pull-back, breakout, low range; all from one window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.base import KEY, ts


def screen(bars: DataFrame, *, vol_ratio: float = 2.0, min_amount: float = 2e8, min_pct: float = 0.0, days: int = 4, mean: int = 250, band: float = 0.03, breakout: int = 20, atr: int = 14, max_atr_pct: float = 2.5) -> DataFrame:
    """(symbol, trade_date, rule, hit, value, reason) of every rule for the newest bar of every symbol.

    volume_surge: up on the day and over the close before, by ``min_pct`` per cent or more, with ``vol_ratio`` times the
    mean volume of the five bars before and an amount of ``min_amount`` (value: the ratio). keep_rising: ``days`` closes in
    a row each over the one before (value: the change over them in per cent). pullback: at most ``band`` above the mean of
    ``mean`` closes and not below (value: the distance). breakout: a close over the highest high of the ``breakout`` bars
    before (value: that high). low_atr: a mean true range of ``atr`` bars of at most ``max_atr_pct`` per cent of the close
    (value: the per cent). Where there are too few bars, or a needed value is missing, a rule doesn't hit and says so.
    """
    if min(days, mean, breakout, atr) < 1:
        raise ValueError("windows are of one bar or more")
    back = lambda n: ts().rowsBetween(-n, -1)
    before = F.lag("close").over(ts())
    pre = F.coalesce("pre_close", before) if "pre_close" in bars.columns else before
    tr = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))
    d = bars.withColumns({"__pre": pre, "__tr": F.when(before.isNotNull(), tr), "__up": F.col("close") > before, "__n": F.row_number().over(ts())})
    d = d.withColumns(
        {
            "__v5": F.avg("volume").over(back(5)),
            "__ups": F.count_if(F.col("__up")).over(ts().rowsBetween(-(days - 1), 0)),
            "__first": F.lag("close", days).over(ts()),
            "__mean": F.avg("close").over(ts(mean)),
            "__top": F.max("high").over(back(breakout)),
            "__atr": F.avg("__tr").over(ts(atr)),
            "__last": F.row_number().over(W.partitionBy(KEY).orderBy(F.desc("trade_date"))),
        }
    ).where("__last = 1")
    close, n = F.col("close"), F.col("__n")
    amount = F.coalesce(F.col("amount").cast("double"), close * F.col("volume"))
    pct = (F.try_divide(close, "__pre") - 1) * 100
    ratio = F.try_divide("volume", "__v5")
    dev, share = F.try_divide(close, "__mean") - 1, F.try_divide("__atr", "close") * 100

    def rule(name: str, bars_needed: int, value, *no) -> F.Column:
        """no: (condition, reason), the first that holds tells why there is no hit."""
        why = F.when(n < bars_needed, "too few bars").when(value.isNull(), "a value is missing")
        for when, text in no:
            why = why.when(F.coalesce(when, F.lit(True)), text)
        return F.struct(F.lit(name).alias("rule"), why.isNull().alias("hit"), value.cast("double").alias("value"), why.alias("reason"))

    rules = [
        rule("volume_surge", 6, ratio, (pct.isNull(), "no close before"), ((close <= F.col("open")) | (close <= F.col("__pre")), "not up"), (pct < min_pct, "rose too little"), (ratio < vol_ratio, "too little volume"), (amount < min_amount, "too small an amount")),
        rule("keep_rising", days + 1, (F.try_divide(close, "__first") - 1) * 100, (F.col("__ups") < days, "a close did not rise")),
        rule("pullback", mean, dev, (dev < 0, "below the mean"), (dev > band, "too far above the mean")),
        rule("breakout", breakout + 1, F.col("__top"), (close <= F.col("__top"), "not over the high")),
        rule("low_atr", atr + 1, share, (share > max_atr_pct, "ranges are too wide")),
    ]
    return d.select("symbol", "trade_date", F.explode(F.array(*rules)).alias("r")).select("symbol", "trade_date", "r.*")


def all_of(screened: DataFrame, rules: list[str]) -> DataFrame:
    """(symbol, trade_date) where every one of the rules hits."""
    d = screened.where(F.col("rule").isin(rules) & F.col("hit")).groupBy("symbol", "trade_date").agg(F.count_distinct("rule").alias("n"))
    return d.where(F.col("n") == len(set(rules))).drop("n")
