"""Prices adjusted by cumulative factors: to the newest bar of a window, to the first, or for export."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.base import KEY, fin, running

PRICES = ("open", "high", "low", "close")


def adjusted(df: DataFrame, way: str | None, *, strict: bool = False) -> DataFrame:
    """``df`` with its prices adjusted, without adj_factor; ``factor_missing`` marks rows that had no factor of their own.

    ``pre``: by the factor over the symbol's newest one in ``df``; ``post``: by the factor itself; None changes nothing. A
    row without a positive factor takes the one before it; where there is none, its prices stay raw. With ``strict`` a
    row without a factor of its own is an error instead, and so is a table without factors.
    """
    if way is None:
        return df
    if way not in ("pre", "post"):
        raise ValueError(f"prices are adjusted 'pre' or 'post', not {way!r}")
    if "adj_factor" not in df.columns:
        if strict:
            raise ValueError("no adj_factor to adjust by")
        return df.withColumn("factor_missing", F.lit(True))
    own = fin(F.col("adj_factor").cast("double"))
    own = F.when(own > 0, own)
    d = df.withColumns({"__own": own}).withColumn("__f", F.last("__own", ignorenulls=True).over(running()))
    by = F.col("__f")
    if way == "pre":
        newest = F.max_by("__own", F.when(F.col("__own").isNotNull(), F.col("trade_date"))).over(W.partitionBy(KEY))
        by = by / newest
    by = F.coalesce(by, F.lit(1.0))
    missing = F.col("__own").isNull()
    if strict:
        missing = F.when(missing, F.raise_error(F.concat(F.lit("no adj_factor for "), F.col("symbol"), F.lit(" on "), F.col("trade_date").cast("string"))).cast("boolean")).otherwise(False)
        by = F.when(missing, None).otherwise(by)
    return d.withColumns({**{c: F.col(c) * by for c in PRICES if c in df.columns}, "factor_missing": missing}).drop("adj_factor", "__own", "__f")


def for_export(df: DataFrame) -> DataFrame:
    """``df`` with prices adjusted to the newest bar, factor (of which they are multiples) and vwap, without adj_factor.

    A missing factor is the next one after it, and 1 where none follows; vwap is null without volume.
    """
    later = W.partitionBy(KEY).orderBy("trade_date").rowsBetween(0, W.unboundedFollowing)
    d = df.withColumn("__f", F.coalesce(F.first(F.col("adj_factor").cast("double"), ignorenulls=True).over(later), F.lit(1.0)))
    d = d.withColumn("factor", F.col("__f") / F.max_by("__f", "trade_date").over(W.partitionBy(KEY)))
    made = {c: F.col(c) * F.col("factor") for c in PRICES if c in df.columns}
    if {"volume", "amount"} <= set(df.columns):
        made["vwap"] = F.when(F.col("volume") > 0, F.col("amount").cast("double") / F.col("volume") * F.col("factor"))
    return d.withColumns(made).drop("adj_factor", "__f")
