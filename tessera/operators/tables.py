"""Small table operators: unions of unlike columns, last of equal keys, intersections, fills, replacement, monthly returns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..functions.base import grown


def _widest(kinds: list[T.DataType]) -> T.DataType:
    """One type that holds all: the same, the wider number, or text."""
    if len({k.simpleString() for k in kinds}) == 1:
        return kinds[0]
    if all(isinstance(k, T.NumericType) for k in kinds):
        return T.LongType() if all(isinstance(k, T.IntegralType) for k in kinds) else T.DoubleType()
    return T.TimestampType() if all(isinstance(k, (T.DateType, T.TimestampType)) for k in kinds) else T.StringType()


def union_relaxed(frames: list[DataFrame]) -> DataFrame:
    """All rows by column name; a column that a frame lacks is null there, unlike types meet in one that holds both."""
    kinds: dict[str, list[T.DataType]] = {}
    for f in frames:
        for c in f.schema.fields:
            kinds.setdefault(c.name, []).append(c.dataType)
    whole = {c: _widest(k) for c, k in kinds.items()}
    cast = [f.select(*[F.col(c).cast(whole[c]).alias(c) for c in f.columns]) for f in frames]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), cast)


def keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of equal keys the row that comes last by ``order`` (null first); a hash aggregate."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__x")).select(*keys, "__x.*").select(*df.columns)


def present(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose key is in ``keys``."""
    return df.join(keys.select(*on), on, "left_semi")


def common(tables: list[DataFrame], on: list[str]) -> DataFrame:
    """Keys that all tables have, each once."""
    return reduce(lambda a, b: a.intersect(b), [t.select(*on) for t in tables])


def filled(df: DataFrame, columns: list[str], *, by: str = "symbol", order: str = "trade_date", backward: bool = False, most: int | None = None) -> DataFrame:
    """Nulls take the last value before them (or the next one after), at most ``most`` rows away."""
    w = W.partitionBy(by).orderBy(order)
    span = w.rowsBetween(0, most if most is not None else W.unboundedFollowing) if backward else w.rowsBetween(-most if most is not None else W.unboundedPreceding, 0)
    pick = F.first if backward else F.last
    return df.withColumns({c: pick(c, ignorenulls=True).over(span) for c in columns})


def replaced(x, mapping: dict, default=None, *, strict: bool = False) -> Column:
    """x through a table of values: unlisted ones become ``default``, or an error if ``strict``; null stays null."""
    x = F.col(x) if isinstance(x, str) else x
    got = F.create_map(*[F.lit(v) for pair in mapping.items() for v in pair])[x]
    other = F.raise_error(F.concat(F.lit("no value for "), x.cast("string"))) if strict else F.lit(default)
    return F.when(x.isNull(), None).otherwise(F.coalesce(got, other))


def json_where(df: DataFrame, column: str, path: str, value: str) -> DataFrame:
    """Rows whose JSON column has the text ``value`` at the path."""
    return df.where(F.get_json_object(column, path) == F.lit(value))


def monthly_returns(returns: DataFrame, *keys: str) -> DataFrame:
    """(keys, year, month, ret): returns compounded by calendar month; null returns count as none."""
    d = returns.where("ret IS NOT NULL")
    return d.groupBy(*keys, F.year("trade_date").alias("year"), F.month("trade_date").alias("month")).agg((grown("ret") - 1).alias("ret"))


def trade_turnover(trades: DataFrame, nav: DataFrame, key: str) -> DataFrame:
    """(key, n_trades, total_amount, turnover): absolute amounts by mean net value and number of dates; null without a net value."""
    a = trades.groupBy(key).agg(F.count("*").alias("n_trades"), F.sum(F.abs(F.col("amount").cast("double"))).alias("total_amount"))
    b = nav.groupBy(key).agg(F.avg("nav").alias("__nav"), F.count_distinct("trade_date").alias("__days"))
    return a.join(b, key, "left").select(key, "n_trades", "total_amount", F.try_divide(F.try_divide("total_amount", F.when(F.col("__nav") > 0, F.col("__nav"))), F.col("__days").cast("double")).alias("turnover"))


def wide_returns(returns: DataFrame, symbols: list[str]) -> DataFrame:
    """A row per date, a column per one of the named symbols: conditional aggregates, one shuffle."""
    return returns.groupBy("trade_date").agg(*[F.max(F.when(F.col("symbol") == s, F.col("ret"))).alias(s) for s in symbols])
