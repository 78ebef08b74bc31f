"""Cross-section operators, per date. Non-finite values are null before any statistic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .base import TIME, cs, fin


def rank(x, *groups) -> Column:
    """Average rank from 1 among the finite values."""
    v = fin(x)
    return F.when(v.isNotNull(), F.rank().over(cs(v.isNotNull(), *groups).orderBy(v)) + (F.count(F.lit(1)).over(cs(v, *groups)) - 1) / 2)


def count(x, *groups) -> Column:
    return F.count(fin(x)).over(cs(*groups))


def pct_rank(x, *groups) -> Column:
    """Average rank by the number of finite values."""
    return F.try_divide(rank(x, *groups), count(x, *groups))


def scale(x) -> Column:
    """x by the sum of absolute values (by 1 where that is zero)."""
    total = F.sum(F.abs(fin(x))).over(cs())
    return fin(x) / F.when(total > 1e-12, total).otherwise(F.lit(1.0))


def demean(x, *groups) -> Column:
    return fin(x) - F.avg(fin(x)).over(cs(*groups))


def zscore(x, *groups) -> Column:
    """(x - mean) / sample standard deviation; 0 where that is zero or there is one value."""
    v = fin(x)
    std = F.stddev_samp(v).over(cs(*groups))
    return F.when(v.isNull(), None).when(F.coalesce(std, F.lit(0.0)) <= 1e-12, F.lit(0.0)).otherwise((v - F.avg(v).over(cs(*groups))) / std)


def ordinal(x, *tie) -> Column:
    """Rank from 1 without ties: equals are ordered by symbol."""
    v = fin(x)
    return F.when(v.isNotNull(), F.row_number().over(cs(v.isNotNull()).orderBy(v, *(tie or ("symbol",)))))


def bucket(x, n: int, *groups) -> Column:
    """1 to n by ceil(ordinal rank * n / count)."""
    v = fin(x)
    place = F.row_number().over(cs(v.isNotNull(), *groups).orderBy(v, "symbol"))
    size = F.count(F.lit(1)).over(cs(v.isNotNull(), *groups))
    return F.when(v.isNotNull(), F.ceil(place * n / size).cast("int"))


def zero_bucket(x, n: int) -> Column:
    """Buckets 1 .. n/2 among negative values and n/2+1 .. n among positive ones; zero has none."""
    v, half = fin(x), n // 2
    sign = F.signum(v)
    place = F.row_number().over(cs(sign).orderBy(v, "symbol"))
    size = F.count(F.lit(1)).over(cs(sign))
    q = F.ceil(place * half / size)
    return F.when(sign < 0, q).when(sign > 0, q + half).cast("int")


__all__ = ["TIME", "bucket", "count", "demean", "ordinal", "pct_rank", "rank", "scale", "zero_bucket", "zscore"]
