"""Windows and guards that all column operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import Window as W

KEY, TIME = "symbol", "trade_date"


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ts(n: int | None = None):
    """A symbol's rows by time; with n the last n of them."""
    w = W.partitionBy(KEY).orderBy(TIME)
    return w if n is None else w.rowsBetween(-(n - 1), 0)


def running():
    return W.partitionBy(KEY).orderBy(TIME).rowsBetween(W.unboundedPreceding, 0)


def cs(*more):
    """All rows of a date."""
    return W.partitionBy(TIME, *more)


def fin(x) -> Column:
    """x where it is a finite number, else null."""
    x = col(x)
    return F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")), x)


def full(x, n: int, value: Column) -> Column:
    """``value`` only where the last n rows all have x."""
    return F.when(F.count(col(x)).over(ts(n)) == n, value)


def grown(x) -> Column:
    """The aggregate product of 1 + x: what compounding the returns x makes of one; a total loss makes it zero for good."""
    return F.product(1 + col(x))


def div(a, b) -> Column:
    """a / b; null where b is zero."""
    return F.try_divide(col(a), col(b))


def corr_over(x, y, w) -> Column:
    """Pearson correlation over a window; null where either side is flat."""
    x, y = col(x), col(y)
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    sx, sy = F.stddev_samp(x).over(w), F.stddev_samp(y).over(w)
    return F.when((sx > 1e-12) & (sy > 1e-12), F.try_divide(F.covar_samp(x, y).over(w), sx * sy))


def corr_of(x, y) -> Column:
    """Pearson correlation as a grouped aggregate; null where either side is flat."""
    x, y = col(x), col(y)
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    sx, sy = F.stddev_samp(x), F.stddev_samp(y)
    return F.when((sx > 1e-12) & (sy > 1e-12), F.try_divide(F.covar_samp(x, y), sx * sy))


def fold(x, start, step, finish=None, *, w=None) -> Column:
    """A recurrence along a symbol's rows: the state after the current row.

    Folds the running list of x, so use it where a key's history is of hundreds of rows; longer ones: operators.recur.
    """
    seen = F.collect_list(col(x)).over(w if w is not None else running())
    return F.aggregate(seen, start, step, finish) if finish is not None else F.aggregate(seen, start, step)
