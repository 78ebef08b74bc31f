"""Time-series operators, per symbol. Windows are full: a short one, or one with a null, gives null (ts_count apart)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .base import col, corr_over, div, full, grown, running, ts


def _at_least_one(n: int) -> int:
    if n < 1:
        raise ValueError(f"a window or shift must be 1 or more, not {n}: less would look ahead")
    return n


def _plain(name):
    def op(x, n: int) -> Column:
        return full(x, _at_least_one(n), getattr(F, name)(col(x)).over(ts(n)))

    op.__name__ = f"ts_{name}"
    op.__doc__ = f"Rolling {name}."
    return op


ts_mean, ts_sum, ts_max, ts_min = _plain("avg"), _plain("sum"), _plain("max"), _plain("min")
ts_std, ts_var = _plain("stddev_samp"), _plain("var_samp")


def ts_count(x, n: int) -> Column:
    """Values in the window; the only operator for which short windows count."""
    return F.count(col(x)).over(ts(_at_least_one(n)))


def ts_delay(x, n: int) -> Column:
    return F.lag(col(x), _at_least_one(n)).over(ts())


def ts_delta(x, n: int) -> Column:
    return col(x) - ts_delay(x, n)


def ts_return(x, n: int) -> Column:
    return div(x, ts_delay(x, n)) - 1


def _both(x, y) -> tuple[Column, Column, Column]:
    both = col(x).isNotNull() & col(y).isNotNull()
    return F.when(both, col(x)), F.when(both, col(y)), F.when(both, F.lit(1))


def ts_corr(x, y, n: int) -> Column:
    """Rolling Pearson correlation; flat windows give null."""
    return full(_both(x, y)[2], n, corr_over(x, y, ts(n)))


def ts_cov(x, y, n: int) -> Column:
    a, b, both = _both(x, y)
    return full(both, n, F.covar_samp(a, b).over(ts(n)))


def ts_regbeta(y, x, n: int) -> Column:
    """Slope of y on x."""
    a, b, both = _both(x, y)
    return full(both, n, F.try_divide(F.covar_pop(a, b).over(ts(n)), F.var_pop(a).over(ts(n))))


def ts_skew(x, n: int) -> Column:
    """Population skewness, n of 3 or more; flat: null."""
    return full(x, n, F.when(F.stddev_samp(col(x)).over(ts(n)) > 1e-12, F.skewness(col(x)).over(ts(n))))


def ts_kurt(x, n: int) -> Column:
    """Excess kurtosis by population moments, n of 4 or more; flat: null."""
    return full(x, n, F.when(F.stddev_samp(col(x)).over(ts(n)) > 1e-12, F.kurtosis(col(x)).over(ts(n))))


def ts_quantile(x, n: int, q: float = 0.8) -> Column:
    """Rolling quantile, linear between neighbours: two places of the window's sorted list, which other quantiles share."""
    values = F.sort_array(F.collect_list(col(x)).over(ts(n)))
    place = q * (_at_least_one(n) - 1)
    low, part = int(place), place - int(place)
    at = lambda k: F.get(values, F.lit(k)).cast("double")
    return full(x, n, at(low) if not part else F.lit(1 - part) * at(low) + F.lit(part) * at(low + 1))


def ts_med(x, n: int) -> Column:
    return ts_quantile(x, n, 0.5)


def _place(x, n: int, of) -> Column:
    return full(x, n, (F.array_position(F.collect_list(col(x)).over(ts(n)), of(col(x)).over(ts(n))) - 1).cast("double"))


def ts_argmax(x, n: int) -> Column:
    """Place of the largest value, 0 the oldest, the first of equals."""
    return _place(x, n, F.max)


def ts_argmin(x, n: int) -> Column:
    return _place(x, n, F.min)


def ts_rank(x, n: int) -> Column:
    """Share of the window at or below the current value."""
    now = col(x)
    return full(x, n, F.size(F.filter(F.collect_list(now).over(ts(n)), lambda v: v <= now)) / F.lit(n))


def ts_prod(x, n: int) -> Column:
    """Compound return."""
    return full(x, n, grown(x).over(ts(n)) - 1)


def ewm(x, alpha: float) -> Column:
    """Exponential mean seeded by the first value, e = alpha * x + (1 - alpha) * e; nulls keep the last mean."""
    start = F.lit(None).cast("double")
    seen = F.collect_list(col(x)).over(running())
    return F.aggregate(seen, start, lambda e, v: F.when(e.isNull(), v).otherwise(F.lit(alpha) * v + F.lit(1 - alpha) * e))


def ts_ema(x, n: int) -> Column:
    """Exponential mean of span n."""
    return ewm(x, 2.0 / (n + 1))


def _time() -> Column:
    return F.row_number().over(ts()).cast("double")


def ts_slope(x, n: int) -> Column:
    """Slope of a line through the window, by place."""
    return full(x, n, F.try_divide(F.covar_pop(_row(x), col(x)).over(ts(n)), F.var_pop(_row(x)).over(ts(n))))


def _row(x) -> Column:
    return F.when(col(x).isNotNull(), F.col("__t"))


def ts_rsquare(x, n: int) -> Column:
    """R squared of that line; flat: null."""
    r = corr_over(_row(x), x, ts(n))
    return full(x, n, r * r)


def ts_resi(x, n: int) -> Column:
    """Root mean square residual of that line."""
    vx, vt = F.var_pop(col(x)).over(ts(n)), F.var_pop(_row(x)).over(ts(n))
    c = F.covar_pop(_row(x), col(x)).over(ts(n))
    return full(x, n, F.sqrt(F.greatest(F.lit(0.0), vx - F.try_divide(c * c, vt))))


def ts_wma(x, n: int) -> Column:
    """Mean with weights 1 to n, the newest heaviest."""
    first = F.col("__t") - n
    return full(x, n, (F.sum(F.col("__t") * col(x)).over(ts(n)) - first * F.sum(col(x)).over(ts(n))) / F.lit(n * (n + 1) / 2))


def with_time(panel):
    """Adds __t, the place of a row among its symbol's, which slope, rsquare, resi and wma read."""
    return panel.withColumn("__t", _time())
