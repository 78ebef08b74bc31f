"""Element-wise maths and logic. Logic yields 0.0 or 1.0; a value counts as true above zero; nulls as in SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .base import col


def el_abs(x) -> Column:
    return F.abs(col(x))


def el_sign(x) -> Column:
    return F.signum(col(x))


def el_log1p(x) -> Column:
    return F.when(col(x) > -1, F.log1p(col(x)))


def el_log(x) -> Column:
    return F.when(col(x) > 0, F.log(col(x)))


def el_sqrt(x) -> Column:
    return F.when(col(x) >= 0, F.sqrt(col(x)))


def el_power(x, p: float) -> Column:
    return F.pow(col(x), F.lit(float(p)))


def el_signed_power(x, p: float) -> Column:
    return F.signum(col(x)) * F.pow(F.abs(col(x)), F.lit(float(p)))


def el_greater(a, b) -> Column:
    return F.greatest(col(a), col(b))


def el_less(a, b) -> Column:
    return F.least(col(a), col(b))


def el_if(c, a, b) -> Column:
    return F.when(col(c) > 0, col(a)).otherwise(col(b))


def _bit(x: Column) -> Column:
    return x.cast("double")


def bool_not(x) -> Column:
    return _bit(~(col(x) > 0))


def bool_and(a, b) -> Column:
    return _bit((col(a) > 0) & (col(b) > 0))


def bool_or(a, b) -> Column:
    return _bit((col(a) > 0) | (col(b) > 0))


def bool_eq(a, b) -> Column:
    return _bit(col(a) == col(b))


def bool_ne(a, b) -> Column:
    return _bit(col(a) != col(b))


def bool_ge(a, b) -> Column:
    return _bit(col(a) >= col(b))


def bool_le(a, b) -> Column:
    return _bit(col(a) <= col(b))


def gt(a, b) -> Column:
    return _bit(col(a) > col(b))


def lt(a, b) -> Column:
    return _bit(col(a) < col(b))
