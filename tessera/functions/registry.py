"""Operators by name: the built-in column operators, and the user's own beside them.

A user's operator is a function of columns (it stays in Spark's own expressions), a callback over a window's values, or a
table function that makes rows of a row.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import base, cs, el, ts


@dataclass(frozen=True)
class Operator:
    name: str
    make: Callable[..., Column]
    category: str
    min_window: int = 0
    label: str = ""


OPERATORS: dict[str, Operator] = {}


def operator(name: str, category: str = "EL", *, min_window: int = 0, label: str = "") -> Callable:
    """Register a function of columns and numbers under ``name``; a name that is taken is an error."""

    def put(make: Callable[..., Column]) -> Callable[..., Column]:
        if name in OPERATORS:
            raise ValueError(f"operator {name!r} exists")
        OPERATORS[name] = Operator(name, make, category, min_window, label or name)
        return make

    return put


def forget(name: str) -> None:
    OPERATORS.pop(name, None)


def apply(df: DataFrame, **columns: tuple) -> DataFrame:
    """``df`` with a column for each ``out=(operator, argument, ...)``; a window below the operator's least is an error."""
    made = {}
    for out, (name, *args) in columns.items():
        if name not in OPERATORS:
            raise KeyError(f"no operator {name!r}")
        own = OPERATORS[name]
        windows = [a for a in args if isinstance(a, int) and not isinstance(a, bool)]
        if own.min_window and windows and windows[-1] < own.min_window:
            raise ValueError(f"{name} needs a window of {own.min_window} or more, not {windows[-1]}")
        made[out] = own.make(*args)
    return df.withColumns(made)


def windowed(callback: Callable, *, many: bool = False) -> Callable[..., Column]:
    """A column operator (x, n) from a callback over the last n values of x, oldest first; null unless all n are there.

    The callback runs in Python on windows that Spark frames and ships by Arrow, for what built-in aggregates can't say:
    once a row, on a Series; or with ``many`` once a batch of rows, on a matrix of a window a row, for a value a row.
    """
    if many:
        return _windowed_many(callback)

    @F.pandas_udf("double")
    def over(values: pd.Series) -> float:
        return float(callback(values.astype(float)))

    def make(x, n: int) -> Column:
        x = base.col(x).cast("double")
        safe = F.coalesce(x, F.lit(0.0))  # a window with a gap is null anyway
        return F.when(F.count(x).over(base.ts(n)) == n, over(safe).over(base.ts(n)))

    return make


def _windowed_many(callback: Callable[[np.ndarray], np.ndarray]) -> Callable[..., Column]:
    @F.pandas_udf("double")
    def over(windows: pd.Series) -> pd.Series:
        out, there = np.full(len(windows), np.nan), windows.notna().to_numpy()
        if there.any():
            out[there] = callback(np.stack(windows[there].to_list()))
        return pd.Series(out)

    def make(x, n: int) -> Column:
        x = base.col(x).cast("double")
        return over(F.when(F.count(x).over(base.ts(n)) == n, F.collect_list(x).over(base.ts(n))))

    return make


@F.udtf(returnType="bin int, low double, high double, part double")
class PriceBins:
    """Rows for the price steps that a bar touches, its volume dealt evenly: a table function for ``lateralJoin``."""

    def eval(self, low: float, high: float, volume: float, step: float):
        if None in (low, high, volume, step) or step <= 0 or high < low:
            return
        first, last = int(low // step), int(high // step)
        for b in range(first, last + 1):
            yield b, b * step, (b + 1) * step, volume / (last - first + 1)


def price_bins(df: DataFrame, low: str, high: str, volume: str, step: float) -> DataFrame:
    """``df`` with bin and part, the rows of ``PriceBins``, from built-in functions: no row leaves the JVM."""
    if step <= 0:
        raise ValueError(f"a price step is positive, not {step}")
    first, last = (F.floor(F.col(x).cast("double") / step) for x in (low, high))
    part = F.col(volume).cast("double") / (last - first + 1)
    dealt = df.where(F.col(volume).isNotNull() & (F.col(high) >= F.col(low)))
    return dealt.withColumn("part", part).withColumn("bin", F.explode(F.sequence(first.cast("int"), last.cast("int"))))


def _builtin() -> None:
    for module, category in ((ts, "TS"), (cs, "CS"), (el, "EL")):
        for name, make in vars(module).items():
            if inspect.isfunction(make) and make.__module__ == module.__name__ and not name.startswith("_"):
                OPERATORS.setdefault(name, Operator(name, make, category, 0, name))


_builtin()
