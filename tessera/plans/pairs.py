"""Queries and their SQL built side by side from pairs of a column and an expression."""

from __future__ import annotations

from pyspark.sql import functions as F

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

W = "(PARTITION BY symbol ORDER BY trade_date"


def w(n: int) -> str:
    return f"OVER {W} ROWS {n - 1} PRECEDING)"


WS = f"OVER {W})"
CS = "OVER (PARTITION BY trade_date)"


def full(x: str, n: int, value: str) -> str:
    return f"CASE WHEN count({x}) {w(n)} = {n} THEN {value} END"


def near(x, digits: int = 6):
    """Rounded, a little off the halves, where engines differ in the last bit; no negative zero.

    By the product with ten to the digits, as in DuckDB, where a double holds it; Spark's round makes a decimal number of
    every value, which costs several times as much.
    """
    x, unit = x + 0.13 * 10**-digits, float(10**digits)
    return F.when(F.abs(x) < 1e15 / unit, F.rint(x * unit) / unit).otherwise(F.round(x, digits)) + 0.0


def near_sql(x: str, digits: int = 6) -> str:
    return f"(round({x} + {0.13 * 10**-digits!r}, {digits}) + 0.0)"


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def columns(name: str, panel, with_: str, source: str, made, sql: dict[str, str], keys=("symbol", "trade_date"), digits: int = 6, doc: str = "") -> None:
    """Register a query that adds columns to a panel: ``made`` gives the columns by name, ``sql`` the same as SQL.

    Columns are made when the query runs, since they need a session. SQL that starts with /*raw*/ isn't rounded.
    """

    def run(spark, sf_dir):
        p = panel(spark, sf_dir)
        done = p.select(*keys, *[c.alias(k) for k, c in made().items()])
        numbers = {k for k, t in done.dtypes if t in ("double", "float")}
        return done.select(*keys, *[near(F.col(k), digits).alias(k) if k in numbers else F.col(k) for k in sql])

    run.__name__, run.__doc__ = name, doc
    QUERIES[name] = run
    inner = ", ".join(f"({e}) AS {k}" for k, e in sql.items())
    rounded = ", ".join(k if e.startswith("/*raw*/") else f"{near_sql(k, digits)} AS {k}" for k, e in sql.items())
    ORACLE_SQL[name] = f"WITH {with_} SELECT {', '.join(keys)}, {rounded} FROM (SELECT {', '.join(keys)}, {inner} FROM {source})"
