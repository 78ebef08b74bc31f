"""Recurrences along a symbol's history, as one pass over its ordered rows inside the JVM.

The rows of a symbol meet in one array, as a recurrence needs them in order; a fold carries the state and appends each
step's result. The work is linear in the number of rows, where a fold per row over the running list is quadratic.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.base import KEY, TIME


def scan(panel: DataFrame, names: list[str], step: Callable[[Column, Column], dict[str, Column]]) -> DataFrame:
    """Adds the columns ``names`` (double): each row's state after ``step(state, row)``, states being null at first."""
    others = [c for c in panel.columns if c not in (KEY, TIME)]
    rows = F.array_sort(F.collect_list(F.struct(TIME, *others)))
    kind = f"struct<{', '.join(f'{n}: double' for n in names)}>"
    start = F.struct(F.lit(None).cast(kind).alias("s"), F.array().cast(f"array<{kind}>").alias("out"))

    def merge(acc: Column, row: Column) -> Column:
        new = step(acc["s"], row)
        made = F.array(F.struct(*[new[n].cast("double").alias(n) for n in names]))
        return F.element_at(F.transform(made, lambda s: F.struct(s.alias("s"), F.concat(acc["out"], F.array(s)).alias("out"))), 1)

    folded = panel.groupBy(KEY).agg(rows.alias("__rows")).withColumn("__out", F.aggregate("__rows", start, merge, lambda acc: acc["out"]))
    flat = folded.select(KEY, F.explode(F.arrays_zip("__rows", "__out")).alias("z"))
    return flat.select(KEY, "z.__rows.*", "z.__out.*").select(*panel.columns, *names)


def mean(before: Column, value: Column, alpha: float) -> Column:
    """One step of an exponential mean seeded by the first value; a null value keeps the mean."""
    return F.when(value.isNull(), before).when(before.isNull(), value).otherwise(F.lit(alpha) * value + F.lit(1 - alpha) * before)


def oscillators(panel: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9, n: int = 14) -> DataFrame:
    """Adds dif, dea, macd, rsi and atr from one pass."""

    def step(s: Column, r: Column) -> dict[str, Column]:
        c, h, low, c0 = r["close"], r["high"], r["low"], s["last"]
        f, g = mean(s["fast"], c, 2 / (fast + 1)), mean(s["slow"], c, 2 / (slow + 1))
        change = c - c0
        up, down = F.when(change > 0, change).otherwise(0.0), F.when(change < 0, -change).otherwise(0.0)
        tr = F.greatest(h - low, F.abs(h - c0), F.abs(low - c0))
        return {
            "fast": f,
            "slow": g,
            "dea": mean(s["dea"], f - g, 2 / (signal + 1)),
            "gain": mean(s["gain"], up, 1 / n),
            "loss": mean(s["loss"], down, 1 / n),
            "atr": mean(s["atr"], tr, 1 / n),
            "moved": F.when(change.isNotNull(), 1.0),
            "last": F.coalesce(c, c0),
        }

    names = ["fast", "slow", "dea", "gain", "loss", "atr", "moved", "last"]
    d = scan(panel, names, step)
    d = d.withColumn("dif", F.col("fast") - F.col("slow")).withColumn("macd", 2 * (F.col("dif") - F.col("dea")))
    total = F.col("gain") + F.col("loss")
    d = d.withColumn("rsi", F.when(F.col("moved").isNotNull(), 100 * F.try_divide(F.col("gain"), F.when(total > 0, total))))
    return d.select(*panel.columns, "dif", "dea", "macd", "rsi", "atr")


def stop_and_reverse(panel: DataFrame, step_size: float = 0.02, most: float = 0.2) -> DataFrame:
    """Adds sar and sar_dir (1 or -1): a stop that speeds up toward the extreme and turns when the price crosses it.

    The first two rows give the direction, extreme and stop; the stop never enters the range of the two rows before.
    Rows with a missing high or low give null and leave the state as it was.
    """

    def step(s: Column, r: Column) -> dict[str, Column]:
        h, low = r["high"], r["low"]
        gap = h.isNull() | low.isNull()
        seed = s["dir"].isNull() & s["h1"].isNotNull()
        d0 = F.when(h >= s["h1"], 1.0).otherwise(-1.0)
        rise = s["dir"] > 0
        ahead = s["stop"] + s["af"] * (s["ep"] - s["stop"])
        held = F.when(rise, F.least(ahead, s["l1"], s["l2"])).otherwise(F.greatest(ahead, s["h1"], s["h2"]))
        turn = F.when(rise, low < held).otherwise(h > held)
        further = F.when(rise, h > s["ep"]).otherwise(low < s["ep"])
        best = F.when(rise, F.greatest(h, s["ep"])).otherwise(F.least(low, s["ep"]))
        pick = lambda seeded, turned, kept, name: F.when(gap, s[name]).when(seed, seeded).when(s["dir"].isNull(), F.lit(None)).when(turn, turned).otherwise(kept)
        return {
            "dir": pick(d0, -s["dir"], s["dir"], "dir"),
            "stop": pick(F.when(d0 > 0, F.least(low, s["l1"])).otherwise(F.greatest(h, s["h1"])), s["ep"], held, "stop"),
            "ep": pick(F.when(d0 > 0, F.greatest(h, s["h1"])).otherwise(F.least(low, s["l1"])), F.when(rise, low).otherwise(h), best, "ep"),
            "af": pick(F.lit(step_size), F.lit(step_size), F.when(further, F.least(s["af"] + step_size, F.lit(most))).otherwise(s["af"]), "af"),
            "h2": F.when(gap, s["h2"]).otherwise(s["h1"]),
            "l2": F.when(gap, s["l2"]).otherwise(s["l1"]),
            "h1": F.coalesce(h, s["h1"]),
            "l1": F.coalesce(low, s["l1"]),
        }

    d = scan(panel, ["dir", "stop", "ep", "af", "h2", "l2", "h1", "l1"], step)
    ok = F.col("high").isNotNull() & F.col("low").isNotNull()
    return d.select(*panel.columns, F.when(ok, F.col("stop")).alias("sar"), F.when(ok, F.col("dir")).cast("tinyint").alias("sar_dir"))
