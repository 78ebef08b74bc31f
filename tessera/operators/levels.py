"""Price levels of each symbol as of its last bar: extremes, turning points, bands, open gaps, retracements, round prices.

One window over a symbol's rows finds places and turning points, one aggregation by symbol gives all numbers and the few
short lists (the last bars for gaps, the turning points), and array functions make the levels. Rows without positive,
finite high, low and close don't count. A kind of level that needs more bars than there are is left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.base import KEY, fin

#: Bounds of the close and steps of round prices below each; above them all the last step (fixed values).
STEPS = ((10, 0.5), (20, 1.0), (100, 5.0), (500, 10.0))
LAST_STEP = 50.0
KELTNER = (("keltner_s", 20, 2.0), ("keltner_m", 60, 2.5), ("keltner_l", 120, 3.0))
RATIOS = (0.236, 0.382, 0.5, 0.618, 0.786)
_LEVEL = "struct<type: string, label: string, value: double>"


def clean(df: DataFrame) -> DataFrame:
    """symbol, trade_date, high, low, close of the rows that count."""
    d = df.select("symbol", "trade_date", *[fin(F.col(c).cast("double")).alias(c) for c in ("high", "low", "close")])
    return d.where("high > 0 AND low > 0 AND close > 0")


def merged(values: Column, share: float) -> Column:
    """Means of groups of near values: sorted, a group runs while values are within ``share`` of its first."""
    zero = F.struct(F.array().cast("array<double>").alias("done"), F.lit(None).cast("double").alias("first"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("n"))

    def step(acc: Column, v: Column) -> Column:
        new = acc["first"].isNull() | (v > acc["first"] * (1 + share))
        closed = F.when(acc["first"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["sum"] / acc["n"])))
        return F.struct(
            F.when(new, closed).otherwise(acc["done"]).alias("done"),
            F.when(new, v).otherwise(acc["first"]).alias("first"),
            F.when(new, v).otherwise(acc["sum"] + v).alias("sum"),
            F.when(new, F.lit(1.0)).otherwise(acc["n"] + 1).alias("n"),
        )

    return F.aggregate(F.array_sort(values), zero, step, lambda acc: F.when(acc["first"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["sum"] / acc["n"]))))


def nearest(values: Column, to: Column, n: int) -> Column:
    """The n values nearest to ``to``, nearest first, of equals the smaller."""
    keyed = F.array_sort(F.transform(values, lambda v: F.struct(F.abs(v - to).alias("d"), v.alias("v"))))
    return F.transform(F.slice(keyed, 1, n), lambda s: s["v"])


def open_gaps(bars: Column, up: bool) -> Column:
    """Middles of the gaps that no later bar has touched. ``bars``: (high, low) of the last bars, oldest first.

    A gap lies between a bar's high and the next one's low (or low and high); a bar that overlaps it has filled it.
    """
    places = F.when(F.size(bars) > 1, F.sequence(F.lit(2), F.size(bars))).otherwise(F.array().cast("array<int>"))

    def gap(i: Column) -> Column:
        before, own = F.element_at(bars, i - 1), F.element_at(bars, i)
        low, high = (before["high"], own["low"]) if up else (own["high"], before["low"])
        later = F.slice(bars, i + 1, F.size(bars))
        filled = F.exists(later, lambda b: (b["low"] <= high) & (b["high"] >= low))
        return F.when((low < high) & ~filled, (low + high) / 2)

    return F.filter(F.transform(places, gap), lambda v: v.isNotNull())


def _row(kind: str, label: str, value: Column) -> Column:
    return F.struct(F.lit(kind).alias("type"), F.lit(label).alias("label"), value.cast("double").alias("value"))


def _rows(kind: str, label: str, values: Column) -> Column:
    return F.transform(values, lambda v: F.struct(F.lit(kind).alias("type"), F.lit(label).alias("label"), v.cast("double").alias("value")))


def _round_prices(close: Column, share: float, most: int) -> Column:
    step = F.lit(LAST_STEP)
    for bound, size in reversed(STEPS):
        step = F.when(close < bound, F.lit(size)).otherwise(step)
    first, last = F.ceil(close * (1 - share) / step), F.floor(close * (1 + share) / step)
    held = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))
    far = F.filter(F.transform(held, lambda k: k * step), lambda v: (v > 0) & (F.abs(v - close) / close >= 0.01))
    return nearest(far, close, most)


def compute_levels(df: DataFrame, *, extremes=(60, 250), swing: int = 5, swing_top: int = 2, lookback: int = 120, gap_top: int = 3, gap_share: float = 0.005, fib_window: int = 120, ratios=RATIOS, boll: tuple[int, float] = (20, 2.0), atr: int = 14, atr_mults=(2.0, 1.5), keltner=KELTNER, round_share: float = 0.10, round_max: int = 8) -> DataFrame:
    """(symbol, trade_date, close, type, label, value, side, rank) as of each symbol's last bar.

    ``side`` is support, resistance or neutral against the close (both to four digits), ``rank`` the place of a level
    among those of its type by distance (of equals the one named first). Of equal levels of a type the first stays.

    pivot: middle and three steps either way of the last bar. extreme: highest and lowest of the last n bars, and turning
    points, bars that are the extreme of ``swing`` bars on both sides (so they are known only so many bars later), merged
    within 1 %. boll, atr, keltner: bands around a mean or the close; the true range is smoothed by 1 / atr from the first
    bar on. gap: gaps of the last ``lookback`` bars that no bar has touched since. fib: shares of the way back between the
    extremes of the last ``fib_window`` bars, downwards if the high came later. round: round prices at least 1 % away.
    """
    rows = clean(df)
    back, ahead = W.partitionBy(KEY).orderBy(F.desc("trade_date")), W.partitionBy(KEY).orderBy("trade_date")
    around = ahead.rowsBetween(-swing, swing)
    full = F.count("*").over(around) == 2 * swing + 1
    before = F.lag("close").over(ahead)
    rows = rows.withColumns(
        {
            "k": F.row_number().over(back),
            "n": F.count("*").over(W.partitionBy(KEY)),
            "top": F.when(full & (F.col("high") == F.max("high").over(around)), F.col("high")),
            "bottom": F.when(full & (F.col("low") == F.min("low").over(around)), F.col("low")),
            "tr": F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before)),
        }
    )
    k, n = F.col("k"), F.col("n")
    # the smoothed range at the last bar, as a weighted sum: the first bar's range carries what is left of the weight
    weight = F.pow(F.lit(1 - 1 / atr), k - 1) * F.when(k == n, 1.0).otherwise(1 / atr)
    within = lambda c, m: F.when(k <= m, F.col(c))
    means = sorted({boll[0], *(m for _, m, _ in keltner)})
    one = rows.groupBy("symbol").agg(
        F.max("n").alias("n"),
        F.max("trade_date").alias("trade_date"),
        F.round(F.max(within("close", 1)), 4).alias("close"),
        F.max(within("close", 1)).alias("c"),
        F.max(within("high", 1)).alias("h"),
        F.max(within("low", 1)).alias("l"),
        F.sum(F.col("tr") * weight).alias("atr"),
        F.stddev_samp(within("close", boll[0])).alias("sd"),
        *[F.avg(within("close", m)).alias(f"ma{m}") for m in means],
        *[F.max(within("high", m)).alias(f"hi{m}") for m in extremes],
        *[F.min(within("low", m)).alias(f"lo{m}") for m in extremes],
        F.max(F.when(k <= fib_window, F.struct("high", "k"))).alias("fh"),
        F.min(F.when(k <= fib_window, F.struct(F.col("low"), (-k).alias("k")))).alias("fl"),
        F.collect_list("top").alias("tops"),
        F.collect_list("bottom").alias("bottoms"),
        F.collect_list(F.when(k <= lookback, F.struct((-k).alias("k"), "high", "low"))).alias("bars"),
    )
    c, count, raw = F.col("close"), F.col("n"), F.col("c")
    p, h, low = (F.col("h") + F.col("l") + raw) / 3, F.col("h"), F.col("l")
    some = lambda when, *levels: F.when(when, F.array(*levels)).otherwise(F.array().cast(f"array<{_LEVEL}>"))
    many = lambda when, levels: F.when(when, levels).otherwise(F.array().cast(f"array<{_LEVEL}>"))
    made = [some(F.lit(True), *[_row("pivot", a, v) for a, v in (("P", p), ("R1", 2 * p - low), ("R2", p + (h - low)), ("R3", h + 2 * (p - low)), ("S1", 2 * p - h), ("S2", p - (h - low)), ("S3", low - 2 * (h - p)))])]
    made += [some(count >= m, _row("extreme", f"high {m}", F.col(f"hi{m}")), _row("extreme", f"low {m}", F.col(f"lo{m}"))) for m in extremes]
    turned = count > 2 * swing + 1
    made.append(many(turned, _rows("extreme", "swing high", nearest(F.filter(merged(F.col("tops"), 0.01), lambda v: v > c * 1.001), c, swing_top))))
    made.append(many(turned, _rows("extreme", "swing low", nearest(F.filter(merged(F.col("bottoms"), 0.01), lambda v: v < c * 0.999), c, swing_top))))
    m, times = boll
    made.append(some(count >= m, _row("boll", "upper", F.col(f"ma{m}") + times * F.col("sd")), _row("boll", "middle", F.col(f"ma{m}")), _row("boll", "lower", F.col(f"ma{m}") - times * F.col("sd"))))
    made.append(some(count >= atr + 1, *[_row("atr", f"{sign:+d} x {x:g}", c + sign * x * F.col("atr")) for x in sorted(set(atr_mults), reverse=True) for sign in (1, -1)]))
    bars = F.transform(F.array_sort("bars"), lambda b: F.struct(b["high"].alias("high"), b["low"].alias("low")))
    for up, label in ((True, "up"), (False, "down")):
        made.append(many(count >= 5, _rows("gap", label, nearest(merged(open_gaps(F.col("last"), up), gap_share), c, gap_top))))
    span = F.col("fh.high") - F.col("fl.low")
    rising = F.col("fh.k") < -F.col("fl.k")
    back_to = [_row("fib", f"{r * 100:g}%", F.when(rising, F.col("fh.high") - span * r).otherwise(F.col("fl.low") + span * r)) for r in ratios]
    made.append(some((count >= 10) & (span > 0), *back_to))
    made.append(_rows("round", "round", _round_prices(c, round_share, round_max)))
    for name, m, times in keltner:
        made.append(some(count >= max(m, atr) + 1, _row(name, "upper", F.col(f"ma{m}") + times * F.col("atr")), _row(name, "lower", F.col(f"ma{m}") - times * F.col("atr"))))
    flat = one.withColumn("last", bars).select("symbol", "trade_date", "close", F.posexplode(F.concat(*made)).alias("at", "x"))
    flat = flat.select("symbol", "trade_date", "close", "at", "x.type", "x.label", F.round("x.value", 4).alias("value"))
    first = flat.groupBy("symbol", "trade_date", "close", "type", "value").agg(F.min(F.struct("at", "label")).alias("f"))
    apart = F.col("value") - F.col("close")
    side = F.when(F.abs(apart) <= 1e-9 * F.greatest(F.lit(1.0), F.abs("close")), "neutral").when(apart > 0, "resistance").otherwise("support")
    rank = F.row_number().over(W.partitionBy("symbol", "type").orderBy(F.round(F.abs(apart), 6), "f.at"))
    return first.select("symbol", "trade_date", "close", "type", F.col("f.label").alias("label"), "value", side.alias("side"), rank.alias("rank"))


def gaps(df: DataFrame, *, lookback: int = 120) -> DataFrame:
    """(symbol, direction, value): the middle of every gap of the last ``lookback`` bars that is still open."""
    rows = clean(df).withColumn("k", F.row_number().over(W.partitionBy(KEY).orderBy(F.desc("trade_date")))).where(F.col("k") <= lookback)
    bars = rows.groupBy("symbol").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("k")).alias("k"), "high", "low"))), lambda b: F.struct(b["high"].alias("high"), b["low"].alias("low"))).alias("bars"))
    each = [bars.select("symbol", F.lit(name).alias("direction"), F.explode(open_gaps(F.col("bars"), up)).alias("value")) for up, name in ((True, "up"), (False, "down"))]
    return each[0].unionByName(each[1])
