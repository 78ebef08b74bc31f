"""Data quality: record rules as bit flags, coverage, calendars and issue tables. Bad rows are flagged, never deleted."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.base import div, ts

#: Bits of quality_flags (fixed values).
FLAGS = {
    "PRICE_OUT_OF_RANGE": 1,
    "ADJ_ANOMALY": 2,
    "ZOMBIE": 4,
    "CROSS_SOURCE_DIFF": 8,
    "SUSPENSION_FILL": 16,
    "OHLC_CONFLICT": 32,
    "NEG_QTY": 64,
    "UNIT_MISMATCH": 128,
    "PRE_CLOSE_MISSING": 256,
    "NEW_LISTING": 512,
    "SUSPENDED": 1024,
    "ST_RISK": 2048,
}
FATAL = ("PRICE_OUT_OF_RANGE", "OHLC_CONFLICT", "NEG_QTY", "UNIT_MISMATCH")


def hit(flag: str, condition: Column) -> Column:
    return F.when(condition, FLAGS[flag]).otherwise(0)


def or_flags(df: DataFrame, *masks: Column) -> DataFrame:
    """The masks added to quality_flags."""
    start = F.coalesce("quality_flags", F.lit(0)) if "quality_flags" in df.columns else F.lit(0)
    return df.withColumn("quality_flags", reduce(lambda a, b: a.bitwiseOR(b), masks, start).cast("int"))


def record_checks(df: DataFrame, *, unit: tuple[float, float] = (0.05, 20.0), price: tuple[float, float] = (0.1, 10_000.0), jump: float = 0.5) -> DataFrame:
    """Adds quality_flags by eight rules; suspended rows are exempt but from the factor jump."""
    has = set(df.columns)
    awake = ~F.coalesce("is_suspended", F.lit(False)) if "is_suspended" in has else F.lit(True)
    o, h, low, c, v, a = (F.col(x) for x in ("open", "high", "low", "close", "volume", "amount"))
    bad = reduce(lambda x, y: x | y, [p.isNull() | (p <= price[0]) | (p > price[1]) for p in (o, h, low, c)])
    ratio = F.when((v > 0) & (c > 0) & (a > 0), F.try_divide(a, c * v)).otherwise(1.0)
    rules = [
        ("PRICE_OUT_OF_RANGE", bad),
        ("OHLC_CONFLICT", (h < F.greatest(o, c)) | (low > F.least(o, c)) | (h < low)),
        ("NEG_QTY", (v < 0) | (a < 0)),
        ("UNIT_MISMATCH", (ratio < unit[0]) | (ratio > unit[1])),
        ("SUSPENSION_FILL", (v == 0) & (o != c)),
        ("ZOMBIE", (v == 0) & (o == c)),
    ]
    if "pre_close" in has:
        rules.append(("PRE_CLOSE_MISSING", F.col("pre_close").isNull()))
    masks = [hit(name, F.coalesce(cond & awake, F.lit(False))) for name, cond in rules]
    if "adj_factor" in has:
        masks.append(hit("ADJ_ANOMALY", F.coalesce(F.abs(div("adj_factor", F.lag("adj_factor").over(ts())) - 1) > jump, F.lit(False))))
    return or_flags(df, *masks)


def flag_counts(df: DataFrame) -> DataFrame:
    """Rows per flag, with the flags that stop a load marked."""
    one = df.agg(*[F.count_if(F.col("quality_flags").bitwiseAND(F.lit(bit)) != 0).alias(name) for name, bit in FLAGS.items()])
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("n"), F.lit(n in FATAL).alias("fatal")) for n in FLAGS]))
    return one.select(rows.alias("x")).select("x.*")


def fail_on_fatal(df: DataFrame) -> None:
    """An error that names the first broken fatal rule."""
    broken = flag_counts(df).where("fatal AND n > 0").orderBy("rule").first()
    if broken:
        raise ValueError(f"{broken['n']} rows break {broken['rule']}")


def coverage(df: DataFrame, least: float = 0.9) -> DataFrame:
    """Symbols per date against the median date."""
    d = df.groupBy("trade_date").agg(F.count_distinct("symbol").alias("n"))
    med = d.agg(F.percentile("n", 0.5).alias("median"))
    return d.crossJoin(F.broadcast(med)).withColumn("ok", F.col("n") >= least * F.col("median"))


def zombie_share(df: DataFrame) -> DataFrame:
    """Share of rows per date whose close didn't move."""
    return df.withColumn("still", (F.col("close") == F.lag("close").over(ts())).cast("int")).groupBy("trade_date").agg(F.avg("still").alias("still"), F.count("*").alias("n"))


def missing_dates(have: DataFrame, calendar: DataFrame) -> DataFrame:
    return calendar.select("trade_date").distinct().join(have.select("trade_date").distinct(), "trade_date", "left_anti")


def point_in_time(df: DataFrame, share: float = 0.9) -> DataFrame:
    """Distinct symbols per date, and whether they fell below a share of the most so far (survivorship)."""
    d = df.groupBy("trade_date").agg(F.count_distinct("symbol").alias("n"))
    peak = F.max("n").over(W.orderBy("trade_date").rowsBetween(W.unboundedPreceding, 0))
    return d.withColumn("peak", peak).withColumn("risk", F.col("n") < share * F.col("peak"))


def adjustment(df: DataFrame, limit: float = 0.35, tolerance: float = 0.02) -> DataFrame:
    """Price jumps over the limit that no jump of the factor explains."""
    r = div("close", F.lag("close").over(ts())) - 1
    f = div("adj_factor", F.lag("adj_factor").over(ts())) - 1
    return df.withColumn("ret", r).withColumn("unexplained", (F.abs("ret") > limit) & (F.abs(f) <= tolerance))


def continuity(df: DataFrame) -> DataFrame:
    """First and last date, dates and missing months by year."""
    return df.groupBy(F.year("trade_date").alias("year")).agg(F.min("trade_date").alias("first"), F.max("trade_date").alias("last"), F.count_distinct("trade_date").alias("dates"))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).count().where("count > 1")


def fingerprints(issues: DataFrame, columns: list[str]) -> DataFrame:
    """Issues with a content key, for idempotent appends."""
    return issues.withColumn("issue_id", F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), 256))


def append_new(old: DataFrame, new: DataFrame, key: str = "issue_id") -> DataFrame:
    return old.unionByName(new.dropDuplicates([key]).join(old.select(key), key, "left_anti"), allowMissingColumns=True)


def missing_by_symbol(have: DataFrame, calendar: DataFrame) -> DataFrame:
    """(symbol, trade_date) of every calendar day on which a symbol has no row; the calendar is sent whole."""
    days = calendar.select("trade_date").distinct()
    return have.select("symbol").distinct().crossJoin(F.broadcast(days)).join(have.select("symbol", "trade_date"), ["symbol", "trade_date"], "left_anti")
