"""Is each day of a stored table whole and right? Verdicts from the data and an independent source, and repairs by them.

One full join on (date, symbol) and one aggregation by date audit all days at once. Verdicts have three values: what can't
be told is ``unknown``, never fine and never a reason to delete.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.base import fin

#: Half of the smallest price step, and what rounding may add to a difference.
HALF_TICK, EPSILON = 0.005, 1e-9


def _tradable(df: DataFrame) -> Column | None:
    """Whether a row's symbol could be traded: not marked suspended, and with volume (an unknown volume counts as some)."""
    marks = []
    if "is_suspended" in df.columns:
        marks.append(~F.coalesce(F.col("is_suspended").cast("boolean"), F.lit(False)))
    if "volume" in df.columns:
        marks.append(F.coalesce(F.col("volume").cast("double") != 0, F.lit(True)))
    return None if not marks else marks[0] if len(marks) == 1 else marks[0] & marks[1]


def snapshots(table: DataFrame, *, stamp: str = "quote_ts", close_at: str = "15:00:00", tz: str = "UTC") -> DataFrame:
    """(trade_date, state, rows, suspicious_rows, batch_rows, quote_ts_max): is a day still what was quoted while it ran?

    ``stamp`` has the quote's time in milliseconds; rows written after the close in one batch have none. A stamped row is
    suspicious unless its time is on its date, at ``close_at`` in ``tz`` or later. A day without suspicious rows is
    ``authoritative``; one with suspicious rows is a ``snapshot``, unless none of them has volume and rows of the batch
    outnumber them (left over from suspended symbols). Without the column a day is ``unknown``.
    """
    day = table.groupBy("trade_date")
    if stamp not in table.columns:
        none = F.lit(None).cast("long")
        return day.agg(F.lit("unknown").alias("state"), F.count("*").alias("rows"), none.alias("suspicious_rows"), none.alias("batch_rows"), none.alias("quote_ts_max"))
    ms = F.col(stamp).cast("long")
    start = F.unix_millis(F.to_utc_timestamp(F.concat(F.col("trade_date").cast("string"), F.lit(f" {close_at}")).cast("timestamp"), tz))
    end = F.unix_millis(F.to_utc_timestamp(F.date_add("trade_date", 1).cast("timestamp"), tz))
    odd = ms.isNotNull() & ((ms < start) | (ms >= end))
    known = [F.col(c).cast("double") for c in ("volume", "amount") if c in table.columns]
    active = F.lit(True)
    if known:
        active = F.coalesce(known[0] > 0, F.lit(False))
        for k in known[1:]:
            active = active | F.coalesce(k > 0, F.lit(False))
    d = day.agg(F.count("*").alias("rows"), F.count_if(odd).alias("suspicious_rows"), F.count_if(ms.isNull()).alias("batch_rows"), F.max(ms).alias("quote_ts_max"), F.count_if(odd & active).alias("moving"))
    left_over = (F.col("moving") == 0) & (F.col("batch_rows") > F.col("suspicious_rows"))
    state = F.when((F.col("suspicious_rows") == 0) | left_over, "authoritative").otherwise("snapshot")
    return d.select("trade_date", state.alias("state"), "rows", "suspicious_rows", "batch_rows", "quote_ts_max")


def _side(df: DataFrame, value: str, name: str) -> DataFrame:
    """A row per (date, symbol): whether it could be traded, its value (of repeated rows the largest), and how many rows."""
    can = _tradable(df)
    rows = df.where(F.col("symbol").isNotNull()) if "symbol" in df.columns else df
    price = fin(F.col(value).cast("double")) if value in df.columns else F.lit(None).cast("double")
    return rows.groupBy("trade_date", "symbol").agg(F.max(price).alias(f"{name}_value"), F.max(can if can is not None else F.lit(True)).alias(f"{name}_can"), F.count("*").alias(f"{name}_rows"))


def audit(table: DataFrame, authority: DataFrame | None, *, value: str = "close", authority_value: str | None = None, tolerance: float = HALF_TICK, samples: int = 50) -> DataFrame:
    """A row per day of ``table``: values and coverage against ``authority``, a table of the same days from elsewhere.

    value_status: ok, mismatch (values that differ by more than ``tolerance``), no_overlap, no_value_column, no_authority.
    coverage_status: ok, gap (symbols that could be traded are missing), no_halt_filter (the authority can't tell which
    could), no_authority. Rows are never compared by count: suspended symbols are rightly left out. ``missing`` names the
    first ``samples`` symbols, the counts count all. Nothing is compared with itself: no authority, no verdict.
    """
    empty = F.lit(None).cast("array<string>")
    if authority is None:
        zero = F.lit(0).cast("long")
        return table.groupBy("trade_date").agg(F.lit("no_authority").alias("value_status"), zero.alias("checked"), zero.alias("mismatches"), F.lit(None).cast("double").alias("max_diff"), F.lit("no_authority").alias("coverage_status"), zero.alias("expected"), zero.alias("actual"), zero.alias("n_missing"), zero.alias("n_extra"), empty.alias("missing"), F.count("*").alias("rows"), zero.alias("authority_rows"))
    name = authority_value or value
    a, b = _side(table, value, "own"), _side(authority, name, "other")
    j = a.join(b, ["trade_date", "symbol"], "full")
    both = F.col("own_value").isNotNull() & F.col("other_value").isNotNull()
    diff = F.when(both, F.abs(F.col("own_value") - F.col("other_value")))
    own, want = F.coalesce("own_can", F.lit(False)), F.coalesce("other_can", F.lit(False))
    missing = want & ~own
    d = j.groupBy("trade_date").agg(
        F.coalesce(F.sum("own_rows"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum("other_rows"), F.lit(0)).alias("authority_rows"),
        F.count_if(both).alias("checked"),
        F.count_if(diff > tolerance + EPSILON).alias("mismatches"),
        F.max(F.when(diff > tolerance + EPSILON, diff)).alias("max_diff"),
        F.count_if(want).alias("expected"),
        F.count_if(own).alias("actual"),
        F.count_if(missing).alias("n_missing"),
        F.count_if(own & ~want).alias("n_extra"),
        F.slice(F.array_sort(F.collect_set(F.when(missing, F.col("symbol")))), 1, samples).alias("missing"),
    )
    d = d.where("rows > 0")
    halted = F.lit(_tradable(authority) is not None)
    priced = F.lit(value in table.columns and name in authority.columns)
    there = F.col("authority_rows") > 0
    values = F.when(~there, "no_authority").when(~priced, "no_value_column").when(F.col("checked") == 0, "no_overlap").when(F.col("mismatches") > 0, "mismatch").otherwise("ok")
    cover = F.when(~there, "no_authority").when(~halted, "no_halt_filter").when(F.col("n_missing") > 0, "gap").otherwise("ok")
    told = there & halted
    counts = [F.when(told, F.col(c)).otherwise(F.lit(0)).alias(c) for c in ("expected", "actual", "n_missing", "n_extra")]
    return d.select("trade_date", values.alias("value_status"), "checked", "mismatches", "max_diff", cover.alias("coverage_status"), *counts, F.when(told, F.col("missing")).alias("missing"), "rows", "authority_rows")


def report(table: DataFrame, authority: DataFrame | None = None, calendar: DataFrame | None = None, *, stamp: str = "quote_ts", close_at: str = "15:00:00", tz: str = "UTC", **how) -> DataFrame:
    """A row per day of the table and of ``calendar``: all verdicts, the reasons for a repair, and whether one is due.

    Reasons: snapshot, value_mismatch, coverage_gap, and missing_day for a date of the calendar without a row. A day that
    is only unknown has none.
    """
    d = snapshots(table, stamp=stamp, close_at=close_at, tz=tz).join(audit(table, authority, **how).drop("rows"), "trade_date")
    if calendar is not None:
        d = d.join(calendar.select("trade_date").distinct(), "trade_date", "full")
    rules = [("missing_day", F.col("rows").isNull()), ("snapshot", F.col("state") == "snapshot"), ("value_mismatch", F.col("value_status") == "mismatch"), ("coverage_gap", F.col("coverage_status") == "gap")]
    reasons = F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules]))
    state = F.when(F.col("rows").isNull(), "missing").otherwise(F.col("state"))
    return d.withColumns({"reasons": reasons, "rows": F.coalesce("rows", F.lit(0)), "state": state}).withColumn("repair", F.size("reasons") > 0)


def plan(report: DataFrame) -> DataFrame:
    """(trade_date, reasons, rows) of the days to write anew."""
    return report.where("repair").select("trade_date", "reasons", "rows")


def files(spark: SparkSession, root: str, planned: DataFrame) -> DataFrame:
    """(trade_date, path, rows): where the rows of the planned days lie, from the files' own metadata."""
    table = spark.read.option("mergeSchema", True).parquet(root)
    hit = table.select("trade_date", F.col("_metadata.file_path").alias("path")).join(planned.select("trade_date"), "trade_date", "left_semi")
    return hit.groupBy("trade_date", "path").agg(F.count("*").alias("rows"))


def repair(spark: SparkSession, root: str, planned: DataFrame, authority: DataFrame | None = None, *, dry_run: bool = True) -> DataFrame:
    """(trade_date, deleted, written): planned days leave the table, and come back from ``authority`` where it has them.

    A dry run only counts. Otherwise the years touched are written once, rows of other days as they are; what the table
    holds for a planned day is gone even if the authority has nothing, so that the day counts as absent from then on.
    """
    from ..sources import lake
    from ..sources.shared import kept

    days = kept(planned.select("trade_date").distinct(), "days")
    table = spark.read.option("mergeSchema", True).parquet(root)
    old = table.join(days, "trade_date", "left_semi").groupBy("trade_date").agg(F.count("*").alias("deleted"))
    new = authority.join(days, "trade_date", "left_semi") if authority is not None else table.limit(0).drop("year")
    counts = new.groupBy("trade_date").agg(F.count("*").alias("written"))
    out = days.join(old, "trade_date", "left").join(counts, "trade_date", "left").na.fill(0, ["deleted", "written"])
    if dry_run:
        return out
    out, new = kept(out, "repaired"), kept(new, "fresh")
    lake.replace_days(spark, root, days, new)
    return out
