"""The panel lake: partitioned Parquet with upserts, deletions, snapshots, user tables, mapping of foreign columns.

Writes go to whole partitions: touched ones are rebuilt beside the old ones and then replaced by Spark's dynamic
partition overwrite. Two writers of one partition need an outside lock, as plain Parquet has no transactions.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import joins

_NUMBER = {n: T.DoubleType() for n in ("open", "high", "low", "close", "volume", "amount", "pre_close", "turnover_rate", "adj_factor")}
DAILY = T.StructType([T.StructField("symbol", T.StringType()), T.StructField("trade_date", T.DateType()), *[T.StructField(n, t) for n, t in _NUMBER.items()], T.StructField("is_suspended", T.BooleanType()), T.StructField("quality_flags", T.IntegerType()), T.StructField("quote_ts", T.LongType())])


def coerce(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Conform to a schema: missing columns are null, texts that don't fit are null, extra columns go.

    Texts become true for 1, true, t, yes in any case, else false.
    """
    has = {f.name: f.dataType for f in df.schema.fields}

    def one(f: T.StructField) -> Column:
        if f.name not in has:
            return F.lit(None).cast(f.dataType)
        if isinstance(f.dataType, T.BooleanType) and isinstance(has[f.name], T.StringType):
            return F.lower(F.trim(f.name)).isin("1", "true", "t", "yes")
        return F.col(f.name).try_cast(f.dataType)

    return df.select(*[one(f).alias(f.name) for f in schema.fields])


def read_daily(spark: SparkSession, root: str, symbols: list[str] | None = None, start=None, end=None) -> DataFrame:
    """Scan with filters that reach the files; columns may differ between files."""
    df = spark.read.option("mergeSchema", True).parquet(root)
    if symbols is not None:
        df = df.where(F.col("symbol").isin(symbols))
    if start is not None:
        df = df.where((F.col("trade_date") >= F.lit(start).cast("date")) & (F.col("year") >= F.year(F.lit(start).cast("date"))))
    if end is not None:
        df = df.where((F.col("trade_date") <= F.lit(end).cast("date")) & (F.col("year") <= F.year(F.lit(end).cast("date"))))
    return df


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


#: Rows of a file, about; a partition with more is written by several tasks.
FILE_ROWS = 4_000_000


def _replace(df: DataFrame, root: str, by: list[str]) -> None:
    """Overwrite the partitions that df has; df may read the same table, so it is written aside first.

    Rows are dealt by partition and a hash of the symbol, so a year of the lake isn't one task's work.
    """
    spark = df.sparkSession
    aside = f"{root.rstrip('/')}_staging_{uuid.uuid4().hex}"
    df.write.parquet(aside)
    try:
        staged = spark.read.parquet(aside)
        most = staged.groupBy(*by).count().agg(F.max("count")).head()[0] or 0
        deal = [F.pmod(F.xxhash64("symbol"), F.lit(-(-most // FILE_ROWS)))] if most > FILE_ROWS and "symbol" in df.columns else []
        wide = [int(spark.conf.get("spark.sql.shuffle.partitions"))] if deal else []  # a number keeps partitions apart
        staged.repartition(*wide, *by, *deal).sortWithinPartitions(*[c for c in ("symbol", "trade_date") if c in df.columns]).write.option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(*by).mode("overwrite").parquet(root)
    finally:
        p = spark._jvm.org.apache.hadoop.fs.Path(aside)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def write_daily(df: DataFrame, root: str, keys=("symbol", "trade_date")) -> None:
    """Upsert by key: rows of the same key are replaced, stored quality bits stay, others are untouched.

    A batch of demonstration rows (source = 'demo') never replaces real ones.
    """
    spark = df.sparkSession
    new = df.withColumn("year", F.year("trade_date"))
    new = new if "quote_ts" in new.columns else new.withColumn("quote_ts", F.lit(None).cast("long"))
    if _exists(spark, root):
        years = [r[0] for r in new.select("year").distinct().collect()]
        old = spark.read.option("mergeSchema", True).parquet(root).where(F.col("year").isin(years))
        if "source" in new.columns and "source" in old.columns:
            clash = new.where("source = 'demo'").join(old.where("source IS NULL OR source <> 'demo'"), list(keys), "left_semi")
            if not clash.isEmpty():
                raise ValueError("demonstration rows would replace real ones")
        if "quality_flags" in new.columns and "quality_flags" in old.columns:
            new = joins.merge_flags(old, new, list(keys))
        new = joins.overlay(old, new, list(keys))
    _replace(new, root, ["year"])


def delete_daily(spark: SparkSession, root: str, symbols: list[str] | None = None, start=None, end=None, dry_run: bool = False) -> int:
    """Delete by symbols and dates; the number of rows that go (or would)."""
    gone = F.lit(True)
    if symbols is not None:
        gone = gone & F.col("symbol").isin(symbols)
    if start is not None:
        gone = gone & (F.col("trade_date") >= F.lit(start).cast("date"))
    if end is not None:
        gone = gone & (F.col("trade_date") <= F.lit(end).cast("date"))
    df = spark.read.option("mergeSchema", True).parquet(root)
    hit = df.where(gone).groupBy("year").count().collect()
    if hit and not dry_run:
        years = [r["year"] for r in hit]
        touched = df.where(F.col("year").isin(years))
        left = touched.where(~gone)
        kept = {r[0] for r in left.select("year").distinct().collect()}
        if kept:
            _replace(left.where(F.col("year").isin(list(kept))), root, ["year"])
        for y in set(years) - kept:
            p = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/year={y}")
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    return sum(r["count"] for r in hit)


def replace_days(spark: SparkSession, root: str, days: DataFrame, new: DataFrame) -> None:
    """Rows of ``days`` leave the table, the rows ``new`` join it; only the years of either are written.

    A year that is left without rows is removed. ``new`` must not read the table.
    """
    df = spark.read.option("mergeSchema", True).parquet(root)
    new = new.withColumn("year", F.year("trade_date"))
    years = sorted({r[0] for d in (days.select(F.year("trade_date")), new.select("year")) for r in d.distinct().collect()})
    left = df.where(F.col("year").isin(years)).join(days, "trade_date", "left_anti").unionByName(new, allowMissingColumns=True)
    kept = {r[0] for r in left.select("year").distinct().collect()}
    if kept:
        _replace(left, root, ["year"])
    for y in set(years) - kept:
        p = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/year={y}")
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def date_range(df: DataFrame) -> DataFrame:
    return df.agg(F.min("trade_date").alias("first"), F.max("trade_date").alias("last"))


def top_by_amount(df: DataFrame, n: int = 200) -> DataFrame:
    """The n largest amounts of the newest date."""
    last = df.agg(F.max("trade_date").alias("trade_date"))
    return df.join(F.broadcast(last), "trade_date").orderBy(F.desc("amount"), "symbol").limit(n)


def latest_snapshot(a: DataFrame, b: DataFrame) -> DataFrame:
    """Newest row of each symbol from two tables, each by its own newest date, merged."""
    newest = lambda d, p: d.groupBy("symbol").agg(F.max_by(F.struct(*[F.col(c).alias(c if c == "trade_date" and not p else f"{p}{c}") for c in d.columns if c != "symbol"]), "trade_date").alias("x")).select("symbol", "x.*")
    return newest(a, "").join(newest(b, "basic_"), "symbol", "full")


def apply_mapping(df: DataFrame, *, rename: dict | None = None, derive: dict | None = None, fill: dict | None = None, select: list[str] | None = None) -> DataFrame:
    """Rename, then derive (SQL expressions), then fill nulls with constants, then select."""
    df = df.withColumnsRenamed(rename or {})
    df = df.withColumns({k: F.expr(v) for k, v in (derive or {}).items()})
    df = df.withColumns({k: F.coalesce(F.col(k), F.lit(v)) if k in df.columns else F.lit(v) for k, v in (fill or {}).items()})
    return df.select(*select) if select else df


def normal_symbol(x) -> Column:
    """CODE.EXCH from the usual spellings; the exchange of a bare code by its first digits; what isn't a symbol stays."""
    raw = F.upper(F.trim(F.col(x) if isinstance(x, str) else x))
    code = F.regexp_extract(raw, r"(\d{6})", 1)
    named = F.regexp_extract(raw, r"(XSHG|XSHE|SH|SZ|BJ)", 1)
    exch = F.when(named.isin("SH", "XSHG"), "SH").when(named.isin("SZ", "XSHE"), "SZ").when(named == "BJ", "BJ")
    first = F.substring(code, 1, 1)
    guess = F.when(first.isin("6", "5", "9"), "SH").when(first.isin("0", "2", "3", "1"), "SZ").when(first.isin("4", "8"), "BJ")
    return F.when(code == "", F.col(x) if isinstance(x, str) else x).otherwise(F.concat_ws(".", code, F.coalesce(exch, guess)))


def apply_filters(df: DataFrame, filters: list[str]) -> DataFrame:
    """``f:a|b`` (in), ``f!=a|b`` (not in; nulls stay), ``f~text`` (contains); all must hold, compared as text."""
    for f in filters:
        if "!=" in f:
            name, _, values = f.partition("!=")
            df = df.where(~F.coalesce(F.col(name).cast("string"), F.lit("")).isin(values.split("|")))
        elif "~" in f:
            name, _, part = f.partition("~")
            df = df.where(F.contains(F.col(name).cast("string"), F.lit(part)))
        else:
            name, _, values = f.partition(":")
            df = df.where(F.col(name).cast("string").isin(values.split("|")))
    return df


def apply_sort(df: DataFrame, sort: str) -> DataFrame:
    """``f`` or ``f:desc``; nulls last."""
    name, _, way = sort.partition(":")
    return df.orderBy(F.col(name).desc_nulls_last() if way == "desc" else F.col(name).asc_nulls_last())


def page(df: DataFrame, order: list, offset: int, limit: int) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def values(df: DataFrame, field: str, limit: int = 200) -> DataFrame:
    """Distinct values with counts, the most frequent first."""
    return df.groupBy(field).count().orderBy(F.desc("count"), field).limit(limit)


def rows_at(payload: DataFrame, column: str, path: str, schema: str) -> DataFrame:
    """The array of rows at a dotted path of a JSON column, one row each."""
    return payload.select(F.explode(F.from_json(F.get_json_object(column, f"$.{path}"), f"array<{schema}>")).alias("r")).select("r.*")


def stamp(df: DataFrame, source: str, version: str) -> DataFrame:
    return df.withColumns({"source": F.lit(source), "data_version": F.lit(version), "ingested_at": F.current_timestamp()})


def write_user_table(df: DataFrame, root: str, day: str | None = None) -> None:
    """A snapshot (replaced by symbol) or, with a day, one partition of a time series (replaced by symbol and day)."""
    spark = df.sparkSession
    new = df.dropDuplicates(["symbol"])
    if day is not None:
        new = new.withColumn("date", F.lit(day).cast("date"))
    else:
        new = new.withColumn("date", F.lit("1970-01-01").cast("date"))
    if _exists(spark, root):
        old = spark.read.option("mergeSchema", True).parquet(root)
        if "date" in old.columns:
            old = old.withColumn("date", F.col("date").cast("date"))
        d = new.first()["date"] if not new.isEmpty() else None
        old = old.where(F.col("date") == F.lit(d))
        new = joins.overlay(old, new, ["symbol", "date"])
    _replace(new, root, ["date"])
