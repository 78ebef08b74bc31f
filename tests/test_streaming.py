"""Streamed results equal batch results on complete input."""

import datetime as dt

from pyspark.sql import functions as F

from tessera.streaming import rollups

T0 = dt.datetime(2024, 1, 1, 10)


def feed(spark, tmp_path, rows, schema):
    """A file stream with one file per batch of rows."""
    for k, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        del k
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")


def drain(df, tmp_path, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name).collect()


SCHEMA = "ts timestamp, key string, value double"


def test_tumbling_equals_batch(spark, tmp_path):
    rows = [(T0 + dt.timedelta(seconds=7 * i), f"k{i % 3}", float(i)) for i in range(100)]
    end = [(T0 + dt.timedelta(hours=2), "end", 0.0)]
    stream = feed(spark, tmp_path, [rows[:50], rows[50:], end, end], SCHEMA)
    bad = F.col("value") % 2 == 0
    got = {(r["bucket"], r["n"], r["mean"], r["p95"], r["error_rate"]) for r in drain(rollups.tumbling(stream, ts="ts", value="value", bad=bad), tmp_path, "tumbling")}
    batch = rollups.tumbling(spark.createDataFrame(rows, SCHEMA), ts="ts", value="value", bad=bad).collect()
    assert got == {tuple(r) for r in batch}


def test_deduplication(spark, tmp_path):
    rows = [(T0, "a", 1.0), (T0 + dt.timedelta(seconds=1), "a", 1.0), (T0 + dt.timedelta(seconds=2), "b", 1.0)]
    stream = feed(spark, tmp_path, [rows[:1], rows[1:]], SCHEMA)
    got = drain(rollups.deduplicated(stream, ["key"], ts="ts"), tmp_path, "dedup")
    assert sorted(r["key"] for r in got) == ["a", "b"]


def test_presence(spark, tmp_path):
    at = lambda m: T0 + dt.timedelta(minutes=m)
    rows = [(at(0), "p", 1.0), (at(3), "p", 1.0), (at(20), "p", 1.0)]
    stream = feed(spark, tmp_path, [rows, [(at(300), "end", 0.0)], [(at(301), "end", 0.0)]], SCHEMA)
    got = {(r["online"], r["offline"], r["samples"]) for r in drain(rollups.presence(stream, "key", ts="ts"), tmp_path, "presence") if r["key"] == "p"}
    assert got == {(at(0), at(8), 2), (at(20), at(25), 1)}


def test_alerts_cool_down(spark, tmp_path):
    at = lambda s: T0 + dt.timedelta(seconds=s)
    ticks = [(at(0), "A", 11.0), (at(10), "A", 12.0), (at(70), "A", 12.0), (at(75), "A", None), (at(80), "B", 99.0)]
    stream = feed(spark, tmp_path, [ticks[:2], ticks[2:]], SCHEMA)
    rules = spark.createDataFrame([(1, "A", "above", 10.0), (2, "B", "below", 10.0)], "rule_id long, key string, kind string, level double")
    got = drain(rollups.alerts(stream, rules, symbol="key", ts="ts", price="value", cooldown=60), tmp_path, "alerts")
    assert sorted((r["rule_id"], r["ts"], r["verdict"]) for r in got) == [(1, at(0), "hit"), (1, at(70), "hit"), (1, at(75), "error")]


def test_session_hours(spark):
    df = spark.createDataFrame([(T0,), (T0 + dt.timedelta(hours=6),)], "ts timestamp")
    assert [r[0] for r in df.select(rollups.in_session("ts")).collect()] == [True, False]
