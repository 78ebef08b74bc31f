"""Stateful streams equal their batch form, across restarts."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tessera.sources import lake
from tessera.streaming import alerting as A

T0 = dt.datetime(2024, 1, 1, 10)
at = lambda s: T0 + dt.timedelta(seconds=s)
ALERTS = "ts timestamp, channel string, title string, text string, severity string"
ROWS = [
    (at(0), "a", "x", "1", "info"), (at(10), "a", "y", "1", "warning"), (at(70), "a", "x", "1", "critical"), (at(200), "a", "x", "1", "info"), (at(201), "b", "x", "1", "INFO "),
    (at(700), "a", "x", "1", "info"), (at(800), "a", None, None, "debug"), (at(13 * 3600), "a", "n", "", "warning"), (at(13 * 3600 + 1), "c", "n", "", "critical"), (at(14 * 3600), "a", "n", "", None),
]
HOW = dict(ts="ts", quiet="23:00-08:00", cooldown=60, ttl=500)


def feed(spark, root, parts, schema):
    """Files, one after the other, and a stream that reads one at a time."""
    import time

    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(root)
        time.sleep(0.05)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(root)


def drain(df, where):
    q = df.writeStream.format("parquet").outputMode("append").option("path", f"{where}/out").option("checkpointLocation", f"{where}/cp").trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert q.exception() is None
    return df.sparkSession.read.schema(df.schema).parquet(f"{where}/out")


def reasons(df):
    return sorted((r["ts"], r["channel"], r["reason"]) for r in df.collect())


def naive(rows, least=0):
    rank = {"warning": 1, "critical": 2}
    last, seen, out = {}, {}, []
    for ts, channel, title, text, severity in rows:
        k, s = (channel, title or "", text or ""), (ts - T0).total_seconds()
        level = rank.get((severity or "").strip().lower(), 0)
        if level < least:
            r = "min_severity"
        elif level < 2 and (ts.hour >= 23 or ts.hour < 8 or (ts.hour, ts.minute, ts.second) == (8, 0, 0)):
            r = "quiet_hours"
        elif channel in last and s - last[channel] < 60:
            r = "cooldown"
        elif k in seen and s - seen[k] < 500:
            r = "dedup"
        else:
            r, last[channel], seen[k] = None, s, s
        out.append((ts, channel, r))
    return sorted(out)


def test_suppression_in_batch(spark):
    df = spark.createDataFrame(ROWS, ALERTS).repartition(3)
    assert reasons(A.suppressed(df, **HOW)) == naive(ROWS)
    assert reasons(A.suppressed(df, least="warning", **HOW)) == naive(ROWS, 1)
    assert {r for *_, r in naive(ROWS, 1)} == {None, "min_severity", "quiet_hours"}
    assert {r for *_, r in naive(ROWS)} == {None, "quiet_hours", "cooldown", "dedup"}
    assert {r["reason"] for r in A.suppressed(df, ts="ts", quiet="25:00-8", cooldown=0, ttl=0).collect()} == {None}
    assert A.suppressed(df.limit(0), **HOW).count() == 0


def test_suppression_as_a_stream_with_a_restart(spark, tmp_path):
    root = f"{tmp_path}/in"
    drain(A.suppressed(feed(spark, root, [ROWS[:2], ROWS[2:4]], ALERTS), **HOW), tmp_path)
    got = drain(A.suppressed(feed(spark, root, [ROWS[4:7], ROWS[7:]], ALERTS), **HOW), tmp_path)
    assert reasons(got) == naive(ROWS)


QUOTES = "ts timestamp, symbol string, last double, volume double"


def test_stale_quotes_stream_equals_batch(spark, tmp_path):
    rows = [(at(0), "a", 1.0, 5.0), (at(30), "a", 1.0, 5.0), (at(90), "a", 1.0, 5.0), (at(95), "a", 1.0, 6.0), (at(200), "a", 1.0, 6.0), (at(200), "b", None, 1.0), (at(300), "b", None, 1.0), (at(301), "b", 2.0, 1.0), (at(390), "b", 2.0, None)]
    how = dict(symbol="symbol", ts="ts", last="last", volume="volume", age=60)
    df = spark.createDataFrame(rows, QUOTES)
    key = lambda d: sorted((r["symbol"], r["ts"], r["is_stale"]) for r in d.collect())
    batch = key(A.stale(df, **how))
    assert [b for *_, b in batch] == [False, False, True, False, True, False, True, False, False]
    got = drain(A.stale(feed(spark, f"{tmp_path}/in", [rows[:2], rows[2:6], rows[6:]], QUOTES), **how), tmp_path)
    assert key(got) == batch


DAYS = "symbol string, trade_date date, ts timestamp, close double, is_final boolean, quality_flags int, source string"


def test_late_snapshots_go_aside(spark, tmp_path):
    d = dt.date(2024, 1, 1)
    row = lambda s, sec, close, final: (s, d, at(sec), close, final, 0, "x")
    parts = [[row("a", 0, 1.0, False), row("b", 1, 5.0, False)], [row("a", 10, 2.0, True), row("b", 12, 6.0, None)], [row("a", 11, 9.0, False), row("a", 13, 2.5, True)], [row("a", 14, 9.5, False), row("b", 20, 7.0, False)]]
    stream = A.settled(feed(spark, f"{tmp_path}/in", parts, DAYS), keys=("symbol", "trade_date"), ts="ts")
    q = stream.writeStream.foreachBatch(A.settle_each(f"{tmp_path}/lake", f"{tmp_path}/side", ["symbol", "trade_date"])).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert q.exception() is None
    assert {r["symbol"]: r["close"] for r in lake.read_daily(spark, f"{tmp_path}/lake").collect()} == {"a": 2.5, "b": 7.0}
    assert sorted(r["close"] for r in spark.read.parquet(f"{tmp_path}/side").collect()) == [9.0, 9.5]
    whole = A.settled(spark.createDataFrame([r for p in parts for r in p], DAYS), keys=("symbol", "trade_date"), ts="ts")
    best = whole.where("NOT is_late").groupBy("symbol").agg(F.max_by("close", F.struct("is_final", "at")).alias("close"))
    assert {r["symbol"]: r["close"] for r in best.collect()} == {"a": 2.5, "b": 7.0}


@pytest.mark.parametrize(("hours", "quiet"), [("09:00-10:00", True), ("10:00-09:00", True), ("11:00-12:00", False), ("23:00-24:00", False), ("x", False), (None, False), ("10:00-10:00", True)])
def test_quiet_hours(spark, hours, quiet):
    df = spark.createDataFrame([(T0,)], "ts timestamp")
    assert df.select(A.in_quiet_hours("ts", hours)).head()[0] is quiet
