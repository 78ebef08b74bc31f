"""Stateful streams: alert noise suppression, stale quotes, late snapshots against final rows.

Each keeps a small state by key, with timers on event time that drop it again; state needs the RocksDB store (see
``store``). The fold over a key's rows is a plain function, which the batch form runs too.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

SEVERITIES = ("info", "warning", "critical")
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def store(spark: SparkSession) -> None:
    """Use the store that keyed state with timers asks for."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)


def _frame(rows: list, schema: T.StructType) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=schema.names)


def severity_rank(severity) -> Column:
    """0 for info and what isn't known, 1 for warning, 2 for critical."""
    s = F.lower(F.trim(F.col(severity) if isinstance(severity, str) else severity))
    return F.when(s == "critical", 2).when(s == "warning", 1).otherwise(0)


def in_quiet_hours(ts: str, hours: str | None, tz: str = "UTC") -> Column:
    """Whether the local time lies in ``"HH:MM-HH:MM"``, both ends included; the span may pass midnight.

    A span that can't be read is none: a mistake in it silences nothing.
    """
    try:
        a, b = ([int(x) for x in part.strip().split(":")] for part in (hours or "").split("-", 1))
        (h1, m1), (h2, m2) = a, b
        if not all(0 <= h <= 23 and 0 <= m <= 59 for h, m in ((h1, m1), (h2, m2))):
            raise ValueError(hours)
    except ValueError:
        return F.lit(False)
    local = F.from_utc_timestamp(F.to_utc_timestamp(F.col(ts), F.current_timezone()), tz)
    second = F.hour(local) * 3600 + F.minute(local) * 60 + F.second(local)
    start, end = h1 * 3600 + m1 * 60, h2 * 3600 + m2 * 60
    return (second >= start) & (second <= end) if start <= end else (second >= start) | (second <= end)


def _decide(rows: pd.DataFrame, last: float | None, seen: dict[str, float], cooldown: float, ttl: float) -> tuple[list, float | None]:
    """Why each row (at, digest; in event order) is silent, None where it is sent; ``seen`` and the last time sent move on."""
    reasons = []
    for at, digest in zip(rows["at"], rows["digest"], strict=True):
        if cooldown > 0 and last is not None and at - last < cooldown:
            reasons.append("cooldown")
        elif ttl > 0 and digest in seen and at - seen[digest] < ttl:
            reasons.append("dedup")
        else:
            reasons.append(None)
            last, seen[digest] = at, at
    return reasons, last


class _Suppress(StatefulProcessor):
    def __init__(self, cooldown: float, ttl: float, schema: T.StructType):
        self.cooldown, self.ttl, self.schema = cooldown, ttl, schema

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at double")
        self.seen = handle.getMapState("seen", "digest string", "at double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        got = pd.concat(list(rows)).sort_values(["at", "digest"], kind="stable")
        last = self.last.get()[0] if self.last.exists() else None
        seen = {k[0]: v[0] for k, v in self.seen.iterator()}
        before = dict(seen)
        reasons, last = _decide(got, last, seen, self.cooldown, self.ttl)
        if last is not None:
            self.last.update((last,))
        for digest, at in seen.items():
            if before.get(digest) != at:
                self.seen.updateValue((digest,), (at,))
                self.handle.registerTimer(int((at + self.ttl) * 1000) + 1)
        yield got.assign(reason=reasons)[self.schema.names]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs() / 1000
        for digest, at in [(k[0], v[0]) for k, v in self.seen.iterator()]:
            if at + self.ttl <= now:
                self.seen.removeKey((digest,))
        yield _frame([], self.schema)

    def close(self) -> None:
        pass


def _judged(alerts: DataFrame, ts: str, channel: str, title: str, text: str, severity: str, least: str | None, quiet: str | None, tz: str) -> DataFrame:
    rank = severity_rank(severity)
    low = rank < (SEVERITIES.index(least) if least in SEVERITIES else 0)
    reason = F.when(low, "min_severity").when((rank < 2) & in_quiet_hours(ts, quiet, tz), "quiet_hours")
    digest = F.sha1(F.concat(F.coalesce(title, F.lit("")), F.lit("|"), F.coalesce(text, F.lit(""))))
    return alerts.withColumns({"channel": F.coalesce(F.col(channel).cast("string"), F.lit("")), "at": F.unix_micros(ts) / 1e6, "digest": digest, "reason": reason})


def suppressed(alerts: DataFrame, *, ts: str, channel: str = "channel", title: str = "title", text: str = "text", severity: str = "severity", least: str | None = None, quiet: str | None = None, tz: str = "UTC", cooldown: float = 0, ttl: float = 0, late: str = "10 minutes") -> DataFrame:
    """``alerts`` with channel, at, digest and reason: why one is silent, null where it is sent.

    In this order: below the ``least`` severity (min_severity); in ``quiet`` hours, unless critical (quiet_hours); within
    ``cooldown`` seconds of the channel's last alert sent (cooldown); within ``ttl`` seconds of the same title and text sent
    (dedup). The first two need no state. A channel's rows of a batch are taken in event order; its state is the last time
    sent and a time by digest, dropped ``ttl`` seconds later when the watermark gets there. On a table it runs as a batch.
    """
    d = _judged(alerts, ts, channel, title, text, severity, least, quiet, tz)
    if not alerts.isStreaming:
        return _suppressed_batch(d, cooldown, ttl)
    store(alerts.sparkSession)
    d = d.withWatermark(ts, late)
    silent, rest = d.where("reason IS NOT NULL"), d.where("reason IS NULL")
    schema = d.schema
    loud = rest.groupBy("channel").transformWithStateInPandas(_Suppress(cooldown, ttl, schema), schema, "append", "eventTime")
    return silent.unionByName(loud)


def _suppressed_batch(d: DataFrame, cooldown: float, ttl: float) -> DataFrame:
    schema = d.schema

    def each(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["at", "digest"], kind="stable")
        return pdf.assign(reason=_decide(pdf, None, {}, cooldown, ttl)[0])[schema.names]

    return d.where("reason IS NOT NULL").unionByName(d.where("reason IS NULL").groupBy("channel").applyInPandas(each, schema))


def _since(rows: pd.DataFrame, held: tuple | None, age: float) -> tuple[list, tuple | None]:
    """Whether each quote (at, last, volume; in event order) has stood for more than ``age`` seconds; the quote held and since when."""
    out = []
    for at, last, volume in zip(rows["at"], rows["held_last"], rows["held_volume"], strict=True):
        if held is None or (last, volume) != held[:2]:
            held = (last, volume, at)
        out.append(at - held[2] > age)
    return out, held


class _Stale(StatefulProcessor):
    def __init__(self, age: float, forget: float, schema: T.StructType):
        self.age, self.forget, self.schema = age, forget, schema

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "last double, volume double, since double, seen double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        got = pd.concat(list(rows)).sort_values("at", kind="stable")
        held = tuple(self.held.get()[:3]) if self.held.exists() else None
        flags, held = _since(got, held, self.age)
        seen = float(got["at"].iat[-1])
        self.held.update((*held, seen))
        self.handle.registerTimer(int((seen + self.forget) * 1000))
        yield got.assign(is_stale=flags)[self.schema.names]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.held.exists() and self.held.get()[3] + self.forget <= expiredTimerInfo.getExpiryTimeInMs() / 1000 + 1e-3:
            self.held.clear()
        yield _frame([], self.schema)

    def close(self) -> None:
        pass


def stale(quotes: DataFrame, *, symbol: str, ts: str, last: str, volume: str, age: float, forget: float = 86_400, late: str = "10 minutes") -> DataFrame:
    """``quotes`` with at and is_stale: price and volume have both stood still for more than ``age`` seconds.

    A missing price or volume is a value like another (-1). State is the quote held, since when, and when it was last
    seen; a symbol that is silent for ``forget`` seconds is forgotten. On a table it is two windows.
    """
    d = quotes.withColumns({"at": F.unix_micros(ts) / 1e6, "held_last": F.coalesce(F.col(last).cast("double"), F.lit(-1.0)), "held_volume": F.coalesce(F.col(volume).cast("double"), F.lit(-1.0)), "is_stale": F.lit(False)})
    if not quotes.isStreaming:
        from pyspark.sql import Window as W

        w = W.partitionBy(symbol).orderBy("at")
        new = F.lag("at").over(w).isNull() | (F.lag("held_last").over(w) != F.col("held_last")) | (F.lag("held_volume").over(w) != F.col("held_volume"))
        d = d.withColumn("__new", F.when(new, F.col("at")))
        since = F.max("__new").over(w.rowsBetween(W.unboundedPreceding, 0))
        return d.withColumn("is_stale", F.col("at") - since > age).drop("held_last", "held_volume", "__new")
    store(quotes.sparkSession)
    made = d.withWatermark(ts, late).groupBy(symbol).transformWithStateInPandas(_Stale(age, forget, d.schema), d.schema, "append", "eventTime")
    return made.drop("held_last", "held_volume")


class _Settle(StatefulProcessor):
    def __init__(self, keep: float, schema: T.StructType):
        self.keep, self.schema = keep, schema

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.final = handle.getValueState("final", "at double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        got = pd.concat(list(rows))
        done = got["is_final"].astype(bool)
        if done.any():
            at = float(got.loc[done, "at"].max())
            self.final.update((at,))
            self.handle.registerTimer(int((at + self.keep) * 1000))
        settled = self.final.exists()
        yield got.assign(is_late=~done & settled)[self.schema.names]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.final.exists() and self.final.get()[0] + self.keep <= expiredTimerInfo.getExpiryTimeInMs() / 1000 + 1e-3:
            self.final.clear()
        yield _frame([], self.schema)

    def close(self) -> None:
        pass


def settled(rows: DataFrame, *, keys: tuple[str, ...], ts: str, final: str = "is_final", keep: float = 7 * 86_400, late: str = "10 minutes") -> DataFrame:
    """``rows`` with at, is_final and is_late: a snapshot that comes with or after its key's final row is late.

    Final rows replace each other. A key's state, the time of its final row, is dropped ``keep`` seconds after that. On a
    table all rows come at once, so every snapshot of a key with a final row is late.
    """
    d = rows.withColumns({"at": F.unix_micros(ts) / 1e6, "is_final": F.coalesce(F.col(final).cast("boolean"), F.lit(False)), "is_late": F.lit(False)})
    if not rows.isStreaming:
        from pyspark.sql import Window as W

        return d.withColumn("is_late", ~F.col("is_final") & F.max("is_final").over(W.partitionBy(*keys)))
    store(rows.sparkSession)
    return d.withWatermark(ts, late).groupBy(*keys).transformWithStateInPandas(_Settle(keep, d.schema), d.schema, "append", "eventTime")


def settle_each(root: str, side: str, keys: list[str]):
    """A foreachBatch function: rows that aren't late go over the lake at ``root`` by key, a final row before any snapshot
    and of others the newest; late ones are kept at ``side``, by batch, so that repeating a batch changes nothing."""
    from pyspark.sql import Window as W

    from ..sources import lake

    def put(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        order = W.partitionBy(*keys).orderBy(F.desc("is_final"), F.desc("at"))
        best = batch.where("NOT is_late").withColumn("__k", F.row_number().over(order)).where("__k = 1").drop("__k", "is_late", "at")
        if not best.isEmpty():
            lake.write_daily(best, root, tuple(keys))
        late = batch.where("is_late")
        if not late.isEmpty():
            late.write.mode("overwrite").parquet(f"{side}/batch={number}")
        batch.unpersist()

    return put
