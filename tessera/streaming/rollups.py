"""Streaming roll-ups, de-duplication, enrichment, presence and alerts; each equals its batch form on complete input."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def tumbling(events: DataFrame, *, ts: str, value: str, bad: Column, width: str = "60 seconds", late: str = "10 minutes", by: tuple[str, ...] = ()) -> DataFrame:
    """Count, mean, p95 (approximate) and error rate per bucket, final when the watermark passes it."""
    d = events.withWatermark(ts, late).groupBy(F.window(ts, width), *by)
    out = d.agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.percentile_approx(value, 0.95, 10_000).alias("p95"), F.avg(bad.cast("double")).alias("error_rate"))
    return out.select(F.col("window.start").alias("bucket"), *by, "n", "mean", "p95", "error_rate")


def sliding(events: DataFrame, *, ts: str, value: str, width: str = "300 seconds", step: str = "30 seconds", late: str = "10 minutes") -> DataFrame:
    d = events.withWatermark(ts, late).groupBy(F.window(ts, width, step)).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))
    return d.select(F.col("window.start").alias("start"), "n", "mean")


def deduplicated(events: DataFrame, keys: list[str], *, ts: str, late: str = "10 minutes") -> DataFrame:
    """The first row of each key; state is dropped behind the watermark."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def presence(events: DataFrame, key: str, *, ts: str, gap: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of a key: online from the first sample until ``gap`` after the last."""
    d = events.withWatermark(ts, late).groupBy(F.session_window(ts, gap), key).agg(F.count("*").alias("samples"))
    return d.select(key, F.col("session_window.start").alias("online"), F.col("session_window.end").alias("offline"), "samples")


def enriched(events: DataFrame, static: DataFrame, key: str) -> DataFrame:
    return events.join(static, key, "left")


def in_session(ts: str, start: str = "09:30", end: str = "15:00") -> Column:
    clock = F.date_format(ts, "HH:mm")
    return (clock >= start) & (clock < end)


def alerts(ticks: DataFrame, rules: DataFrame, *, symbol: str, ts: str, price: str, cooldown: int, late: str = "10 minutes") -> DataFrame:
    """Hits of price rules (rule_id, symbol, kind above or below, level), silent for ``cooldown`` seconds after one.

    State is the event time of a rule's last hit. Ticks of a batch are taken in event order; a tick older than the last
    hit is silent. A missing price gives an error row, not silence.
    """
    j = ticks.withWatermark(ts, late).join(F.broadcast(rules), symbol)
    p = F.col(price)
    verdict = F.when(p.isNull(), "error").when((F.col("kind") == "above") & (p > F.col("level")), "hit").when((F.col("kind") == "below") & (p < F.col("level")), "hit")
    hits = j.select("rule_id", symbol, F.col(ts).alias("ts"), p.cast("double").alias("price"), verdict.alias("verdict")).where("verdict IS NOT NULL")

    def quiet(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        got = pd.concat(list(batches)).sort_values("ts", kind="stable")
        out = []
        for row in got.itertuples(index=False):
            at = row.ts.timestamp()
            if row.verdict == "error":
                out.append(row)
            elif last is None or at >= last + cooldown:
                out.append(row)
                last = at
        if last is not None:
            state.update((last,))
        yield pd.DataFrame(out, columns=got.columns)

    kind = dict(hits.dtypes)[symbol]
    return hits.groupBy("rule_id").applyInPandasWithState(quiet, f"rule_id long, {symbol} {kind}, ts timestamp, price double, verdict string", "last double", "append", GroupStateTimeout.NoTimeout)


def upsert_each(root: str, keys: list[str]):
    """A foreachBatch function that lays each batch over the lake; repeating a batch changes nothing."""
    from ..sources import lake

    def put(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            lake.write_daily(batch.dropDuplicates(keys), root, tuple(keys))

    return put
