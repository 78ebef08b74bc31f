"""Queries of dictionary links, outlook statistics, quotes against their sources and user-defined operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import registry
from ..operators import feeds, links, outlook
from . import panel
from .pairs import near, near_sql, query

_N = near_sql
_WORDS = r"[^\s]+"
_NAMES = f"n AS (SELECT name, max(code) AS code FROM (SELECT array_to_string(regexp_extract_all(text, '{_WORDS}')[1:3], ' ') AS name, 'I' || item_id AS code FROM benchmark) WHERE name <> '' GROUP BY 1)"


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three words of each passage name it."""
    b = panel.table(spark, sf_dir, "benchmark")
    words = F.slice(F.regexp_extract_all("text", F.lit(_WORDS), 0), 1, 3)
    return links.dictionary(b.select(F.array_join(words, " ").alias("name"), F.concat(F.lit("I"), F.col("item_id")).alias("symbol")))


@query(
    f"WITH {_NAMES}, p AS (SELECT string_agg(regexp_escape(name), '|' ORDER BY length(name) DESC, name) AS pattern FROM n), h AS (SELECT doc_id, unnest(regexp_extract_all(text, (SELECT pattern FROM p))) AS name FROM documents WHERE text IS NOT NULL) "
    "SELECT doc_id, code, count(*) AS times FROM h JOIN n USING (name) GROUP BY 1, 2"
)
def linked_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages that documents name, and how often; every document against every name."""
    names = _names(spark, sf_dir)
    hits = links.spoken(panel.table(spark, sf_dir, "documents"), names, key="doc_id", text="text")
    return hits.join(names, "name").groupBy("doc_id", "code").agg(F.count("*").alias("times"))


_VALID = "v AS (SELECT user_id AS outlook, event_id // 3 AS item, ts::DATE AS trade_date, ts AS validated_at, event_type AS dimension, 1 + user_id % 5 AS weight, CASE WHEN value > 50 THEN 'correct' WHEN value > 10 THEN 'partial' WHEN value > 2 THEN 'wrong' ELSE 'unknown' END AS verdict FROM events)"


@query(
    f"""WITH {_VALID}, l AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY outlook, item ORDER BY validated_at DESC, verdict DESC) = 1), c AS (SELECT *, CASE verdict WHEN 'correct' THEN 1.0 WHEN 'partial' THEN 0.5 WHEN 'wrong' THEN 0.0 END AS credit FROM l)
SELECT dimension, grouping(dimension) = 1 AS is_total, count(DISTINCT outlook) AS outlooks, count(*) AS items, count(credit) AS judged, count(*) FILTER (verdict = 'correct') AS correct, count(*) FILTER (verdict = 'partial') AS partial, count(*) FILTER (verdict = 'wrong') AS wrong, count(*) FILTER (credit IS NULL) AS unverified,
  coalesce(sum(weight) FILTER (credit IS NOT NULL), 0)::DOUBLE AS judged_weight, sum(weight)::DOUBLE AS total_weight, {_N('100 * sum(credit * weight) / nullif(sum(weight) FILTER (credit IS NOT NULL), 0)')} AS score, {_N('coalesce(sum(weight) FILTER (credit IS NOT NULL), 0) / sum(weight)')} AS coverage
FROM c GROUP BY GROUPING SETS ((dimension), ())"""
)
def outlook_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit rates, score and coverage by dimension and over all, from each item's newest validation."""
    e = panel.table(spark, sf_dir, "events")
    v = F.col("value")
    verdict = F.when(v > 50, "correct").when(v > 10, "partial").when(v > 2, "wrong").otherwise("unknown")
    made = e.select(F.col("user_id").alias("outlook"), F.floor(F.col("event_id") / 3).alias("item"), F.to_date("ts").alias("trade_date"), F.col("ts").alias("validated_at"), F.col("event_type").alias("dimension"), (1 + F.col("user_id") % 5).alias("weight"), verdict.alias("verdict"))
    d = outlook.outlook_stats(made)
    return d.withColumns({c: near(F.col(c)) for c in ("score", "coverage")})


_PLAIN = r"lower(regexp_replace({}, '[\s\x{{200b}}\x{{200c}}\x{{200d}}\x{{feff}}]+', '', 'g'))"


@query(
    f"""WITH c AS (SELECT doc_id AS claim, doc_id + doc_id % 2 * 3 AS src, substr(text, 11, 40) AS quote FROM documents)
SELECT claim, CASE WHEN d.text IS NULL THEN 'no source' WHEN quote IS NOT NULL AND contains({_PLAIN.format('d.text')}, {_PLAIN.format('quote')}) THEN 'found' ELSE 'absent' END AS status FROM c LEFT JOIN documents d ON d.doc_id = src"""
)
def cited_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each document's quote stands in the one it cites; every second cites another."""
    d = panel.table(spark, sf_dir, "documents")
    claims = d.select(F.col("doc_id").alias("claim"), (F.col("doc_id") + F.col("doc_id") % 2 * 3).alias("src"), F.substring("text", 11, 40).alias("quote"))
    return feeds.cited(claims, d.select(F.col("doc_id").alias("src"), "text"), by="src").select("claim", "status")


# user-defined operators


@registry.operator("close_place", "TS", min_window=2, label="where the close lies between the window's extremes")
def close_place(x, n: int):
    ts_max, ts_min = (registry.OPERATORS[k].make(x, n) for k in ("ts_max", "ts_min"))
    return F.try_divide(F.col(x) - ts_min, ts_max - ts_min)


_W = "(PARTITION BY symbol ORDER BY trade_date ROWS 5 PRECEDING)"


@query(f"WITH {panel.BARS} SELECT symbol, trade_date, {_N(f'CASE WHEN count(close) OVER {_W} = 6 AND max(close) OVER {_W} > min(close) OVER {_W} THEN (close - min(close) OVER {_W}) / (max(close) OVER {_W} - min(close) OVER {_W}) END')} AS place FROM bars")
def user_operator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An operator of the user's own, made of built-in ones and called by its name."""
    d = registry.apply(panel.bars(spark, sf_dir), place=("close_place", "close", 6))
    return d.select("symbol", "trade_date", near(F.col("place")).alias("place"))


@query(f"WITH {panel.BARS}, l AS (SELECT symbol, trade_date, CASE WHEN count(close) OVER w = 6 THEN list(close) OVER w END AS v FROM bars WINDOW w AS {_W}) SELECT symbol, trade_date, {_N('list_avg(list_transform(v, lambda x: abs(x - list_median(v))))')} AS spread FROM l")
def window_callback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean distance from the window's median, by a callback over the values of many windows."""
    spread = registry.windowed(lambda m: np.abs(m - np.median(m, axis=1, keepdims=True)).mean(axis=1), many=True)
    return panel.bars(spark, sf_dir).select("symbol", "trade_date", near(spread("close", 6)).alias("spread"))


@query(f"WITH {panel.BARS}, b AS (SELECT symbol, low, high, volume, unnest(range(floor(low / 100)::BIGINT, floor(high / 100)::BIGINT + 1)) AS bin FROM bars) SELECT symbol, bin::INT AS bin, {_N('sum(volume / (floor(high / 100) - floor(low / 100) + 1))')} AS volume FROM b GROUP BY 1, 2")
def price_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volume by symbol and price step, dealt by a generator; a symbol's bars are together, so its bins are summed where they are made."""
    made = registry.price_bins(panel.bars(spark, sf_dir), "low", "high", "volume", 100.0)
    return made.groupBy("symbol", "bin").agg(F.sum("part").alias("volume")).withColumn("volume", near(F.col("volume")))
