"""Text and feed tables: dictionary links, redaction, matching of citations, budgets, roll-ups over a complete grid."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Shapes of credentials and local paths that redaction masks (fixed patterns, applied in order).
SECRETS = (
    (r"sk-[A-Za-z0-9_-]{8,}", "[KEY]"),
    (r"AKIA[0-9A-Z]{16}", "[KEY]"),
    (r"(?i)(password|passwd|token|secret|api[_-]?key)(\s*[:=]\s*)[^\s,;]+", "$1$2[MASKED]"),
    (r"/(?:home|Users|root)/[^\s]+", "[PATH]"),
)


def redact(text) -> Column:
    x = F.col(text) if isinstance(text, str) else text
    for pattern, mask in SECRETS:
        x = F.regexp_replace(x, pattern, mask)
    return x


def normalised(text) -> Column:
    """Lower case without white space and zero-width characters."""
    x = F.col(text) if isinstance(text, str) else text
    return F.lower(F.regexp_replace(x, r"[\s\x{200b}\x{200c}\x{200d}\x{feff}]+", ""))


def link(news: DataFrame, names: DataFrame, *, key: str, text: str) -> DataFrame:
    """Dictionary names that occur as words of a text: (key, codes). The dictionary joins by word, so neither side is sent whole."""
    words = news.select(key, F.explode(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"[^\s]+"), 0))).alias("word"))
    return words.join(names, "word").groupBy(key).agg(F.array_sort(F.collect_set("code")).alias("codes"))


def cited(claims: DataFrame, sources: DataFrame, *, by: str) -> DataFrame:
    """Whether each quote stands in its source: found, absent, or no such source."""
    j = claims.join(sources.select(by, F.col("text").alias("source_text")), by, "left")
    return j.withColumn("status", F.when(F.col("source_text").isNull(), "no source").when(F.contains(normalised("source_text"), normalised("quote")), "found").otherwise("absent")).drop("source_text")


def _words(text: str) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[^\x20\x09-\x0D]+"), 0)


def quoted(quotes: DataFrame, sources: DataFrame, *, item: str, by: str, run: int = 8) -> DataFrame:
    """(item, source) of every source whose words hold all of a quote's words in a row; an item found nowhere has a null source.

    Words are compared in lower case. A quote meets the sources that share the hash of its first ``run`` words by an equi-join
    (of all its words if it has fewer; a pass over the sources for each such length that occurs), then all its words are
    compared. A quote without words is found nowhere. Texts travel only where a hash agrees.
    """
    spaced = lambda w: F.concat(F.lit(" "), F.array_join(w, " "), F.lit(" "))
    q = quotes.select(F.col(item), _words("text").alias("w"))
    lead = F.least(F.size("w"), F.lit(run))
    q = q.select(item, lead.alias("lead"), F.when(lead > 0, F.xxhash64(F.slice("w", 1, lead))).alias("h"), spaced(F.col("w")).alias("quote"))
    s = sources.select(F.col(by), _words("text").alias("w"), spaced(_words("text")).alias("said"))
    # at most ``run`` lengths
    lengths = sorted(r[0] for r in q.where("lead > 0").select("lead").distinct().collect())
    out = q.select(item).distinct()
    if not lengths:
        return out.join(s.select(by).limit(0), F.lit(False), "left")

    def met(n: int) -> DataFrame:
        at = F.sequence(F.lit(1), F.size("w") - (n - 1))
        seen = s.where(F.size("w") >= n).select(by, F.explode(F.array_distinct(F.transform(at, lambda k: F.xxhash64(F.slice("w", k, n))))).alias("h"))
        return seen.join(q.where(F.col("lead") == n).select(item, "h"), "h").select(item, by)

    meet = reduce(DataFrame.unionByName, map(met, lengths)).distinct()
    found = meet.join(q.select(item, "quote"), item).join(s.select(by, "said"), by).where(F.contains("said", "quote")).select(item, by).distinct()
    return out.join(found, item, "left")


def within_budget(df: DataFrame, group: str, order: list, text: str, most: int) -> DataFrame:
    """Rows of each group in order while the bytes so far stay within the budget."""
    size = F.sum(F.octet_length(text)).over(W.partitionBy(group).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return df.withColumn("bytes_so_far", size).where(F.col("bytes_so_far") <= most)


def latency_series(events: DataFrame, *, ts: str, value: str, bad: Column, width: str) -> DataFrame:
    """Fixed buckets over the whole range, empty ones included: count, mean, median, p95, error rate."""
    b = F.window(ts, width)["start"]
    d = events.groupBy(b.alias("bucket")).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.percentile(value, 0.5).alias("p50"), F.percentile(value, 0.95).alias("p95"), F.avg(bad.cast("double")).alias("error_rate"))
    ends = events.agg(F.min(b).alias("a"), F.max(b).alias("z"))
    grid = ends.where("a IS NOT NULL").select(F.explode(F.sequence("a", "z", F.expr(f"INTERVAL {width}"))).alias("bucket"))
    return grid.join(d, "bucket", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def slowest(events: DataFrame, by: str, value: str, bad: Column, n: int) -> DataFrame:
    d = events.groupBy(by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.percentile(value, 0.95).alias("p95"), F.avg(bad.cast("double")).alias("error_rate"))
    return d.orderBy(F.desc("p95"), by).limit(n)


def content_hash(*columns: str) -> Column:
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), 256)
