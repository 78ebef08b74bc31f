"""Mixing sources by temperature: token shares to a power, found by bisection, realised as block permutations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import beside, clean_text, stage

#: Exponents are multiples of 1/GRID; each pass over the source table narrows the range WIDTH-fold.
GRID, WIDTH = 1024, 32


def n_tokens(text: str = "text") -> Column:
    """Tokens, measured as words between ASCII white space."""
    return F.regexp_count(clean_text(text), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def shares(docs: DataFrame, text: str, source: str) -> DataFrame:
    """A row per source: tokens. Sources without any have no share."""
    return docs.groupBy(F.coalesce(F.col(source).cast("string"), F.lit("")).alias("src")).agg(F.sum(n_tokens(text)).alias("t"))


def find_exponent(src: DataFrame, *, max_repetition: float | None, target_entropy: float | None, budget: float | None) -> tuple[float, float, float]:
    """(exponent, sum of powered shares, budget in tokens).

    With ``max_repetition`` the smallest exponent at which no source is read more often; with ``target_entropy`` (a part
    of the most there can be, 0 to 1) the largest at which the mix has it. Both conditions are monotone, so each pass
    evaluates WIDTH exponents in one aggregation over the staged source table and keeps one interval.
    """
    have = src.where("t > 0")
    total, n, least, most = have.agg(F.sum("t"), F.count("*"), F.min("t"), F.max("t")).first()
    if not n:
        return 1.0, 1.0, 0.0
    p = F.col("t") / F.lit(float(total))
    lowest, highest = least / total, most / total

    def powered(ks: list[int]) -> list[tuple[float, float]]:
        row = have.agg(*[x for k in ks for x in (F.sum(F.pow(p, F.lit(k / GRID))), F.sum(F.pow(p, F.lit(k / GRID)) * F.log(p)))]).first()
        return list(zip(row[::2], row[1::2], strict=True))

    def good(k: int, z: float, e: float) -> bool:
        """True from some exponent on."""
        import math

        a = k / GRID
        if target_entropy is not None:
            return math.log(z) - a * e / z < target_entropy * math.log(n) - 1e-12
        reads = lowest ** (a - 1) * (highest ** (1 - a) if budget is None else budget / total / z)
        return reads <= max_repetition + 1e-12

    lo, hi = -1, GRID  # not good at lo; taken as good at hi
    while hi - lo > 1:
        ks = sorted({lo + 1 + (hi - lo - 1) * j // WIDTH for j in range(WIDTH)} - {hi})
        for k, (z, e) in zip(ks, powered(ks), strict=True):
            if good(k, z, e):
                hi = k
                break
            lo = k
    k = max(0, hi - 1) if target_entropy is not None else hi
    ((z, _),) = powered([k])
    a = k / GRID
    return a, z, budget if budget is not None else total * z * highest ** (1 - a)


@beside("n_tokens", "epoch", "block")
def mix(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", source: str = "source", max_repetition: float | None = 2.0, target_entropy: float | None = None, budget: float | None = None) -> DataFrame:
    """Rows of ``docs``, each as often as its source's weight asks; adds ``n_tokens``, ``epoch`` (from 1) and ``block``.

    A source's weight is its token share to the power found by ``find_exponent``, normalised. Its token budget is that
    weight times ``budget``; without one, the least at which every document is read at least once. Whole passes over a
    source come first; the last one takes its 4096 blocks (by a hash of the document) in an order permuted by source and
    pass, and of the block on the border its documents in hash order as long as they fit. No window is wider than the
    blocks of a source or the documents of a block.

    Null sources are one source '', null texts have no tokens; documents of a source without tokens are read once. An
    empty table gives an empty table. Repeated rows count as many times. The caller's columns stay: where one has the name
    of an added one, the added one has an underscore behind it.
    """
    src = stage(shares(docs, text, source), "mix-sources")
    a, z, budget = find_exponent(src, max_repetition=max_repetition, target_entropy=target_entropy, budget=budget)
    total = F.lit(float(src.agg(F.sum("t")).first()[0] or 1))
    quota = F.pow(F.col("t") / total, F.lit(a)) / F.lit(z) * F.lit(budget)
    weights = src.select(
        "src",
        F.when(F.col("t") > 0, F.floor(quota / F.col("t") + 1e-9)).otherwise(1).cast("long").alias("full"),
        F.when(F.col("t") > 0, F.greatest(F.lit(0.0), quota - F.floor(quota / F.col("t") + 1e-9) * F.col("t"))).otherwise(0.0).alias("rest"),
    )
    rows = docs.withColumns({"__mx_src": F.coalesce(F.col(source).cast("string"), F.lit("")), "n_tokens": n_tokens(text)})
    rows = rows.withColumn("__mx_key", F.md5(F.concat_ws("/", F.col("__mx_src"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))))
    rows = rows.withColumn("block", F.substring("__mx_key", 1, 3))
    order = F.md5(F.concat_ws(":", F.col("src"), (F.col("full") + 1).cast("string"), F.col("block")))
    before = F.sum("bt").over(W.partitionBy("src").orderBy(order, "block").rowsBetween(W.unboundedPreceding, -1))
    blocks = (
        rows.groupBy(F.col("__mx_src").alias("src"), "block")
        .agg(F.sum("n_tokens").alias("bt"))
        .join(weights, "src")
        .withColumn("left", F.col("rest") - F.coalesce(before, F.lit(0)))
        .select(F.col("src").alias("__mx_src"), "block", F.col("full").alias("__mx_full"), F.col("left").alias("__mx_left"))
    )
    blocks = stage(blocks, "mix-blocks")
    inside = W.partitionBy("__mx_src", "block").orderBy("__mx_key").rowsBetween(W.unboundedPreceding, 0)
    taken = F.sum("n_tokens").over(inside) <= F.col("__mx_left")
    return (
        rows.join(blocks, ["__mx_src", "block"])
        .withColumn("__mx_copies", F.col("__mx_full") + F.when((F.col("__mx_left") > 0) & taken, 1).otherwise(0))
        .where("__mx_copies > 0")
        .withColumn("epoch", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__mx_copies"))))
        .select(*docs.columns, "n_tokens", "epoch", "block")
    )


def oracle(max_repetition: float = 2.0, docs: str = "documents", columns: str = "doc_id, source, n_tokens, epoch, block") -> str:
    """The same in DuckDB SQL, for a repetition limit and the least budget; ids and sources without nulls."""
    return f"""
WITH d AS (
  SELECT *, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n_tokens, md5(source || '/' || doc_id) AS key FROM {docs}
), src AS (SELECT source, sum(n_tokens) AS t FROM d GROUP BY source
), tot AS (SELECT sum(t)::DOUBLE AS total, min(t) AS least, max(t) AS most FROM src WHERE t > 0
), k AS (
  SELECT coalesce(min(k), {GRID}) / {GRID}.0::DOUBLE AS a FROM range({GRID + 1}) r(k), tot
  WHERE pow(most::DOUBLE / least, 1 - k / {GRID}.0::DOUBLE) <= {max_repetition} + 1e-12
), z AS (SELECT sum(pow(t / total, a)) AS z FROM src, tot, k WHERE t > 0
), q AS (SELECT source, t, pow(t / total, a) / z * (total * z * pow(most / total, 1 - a)) AS quota FROM src, tot, k, z
), w AS (
  SELECT source, CASE WHEN t > 0 THEN floor(quota / t + 1e-9)::BIGINT ELSE 1 END AS full_,
         CASE WHEN t > 0 THEN greatest(0, quota - floor(quota / t + 1e-9) * t) ELSE 0 END AS rest FROM q
), b AS (
  SELECT source, substr(key, 1, 3) AS block, sum(n_tokens) AS bt FROM d GROUP BY 1, 2
), p AS (
  SELECT b.source, block, full_, rest - coalesce(sum(bt) OVER (PARTITION BY b.source ORDER BY md5(b.source || ':' || (full_ + 1) || ':' || block), block
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_ FROM b JOIN w ON b.source = w.source
), c AS (
  SELECT d.*, block, full_ + CASE WHEN left_ > 0 AND sum(n_tokens) OVER (PARTITION BY d.source, block ORDER BY key ROWS UNBOUNDED PRECEDING) <= left_
         THEN 1 ELSE 0 END AS copies
  FROM d JOIN p ON d.source = p.source AND substr(d.key, 1, 3) = p.block
)
SELECT {columns} FROM (SELECT *, unnest(range(1, copies + 1)) AS epoch FROM c)"""
