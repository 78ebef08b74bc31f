"""Cross-site line dedup: how many sites show a line, by HyperLogLog sketches; widespread lines stay once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import beside, clean_text, let, stage

TRIM = " \t\r"


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _row_key() -> Column:
    """Tells apart rows that share an id but not a text."""
    return F.xxhash64(clean_text("__ld_text"))


def occurrences(docs: DataFrame, text: str, doc_id: str, site: str) -> DataFrame:
    """A row per non-blank line: document, place, site and two hashes (96 bits) of the trimmed line."""
    line = F.btrim("line", F.lit(TRIM))
    return (
        docs.select(F.col(text).alias("__ld_text"), F.col(doc_id).alias("doc"), F.coalesce(F.col(site).cast("string"), F.lit("")).alias("site"))
        .select("doc", "site", _row_key().alias("rk"), F.posexplode(_lines(clean_text("__ld_text"))).alias("pos", "line"))
        .where(line != "")
        .select("doc", "rk", "pos", "site", F.xxhash64(line).alias("h"), F.hash(line).alias("g"))
    )


def widespread(occ: DataFrame, min_sites: int, lg_k: int = 12, band: float = 0.15) -> DataFrame:
    """Lines on ``min_sites`` sites or more, each with its first occurrence.

    The sketches of a line merge by aggregation, so what moves for a line is bounded by the number of tasks, not of
    sites. An estimate within ``band`` (over eight standard errors at lg_k 12) of the threshold is replaced by an exact
    distinct count.
    """
    spread = occ.groupBy("h", "g").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(lg_k))).alias("sites"),
        F.min(F.struct("doc", "rk", "pos")).alias("first"),
    )
    slack = max(1.0, band * min_sites)
    spread = stage(spread.where(F.col("sites") >= min_sites - slack), "line-spread")
    near = spread.where(F.abs(F.col("sites") - min_sites) <= slack)
    exact = (
        occ.join(near.select("h", "g"), ["h", "g"], "left_semi")
        .groupBy("h", "g")
        .agg(F.countDistinct("site").alias("exact"))
        .where(F.col("exact") >= min_sites)
        .select("h", "g")
    )
    far = spread.where(F.col("sites") > min_sites + slack)
    return far.select("h", "g", "first").unionByName(near.join(exact, ["h", "g"], "left_semi").select("h", "g", "first"))


@beside("n_lines", "n_removed")
def dedup_lines(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", site: str = "source", min_sites: int = 5) -> DataFrame:
    """Remove lines that ``min_sites`` sites or more show, except each one's first occurrence.

    A line is what stands between line feeds, compared without blanks, tabs and carriage returns at its ends; blank
    lines always stay. First means smallest document id, then place. A null site counts as one site, a null text as
    empty (and stays null if nothing is removed), an empty table gives an empty table, repeated rows are one document
    and are treated alike. All rows and columns stay; added are ``n_lines`` and ``n_removed``,
    with an underscore behind where the caller has such a column.
    """
    occ = occurrences(docs, text, doc_id, site)
    flagged = widespread(occ, min_sites)
    drops = (
        occ.select("doc", "rk", "pos", "h", "g")
        .join(flagged, ["h", "g"])
        .where(~F.struct("doc", "rk", "pos").eqNullSafe(F.col("first")))
        .select("doc", "rk", "pos")
        .groupBy("doc", "rk")
        .agg(F.collect_set("pos").alias("__ld_drop"))
        .select(F.col("doc").alias("__ld_doc"), F.col("rk").alias("__ld_rk"), "__ld_drop")
    )
    rows = docs.withColumn("__ld_text", F.col(text))
    joined = rows.join(drops, F.col(doc_id).eqNullSafe(F.col("__ld_doc")) & (_row_key() == F.col("__ld_rk")), "left")

    def kept(lines: Column) -> Column:
        places = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__ld_drop"))
        return F.array_join(F.transform(places, lambda i: F.get(lines, i)), "\n")

    rebuilt = F.when(F.col("__ld_drop").isNull(), F.col("__ld_text")).otherwise(let(_lines(clean_text("__ld_text")), kept))
    return joined.withColumns(
        {
            text: rebuilt,
            "n_lines": (F.length(clean_text("__ld_text")) - F.length(F.replace(clean_text("__ld_text"), F.lit("\n"), F.lit(""))) + 1).cast("long"),
            "n_removed": F.coalesce(F.size("__ld_drop"), F.lit(0)).cast("long"),
        }
    ).drop("__ld_text", "__ld_doc", "__ld_rk", "__ld_drop")


def oracle(min_sites: int = 5, docs: str = "documents", extra: str = "") -> str:
    """The same in DuckDB SQL."""
    key = "trim(line, ' ' || chr(9) || chr(13))"
    return f"""
WITH occ AS (
  SELECT doc_id, site, unnest(ls) AS line, unnest(range(len(ls))) AS pos
  FROM (SELECT doc_id, coalesce(source, '') AS site, string_split(coalesce(text, ''), chr(10)) AS ls FROM {docs})
), spread AS (
  SELECT {key} AS k, min(struct_pack(d := doc_id, p := pos)) AS first FROM occ WHERE {key} <> ''
  GROUP BY 1 HAVING count(DISTINCT site) >= {min_sites}
), marked AS (
  SELECT o.doc_id, o.line, o.pos, s.k IS NOT NULL AND (o.doc_id <> s.first.d OR o.pos <> s.first.p) AS dropped
  FROM occ o LEFT JOIN spread s ON {key.replace("line", "o.line")} = s.k
)
SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '') AS text,
       count(*) AS n_lines, count(*) FILTER (dropped) AS n_removed
FROM marked GROUP BY doc_id{extra}"""
