"""Merkle manifest of a dataset: conditional aggregates spread each parent's children into fanout columns.

All columns of a parent, one after the other, hash to its digest; all but a child's own column are that child's siblings.
Each level is one hash aggregation by (group, parent), a sixteenth of the one below; paths go down again by joins on the
same key. A group of any size is therefore spread over all tasks, down to its last level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import stage, tasks

FANOUT = 16
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Columns of a leaf.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """A value with its length before it: no two lists of values are one string. ``-`` is null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(fields=FIELDS, **changed: Column) -> Column:
    return digest(*(field(changed.get(c, F.col(c))) for c in fields))


def numbered(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """``rows`` with ``idx``, from 0 inside each group by ``order``.

    Rows are dealt by ranges of (group, order), so a group that holds most rows is ranked by as many tasks; a row's place
    in its task less the group's first place there, plus what the tasks before hold of the group, is its number. The
    table of these has a row per (task, group it holds). Rows that agree in all of ``order`` are dealt by arrival.
    """
    keys = [group, *order, "__arrival"]
    dealt = rows.withColumn("__arrival", F.monotonically_increasing_id()).repartitionByRange(tasks(rows.sparkSession), *keys)
    placed = dealt.sortWithinPartitions(*keys).drop("__arrival").withColumn("__at", F.monotonically_increasing_id())
    placed = stage(placed.withColumn("__task", F.shiftright("__at", 33)), "ranges")
    held = placed.groupBy("__task", group).agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(W.partitionBy(group).orderBy("__task").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    base = stage(held.select("__task", group, (before - F.col("__first")).alias("__base")), "range-starts")
    return placed.join(base, ["__task", group]).withColumn("idx", F.col("__at") + F.col("__base")).drop("__at", "__task", "__base")


def _slots(nodes: DataFrame, value: Column) -> DataFrame:
    """(grp, idx, c0 .. c15, digest): children of each parent side by side, each at its slot."""
    slot = F.col("idx") % FANOUT
    each = [F.max(F.when(slot == j, value)).alias(f"c{j}") for j in range(FANOUT)]
    return nodes.groupBy("grp", F.floor(F.col("idx") / FANOUT).cast("long").alias("parent")).agg(*each).withColumnRenamed("parent", "idx")


def _hashed(slots: DataFrame, at: str = "") -> DataFrame:
    """With ``lone`` (the group has this one node, which goes up as it is) and ``digest`` of the children; at: a field."""
    own = [F.col(f"c{j}{at}") for j in range(FANOUT)]
    lone = (F.col("idx") == 0) & F.col("c1").isNull()
    return slots.withColumn("lone", lone).withColumn("digest", F.when(lone, own[0]).otherwise(F.sha2(F.concat_ws("", *own), 256)))


def _children(parents: DataFrame, at: str = "") -> Column:
    """For each child (slot, value, left, right): what stands before and after its own column."""
    names = [f"c{j}" for j in range(FANOUT)]
    beside = lambda some: F.concat_ws("", *(F.col(c + at) for c in some))
    each = [F.struct(F.lit(j).alias("slot"), F.col(c).alias("value"), beside(names[:j]).alias("left"), beside(names[j + 1 :]).alias("right")) for j, c in enumerate(names)]
    return F.filter(F.array(*each), lambda s: s["value"].isNotNull())


def _onwards(lone: str, child: str) -> Column:
    """The child's path: its own siblings, then the parent's path; a lone node adds no step."""
    own = F.array(F.struct(F.col(f"{child}.left").alias("left"), F.col(f"{child}.right").alias("right")))
    return F.when(F.col(lone), F.col("path")).otherwise(F.concat(own, F.col("path")))


def climb(level: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """All levels above ``level`` (grp, idx, c0 .. c15, lone, digest), up to the one with a node a group, each staged."""
    levels = [level]
    while not levels[-1].where("idx > 0").isEmpty():
        levels.append(stage(_hashed(_slots(levels[-1].select("grp", "idx", "digest"), F.col("digest"))), "level"))
    return levels, levels[-1].select("grp", "digest")


def descend(levels: list[DataFrame], top: DataFrame) -> DataFrame:
    """The lowest level's parents with ``path`` and ``subroot``: paths from the top's (grp, path, subroot) down."""
    above = top.withColumn("idx", F.lit(0).cast("long"))
    for level in reversed(levels[1:]):
        spread = level.join(above, ["grp", "idx"]).select("grp", "idx", "lone", "path", "subroot", F.explode(_children(level)).alias("k"))
        path = _onwards("lone", "k")
        above = stage(spread.select("grp", (F.col("idx") * FANOUT + F.col("k.slot")).alias("idx"), path.alias("path"), "subroot"), "paths")
    return levels[0].join(above, ["grp", "idx"])


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, start, lambda acc, step: digest(step["left"], acc, step["right"]))


def manifest(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, path (left and right siblings, level by level) and other_leaf, a row per document.

    A leaf is the hash of the columns FIELDS, each with its length before it, ``-`` if null; other columns aren't read.
    Leaves ascend by doc_id in their source (null first; equal ids by leaf, so repeated rows are interchangeable); runs of
    FANOUT become a node until one is left, the subroot, and subroots by source (null first, bytewise) do the same.
    other_leaf is the hash with ``tampered`` for the text where that isn't null. Empty and very long texts are texts like
    others; an empty table has no rows and no root. The root alone, one row, reaches the driver.
    """
    other = F.when(tampered.isNotNull() & (tampered != F.col("text")), leaf(text=tampered)) if tampered is not None else F.lit(None).cast("string")
    group = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
    leaves = stage(docs.select(group.alias("grp"), F.col("doc_id").cast("long").alias("doc_id"), leaf().alias("leaf"), other.alias("other_leaf")), "leaves")
    placed = numbered(leaves, "grp", "doc_id", "leaf")
    low = stage(_hashed(_slots(placed, F.struct("leaf", "doc_id", "other_leaf")), ".leaf"), "leaf-level")
    levels, subroots = climb(low)
    nodes = stage(numbered(subroots.select(F.lit("").alias("one"), F.col("grp").alias("source"), F.col("digest")), "one", "source"), "subroots")
    named = _slots(nodes.select(F.col("one").alias("grp"), "idx", F.struct(F.col("digest").alias("leaf"), "source").alias("value")), F.col("value"))
    top_low = stage(_hashed(named, ".leaf"), "source-level")
    top_levels, root = climb(top_low)
    got = root.head()
    start = root.select("grp", F.array().cast("array<struct<left: string, right: string>>").alias("path"), F.lit("").alias("subroot"))
    tops = descend(top_levels, start).select("lone", "path", F.explode(_children(top_low, ".leaf")).alias("k"))
    tops = tops.select(F.col("k.value.source").alias("grp"), _onwards("lone", "k").alias("path"), F.col("k.value.leaf").alias("subroot"))
    below = descend(levels, stage(tops, "source-paths")).select("lone", "path", "subroot", F.explode(_children(low, ".leaf")).alias("k"))
    return below.select(
        F.col("k.value.doc_id").alias("doc_id"),
        F.col("k.value.leaf").alias("leaf"),
        "subroot",
        F.lit(got["digest"] if got else None).cast("string").alias("root"),
        _onwards("lone", "k").alias("path"),
        F.col("k.value.other_leaf").alias("other_leaf"),
    )


def proofs(manifest: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified: each leaf, or its other one, against its path."""
    proof = F.sha2(F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), ""), 256)
    folded = fold(F.coalesce("other_leaf", "leaf"), F.col("path"))
    return manifest.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), folded.alias("folded_root"), (folded == F.col("root")).alias("verified"))


def lower_some(doc_id: str = "doc_id", text: str = "text", every: int = 5) -> Column:
    """The text with A-Z in lower case where ``every`` divides the crc32 of the id's digits; else null."""
    return F.when(F.crc32(F.col(doc_id).cast("string").cast("binary")) % every == 0, F.translate(text, _UPPER, _LOWER))


def oracle(levels: int = 6) -> str:
    """DuckDB SQL for ``proofs(manifest(documents, lower_some()))``, for up to 16 ** levels documents a source."""
    part = lambda c: f"COALESCE(CAST(strlen({c}) AS VARCHAR) || ':' || {c}, '-')"
    row = lambda text: "sha256(" + " || ".join([part("CAST(doc_id AS VARCHAR)"), part("source"), part("lang"), part("CAST(n_chars AS VARCHAR)"), part(text)]) + ")"
    step = "list_reduce([c, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)"
    crc = "list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda z: CAST(ord(z) AS BIGINT))), lambda a, b: " + step.replace("[c,", "[xor(a, b),") + ")"
    lower = f"translate(text, '{_UPPER}', '{_LOWER}')"
    ctes = [
        f"leaves AS (SELECT doc_id, COALESCE('=' || source, '') AS g, {row('text')} AS leaf, CASE WHEN xor({crc}, 4294967295) % 5 = 0 THEN {row(lower)} END AS other FROM documents)",
        "s0 AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, leaf AS d FROM leaves)",
    ]

    def tree(name: str, columns: str) -> None:
        for k in range(levels):
            side = lambda frame: f"COALESCE(STRING_AGG(d, '') OVER (PARTITION BY g, i // 16 ORDER BY i ROWS BETWEEN {frame}), '')"  # noqa: B023,E731
            ctes.append(f"{name}t{k} AS (SELECT g, i, d, {side('UNBOUNDED PRECEDING AND 1 PRECEDING')} AS l, {side('1 FOLLOWING AND UNBOUNDED FOLLOWING')} AS r, COUNT(*) OVER (PARTITION BY g) AS n FROM {name}{k})")
            ctes.append(f"{name}{k + 1} AS (SELECT g, i // 16 AS i, CASE WHEN MAX(n) = 1 THEN MAX(d) ELSE sha256(STRING_AGG(d, '' ORDER BY i)) END AS d FROM {name}t{k} GROUP BY g, i // 16)")

    tree("s", "")
    ctes.append(f"u0 AS (SELECT '' AS g, g AS source, d, ROW_NUMBER() OVER (ORDER BY g) - 1 AS i FROM s{levels})")
    tree("u", "")
    joins, left, right, used = [], [], [], []
    for name, key, place in (("s", "s0.g", "s0.i"), ("u", "''", "u0.i")):
        if name == "u":
            joins.append("JOIN u0 ON u0.source = s0.g")
        for k in range(levels):
            t = f"{name}{k}t"
            joins.append(f"JOIN {name}t{k} {t} ON {t}.g = {key} AND {t}.i = {place} // {16**k}")
            left.append(f"{t}.l")
            right.append(f"{t}.r")
            used.append(f"{t}.n > 1")
    folded = "COALESCE(s0.other, s0.leaf)"
    ctes.append("p AS (SELECT doc_id, leaf, u0.d AS subroot, (SELECT d FROM u" + str(levels) + ") AS root, " + f"{folded} AS f0, " + ", ".join(f"{a} AS l{k}, {b} AS r{k}, {c} AS h{k}" for k, (a, b, c) in enumerate(zip(left, right, used, strict=True))) + " FROM s0 " + " ".join(joins) + ")")
    for k in range(2 * levels):
        ctes.append(f"f{k} AS (SELECT *, CASE WHEN h{k} THEN sha256(l{k} || f{k} || r{k}) ELSE f{k} END AS f{k + 1} FROM {'p' if k == 0 else f'f{k - 1}'})")
    last = 2 * levels
    proof = " || ".join(f"l{k} || r{k}" for k in range(last))
    return "WITH " + ", ".join(ctes) + f" SELECT doc_id, leaf, subroot, root, sha256({proof}) AS proof_sha256, f{last} AS folded_root, f{last} = root AS verified FROM f{last - 1}"
