"""Learned quality rules: document statistics as column expressions, and decision lists by sequential covering."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import beside, clean_text, let, stage

_WHITE = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"
#: Statistics the rules may test, all from the text alone.
FEATURES = ("n_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "distinct_share", "upper_share", "digit_share", "mark_share", "word_marks")


def _count_of(text: Column, chars: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")


def _repeat_words(words: Column) -> Column:
    """Words inside 5-word windows that occur twice or more; each word counts once. Linear but for one sort."""
    spot = lambda p: F.transform(p, lambda x, i: F.least(F.lit(5), F.coalesce(F.get(p, i + 1) - x, F.lit(5))))
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)

    def twice(s: Column) -> Column:
        same = lambda x, i: F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False))
        return F.array_sort(F.transform(F.filter(s, same), lambda x: x["i"]))

    def covered(grams: Column) -> Column:
        ranked = F.array_sort(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        found = let(let(ranked, twice), lambda p: total(spot(p)))
        return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0).cast("long")).otherwise(found)

    def grams(w: Column) -> Column:
        window = lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(5)])
        return F.transform(F.sequence(F.lit(0), F.size(w) - 5), window)

    return let(words, lambda w: F.when(F.size(w) < 5, F.lit(0).cast("long")).otherwise(let(grams(w), covered)))


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the base counts (long) and the shares of FEATURES (double). A null text counts as empty."""
    t = clean_text("__qr_text")
    trimmed = F.btrim(t, F.lit(_WHITE))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))
    lines = F.filter(F.split(t, "\n", -1), lambda x: F.btrim(x, F.lit(_WHITE)) != "")
    of_words = let(
        words,
        lambda w: F.struct(
            F.size(w).cast("long").alias("n"),
            F.size(F.array_distinct(w)).alias("distinct"),
            _repeat_words(w).alias("repeat"),
        ),
    )
    of_lines = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup")))
    base = docs.withColumn("__qr_text", F.col(text)).withColumns({"__qr_w": of_words, "__qr_l": of_lines})
    base = base.withColumns(
        {
            "n_words": F.col("__qr_w")["n"],
            "word_chars": F.length(F.translate(t, _WHITE, "")).cast("long"),
            "n_symbols": _count_of(t, _SYMBOLS),
            "n_dup_lines": F.col("__qr_l")["dup"],
            "n_repeat_words": F.col("__qr_w")["repeat"],
            "__qr_distinct": F.col("__qr_w")["distinct"],
            "__qr_lines": F.col("__qr_l")["n"],
        }
    )
    chars, n = F.greatest("word_chars", F.lit(1)), F.greatest("n_words", F.lit(1))
    share = {
        "mean_word": F.col("word_chars") / n,
        "symbol_share": F.col("n_symbols") / chars,
        "dup_line_share": F.col("n_dup_lines") / F.greatest("__qr_lines", F.lit(1)),
        "repeat_share": F.col("n_repeat_words") / n,
        "distinct_share": F.col("__qr_distinct") / n,
        "upper_share": _count_of(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ") / chars,
        "digit_share": _count_of(t, "0123456789") / chars,
        "mark_share": _count_of(t, "!?") / chars,
        "word_marks": _count_of(t, ".,;:") / n,
    }
    return base.withColumns(share).drop("__qr_text", "__qr_w", "__qr_l", "__qr_distinct", "__qr_lines")


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    bound: float

    def column(self) -> Column:
        x = F.col(self.feature).cast("double")
        return x > self.bound if self.above else x <= self.bound

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.bound:.6g}"


@dataclass(frozen=True)
class DecisionList:
    """Ordered rules; a row that meets all conditions of any is rejected, all others are kept."""

    rules: tuple[tuple[Condition, ...], ...]

    def keeps(self) -> Column:
        verdict = None
        for rule in self.rules:
            verdict = F.when(_all(rule), False) if verdict is None else verdict.when(_all(rule), False)
        return F.lit(True) if verdict is None else verdict.otherwise(True)

    def __str__(self) -> str:
        return "\n".join(" and ".join(map(str, r)) + " -> reject" for r in self.rules) + "\notherwise keep"


def _all(rule) -> Column:
    out = F.lit(True)
    for c in rule:
        out = out & c.column()
    return out


def learn(rows: DataFrame, features=FEATURES, *, label: str = "bad", max_rules: int = 8, max_conditions: int = 4, cuts: int = 32, precision: float = 0.97, least: int = 8) -> DecisionList:
    """A decision list that finds ``label`` = 1, by sequential covering.

    ``rows``: the (bounded, staged) labelled rows with ``features``, ``label`` (0 or 1) and ``prune`` (true for the rows
    held back for pruning). A rule grows by the condition with the largest information gain on the growing rows, then
    loses final conditions while that doesn't lower (p - n) / (p + n) on the pruning rows, and is taken if
    ``precision`` holds on all rows and it covers ``least``. Thresholds are quantiles of either class. Covered rows go, and the next rule starts. Each step is one
    aggregation; only counts by feature and cut reach the driver.
    """
    at = [i / cuts for i in range(cuts + 1)]
    by_class = rows.groupBy(label).agg(*[F.percentile_approx(F.col(f).cast("double"), at, 10_000).alias(f) for f in features]).collect()
    bounds = {f: sorted({x for r in by_class for x in r[f] or []}) for f in features}
    bins = F.array(*[_bin(F.col(f).cast("double"), bounds[f]) for f in features])
    binned = stage(rows.select(*features, F.col(label).alias("y"), "prune", bins.alias("bins")), "rule-rows")
    rules: list[tuple[Condition, ...]] = []
    left, barred = binned, set()
    while len(rules) < max_rules and len(barred) < len(features):
        rule: list[Condition] = []
        while len(rule) < max_conditions:
            counts = left.where(~F.col("prune") & _all(rule)).select("y", F.posexplode("bins").alias("f", "b")).groupBy("f", "b", "y").count().collect()
            best = _best(counts, features, bounds, least, barred if not rule else set())
            if best is None:
                break
            rule.append(best[0])
            if best[1] == 0:
                break
        if not rule:
            break
        if taken := _pruned(left, rule, least, precision):
            rules.append(taken)
            left, barred = left.where(~_all(taken)), set()
        else:
            barred.add(rule[0].feature)  # no precise rule begins with it; the next best may
    return DecisionList(tuple(rules))


def _pruned(left: DataFrame, rule: list[Condition], least: int, precision: float) -> tuple[Condition, ...] | None:
    """The shortest beginning of the rule that is worth as much as any on the pruning rows, among those precise enough."""
    tests = [_all(rule[: k + 1]) for k in range(len(rule))]
    sums = left.agg(*[F.coalesce(F.sum(F.when(t & (F.col("y") == y) & (F.col("prune") == part), 1)), F.lit(0)) for t in tests for y in (1, 0) for part in (True, False)]).first()
    best, most = None, None
    for k in range(len(rule)):
        hit_held, hit, miss_held, miss = sums[4 * k : 4 * k + 4]
        worth = (hit_held - miss_held) / (hit_held + miss_held) if hit_held + miss_held else 0.0
        if hit + hit_held >= least and hit + hit_held >= precision * (hit + hit_held + miss + miss_held) and (most is None or worth > most):
            best, most = tuple(rule[: k + 1]), worth
    return best


def _bin(x: Column, bounds: list[float]) -> Column:
    """How many of the ascending bounds lie below x."""
    return F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: x > b)) if bounds else F.lit(0)


def _best(counts, features, bounds, least: int, barred: set[str]) -> tuple[Condition, int] | None:
    """The condition with the largest gain, and how many good rows it still lets in."""
    at = {(r["f"], r["b"], r["y"]): r["count"] for r in counts}
    p0 = sum(n for (f, _, y), n in at.items() if f == 0 and y == 1)
    n0 = sum(n for (f, _, y), n in at.items() if f == 0 and y == 0)
    if p0 < least or not n0:
        return None
    best, most = None, 1e-9
    for f, name in enumerate(features):
        if name in barred:
            continue
        p_below = n_below = 0
        for b, bound in enumerate(bounds[name]):
            p_below += at.get((f, b, 1), 0)
            n_below += at.get((f, b, 0), 0)
            for above, p, n in ((False, p_below, n_below), (True, p0 - p_below, n0 - n_below)):
                if p >= least and n < n0:
                    gain = p * (math.log2((p + 0.5) / (p + n + 1)) - math.log2((p0 + 0.5) / (p0 + n0 + 1)))
                    if gain > most:
                        best, most = (Condition(name, above, float(bound)), n), gain
    return best


def labelled(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", at_most: int = 20_000) -> DataFrame:
    """Statistics of at most ``at_most`` labelled documents (in hash order of the id), staged; a fifth held back for pruning."""
    key = F.md5(F.col("doc_id").cast("string"))
    sample = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("q")).orderBy(key, "doc_id").limit(at_most)
    sample = sample.select(F.col("doc_id").alias("__qr_id"), (F.col("q") == 0).cast("int").alias("bad"), (F.substring(key, 1, 2) < "33").alias("prune"))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(sample), F.col("doc_id") == F.col("__qr_id"))
    return stage(statistics(rows).select(*FEATURES, "bad", "prune"), "rule-sample")


#: Counts of the base rules.
BASE = ("word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@beside(*FEATURES, *BASE, "base_failed", "kept")
def judge(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", at_most: int = 20_000) -> DataFrame:
    """``docs`` with the base counts, ``base_failed`` and ``kept``.

    The list is learnt from at most ``at_most`` rows of ``labels`` (doc_id, quality: 1 good, 0 bad; nulls are left out,
    of repeated ids the worst counts). Without usable labels the list is empty and only the base rules reject. Null and
    empty texts have no words and fail the base rules. Every row and column stays; where the caller has a column of an added
    name, the added one has an underscore behind it. Of conditions with equal gain the first feature and bound count. A
    text is one row's work, however long. An empty table gives an empty table.
    """
    rules = learn(labelled(docs, labels, doc_id=doc_id, text=text, at_most=at_most))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return statistics(docs, text).withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & rules.keeps())
