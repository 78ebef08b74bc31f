"""Names of a dictionary in texts: which securities and which industry a text speaks of."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Names that one automaton holds; a larger dictionary is dealt to several, one pass over the texts each.
PART = 200_000
#: Set where a text's symbols or industry were inferred from its words.
INFERRED = 4


def dictionary(securities: DataFrame, *, name: str = "name", code: str = "symbol") -> DataFrame:
    """(name, code): trimmed names that aren't empty; of a name with several codes the largest one."""
    n = F.trim(F.col(name))
    return securities.where(F.col(name).isNotNull() & (F.length(n) > 0) & F.col(code).isNotNull()).groupBy(n.alias("name")).agg(F.max(F.col(code).cast("string")).alias("code"))


def occurrences(texts: DataFrame, names: DataFrame, *, key: str, text: str, longest: bool = True) -> DataFrame:
    """(key, start, name) of every place where a name begins; with ``longest`` only the longest that begins there.

    Names are put into automata of PART names each, which tasks build once and run over a text in one pass, however many
    names there are: no text meets a name that isn't in it. Distinct keys are asked for; null texts hold nothing.
    """
    spark = texts.sparkSession
    parts = max(1, -(-names.count() // PART))
    rows = texts.where(F.col(text).isNotNull()).select(key, text)
    kind = dict(rows.dtypes)[key]
    dealt = names.select("name", F.pmod(F.xxhash64("name"), F.lit(parts)).alias("part"))
    found = []
    for part in range(parts):
        # at most about PART names
        shared = spark.sparkContext.broadcast([r[0] for r in dealt.where(F.col("part") == part).select("name").collect()])

        def search(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            import ahocorasick

            automaton = ahocorasick.Automaton()
            for n in shared.value:
                automaton.add_word(n, n)
            if shared.value:
                automaton.make_automaton()
            for pdf in batches:
                out = []
                for k, t in zip(pdf[key], pdf[text], strict=True):
                    best: dict[int, str] = {}
                    for end, n in automaton.iter(t) if shared.value else ():
                        start = end - len(n) + 1
                        if not longest:
                            out.append((k, start, n))
                        elif len(n) > len(best.get(start, "")):
                            best[start] = n
                    out += [(k, start, n) for start, n in best.items()]
                yield pd.DataFrame(out, columns=[key, "start", "name"]).astype({"start": "int64"})

        # ids as text: beside nulls pandas would hold longs as floats
        hits = rows.withColumn(key, F.col(key).cast("string")).mapInPandas(search, f"{key} string, start long, name string")
        found.append(hits.withColumn(key, F.col(key).cast(kind)))
    hits = reduce(DataFrame.unionByName, found)
    if longest and parts > 1:
        hits = hits.groupBy(key, "start").agg(F.max_by("name", F.length("name")).alias("name"))
    return hits


def spoken(texts: DataFrame, names: DataFrame, *, key: str, text: str) -> DataFrame:
    """(key, start, name): names from left to right, at each place the longest, none over another's characters."""
    hits = occurrences(texts, names, key=key, text=text)
    listed = hits.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start", "name"))).alias("hits"))
    zero = F.struct(F.lit(0).cast("long").alias("upto"), F.array().cast("array<struct<start: bigint, name: string>>").alias("kept"))

    def step(acc, h):
        free = h["start"] >= acc["upto"]
        return F.struct(F.when(free, h["start"] + F.length(h["name"])).otherwise(acc["upto"]).alias("upto"), F.when(free, F.concat(acc["kept"], F.array(h))).otherwise(acc["kept"]).alias("kept"))

    return listed.select(key, F.explode(F.aggregate("hits", zero, step, lambda acc: acc["kept"])).alias("h")).select(key, "h.start", "h.name")


def link_symbols(news: DataFrame, names: DataFrame, *, key: str = "id", title: str = "title", content: str = "content") -> DataFrame:
    """``news`` with the codes of the names that title and content speak of behind its ``symbols``, each once, in order of first mention.

    ``quality_flags`` gets the bit INFERRED where a name was found, whether its code was there before or not. Title and
    content are read as one text.
    """
    texts = news.select(key, F.concat(F.coalesce(title, F.lit("")), F.coalesce(content, F.lit(""))).alias("__text"))
    hits = spoken(texts, names, key=key, text="__text").join(names, "name")
    codes = hits.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("start", "code"))), lambda h: h["code"]).alias("__codes"))
    d = news.join(codes, key, "left")
    own = F.coalesce("symbols", F.array().cast("array<string>"))
    hit = F.col("__codes").isNotNull()
    return d.withColumns({"symbols": F.when(hit, F.array_distinct(F.concat(own, F.col("__codes")))).otherwise(F.col("symbols")), "quality_flags": F.when(hit, F.coalesce("quality_flags", F.lit(0)).bitwiseOR(F.lit(INFERRED))).otherwise(F.col("quality_flags"))}).drop("__codes")


def link_industry(news: DataFrame, keywords: DataFrame, industries: DataFrame, *, key: str = "id", title: str = "title", content: str = "content") -> DataFrame:
    """``news`` with ``industry_code``: that of the longest of ``keywords`` (name, code) in its text, else of its first known symbol.

    ``industries``: symbol, code. Of equally long keywords the smaller one counts. Where neither is known the row stays as it is.
    """
    texts = news.select(key, F.concat(F.coalesce(title, F.lit("")), F.coalesce(content, F.lit(""))).alias("__text"))
    hits = occurrences(texts, keywords.select("name"), key=key, text="__text", longest=False).select(key, "name").distinct().join(keywords, "name")
    by_word = hits.groupBy(key).agg(F.min_by("code", F.struct(-F.length("name"), "name")).alias("__word"))
    each = news.select(key, F.posexplode("symbols").alias("at", "symbol")).join(industries.select("symbol", F.col("code").alias("c")), "symbol")
    by_symbol = each.groupBy(key).agg(F.min_by("c", "at").alias("__symbol"))
    d = news.join(by_word, key, "left").join(by_symbol, key, "left").withColumn("__code", F.coalesce("__word", "__symbol"))
    known = F.col("__code").isNotNull()
    old = F.col("industry_code") if "industry_code" in news.columns else F.lit(None).cast("string")
    return d.withColumns({"industry_code": F.when(known, F.col("__code")).otherwise(old), "quality_flags": F.when(known, F.coalesce("quality_flags", F.lit(0)).bitwiseOR(F.lit(INFERRED))).otherwise(F.col("quality_flags"))}).drop("__word", "__symbol", "__code")


def items(news: DataFrame, *, key: str = "id") -> DataFrame:
    """(symbol, key): a row for each symbol that an item is linked to."""
    return news.select(F.explode("symbols").alias("symbol"), key).distinct()


def newest(news: DataFrame, n: int, *, key: str = "id", ts: str = "ts") -> DataFrame:
    """The n newest items of each symbol."""
    d = items(news, key=key).join(news.select(key, ts), key)
    rank = F.row_number().over(W.partitionBy("symbol").orderBy(F.desc(ts), key))
    return d.withColumn("rank", rank).where(F.col("rank") <= n)
