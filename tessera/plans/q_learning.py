"""Queries of the learning tables and further evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import cs, ts
from ..operators import evaluate as E
from ..operators import learning as L
from . import panel
from .pairs import near, near_sql, query
from .q_tables import _IC

_N = near_sql
_DATES = f"WITH {panel.BARS}, d AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date) - 1 AS k, count(*) OVER () AS n FROM (SELECT DISTINCT trade_date FROM bars))"


@query(
    f"""WITH {panel.WIDE}, l AS (SELECT symbol, trade_date, volume, turnover_rate, CASE WHEN NOT coalesce(lead(is_suspended) OVER w, true) THEN lead(close, 4) OVER w / lead(close, 1) OVER w - 1 END AS y FROM wide WINDOW w AS (PARTITION BY symbol ORDER BY trade_date)),
k AS (SELECT *, count(*) OVER (PARTITION BY trade_date) AS n FROM l WHERE y IS NOT NULL) SELECT symbol, trade_date, {_N('least(greatest(y, -0.5), 0.5)')} AS label FROM k WHERE n >= 5"""
)
def learning_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels from the next bar's close over three bars, untradable entries left out."""
    d = L.labelled(panel.wide_bars(spark, sf_dir), ["volume", "turnover_rate"], horizon=3, blocked="is_suspended")
    return d.select("symbol", "trade_date", near(F.col("label")).alias("label"))


@query(_DATES + " SELECT trade_date, CASE WHEN k < floor(n * 0.7) - 2 THEN 'train' WHEN k >= floor(n * 0.7) AND k < floor(n * (0.7 + 0.15)) - 2 THEN 'valid' WHEN k >= floor(n * (0.7 + 0.15)) THEN 'test' END AS part FROM d WHERE part IS NOT NULL")
def chronological_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.split(panel.bars(spark, sf_dir), purge=2)


@query(_DATES + ", b AS (SELECT *, floor(k * 5 / n)::BIGINT AS block FROM d), e AS (SELECT block AS fold, min(k) AS a, max(k) AS z FROM b GROUP BY 1) SELECT fold, trade_date, CASE WHEN block = fold THEN 'test' WHEN k < a - 2 OR k > z + 1 THEN 'train' END AS part FROM b, e WHERE part IS NOT NULL")
def purged_kfold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five folds with purge and embargo."""
    return L.purged_kfold(panel.bars(spark, sf_dir), 5, purge=2, embargo=1)


@query(_DATES + ", b AS (SELECT *, floor(k * 4 / n)::INT AS block FROM d), c(split, x, y) AS (VALUES (0, 0, 1), (1, 0, 2), (2, 0, 3), (3, 1, 2), (4, 1, 3), (5, 2, 3)) SELECT split, trade_date, CASE WHEN block IN (x, y) THEN 'test' ELSE 'train' END AS part FROM b, c")
def combinatorial_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All choices of two test blocks out of four."""
    return L.combinatorial(panel.bars(spark, sf_dir), 4, 2)


@query()
def ridge_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ridge regression fitted on the earlier dates, applied to the later ones."""
    d = panel.bars(spark, sf_dir).withColumn("mom", ts.ts_return("close", 3))
    d = L.labelled(d, ["mom", "turnover_rate"], horizon=3)
    parts = L.split(d, purge=3)
    train = d.join(parts.where("part = 'train'").select("trade_date"), "trade_date", "left_semi")
    test = d.join(parts.where("part = 'test'").select("trade_date"), "trade_date", "left_semi")
    scale = lambda x: L.standardised(x, ["mom", "turnover_rate"], train)
    return L.ridge_predictions(scale(train), scale(test), ["mom", "turnover_rate"]).select("symbol", "trade_date", "label", "prediction")


_G = "(PARTITION BY trade_date, industry"


@query(
    f"""WITH {panel.EVALUATED}, ok AS (SELECT * FROM ev WHERE factor IS NOT NULL AND fwd_ret_1 IS NOT NULL), rk AS (SELECT *,
  rank() OVER {_G} ORDER BY factor) + (count(*) OVER (PARTITION BY trade_date, industry, factor) - 1) / 2.0 AS fr, rank() OVER {_G} ORDER BY fwd_ret_1) + (count(*) OVER (PARTITION BY trade_date, industry, fwd_ret_1) - 1) / 2.0 AS rr FROM ok),
ic AS (SELECT trade_date, industry, CASE WHEN stddev_samp(fr) > 1e-12 AND stddev_samp(rr) > 1e-12 THEN corr(fr, rr) END AS ric FROM rk GROUP BY 1, 2 HAVING count(*) >= 4)
SELECT industry, {_N("avg(ric)")} AS mean, count(ric) AS n FROM ic GROUP BY 1"""
)
def ic_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean daily rank correlation inside each industry."""
    ic = E.ic_series(panel.evaluated(spark, sf_dir), "factor", "fwd_ret_1", 4, ("industry",))
    return E.ic_summary(ic, "rank_ic", ("industry",)).select("industry", near(F.col("mean")).alias("mean"), "n")


_W12 = "OVER (ORDER BY trade_date ROWS 11 PRECEDING)"


@query(_IC + f", w AS (SELECT trade_date, CASE WHEN count(rank_ic) {_W12} = 12 THEN avg(rank_ic) {_W12} END AS m, CASE WHEN count(rank_ic) {_W12} = 12 THEN stddev_samp(rank_ic) {_W12} END AS s FROM ic) SELECT trade_date, {_N('m')} AS mean, {_N('s')} AS std, {_N('m / s')} AS ir FROM w")
def rolling_ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rolling mean, deviation and ratio of the daily rank correlation."""
    w = W.orderBy("trade_date").rowsBetween(-11, 0)
    full = F.count("rank_ic").over(w) == 12
    d = E.ic_series(panel.evaluated(spark, sf_dir), "factor", "fwd_ret_1").select("trade_date", F.when(full, F.avg("rank_ic").over(w)).alias("m"), F.when(full, F.stddev_samp("rank_ic").over(w)).alias("s"))
    return d.select("trade_date", near(F.col("m")).alias("mean"), near(F.col("s")).alias("std"), near(F.try_divide("m", "s")).alias("ir"))


_E = "(SELECT avg(ic) FROM ic)"


@query(_IC + f", e AS (SELECT trade_date, ic, ic - {_E} AS e, lag(ic - {_E}) OVER (ORDER BY trade_date) AS e1, lag(ic - {_E}, 2) OVER (ORDER BY trade_date) AS e2 FROM ic) SELECT {_N('avg(ic) / (sqrt(sum(e * e) + 2 * (2.0 / 3) * sum(e * e1) + 2 * (1.0 / 3) * sum(e * e2)) / count(*))')} AS nw_t FROM e")
def newey_west(spark: SparkSession, sf_dir: str) -> DataFrame:
    """t of the mean correlation with two lags of autocorrelation."""
    ic = E.ic_series(panel.evaluated(spark, sf_dir), "factor", "fwd_ret_1")
    return E.newey_west(ic, "ic", 2).select(near(F.col("nw_t")).alias("nw_t"))


@query(_IC + f", l AS (SELECT ic AS a, lag(ic) OVER (ORDER BY trade_date) AS b FROM ic) SELECT {_N('corr(a, b)')} AS autocorr FROM l")
def ic_autocorrelation(spark: SparkSession, sf_dir: str) -> DataFrame:
    ic = E.ic_series(panel.evaluated(spark, sf_dir), "factor", "fwd_ret_1")
    return E.autocorrelation(ic, "ic").select(near(F.col("autocorr")).alias("autocorr"))


@query(
    _IC
    + f""", s AS (SELECT *, ceil(row_number() OVER (ORDER BY trade_date) * 2.0 / count(*) OVER ())::INT AS half FROM ic)
SELECT half, {_N('avg(rank_ic)')} AS mean, {_N('avg(rank_ic) / stddev_samp(rank_ic)')} AS ir, count(*) AS n FROM s GROUP BY 1"""
)
def time_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same statistics in each half of the history, from the daily series only."""
    ic = E.ic_series(panel.evaluated(spark, sf_dir), "factor", "fwd_ret_1")
    half = F.ceil(F.row_number().over(W.orderBy("trade_date")) * 2 / F.count("*").over(W.partitionBy())).cast("int")
    d = E.ic_summary(ic.withColumn("half", half), "rank_ic", ("half",))
    return d.select("half", near(F.col("mean")).alias("mean"), near(F.col("ir")).alias("ir"), "n")


@query(
    f"""WITH {panel.EVALUATED}, z AS (SELECT trade_date, symbol, factor, volume, turnover_rate, {", ".join(f"rank() OVER (PARTITION BY trade_date ORDER BY {x}) + (count(*) OVER (PARTITION BY trade_date, {x}) - 1) / 2.0 AS r_{x}" for x in ("factor", "volume", "turnover_rate"))} FROM ev WHERE factor IS NOT NULL),
c AS (SELECT trade_date, corr(r_factor, r_volume) AS v, corr(r_factor, r_turnover_rate) AS t FROM z GROUP BY 1 HAVING count(*) >= 5) SELECT {_N("avg(v)")} AS volume, {_N("avg(t)")} AS turnover_rate FROM c"""
)
def style_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean daily rank correlation of a factor with style columns."""
    from ..functions.base import corr_of

    names = ("factor", "volume", "turnover_rate")
    d = panel.evaluated(spark, sf_dir).where("factor IS NOT NULL").select("trade_date", "symbol", *names)
    d = d.withColumns({f"r_{x}": cs.rank(x) for x in names})
    day = d.groupBy("trade_date").agg(corr_of("r_factor", "r_volume").alias("v"), corr_of("r_factor", "r_turnover_rate").alias("t"), F.count("*").alias("n")).where("n >= 5")
    return day.agg(F.avg("v").alias("v"), F.avg("t").alias("t")).select(near(F.col("v")).alias("volume"), near(F.col("t")).alias("turnover_rate"))
