"""Evaluation of factors over a panel with forward returns: rank correlation, buckets, turnover, decay, events, exposure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import cs as C
from ..functions.base import corr_of, div, fin, grown, ts

YEAR = 252


def forward_returns(df: DataFrame, horizons, price: str = "close", prefix: str = "fwd_ret") -> DataFrame:
    """Returns h rows ahead, on the whole panel: leave rows out afterwards only."""
    return df.withColumns({f"{prefix}_{h}": div(F.lead(price, h).over(ts()), price) - 1 for h in horizons})


def session_returns(df: DataFrame, horizons) -> DataFrame:
    """Compounded overnight, intraday and total returns of the next h rows."""
    night, day = F.log(div("open", F.lag("close").over(ts()))), F.log(div("close", "open"))
    ahead = lambda x, h: F.when(F.count(x).over(ts().rowsBetween(1, h)) == h, F.expm1(F.sum(x).over(ts().rowsBetween(1, h))))
    return df.withColumns({f"{name}_{h}": ahead(x, h) for h in horizons for name, x in (("overnight", night), ("intraday", day), ("total", night + day))})


def ic_series(df: DataFrame, factor: str, ret: str, min_obs: int = 5, by: tuple[str, ...] = ()) -> DataFrame:
    """Per date (and group): n, Pearson and Spearman correlation of factor and return, where n >= min_obs."""
    ok = df.select("trade_date", *by, fin(factor).alias("f"), fin(ret).alias("r")).where("f IS NOT NULL AND r IS NOT NULL")
    ranked = ok.withColumns({"fr": C.rank("f", *by), "rr": C.rank("r", *by)})
    out = ranked.groupBy("trade_date", *by).agg(F.count("*").alias("n"), corr_of("f", "r").alias("ic"), corr_of("fr", "rr").alias("rank_ic"))
    return out.where(F.col("n") >= min_obs)


def ic_summary(ic: DataFrame, x: str = "ic", keys: tuple[str, ...] = ()) -> DataFrame:
    """Mean, deviation, ratio, yearly ratio, t, hit rate, skewness, kurtosis, share beyond 0.02, count of a daily series."""
    v = F.col(x)
    std = F.stddev_samp(v)
    steady = F.when(std > 1e-9, std)
    mean, n = F.avg(v), F.count(v)
    return ic.groupBy(*keys).agg(
        mean.alias("mean"),
        std.alias("std"),
        F.try_divide(mean, steady).alias("ir"),
        (F.try_divide(mean, steady) * F.sqrt(F.lit(float(YEAR)))).alias("annual_ir"),
        (F.try_divide(mean, steady) * F.sqrt(n)).alias("t"),
        F.avg((v > 0).cast("double")).alias("hit"),
        F.when(std > 1e-9, F.skewness(v)).alias("skew"),
        F.when(std > 1e-9, F.kurtosis(v)).alias("kurt"),
        F.avg((F.abs(v) > 0.02).cast("double")).alias("strong"),
        n.alias("n"),
    )


def autocorrelation(series: DataFrame, x: str, lag: int = 1) -> DataFrame:
    """Pearson correlation of a daily series with itself ``lag`` rows before; null for fewer than lag + 2 values."""
    d = series.select("trade_date", F.col(x).alias("v")).where("v IS NOT NULL")
    d = d.withColumn("p", F.lag("v", lag).over(W.orderBy("trade_date")))
    return d.agg(F.when(F.count("*") > lag + 1, corr_of("v", "p")).alias("autocorr"))


def newey_west(series: DataFrame, x: str, lags: int) -> DataFrame:
    """t of the mean with Bartlett weights over ``lags`` lags."""
    d = series.select("trade_date", F.col(x).alias("v")).where("v IS NOT NULL")
    d = d.withColumn("e", F.col("v") - F.avg("v").over(W.partitionBy()))
    w = W.orderBy("trade_date")
    d = d.select("v", "e", *[F.lag("e", k).over(w).alias(f"e{k}") for k in range(1, lags + 1)])
    var = F.sum(F.col("e") * F.col("e"))
    for k in range(1, lags + 1):
        var = var + 2 * (1 - k / (lags + 1)) * F.coalesce(F.sum(F.col("e") * F.col(f"e{k}")), F.lit(0.0))
    n = F.count("v")
    return d.agg(F.try_divide(F.avg("v"), F.sqrt(F.greatest(var, F.lit(0.0))) / n).alias("nw_t"))


def bucketed(df: DataFrame, factor: str, n: int, out: str = "q", *, zero_aware: bool = False, by_group: str | None = None) -> DataFrame:
    """Adds bucket 1 .. n per date (inside a group if asked); non-finite factors have none."""
    q = C.zero_bucket(factor, n) if zero_aware else C.bucket(factor, n, *([by_group] if by_group else []))
    return df.withColumn(out, q)


def group_returns(df: DataFrame, factor: str, ret: str, n: int, weight: str | None = None, **how) -> DataFrame:
    """Mean (or weighted mean) return by date and bucket, with counts."""
    d = bucketed(df, factor, n, **how).where("q IS NOT NULL").withColumn("r", fin(ret)).where("r IS NOT NULL")
    mean = F.try_divide(F.sum(F.col("r") * F.col(weight)), F.sum(weight)) if weight else F.avg("r")
    return d.groupBy("trade_date", "q").agg(mean.alias("ret"), F.count("*").alias("n"))


def pivot_returns(groups: DataFrame, n: int) -> DataFrame:
    """A column g1 .. gn per bucket, all of them whether filled or not."""
    wide = groups.groupBy("trade_date").pivot("q", list(range(1, n + 1))).agg(F.first("ret"))
    return wide.select("trade_date", *[F.col(str(k)).alias(f"g{k}") for k in range(1, n + 1)])


def nav(groups: DataFrame, key: str = "q", ret: str = "ret") -> DataFrame:
    """Compounded value per key; a missing return counts as zero, after a total loss it stays zero."""
    w = W.partitionBy(key).orderBy("trade_date").rowsBetween(W.unboundedPreceding, 0)
    return groups.withColumn("nav", grown(F.coalesce(ret, F.lit(0.0))).over(w))


def long_short(groups: DataFrame, top: int, bottom: int = 1) -> DataFrame:
    """Daily spread of two buckets (an empty side is zero) and its compounded value."""
    side = lambda q: F.coalesce(F.avg(F.when(F.col("q") == q, F.col("ret"))), F.lit(0.0))
    d = groups.groupBy("trade_date").agg((side(top) - side(bottom)).alias("ret")).withColumn("q", F.lit(0))
    return nav(d).select("trade_date", F.col("ret").alias("spread"), "nav")


def turnover(df: DataFrame, factor: str, n: int) -> DataFrame:
    """1 - overlap / size of the top and the bottom bucket against the session before; the first session is left out."""
    d = bucketed(df, factor, n).where("q IS NOT NULL").select("trade_date", "symbol", "q")
    sessions = d.select("trade_date").distinct().withColumn("k", F.row_number().over(W.orderBy("trade_date")))
    d = d.join(sessions, "trade_date")
    stayed = (F.lag("q").over(ts()) == F.col("q")) & (F.lag("k").over(ts()) == F.col("k") - 1)
    d = d.withColumn("stayed", F.coalesce(stayed, F.lit(False))).where("k > 1")
    side = lambda q: 1 - F.try_divide(F.count_if((F.col("q") == q) & F.col("stayed")), F.count_if(F.col("q") == q))
    out = d.groupBy("trade_date").agg(side(n).alias("turnover_long"), side(1).alias("turnover_short"))
    both = (F.col("turnover_long") + F.col("turnover_short")) / 2
    return out.withColumn("turnover_avg", F.coalesce(both, F.col("turnover_long"), F.col("turnover_short")))


def event_study(df: DataFrame, factor: str, n: int, before: int, after: int, price: str = "close", demeaned: bool = True) -> DataFrame:
    """Mean price path by bucket from ``before`` rows ahead of each date to ``after`` behind it, relative to the date."""
    steps = [k for k in range(-before, after + 1)]
    shift = lambda k: F.lag(price, -k).over(ts()) if k < 0 else F.lead(price, k).over(ts()) if k else F.col(price)
    d = df.select("symbol", "trade_date", factor, *[(div(shift(k), price) - 1).alias(f"p{k + before}") for k in steps])
    if demeaned:
        d = d.withColumns({f"p{k + before}": C.demean(f"p{k + before}") for k in steps})
    g = bucketed(d, factor, n).where("q IS NOT NULL").groupBy("q").agg(*[F.avg(f"p{k + before}").alias(f"p{k + before}") for k in steps])
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("step"), F.col(f"p{k + before}").alias("path")) for k in steps]))
    return g.select("q", pairs.alias("x")).select("q", "x.*")


def top_n(df: DataFrame, factor: str, ret: str, n: int) -> DataFrame:
    """The n largest by factor per date: mean return, sorted members, and the share of members new since the date before."""
    ok = df.withColumn("f", fin(factor)).withColumn("r", fin(ret)).where("f IS NOT NULL AND r IS NOT NULL")
    k = F.row_number().over(W.partitionBy("trade_date").orderBy(F.desc("f"), "symbol"))
    d = ok.withColumn("k", k).where(F.col("k") <= n).groupBy("trade_date").agg(F.avg("r").alias("ret"), F.array_sort(F.collect_list("symbol")).alias("members"))
    prev = F.lag("members").over(W.orderBy("trade_date"))
    return d.withColumn("fresh", 1 - F.size(F.array_intersect("members", prev)) / F.size("members"))


def exposure(df: DataFrame, factor: str, by: str, share: float = 0.2) -> DataFrame:
    """Weight of each category in the top and the bottom share per date, averaged over dates, and the difference."""
    p = df.withColumn("p", F.try_divide(C.ordinal(factor), C.count(factor))).where("p IS NOT NULL")
    d = p.groupBy("trade_date", by).agg(F.count_if(F.col("p") > 1 - share).alias("t"), F.count_if(F.col("p") <= share).alias("b"))
    w = W.partitionBy("trade_date")
    d = d.withColumns({"t": F.try_divide(F.col("t"), F.sum("t").over(w)), "b": F.try_divide(F.col("b"), F.sum("b").over(w))})
    return d.groupBy(by).agg(F.avg("t").alias("top"), F.avg("b").alias("bottom")).withColumn("gap", F.col("top") - F.col("bottom"))


def pure_exposure(df: DataFrame, factor: str, covariates: list[str]) -> DataFrame:
    """Per date, the sum of w * x with w = factor / sum of absolute factors."""
    f = fin(factor)
    return df.where(f.isNotNull()).groupBy("trade_date").agg(*[F.try_divide(F.sum(f * F.col(c)), F.sum(F.when(F.col(c).isNotNull(), F.abs(f)))).alias(c) for c in covariates])


def account_samples(df: DataFrame, factor: str, ret: str) -> DataFrame:
    """Why rows drop out: one row of exclusive counts."""
    f, r = F.col(factor), F.col(ret)
    none, odd = f.isNull(), f.isNotNull() & fin(factor).isNull()
    return df.agg(F.count("*").alias("total"), F.count_if(none).alias("null_factor"), F.count_if(odd).alias("nonfinite"), F.count_if(~none & ~odd & r.isNull()).alias("no_return"), F.count_if(~none & ~odd & r.isNotNull()).alias("used"))


def filter_zscore(df: DataFrame, columns: list[str], threshold: float = 20.0) -> DataFrame:
    """Rows whose per-date z of every column stays within the threshold."""
    keep: Column = F.lit(True)
    for c in columns:
        keep = keep & (F.coalesce(F.abs(C.zscore(c)), F.lit(0.0)) <= threshold)
    return df.withColumn("__keep", keep).where("__keep").drop("__keep")


def performance(returns: DataFrame, key: str, ret: str = "ret", year: int = YEAR, risk_free: float = 0.0) -> DataFrame:
    """Per strategy: total, yearly return and deviation, Sharpe, Sortino, drawdown, Calmar, win rate, payoff, best, worst.

    The yearly return is compound; Sharpe and Sortino take it less ``risk_free`` (yearly). The first peak is the start.
    """
    w = W.partitionBy(key).orderBy("trade_date").rowsBetween(W.unboundedPreceding, 0)
    d = returns.where(F.col(ret).isNotNull()).withColumn("nav", grown(ret).over(w))
    d = d.withColumn("dd", F.col("nav") / F.greatest(F.max("nav").over(w), F.lit(1.0)) - 1)
    r, n = F.col(ret), F.count(ret)
    total = grown(r) - 1
    annual = F.when(total >= -1, F.pow(total + 1, F.lit(float(year)) / n) - 1)
    vol = F.stddev_samp(r) * F.sqrt(F.lit(float(year)))
    down = F.sqrt(F.avg(F.pow(F.least(r - ((1 + risk_free) ** (1 / year) - 1), F.lit(0.0)), F.lit(2)))) * F.sqrt(F.lit(float(year)))
    return d.groupBy(key).agg(
        n.alias("n"),
        total.alias("total"),
        annual.alias("annual"),
        vol.alias("vol"),
        F.try_divide(annual - risk_free, F.when(vol > 1e-12, vol)).alias("sharpe"),
        F.try_divide(annual - risk_free, F.when(down > 1e-12, down)).alias("sortino"),
        F.min("dd").alias("max_drawdown"),
        F.count_if(F.col("dd") < -1e-9).alias("underwater"),
        F.try_divide(annual, F.when(F.min("dd") < -1e-12, -F.min("dd"))).alias("calmar"),
        F.avg((r > 0).cast("double")).alias("win_rate"),
        F.try_divide(F.avg(F.when(r > 0, r)), -F.avg(F.when(r < 0, r))).alias("payoff"),
        F.max(r).alias("best"),
        F.min(r).alias("worst"),
    )
