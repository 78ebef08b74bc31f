"""Strategy tables: parameter sweeps, attribution, risk against a benchmark, drawdowns, weights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.base import div, fin, grown, ts


def sweep(panel: DataFrame, factor: str, sizes: list[int], *, cost: float = 0.001, year: int = 252) -> DataFrame:
    """Equal-weight top-N portfolios for many N in one pass: mean return, turnover, net value, drawdown and Sharpe by N.

    Names rank once per date; a running mean over the rank gives all N at once, so the grid costs no further pass over
    the panel. Turnover compares members with those of the date before.
    """
    ok = panel.withColumn("f", fin(factor)).withColumn("r", div(F.lead("close").over(ts()), "close") - 1).where("f IS NOT NULL AND r IS NOT NULL")
    k = F.row_number().over(W.partitionBy("trade_date").orderBy(F.desc("f"), "symbol"))
    d = ok.select("trade_date", "symbol", "r", k.alias("k")).where(F.col("k") <= max(sizes))
    day = W.partitionBy("trade_date").orderBy("k").rowsBetween(W.unboundedPreceding, 0)
    means = d.withColumn("ret", F.avg("r").over(day)).where(F.col("k").isin(sizes)).select("trade_date", F.col("k").alias("n"), "ret")
    cal = d.select("trade_date").distinct().withColumn("prev", F.lag("trade_date").over(W.orderBy("trade_date")))
    before = d.select(F.col("trade_date").alias("prev"), "symbol", F.col("k").alias("k0"))
    moved = d.join(cal, "trade_date").join(before, ["prev", "symbol"], "left")
    kept = moved.groupBy("trade_date").agg(*[F.count_if((F.col("k") <= n) & (F.col("k0") <= n)).alias(f"s{n}") for n in sizes])
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("n"), (1 - F.col(f"s{n}") / n).alias("turnover")) for n in sizes]))
    turn = kept.select("trade_date", rows.alias("x")).select("trade_date", "x.*")
    net = means.join(turn, ["trade_date", "n"]).withColumn("net", F.col("ret") - cost * F.col("turnover"))
    w = W.partitionBy("n").orderBy("trade_date").rowsBetween(W.unboundedPreceding, 0)
    net = net.withColumn("nav", grown("net").over(w))
    net = net.withColumn("dd", F.col("nav") / F.greatest(F.max("nav").over(w), F.lit(1.0)) - 1)
    std = F.stddev_samp("net")
    return net.groupBy("n").agg(F.count("*").alias("days"), F.avg("net").alias("mean"), F.avg("turnover").alias("turnover"), F.max_by("nav", "trade_date").alias("nav"), F.min("dd").alias("max_drawdown"), F.try_divide(F.avg("net") * (year**0.5), F.when(std > 1e-12, std)).alias("sharpe"))


def rebalance_flags(dates: DataFrame, mode: str) -> DataFrame:
    """First session of each week or month (or every, or none); the very first is always marked."""
    w = W.orderBy("trade_date")
    before = F.lag("trade_date").over(w)
    if mode in ("week", "month"):
        flag = before.isNull() | (F.trunc("trade_date", mode) != F.trunc(before, mode))
    else:
        flag = before.isNull() | F.lit(mode == "day")
    return dates.select("trade_date").distinct().withColumn("rebalance", flag)


def risk_vs_benchmark(returns: DataFrame, bench: DataFrame, key: str, year: int = 252) -> DataFrame:
    """Per strategy: alpha, beta, tracking error, information ratio and mean excess."""
    j = returns.join(bench.select("trade_date", F.col("ret").alias("b")), "trade_date")
    r, b = F.col("ret"), F.col("b")
    beta = F.try_divide(F.covar_samp(r, b), F.var_samp(b))
    te = F.stddev_samp(r - b) * (year**0.5)
    return j.groupBy(key).agg(beta.alias("beta"), ((F.avg(r) - beta * F.avg(b)) * year).alias("alpha"), te.alias("tracking_error"), (F.avg(r - b) * year).alias("excess"), F.try_divide(F.avg(r - b) * year, F.when(te > 1e-12, te)).alias("ir"))


def drawdown_periods(nav: DataFrame, key: str, least: float = 0.05) -> DataFrame:
    """Episodes at least ``least`` deep: start (date of the peak), trough, end (date of the recovery, null until then)."""
    w = W.partitionBy(key).orderBy("trade_date").rowsBetween(W.unboundedPreceding, 0)
    d = nav.withColumn("peak", F.max("nav").over(w)).withColumn("dd", F.col("nav") / F.col("peak") - 1)
    d = d.withColumn("island", F.sum((F.col("dd") == 0).cast("int")).over(w))
    e = d.groupBy(key, "island").agg(F.min("trade_date").alias("start"), F.min_by("trade_date", F.struct("dd", "trade_date")).alias("trough"), F.min("dd").alias("depth"), F.count_if(F.col("dd") < 0).alias("sessions"))
    e = e.withColumn("end", F.lead("start").over(W.partitionBy(key).orderBy("island"))).select(key, "island", "start", "trough", "end", "depth", "sessions")
    return e.where(F.col("depth") <= -least).drop("island")


def contribution(weights: DataFrame, returns: DataFrame) -> DataFrame:
    """Yesterday's weight times today's return by symbol and date."""
    w = weights.withColumn("w", F.lag("weight").over(ts()))
    return w.join(returns.select("symbol", "trade_date", "ret"), ["symbol", "trade_date"]).select("symbol", "trade_date", (F.col("w") * F.col("ret")).alias("contribution"))


def brinson(port: DataFrame, bench: DataFrame, group: str) -> DataFrame:
    """Allocation, selection and interaction by date and group; both sides: trade_date, group, weight, ret (of the group)."""
    j = port.select("trade_date", group, F.col("weight").alias("wp"), F.col("ret").alias("rp")).join(bench.select("trade_date", group, F.col("weight").alias("wb"), F.col("ret").alias("rb")), ["trade_date", group], "full")
    wp, wb = F.coalesce("wp", F.lit(0.0)), F.coalesce("wb", F.lit(0.0))
    rb = F.coalesce("rb", F.lit(0.0))
    rp = F.coalesce("rp", rb)
    j = j.withColumn("total", F.sum(wb * rb).over(W.partitionBy("trade_date")))
    return j.select("trade_date", group, ((wp - wb) * (rb - F.col("total"))).alias("allocation"), (wb * (rp - rb)).alias("selection"), ((wp - wb) * (rp - rb)).alias("interaction"))


def tail_risk(returns: DataFrame, key: str, level: float = 0.95) -> DataFrame:
    """Value at risk and the mean loss at or beyond it."""
    q = returns.groupBy(key).agg(F.percentile("ret", F.lit(1 - level)).alias("q"))
    return returns.join(q, key).groupBy(key).agg(F.first("q").alias("var"), F.avg(F.when(F.col("ret") <= F.col("q"), F.col("ret"))).alias("cvar"))


def weights(df: DataFrame, x: str, out: str = "weight") -> DataFrame:
    """Positive x by its sum over the date."""
    v = F.when(fin(x) > 0, fin(x))
    return df.withColumn(out, F.try_divide(v, F.sum(v).over(W.partitionBy("trade_date"))))


def profile(weighted: DataFrame) -> DataFrame:
    """Concentration per date: Herfindahl, effective number, top five and ten."""
    rn = F.row_number().over(W.partitionBy("trade_date").orderBy(F.desc("weight"), "symbol"))
    d = weighted.where("weight IS NOT NULL").withColumn("rn", rn)
    h = F.sum(F.col("weight") * F.col("weight"))
    return d.groupBy("trade_date").agg(h.alias("hhi"), F.try_divide(F.lit(1.0), h).alias("effective"), F.sum(F.when(F.col("rn") <= 5, F.col("weight"))).alias("top5"), F.sum(F.when(F.col("rn") <= 10, F.col("weight"))).alias("top10"))


def normal_cdf(x):
    """Standard normal distribution function by a rational approximation (fixed values), to about 1e-7."""
    z = F.abs(x)
    t = 1 / (1 + 0.2316419 * z)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = 0.3989422804014327 * F.exp(-z * z / 2) * poly
    return F.when(x >= 0, 1 - tail).otherwise(tail)


def probabilistic_sharpe(returns: DataFrame, key: str, benchmark: float = 0.0) -> DataFrame:
    """Per strategy: daily Sharpe, its moments, and the probability that the true one is above ``benchmark``."""
    r = F.col("ret")
    d = returns.where(r.isNotNull()).groupBy(key).agg(F.count("*").alias("n"), F.try_divide(F.avg(r), F.when(F.stddev_samp(r) > 1e-12, F.stddev_samp(r))).alias("sr"), F.skewness(r).alias("skew"), (F.kurtosis(r) + 3).alias("kurt"))
    spread = 1 - F.col("skew") * F.col("sr") + (F.col("kurt") - 1) / 4 * F.col("sr") * F.col("sr")
    z = (F.col("sr") - benchmark) * F.sqrt(F.col("n") - 1) / F.sqrt(F.when(spread > 0, spread))
    return d.withColumn("psr", normal_cdf(z))
