"""How far a search over many configurations fools itself: symmetric cross-validation and the deflated Sharpe ratio."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.base import fin
from .strategy import normal_cdf

#: Sums of returns are compared on this grid, so that equal configurations tie in any order of summation.
GRID = 1e-10
#: Splits at most; (split, configuration) cells of a product at a time.
MOST, CELLS = 200_000, 4_000_000
#: Euler's constant (fixed value).
EULER = 0.5772156649015329


def _splits(k: int) -> np.ndarray:
    """All choices of half of k blocks, as rows of 0 and 1 in the order of their bits."""
    bits = np.array([m for m in range(1 << k) if m.bit_count() == k // 2], np.int64)
    return (bits[:, None] >> np.arange(k) & 1).astype(np.int64)


def block_sums(returns: DataFrame, key: str, partitions: int) -> tuple[DataFrame, int, int]:
    """(configuration and b0 .. : its summed returns by block of dates as multiples of GRID; blocks; dates used).

    Blocks are of equal length in time and even in number, at most ``partitions``; dates that fill no block are left out.
    """
    days = returns.select("trade_date").distinct().withColumn("__at", F.row_number().over(W.orderBy("trade_date")) - 1)
    t = days.count()
    k = min(partitions, t)
    k -= k % 2
    if t < 4 or k < 4:
        raise ValueError(f"{t} dates in {k} blocks: four of each are needed")
    if math.comb(k, k // 2) > MOST:
        raise ValueError(f"{partitions} blocks have {math.comb(k, k // 2)} splits; at most {MOST} are tried")
    size = t // k
    rows = returns.join(days, "trade_date").withColumn("__r", fin("ret"))
    block = F.floor(F.col("__at") / size)
    each = [F.round(F.sum(F.when(block == b, F.col("__r"))) / GRID).cast("long").alias(f"b{b}") for b in range(k)]
    return rows.groupBy(key).agg(F.count("__r").alias("__n"), F.count("*").alias("__rows"), *each), k, size * k


def overfit_probability(returns: DataFrame, key: str, *, partitions: int = 16) -> DataFrame:
    """One row (pbo, n_combos, n_partitions, t_used, n_configs): how often the best configuration in sample is below the median out of sample.

    ``returns``: key, trade_date, ret, a finite return of every configuration on every date. Every half of the blocks is
    in sample once, the other half out. All splits are one product: a table of block sums by configuration, dealt in
    chunks, times the bits of the splits, which every task makes itself. A first pass keeps each chunk's best by split, a
    second one, given the best of all, counts what stands below it out of sample. Ties in sample go to the smaller key.
    Missing or non-finite returns, fewer than two configurations and configurations that are all alike are errors.
    """
    from ..sources.shared import kept

    sums, k, used = block_sums(returns, key, partitions)
    sums = kept(sums, "blocks")
    names = [f"b{b}" for b in range(k)]
    spread = F.greatest(*[F.max(c) - F.min(c) for c in names])
    dates = returns.select("trade_date").distinct().count()
    head = sums.agg(F.count("*").alias("n"), spread.alias("spread"), F.max(F.when((F.col("__n") != dates) | (F.col("__rows") != dates), 1)).alias("odd")).head()
    if head["n"] < 2:
        raise ValueError(f"{head['n']} configurations: two are needed")
    if head["odd"]:
        raise ValueError("every configuration needs one finite return on every date")
    if not head["spread"]:
        raise ValueError("all configurations are alike: nothing to rank")
    n, combos = head["n"], math.comb(k, k // 2)
    chunk = max(1, CELLS // combos)
    dealt = sums.withColumn("__chunk", F.pmod(F.xxhash64(key), F.lit(-(-n // chunk)))).select("__chunk", key, *names)
    kind = dict(sums.dtypes)[key]

    def halves(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        m, bits = pdf[names].to_numpy(np.int64), _splits(k)
        inside = bits @ m.T
        return inside, m.sum(1)[None, :] - inside

    def best(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key, ignore_index=True)
        inside, outside = halves(pdf)
        at = inside.argmax(1)
        row = np.arange(len(inside))
        return pd.DataFrame({"split": row, "inside": inside[row, at], "outside": outside[row, at], "who": pdf[key].to_numpy()[at]})

    found = dealt.groupBy("__chunk").applyInPandas(best, f"split int, inside long, outside long, who {kind}")
    first = F.row_number().over(W.partitionBy("split").orderBy(F.desc("inside"), "who"))
    # at most MOST numbers
    champions = found.withColumn("k", first).where("k = 1").select("split", "outside").toPandas().sort_values("split")["outside"].to_numpy(np.int64)
    shared = returns.sparkSession.sparkContext.broadcast(champions)

    def below(pdf: pd.DataFrame) -> pd.DataFrame:
        _, outside = halves(pdf)
        return pd.DataFrame({"split": np.arange(len(outside)), "below": (outside < shared.value[:, None]).sum(1)})

    counts = dealt.groupBy("__chunk").applyInPandas(below, "split int, below long").groupBy("split").agg(F.sum("below").alias("below"))
    pbo = F.avg((2 * (F.col("below") + 1) <= n + 1).cast("double"))
    return counts.agg(pbo.alias("pbo"), F.count("*").alias("n_combos")).select("pbo", "n_combos", F.lit(k).alias("n_partitions"), F.lit(used).alias("t_used"), F.lit(n).cast("long").alias("n_configs"))


def deflated_sharpe(returns: DataFrame, key: str, n_trials: int | None = None) -> DataFrame:
    """Per configuration: sr (by date), expected_max (of as many trials without skill) and dsr, the probability to be above that.

    Trials default to the configurations at hand, and the variance of their Sharpe ratios is what these show. Fewer than
    two trials leave nothing to deflate, an error; configurations without variance have no ratio (null).
    """
    from .prep import inv_norm

    r = F.col("ret")
    sd = F.when(F.stddev_samp(r) > 1e-12, F.stddev_samp(r))
    each = returns.where(fin("ret").isNotNull()).groupBy(key).agg(F.count("*").alias("n"), F.try_divide(F.avg(r), sd).alias("sr"), F.skewness(r).alias("skew"), (F.kurtosis(r) + 3).alias("kurt"))
    trials = each.agg(F.var_samp("sr").alias("var"), F.count("sr").alias("trials"))
    if n_trials is not None:
        trials = trials.withColumn("trials", F.lit(n_trials))
    if (n_trials if n_trials is not None else trials.head()["trials"]) < 2:
        raise ValueError("a single trial has no selection to correct for")
    top = lambda p: inv_norm(1 - 1 / (F.col("trials") * p))
    most = F.sqrt(F.col("var")) * ((1 - EULER) * top(F.lit(1.0)) + EULER * top(F.lit(math.e)))
    d = each.crossJoin(F.broadcast(trials.select(most.alias("expected_max"))))  # one row
    width = 1 - F.col("skew") * F.col("sr") + (F.col("kurt") - 1) / 4 * F.col("sr") * F.col("sr")
    z = (F.col("sr") - F.col("expected_max")) * F.sqrt(F.col("n") - 1) / F.sqrt(F.when(width > 0, width))
    return d.select(key, "n", "sr", "expected_max", normal_cdf(z).alias("dsr"))
