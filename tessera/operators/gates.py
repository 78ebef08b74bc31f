"""Gates for many candidate columns at once: what they foretell, how alike they are, which of them stay.

Dates stream through the tasks; each cross-section is a small matrix of candidates, and only sums over dates leave.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.base import fin

#: Reasons to leave a candidate out, in the order of the gates.
REASONS = ("COMPUTE_FAIL", "SIZE_PROXY", "LOW_IC", "REDUNDANT", "LOW_TSTAT", "OOS_FAIL")


def _dates(batches):
    """Whole dates, one after the other."""
    held: list[pd.DataFrame] = []
    for pdf in batches:
        while len(pdf):
            day = pdf["trade_date"].iat[0]
            if held and held[-1]["trade_date"].iat[0] != day:
                yield pd.concat(held)
                held = []
            same = int((pdf["trade_date"] == day).sum())  # sorted: a date's rows are together
            held.append(pdf.iloc[:same])
            pdf = pdf.iloc[same:]
    if held:
        yield pd.concat(held)


def _by_date(batches, names: list[str]):
    """Matrices of whole dates, one after the other: rows are symbols, columns ``names``; NaN where null."""
    for pdf in _dates(batches):
        yield pdf[names].to_numpy(float)


def _streamed(panel: DataFrame, names: list[str], *kept: str) -> DataFrame:
    rows = panel.select("trade_date", *[fin(F.col(c).cast("double")).alias(c) for c in names], *kept)
    return rows.repartition("trade_date").sortWithinPartitions("trade_date")


def _ranks(x: np.ndarray) -> np.ndarray:
    """Average ranks of each column's values; NaN stays."""
    return pd.DataFrame(x).rank().to_numpy()


def correlations(panel: DataFrame, candidates: list[str], *, least: int = 5) -> tuple[np.ndarray, int]:
    """(mean over dates of the rank correlation of every pair, how many dates count).

    Ranks are of all values of a candidate on a date; then rows that lack a candidate go, and dates with fewer than
    ``least`` rows. A flat candidate has correlation 0. Driver: one number a pair.
    """
    k = len(candidates)
    if k < 2:
        raise ValueError("two candidates are needed")

    def summed(batches):
        total, days = np.zeros((k, k)), 0
        for x in _by_date(batches, candidates):
            r = _ranks(x)
            r = r[~np.isnan(r).any(1)]
            if len(r) < least:
                continue
            r = (r - r.mean(0)) / (r.std(0) + 1e-12)
            total += r.T @ r / len(r)
            days += 1
        yield pd.DataFrame({"i": np.arange(k), "days": days, "own": [row.tobytes() for row in total]})

    def added(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"i": [pdf["i"].iat[0]], "days": [int(pdf["days"].sum())], "own": [sum(np.frombuffer(z) for z in pdf["own"]).tobytes()]})

    schema = "i int, days long, own binary"
    got = sorted(_streamed(panel, candidates).mapInPandas(summed, schema).groupBy("i").applyInPandas(added, schema).collect())
    days = got[0]["days"] if got else 0
    if not days:
        raise ValueError(f"no date has {least} rows with all candidates")
    return np.array([np.frombuffer(r["own"]) for r in got]) / days, days


def likeness(panel: DataFrame, chosen: list[str], others: list[str], *, least: int = 5) -> dict[str, float]:
    """For each of ``others`` its largest mean rank correlation, either sign, with one of ``chosen``.

    As in ``correlations`` of the chosen and that one alone, so what the rest lacks bears on nothing; 0 where no date counts.
    """
    c, k = len(chosen), len(others)

    def summed(batches):
        total, days = np.zeros((k, c)), np.zeros(k, np.int64)
        for x in _by_date(batches, [*chosen, *others]):
            r = _ranks(x)
            have = ~np.isnan(r)
            all_chosen = have[:, :c].all(1)
            for j in range(k):
                own = r[all_chosen & have[:, c + j]]
                if len(own) < least:
                    continue
                own = own[:, [*range(c), c + j]]
                own = (own - own.mean(0)) / (own.std(0) + 1e-12)
                total[j] += own[:, :c].T @ own[:, c] / len(own)
                days[j] += 1
        yield pd.DataFrame({"i": np.repeat(np.arange(k), c), "j": np.tile(np.arange(c), k), "days": np.repeat(days, c), "total": total.ravel()})

    sums = _streamed(panel, [*chosen, *others]).mapInPandas(summed, "i int, j int, days long, total double")
    got = sums.groupBy("i", "j").agg(F.sum("days").alias("days"), F.sum("total").alias("total")).collect()
    return {o: max((abs(r["total"]) / r["days"] for r in got if r["i"] == i and r["days"]), default=0.0) for i, o in enumerate(others)}


def residuals(x: np.ndarray, size: np.ndarray, group: np.ndarray, least: int, n: float = 5.0) -> np.ndarray:
    """The columns of one date's matrix, clipped to median +- n * 1.4826 * MAD, standardised, less what size and group explain.

    ``group`` numbers each row's category from 0. Least squares on 1, size and the categories, on the rows that have the
    value and a size: both are centred in their category, then one slope. With fewer rows than ``least`` the mean alone goes.
    """
    out = np.full(x.shape, np.nan)
    for j, v in enumerate(x.T):
        have = ~np.isnan(v)
        v = v[have]
        if not len(v):
            continue
        std = lambda z: float(z.std(ddof=1)) if len(z) > 1 else 0.0
        middle = np.median(v)
        scale = 1.4826 * np.median(np.abs(v - middle))
        scale = scale if scale > 1e-12 else std(v)
        v = np.clip(v, middle - n * scale, middle + n * scale)
        spread = std(v)
        v = (v - v.mean()) / (spread if spread > 1e-12 else 1.0)
        ok = ~np.isnan(size[have])
        v, s, g = v[ok], size[have][ok], group[have][ok]
        if len(v) >= least:
            count = np.maximum(np.bincount(g), 1)
            v = v - (np.bincount(g, v) / count)[g]
            within = s - (np.bincount(g, s) / count)[g]
            square = within @ within
            if square > 1e-20 * max(1.0, s @ s):
                v = v - v @ within / square * within
        elif len(v):
            v = v - v.mean()
        out[np.flatnonzero(have)[ok], j] = v
    return out


def daily_ic(panel: DataFrame, candidates: list[str], ret: str, *, least: int = 5, covariates: tuple[str, str] | None = None) -> DataFrame:
    """(candidate, n, mean, std): how many dates count, mean and deviation over dates of each candidate's correlation with ``ret``.

    A date counts for a candidate with at least ``least`` rows that have both; a flat side has no correlation. With
    ``covariates``, a number and a category, each candidate is made neutral to them first, date by date (see ``residuals``;
    rows without a category are one of their own); dates with fewer rows than the regression has numbers, and one, are only centred.
    """
    size, group = covariates or (None, None)
    extra = [size] if covariates else []
    enough = max(panel.select(group).distinct().count() - 1, 1) + 3 if covariates else 0

    def days(batches):
        if not covariates:
            yield from _by_date(batches, [*candidates, ret])
            return
        for pdf in _dates(batches):
            x, of = pdf[candidates].to_numpy(float), pd.factorize(pdf[group], use_na_sentinel=False)[0]
            yield np.column_stack([residuals(x, pdf[size].to_numpy(float), of, enough), pdf[ret].to_numpy(float)])

    def summed(batches):
        n, s, q = (np.zeros(len(candidates)) for _ in range(3))
        for m in days(batches):
            x, y = m[:, :-1], m[:, -1:]
            both = ~np.isnan(x) & ~np.isnan(y)
            count = both.sum(0)
            x, y = np.where(both, x, 0.0), np.where(both, y, 0.0)
            c = np.maximum(count, 1)
            x, y = np.where(both, x - x.sum(0) / c, 0.0), np.where(both, y - y.sum(0) / c, 0.0)
            sx, sy = np.sqrt((x * x).sum(0) / np.maximum(count - 1, 1)), np.sqrt((y * y).sum(0) / np.maximum(count - 1, 1))
            good = (count >= least) & (sx > 1e-12) & (sy > 1e-12)
            ic = np.where(good, (x * y).sum(0) / np.maximum(count - 1, 1) / np.where(good, sx * sy, 1), 0.0)
            n, s, q = n + good, s + ic, q + ic * ic
        yield pd.DataFrame({"candidate": candidates, "n": n.astype(np.int64), "s": s, "q": q})

    sums = _streamed(panel, [*candidates, ret, *extra], *([group] if covariates else [])).mapInPandas(summed, "candidate string, n long, s double, q double")
    total = sums.groupBy("candidate").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    mean = F.try_divide("s", F.col("n").cast("double"))
    var = F.when(F.col("n") > 1, F.greatest(F.lit(0.0), (F.col("q") - F.col("s") * mean) / (F.col("n") - 1)))
    return total.select("candidate", "n", mean.alias("mean"), F.sqrt(var).alias("std"))


def threshold(trials: int) -> float:
    """The t that so many trials ask for."""
    return math.sqrt(2 * math.log(trials)) if trials >= 2 else 1.96


def fitness(ic: float, raw: float, hinge: float = 0.5) -> float:
    """Size of the neutral correlation, less twice what its loss against the raw one exceeds ``hinge``."""
    return abs(ic) - 2 * max(0.0, 1 - abs(ic) / max(abs(raw), 1e-12) - hinge)


def redundant(matrix: np.ndarray, names: list[str], limit: float = 0.7) -> list[tuple[str, str, float]]:
    """Pairs at least as correlated as ``limit``, either sign."""
    i, j = np.nonzero(np.triu(np.abs(matrix) >= limit, 1))
    return [(names[a], names[b], float(matrix[a, b])) for a, b in zip(i, j, strict=True)]


def independent(matrix: np.ndarray, order: list[int], limit: float = 0.7) -> list[int]:
    """In ``order``, those not as correlated as ``limit`` with one kept before: a greedy independent set."""
    kept: list[int] = []
    for i in order:
        if not kept or np.abs(matrix[i, kept]).max() < limit:
            kept.append(i)
    return kept


def screen(
    train: DataFrame,
    valid: DataFrame,
    candidates: list[str],
    ret: str,
    *,
    neutral: dict[str, str] | None = None,
    covariates: tuple[str, str] | None = None,
    least_ic: float = 0.02,
    decay: float = 0.8,
    limit: float = 0.7,
) -> DataFrame:
    """(candidate, place, passed, reason, ic, ic_raw, t_valid): every candidate through all gates, in the order given.

    On the training rows: a candidate without a correlation fails (COMPUTE_FAIL), one that loses more than ``decay`` of it
    when neutral is a proxy (SIZE_PROXY), one under ``least_ic`` is weak (LOW_IC); one correlated by ``limit`` or more with a
    survivor before it goes (REDUNDANT). Neutral is the column ``neutral[c]``, or else, with ``covariates``, a number and a
    category, what these leave of the candidate. On the validation rows its t must reach what the trials
    so far ask for (LOW_TSTAT; OOS_FAIL where there is none). Only those that pass all are survivors. Four aggregations, and
    one for each survivor; the driver sees a few numbers a candidate and, for each survivor, one a candidate and survivor.
    """
    neutral = neutral or {}
    of = lambda df, names, **how: {r["candidate"]: r for r in daily_ic(df, sorted(set(names)), ret, **how).collect()}
    inside, outside = of(train, [*candidates, *neutral.values()]), of(valid, candidates)
    rest = [c for c in candidates if c not in neutral] if covariates else []
    cleaned = of(train, rest, covariates=covariates) if rest else {}
    first = {c: cleaned[c] if c in cleaned else inside[neutral.get(c, c)] for c in candidates}

    def weak(c: str) -> str | None:
        raw, own = inside[c]["mean"], first[c]["mean"]
        if own is None or raw is None:
            return "COMPUTE_FAIL"
        if (c in neutral or c in cleaned) and 1 - abs(own) / max(abs(raw), 1e-12) > decay:
            return "SIZE_PROXY"
        return "LOW_IC" if abs(own) < least_ic else None

    survivors: list[str] = []
    alike: dict[str, float] = {}
    out = []
    for i, c in enumerate(candidates):
        after, t, reason = outside[c], None, weak(c)
        if reason is None and alike.get(c, 0.0) >= limit:
            reason = "REDUNDANT"
        if reason is None:
            t = after["mean"] / after["std"] * math.sqrt(after["n"]) if after["mean"] is not None and after["std"] else None
            reason = "OOS_FAIL" if t is None else "LOW_TSTAT" if abs(t) < threshold(i + 1) else None
        if reason is None:
            survivors.append(c)
            left = [x for x in candidates[i + 1 :] if weak(x) is None]
            alike = likeness(train, survivors, left) if left else {}
        out.append((c, i, reason is None, reason, first[c]["mean"], inside[c]["mean"], t))
    return train.sparkSession.createDataFrame(out, "candidate string, place int, passed boolean, reason string, ic double, ic_raw double, t_valid double")


def outcomes(screened: DataFrame) -> DataFrame:
    """(reason, n): how many candidates each gate left out, and how many passed."""
    return screened.groupBy(F.coalesce("reason", F.lit("PASSED")).alias("reason")).agg(F.count("*").alias("n"))
