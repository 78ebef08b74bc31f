"""Pre-processing per date: winsorise, standardise, neutralise, orthogonalise."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cs as C
from ..functions.base import cs, fin, ts


def _clip(x: Column, lo: Column, hi: Column) -> Column:
    return F.when(x.isNotNull(), F.least(F.greatest(x, lo), hi))


def clip(x, lo: float = -10.0, hi: float = 10.0) -> Column:
    return _clip(fin(x), F.lit(lo), F.lit(hi))


def three_sigma(x, n: float = 3.0) -> Column:
    v = fin(x)
    m, s = F.avg(v).over(cs()), F.stddev_samp(v).over(cs())
    return F.when(s.isNull(), v).otherwise(_clip(v, m - n * s, m + n * s))


def mad(df: DataFrame, x: str, n: float = 5.0, out: str | None = None) -> DataFrame:
    """Clip to median +- n * 1.4826 * MAD; where the MAD is zero the standard deviation serves."""
    v = fin(x)
    df = df.withColumn("__m", F.percentile(v, F.lit(0.5)).over(cs()))
    df = df.withColumn("__d", F.percentile(F.abs(v - F.col("__m")), F.lit(0.5)).over(cs()) * 1.4826)
    s = F.when(F.col("__d") > 0, F.col("__d")).otherwise(F.coalesce(F.stddev_samp(v).over(cs()), F.lit(0.0)))
    return df.withColumn(out or x, _clip(v, F.col("__m") - n * s, F.col("__m") + n * s)).drop("__m", "__d")


def quantile_clip(df: DataFrame, x: str, q: float = 0.01, out: str | None = None) -> DataFrame:
    """Clip at the values whose rank is nearest to q and 1 - q of the way."""
    v = fin(x)
    place, n = C.ordinal(x), C.count(x)
    at = lambda share: F.max(F.when(place_col == F.floor((n_col - 1) * share + 0.5) + 1, v)).over(cs())
    df = df.withColumn("__r", place).withColumn("__n", n)
    place_col, n_col = F.col("__r"), F.col("__n")
    return df.withColumn(out or x, _clip(v, at(q), at(1 - q))).drop("__r", "__n")


def huber(x, c: float = 2.0) -> Column:
    """Clip in units of the standard deviation."""
    return three_sigma(x, c)


#: Rational approximation of the inverse normal distribution (fixed values).
_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
_CC = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
_DD = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)


def _poly(x: Column, coefficients) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + c
    return out


def inv_norm(p: Column) -> Column:
    """Inverse of the standard normal distribution function, to about 1e-9."""
    low = 0.02425
    q, r = p - 0.5, (p - 0.5) * (p - 0.5)
    tail = lambda x: F.sqrt(-2 * F.log(x))
    ends = lambda x: _poly(tail(x), _CC) / (_poly(tail(x), _DD) * tail(x) + 1)
    middle = _poly(r, _A) * q / (_poly(r, _B) * r + 1)
    return F.when(p < low, ends(p)).when(p > 1 - low, -ends(1 - p)).otherwise(middle)


def rankgauss(x, limit: float = 1e-6) -> Column:
    """Normal scores of average ranks by (rank - 0.5) / count."""
    p = (C.rank(x) - 0.5) / C.count(x)
    return inv_norm(F.least(F.greatest(p, F.lit(limit)), F.lit(1 - limit)))


def minmax(x, lo: float = 0.0, hi: float = 1.0) -> Column:
    v = fin(x)
    a, b = F.min(v).over(cs()), F.max(v).over(cs())
    return F.when(v.isNotNull(), F.coalesce(lo + (hi - lo) * F.try_divide(v - a, F.when(b - a > 1e-12, b - a)), F.lit((lo + hi) / 2)))


def boxcox(df: DataFrame, x: str, lam: float = 0.0, eps: float = 1e-9, out: str | None = None) -> DataFrame:
    """Shift to above zero per date, Box-Cox, then z-score."""
    v = fin(x)
    s = v - F.min(v).over(cs()) + eps
    df = df.withColumn("__b", F.log(s) if lam == 0 else (F.pow(s, F.lit(lam)) - 1) / lam)
    return df.withColumn(out or x, C.zscore("__b")).drop("__b")


def yeo_johnson(df: DataFrame, x: str, lam: float = 0.0, out: str | None = None) -> DataFrame:
    v = fin(x)
    up = F.log1p(v) if lam == 0 else (F.pow(v + 1, F.lit(lam)) - 1) / lam
    down = -F.log1p(-v) if lam == 2 else -(F.pow(1 - v, F.lit(2.0 - lam)) - 1) / (2 - lam)
    df = df.withColumn("__y", F.when(v >= 0, up).otherwise(down))
    return df.withColumn(out or x, C.zscore("__y")).drop("__y")


def rolling_zscore(x, window: int = 20, least: int | None = None) -> Column:
    v = fin(x)
    s = F.stddev_samp(v).over(ts(window))
    z = F.when(s > 1e-12, (v - F.avg(v).over(ts(window))) / s).otherwise(F.lit(0.0))
    return F.when(v.isNotNull() & (F.count(v).over(ts(window)) >= (least or window)), z)


def rolling_minmax(x, window: int = 20, least: int | None = None) -> Column:
    v = fin(x)
    a, b = F.min(v).over(ts(window)), F.max(v).over(ts(window))
    return F.when(v.isNotNull() & (F.count(v).over(ts(window)) >= (least or window)), F.coalesce(F.try_divide(v - a, F.when(b - a > 1e-12, b - a)), F.lit(0.5)))


def volatility_scaling(x, window: int = 20, shift: bool = True) -> Column:
    """x by its rolling deviation, of the row before unless told otherwise."""
    v = fin(x)
    s = F.when(F.count(v).over(ts(window)) == window, F.stddev_samp(v).over(ts(window)))
    s = F.lag(s).over(ts()) if shift else s
    return F.try_divide(v, F.when(s > 1e-12, s))


def industry_mean(x, group: str = "industry") -> Column:
    """x less the mean of its date and group."""
    return C.demean(x, group)


def neutral_size_industry(df: DataFrame, x: str, size: str, group: str, out: str) -> DataFrame:
    """Residual of x on one number and a category per date: both are centred in their group, then one slope (windows only)."""
    v, s = fin(x), fin(size)
    both = v.isNotNull() & s.isNotNull() & F.col(group).isNotNull()
    df = df.withColumn("__ok", both).withColumn("__v", F.when(both, v)).withColumn("__s", F.when(both, s))
    within = cs(group)
    df = df.withColumn("__vd", F.col("__v") - F.avg("__v").over(within)).withColumn("__sd", F.col("__s") - F.avg("__s").over(within))
    slope = F.try_divide(F.sum(F.col("__vd") * F.col("__sd")).over(cs()), F.sum(F.col("__sd") * F.col("__sd")).over(cs()))
    return df.withColumn(out, F.col("__vd") - F.coalesce(slope, F.lit(0.0)) * F.col("__sd")).drop("__ok", "__v", "__s", "__vd", "__sd")


def residual_by_day(df: DataFrame, x: str, numbers: list[str], group: str | None = None, *, out: str = "residual", kind: str = "ols", lam: float = 1e-3, alpha: float = 1e-4) -> DataFrame:
    """Residuals of a regression per date on [1, numbers, dummies]; rows with gaps get null. kind: ols, ridge or lasso.

    A date is one group: as wide as the market is, not as long as its history.
    """
    need = [x, *numbers, *([group] if group else [])]

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.copy()
        pdf[out] = np.nan
        ok = np.isfinite(pdf[[x, *numbers]].astype(float)).all(axis=1)
        if group:
            ok &= pdf[group].notna()
        sub = pdf[ok]
        cols = [np.ones(len(sub)), *[sub[c].to_numpy(float) for c in numbers]]
        if group and len(sub):
            cols += [(sub[group] == g).to_numpy(float) for g in sorted(sub[group].unique())[1:]]
        z, y = np.column_stack(cols), sub[x].to_numpy(float)
        if len(y) > z.shape[1]:
            if kind == "ols":
                beta = np.linalg.lstsq(z, y, rcond=None)[0]
            elif kind == "ridge":
                penalty = lam * np.eye(z.shape[1])
                penalty[0, 0] = 0
                beta = np.linalg.solve(z.T @ z + penalty, z.T @ y)
            else:
                beta = _lasso(z, y, alpha)
            pdf.loc[ok, out] = y - z @ beta
        return pdf

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + f", `{out}` double"
    solved = df.groupBy("trade_date").applyInPandas(solve, schema)
    assert set(need) <= set(df.columns)
    return solved.withColumn(out, fin(out))


def _lasso(z: np.ndarray, y: np.ndarray, alpha: float, rounds: int = 500) -> np.ndarray:
    beta, norm = np.zeros(z.shape[1]), (z * z).sum(axis=0)
    rest = y.copy()
    for _ in range(rounds):
        before = beta.copy()
        for j in range(z.shape[1]):
            if norm[j]:
                rho = z[:, j] @ rest + norm[j] * beta[j]
                new = rho / norm[j] if j == 0 else np.sign(rho) * max(0.0, abs(rho) - alpha * len(y)) / norm[j]
                rest -= z[:, j] * (new - beta[j])
                beta[j] = new
        if np.abs(beta - before).max() < 1e-10:
            break
    return beta


def gram_schmidt(df: DataFrame, columns: list[str]) -> DataFrame:
    """Each column less its regression (with intercept) on those before it, per date; the first stays."""
    for i, x in enumerate(columns):
        for y in columns[:i]:
            a, b = F.col(x), F.col(y)
            slope = F.try_divide(F.covar_pop(a, b).over(cs()), F.var_pop(b).over(cs()))
            df = df.withColumn(x, a - F.avg(a).over(cs()) - F.coalesce(slope, F.lit(0.0)) * (b - F.avg(b).over(cs())))
    return df


def symmetric(df: DataFrame, columns: list[str]) -> DataFrame:
    """Symmetric orthogonalisation per date: standardised columns times the inverse root of their Gram matrix."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, z = pdf.copy(), pdf[columns].astype(float)
        ok = np.isfinite(z).all(axis=1)
        z = z[ok].to_numpy()
        done = np.full((len(pdf), len(columns)), np.nan)
        if len(z) > len(columns):
            s = z.std(axis=0)
            z = (z - z.mean(axis=0)) / np.where(s > 1e-12, s, 1)
            w, v = np.linalg.eigh(z.T @ z)
            done[ok.to_numpy()] = z @ v @ np.diag(1 / np.sqrt(np.maximum(w, 1e-12))) @ v.T
        pdf[columns] = done
        return pdf

    return df.groupBy("trade_date").applyInPandas(solve, df.schema)


def run(df: DataFrame, columns: list[str], steps) -> DataFrame:
    """Ordered steps, each (frame, column) -> frame, over many columns."""
    for step in steps:
        for x in columns:
            df = step(df, x)
    return df
