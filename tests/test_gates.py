"""Gates over many candidates against loops over dates and pairs."""

import numpy as np
import pandas as pd
import pytest

from tessera.operators import gates as G

NAMES = [f"c{i}" for i in range(9)]


def make(seed, days):
    rng = np.random.default_rng(seed)
    rows = []
    for d in range(days):
        n = int(rng.integers(3, 14))
        base = rng.normal(size=(n, 9))
        base[:, 1] = base[:, 0] + rng.normal(size=n) * 0.2
        base[:, 4] = 1.0
        ret = base[:, 0] * 0.05 + base[:, 3] * 0.04 - base[:, 6] * 0.05 + rng.normal(size=n) * 0.03
        base[:, 7] = np.round(base[:, 7])
        x = np.where(rng.random((n, 9)) < 0.04, np.nan, base)
        for i in range(n):
            rows.append((f"s{i}", d, *[None if np.isnan(v) else float(v) for v in x[i]], float(rng.normal() * 0.001), float(ret[i]) if rng.random() > 0.05 else None))
    return rows


SCHEMA = "symbol string, trade_date int, " + ", ".join(f"{c} double" for c in NAMES) + ", thin double, ret double"


@pytest.fixture(scope="module")
def tables(spark):
    out = []
    for seed, days in ((1, 60), (2, 40)):
        rows = make(seed, days)
        out.append((spark.createDataFrame(rows, SCHEMA).repartition(5), pd.DataFrame(rows, columns=["symbol", "trade_date", *NAMES, "thin", "ret"])))
    return out


def naive_corr(pdf):
    total, n = np.zeros((9, 9)), 0
    for _, g in pdf.groupby("trade_date"):
        r = g[NAMES].rank().to_numpy()
        r = r[~np.isnan(r).any(1)]
        if len(r) >= 5:
            with np.errstate(all="ignore"):
                total += np.nan_to_num(np.corrcoef(r.T))
            n += 1
    return total / n, n


def naive_ic(pdf, c, ret="ret"):
    out = []
    for _, g in pdf.groupby("trade_date"):
        g = g[[c, ret]].astype(float).dropna()
        if len(g) >= 5 and g[c].std() > 1e-12 and g[ret].std() > 1e-12:
            out.append(np.corrcoef(g[c], g[ret])[0, 1])
    return out


def test_correlations(tables):
    df, pdf = tables[0]
    got, n = G.correlations(df, NAMES)
    want, m = naive_corr(pdf)
    np.fill_diagonal(want, np.diag(got))
    assert n == m and np.allclose(got, want, atol=1e-9)
    assert np.allclose(np.delete(np.diag(got), 4), 1) and got[4, 4] == 0
    assert [p[:2] for p in G.redundant(got, NAMES, 0.7)] == [("c0", "c1")]
    assert G.independent(got, [1, 0, 2, 3], 0.7) == [1, 2, 3]
    with pytest.raises(ValueError):
        G.correlations(df, NAMES[:1])
    with pytest.raises(ValueError):
        G.correlations(df.limit(0), NAMES)


def test_daily_ic(tables):
    df, pdf = tables[0]
    got = {r["candidate"]: r for r in G.daily_ic(df, NAMES, "ret").collect()}
    for c in NAMES:
        want = naive_ic(pdf, c)
        assert got[c]["n"] == len(want)
        assert (got[c]["mean"] is None) == (not want)
        if want:
            assert got[c]["mean"] == pytest.approx(np.mean(want)) and got[c]["std"] == pytest.approx(np.std(want, ddof=1))


def test_screen_equals_the_loop(tables):
    (train, ptrain), (valid, pvalid) = tables
    neutral = {"c2": "c5", "c6": "thin"}
    corr, _ = naive_corr(ptrain)
    survivors, want = [], []
    for i, c in enumerate(NAMES):
        raw, own, after = naive_ic(ptrain, c), naive_ic(ptrain, neutral.get(c, c)), naive_ic(pvalid, c)
        if not raw or not own:
            reason = "COMPUTE_FAIL"
        elif c in neutral and 1 - abs(np.mean(own)) / abs(np.mean(raw)) > 0.8:
            reason = "SIZE_PROXY"
        elif abs(np.mean(own)) < 0.03:
            reason = "LOW_IC"
        elif any(abs(corr[i, j]) >= 0.7 for j in survivors):
            reason = "REDUNDANT"
        elif abs(np.mean(after) / np.std(after, ddof=1) * len(after) ** 0.5) < G.threshold(i + 1):
            reason = "LOW_TSTAT"
        else:
            reason = None
            survivors.append(i)
        want.append((c, i, reason is None, reason))
    got = G.screen(train, valid, NAMES, "ret", neutral=neutral, least_ic=0.03).orderBy("place")
    assert [tuple(r)[:4] for r in got.collect()] == want
    reasons = {w[3] for w in want}
    assert {None, "COMPUTE_FAIL", "SIZE_PROXY", "LOW_IC", "REDUNDANT"} <= reasons
    counts = {r["reason"]: r["n"] for r in G.outcomes(got).collect()}
    assert counts == {k or "PASSED": [w[3] for w in want].count(k) for k in reasons}


def test_numbers():
    assert G.threshold(1) == 1.96 and G.threshold(100) == pytest.approx((2 * np.log(100)) ** 0.5)
    assert G.fitness(0.03, 0.03) == 0.03 and G.fitness(0.01, 0.04) == pytest.approx(0.01 - 0.5)


def naive_neutral(g, c, levels):
    """One date's column, clipped, standardised and regressed on size and dummies as one matrix."""
    v = g[c].to_numpy(float)
    have = ~np.isnan(v)
    if not have.any():
        return v
    middle = np.nanmedian(v)
    scale = 1.4826 * np.nanmedian(abs(v - middle))
    scale = scale if scale > 1e-12 else np.std(v[have], ddof=1)
    v = np.clip(v, middle - 5 * scale, middle + 5 * scale)
    spread = np.nanstd(v, ddof=1)
    v = (v - np.nanmean(v)) / (spread if spread > 1e-12 else 1)
    size = g["float_mv"].to_numpy(float)
    ok, out = have & ~np.isnan(size), np.full(len(v), np.nan)
    if ok.sum() < len(levels) + 2:
        out[ok] = v[ok] - v[ok].mean()
        return out
    z = np.column_stack([np.ones(ok.sum()), size[ok], *[(g["industry"] == x).to_numpy(float)[ok] for x in levels[1:]]])
    out[ok] = v[ok] - z @ np.linalg.lstsq(z, v[ok], rcond=None)[0]
    return out


def test_query_makes_every_candidate_neutral(spark):
    """Against pandas on the whole panel: both covariates for all nine, purge and embargo, returns inside their part."""
    from tessera.plans import q_risk

    names = list(q_risk._CANDIDATES)
    pdf = q_risk._candidates(spark, "/root/testdata/sf0.01").select("symbol", "trade_date", "float_mv", "industry", "close", *names).toPandas().sort_values(["symbol", "trade_date"])
    days = sorted(pdf["trade_date"].unique())
    a, b = int(len(days) * 0.7), int(len(days) * 0.85)
    train, valid = (pdf[pdf["trade_date"].isin(d)].copy() for d in (days[: a - 1], days[a + 1 : b - 1]))
    for part in (train, valid):
        part["ret"] = part.groupby("symbol")["close"].shift(-1) / part["close"] - 1
    train = train.dropna(subset=["ret"])
    levels = sorted(train["industry"].unique())
    for c in names:
        train[f"{c}_n"] = pd.concat([pd.Series(naive_neutral(g, c, levels), g.index) for _, g in train.groupby("trade_date")])
    survivors, want = [], []
    for i, c in enumerate(names):
        ic, raw, after = naive_ic(train, f"{c}_n"), np.mean(naive_ic(train, c)), naive_ic(valid, c)
        ic, t = np.mean(ic), None
        if 1 - abs(ic) / abs(raw) > 0.8:
            reason = "SIZE_PROXY"
        elif abs(ic) < 0.02:
            reason = "LOW_IC"
        elif survivors and G.likeness(spark.createDataFrame(train[["trade_date", *survivors, c]]), survivors, [c])[c] >= 0.7:
            reason = "REDUNDANT"
        else:
            t = np.mean(after) / np.std(after, ddof=1) * len(after) ** 0.5
            reason = None if abs(t) >= G.threshold(i + 1) else "LOW_TSTAT"
            survivors += [c] * (reason is None)
        want.append((c, reason, ic, raw, t))
    got = q_risk.candidate_gates(spark, "/root/testdata/sf0.01").orderBy("place").collect()
    assert [(r["candidate"], r["reason"], r["passed"]) for r in got] == [(c, why, why is None) for c, why, *_ in want]
    for r, (_, _, *numbers) in zip(got, want, strict=True):
        assert [r["ic"], r["ic_raw"], r["t_valid"]] == [None if x is None else pytest.approx(x, abs=1e-6) for x in numbers]


def test_redundancy_goes_by_the_survivors_alone(spark):
    """A candidate without a value takes no rows from the others, and one with gaps only its own."""
    rng = np.random.default_rng(5)
    rows = []
    for d in range(30):
        for i in range(20):
            x, z = rng.normal(size=2)
            rows.append((f"s{i}", d, float(x), float(x + rng.normal() * 0.1), None, float(z) if i < 6 else None, float(x * 0.05 + rng.normal() * 0.02)))
    df = spark.createDataFrame(rows, "symbol string, trade_date int, a double, b double, none double, gaps double, ret double")
    got = {r["candidate"]: r["reason"] for r in G.screen(df, df, ["a", "none", "gaps", "b"], "ret", least_ic=0.0).collect()}
    assert got["a"] is None and got["none"] == "COMPUTE_FAIL" and got["b"] == "REDUNDANT" and got["gaps"] != "REDUNDANT"
    pdf = pd.DataFrame(rows, columns=["symbol", "trade_date", "a", "b", "none", "gaps", "ret"])
    assert G.likeness(df, ["a"], ["gaps", "none", "b"]) == {"gaps": pytest.approx(naive_rank(pdf, "a", "gaps")), "none": 0.0, "b": pytest.approx(naive_rank(pdf, "a", "b"))}


def naive_rank(pdf, a, b):
    return abs(np.mean([np.corrcoef(g[[a, b]].rank().dropna().T)[0, 1] for _, g in pdf.groupby("trade_date")]))
