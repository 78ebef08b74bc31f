"""Overfitting measures against plain loops."""

from itertools import combinations
from statistics import NormalDist

import numpy as np
import pytest

from tessera.operators import overfit as O


def table(spark, m):
    rows = [(f"c{i:02d}", j, float(v)) for (j, i), v in np.ndenumerate(m)]
    return spark.createDataFrame(rows, "config string, trade_date int, ret double").repartition(3)


def naive(m, parts):
    k = min(parts, len(m)) // 2 * 2
    size = len(m) // k
    sums = np.round(m[: k * size].reshape(k, size, -1).sum(1) / O.GRID)
    hits = total = 0
    for half in combinations(range(k), k // 2):
        inside = sums[list(half)].sum(0)
        outside = sums.sum(0) - inside
        omega = (outside < outside[inside.argmax()]).sum() + 1
        hits += 2 * omega <= m.shape[1] + 1
        total += 1
    return hits / total, total, k, k * size


@pytest.mark.parametrize(("t", "n", "parts"), [(37, 5, 8), (40, 9, 6), (5, 3, 16), (64, 30, 10)])
def test_equals_a_loop_over_splits(spark, monkeypatch, t, n, parts):
    monkeypatch.setattr(O, "CELLS", 1000)
    m = np.random.default_rng(t).normal(size=(t, n)) * 0.01
    m[:, -1] = m[:, 0]  # a tie
    r = O.overfit_probability(table(spark, m), "config", partitions=parts).head()
    assert (pytest.approx(r["pbo"]), r["n_combos"], r["n_partitions"], r["t_used"]) == naive(m, parts)
    assert r["n_configs"] == n


def test_skill_and_noise(spark):
    rng = np.random.default_rng(1)
    noise = rng.normal(size=(320, 20)) * 0.01
    assert 0.2 < O.overfit_probability(table(spark, noise), "config").head()["pbo"] < 0.8
    assert O.overfit_probability(table(spark, noise + np.linspace(0, 0.01, 20)), "config").head()["pbo"] < 0.05


def test_degenerate_input_is_an_error(spark):
    good = np.random.default_rng(2).normal(size=(20, 3))
    for bad in (good[:3], good[:, :1], np.full((20, 3), 0.001), np.repeat(good[:, :1], 3, 1), np.where(np.arange(60).reshape(20, 3) == 7, np.nan, good)):
        with pytest.raises(ValueError):
            O.overfit_probability(table(spark, bad), "config")
    with pytest.raises(ValueError):
        O.overfit_probability(table(spark, good).where("NOT (config = 'c01' AND trade_date = 4)"), "config")
    with pytest.raises(ValueError):
        O.overfit_probability(table(spark, np.random.default_rng(2).normal(size=(60, 3))), "config", partitions=24)


def test_deflated_sharpe(spark):
    m = np.random.default_rng(5).normal(size=(200, 6)) * 0.01 + np.linspace(0, 0.002, 6)
    got = {r["config"]: r for r in O.deflated_sharpe(table(spark, m), "config").collect()}
    sr = m.mean(0) / m.std(0, ddof=1)
    g, n = 0.5772156649015329, 6
    nd = NormalDist()
    top = sr.std(ddof=1) * ((1 - g) * nd.inv_cdf(1 - 1 / n) + g * nd.inv_cdf(1 - 1 / n / np.e))
    for i in range(6):
        x = (m[:, i] - m[:, i].mean()) / m[:, i].std()
        width = 1 - (x**3).mean() * sr[i] + ((x**4).mean() - 1) / 4 * sr[i] ** 2
        r = got[f"c{i:02d}"]
        assert r["sr"] == pytest.approx(sr[i]) and r["expected_max"] == pytest.approx(top, rel=1e-6)
        assert r["dsr"] == pytest.approx(nd.cdf((sr[i] - top) * np.sqrt(199 / width)), abs=1e-6)
    with pytest.raises(ValueError):
        O.deflated_sharpe(table(spark, m[:, :1]), "config")
