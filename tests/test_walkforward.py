"""Walk-forward windows, fits and versions against refitting each window by itself."""

import datetime as dt

import numpy as np
import pytest

from tessera.operators import learning as L
from tessera.operators import walkforward as WF

MONTHS = dict(train=6, valid=2, test=2, step=3)


def shifted(d, months):
    y, m = divmod(d.month - 1 + months, 12)
    return dt.date(d.year + y, m + 1, d.day)


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(7)
    start = dt.date(2020, 1, 5)
    days = [start + dt.timedelta(days=int(x)) for x in np.flatnonzero(rng.random(700) < 0.3)]
    days[0] = start
    rows = []
    for d in sorted(set(days)):
        for s in range(int(rng.integers(4, 9))):
            a, b = rng.normal(size=2) * (1, 50) + (3, 100)
            rows.append((f"s{s}", d, float(a), float(b), 7.0, float(0.02 * a - 0.001 * b + rng.normal() * 0.05)))
    rows.append(("odd", days[9], None, 1.0, 7.0, 0.1))
    rows.append(("odd", days[9 + 1], float("nan"), 1.0, 7.0, 0.1))
    return rows


@pytest.fixture(scope="module")
def panel(spark, data):
    return spark.createDataFrame(data, "symbol string, trade_date date, a double, b double, flat double, label double").repartition(4)


def naive_windows(dates, purge, embargo):
    out, k = [], 0
    while True:
        tr_s = shifted(dates[0], k * MONTHS["step"])
        tr_e, va_e, te_e = (shifted(dates[0], k * MONTHS["step"] + n) for n in (6, 8, 10))
        if te_e > dates[-1]:
            return out
        train = [d for d in dates if tr_s <= d <= tr_e]
        valid = [d for d in dates if tr_e < d <= va_e]
        test = [d for d in dates if va_e < d <= te_e]
        for name, own in (("train", train[: len(train) - purge]), ("valid", valid[embargo : len(valid) - purge]), ("test", test[embargo:])):
            out.append((k, name, own[0], own[-1]))
        k += 1


@pytest.mark.parametrize(("purge", "embargo"), [(0, 0), (3, 1)])
def test_windows(panel, data, purge, embargo):
    got = sorted(tuple(r)[:4] for r in WF.windows(panel, purge=purge, embargo=embargo, **MONTHS).collect())
    assert got == sorted(naive_windows(sorted({r[1] for r in data}), purge, embargo)) and len(got) > 9


def test_windows_that_cannot_be(panel):
    for how in (dict(train=60), dict(purge=500, **MONTHS), dict(embargo=-1, **MONTHS), dict(step=0)):
        with pytest.raises(ValueError):
            WF.windows(panel, **how)
    with pytest.raises(ValueError):
        WF.windows(panel.limit(0), **MONTHS)


def refit(rows, first, last, lam):
    own = np.array([r[2:] for r in rows if first <= r[1] <= last and r[2] is not None and np.isfinite(r[2])])
    x, y = own[:, :3], own[:, 3]
    mean, sd = x.mean(0), x.std(0, ddof=1)
    z = np.where(sd > 1e-12, (x - mean) / np.where(sd > 1e-12, sd, 1), 0)
    w = np.linalg.solve(z.T @ z + lam * np.eye(3), z.T @ (y - y.mean())) / np.where(sd > 1e-12, sd, np.inf)
    return len(own), w, y.mean() - w @ mean


def test_all_windows_in_one_pass_equal_refitting_each(panel, data):
    features = ["a", "b", "flat"]
    spans, made, predicted = WF.retrain(panel, features, horizon=2, lam=2.0, **MONTHS)
    bounds = {(r["window"], r["part"]): (r["first"], r["last"]) for r in spans.collect()}
    got = {r["window"]: r for r in made.collect()}
    assert len(got) == len(bounds) // 3 > 3
    standing, promoted = None, {}
    want = {}
    for k in sorted(got):
        n, w, b = refit(data, *bounds[k, "train"], 2.0)
        assert got[k]["train_rows"] == n and np.allclose(got[k]["weights"], w) and got[k]["intercept"] == pytest.approx(b)
        first, last = bounds[k, "test"]
        own = [r for r in data if first <= r[1] <= last and r[2] is not None and np.isfinite(r[2])]
        for r in own:
            want[k, r[0], r[1]] = b + w @ np.array(r[2:5])
        ics = []
        for d in {r[1] for r in own}:
            day = [(want[k, r[0], d], r[5]) for r in own if r[1] == d]
            if len(day) >= 5:
                ics.append(np.corrcoef(np.array(day).T)[0, 1])
        metric = np.mean(ics)
        assert got[k]["metric"] == pytest.approx(metric) and got[k]["test_rows"] == len(own)
        promoted[k] = standing is None or metric >= standing
        standing = metric if promoted[k] else standing
    assert {k: r["promoted"] for k, r in got.items()} == promoted and len(set(promoted.values())) == 2
    mine = {(r["window"], r["symbol"], r["trade_date"]): r["prediction"] for r in predicted.collect()}
    assert mine.keys() == want.keys() and all(mine[k] == pytest.approx(v) for k, v in want.items())
    live = WF.signals(panel, features, spans, made).collect()
    starts = sorted((bounds[k, "test"][0], k) for k in got if promoted[k])
    for r in live:
        k = max(k for d, k in starts if d <= r["trade_date"])
        x = next(d for d in data if d[0] == r["symbol"] and d[1] == r["trade_date"])
        assert r["version"] == k and r["signal"] == pytest.approx(got[k]["intercept"] + np.dot(got[k]["weights"], x[2:5]))
    assert len(live) == sum(r[1] >= starts[0][0] and r[2] is not None and np.isfinite(r[2]) for r in data)


def test_the_bar_for_promotion(spark):
    models = spark.createDataFrame([(k, 1) for k in range(5)], "window int, train_rows long")
    predicted = spark.createDataFrame([(k, f"s{s}", "2020-01-01", float(s), float(s if s else z)) for k, z in enumerate((1, 9, 0, 0)) for s in range(6)], "window int, symbol string, trade_date string, prediction double, label double")
    got = [(r["metric"] is not None, r["test_rows"], r["promoted"]) for r in WF.versions(models, predicted, improvement=0.01).orderBy("window").collect()]
    assert got == [(True, 6, True), (True, 6, False), (True, 6, True), (True, 6, False), (False, 0, False)]


def test_newest_signal_by_key(spark):
    df = spark.createDataFrame([("a", 1, 0.5, 1), ("a", 1, 0.7, 3), ("a", 1, 0.6, 2), ("b", 1, 0.1, 1)], "symbol string, trade_date int, signal double, version int")
    assert sorted(map(tuple, WF.newest(df).collect())) == [("a", 1, 0.7, 3), ("b", 1, 0.1, 1)]


def test_paths_test_each_block_as_often(panel):
    split = WF.paths(L.combinatorial(panel, 6, 2), 2)
    by = {}
    for r in split.select("split", "path").distinct().collect():
        by.setdefault(r["path"], []).append(r["split"])
    assert {k: len(v) for k, v in by.items()} == {0: 9, 1: 6}
    with pytest.raises(ValueError):
        WF.paths(split, 0)
