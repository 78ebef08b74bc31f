"""Small frames: full windows, flat columns, gaps, ties, look-ahead."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import base, cs, indicators, ts
from tessera.operators import evaluate, feeds, groups, joins, learning, prep, quality, strategy

DAY = lambda k: dt.date(2024, 1, 1) + dt.timedelta(days=k)


def panel(spark, **by_symbol):
    rows = [(s, DAY(k), None if v is None else float(v)) for s, vs in by_symbol.items() for k, v in enumerate(vs)]
    return spark.createDataFrame(rows, "symbol string, trade_date date, x double")


def series(df, column, symbol="A"):
    return [r[0] for r in df.withColumn("__y", column).where(F.col("symbol") == symbol).orderBy("trade_date").select("__y").collect()]


def test_short_and_holed_windows_are_null(spark):
    df = ts.with_time(panel(spark, A=[1, 2, 3], B=[1, None, 3]))
    for op in (ts.ts_mean, ts.ts_std, ts.ts_sum, ts.ts_max, ts.ts_med, ts.ts_rank, ts.ts_argmax, ts.ts_slope, ts.ts_wma, ts.ts_prod):
        assert series(df, op("x", 5)) == [None] * 3
        assert series(df, op("x", 2), "B") == [None] * 3
    assert series(df, ts.ts_count("x", 2), "B") == [1, 1, 1]


def test_flat_columns(spark):
    df = ts.with_time(panel(spark, A=[2, 2, 2, 2, 2]))
    assert series(df, ts.ts_corr("x", "x", 3))[-1] is None
    assert series(df, ts.ts_skew("x", 3))[-1] is None
    assert series(df, ts.ts_rsquare("x", 3))[-1] is None
    assert series(df, cs.zscore("x")) == [0.0] * 5


def test_shifts_never_look_ahead():
    for n in (0, -1):
        with pytest.raises(ValueError):
            ts.ts_delay("x", n)


def test_values_by_hand(spark):
    df = ts.with_time(panel(spark, A=[3, 1, 2, 5]))
    assert series(df, ts.ts_argmax("x", 3))[2:] == [0.0, 2.0]
    assert series(df, ts.ts_wma("x", 3))[2] == pytest.approx((3 + 2 + 6) / 6)
    assert series(df, ts.ts_rank("x", 3))[2] == pytest.approx(2 / 3)
    assert series(df, ts.ts_ema("x", 3)) == pytest.approx([3, 2, 2, 3.5])
    assert series(df, ts.ts_slope("x", 4))[3] == pytest.approx(np.polyfit(range(4), [3, 1, 2, 5], 1)[0])


def test_cross_section_ignores_what_is_not_finite(spark):
    rows = [("A", 1.0), ("B", 1.0), ("C", 5.0), ("D", None), ("E", float("nan")), ("F", float("inf"))]
    df = spark.createDataFrame([(s, DAY(0), x) for s, x in rows], "symbol string, trade_date date, x double")
    got = {r["symbol"]: (r["r"], r["b"]) for r in df.select("symbol", cs.rank("x").alias("r"), cs.bucket("x", 3).alias("b")).collect()}
    assert got == {"A": (1.5, 1), "B": (1.5, 2), "C": (3.0, 3), "D": (None, None), "E": (None, None), "F": (None, None)}


@pytest.mark.parametrize("name", ["macd", "rsi", "atr", "obv", "cci", "wr", "roc", "mfi", "vr", "mean", "quantile", "ema"])
def test_prefix_invariance(spark, name):
    rng = np.random.default_rng(7)
    rows = [("A", DAY(k), *(float(v) for v in (p, p * 1.1, p * 0.9, p * 1.01)), float(rng.integers(1, 99)), 1.0) for k, p in enumerate(np.exp(np.cumsum(rng.normal(size=60) / 20)))]
    df = spark.createDataFrame(rows, "symbol string, trade_date date, open double, high double, low double, close double, volume double, amount double")
    column = {
        "macd": lambda: indicators.macd()["macd"],
        "rsi": indicators.rsi,
        "atr": indicators.atr,
        "obv": indicators.obv,
        "cci": indicators.cci,
        "wr": indicators.wr,
        "roc": indicators.roc,
        "mfi": indicators.mfi,
        "vr": lambda: indicators.volume_ratio(5),
        "mean": lambda: ts.ts_mean("close", 5),
        "quantile": lambda: ts.ts_quantile("close", 5),
        "ema": lambda: ts.ts_ema("close", 5),
    }[name]()
    whole = series(df, column)
    part = series(df.where(F.col("trade_date") < DAY(40)), column)
    for a, b in zip(whole[:40], part, strict=True):
        assert a == b or a == pytest.approx(b, abs=1e-9)


def test_asof_join_takes_the_newest_not_later(spark):
    left = spark.createDataFrame([("A", 5), ("A", 1), ("B", 5)], "k string, t int")
    right = spark.createDataFrame([("A", 2, "x"), ("A", 5, "y"), ("A", 6, "z")], "k string, s int, v string")
    got = {(r["k"], r["t"]): r["v"] for r in joins.asof_join(left, right, left_on="t", right_on="s", by=["k"], columns=["v"]).collect()}
    assert got == {("A", 5): "y", ("A", 1): None, ("B", 5): None}


def test_snapshots_only_join_to_one_date(spark):
    df = panel(spark, A=[1, 2])
    side = spark.createDataFrame([("A", 9)], "symbol string, heat int")
    with pytest.raises(ValueError):
        joins.attach(df, side, snapshot=True)
    assert joins.attach(df.where(F.col("trade_date") == DAY(0)), side, snapshot=True).first()["ext_heat"] == 9


def test_perfect_factor_has_ic_one(spark):
    rng = np.random.default_rng(1)
    df = panel(spark, **{f"S{k}": np.exp(np.cumsum(rng.normal(size=12) / 10)) for k in range(8)})
    df = evaluate.forward_returns(df, [1], "x")
    ic = evaluate.ic_series(df.withColumn("f", F.exp(F.col("fwd_ret_1"))), "f", "fwd_ret_1").collect()
    assert len(ic) == 11 and all(r["rank_ic"] == pytest.approx(1) for r in ic)


def test_residuals_are_orthogonal(spark):
    rng = np.random.default_rng(2)
    rows = [(f"S{k}", DAY(0), float(a), float(b), f"g{k % 3}") for k, (a, b) in enumerate(rng.normal(size=(30, 2)))]
    df = spark.createDataFrame(rows, "symbol string, trade_date date, y double, size double, grp string")
    a = {r["symbol"]: r["residual"] for r in prep.residual_by_day(df, "y", ["size"], "grp").collect()}
    b = {r["symbol"]: r["residual"] for r in prep.neutral_size_industry(df, "y", "size", "grp", "residual").collect()}
    assert a == pytest.approx(b, abs=1e-9)
    size = {r[0]: r[3] for r in rows}
    assert sum(a[s] * size[s] for s in a) == pytest.approx(0, abs=1e-9)


def test_inverse_normal(spark):
    from statistics import NormalDist

    ps = [1e-6, 0.01, 0.3, 0.5, 0.9, 0.999]
    got = [r[0] for r in spark.createDataFrame([(p,) for p in ps], "p double").select(prep.inv_norm(F.col("p"))).collect()]
    assert got == pytest.approx([NormalDist().inv_cdf(p) for p in ps], abs=1e-7)


def test_record_checks(spark):
    good = ("A", DAY(0), 10.0, 11.0, 9.0, 10.5, 100.0, 1050.0, 10.0, 1.0, False)
    names = "symbol string, trade_date date, open double, high double, low double, close double, volume double, amount double, pre_close double, adj_factor double, is_suspended boolean"

    def flags(**change):
        keys = [c.split()[0] for c in names.split(", ")]
        row = tuple(change.get(k, v) for k, v in zip(keys, good, strict=True))
        return quality.record_checks(spark.createDataFrame([row], names)).first()["quality_flags"]

    f = quality.FLAGS
    assert flags() == 0
    assert flags(high=9.0) == f["OHLC_CONFLICT"]
    assert flags(volume=-1.0) == f["NEG_QTY"]
    assert flags(amount=1e9) == f["UNIT_MISMATCH"]
    assert flags(pre_close=None) == f["PRE_CLOSE_MISSING"]
    assert flags(volume=0.0) == f["SUSPENSION_FILL"]
    assert flags(volume=0.0, open=10.5) == f["ZOMBIE"]
    assert flags(close=None) == f["PRICE_OUT_OF_RANGE"]
    assert flags(high=9.0, is_suspended=True) == 0


def test_streaks_follow_sessions(spark):
    cal = spark.createDataFrame([(DAY(k),) for k in (0, 1, 4, 5)], "trade_date date")
    pool = spark.createDataFrame([(DAY(k), "A") for k in (0, 1, 4)] + [(DAY(5), "B"), (DAY(1), "B")], "trade_date date, symbol string")
    got = {(r["symbol"], r["trade_date"]): r["streak"] for r in groups.streaks(pool, cal).collect()}
    assert got == {("A", DAY(0)): 1, ("A", DAY(1)): 2, ("A", DAY(4)): 3, ("B", DAY(1)): 1, ("B", DAY(5)): 1}


def test_drawdown_episodes(spark):
    nav = spark.createDataFrame([("s", DAY(k), v) for k, v in enumerate([1.0, 0.9, 0.8, 1.1, 1.0, 1.2])], "k string, trade_date date, nav double")
    got = [(r["start"], r["trough"], r["end"], round(r["depth"], 6)) for r in strategy.drawdown_periods(nav, "k").orderBy("start").collect()]
    assert got == [(DAY(0), DAY(2), DAY(3), -0.2), (DAY(3), DAY(4), DAY(5), round(1 / 1.1 - 1, 6))]
    lasting = spark.createDataFrame([("s", DAY(k), v) for k, v in enumerate([1.0, 2.0, 1.0, 1.5])], "k string, trade_date date, nav double")
    assert [(r["start"], r["trough"], r["end"]) for r in strategy.drawdown_periods(lasting, "k").collect()] == [(DAY(1), DAY(2), None)]


def test_a_total_loss_is_final(spark):
    df = spark.createDataFrame([("A", DAY(k), r) for k, r in enumerate([0.1, -1.0, 0.2])], "symbol string, trade_date date, ret double")
    assert [r["p"] for r in df.select(ts.ts_prod("ret", 3).alias("p"), "trade_date").orderBy("trade_date").collect()] == [None, None, -1.0]
    p = evaluate.performance(df, "symbol").first()
    assert (p["total"], p["annual"], p["max_drawdown"], p["underwater"]) == (-1.0, -1.0, -1.0, 2)
    assert [r["nav"] for r in evaluate.nav(df.withColumn("q", F.lit(1))).orderBy("trade_date").collect()] == [1.1, 0.0, 0.0]
    assert [r["level"] for r in groups.index_level(df, "symbol").orderBy("trade_date").collect()] == [1.1, 0.0, 0.0]
    assert groups.trailing(df, "symbol", [3]).first()["ret_3"] == -1.0


def test_performance_and_autocorrelation_by_hand(spark):
    df = spark.createDataFrame([("A", DAY(k), r) for k, r in enumerate([0.1, -0.1, 0.2])], "symbol string, trade_date date, ret double")
    p = evaluate.performance(df, "symbol", year=3, risk_free=0.05).first()
    vol = math.sqrt(((0.1 - 0.2 / 3) ** 2 + (0.1 + 0.2 / 3) ** 2 + (0.2 - 0.2 / 3) ** 2) / 2 * 3)
    assert abs(p["annual"] - 0.188) < 1e-12 and abs(p["sharpe"] - (0.188 - 0.05) / vol) < 1e-9
    ic = spark.createDataFrame([(DAY(k), v) for k, v in enumerate([1.0, 2.0, 4.0, 3.0])], "trade_date date, ic double")
    x, y = [2.0, 4.0, 3.0], [1.0, 2.0, 4.0]
    dx, dy = [v - 3 for v in x], [v - 7 / 3 for v in y]
    want = sum(a * b for a, b in zip(dx, dy, strict=True)) / math.sqrt(sum(a * a for a in dx) * sum(b * b for b in dy))
    assert abs(evaluate.autocorrelation(ic, "ic").first()["autocorr"] - want) < 1e-9
    assert evaluate.autocorrelation(ic.limit(2), "ic").first()["autocorr"] is None


def test_ridge_is_the_penalised_sum_of_squares(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(40, 2))
    y = x @ [2.0, -1.0] + 3 + rng.normal(size=40)
    df = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y, strict=True)], "a double, b double, label double")
    xc, yc = x - x.mean(0), y - y.mean()
    w = np.linalg.solve(xc.T @ xc + 5 * np.eye(2), xc.T @ yc)
    got = [r["prediction"] for r in learning.ridge_predictions(df, df, ["a", "b"], lam=5.0).collect()]
    assert np.allclose(got, y.mean() + xc @ w)


def test_division_by_zero_is_null(spark):
    r = spark.createDataFrame([(1.0, 0.0)], "a double, b double").select(base.div("a", "b").alias("d"), base.fin(F.lit(math.inf)).alias("f")).first()
    assert r["d"] is None and r["f"] is None


def test_stop_and_reverse_against_a_loop(spark):
    from tessera.operators import recur

    rng = np.random.default_rng(3)
    mid = 100 + np.cumsum(rng.normal(size=80))
    high, low = mid + rng.uniform(0.1, 1, 80), mid - rng.uniform(0.1, 1, 80)
    df = spark.createDataFrame([("A", DAY(k), float(h), float(x)) for k, (h, x) in enumerate(zip(high, low, strict=True))], "symbol string, trade_date date, high double, low double")
    up = high[1] >= high[0]
    ep, sar, af = (max(high[:2]), min(low[:2]), 0.02) if up else (min(low[:2]), max(high[:2]), 0.02)
    want = [(None, None), (sar, 1 if up else -1)]
    for i in range(2, 80):
        sar += af * (ep - sar)
        sar = min(sar, low[i - 1], low[i - 2]) if up else max(sar, high[i - 1], high[i - 2])
        if (low[i] < sar) if up else (high[i] > sar):
            up, sar, ep, af = not up, ep, (low[i] if up else high[i]), 0.02
        elif (high[i] > ep) if up else (low[i] < ep):
            ep, af = (high[i] if up else low[i]), min(af + 0.02, 0.2)
        want.append((sar, 1 if up else -1))
    got = [(r["sar"], r["sar_dir"]) for r in recur.stop_and_reverse(df).orderBy("trade_date").collect()]
    assert [d for _, d in got] == [d for _, d in want]
    assert got[0][0] is None and [x for x, _ in got[1:]] == pytest.approx([x for x, _ in want[1:]])


def test_missing_dates_of_every_symbol(spark):
    have = spark.createDataFrame([("a", 1), ("a", 2), ("b", 2), ("c", 3)], "symbol string, trade_date int")
    got = sorted(map(tuple, quality.missing_by_symbol(have, have).collect()))
    assert got == [("a", 3), ("b", 1), ("b", 3), ("c", 1), ("c", 2)]


def test_quoted_finds_every_source(spark):
    quote = "one two three four five six seven eight nine"
    quotes = spark.createDataFrame([(1, quote), (2, "a b c d e f g h"), (3, "short"), (4, None), (5, quote), (6, "Ninety")], "item long, text string")
    texts = [(10, f"Zero {quote.upper()}\n ten"), (11, quote.replace("nine", "ninety")), (12, None), (13, f"{quote} {quote}"), (14, quote.replace(" ", "\t"))]
    sources = spark.createDataFrame(texts, "doc long, text string")
    got = {tuple(r) for r in feeds.quoted(quotes, sources, item="item", by="doc").collect()}
    assert got == {(i, d) for i in (1, 5) for d in (10, 13, 14)} | {(2, None), (3, None), (4, None), (6, 11)}


def test_cited_in_the_named_source(spark):
    claims = spark.createDataFrame([(1, "A  b"), (1, "x"), (9, "A")], "doc long, quote string")
    got = feeds.cited(claims, spark.createDataFrame([(1, "so a B c")], "doc long, text string"), by="doc")
    assert sorted((r["doc"], r["status"]) for r in got.collect()) == [(1, "absent"), (1, "found"), (9, "no source")]
