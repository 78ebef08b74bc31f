"""Queries of the column operators: over time, across a date, element-wise, features and indicators."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from ..functions import base, cs, el, indicators, patterns, ts
from ..operators import recur
from . import panel
from .pairs import CS, ORACLE_SQL, WS, W, columns, full, near, query, w

_C, _V = "close", "volume"


def _timed(spark, sf_dir):
    return ts.with_time(panel.bars(spark, sf_dir))


_TIMED = panel.BARS + f", timed AS (SELECT *, row_number() {WS}::DOUBLE AS t FROM bars)"

columns(
    "ts_moments",
    panel.bars,
    panel.BARS,
    "bars",
    lambda: {
        "mean_5": ts.ts_mean(_C, 5),
        "std_10": ts.ts_std(_C, 10),
        "var_5": ts.ts_var(_C, 5),
        "sum_5": ts.ts_sum(_V, 5),
        "max_6": ts.ts_max(_C, 6),
        "min_6": ts.ts_min(_C, 6),
        "count_4": ts.ts_count(_C, 4),
        "return_3": ts.ts_return(_C, 3),
        "delay_2": ts.ts_delay(_C, 2),
        "delta_1": ts.ts_delta(_C, 1),
        "prod_4": ts.ts_prod("turnover_rate", 4),
    },
    {
        "mean_5": full(_C, 5, f"avg(close) {w(5)}"),
        "std_10": full(_C, 10, f"stddev_samp(close) {w(10)}"),
        "var_5": full(_C, 5, f"var_samp(close) {w(5)}"),
        "sum_5": full(_V, 5, f"sum(volume) {w(5)}"),
        "max_6": full(_C, 6, f"max(close) {w(6)}"),
        "min_6": full(_C, 6, f"min(close) {w(6)}"),
        "count_4": f"/*raw*/count(close) {w(4)}",
        "return_3": f"close / lag(close, 3) {WS} - 1",
        "delay_2": f"lag(close, 2) {WS}",
        "delta_1": f"close - lag(close) {WS}",
        "prod_4": full("turnover_rate", 4, f"product(1 + turnover_rate) {w(4)} - 1"),
    },
    digits=4,
    doc="Rolling moments, extremes, shifts and compounding.",
)

columns(
    "ts_order",
    panel.bars,
    panel.BARS,
    "bars",
    lambda: {
        "med_7": ts.ts_med(_C, 7),
        "q80_10": ts.ts_quantile(_C, 10),
        "argmax_6": ts.ts_argmax(_C, 6),
        "argmin_6": ts.ts_argmin(_C, 6),
        "rank_8": ts.ts_rank(_C, 8),
    },
    {
        "med_7": full(_C, 7, f"quantile_cont(close, 0.5) {w(7)}"),
        "q80_10": full(_C, 10, f"quantile_cont(close, 0.8) {w(10)}"),
        "argmax_6": full(_C, 6, f"list_position(list(close) {w(6)}, max(close) {w(6)}) - 1"),
        "argmin_6": full(_C, 6, f"list_position(list(close) {w(6)}, min(close) {w(6)}) - 1"),
        "rank_8": full(_C, 8, f"len(list_filter(list(close) {w(8)}, lambda v: v <= close)) / 8.0"),
    },
    doc="Rolling median, quantile, places of extremes and rank.",
)

columns(
    "ts_pairs",
    panel.bars,
    panel.BARS,
    "bars",
    lambda: {
        "corr_10": ts.ts_corr(_C, _V, 10),
        "cov_10": ts.ts_cov(_C, _V, 10),
        "beta_10": ts.ts_regbeta(_C, _V, 10),
    },
    {
        "corr_10": full(_C, 10, f"corr(close, volume) {w(10)}"),
        "cov_10": full(_C, 10, f"covar_samp(close, volume) {w(10)}"),
        "beta_10": full(_C, 10, f"regr_slope(close, volume) {w(10)}"),
    },
    digits=5,
    doc="Rolling correlation, covariance and regression beta of two columns.",
)

columns(
    "ts_regression",
    _timed,
    _TIMED,
    "timed",
    lambda: {
        "slope_8": ts.ts_slope(_C, 8),
        "rsq_8": ts.ts_rsquare(_C, 8),
        "resi_8": ts.ts_resi(_C, 8),
        "wma_6": ts.ts_wma(_C, 6),
    },
    {
        "slope_8": full(_C, 8, f"regr_slope(close, t) {w(8)}"),
        "rsq_8": full(_C, 8, f"CASE WHEN stddev_samp(close) {w(8)} > 1e-12 THEN regr_r2(close, t) {w(8)} END"),
        "resi_8": full(_C, 8, f"sqrt(greatest(0, var_pop(close) {w(8)} - pow(covar_pop(t, close) {w(8)}, 2) / var_pop(t) {w(8)}))"),
        "wma_6": full(_C, 6, f"(sum(t * close) {w(6)} - (t - 6) * sum(close) {w(6)}) / 21.0"),
    },
    digits=5,
    doc="Rolling line fit by place and weighted mean.",
)


def _central(x, n):
    a = f"list({x}) {w(n)}"
    mean = f"list_avg({a})"
    m = lambda k: f"list_avg(list_transform({a}, lambda v: pow(v - {mean}, {k})))"
    return m


_m10 = _central(_C, 10)
columns(
    "ts_shape",
    panel.bars,
    panel.BARS,
    "bars",
    lambda: {
        "skew_10": ts.ts_skew(_C, 10),
        "kurt_10": ts.ts_kurt(_C, 10),
    },
    {
        "skew_10": full(_C, 10, f"CASE WHEN stddev_samp(close) {w(10)} > 1e-12 THEN {_m10(3)} / pow({_m10(2)}, 1.5) END"),
        "kurt_10": full(_C, 10, f"CASE WHEN stddev_samp(close) {w(10)} > 1e-12 THEN {_m10(4)} / pow({_m10(2)}, 2) - 3 END"),
    },
    digits=5,
    doc="Rolling skewness and excess kurtosis by population moments.",
)


def ema_sql(x: str, alpha: float) -> str:
    return f"list_reduce(list({x}) OVER {W} ROWS UNBOUNDED PRECEDING), lambda e, v: {alpha!r} * v + {1 - alpha!r} * e)"


columns(
    "ts_ema",
    panel.bars,
    panel.BARS,
    "bars",
    lambda: {
        "ema_6": ts.ts_ema(_C, 6),
        "ema_12": ts.ts_ema(_C, 12),
    },
    {
        "ema_6": ema_sql(_C, 2 / 7),
        "ema_12": ema_sql(_C, 2 / 13),
    },
    doc="Exponential means, seeded by the first value.",
)

_rank = f"rank() OVER (PARTITION BY trade_date ORDER BY close) + (count(*) OVER (PARTITION BY trade_date, close) - 1) / 2.0"  # noqa: F541
columns(
    "cs_operators",
    panel.bars,
    panel.BARS,
    "bars",
    lambda: {
        "rank": cs.rank(_C),
        "scale": cs.scale(_C),
        "demean": cs.demean(_C),
        "zscore": cs.zscore(_C),
        "bucket": cs.bucket(_C, 5),
    },
    {
        "rank": _rank,
        "scale": f"close / sum(abs(close)) {CS}",
        "demean": f"close - avg(close) {CS}",
        "zscore": f"CASE WHEN coalesce(stddev_samp(close) {CS}, 0) <= 1e-12 THEN 0 ELSE (close - avg(close) {CS}) / stddev_samp(close) {CS} END",
        "bucket": f"/*raw*/ceil(row_number() OVER (PARTITION BY trade_date ORDER BY close, symbol) * 5.0 / count(*) {CS})::INT",
    },
    doc="Per date: average rank, scale, demean, z-score, bucket.",
)

_d = "close - open"
_dc = lambda: F.col("close") - F.col("open")
columns(
    "el_operators",
    panel.bars,
    panel.BARS,
    "bars",
    lambda: {
        "a": el.el_abs(_dc()),
        "s": el.el_sign(_dc()),
        "l1": el.el_log1p(_dc() / 1e6),
        "lg": el.el_log(_dc()),
        "sq": el.el_sqrt(_dc()),
        "pw": el.el_power(_dc() / 100, 2),
        "sp": el.el_signed_power(_dc(), 0.5),
        "gr": el.el_greater(_C, "open"),
        "le": el.el_less(_C, "open"),
        "cond": el.el_if(_dc(), "high", "low"),
        "b_not": el.bool_not(_dc()),
        "b_and": el.bool_and(_dc(), F.col("volume") - 100),
        "b_or": el.bool_or(_dc(), F.col("volume") - 100),
        "b_eq": el.bool_eq("high", _C),
        "b_ne": el.bool_ne("high", _C),
        "b_ge": el.bool_ge(_C, "open"),
        "b_le": el.bool_le(_C, "open"),
        "dv": base.div("amount", _V),
    },
    {
        "a": f"abs({_d})",
        "s": f"/*raw*/sign({_d})::DOUBLE",
        "l1": f"ln(1 + ({_d}) / 1e6)",
        "lg": f"CASE WHEN {_d} > 0 THEN ln({_d}) END",
        "sq": f"CASE WHEN {_d} >= 0 THEN sqrt({_d}) END",
        "pw": f"pow(({_d}) / 100, 2)",
        "sp": f"sign({_d}) * sqrt(abs({_d}))",
        "gr": "greatest(close, open)",
        "le": "least(close, open)",
        "cond": f"CASE WHEN {_d} > 0 THEN high ELSE low END",
        "b_not": f"/*raw*/(NOT ({_d} > 0))::INT::DOUBLE",
        "b_and": f"/*raw*/(({_d} > 0) AND (volume - 100 > 0))::INT::DOUBLE",
        "b_or": f"/*raw*/(({_d} > 0) OR (volume - 100 > 0))::INT::DOUBLE",
        "b_eq": "/*raw*/(high = close)::INT::DOUBLE",
        "b_ne": "/*raw*/(high <> close)::INT::DOUBLE",
        "b_ge": "/*raw*/(close >= open)::INT::DOUBLE",
        "b_le": "/*raw*/(close <= open)::INT::DOUBLE",
        "dv": "CASE WHEN volume <> 0 THEN amount / volume END",
    },
    doc="Element-wise maths, logic and safe division.",
)

# candle shape and price ratios
columns(
    "alpha_candle",
    panel.bars,
    panel.BARS,
    "bars",
    lambda: {k: indicators.alpha_candle()[k] for k, e in {
            "KMID": "(close - open) / open",
            "KLEN": "(high - low) / open",
            "KMID2": "(close - open) / (high - low + 1e-12)",
            "KUP": "(high - greatest(open, close)) / open",
            "KUP2": "(high - greatest(open, close)) / (high - low + 1e-12)",
            "KLOW": "(least(open, close) - low) / open",
            "KLOW2": "(least(open, close) - low) / (high - low + 1e-12)",
            "KSFT": "(2 * close - high - low) / open",
            "KSFT2": "(2 * close - high - low) / (high - low + 1e-12)",
            "OPEN0": "open / close",
            "HIGH0": "high / close",
            "LOW0": "low / close",
            "VWAP0": "amount / volume / close",
        }.items()},
    {k: e for k, e in {
            "KMID": "(close - open) / open",
            "KLEN": "(high - low) / open",
            "KMID2": "(close - open) / (high - low + 1e-12)",
            "KUP": "(high - greatest(open, close)) / open",
            "KUP2": "(high - greatest(open, close)) / (high - low + 1e-12)",
            "KLOW": "(least(open, close) - low) / open",
            "KLOW2": "(least(open, close) - low) / (high - low + 1e-12)",
            "KSFT": "(2 * close - high - low) / open",
            "KSFT2": "(2 * close - high - low) / (high - low + 1e-12)",
            "OPEN0": "open / close",
            "HIGH0": "high / close",
            "LOW0": "low / close",
            "VWAP0": "amount / volume / close",
        }.items()},
    doc="Candle-shape and price-ratio features.",
)


def _changes(spark, sf_dir):
    return indicators.with_changes(panel.bars(spark, sf_dir))


_CHANGES = (
    panel.BARS
    + f""", chg AS (SELECT *, row_number() {WS}::DOUBLE AS t, close - lag(close) {WS} AS pc, volume - lag(volume) {WS} AS pv,
  close / lag(close) {WS} AS cr, close / lag(close) {WS} - 1 AS ret, ln(volume + 1) AS lv, ln(volume / lag(volume) {WS} + 1) AS lvc FROM bars)"""
)


def _alpha_sql(d: int) -> dict[str, str]:
    f = lambda x, e: full(x, d, e)
    s = lambda e, x: f(x, f"sum({e}) {w(d)} / (sum(abs({x})) {w(d)} + 1e-12)")
    lo, hi = f"min(low) {w(d)}", f"max(high) {w(d)}"
    imax, imin = f"(list_position(list(high) {w(d)}, {hi}) - 1) / {d}.0", f"(list_position(list(low) {w(d)}, {lo}) - 1) / {d}.0"
    return {
        "ROC": f"lag(close, {d}) {WS} / close",
        "MA": f("close", f"avg(close) {w(d)} / close"),
        "STD": f("close", f"stddev_samp(close) {w(d)} / close"),
        "BETA": f("close", f"regr_slope(close, t) {w(d)} / close"),
        "RSQR": f("close", f"CASE WHEN stddev_samp(close) {w(d)} > 1e-12 THEN regr_r2(close, t) {w(d)} ELSE 0 END"),
        "RESI": f("close", f"sqrt(greatest(0, var_pop(close) {w(d)} - pow(covar_pop(t, close) {w(d)}, 2) / var_pop(t) {w(d)})) / close"),
        "MAX": f("high", f"{hi} / close"),
        "MIN": f("low", f"{lo} / close"),
        "QTLU": f("close", f"quantile_cont(close, 0.8) {w(d)} / close"),
        "QTLD": f("close", f"quantile_cont(close, 0.2) {w(d)} / close"),
        "RANK": f("close", f"len(list_filter(list(close) {w(d)}, lambda v: v <= close)) / {d}.0"),
        "RSV": f("close", f"(close - {lo}) / ({hi} - {lo} + 1e-12)"),
        "IMAX": f("high", imax),
        "IMIN": f("low", imin),
        "IMXD": f("low", f"{imax} - {imin}"),
        "CORR": f("close", f"corr(close, lv) {w(d)}"),
        "CORD": f("cr", f"corr(cr, lvc) {w(d)}"),
        "CNTP": f("pc", f"avg((pc > 0)::INT) {w(d)}"),
        "CNTN": f("pc", f"avg((pc < 0)::INT) {w(d)}"),
        "CNTD": f("pc", f"avg((pc > 0)::INT - (pc < 0)::INT) {w(d)}"),
        "SUMP": s("greatest(pc, 0)", "pc"),
        "SUMN": s("greatest(-pc, 0)", "pc"),
        "SUMD": s("pc", "pc"),
        "VMA": f("volume", f"avg(volume) {w(d)} / (volume + 1e-12)"),
        "VSTD": f("volume", f"stddev_samp(volume) {w(d)} / (volume + 1e-12)"),
        "WVMA": f("ret", f"stddev_samp(abs(ret) * volume) {w(d)} / (avg(abs(ret) * volume) {w(d)} + 1e-12)"),
        "VSUMP": s("greatest(pv, 0)", "pv"),
        "VSUMN": s("greatest(-pv, 0)", "pv"),
        "VSUMD": s("pv", "pv"),
    }


for _n in (5, 10, 20, 30, 60):
    columns(
        f"alpha_rolling_{_n}",
        _changes,
        _CHANGES,
        "chg",
        partial(indicators.alpha_rolling, _n),
        {f"{k}{_n}": e for k, e in _alpha_sql(_n).items()},
        digits=5,
        doc=f"All rolling feature families over {_n} rows.",
    )

_lagged = {"CLOSE": "close", "OPEN": "open", "HIGH": "high", "LOW": "low", "VWAP": "(amount / volume)"}
columns(
    "alpha_lags",
    panel.bars,
    panel.BARS,
    "bars",
    indicators.alpha360,
    {
        f"{k}{i}": f"lag(volume, {i}) {WS} / (volume + 1e-12)" if k == "VOLUME" else f"lag({_lagged[k]}, {i}) {WS} / close"
        for i in range(59, -1, -1)
        for k in (*_lagged, "VOLUME")
    },
    digits=5,
    doc="Sixty lags of six fields.",
)

_tr = f"greatest(high - low, abs(high - lag(close) {WS}), abs(low - lag(close) {WS}))"
_dif = f"({ema_sql('close', 2 / 13)} - {ema_sql('close', 2 / 27)})"
_TP = panel.BARS + f", tp AS (SELECT *, (high + low + close) / 3 AS tp, lag((high + low + close) / 3) {WS} AS tp0, close - lag(close) {WS} AS ch, {_tr} AS tr, {_dif} AS dif FROM bars)"
_n20 = f"OVER {W} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)"
_n5 = f"OVER {W} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)"
_hm, _lm = f"max(high) {w(14)}", f"min(low) {w(14)}"
columns(
    "indicators_window",
    panel.bars,
    _TP,
    "tp",
    lambda: {
        "ma_5": indicators.ma(5),
        "ma_60": indicators.ma(60),
        "boll_mid": indicators.boll()["boll_mid"],
        "boll_up": indicators.boll()["boll_up"],
        "boll_low": indicators.boll()["boll_low"],
        "bbi": indicators.bbi(),
        "vratio": indicators.volume_ratio(),
        "surge": indicators.volume_surge(),
        "turn_5": indicators.ma(5, "turnover_rate"),
        "obv": indicators.obv(),
        "cci": indicators.cci(),
        "wr": indicators.wr(),
        "roc": indicators.roc(),
        "mfi": indicators.mfi(),
        **{k: indicators.pivots()[k] for k, e in {"P": "(H + L + C) / 3", "R1": "2 * (H + L + C) / 3 - L", "S1": "2 * (H + L + C) / 3 - H", "R2": "(H + L + C) / 3 + H - L", "S2": "(H + L + C) / 3 - H + L", "R3": "H + 2 * ((H + L + C) / 3 - L)", "S3": "L - 2 * (H - (H + L + C) / 3)"}.items()},
    },
    {
        "ma_5": full("close", 5, f"avg(close) {w(5)}"),
        "ma_60": full("close", 60, f"avg(close) {w(60)}"),
        "boll_mid": full("close", 20, f"avg(close) {w(20)}"),
        "boll_up": full("close", 20, f"avg(close) {w(20)} + 2 * stddev_samp(close) {w(20)}"),
        "boll_low": full("close", 20, f"avg(close) {w(20)} - 2 * stddev_samp(close) {w(20)}"),
        "bbi": full("close", 24, f"(avg(close) {w(3)} + avg(close) {w(6)} + avg(close) {w(12)} + avg(close) {w(24)}) / 4"),
        "vratio": f"CASE WHEN count(volume) {_n20} = 20 THEN volume / avg(volume) {_n20} END",
        "surge": f"/*raw*/(CASE WHEN count(volume) {_n5} = 5 AND volume / avg(volume) {_n5} > 1.5 THEN 1 ELSE 0 END)::TINYINT",
        "turn_5": full("turnover_rate", 5, f"avg(turnover_rate) {w(5)}"),
        "obv": f"sum(coalesce(sign(ch), 0) * volume) OVER {W} ROWS UNBOUNDED PRECEDING)",
        "cci": full("tp", 14, f"(tp - avg(tp) {w(14)}) / (0.015 * list_avg(list_transform(list(tp) {w(14)}, lambda v: abs(v - list_avg(list(tp) {w(14)})))))"),
        "wr": full("high", 14, f"({_hm} - close) / nullif({_hm} - {_lm}, 0) * -100"),
        "roc": f"100 * (close / lag(close, 12) {WS} - 1)",
        "mfi": f"CASE WHEN count(tp0) {w(14)} = 14 THEN 100 * sum(CASE WHEN tp > tp0 THEN tp * volume ELSE 0 END) {w(14)} / nullif(sum(CASE WHEN tp <> tp0 THEN tp * volume ELSE 0 END) {w(14)}, 0) END",
        **{k: e.replace("H", f"lag(high) {WS}").replace("L", f"lag(low) {WS}").replace("C", f"lag(close) {WS}") for k, e in {"P": "(H + L + C) / 3", "R1": "2 * (H + L + C) / 3 - L", "S1": "2 * (H + L + C) / 3 - H", "R2": "(H + L + C) / 3 + H - L", "S2": "(H + L + C) / 3 - H + L", "R3": "H + 2 * ((H + L + C) / 3 - L)", "S3": "L - 2 * (H - (H + L + C) / 3)"}.items()},
    },
    digits=5,
    doc="Moving averages, bands, volume measures, oscillators and pivots.",
)

_ge, _le2 = (ema_sql(f"CASE WHEN {x} > 0 THEN {x} ELSE 0 END", 1 / 14) for x in ("ch", "-ch"))
columns(
    "indicators_folded",
    panel.bars,
    _TP,
    "tp",
    lambda: {
        "dif": indicators.macd()["dif"],
        "dea": indicators.macd()["dea"],
        "macd": indicators.macd()["macd"],
        "rsi": indicators.rsi(),
        "atr": indicators.atr(),
    },
    {
        "dif": "dif",
        "dea": ema_sql("dif", 0.2),
        "macd": f"2 * (dif - {ema_sql('dif', 0.2)})",
        "rsi": f"CASE WHEN ch IS NOT NULL THEN 100 * {_ge} / nullif({_ge} + {_le2}, 0) END",
        "atr": ema_sql("tr", 1 / 14),
    },
    digits=4,
    doc="MACD, RSI and ATR by folds in the JVM.",
)

_PARTS = {"o": "open", "h": "high", "l": "low", "c": "close", "b": "abs(close - open)", "r": "high - low", "u": "high - greatest(open, close)", "w": "least(open, close) - low", "t": "greatest(open, close)", "m": "least(open, close)"}
_LAGS = ", ".join(f"lag({k}, {n}) {WS} AS {k}{n}" for n in range(1, patterns.BACK + 1) for k in _PARTS)


@query(
    f"WITH {panel.BARS}, p AS (SELECT *, {', '.join(f'{e} AS {k}' for k, e in _PARTS.items())} FROM bars), q AS (SELECT *, {_LAGS} FROM p) SELECT symbol, trade_date, "
    + ", ".join(f"(CASE WHEN {patterns.condition(n)} THEN 1 ELSE 0 END)::TINYINT AS pattern_{n}" for n in patterns.names())
    + " FROM q"
)
def candle_patterns(spark, sf_dir):
    """Candlestick patterns as 0/1 columns, all from one window."""
    return patterns.flags(panel.bars(spark, sf_dir)).select("symbol", "trade_date", *[f"pattern_{n}" for n in patterns.names()])


@query(ORACLE_SQL["indicators_folded"])
def indicators_recurrent(spark, sf_dir):
    """MACD, RSI and ATR from one ordered pass per symbol."""
    d = recur.oscillators(panel.bars(spark, sf_dir).select("symbol", "trade_date", "high", "low", "close"))
    return d.select("symbol", "trade_date", *[near(F.col(c), 4).alias(c) for c in ("dif", "dea", "macd", "rsi", "atr")])


@query()
def stop_and_reverse(spark, sf_dir):
    """The parabolic stop of every symbol."""
    return recur.stop_and_reverse(panel.bars(spark, sf_dir).select("symbol", "trade_date", "high", "low"))
