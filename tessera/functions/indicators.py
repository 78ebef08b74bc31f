"""Feature families and technical indicators as columns over a symbol's bars (open, high, low, close, volume, amount)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import ts as T
from .base import col, corr_over, div, full, running, ts

EPS = 1e-12


def _bar() -> tuple[Column, ...]:
    return tuple(F.col(x) for x in ("open", "high", "low", "close", "volume"))


def alpha_candle() -> dict[str, Column]:
    """Candle shape and price ratios."""
    _o, _h, _l, _c, _v = _bar()
    _range = _h - _l + EPS
    _top, _low = F.greatest(_o, _c), F.least(_o, _c)
    return {
        "KMID": div(_c - _o, _o),
        "KLEN": div(_h - _l, _o),
        "KMID2": div(_c - _o, _range),
        "KUP": div(_h - _top, _o),
        "KUP2": div(_h - _top, _range),
        "KLOW": div(_low - _l, _o),
        "KLOW2": div(_low - _l, _range),
        "KSFT": div(2 * _c - _h - _l, _o),
        "KSFT2": div(2 * _c - _h - _l, _range),
        "OPEN0": div(_o, _c),
        "HIGH0": div(_h, _c),
        "LOW0": div(_l, _c),
        "VWAP0": div(div("amount", _v), _c),
    }


def with_changes(panel):
    """Adds what the rolling families read: changes of close and volume, and the place in time."""
    _, _, _, _c, _v = _bar()
    prev = lambda x: F.lag(x).over(ts())
    return T.with_time(panel).withColumns(
        {
            "__pc": _c - prev("close"),
            "__pv": _v - prev("volume"),
            "__ret": div(_c, prev("close")) - 1,
            "__cr": div(_c, prev("close")),
            "__lv": F.log(_v + 1),
            "__lvc": F.log(div(_v, prev("volume")) + 1),
        }
    )


def alpha_rolling(d: int) -> dict[str, Column]:
    """The rolling families for a window of d rows; the panel needs with_changes."""
    _, _h, _l, _c, _v = _bar()
    pc, pv = F.col("__pc"), F.col("__pv")
    pos = lambda x: F.when(x.isNotNull(), F.greatest(x, F.lit(0.0)))
    total = lambda x: T.ts_sum(x, d)
    share = lambda x, of: total(x) / (total(F.abs(of)) + EPS)
    traded = F.abs(F.col("__ret")) * _v
    imax, imin = T.ts_argmax(_h, d) / d, T.ts_argmin(_l, d) / d
    low, high = T.ts_min(_l, d), T.ts_max(_h, d)
    fields = {
        "ROC": div(T.ts_delay(_c, d), _c),
        "MA": div(T.ts_mean(_c, d), _c),
        "STD": div(T.ts_std(_c, d), _c),
        "BETA": div(T.ts_slope(_c, d), _c),
        "RSQR": full(_c, d, F.coalesce(T.ts_rsquare(_c, d), F.lit(0.0))),
        "RESI": div(T.ts_resi(_c, d), _c),
        "MAX": div(high, _c),
        "MIN": div(low, _c),
        "QTLU": div(T.ts_quantile(_c, d, 0.8), _c),
        "QTLD": div(T.ts_quantile(_c, d, 0.2), _c),
        "RANK": T.ts_rank(_c, d),
        "RSV": (_c - low) / (high - low + EPS),
        "IMAX": imax,
        "IMIN": imin,
        "IMXD": imax - imin,
        "CORR": full(_c, d, corr_over(_c, "__lv", ts(d))),
        "CORD": full("__cr", d, corr_over("__cr", "__lvc", ts(d))),
        "CNTP": T.ts_mean((pc > 0).cast("double"), d),
        "CNTN": T.ts_mean((pc < 0).cast("double"), d),
        "CNTD": T.ts_mean((pc > 0).cast("double") - (pc < 0).cast("double"), d),
        "SUMP": share(pos(pc), pc),
        "SUMN": share(pos(-pc), pc),
        "SUMD": share(pos(pc) - pos(-pc), pc),
        "VMA": T.ts_mean(_v, d) / (_v + EPS),
        "VSTD": T.ts_std(_v, d) / (_v + EPS),
        "WVMA": T.ts_std(traded, d) / (T.ts_mean(traded, d) + EPS),
        "VSUMP": share(pos(pv), pv),
        "VSUMN": share(pos(-pv), pv),
        "VSUMD": share(pos(pv) - pos(-pv), pv),
    }
    return {f"{k}{d}": c for k, c in fields.items()}


def alpha360(lags: int = 60) -> dict[str, Column]:
    """Lagged prices over close and volumes over volume, oldest first."""
    _o, _h, _l, _c, _v = _bar()
    vwap = div("amount", _v)
    out = {}
    for i in range(lags - 1, -1, -1):
        back = lambda x, i=i: F.lag(x, i).over(ts()) if i else col(x)
        for name, x in (("CLOSE", _c), ("OPEN", _o), ("HIGH", _h), ("LOW", _l), ("VWAP", vwap)):
            out[f"{name}{i}"] = div(back(x), _c)
        out[f"VOLUME{i}"] = div(back(_v), _v + EPS)
    return out


def ma(n: int, x="close") -> Column:
    return T.ts_mean(x, n)


def boll(n: int = 20, k: float = 2.0, x="close") -> dict[str, Column]:
    mid, std = T.ts_mean(x, n), T.ts_std(x, n)
    return {"boll_mid": mid, "boll_up": mid + k * std, "boll_low": mid - k * std}


def bbi(periods=(3, 6, 12, 24), x="close") -> Column:
    """Mean of several moving averages."""
    total = T.ts_mean(x, periods[0])
    for n in periods[1:]:
        total = total + T.ts_mean(x, n)
    return total / len(periods)


def macd(fast: int = 12, slow: int = 26, signal: int = 9, x="close") -> dict[str, Column]:
    """dif, dea and twice their difference; one fold carries all three means."""
    a, b, s = 2.0 / (fast + 1), 2.0 / (slow + 1), 2.0 / (signal + 1)
    nothing = F.lit(None).cast("double")
    start = F.struct(nothing.alias("f"), nothing.alias("s"), nothing.alias("d"))

    def step(e, v):
        first = e["f"].isNull()
        f = F.when(first, v).otherwise(F.lit(a) * v + F.lit(1 - a) * e["f"])
        g = F.when(first, v).otherwise(F.lit(b) * v + F.lit(1 - b) * e["s"])
        d = F.when(first, f - g).otherwise(F.lit(s) * (f - g) + F.lit(1 - s) * e["d"])
        return F.struct(f.alias("f"), g.alias("s"), d.alias("d"))

    state = F.aggregate(F.collect_list(col(x)).over(running()), start, step)
    dif = state["f"] - state["s"]
    return {"dif": dif, "dea": state["d"], "macd": 2 * (dif - state["d"])}


def rsi(n: int = 14, x="close") -> Column:
    """Wilder's index: means of gains and losses with weight 1/n; null where nothing has moved."""
    change = col(x) - F.lag(col(x)).over(ts())
    moved = lambda x: F.when(x > 0, x).otherwise(0.0)  # noqa: E731  (the first row counts as unmoved)
    gain, loss = T.ewm(moved(change), 1.0 / n), T.ewm(moved(-change), 1.0 / n)
    return F.when(change.isNotNull(), 100 * F.try_divide(gain, gain + loss))


def rsv(n: int = 9) -> Column:
    """Place of close in the range of n rows, 0 to 100; 50 where the range is flat."""
    _, _, _, _c, _ = _bar()
    low, high = T.ts_min("low", n), T.ts_max("high", n)
    return F.when(low.isNotNull(), F.when(high > low, 100 * F.try_divide(_c - low, high - low)).otherwise(50.0))


def kdj(panel, n: int = 9, m1: int = 3, m2: int = 3):
    """Adds k, d and j = 3k - 2d: rsv smoothed by 1/m1, and that by 1/m2."""
    panel = panel.withColumn("__rsv", rsv(n)).withColumn("k", F.when(F.col("__rsv").isNotNull(), T.ewm("__rsv", 1.0 / m1)))
    panel = panel.withColumn("d", F.when(F.col("k").isNotNull(), T.ewm("k", 1.0 / m2)))
    return panel.withColumn("j", 3 * F.col("k") - 2 * F.col("d")).drop("__rsv")


def true_range() -> Column:
    _, _h, _l, _, _ = _bar()
    before = F.lag("close").over(ts())
    return F.greatest(_h - _l, F.abs(_h - before), F.abs(_l - before))


def atr(n: int = 14) -> Column:
    """Wilder's mean of the true range, the first being high less low."""
    return T.ewm(true_range(), 1.0 / n)


def obv() -> Column:
    """Volume signed by the change of close, summed up."""
    _, _, _, _c, _v = _bar()
    change = F.coalesce(F.signum(_c - F.lag("close").over(ts())), F.lit(0.0))
    return F.sum(change * _v).over(running())


def cci(n: int = 14) -> Column:
    """Typical price less its mean, by 0.015 times the mean absolute deviation from that mean."""
    _, _h, _l, _c, _ = _bar()
    tp = (_h + _l + _c) / 3
    seen, mean = F.collect_list(tp).over(ts(n)), F.avg(tp).over(ts(n))
    spread = F.aggregate(F.transform(seen, lambda v: F.abs(v - mean)), F.lit(0.0), lambda a, v: a + v) / n
    return full(tp, n, F.try_divide(tp - mean, 0.015 * spread))


def wr(n: int = 14) -> Column:
    _, _, _, _c, _ = _bar()
    high, low = T.ts_max("high", n), T.ts_min("low", n)
    return F.try_divide(high - _c, high - low) * -100


def roc(n: int = 12, x="close") -> Column:
    return 100 * T.ts_return(x, n)


def dpo(n: int = 20, x="close") -> Column:
    """Close less the mean of n rows, n/2 + 1 rows ago."""
    return col(x) - F.lag(T.ts_mean(x, n), n // 2 + 1).over(ts())


def mfi(n: int = 14) -> Column:
    """Money-flow index: typical price times volume on rising against all moving rows."""
    _, _h, _l, _c, _v = _bar()
    tp = (_h + _l + _c) / 3
    flow, up = tp * _v, tp - F.lag(tp).over(ts())
    plus = F.sum(F.when(up > 0, flow).otherwise(0.0)).over(ts(n))
    minus = F.sum(F.when(up < 0, flow).otherwise(0.0)).over(ts(n))
    return F.when(F.count(up).over(ts(n)) == n, 100 * F.try_divide(plus, plus + minus))


def volume_ratio(n: int = 20, x="volume") -> Column:
    """Volume by the mean of the n rows before, today left out."""
    before = ts().rowsBetween(-n, -1)
    return F.when(F.count(col(x)).over(before) == n, F.try_divide(col(x), F.avg(col(x)).over(before)))


def volume_surge(n: int = 5, ratio: float = 1.5, x="volume") -> Column:
    return F.when(volume_ratio(n, x) > ratio, 1).otherwise(0).cast("tinyint")


def tiandao(n: int = 12, x="close") -> Column:
    """Double mean over half a window, short windows allowed."""
    w = ts(n // 2 + 1)
    return F.avg(F.avg(col(x)).over(w)).over(w)


def pivots() -> dict[str, Column]:
    """Classic pivot levels of the bar before."""
    h, low, c = (F.lag(x).over(ts()) for x in ("high", "low", "close"))
    p = (h + low + c) / 3
    return {"P": p, "R1": 2 * p - low, "S1": 2 * p - h, "R2": p + h - low, "S2": p - h + low, "R3": h + 2 * (p - low), "S3": low - 2 * (h - p)}
