"""Queries of the table operators: joins, pre-processing and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import base, cs
from ..operators import evaluate as E
from ..operators import joins as J
from ..operators import prep as P
from . import panel
from .pairs import CS, columns, near, near_sql, query, w

_N = near_sql


def _near(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: near(F.col(n)) for n in names})


@query(
    f"""WITH {panel.PIT}, {panel.CLASSIFY}
SELECT p.symbol, p.stat_date, p.item, p.value, c.code FROM pit p ASOF LEFT JOIN cls c ON p.symbol = c.symbol AND p.stat_date >= c.std_date"""
)
def asof_industry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each fact with the classification in effect at its date."""
    facts, classes = panel.financial_pit(spark, sf_dir), panel.industry_classify(spark, sf_dir)
    return J.asof_join(facts, classes, left_on="stat_date", right_on="std_date", by=["symbol"], columns=["code"]).select("symbol", "stat_date", "item", "value", "code")


@query(
    f"""WITH {panel.WIDE}, half AS (
  SELECT 'TOP30' AS index_code, make_date(year(trade_date)::INT, CASE WHEN month(trade_date) <= 6 THEN 7 ELSE 1 END, 1) + CASE WHEN month(trade_date) <= 6 THEN INTERVAL 0 YEAR ELSE INTERVAL 1 YEAR END AS eff_date,
    symbol, sum(amount) AS amount FROM wide GROUP BY 1, 2, 3
), cons AS (SELECT index_code, eff_date::DATE AS eff_date, symbol FROM half QUALIFY row_number() OVER (PARTITION BY eff_date ORDER BY amount DESC, symbol) <= 30
), cal AS (SELECT DISTINCT trade_date FROM wide)
SELECT c.trade_date, k.eff_date, k.symbol FROM cal c JOIN cons k ON k.eff_date = (SELECT max(eff_date) FROM cons x WHERE x.eff_date <= c.trade_date)"""
)
def membership_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index members of every date: the whole newest half-yearly batch."""
    b = panel.bars(spark, sf_dir)
    first = F.month("trade_date") <= 6
    eff = F.make_date(F.year("trade_date") + F.when(first, 0).otherwise(1), F.when(first, 7).otherwise(1), F.lit(1))
    half = b.groupBy(F.lit("TOP30").alias("index_code"), eff.alias("eff_date"), "symbol").agg(F.sum("amount").alias("amount"))
    cons = J.newest_n(half, ["eff_date"], [F.desc("amount"), F.col("symbol")], 30).select("index_code", "eff_date", "symbol")
    return J.membership_asof(cons, b).select("trade_date", "eff_date", "symbol")


@query(f"WITH {panel.BARS} SELECT symbol, max(trade_date) AS trade_date, arg_max(close, trade_date) AS close, arg_max(amount, trade_date) AS amount FROM bars GROUP BY symbol")
def newest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest bar of every symbol by hash aggregate."""
    return J.newest(panel.bars(spark, sf_dir), ["symbol"], ["trade_date"], ["trade_date", "close", "amount"])


@query(f"WITH {panel.BARS} SELECT symbol, trade_date, close, row_number() OVER (PARTITION BY symbol ORDER BY trade_date DESC) AS rn FROM bars QUALIFY rn <= 5")
def tail_per_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest five bars of every symbol."""
    return J.newest_n(panel.bars(spark, sf_dir), ["symbol"], [F.desc("trade_date")], 5).select("symbol", "trade_date", "close", "rn")


_PEER = """, peer AS (SELECT symbol, trade_date, CASE WHEN substr(symbol, 2)::INT % 7 = 0 THEN close * 1.002 ELSE close END AS close, amount
  FROM bars WHERE (substr(symbol, 2)::INT * 31 + month(trade_date)) % 50 <> 0)"""


def _peer(b: DataFrame) -> DataFrame:
    k = F.substring("symbol", 2, 9).cast("int")
    return b.where((k * 31 + F.month("trade_date")) % 50 != 0).select("symbol", "trade_date", F.when(k % 7 == 0, F.col("close") * 1.002).otherwise(F.col("close")).alias("close"), "amount")


@query(
    f"""WITH {panel.BARS}{_PEER}, j AS (
  SELECT coalesce(a.symbol, b.symbol) AS symbol, coalesce(a.trade_date, b.trade_date) AS trade_date, a.symbol IS NOT NULL AS l, b.symbol IS NOT NULL AS r, a.close AS ac, b.close AS bc, a.amount AS aa, b.amount AS ba
  FROM bars a FULL JOIN peer b ON a.symbol = b.symbol AND a.trade_date = b.trade_date
), x AS (SELECT symbol, trade_date, l, r, 'close' AS field, ac AS x, bc AS y, 0.1 AS tol FROM j UNION ALL SELECT symbol, trade_date, l, r, 'amount', aa, ba, 1.0 FROM j
), z AS (SELECT *, CASE WHEN x = y THEN 0 ELSE 100 * abs(x - y) / greatest(abs(x), abs(y)) END AS d FROM x)
SELECT symbol, trade_date, field, {_N("d")} AS diff_pct, CASE WHEN NOT l OR NOT r OR x IS NULL OR y IS NULL THEN 'L3' WHEN d = 0 THEN 'L0' WHEN d <= tol THEN 'L1' ELSE 'L2' END AS level FROM z"""
)
def cross_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sources compared by key and field, with levels."""
    b = panel.bars(spark, sf_dir)
    return _near(J.classify_divergence(b, _peer(b), ["close", "amount"]).select("symbol", "trade_date", "field", "diff_pct", "level"), "diff_pct")


@query(f"WITH {panel.BARS}{_PEER} SELECT b.symbol, b.trade_date, coalesce(CASE WHEN month(b.trade_date) % 3 <> 0 THEN b.close END, p.close) AS close FROM bars b LEFT JOIN peer p ON b.symbol = p.symbol AND b.trade_date = p.trade_date")
def fill_only_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nulls, and only nulls, taken from a second source."""
    b = panel.bars(spark, sf_dir)
    holes = b.select("symbol", "trade_date", F.when(F.month("trade_date") % 3 != 0, F.col("close")).alias("close"))
    return J.fill_nulls(holes, _peer(b), ["symbol", "trade_date"], ["close"])[0]


@query(f"WITH {panel.BARS}{_PEER} SELECT symbol, trade_date, close FROM bars WHERE (symbol, trade_date) NOT IN (SELECT symbol, trade_date FROM peer) UNION ALL SELECT symbol, trade_date, close FROM peer")
def overlay_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch laid over a table: its keys replace, all others stay."""
    b = panel.bars(spark, sf_dir).select("symbol", "trade_date", "close")
    return J.overlay(b, _peer(b.withColumn("amount", F.lit(0.0))).drop("amount"), ["symbol", "trade_date"])


@query(f"WITH {panel.BARS}{_PEER} SELECT count(*) FILTER (l AND r) AS matched, count(*) FILTER (NOT r) AS only_left, count(*) FILTER (NOT l) AS only_right, {_N('count(*) FILTER (l AND r) * 1.0 / count(*)')} AS rate FROM (SELECT a.symbol IS NOT NULL AS l, b.symbol IS NOT NULL AS r FROM bars a FULL JOIN peer b USING (symbol, trade_date))")
def compare_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matched and unmatched keys of two tables."""
    b = panel.bars(spark, sf_dir)
    return _near(J.compare_trades(b, _peer(b), ["symbol", "trade_date"]), "rate")


# pre-processing

_std, _avg = f"stddev_samp(close) {CS}", f"avg(close) {CS}"
columns(
    "prep_clips",
    panel.bars,
    panel.BARS,
    "bars",
    lambda: {
        "clipped": P.clip("close", 100.0, 5000.0),
        "sigma": P.three_sigma("close", 2.0),
        "huber": P.huber("close", 1.5),
        "minmax": P.minmax("close"),
        "pct": cs.pct_rank("close"),
        "rz": P.rolling_zscore("close", 10),
        "rm": P.rolling_minmax("close", 10),
        "vs": P.volatility_scaling("volume", 10, shift=False),
    },
    {
        "clipped": "least(greatest(close, 100), 5000)",
        "sigma": f"CASE WHEN {_std} IS NULL THEN close ELSE least(greatest(close, {_avg} - 2 * {_std}), {_avg} + 2 * {_std}) END",
        "huber": f"CASE WHEN {_std} IS NULL THEN close ELSE least(greatest(close, {_avg} - 1.5 * {_std}), {_avg} + 1.5 * {_std}) END",
        "minmax": f"CASE WHEN max(close) {CS} - min(close) {CS} > 1e-12 THEN (close - min(close) {CS}) / (max(close) {CS} - min(close) {CS}) ELSE 0.5 END",
        "pct": f"(rank() OVER (PARTITION BY trade_date ORDER BY close) + (count(*) OVER (PARTITION BY trade_date, close) - 1) / 2.0) / count(close) {CS}",
        "rz": f"CASE WHEN count(close) {w(10)} >= 10 THEN CASE WHEN stddev_samp(close) {w(10)} > 1e-12 THEN (close - avg(close) {w(10)}) / stddev_samp(close) {w(10)} ELSE 0 END END",
        "rm": f"CASE WHEN count(close) {w(10)} >= 10 THEN coalesce((close - min(close) {w(10)}) / nullif(max(close) {w(10)} - min(close) {w(10)}, 0), 0.5) END",
        "vs": f"CASE WHEN count(volume) {w(10)} = 10 THEN volume / nullif(stddev_samp(volume) {w(10)}, 0) END",
    },
    doc="Clips, scalings and rolling standardisation.",
)


@query(
    f"""WITH {panel.BARS}, a AS (SELECT *, quantile_cont(close, 0.5) {CS} AS m FROM bars), b AS (SELECT *, quantile_cont(abs(close - m), 0.5) {CS} * 1.4826 AS d FROM a),
c AS (SELECT *, CASE WHEN d > 0 THEN d ELSE coalesce(stddev_samp(close) {CS}, 0) END AS s FROM b)
SELECT symbol, trade_date, {_N("least(greatest(close, m - 3 * s), m + 3 * s)", 5)} AS close FROM c"""
)
def prep_mad(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clip by the median absolute deviation."""
    d = P.mad(panel.bars(spark, sf_dir), "close", 3.0).select("symbol", "trade_date", "close")
    return d.withColumn("close", near(F.col("close"), 5))


@query(
    f"""WITH {panel.WIDE}, g AS (SELECT symbol, trade_date, close - avg(close) OVER (PARTITION BY trade_date, industry) AS v, ln(amount) - avg(ln(amount)) OVER (PARTITION BY trade_date, industry) AS s FROM wide WHERE industry IS NOT NULL)
SELECT symbol, trade_date, {_N(f"v - coalesce(sum(v * s) {CS} / nullif(sum(s * s) {CS}, 0), 0) * s", 4)} AS residual FROM g"""
)
def neutral_size_industry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Close freed of size and industry per date, by windows only."""
    wide = panel.wide_bars(spark, sf_dir).where("industry IS NOT NULL").withColumn("size", F.log("amount"))
    d = P.neutral_size_industry(wide, "close", "size", "industry", "residual").select("symbol", "trade_date", "residual")
    return d.withColumn("residual", near(F.col("residual"), 4))


@query()
def neutral_ridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ridge residuals per date on size and industry dummies."""
    wide = panel.wide_bars(spark, sf_dir).withColumn("size", F.log("amount")).select("symbol", "trade_date", "close", "size", "industry")
    return P.residual_by_day(wide, "close", ["size"], "industry", kind="ridge").select("symbol", "trade_date", "residual")


@query()
def orthogonal_symmetric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symmetric orthogonalisation of three columns per date."""
    return P.symmetric(panel.bars(spark, sf_dir).select("symbol", "trade_date", "close", "volume", "turnover_rate"), ["close", "volume", "turnover_rate"])


# evaluation

_IC = f"""WITH {panel.EVALUATED}, ok AS (SELECT * FROM ev WHERE factor IS NOT NULL AND fwd_ret_1 IS NOT NULL),
rk AS (SELECT *, rank() OVER (PARTITION BY trade_date ORDER BY factor) + (count(*) OVER (PARTITION BY trade_date, factor) - 1) / 2.0 AS fr,
  rank() OVER (PARTITION BY trade_date ORDER BY fwd_ret_1) + (count(*) OVER (PARTITION BY trade_date, fwd_ret_1) - 1) / 2.0 AS rr FROM ok),
ic AS (SELECT trade_date, count(*) AS n, corr(factor, fwd_ret_1) AS ic, corr(fr, rr) AS rank_ic FROM rk GROUP BY 1 HAVING count(*) >= 5)"""


@query(_IC + f" SELECT trade_date, n, {_N('ic')} AS ic, {_N('rank_ic')} AS rank_ic FROM ic")
def ic_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily Pearson and Spearman correlation of a factor with the next return."""
    return _near(E.ic_series(panel.evaluated(spark, sf_dir), "factor", "fwd_ret_1"), "ic", "rank_ic")


_M = "(SELECT avg(rank_ic) FROM ic)"
_mom = lambda k: f"avg(pow(rank_ic - {_M}, {k}))"


@query(
    _IC
    + f""" SELECT {_N("avg(rank_ic)")} AS mean, {_N("stddev_samp(rank_ic)")} AS std, {_N("avg(rank_ic) / stddev_samp(rank_ic)")} AS ir, {_N("avg(rank_ic) / stddev_samp(rank_ic) * sqrt(252)")} AS annual_ir,
{_N("avg(rank_ic) / stddev_samp(rank_ic) * sqrt(count(*))")} AS t, {_N("avg((rank_ic > 0)::INT)")} AS hit, {_N(f"{_mom(3)} / pow({_mom(2)}, 1.5)")} AS skew, {_N(f"{_mom(4)} / pow({_mom(2)}, 2) - 3")} AS kurt,
{_N("avg((abs(rank_ic) > 0.02)::INT)")} AS strong, count(*) AS n FROM ic"""
)
def ic_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of the daily rank correlation."""
    s = E.ic_summary(E.ic_series(panel.evaluated(spark, sf_dir), "factor", "fwd_ret_1"), "rank_ic")
    return _near(s, *[c for c, t in s.dtypes if t == "double"])


@query(_IC + f" SELECT year(trade_date)::INT AS y, {_N('avg(ic)')} AS mean, {_N('stddev_samp(ic)')} AS std, count(*) AS n FROM ic GROUP BY 1")
def ic_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    ic = E.ic_series(panel.evaluated(spark, sf_dir), "factor", "fwd_ret_1").withColumn("y", F.year("trade_date"))
    return _near(E.ic_summary(ic, "ic", ("y",)).select("y", "mean", "std", "n"), "mean", "std")


_B = f"""WITH {panel.EVALUATED}, b AS (SELECT *, ceil(row_number() OVER (PARTITION BY trade_date ORDER BY factor, symbol) * 5.0 / count(*) OVER (PARTITION BY trade_date))::INT AS q FROM ev WHERE factor IS NOT NULL),
g AS (SELECT trade_date, q, avg(fwd_ret_1) AS ret, count(*) AS n FROM b WHERE fwd_ret_1 IS NOT NULL GROUP BY 1, 2)"""


@query(_B + f" SELECT trade_date, q, {_N('ret')} AS ret, n FROM g")
def group_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean next return by date and bucket."""
    return _near(E.group_returns(panel.evaluated(spark, sf_dir), "factor", "fwd_ret_1", 5), "ret")


@query(_B + " SELECT trade_date, " + ", ".join(_N(f"max(ret) FILTER (q = {k})") + f" AS g{k}" for k in range(1, 6)) + " FROM g GROUP BY 1")
def group_returns_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with a column per bucket."""
    d = E.pivot_returns(E.group_returns(panel.evaluated(spark, sf_dir), "factor", "fwd_ret_1", 5), 5)
    return _near(d, *[f"g{k}" for k in range(1, 6)])


@query(_B + f", n AS (SELECT trade_date, q, product(1 + coalesce(ret, 0)) OVER (PARTITION BY q ORDER BY trade_date ROWS UNBOUNDED PRECEDING) AS nav FROM g) SELECT trade_date, q, {_N('nav')} AS nav FROM n")
def quantile_nav(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compounded value of every bucket."""
    return _near(E.nav(E.group_returns(panel.evaluated(spark, sf_dir), "factor", "fwd_ret_1", 5)).select("trade_date", "q", "nav"), "nav")


@query(
    _B
    + f""", cal AS (SELECT trade_date, lead(trade_date) OVER (ORDER BY trade_date) AS nxt FROM (SELECT DISTINCT trade_date FROM b)),
s AS (SELECT trade_date, q, count(*) AS size FROM b WHERE q IN (1, 5) GROUP BY 1, 2),
o AS (SELECT cal.nxt AS trade_date, x.q, count(*) AS both_ FROM b x JOIN cal USING (trade_date) JOIN b y ON y.trade_date = cal.nxt AND y.symbol = x.symbol AND y.q = x.q WHERE x.q IN (1, 5) GROUP BY 1, 2),
t AS (SELECT s.trade_date, max(1 - coalesce(both_, 0) / size) FILTER (s.q = 5) AS l, max(1 - coalesce(both_, 0) / size) FILTER (s.q = 1) AS sh FROM s LEFT JOIN o ON s.trade_date = o.trade_date AND s.q = o.q GROUP BY 1)
SELECT cal.nxt AS trade_date, {_N("l")} AS turnover_long, {_N("sh")} AS turnover_short, {_N("coalesce((l + sh) / 2, l, sh)")} AS turnover_avg FROM cal LEFT JOIN t ON t.trade_date = cal.nxt WHERE cal.nxt IS NOT NULL"""
)
def factor_turnover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turnover of the end buckets against the session before."""
    return _near(E.turnover(panel.evaluated(spark, sf_dir), "factor", 5), "turnover_long", "turnover_short", "turnover_avg")


@query(
    f"""WITH {panel.EVALUATED}, r AS (SELECT trade_date, symbol, fwd_ret_1 AS r, row_number() OVER (PARTITION BY trade_date ORDER BY factor DESC, symbol) AS k FROM ev WHERE factor IS NOT NULL AND fwd_ret_1 IS NOT NULL),
t AS (SELECT trade_date, avg(r) AS ret, list(symbol ORDER BY symbol) AS members FROM r WHERE k <= 20 GROUP BY 1)
SELECT trade_date, {_N("ret")} AS ret, array_to_string(members, ',') AS members, CASE WHEN before IS NOT NULL THEN {_N("1 - len(list_intersect(members, before)) * 1.0 / len(members)")} END AS fresh FROM (SELECT *, lag(members) OVER (ORDER BY trade_date) AS before FROM t)"""
)
def top_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Return, members and renewal of the twenty largest by factor."""
    return _near(E.top_n(panel.evaluated(spark, sf_dir), "factor", "fwd_ret_1", 20), "ret", "fresh").withColumn("members", F.array_join("members", ","))


@query(
    f"""WITH {panel.EVALUATED}, """
    + ", ".join(f"h{h} AS (SELECT {h} AS horizon, avg(ic) AS ic, count(*) AS days FROM (SELECT trade_date, corr(factor, fwd_ret_{h}) AS ic FROM ev WHERE factor IS NOT NULL AND fwd_ret_{h} IS NOT NULL GROUP BY 1 HAVING count(*) >= 5))" for h in (1, 3, 6))
    + f" SELECT horizon, {_N('ic')} AS ic, days FROM (SELECT * FROM h1 UNION ALL SELECT * FROM h3 UNION ALL SELECT * FROM h6)"
)
def decay_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean correlation by horizon, all horizons in one aggregation over the panel."""
    d = panel.evaluated(spark, sf_dir)
    hs = (1, 3, 6)
    n = lambda h: F.count_if(F.col("factor").isNotNull() & F.col(f"fwd_ret_{h}").isNotNull())
    day = d.groupBy("trade_date").agg(*[x for h in hs for x in (base.corr_of("factor", f"fwd_ret_{h}").alias(f"c{h}"), n(h).alias(f"n{h}"))])
    one = day.agg(*[x for h in hs for x in (F.avg(F.when(F.col(f"n{h}") >= 5, F.col(f"c{h}"))).alias(f"c{h}"), F.count_if(F.col(f"n{h}") >= 5).alias(f"d{h}"))])
    rows = F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"c{h}").alias("ic"), F.col(f"d{h}").alias("days")) for h in hs]))
    return _near(one.select(rows.alias("x")).select("x.*"), "ic")


@query(
    f"""WITH {panel.EVALUATED}, p AS (SELECT symbol, trade_date, factor, """
    + ", ".join(f"{('lag' if k < 0 else 'lead')}(close, {abs(k)}) OVER (PARTITION BY symbol ORDER BY trade_date) / close - 1 AS p{k + 2}" if k else "close / close - 1 AS p2" for k in range(-2, 4))
    + " FROM ev), d AS (SELECT symbol, trade_date, factor, "
    + ", ".join(f"p{k} - avg(p{k}) OVER (PARTITION BY trade_date) AS p{k}" for k in range(6))
    + " FROM p), q AS (SELECT *, ceil(row_number() OVER (PARTITION BY trade_date ORDER BY factor, symbol) * 3.0 / count(*) OVER (PARTITION BY trade_date))::INT AS q FROM d WHERE factor IS NOT NULL)"
    + " UNION ALL ".join(f" SELECT q, {k - 2} AS step, {_N(f'avg(p{k})')} AS path FROM q GROUP BY 1" for k in range(6))
)
def event_study(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean price path around each date by bucket, less the market's."""
    return _near(E.event_study(panel.evaluated(spark, sf_dir), "factor", 3, 2, 3), "path")


@query(
    f"""WITH {panel.EVALUATED}, p AS (SELECT trade_date, industry, row_number() OVER (PARTITION BY trade_date ORDER BY factor, symbol) * 1.0 / count(*) OVER (PARTITION BY trade_date) AS p FROM ev WHERE factor IS NOT NULL),
d AS (SELECT trade_date, industry, count(*) FILTER (p > 0.8) AS t, count(*) FILTER (p <= 0.2) AS b FROM p GROUP BY 1, 2),
s AS (SELECT industry, t / nullif(sum(t) OVER (PARTITION BY trade_date), 0) AS t, b / nullif(sum(b) OVER (PARTITION BY trade_date), 0) AS b FROM d)
SELECT industry, {_N("avg(t)")} AS top, {_N("avg(b)")} AS bottom, {_N("avg(t) - avg(b)")} AS gap FROM s GROUP BY 1"""
)
def exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Industry weights of the top and bottom fifth."""
    return _near(E.exposure(panel.evaluated(spark, sf_dir), "factor", "industry"), "top", "bottom", "gap")


@query(f"WITH {panel.EVALUATED} SELECT trade_date, {_N('sum(factor * turnover_rate) / sum(abs(factor)) FILTER (turnover_rate IS NOT NULL)')} AS turnover_rate, {_N('sum(factor * volume) / sum(abs(factor)) FILTER (volume IS NOT NULL)')} AS volume FROM ev WHERE factor IS NOT NULL GROUP BY 1")
def pure_exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _near(E.pure_exposure(panel.evaluated(spark, sf_dir), "factor", ["turnover_rate", "volume"]), "turnover_rate", "volume")


@query(f"WITH {panel.EVALUATED} SELECT count(*) AS total, count(*) FILTER (factor IS NULL) AS null_factor, 0::BIGINT AS nonfinite, count(*) FILTER (factor IS NOT NULL AND fwd_ret_1 IS NULL) AS no_return, count(*) FILTER (factor IS NOT NULL AND fwd_ret_1 IS NOT NULL) AS used FROM ev")
def account_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.account_samples(panel.evaluated(spark, sf_dir), "factor", "fwd_ret_1")


@query(f"WITH {panel.EVALUATED}, z AS (SELECT symbol, trade_date, CASE WHEN coalesce(stddev_samp(fwd_ret_1) {CS}, 0) <= 1e-12 THEN 0 ELSE abs(fwd_ret_1 - avg(fwd_ret_1) {CS}) / stddev_samp(fwd_ret_1) {CS} END AS z, fwd_ret_1 FROM ev) SELECT symbol, trade_date FROM z WHERE fwd_ret_1 IS NULL OR z <= 2")
def filter_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose next return isn't an outlier of its date."""
    return E.filter_zscore(panel.evaluated(spark, sf_dir), ["fwd_ret_1"], 2.0).select("symbol", "trade_date")


_LN = "ln(open / lag(close) OVER (PARTITION BY symbol ORDER BY trade_date))"
_F3 = "OVER (PARTITION BY symbol ORDER BY trade_date ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING)"


@query(f"WITH {panel.BARS}, s AS (SELECT symbol, trade_date, {_LN} AS n, ln(close / open) AS d FROM bars), x AS (SELECT symbol, trade_date, CASE WHEN count(n) {_F3} = 3 THEN exp(sum(n) {_F3}) - 1 END AS a, CASE WHEN count(d) {_F3} = 3 THEN exp(sum(d) {_F3}) - 1 END AS b, CASE WHEN count(n + d) {_F3} = 3 THEN exp(sum(n + d) {_F3}) - 1 END AS c FROM s) SELECT symbol, trade_date, {_N('a')} AS overnight_3, {_N('b')} AS intraday_3, {_N('c')} AS total_3 FROM x")
def session_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overnight, intraday and total returns of the next three sessions."""
    d = E.session_returns(panel.bars(spark, sf_dir), [3]).select("symbol", "trade_date", "overnight_3", "intraday_3", "total_3")
    return _near(d, "overnight_3", "intraday_3", "total_3")


@query(
    _B
    + f""", v AS (SELECT q, ret, trade_date, product(1 + ret) OVER (PARTITION BY q ORDER BY trade_date ROWS UNBOUNDED PRECEDING) AS nav FROM g),
d AS (SELECT *, nav / greatest(max(nav) OVER (PARTITION BY q ORDER BY trade_date ROWS UNBOUNDED PRECEDING), 1) - 1 AS dd FROM v),
a AS (SELECT q, count(*) AS n, product(1 + ret) - 1 AS total, stddev_samp(ret) * sqrt(252) AS vol, min(dd) AS mdd, avg((ret > 0)::INT) AS win, max(ret) AS best, min(ret) AS worst FROM d GROUP BY q)
SELECT q, n, {_N("total")} AS total, {_N("vol")} AS vol, {_N("(pow(1 + total, 252.0 / n) - 1) / vol")} AS sharpe, {_N("mdd")} AS max_drawdown, {_N("win")} AS win_rate, {_N("best")} AS best, {_N("worst")} AS worst FROM a"""
)
def performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Performance of every bucket."""
    p = E.performance(E.group_returns(panel.evaluated(spark, sf_dir), "factor", "fwd_ret_1", 5), "q")
    names = ["total", "vol", "sharpe", "max_drawdown", "win_rate", "best", "worst"]
    return _near(p.select("q", "n", *names), *names)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Panel, factor, z-score, forward return, daily rank correlation and its mean and ratio."""
    d = panel.evaluated(spark, sf_dir).withColumn("factor", cs.zscore("factor"))
    return E.ic_summary(E.ic_series(d, "factor", "fwd_ret_1"), "rank_ic")

