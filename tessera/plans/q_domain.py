"""Queries of quality, fundamentals, groups, strategies and feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import base
from ..operators import calendars as C
from ..operators import feeds, riskmodel, strategy
from ..operators import fundamentals as FU
from ..operators import groups as G
from ..operators import quality as Q
from . import panel
from .pairs import near, near_sql, query

_N = near_sql


def _near(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: near(F.col(n)) for n in names})


_FLAGGED = f"""WITH {panel.WIDE}, fl AS (SELECT *,
  CASE WHEN NOT is_suspended AND (open <= 0.1 OR open > 10000 OR high <= 0.1 OR high > 10000 OR low <= 0.1 OR low > 10000 OR close <= 0.1 OR close > 10000) THEN 1 ELSE 0 END
  | CASE WHEN coalesce(abs(adj_factor / lag(adj_factor) OVER (PARTITION BY symbol ORDER BY trade_date) - 1) > 0.05, false) THEN 2 ELSE 0 END
  | CASE WHEN NOT is_suspended AND volume > 0 AND close > 0 AND amount > 0 AND (amount / (close * volume) < 0.2 OR amount / (close * volume) > 5) THEN 128 ELSE 0 END
  | CASE WHEN NOT is_suspended AND pre_close IS NULL THEN 256 ELSE 0 END AS quality_flags FROM wide)"""


def _flagged(spark, sf_dir) -> DataFrame:
    return Q.record_checks(panel.wide_bars(spark, sf_dir), unit=(0.2, 5.0), jump=0.05)


@query(_FLAGGED + " SELECT symbol, trade_date, quality_flags::INT AS quality_flags FROM fl")
def record_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight record rules as a bit mask per row."""
    return _flagged(spark, sf_dir).select("symbol", "trade_date", "quality_flags")


@query(_FLAGGED + " SELECT rule, count(*) FILTER (quality_flags & bit <> 0) AS n, rule IN ('PRICE_OUT_OF_RANGE', 'OHLC_CONFLICT', 'NEG_QTY', 'UNIT_MISMATCH') AS fatal FROM fl, (VALUES " + ", ".join(f"('{k}', {v})" for k, v in Q.FLAGS.items()) + ") f(rule, bit) GROUP BY rule")
def flag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.flag_counts(_flagged(spark, sf_dir))


@query(f"WITH {panel.BARS}, d AS (SELECT trade_date, count(DISTINCT symbol) AS n FROM bars GROUP BY 1) SELECT trade_date, n, (SELECT quantile_cont(n, 0.5) FROM d)::DOUBLE AS median, n >= 0.9 * (SELECT quantile_cont(n, 0.5) FROM d) AS ok FROM d")
def day_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols per date against the median date."""
    return Q.coverage(panel.bars(spark, sf_dir))


@query(f"WITH {panel.BARS}, d AS (SELECT trade_date, count(DISTINCT symbol) AS n FROM bars GROUP BY 1), p AS (SELECT *, max(n) OVER (ORDER BY trade_date ROWS UNBOUNDED PRECEDING) AS peak FROM d) SELECT *, n < 0.9 * peak AS risk FROM p")
def point_in_time_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.point_in_time(panel.bars(spark, sf_dir))


@query("WITH r AS (SELECT min(o_orderdate)::DATE AS a, max(o_orderdate)::DATE AS z FROM orders) SELECT d::DATE AS trade_date FROM r, generate_series(a, z, INTERVAL 1 DAY) g(d) WHERE d::DATE NOT IN (SELECT o_orderdate::DATE FROM orders)")
def missing_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days between the first and the last order on which nobody ordered."""
    have = panel.table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("trade_date"))
    span = have.agg(F.min("trade_date").alias("a"), F.max("trade_date").alias("z"))
    return Q.missing_dates(have, span.select(F.explode(F.sequence("a", "z")).alias("trade_date")))


@query(f"WITH {panel.DAILY} SELECT s.symbol, c.trade_date FROM (SELECT DISTINCT symbol FROM daily) s CROSS JOIN (SELECT DISTINCT trade_date FROM daily) c WHERE NOT EXISTS (SELECT 1 FROM daily d WHERE d.symbol = s.symbol AND d.trade_date = c.trade_date)")
def missing_dates_by_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calendar days on which a user has no row, for every user."""
    d = panel.user_daily(spark, sf_dir)
    return Q.missing_by_symbol(d, d)


@query(f"WITH {panel.WIDE}, r AS (SELECT symbol, trade_date, close / lag(close) OVER w - 1 AS ret, adj_factor / lag(adj_factor) OVER w - 1 AS f FROM wide WINDOW w AS (PARTITION BY symbol ORDER BY trade_date)) SELECT symbol, trade_date, {_N('ret')} AS ret, abs(ret) > 0.35 AND abs(f) <= 0.02 AS unexplained FROM r")
def adjustment_jumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price jumps that no factor jump explains."""
    return _near(Q.adjustment(panel.wide_bars(spark, sf_dir)).select("symbol", "trade_date", "ret", "unexplained"), "ret")


@query(f"WITH {panel.BARS} SELECT year(trade_date)::INT AS year, min(trade_date) AS first, max(trade_date) AS last, count(DISTINCT trade_date) AS dates FROM bars GROUP BY 1")
def year_continuity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.continuity(panel.bars(spark, sf_dir))


@query("SELECT l_orderkey, l_linenumber, count(*) AS count FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.duplicate_keys(panel.table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


# fundamentals

_ASOF = "1998-06-30"
_KNOWN = f"WITH {panel.PIT}, {panel.CLASSIFY}, kn AS (SELECT symbol, item, arg_max(value, (stat_date, pub_date, value)) AS value, max(stat_date) AS stat_date FROM pit WHERE pub_date <= DATE '{_ASOF}' GROUP BY 1, 2), ind AS (SELECT symbol, arg_max(code, std_date) AS code FROM cls WHERE std_date <= DATE '{_ASOF}' GROUP BY 1), v AS (SELECT kn.symbol, item, value, code FROM kn JOIN ind USING (symbol)), b AS (SELECT code, item, quantile_cont(value, 0.25) AS p25, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.75) AS p75, count(*) AS n FROM v GROUP BY 1, 2 HAVING count(*) >= 5)"


@query(_KNOWN + " SELECT symbol, item, stat_date, value FROM kn")
def resolve_pit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest report of each item known at a date."""
    return FU.known_at(panel.financial_pit(spark, sf_dir), _ASOF).select("symbol", "item", "stat_date", "value")


def _values(spark, sf_dir) -> DataFrame:
    return FU.known_at(panel.financial_pit(spark, sf_dir), _ASOF).join(FU.industry_at(panel.industry_classify(spark, sf_dir), _ASOF), "symbol").select("symbol", "item", "value", "code")


@query(_KNOWN + f" SELECT code, item, {_N('p25', 4)} AS p25, {_N('p50', 4)} AS p50, {_N('p75', 4)} AS p75, n FROM b")
def percentile_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quartiles by group and item."""
    b = FU.bands(_values(spark, sf_dir))
    return b.withColumns({k: near(F.col(k), 4) for k in ("p25", "p50", "p75")})


@query(
    _KNOWN
    + f""", p AS (SELECT symbol, CASE WHEN value >= p75 THEN 1.0 WHEN value >= p50 THEN 2.0 / 3 WHEN value >= p25 THEN 1.0 / 3 ELSE 0 END * 3 AS points FROM v JOIN b USING (code, item)),
s AS (SELECT symbol, sum(points) AS points, count(*) * 3.0 AS available FROM p GROUP BY 1), n AS (SELECT *, 100 * points / available AS normalised FROM s)
SELECT symbol, {_N('points')} AS points, available::DOUBLE AS available, {_N('normalised')} AS normalised, CASE WHEN normalised + 1e-9 >= 80 THEN 'A' WHEN normalised + 1e-9 >= 60 THEN 'B' WHEN normalised + 1e-9 >= 40 THEN 'C' ELSE 'D' END AS letter FROM n"""
)
def score_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points by quartile summed to a score and a letter."""
    v = _values(spark, sf_dir)
    return _near(FU.score(FU.points(v, FU.bands(v))), "points", "normalised")


@query(f"WITH {panel.PIT} SELECT a.symbol, a.item, a.stat_date, greatest(a.pub_date, b.pub_date) AS pub_date, {_N('a.value / b.value - 1')} AS growth FROM pit a JOIN pit b ON a.symbol = b.symbol AND a.item = b.item AND a.stat_date = last_day(b.stat_date + INTERVAL 12 MONTH)")
def growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yearly growth of each item, published when both reports are."""
    return _near(FU.growth(panel.financial_pit(spark, sf_dir)), "growth")


# groups and market

_GROUP = f"""WITH {panel.WIDE}, r AS (SELECT *, close / lag(close) OVER (PARTITION BY symbol ORDER BY trade_date) - 1 AS ret FROM wide),
gd AS (SELECT trade_date, industry, avg(ret) AS ret, quantile_cont(ret, 0.5) AS median_ret, count(ret) AS n, avg((ret > 0)::INT) AS up_ratio, sum(amount) AS amount, avg(turnover_rate) AS turnover FROM r GROUP BY 1, 2)"""


@query(_GROUP + f" SELECT trade_date, industry, {_N('ret')} AS ret, {_N('median_ret')} AS median_ret, n, {_N('up_ratio')} AS up_ratio, {_N('amount', 2)} AS amount, {_N('turnover')} AS turnover FROM gd")
def group_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily index of each group."""
    d = G.group_daily(panel.wide_bars(spark, sf_dir), "industry")
    return _near(d, "ret", "median_ret", "up_ratio", "turnover").withColumn("amount", near(F.col("amount"), 2))


_LEVEL = _GROUP + """, lv AS (SELECT trade_date, industry, exp(sum(ln(1 + coalesce(greatest(ret, -0.9), 0))) OVER (PARTITION BY industry ORDER BY trade_date ROWS UNBOUNDED PRECEDING)) AS level FROM gd),
bm AS (SELECT trade_date, exp(sum(ln(1 + greatest(coalesce(ret, 0), -0.9))) OVER (ORDER BY trade_date ROWS UNBOUNDED PRECEDING)) AS bench FROM (SELECT trade_date, avg(ret) AS ret FROM r GROUP BY 1)),
a AS (SELECT industry, trade_date, 100 * level / bench AS rs FROM lv JOIN bm USING (trade_date)),
b AS (SELECT *, 100 * rs / lag(rs, 12) OVER (PARTITION BY industry ORDER BY trade_date) AS x FROM a),
c AS (SELECT *, CASE WHEN count(x) OVER w = 6 THEN avg(x) OVER w END AS rs_ratio FROM b WINDOW w AS (PARTITION BY industry ORDER BY trade_date ROWS 5 PRECEDING)),
d AS (SELECT *, 100 * rs_ratio / lag(rs_ratio, 6) OVER (PARTITION BY industry ORDER BY trade_date) AS y FROM c),
e AS (SELECT *, CASE WHEN count(y) OVER w = 6 THEN avg(y) OVER w END AS rs_mom FROM d WINDOW w AS (PARTITION BY industry ORDER BY trade_date ROWS 5 PRECEDING))"""


@query(_LEVEL + f" SELECT industry, trade_date, {_N('rs_ratio', 4)} AS rs_ratio, {_N('rs_mom', 4)} AS rs_mom, CASE WHEN rs_ratio > 100 AND rs_mom > 100 THEN 1 WHEN rs_ratio < 100 AND rs_mom > 100 THEN 2 WHEN rs_ratio < 100 AND rs_mom < 100 THEN 3 WHEN rs_ratio > 100 AND rs_mom < 100 THEN 4 END AS quadrant FROM e")
def rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relative rotation of every group."""
    wide = panel.wide_bars(spark, sf_dir)
    floor = lambda d: d.withColumn("ret", F.greatest("ret", F.lit(-0.9)))
    levels = G.index_level(floor(G.group_daily(wide, "industry")), "industry")
    market = wide.withColumn("ret", base.div("close", F.lag("close").over(base.ts())) - 1).groupBy("trade_date").agg(F.avg("ret").alias("ret"))
    bench = G.index_level(floor(market.withColumn("k", F.lit(0))), "k")
    d = G.rotation(levels.select("industry", "trade_date", "level"), bench, "industry", 12, 6, 6)
    return d.select("industry", "trade_date", near(F.col("rs_ratio"), 4).alias("rs_ratio"), near(F.col("rs_mom"), 4).alias("rs_mom"), "quadrant")


_POOL = f"WITH {panel.DAILY}, cal AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date) AS k FROM (SELECT DISTINCT trade_date FROM daily)), pool AS (SELECT DISTINCT ts::DATE AS trade_date, 'U' || user_id AS symbol FROM events WHERE event_type = 'purchase'), i AS (SELECT p.*, k, k - row_number() OVER (PARTITION BY symbol ORDER BY k) AS island FROM pool p JOIN cal USING (trade_date)), st AS (SELECT trade_date, symbol, row_number() OVER (PARTITION BY symbol, island ORDER BY k) AS streak FROM i)"


def _streaks(spark, sf_dir) -> DataFrame:
    e = panel.table(spark, sf_dir, "events")
    pool = e.where("event_type = 'purchase'").select(F.to_date("ts").alias("trade_date"), F.concat(F.lit("U"), F.col("user_id")).alias("symbol"))
    return G.streaks(pool, e.select(F.to_date("ts").alias("trade_date")))


@query(_POOL + " SELECT trade_date, symbol, streak FROM st")
def streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of consecutive sessions in a pool."""
    return _streaks(spark, sf_dir).select("trade_date", "symbol", "streak")


@query(_POOL + f", d AS (SELECT trade_date, max(streak) AS highest, count(*) FILTER (streak = 1) AS first, count(*) FILTER (streak >= 2) AS second, count(*) FILTER (streak >= 3) AS third, count(DISTINCT streak) AS rungs, count(*) AS n FROM st GROUP BY 1) SELECT *, {_N('second * 1.0 / lag(n) OVER (ORDER BY trade_date)')} AS promotion FROM d")
def ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heights of the pool's streaks by date."""
    return _near(G.ladder(_streaks(spark, sf_dir)), "promotion")


# strategies


@query(
    f"""WITH {panel.EVALUATED}, k AS (SELECT trade_date, symbol, fwd_ret_1 AS r, row_number() OVER (PARTITION BY trade_date ORDER BY factor DESC, symbol) AS k FROM ev WHERE factor IS NOT NULL AND fwd_ret_1 IS NOT NULL),
n AS (SELECT unnest([5, 10, 20, 40]) AS n), m AS (SELECT trade_date, n, avg(r) AS ret, count(*) AS c FROM k JOIN n ON k.k <= n.n GROUP BY 1, 2 HAVING count(*) = n.n),
cal AS (SELECT trade_date, lag(trade_date) OVER (ORDER BY trade_date) AS prev FROM (SELECT DISTINCT trade_date FROM k)),
t AS (SELECT x.trade_date, n.n, 1 - count(y.symbol) * 1.0 / n.n AS turnover FROM k x JOIN n ON x.k <= n.n JOIN cal ON cal.trade_date = x.trade_date LEFT JOIN k y ON y.trade_date = cal.prev AND y.symbol = x.symbol AND y.k <= n.n GROUP BY 1, 2),
e AS (SELECT m.trade_date, m.n, turnover, ret - 0.001 * turnover AS net FROM m JOIN t ON m.trade_date = t.trade_date AND m.n = t.n),
v AS (SELECT *, product(1 + net) OVER (PARTITION BY n ORDER BY trade_date ROWS UNBOUNDED PRECEDING) AS nav FROM e),
w AS (SELECT *, nav / greatest(max(nav) OVER (PARTITION BY n ORDER BY trade_date ROWS UNBOUNDED PRECEDING), 1) - 1 AS dd FROM v)
SELECT n, count(*) AS days, {_N("avg(net)")} AS mean, {_N("avg(turnover)")} AS turnover, {_N("min(dd)")} AS max_drawdown, {_N("avg(net) * sqrt(252) / stddev_samp(net)")} AS sharpe FROM w GROUP BY n"""
)
def sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grid of top-N portfolios in one pass."""
    s = strategy.sweep(panel.evaluated(spark, sf_dir), "factor", [5, 10, 20, 40]).drop("nav")
    return _near(s, "mean", "turnover", "max_drawdown", "sharpe")


@query(f"WITH {panel.DAILY}, d AS (SELECT trade_date, lag(trade_date) OVER (ORDER BY trade_date) AS p FROM (SELECT DISTINCT trade_date FROM daily)) SELECT trade_date, p IS NULL OR date_trunc('week', trade_date) <> date_trunc('week', p) AS rebalance FROM d")
def rebalance_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strategy.rebalance_flags(panel.user_daily(spark, sf_dir), "week")


_RET = f"WITH {panel.WIDE}, r AS (SELECT symbol, trade_date, close / lag(close) OVER (PARTITION BY symbol ORDER BY trade_date) - 1 AS ret FROM wide), ok AS (SELECT * FROM r WHERE ret IS NOT NULL), bm AS (SELECT trade_date, avg(ret) AS b FROM ok GROUP BY 1)"


def _returns(spark, sf_dir) -> DataFrame:
    return panel.wide_bars(spark, sf_dir).withColumn("ret", base.div("close", F.lag("close").over(base.ts())) - 1).where("ret IS NOT NULL").select("symbol", "trade_date", "ret")


@query(_RET + f" SELECT symbol, {_N('covar_samp(ret, b) / var_samp(b)')} AS beta, {_N('stddev_samp(ret - b) * sqrt(252)', 4)} AS tracking_error, {_N('avg(ret - b) * 252', 4)} AS excess, {_N('avg(ret - b) * 252 / (stddev_samp(ret - b) * sqrt(252))')} AS ir FROM ok JOIN bm USING (trade_date) GROUP BY 1")
def risk_vs_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beta, tracking error and information ratio of every symbol."""
    r = _returns(spark, sf_dir)
    d = strategy.risk_vs_benchmark(r, r.groupBy("trade_date").agg(F.avg("ret").alias("ret")), "symbol").drop("alpha")
    return _near(d, "beta", "ir").withColumns({k: near(F.col(k), 4) for k in ("tracking_error", "excess")})


@query(_RET + f", q AS (SELECT symbol, quantile_cont(ret, 0.05) AS q FROM ok GROUP BY 1) SELECT symbol, {_N('any_value(q)')} AS var, {_N('avg(ret) FILTER (ret <= q)')} AS cvar FROM ok JOIN q USING (symbol) GROUP BY 1")
def tail_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _near(strategy.tail_risk(_returns(spark, sf_dir), "symbol"), "var", "cvar")


@query(_RET + f" SELECT x.symbol AS a, y.symbol AS b, {_N('covar_samp(x.ret, y.ret)', 4)} AS cov, {_N('covar_samp(x.ret, y.ret) / (stddev_samp(x.ret) * stddev_samp(y.ret))', 4)} AS corr, count(*) AS n FROM ok x JOIN ok y ON x.trade_date = y.trade_date AND x.symbol <= y.symbol GROUP BY 1, 2")
def covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Covariance and correlation of all pairs of symbols."""
    d = riskmodel.pairwise(_returns(spark, sf_dir))
    return d.withColumns({k: near(F.col(k), 4) for k in ("cov", "corr")})


@query(f"WITH {panel.BARS}, w AS (SELECT trade_date, symbol, amount / sum(amount) OVER (PARTITION BY trade_date) AS weight FROM bars), r AS (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY weight DESC, symbol) AS rn FROM w) SELECT trade_date, {_N('sum(weight * weight)')} AS hhi, {_N('1 / sum(weight * weight)', 4)} AS effective, {_N('sum(weight) FILTER (rn <= 5)')} AS top5, {_N('sum(weight) FILTER (rn <= 10)')} AS top10 FROM r GROUP BY 1")
def portfolio_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concentration of amount-weighted holdings by date."""
    d = strategy.profile(strategy.weights(panel.bars(spark, sf_dir), "amount"))
    return _near(d, "hhi", "top5", "top10").withColumn("effective", near(F.col("effective"), 4))


# feeds

_BAD = lambda: F.col("event_type") == "error"


@query(
    f"""WITH e AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS bucket, value, event_type FROM events), d AS (SELECT bucket, count(*) AS n, avg(value) AS mean, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.95) AS p95, avg((event_type = 'error')::INT) AS er FROM e GROUP BY 1),
g AS (SELECT unnest(generate_series((SELECT min(bucket) FROM d), (SELECT max(bucket) FROM d), INTERVAL 1 HOUR)) AS bucket)
SELECT g.bucket AS bucket, coalesce(n, 0) AS n, {_N('mean')} AS mean, {_N('p50')} AS p50, {_N('p95')} AS p95, {_N('er')} AS error_rate FROM g LEFT JOIN d ON g.bucket = d.bucket"""
)
def latency_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly latency over a complete grid."""
    d = feeds.latency_series(panel.table(spark, sf_dir, "events"), ts="ts", value="value", bad=_BAD(), width="1 hour")
    return _near(d, "mean", "p50", "p95", "error_rate")


@query(f"SELECT event_type, count(*) AS n, {_N('avg(value)')} AS mean, {_N('quantile_cont(value, 0.95)')} AS p95, {_N("avg((event_type = 'error')::INT)")} AS error_rate FROM events GROUP BY 1 ORDER BY quantile_cont(value, 0.95) DESC, event_type LIMIT 3")
def slowest_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _near(feeds.slowest(panel.table(spark, sf_dir, "events"), "event_type", "value", _BAD(), 3), "mean", "p95", "error_rate")


@query("SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, 'sk-[A-Za-z0-9_-]{8,}', '[KEY]', 'g'), 'AKIA[0-9A-Z]{16}', '[KEY]', 'g'), '(?i)(password|passwd|token|secret|api[_-]?key)(\\s*[:=]\\s*)[^\\s,;]+', '\\1\\2[MASKED]', 'g'), '/(?:home|Users|root)/[^\\s]+', '[PATH]', 'g') AS text FROM documents")
def redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with credentials and local paths masked."""
    return panel.table(spark, sf_dir, "documents").select("doc_id", feeds.redact("text").alias("text"))


_SAID = lambda t: f"(' ' || array_to_string(regexp_extract_all(lower({t}), '[^\\x20\\x09-\\x0D]+'), ' ') || ' ')"


@query(
    f"""WITH q AS (SELECT item_id, {_SAID('text')} AS quote FROM benchmark), d AS (SELECT doc_id, {_SAID('text')} AS said FROM documents)
SELECT DISTINCT q.item_id, d.doc_id, CASE WHEN d.doc_id IS NULL THEN 'absent' ELSE 'found' END AS status FROM q LEFT JOIN d ON trim(quote) <> '' AND contains(said, quote)"""
)
def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in which a benchmark passage stands whole, and the passages that stand in none."""
    d = feeds.quoted(panel.table(spark, sf_dir, "benchmark"), panel.table(spark, sf_dir, "documents"), item="item_id", by="doc_id")
    return d.withColumn("status", F.when(F.col("doc_id").isNull(), "absent").otherwise("found"))


@query("SELECT doc_id, source, bytes_so_far::BIGINT AS bytes_so_far FROM (SELECT doc_id, source, sum(strlen(text)) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS bytes_so_far FROM documents) WHERE bytes_so_far <= 50000")
def byte_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of each source within a byte budget."""
    return feeds.within_budget(panel.table(spark, sf_dir, "documents"), "source", [F.col("doc_id")], "text", 50_000).select("doc_id", "source", "bytes_so_far")


# calendars and confidence

_CAL = f"WITH {panel.DAILY}, cal AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date) AS k, lag(trade_date) OVER (ORDER BY trade_date) AS prev, lead(trade_date) OVER (ORDER BY trade_date) AS nxt FROM (SELECT DISTINCT trade_date FROM daily))"


@query(_CAL + " SELECT trade_date, k, prev, nxt AS next FROM cal")
def session_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every session with its place and neighbours."""
    return C.sessions(panel.user_daily(spark, sf_dir))


@query(_CAL + " SELECT symbol, max(d.trade_date) AS trade_date, (SELECT count(*) FROM cal) - max(k) AS lag FROM daily d JOIN cal ON d.trade_date = cal.trade_date GROUP BY 1")
def session_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions since the newest row of every user."""
    d = panel.user_daily(spark, sf_dir)
    last = d.groupBy("symbol").agg(F.max("trade_date").alias("trade_date"))
    return C.session_lag(last, "trade_date", d, "2100-01-01").select("symbol", "trade_date", F.col("lag").cast("long").alias("lag"))


@query(f"WITH {panel.WIDE} SELECT symbol, trade_date, (CASE WHEN is_suspended THEN 1024 ELSE 0 END | CASE WHEN trade_date - min(trade_date) OVER (PARTITION BY symbol) < 60 THEN 512 ELSE 0 END)::INT AS quality_flags FROM wide")
def tradability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suspended and newly listed rows by bits."""
    wide = panel.wide_bars(spark, sf_dir)
    return C.tradability(wide, wide.groupBy("symbol").agg(F.min("trade_date").alias("list_date"))).select("symbol", "trade_date", "quality_flags")


@query(
    f"""WITH {panel.BARS}, ix AS (SELECT trade_date, avg(close) AS ic FROM bars GROUP BY 1), j AS (SELECT symbol, b.trade_date, close, ic FROM bars b JOIN ix ON b.trade_date = ix.trade_date),
d AS (SELECT symbol, trade_date, close / lag(close, 3) OVER w - ic / lag(ic, 3) OVER w AS d3 FROM j WINDOW w AS (PARTITION BY symbol ORDER BY trade_date))
SELECT symbol, trade_date, {_N("d3")} AS dev_3, CASE WHEN d3 IS NULL THEN 0 WHEN (CASE WHEN d3 >= 0 THEN d3 / 2 ELSE -d3 / 1.5 END) >= 1 THEN 3 WHEN (CASE WHEN d3 >= 0 THEN d3 / 2 ELSE -d3 / 1.5 END) >= 0.7 THEN 2 WHEN (CASE WHEN d3 >= 0 THEN d3 / 2 ELSE -d3 / 1.5 END) >= 0.5 THEN 1 ELSE 0 END AS grade FROM d"""
)
def abnormal_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-session moves less the index's, graded by their threshold."""
    b = panel.bars(spark, sf_dir)
    d = C.deviation(b, b.groupBy("trade_date").agg(F.avg("close").alias("close")), (3,))
    return d.select("symbol", "trade_date", near(F.col("dev_3")).alias("dev_3"), C.proximity("dev_3", 2.0, 1.5).alias("grade"))


@query(
    f"""WITH {panel.BARS}, e AS (SELECT symbol, high, low, volume, min(low) OVER (PARTITION BY symbol) AS a, (max(high) OVER (PARTITION BY symbol) - min(low) OVER (PARTITION BY symbol)) / 20 AS wd FROM bars),
f AS (SELECT *, least(19, coalesce(floor((low - a) / nullif(wd, 0)), 0))::INT AS lo, least(19, coalesce(floor((high - a) / nullif(wd, 0)), 0))::INT AS hi FROM e),
g AS (SELECT symbol, a, wd, volume / (hi - lo + 1) AS part, unnest(range(lo, hi + 1)) AS bin FROM f),
s AS (SELECT symbol, bin, sum(part) AS volume, any_value(a) AS a, any_value(wd) AS wd FROM g GROUP BY 1, 2)
SELECT symbol, bin::INT AS bin, {_N("a + (bin + 0.5) * wd", 4)} AS price, {_N("volume", 4)} AS volume, row_number() OVER (PARTITION BY symbol ORDER BY round(volume, 6) DESC, bin) AS rn FROM s QUALIFY rn <= 5"""
)
def volume_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fullest price bins of every symbol."""
    d = C.volume_profile(panel.bars(spark, sf_dir))
    return d.withColumns({"price": near(F.col("price"), 4), "volume": near(F.col("volume"), 4)})


_SR = "avg(ret) / stddev_samp(ret)"
_Mk = lambda k: f"avg(pow(ret - m, {k}))"


@query(
    _RET
    + f""", c AS (SELECT symbol, ret, avg(ret) OVER (PARTITION BY symbol) AS m FROM ok), s AS (SELECT symbol, count(*) AS n, {_SR} AS sr, {_Mk(3)} / pow({_Mk(2)}, 1.5) AS skew, {_Mk(4)} / pow({_Mk(2)}, 2) AS kurt FROM c GROUP BY 1),
z AS (SELECT *, sr * sqrt(n - 1) / sqrt(1 - skew * sr + (kurt - 1) / 4 * sr * sr) AS z FROM s), t AS (SELECT *, 1 / (1 + 0.2316419 * abs(z)) AS t FROM z),
p AS (SELECT *, 0.3989422804014327 * exp(-z * z / 2) * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429)))) AS tail FROM t)
SELECT symbol, n, {_N("sr")} AS sr, {_N("skew")} AS skew, {_N("kurt")} AS kurt, {_N("CASE WHEN z >= 0 THEN 1 - tail ELSE tail END")} AS psr FROM p"""
)
def probabilistic_sharpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probability that each symbol's Sharpe ratio is above zero."""
    return _near(strategy.probabilistic_sharpe(_returns(spark, sf_dir), "symbol"), "sr", "skew", "kurt", "psr")
