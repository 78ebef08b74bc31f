"""Queries of operators that had only unit tests: transforms, attribution, market states, merges, streams as batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import feeds, groups, joins, prep, quality, strategy
from ..sources import lake
from ..streaming import rollups
from . import panel
from .pairs import CS, near, near_sql, query
from .q_domain import _RET, _returns

_N = near_sql
_Z = "CASE WHEN {x} IS NULL THEN NULL WHEN coalesce(stddev_samp({x}) {cs}, 0) <= 1e-12 THEN 0 ELSE ({x} - avg({x}) {cs}) / stddev_samp({x}) {cs} END"


def _z(x: str) -> str:
    return _Z.format(x=x, cs=CS)


def _near(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: near(F.col(c), digits) for c in names})


# transforms


@query(
    f"WITH {panel.BARS}, b AS (SELECT symbol, trade_date, ln(close - min(close) {CS} + 1e-9) AS b, CASE WHEN close - open >= 0 THEN ln(1 + close - open) ELSE -((1 - (close - open)) ** 2 - 1) / 2 END AS y FROM bars) "
    f"SELECT symbol, trade_date, {_N(_z('b'), 5)} AS boxcox, {_N(_z('y'), 5)} AS yeo FROM b"
)
def power_transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Box-Cox of the close and Yeo-Johnson of the day's move, as z-scores of their date."""
    d = panel.bars(spark, sf_dir).withColumn("move", F.col("close") - F.col("open"))
    d = prep.yeo_johnson(prep.boxcox(d, "close", 0.0, out="boxcox"), "move", 0.0, out="yeo")
    return _near(d.select("symbol", "trade_date", "boxcox", "yeo"), "boxcox", "yeo", digits=5)


@query(f"WITH {panel.WIDE} SELECT symbol, trade_date, {_N('close - avg(close) OVER (PARTITION BY trade_date, industry)', 5)} AS own FROM wide")
def industry_demeaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The close less the mean of its date and industry."""
    return panel.wide_bars(spark, sf_dir).select("symbol", "trade_date", near(prep.industry_mean("close"), 5).alias("own"))


_SLOPE = "coalesce(covar_pop({a}, {b}) OVER d / nullif(var_pop({b}) OVER d, 0), 0)"


@query(
    f"WITH {panel.BARS}, a AS (SELECT symbol, trade_date, close AS x, volume - avg(volume) OVER d - {_SLOPE.format(a='volume', b='close')} * (close - avg(close) OVER d) AS y, amount / 100 AS z FROM bars WINDOW d AS (PARTITION BY trade_date)), "
    f"b AS (SELECT symbol, trade_date, x, y, z - avg(z) OVER d - {_SLOPE.format(a='z', b='x')} * (x - avg(x) OVER d) AS z FROM a WINDOW d AS (PARTITION BY trade_date)) "
    f"SELECT symbol, trade_date, {_N('x', 3)} AS x, {_N('y', 3)} AS y, {_N('z - avg(z) OVER d - ' + _SLOPE.format(a='z', b='y') + ' * (y - avg(y) OVER d)', 3)} AS z FROM b WINDOW d AS (PARTITION BY trade_date)"
)
def orthogonal_gram_schmidt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Close, volume and amount, each less its regression on those before it, per date."""
    d = panel.bars(spark, sf_dir).select("symbol", "trade_date", F.col("close").alias("x"), F.col("volume").alias("y"), (F.col("amount").cast("double") / 100).alias("z"))
    return _near(prep.gram_schmidt(d, ["x", "y", "z"]), "x", "y", "z", digits=3)


# attribution and market states

_BRINSON = (
    f"WITH {panel.WIDE}, r AS (SELECT symbol, trade_date, industry, amount::DOUBLE AS amount, volume, close / lag(close) OVER (PARTITION BY symbol ORDER BY trade_date) - 1 AS ret FROM wide), ok AS (SELECT * FROM r WHERE ret IS NOT NULL), "
    "p AS (SELECT trade_date, industry, sum(amount) / sum(sum(amount)) OVER (PARTITION BY trade_date) AS w, sum(amount * ret) / sum(amount) AS r FROM ok WHERE volume >= 30 GROUP BY 1, 2), "
    "q AS (SELECT trade_date, industry, count(*) / sum(count(*)) OVER (PARTITION BY trade_date) AS w, avg(ret) AS r FROM ok GROUP BY 1, 2), "
    "j AS (SELECT trade_date, industry, coalesce(p.w, 0) AS wp, coalesce(q.w, 0) AS wb, coalesce(p.r, q.r, 0) AS rp, coalesce(q.r, 0) AS rb FROM p FULL JOIN q USING (trade_date, industry)), t AS (SELECT *, sum(wb * rb) OVER (PARTITION BY trade_date) AS total FROM j)"
)


@query(f"{_BRINSON} SELECT trade_date, industry, {_N('(wp - wb) * (rb - total)')} AS allocation, {_N('wb * (rp - rb)')} AS selection, {_N('(wp - wb) * (rp - rb)')} AS interaction FROM t")
def brinson(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Allocation, selection and interaction of an amount-weighted portfolio against equal weights, by date and industry."""
    d = panel.wide_bars(spark, sf_dir).join(_returns(spark, sf_dir), ["symbol", "trade_date"]).withColumn("amount", F.col("amount").cast("double"))
    day = W.partitionBy("trade_date")
    port = d.where("volume >= 30").groupBy("trade_date", "industry").agg(F.sum("amount").alias("a"), (F.sum(F.col("amount") * F.col("ret")) / F.sum("amount")).alias("ret"))
    bench = d.groupBy("trade_date", "industry").agg(F.count("*").alias("a"), F.avg("ret").alias("ret"))
    weigh = lambda x: x.withColumn("weight", F.col("a") / F.sum("a").over(day))
    return _near(strategy.brinson(weigh(port), weigh(bench), "industry"), "allocation", "selection", "interaction")


@query(_RET + f", w AS (SELECT symbol, trade_date, amount::DOUBLE / sum(amount::DOUBLE) OVER (PARTITION BY trade_date) AS w FROM wide), l AS (SELECT symbol, trade_date, lag(w) OVER (PARTITION BY symbol ORDER BY trade_date) AS w FROM w) SELECT symbol, trade_date, {_N('w * ret')} AS contribution FROM l JOIN ok USING (symbol, trade_date)")
def stock_contribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each symbol's weight of the bar before made of its return."""
    weights = strategy.weights(panel.bars(spark, sf_dir).withColumn("amount", F.col("amount").cast("double")), "amount")
    return _near(strategy.contribution(weights, _returns(spark, sf_dir)), "contribution")


_PART = "least(greatest(({x} - {low}) / ({high} - {low}), 0), 1) * 100"


@query(
    _RET
    + f", d AS (SELECT trade_date, avg(ret) AS trend, avg((ret > 0)::INT) AS breadth, stddev_samp(ret) AS noise FROM ok GROUP BY 1), s AS (SELECT trade_date, {_PART.format(x='trend', low='-0.5', high='0.5')} AS a, {_PART.format(x='breadth', low='0.2', high='0.8')} AS b, coalesce(100 - {_PART.format(x='noise', low='0.1', high='2.0')}, 50) AS c FROM d), "
    f"t AS (SELECT trade_date, (2 * a + b + c) / 4 AS score FROM s) SELECT trade_date, {_N('score')} AS score, CASE WHEN score >= 80 THEN 'strong' WHEN score >= 60 THEN 'warm' WHEN score >= 40 THEN 'neutral' WHEN score >= 20 THEN 'cool' ELSE 'cold' END AS state FROM t"
)
def market_regime(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score of trend, breadth and calm by date, and the state it means."""
    day = _returns(spark, sf_dir).groupBy("trade_date").agg(F.avg("ret").alias("trend"), F.avg((F.col("ret") > 0).cast("int")).alias("breadth"), F.stddev_samp("ret").alias("noise"))
    day = day.withColumns({"trend": groups.component("trend", -0.5, 0.5), "breadth": groups.component("breadth", 0.2, 0.8), "noise": groups.component("noise", 0.1, 2.0, invert=True)})
    return _near(groups.regime(day, {"trend": 2, "breadth": 1, "noise": 1}).select("trade_date", "score", "state"), "score")


@query(f"WITH {panel.DAILY}, s AS (SELECT trade_date, (close = lag(close) OVER (PARTITION BY symbol ORDER BY trade_date))::INT AS still FROM daily) SELECT trade_date, {_N('avg(still)')} AS still, count(*) AS n FROM s GROUP BY 1")
def still_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of symbols whose close didn't move, by date."""
    return _near(quality.zombie_share(panel.user_daily(spark, sf_dir)), "still")


# merges, mapping, digests


@query(f"WITH {panel.BARS}, n AS (SELECT symbol, max(trade_date) AS trade_date, arg_max(close, trade_date) AS close FROM bars GROUP BY 1), d AS (SELECT 'S' || s_suppkey AS symbol, round(s_acctbal, 2) AS basic_balance FROM supplier) SELECT symbol, trade_date, {_N('close')} AS close, {_N('basic_balance')} AS basic_balance FROM n FULL JOIN d USING (symbol)")
def newest_of_two_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each symbol's newest bar beside its newest basics, whichever exist."""
    basics = panel.table(spark, sf_dir, "supplier").select(F.concat(F.lit("S"), F.col("s_suppkey")).alias("symbol"), F.lit("1998-01-01").cast("date").alias("trade_date"), F.round("s_acctbal", 2).cast("double").alias("balance"))
    d = lake.latest_snapshot(panel.bars(spark, sf_dir).select("symbol", "trade_date", "close"), basics)
    return _near(d.select("symbol", "trade_date", "close", "basic_balance"), "close", "basic_balance")


@query(
    "WITH a AS (SELECT o_custkey AS k, count(*) AS orders FROM orders GROUP BY 1), b AS (SELECT c_custkey AS k, c_mktsegment AS segment FROM customer WHERE c_custkey % 3 <> 0), c AS (SELECT user_id AS k, count(*) AS events FROM events GROUP BY 1) "
    "SELECT k, orders, segment, events FROM a FULL JOIN b USING (k) FULL JOIN c USING (k)"
)
def merged_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders, segments and events by key, none left out."""
    t = lambda name: panel.table(spark, sf_dir, name)
    a = t("orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("orders"))
    b = t("customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("segment"))
    c = t("events").groupBy(F.col("user_id").alias("k")).agg(F.count("*").alias("events"))
    return joins.full_merge([a, b, c], "k")


@query("SELECT o_orderkey AS id, o_orderstatus AS status, o_totalprice * 2 AS double_price, coalesce(NULL, 'none') AS note FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_orderpriority NOT IN ('5-LOW') AND contains(o_orderpriority, 'I')")
def mapped_and_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders under other names, with derived and constant columns, by three kinds of filters."""
    o = lake.apply_filters(panel.table(spark, sf_dir, "orders"), ["o_orderstatus:F|O", "o_orderpriority!=5-LOW", "o_orderpriority~I"])
    return lake.apply_mapping(o, rename={"o_orderkey": "id", "o_orderstatus": "status"}, derive={"double_price": "o_totalprice * 2"}, fill={"note": "none"}, select=["id", "status", "double_price", "note"])


@query("SELECT doc_id, sha256(coalesce(source, '') || chr(31) || coalesce(lang, '') || chr(31) || coalesce(text, '')) AS digest FROM documents")
def content_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A digest of each document's content."""
    return panel.table(spark, sf_dir, "documents").select("doc_id", feeds.content_hash("source", "lang", "text").alias("digest"))


@query(f"WITH {panel.BARS} SELECT min(trade_date) AS first, max(trade_date) AS last FROM bars")
def table_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lake.date_range(panel.bars(spark, sf_dir))


@query(f"WITH {panel.BARS} SELECT symbol, trade_date, {_N('amount', 2)} AS amount FROM bars WHERE trade_date = (SELECT max(trade_date) FROM bars) ORDER BY amount DESC, symbol LIMIT 20")
def largest_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty largest amounts of the newest date."""
    d = lake.top_by_amount(panel.bars(spark, sf_dir).withColumn("amount", F.col("amount").cast("double")), 20)
    return _near(d.select("symbol", "trade_date", "amount"), "amount", digits=2)


@query("SELECT event_type, count(*) AS count FROM events GROUP BY 1 ORDER BY count(*) DESC, event_type LIMIT 200")
def field_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of a field with their counts."""
    return lake.values(panel.table(spark, sf_dir, "events"), "event_type")


@query("SELECT event_id, (json_extract(props, '$.k'))::BIGINT AS k FROM events")
def json_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows at a path of a JSON column."""
    e = panel.table(spark, sf_dir, "events")
    payload = e.select(F.concat(F.lit('{"data": {"rows": [{"event_id": '), F.col("event_id"), F.lit(', "k": '), F.get_json_object("props", "$.k"), F.lit("}]}}")).alias("body"))
    return lake.rows_at(payload, "body", "data.rows", "struct<event_id: bigint, k: bigint>")


# streams as batches


@query(f"SELECT start, count(*) AS n, {_N('avg(value)')} AS mean FROM (SELECT unnest(range(time_bucket(INTERVAL 10 MINUTE, ts) - INTERVAL 50 MINUTE, time_bucket(INTERVAL 10 MINUTE, ts) + INTERVAL 1 MINUTE, INTERVAL 10 MINUTE)) AS start, value FROM events) GROUP BY 1")
def sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of the last hour, every ten minutes."""
    return _near(rollups.sliding(panel.table(spark, sf_dir, "events"), ts="ts", value="value", width="60 minutes", step="10 minutes"), "mean")


@query(
    "WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 6 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) "
    "SELECT user_id, min(ts) AS online, max(ts) + INTERVAL 6 HOUR AS offline, count(*) AS samples FROM s GROUP BY user_id, k"
)
def presence_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's spans of presence, until six hours without an event."""
    return rollups.presence(panel.table(spark, sf_dir, "events"), "user_id", ts="ts", gap="6 hours")


@query("SELECT event_id, value, c_name, c_mktsegment FROM events LEFT JOIN customer ON user_id = c_custkey")
def enriched_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events beside what is known of their user."""
    static = panel.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), "c_name", "c_mktsegment")
    return rollups.enriched(panel.table(spark, sf_dir, "events"), static, "user_id").select("event_id", "value", "c_name", "c_mktsegment")


@query(
    _RET
    + f", n AS (SELECT symbol, trade_date, product(1 + ret) OVER w AS nav FROM ok WINDOW w AS (PARTITION BY symbol ORDER BY trade_date)), p AS (SELECT *, nav / max(nav) OVER (PARTITION BY symbol ORDER BY trade_date) - 1 AS dd FROM n), i AS (SELECT *, sum((dd = 0)::INT) OVER (PARTITION BY symbol ORDER BY trade_date) AS island FROM p), "
    "e AS (SELECT symbol, island, min(trade_date) AS start, arg_min(trade_date, (dd, trade_date)) AS trough, min(dd) AS depth, count(*) FILTER (dd < 0) AS sessions FROM i GROUP BY 1, 2), f AS (SELECT *, lead(start) OVER (PARTITION BY symbol ORDER BY island) AS \"end\" FROM e) "
    f'SELECT symbol, start, trough, "end", {_N("depth")} AS depth, sessions FROM f WHERE depth <= -0.05'
)
def drawdown_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drawdowns of each symbol at least five per cent deep: peak, trough, recovery."""
    r = _returns(spark, sf_dir)
    nav = r.withColumn("nav", F.product(1 + F.col("ret")).over(W.partitionBy("symbol").orderBy("trade_date").rowsBetween(W.unboundedPreceding, 0)))
    return _near(strategy.drawdown_periods(nav, "symbol").select("symbol", "start", "trough", "end", "depth", "sessions"), "depth")
