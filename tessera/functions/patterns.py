"""Candlestick patterns: 1 or 0 per bar, null where a price is missing, from the bar and earlier ones only.

Each pattern is a condition over the bar (o, h, l, c; b body, r range, u upper and w lower shadow, t and m top and bottom
of the body) and the bars k before it (o1, h1, ... o4). Thresholds are shares of the range unless said otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import ts

#: Least range of a bar as a share of its close, for patterns that compare parts of it.
RANGE = 0.004
_sized = lambda share=RANGE: f"r > 0 AND c > 0 AND r >= c * {share}"
_white = lambda k="": f"c{k} > o{k}"
_black = lambda k="": f"c{k} < o{k}"
_long = lambda k, share=0.5: f"b{k} >= {share} * r{k}"
_near = lambda x, y, tol=0.003: f"abs({x} - {y}) <= abs({y}) * {tol}"
_small = lambda k, share=0.1: f"b{k} <= {share} * r{k}"
_within = lambda k, j: f"t{k} <= t{j} AND m{k} >= m{j}"
_inside_body = _within("", 1)
_bare = lambda k="": f"u{k} <= 0.1 * r{k} AND w{k} <= 0.1 * r{k}"
_all = lambda rule, *bars: " AND ".join(rule(k) for k in bars)
_rising = "c1 > c2 AND c > c1"
_falling = "c1 < c2 AND c < c1"
#: An open inside the upper or lower part of the body before.
_opens_up = "o1 > o2 AND o1 < c2 AND o > o1 AND o < c1"
_opens_down = "o1 < o2 AND o1 > c2 AND o < o1 AND o > c1"


def _trap(bull: bool, strict: bool) -> str:
    """An inside bar, a false break out of it, and within three bars a close beyond its other side."""
    ways = []
    for k in (1, 2, 3):
        i, j = k + 1, k + 2
        false, back, held = (f"c{k} < l{i}", f"c > h{i}", f"l{k} > l{j}") if bull else (f"c{k} > h{i}", f"c < l{i}", f"h{k} < h{j}")
        ways.append(" AND ".join([f"h{i} < h{j} AND l{i} > l{j}", false, back, *([held] if strict else [])]))
    return "(" + ") OR (".join(ways) + ")"


_CONDITIONS: dict[str, tuple[str, ...]] = {
    "doji": (_sized(), "b <= 0.1 * r"),
    "hammer": (_sized(), "c5 > c", "w >= 2 * b", "u <= 0.25 * r", "b <= 0.35 * r"),
    "shooting_star": (_sized(), "c5 < c", "u >= 2 * b", "w <= 0.25 * r", "b <= 0.35 * r"),
    "hanging_man": (_sized(), "c5 < c", "w >= 2 * b", "u <= 0.25 * r", "b <= 0.35 * r"),
    "inverted_hammer": (_sized(), "c5 > c", "u >= 2 * b", "w <= 0.25 * r", "b <= 0.35 * r"),
    "gravestone_doji": (_sized(), "b <= 0.1 * r", "w <= 0.1 * r", "u >= 0.6 * r"),
    "dragonfly_doji": (_sized(), "b <= 0.1 * r", "u <= 0.1 * r", "w >= 0.6 * r"),
    "long_legged_doji": (_sized(0.006), "b <= 0.1 * r", "u >= 0.3 * r", "w >= 0.3 * r"),
    "takuri": (_sized(), "b <= 0.2 * r", "u <= 0.1 * r", "w >= 0.6 * r"),
    "marubozu": (_sized(), "u <= 0.05 * r", "w <= 0.05 * r", "b >= 0.7 * r"),
    "closing_marubozu": (_sized(), f"(({_white()} AND u <= 0.1 * r) OR ({_black()} AND w <= 0.1 * r))", "b >= 0.7 * r"),
    "spinning_top": (_sized(), "b <= 0.3 * r", "u >= 0.1 * r", "w >= 0.1 * r"),
    "high_wave": (_sized(0.008), "b <= 0.25 * r", "u >= 0.3 * r", "w >= 0.3 * r"),
    "long_line": (_sized(), "b >= 0.8 * r"),
    "short_line": (_sized(), "b <= 0.3 * r"),
    "belt_hold_bull": (_sized(), _white(), "w <= 0.05 * r", "b >= 0.6 * r"),
    "belt_hold_bear": (_sized(), _black(), "u <= 0.05 * r", "b >= 0.6 * r"),
    "bullish_engulfing": (_black(1), _white(), "o <= c1", "c >= o1", "b > b1"),
    "bearish_engulfing": (_white(1), _black(), "o >= c1", "c <= o1", "b > b1"),
    "counterattack_bull": (_sized(), _black(1), _long(1), _white(), _near("c", "c1")),
    "counterattack_bear": (_sized(), _white(1), _long(1), _black(), _near("c", "c1")),
    "separating_lines_bull": (_sized(), _black(1), _white(), _near("o", "o1"), _long("")),
    "separating_lines_bear": (_sized(), _white(1), _black(), _near("o", "o1"), _long("")),
    "matching_low": (_sized(), _black(1), _long(1), _black(), _near("c", "c1")),
    "dark_cloud_cover": (_sized(), _white(1), _long(1), _black(), "o > c1", "c < m1 + 0.5 * b1", "c > o1"),
    "piercing": (_sized(), _black(1), _long(1), _white(), "o < c1", "c > t1 - 0.5 * b1", "c < o1"),
    "on_neck": (_sized(), _black(1), _long(1), _white(), "o < l1", _near("c", "c1")),
    "in_neck": (_sized(), _black(1), _long(1), _white(), "o < l1", "c > c1", "c <= c1 + 0.1 * (o1 - c1)"),
    "thrusting_neck": (_sized(), _black(1), _long(1), _white(), "o < l1", "c > c1", "c < c1 + 0.5 * (o1 - c1)"),
    "harami": (_sized(), _long(1), "b <= 0.5 * r", _inside_body),
    "harami_cross": (_sized(), _long(1), "b <= 0.1 * r", _inside_body),
    "homing_pigeon": (_sized(), _black(1), _long(1), _black(), "b <= 0.5 * r", _inside_body),
    "morning_star": (_black(2), "b1 <= 0.5 * b2", "t1 < c2", _white(), "c >= c2 + 0.5 * b2"),
    "gap_side_side_white_up": (_sized(), _white(2), _white(1), _long(1, 0.4), "o1 > h2", _white(), "o <= c1", "o >= o1", "c > c1", "l > h2"),
    "gap_side_side_white_down": (_sized(), _black(2), _black(1), _long(1, 0.4), "o1 < l2", _black(), "o >= c1", "o <= o1", "c < c1", "h < l2"),
    "tasuki_gap_up": (_sized(), _white(2), _white(1), _long(1, 0.4), "o1 > h2", _black(), "o <= c1", "o >= o1", "c < c1", "c > h2"),
    "tasuki_gap_down": (_sized(), _black(2), _black(1), _long(1, 0.4), "o1 < l2", _white(), "o >= c1", "o <= o1", "c > c1", "c < l2"),
    "upside_gap_two_crows": (_sized(), _white(2), _long(2), _black(1), "o1 > h2", "c1 > c2", _black(), "o > c1", "c < c1", "c > c2"),
    "two_crows": (_sized(), _white(2), _long(2), _black(1), "o1 > c2", "c1 < c2", _black(), "c < c1", "c < c2", "c > o2"),
    "xside_gap_3_methods_up": (_sized(), _white(2), _white(1), _long(1, 0.4), "o1 > h2", _black(), "o <= c1", "c < c1", "c > c2"),
    "xside_gap_3_methods_down": (_sized(), _black(2), _black(1), _long(1, 0.4), "o1 < l2", _white(), "o >= c1", "c > c1", "c < c2"),
    "kicking": (_sized(), _black(1), _bare(1), _white(), _bare(), "o > o1"),
    "kicking_by_length": (_sized(), _black(1), _bare(1), _white(), _bare(), "o > o1", _near("b", "b1", 0.02)),
    "morning_doji_star": (_sized(), _black(2), _long(2), _small(1), "h1 < l2", _white(), "c > c2 + 0.5 * b2"),
    "evening_star": (_sized(), _white(2), "b1 <= 0.5 * b2", "m1 > c2", _black(), "c <= c2 - 0.5 * b2"),
    "evening_doji_star": (_sized(), _white(2), _long(2), _small(1), "l1 > h2", _black(), "c < c2 - 0.5 * b2"),
    "abandoned_baby_bull": (_sized(), _black(2), _small(1), "h1 < l2", _white(), "l > h1"),
    "abandoned_baby_bear": (_sized(), _white(2), _small(1), "l1 > h2", _black(), "h < l1"),
    "three_white_soldiers": (_sized(), _all(_white, 2, 1, ""), _rising, _all(lambda k: _long(k, 0.4), 2, 1, ""), _opens_up),
    "three_black_crows": (_sized(), _all(_black, 2, 1, ""), _falling, _all(lambda k: _long(k, 0.4), 2, 1, ""), _opens_down),
    "identical_three_crows": (_sized(), _all(_black, 2, 1, ""), _all(lambda k: _long(k, 0.4), 2, 1, ""), _falling, _near("o1", "c2"), _near("o", "c1")),
    "advance_block": (_sized(), _all(_white, 2, 1, ""), _rising, _long(2, 0.3), _long(1, 0.3), "b < b1", "u > u1", _opens_up),
    "stalled_pattern": (_sized(), _all(_white, 2, 1, ""), _rising, _long(1), "b <= 0.3 * b1", _near("o", "c1")),
    "three_stars_in_south": (_sized(), _black(2), _long(2, 0.45), "w2 >= 0.8 * b2", _black(1), "o1 > c2", "c1 < c2", _black(), "o >= m1", "o <= t1", "c > c1"),
    "three_inside_up": (_sized(), _black(2), _long(2), _white(1), _within(1, 2), _white(), "c > c2"),
    "three_inside_down": (_sized(), _white(2), _long(2), _black(1), _within(1, 2), _black(), "c < c2"),
    "three_outside_up": (_sized(), _black(2), _white(1), "o1 <= c2", "c1 >= o2", "b1 > b2", _white(), "c > c1"),
    "three_outside_down": (_sized(), _white(2), _black(1), "o1 >= c2", "c1 <= o2", "b1 > b2", _black(), "c < c1"),
    "three_line_strike_bull": (_sized(), _all(_black, 3, 2, 1), "c2 < c3 AND c1 < c2", "o < c1", _long("", 0.8), "c > o3"),
    "three_line_strike_bear": (_sized(), _all(_white, 3, 2, 1), "c2 > c3 AND c1 > c2", "o > c1", _long("", 0.8), "c < o3"),
    "rising_three_methods": (_sized(), _white(4), _long(4, 0.6), _all(lambda k: f"b{k} <= 0.3 * b4", 3, 2, 1), _all(lambda k: _within(k, 4), 3, 2, 1), _white(), "c > c4"),
    "falling_three_methods": (_sized(), _black(4), _long(4, 0.6), _all(lambda k: f"b{k} <= 0.3 * b4", 3, 2, 1), _all(lambda k: _within(k, 4), 3, 2, 1), _black(), "c < c4"),
    "mat_hold": (_sized(), _white(4), _long(4, 0.6), "o3 > h4", _all(lambda k: f"b{k} <= 0.3 * b4", 3, 2, 1), _within(2, 4), _within(1, 4), _white(), "c > c4"),
    "breakaway_bull": (_sized(), _black(4), _long(4), "h3 < l4", _white(), "c > least(l3, l2, l1)", "c < c4"),
    "breakaway_bear": (_sized(), _white(4), _long(4), "l3 > h4", _black(), "c < greatest(h3, h2, h1)", "c > c4"),
    "ladder_bottom": (_sized(), _all(_black, 4, 3, 2), "c3 < c4 AND c2 < c3", _black(1), "u1 >= 0.3 * r1", _white(), "c > o1"),
    "concealing_baby_swallow": (_sized(), _all(_black, 3, 2, 1, ""), _long(3, 0.4), _long(2, 0.4), "o1 < l2", "t >= t1 AND m <= m1", "c < c1", "w1 >= 0.4 * r1", "w >= 0.4 * r"),
    "stick_sandwich": (_sized(), _black(2), _white(1), "o1 > h2", _black(), _near("c", "c2")),
    "tri_star": (_sized(0.006), _all(_small, 2, 1, ""), "h1 < l2 OR l1 > h2"),
    "unique_three_river": (_sized(), _black(2), _long(2), _black(1), "b1 <= 0.5 * b2", "w1 >= 2 * b1", _white(), "o < c1", "c < c1"),
    "doji_star": (_sized(), _long(1), _small(""), "m >= t1 OR t <= m1"),
    "rickshaw_man": (_sized(0.01), _small(""), "u >= 0.4 * r", "w >= 0.4 * r"),
    "hikkake_bull": (_sized(), _trap(True, False)),
    "hikkake_bear": (_sized(), _trap(False, False)),
    "hikkake_mod_bull": (_sized(), _trap(True, True)),
    "hikkake_mod_bear": (_sized(), _trap(False, True)),
}

#: Bars a condition may look back.
BACK = 5


def with_parts(bars: DataFrame) -> DataFrame:
    """Adds the parts of each bar and of the bars before it."""
    parts = {
        "o": "open",
        "h": "high",
        "l": "low",
        "c": "close",
        "b": "abs(close - open)",
        "r": "high - low",
        "u": "high - greatest(open, close)",
        "w": "least(open, close) - low",
        "t": "greatest(open, close)",
        "m": "least(open, close)",
    }
    bars = bars.withColumns({k: F.expr(v) for k, v in parts.items()})
    return bars.withColumns({f"{k}{n}": F.lag(k, n).over(ts()) for n in range(1, BACK + 1) for k in parts})


def names() -> list[str]:
    return list(_CONDITIONS)


def condition(name: str) -> str:
    """The pattern as a SQL condition over the parts."""
    return " AND ".join(f"({c})" for c in _CONDITIONS[name])


def flags(bars: DataFrame, wanted: list[str] | None = None) -> DataFrame:
    """The panel with a tinyint column per pattern; one window serves all."""
    missing = "open IS NULL OR high IS NULL OR low IS NULL OR close IS NULL"
    found = {n: F.expr(f"CAST(CASE WHEN {missing} THEN NULL WHEN {condition(n)} THEN 1 ELSE 0 END AS TINYINT)") for n in wanted or names()}
    d = with_parts(bars)
    return d.select(*bars.columns, *[c.alias(f"pattern_{n}") for n, c in found.items()])
