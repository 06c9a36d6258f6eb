"""Indicators of daily prices: window expressions, and kernels that walk a series.

SQL of the kernels doesn't walk: exponential means are sums over all rows so far with their
weights written out, and what has no closed form is a recursive query over row numbers.
"""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from larkspur.functions import indicators as I, scalars as S, sequential as Q, windows as W
from larkspur.plans import by_series
from larkspur.queries.registry import BARS, DAY, FIXED, bars, fixed, query

# Window expressions

W_SQL = "PARTITION BY user_id ORDER BY day"
WINDOWS = f"WINDOW w AS ({W_SQL}), p AS (PARTITION BY user_id), u AS ({W_SQL} ROWS UNBOUNDED PRECEDING), " + ", ".join(f"w{n} AS ({W_SQL} ROWS {n - 1} PRECEDING)" for n in range(2, 8))


def _expr(name, sql, make, prepare: str = "b"):
    """x of each bar by ``make`` from low, high, open, close and volume; ``sql`` over b, the bars with their number rn of cnt."""
    steps = f"WITH {BARS}, b AS (SELECT *, row_number() OVER ({W_SQL}) AS rn, count(*) OVER (PARTITION BY user_id) AS cnt FROM bars){'' if prepare == 'b' else ', ' + prepare}"
    source = "b" if prepare == "b" else re.findall(r"(?:^|, )(\w+) AS \(SELECT", prepare)[-1]
    columns = lambda t: make(*[F.col(c) for c in ("low", "high", "open", "close", "volume")])
    query(name, f"{steps} SELECT user_id, day, {FIXED(sql)} AS x FROM {source} {WINDOWS}" if sql else None)(lambda t: bars(t).select("user_id", "day", fixed(columns(t).cast("double")).alias("x")))


def nz(a: str, b: str) -> str:
    """a - b, with the machine epsilon added if one row of the series is 0."""
    return f"({a} - {b} + CASE WHEN bool_or({a} - {b} = 0) OVER p THEN 2.220446049250313e-16 ELSE 0 END)"


def when(n: int, sql: str) -> str:
    return f"CASE WHEN rn >= {n} THEN {sql} END"


TR = "greatest(abs(high - low), coalesce(abs(high - lag(close) OVER w), 0), coalesce(abs(lag(close) OVER w - low), 0))"
_TR = f"c AS (SELECT *, {TR} AS tr, lag(close) OVER w AS pc, lag(high) OVER w AS ph, lag(low) OVER w AS pl FROM b WINDOW w AS ({W_SQL}))"

_expr("williams_r", when(5, "100 * ((close - min(low) OVER w5) / nullif(max(high) OVER w5 - min(low) OVER w5, 0) - 1)"), lambda l, h, o, c, v: W.williams_r(l, h, c, 5, **DAY))
_expr("rolling_mid", when(5, "(min(low) OVER w5 + max(high) OVER w5) / 2"), lambda l, h, o, c, v: W.rolling_mid(l, h, 5, **DAY))
_expr("bollinger_upper", when(5, "avg(close) OVER w5 + 2 * stddev_samp(close) OVER w5 - close"), lambda l, h, o, c, v: W.bollinger(c, 5, **DAY)["upper_to_raw"])
_expr("bollinger_lower", when(5, "close - (avg(close) OVER w5 - 2 * stddev_samp(close) OVER w5)"), lambda l, h, o, c, v: W.bollinger(c, 5, **DAY)["raw_to_lower"])
_expr("drawdown", "max(close) OVER u - close", lambda l, h, o, c, v: W.drawdown(c, **DAY)["drawdown"])
_expr("drawdown_percent", "1 - close / max(close) OVER u", lambda l, h, o, c, v: W.drawdown(c, **DAY)["percent"])
_expr("drawdown_log", "ln(max(close) OVER u / close)", lambda l, h, o, c, v: W.drawdown(c, **DAY)["log"])
_expr("true_range", TR, lambda l, h, o, c, v: W.true_range(l, h, c, **DAY))
_expr("on_balance_volume", "sum(s * volume) OVER u", lambda l, h, o, c, v: W.on_balance_volume(c, v, **DAY), f"d AS (SELECT *, coalesce(sign(close - lag(close) OVER ({W_SQL})), 1) AS s FROM b)")
for _name, _sql in (("pivot", "pp"), ("r1", "2 * pp - low"), ("s1", "2 * pp - high"), ("r2", "pp + high - low"), ("s2", "pp - high + low"), ("r3", "high + 2 * (pp - low)"), ("s3", "low - 2 * (high - pp)")):
    _expr("pivot_point" if _name == "pivot" else f"pivot_{_name}", _sql, lambda l, h, o, c, v, n=_name: W.pivot_points(l, h, c)[n], "d AS (SELECT *, (low + high + close) / 3 AS pp FROM b)")
_expr("psychological_line", when(5, "100 * sum((close > open)::INT) OVER w5 / 5"), lambda l, h, o, c, v: W.psychological_line(c, 5, o, **DAY))
_expr("psychological_line_closes", when(5, "100 * sum(up) OVER w5 / 5"), lambda l, h, o, c, v: W.psychological_line(c, 5, **DAY), f"d AS (SELECT *, coalesce((close > lag(close) OVER ({W_SQL}))::INT, 0) AS up FROM b)")
_expr("price_distance", f"CASE WHEN rn >= 2 AND rn < cnt THEN 2 * {nz('high', 'low')} + abs(lead(open) OVER w - close) - abs{nz('close', 'open')} END", lambda l, h, o, c, v: W.price_distance(l, h, o, c, **DAY))
_expr("detrended_price", when(8, "close - (lag(close, 3) OVER w + lag(close, 4) OVER w + lag(close, 5) OVER w + lag(close, 6) OVER w + lag(close, 7) OVER w) / 5"), lambda l, h, o, c, v: W.detrended_price(c, 5, **DAY))
_expr("commodity_channel", when(5, "(tp - avg(tp) OVER w5) / nullif(0.015 * list_avg(list_transform(list(tp) OVER w5, lambda v: abs(v - m))), 0)"), lambda l, h, o, c, v: W.commodity_channel(l, h, c, 5, **DAY),
      f"d AS (SELECT *, (low + high + close) / 3 AS tp FROM b), e AS (SELECT *, avg(tp) OVER ({W_SQL} ROWS 4 PRECEDING) AS m FROM d)")
_BEFORE5 = f"({W_SQL} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)"
_expr("garman_klass", when(6, f"sqrt(252 * avg(0.5 * power(ln(high / low), 2) - (2 * ln(2) - 1) * power(ln(close / open), 2)) OVER {_BEFORE5})"), lambda l, h, o, c, v: W.garman_klass(l, h, o, c, 5, **DAY))
_expr("parkinson", when(5, "sqrt(252 * avg(power(ln(high / low), 2) / (4 * ln(2))) OVER w5)"), lambda l, h, o, c, v: W.parkinson(l, h, 5, **DAY))
_expr("yang_zhang", when(7, f"sqrt(252 * sum(t) OVER {_BEFORE5} / 4)"), lambda l, h, o, c, v: W.yang_zhang(l, h, o, c, 5, **DAY), "c0 AS (SELECT *, 0.34 / (1 + 6 / 4.0) AS k FROM b), " + _TR.replace("FROM b", "FROM c0")
      + ", d AS (SELECT *, power(ln(open / pc), 2) + k * power(ln(close / pc), 2) + (1 - k) * (ln(high / open) * (ln(high / open) - ln(close / open)) + ln(low / open) * (ln(low / open) - ln(close / open))) AS t FROM c)")
_expr("hodges_tompkins", when(5, "sqrt(252) * stddev_samp(ret) OVER w5 / nullif(1 - 5.0 / n + 24.0 / (3 * n * n), 0)"), lambda l, h, o, c, v: W.hodges_tompkins(c, 5, **DAY), f"d AS (SELECT *, ln(close / lag(close) OVER ({W_SQL})) AS ret, nullif(cnt - 4, 0)::DOUBLE AS n FROM b)")
_expr("slope", "(close - lag(close, 2) OVER w) / 2", lambda l, h, o, c, v: W.slope(c, 2, **DAY))
_expr("slope_degrees", "degrees(atan((close - lag(close, 2) OVER w) / 2))", lambda l, h, o, c, v: W.slope(c, 2, True, True, **DAY))
_part = lambda n: f"sum(bp) OVER w{n} / nullif(sum(tr2) OVER w{n}, 0)"
_expr("ultimate_oscillator", when(7, f"100 * (4 * ({_part(3)}) + 2 * ({_part(5)}) + {_part(7)}) / 7"), lambda l, h, o, c, v: W.ultimate_oscillator(l, h, c, 3, 5, 7, **DAY),
      _TR + ", d AS (SELECT *, CASE WHEN pc IS NOT NULL THEN close - least(low, pc) END AS bp, CASE WHEN pc IS NOT NULL THEN greatest(high, pc) - least(low, pc) END AS tr2 FROM c)")
_expr("ulcer_index", when(5, "sqrt(sum(power(dn, 2)) OVER w5 / 5)"), lambda l, h, o, c, v: W.ulcer_index(c, 5, **DAY), f"d AS (SELECT *, CASE WHEN rn >= 5 THEN 100 * (close - max(close) OVER ({W_SQL} ROWS 4 PRECEDING)) / max(close) OVER ({W_SQL} ROWS 4 PRECEDING) END AS dn FROM b)")
_expr("ttm_trend", "coalesce(CASE WHEN rn >= 6 THEN close > avg((low + high) / 2) OVER w6 END, false)::INT", lambda l, h, o, c, v: W.ttm_trend(l, h, c, 5, **DAY).cast("int"))
_lags = lambda x, weights: " + ".join(f"{w!r} * {'lag(' + x + ', ' + str(i) + ') OVER w' if i else x}" for i, w in enumerate(weights))
_expr("centre_of_gravity", when(5, f"-({_lags('close', [1, 2, 3, 4, 5])}) / sum(close) OVER w5"), lambda l, h, o, c, v: W.centre_of_gravity(c, 5, **DAY))
_alma = [f"exp(-power({i} - 0.85 * 4, 2) / (2 * power(5 / 6.0, 2)))" for i in range(5)]
_expr("arnaud_legoux", when(6, f"({' + '.join(f'{w} * lag(close, {i}) OVER w' for i, w in enumerate(_alma))}) / ({' + '.join(_alma)})"), lambda l, h, o, c, v: W.arnaud_legoux(c, 5, **DAY))
_expr("rate_of_change", "(close - lag(close) OVER w) / nullif(lag(close) OVER w, 0)", lambda l, h, o, c, v: W.rate_of_change(c, 1, **DAY))
_ad = f"d AS (SELECT *, (close - open) * volume / nullif(high - low, 0) AS f FROM b)"
_expr("accumulation", "CASE WHEN f IS NOT NULL THEN sum(f) OVER u END", lambda l, h, o, c, v: W.accumulation(l, h, o, c, v, **DAY), _ad)
_expr("chaikin_money_flow", when(5, "CASE WHEN count(f) OVER w5 = 5 THEN sum(f) OVER w5 END / sum(volume) OVER w5"), lambda l, h, o, c, v: W.chaikin_money_flow(l, h, o, c, v, 5, **DAY), _ad)
_expr("vertical_horizontal", when(6, "(max(close) OVER w5 - min(close) OVER w5) / nullif(sum(m) OVER w5, 0)"), lambda l, h, o, c, v: W.vertical_horizontal(c, 5, **DAY), f"d AS (SELECT *, abs(close - lag(close) OVER ({W_SQL})) AS m FROM b)")
_expr("decay", "greatest(close, lag(close) OVER w - 0.2, 0)", lambda l, h, o, c, v: W.decay(c, 5, **DAY))
_expr("decay_exponential", "greatest(close, lag(close) OVER w - exp(-5), 0)", lambda l, h, o, c, v: W.decay(c, 5, True, **DAY))
_expr("coppock", "CASE WHEN rn >= 3 AND len(k) > 0 THEN list_sum(list_transform(k, lambda v, i: v * i)) / (len(k) * (len(k) + 1) / 2.0) END", lambda l, h, o, c, v: W.coppock(c, 4, 3, 3, **DAY),
      f"d AS (SELECT *, close / lag(close, 4) OVER ({W_SQL}) + close / lag(close, 3) OVER ({W_SQL}) - 2 AS s FROM b), e AS (SELECT *, list_filter(list(s) OVER ({W_SQL} ROWS 2 PRECEDING), lambda v: v IS NOT NULL) AS k FROM d)")
_expr("balance_of_power", f"{nz('close', 'open')} / {nz('high', 'low')}", lambda l, h, o, c, v: W.balance_of_power(l, h, o, c, ["user_id"]))
for _side, _up in (("plus", "abs(high - pl)"), ("minus", "abs(low - ph)")):
    _expr("vortex" if _side == "plus" else "vortex_minus", when(6, f"sum({_up}) OVER w5 / nullif(sum(tr) OVER w5, 0)"), lambda l, h, o, c, v, s=_side: W.vortex(l, h, c, 5, **DAY)[s], _TR)
for _side, _band in (("upper", "high * (1 + k)"), ("middle", "close"), ("lower", "low * (1 - k)")):
    _expr("acceleration_bands" if _side == "upper" else f"acceleration_{_side}", when(5, f"avg({_band}) OVER w5"), lambda l, h, o, c, v, s=_side: W.acceleration_bands(c, h, l, 5, **DAY)[s], f"d AS (SELECT *, 4 * {nz('high', 'low')} / (high + low) AS k FROM b WINDOW p AS (PARTITION BY user_id))")
_expr("ease_of_movement", when(6, "avg(f) OVER w5"), lambda l, h, o, c, v: W.ease_of_movement(l, h, v, 5, **DAY), _TR + ", d AS (SELECT *, ((high + low) / 2 - (ph + pl) / 2) * (high - low) / (volume / 1e8) AS f FROM c)")
_expr("price_volume_trend", "CASE WHEN f IS NOT NULL THEN sum(f) OVER u END", lambda l, h, o, c, v: W.price_volume_trend(c, v, **DAY), f"d AS (SELECT *, (close / lag(close) OVER ({W_SQL}) - 1) * volume AS f FROM b)")
_expr("chop_index", when(5, "100 * (log10(sum(tr) OVER w5) - log10(nullif(max(high) OVER w5 - min(low) OVER w5, 0))) / log10(5)"), lambda l, h, o, c, v: W.chop_index(l, h, c, 5, **DAY), _TR)
_tri = lambda x: f"CASE WHEN rn >= 5 THEN (lag({x}) OVER ({W_SQL}) + 2 * lag({x}, 2) OVER ({W_SQL}) + 2 * lag({x}, 3) OVER ({W_SQL}) + lag({x}, 4) OVER ({W_SQL})) / 6 END"
_expr("relative_vigor", when(5, "sum(ta) OVER w5 / nullif(sum(tb) OVER w5, 0)"), lambda l, h, o, c, v: W.relative_vigor(l, h, o, c, 5, **DAY),
      f"d AS (SELECT *, {nz('close', 'open')} AS a, {nz('high', 'low')} AS z FROM b WINDOW p AS (PARTITION BY user_id)), e AS (SELECT *, {_tri('a')} AS ta, {_tri('z')} AS tb FROM d)")
for _side, _test in (("peak", ">"), ("valley", "<")):
    _expr("peaks_and_valleys" if _side == "peak" else "last_valley", "coalesce(last_value(turn IGNORE NULLS) OVER u, CASE WHEN rn = 1 THEN close ELSE nth_value(close, 2) OVER u END)", lambda l, h, o, c, v, s=_side: W.peaks_and_valleys(c, F.col("day"), **DAY)[s]["value"],
          f"d AS (SELECT *, CASE WHEN lag(close) OVER ({W_SQL}) {_test} lag(close, 2) OVER ({W_SQL}) AND lag(close) OVER ({W_SQL}) {_test} close THEN lag(close) OVER ({W_SQL}) END AS turn FROM b)")
_expr("bias", when(5, "close / nullif(avg(close) OVER w5, 0) - 1"), lambda l, h, o, c, v: W.bias(c, 5, **DAY))
_expr("symmetric_triangle", when(5, "(lag(close) OVER w + 2 * lag(close, 2) OVER w + 2 * lag(close, 3) OVER w + lag(close, 4) OVER w) / 6"), lambda l, h, o, c, v: W.symmetric_triangle_mean(c, 4, **DAY))
_expr("weighted_mean", when(3, "(3 * close + 2 * lag(close) OVER w + lag(close, 2) OVER w) / 6"), lambda l, h, o, c, v: W.weighted_mean(c, 3, **DAY))
for _name, _sql in (("short_to_long", when(6, "avg(close) OVER w3 - avg(close) OVER w6")), ("raw_to_short", when(3, "close - avg(close) OVER w3")), ("raw_to_long", when(6, "close - avg(close) OVER w6"))):
    _expr("double_cross_over" if _name == "short_to_long" else f"double_cross_{_name}", _sql, lambda l, h, o, c, v, n=_name: W.double_cross_over(c, 3, 6, **DAY)[n])
_expr("expo_smoother", "coalesce(lag(close) OVER w, close) + 0.3 * (close - coalesce(lag(close) OVER w, close))", lambda l, h, o, c, v: W.expo_smoother(c, 0.3, **DAY))
_days = lambda: F.unix_date(F.col("day").cast("date")).cast("double")
_grad = lambda f, c: f"coalesce((coalesce(lead({f}) OVER w, {f}) - coalesce(lag({f}) OVER w, {f})) / nullif(coalesce(lead({c}) OVER w, {c}) - coalesce(lag({c}) OVER w, {c}), 0), 0)"
_DATED = "d AS (SELECT *, epoch(day) / 86400 AS dn FROM b)"
_expr("gradient", _grad("close", "dn"), lambda l, h, o, c, v: W.gradient(c, _days(), **DAY), _DATED)
_expr("divergence", f"{_grad('close', 'dn')} + {_grad('high', 'volume')}", lambda l, h, o, c, v: W.divergence([c, h], [_days(), v], **DAY), _DATED)
_expr("jacobian_trace", f"{_grad('close', 'dn')} + {_grad('high', 'volume')}", lambda l, h, o, c, v: W.jacobian([c, h], [_days(), v], **DAY)["trace"], _DATED)
_expr("jacobian_cell", _grad("high", "dn"), lambda l, h, o, c, v: W.jacobian([c, h], [_days(), v], **DAY)["matrix"][1][0], _DATED)
_three = lambda x, i: f"CASE WHEN rn = 1 THEN {x if i == 0 else f'lead({x}, {i}) OVER w'} WHEN rn = cnt THEN {x if i == 2 else f'lag({x}, {2 - i}) OVER w'} ELSE {('lag(' + x + ') OVER w', x, 'lead(' + x + ') OVER w')[i]} END"
_expr("laplacian", "CASE WHEN cnt >= 3 THEN 2 * (f0 / ((x1 - x0) * (x2 - x0)) - f1 / ((x1 - x0) * (x2 - x1)) + f2 / ((x2 - x1) * (x2 - x0))) END", lambda l, h, o, c, v: W.laplacian(c, [_days()], **DAY),
      _DATED + ", e AS (SELECT *, " + ", ".join(f"{_three('close', i)} AS f{i}, {_three('dn', i)} AS x{i}" for i in range(3)) + f" FROM d WINDOW w AS ({W_SQL}))")
_expr("clip", "least(greatest(close, 50), 200)", lambda l, h, o, c, v: S.clip(c, 50.0, 200.0))
_expr("non_zero_range", nz("high", "low") + " * 1e15", lambda l, h, o, c, v: W.non_zero_range(h, l, ["user_id"]) * 1e15)
for _kind, _place in (("linreg", 4), ("forecast", 5), ("intercept", 0)):
    _expr(f"linreg_mean_{_kind}", when(6, f"avg(close) OVER {_BEFORE5} + regr_slope(close, rn) OVER {_BEFORE5} * ({_place} - 3)"), lambda l, h, o, c, v, k=_kind: W.linreg_mean(c, 5, k, **DAY))
_expr("linreg_mean", when(6, f"regr_slope(close, rn) OVER {_BEFORE5}"), lambda l, h, o, c, v: W.linreg_mean(c, 5, "slope", **DAY))
_expr("linreg_degrees", when(6, f"degrees(atan(regr_slope(close, rn) OVER {_BEFORE5}))"), lambda l, h, o, c, v: W.linreg_mean(c, 5, "degree", **DAY))
_AHEAD = f"({W_SQL} ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)"
_expr("entropy", f"CASE WHEN rn > cnt - 3 THEN e WHEN rn >= 4 THEN sum(e) OVER {_AHEAD} END", lambda l, h, o, c, v: W.entropy(c, 4, **DAY), f"d AS (SELECT *, CASE WHEN rn >= 4 THEN close / sum(close) OVER ({W_SQL} ROWS 3 PRECEDING) END AS q FROM b), e0 AS (SELECT *, -q * log2(q) AS e FROM d)")
for _kind, _sql in (("gini_index", "1 - list_sum(list_transform(s, lambda q: q * q))"), ("info_entropy", "-list_sum(list_transform(s, lambda q: q * log2(q)))")):
    _expr("impurity" if _kind == "gini_index" else "impurity_entropy", f"CASE WHEN rn <= cnt - 3 THEN {_sql} END", lambda l, h, o, c, v, k=_kind: W.impurity(F.floor(c / 100), 4, k, **DAY),
          f"d AS (SELECT *, list(floor(close / 100)) OVER {_AHEAD} AS g FROM b), e AS (SELECT *, list_transform(list_distinct(g), lambda y: len(list_filter(g, lambda z: z = y)) / 4.0) AS s FROM d)")
_expr("log_returns", "ln(close / lag(close) OVER w)", lambda l, h, o, c, v: W.returns(c, "log", 1, **DAY))
_expr("percent_returns", "close / lag(close) OVER w - 1", lambda l, h, o, c, v: W.returns(c, "percentage", 1, **DAY))
_expr("trinary_returns", "sign(close - lag(close) OVER w)", lambda l, h, o, c, v: W.returns(c, "trinary", 1, **DAY))
_expr("cumulative_product", "exp(sum(ln(close)) OVER u) / 1e60", lambda l, h, o, c, v: W.cumulative_product(c, **DAY) / 1e60)
_expr("roll_min", when(4, "min(close) OVER w4"), lambda l, h, o, c, v: W.rolling(F.min, 4, c, **DAY))
_expr("abs", "abs(close - 200)", lambda l, h, o, c, v: F.abs(c - 200))

# Kernels


def _kernel_query(name, kernel, columns, output, sql, **options):
    def make(t):
        run = lambda *a, **o: {"k_out": kernel(*a, **o)[output]}
        return by_series(bars(t), run, columns, {"k_out": "double"}, ["day"], ["user_id"], **options).select("user_id", "day", fixed("k_out").alias("x"))

    query(name, sql)(make)


class Steps:
    """SQL in steps: each adds columns to the bars, which also have their number rn of cnt and the row before's prices."""

    def __init__(self, **columns):
        self.parts, self.last, self.recursive = [f"b AS (SELECT *, row_number() OVER ({W_SQL}) AS rn, count(*) OVER (PARTITION BY user_id) AS cnt FROM bars)", f"c AS (SELECT *, lag(close) OVER w AS pc, lag(high) OVER w AS ph, lag(low) OVER w AS pl, {TR} AS tr FROM b WINDOW w AS ({W_SQL}))"], "c", False
        if columns:
            self.add(**columns)

    def add(self, **columns) -> Steps:
        name = f"s{len(self.parts)}"
        self.parts.append(f"{name} AS (SELECT *, {', '.join(f'{sql} AS {c}' for c, sql in columns.items())} FROM {self.last} {WINDOWS})")
        self.last = name
        return self

    def walk(self, start: dict[str, str], *lets: dict[str, str]) -> Steps:
        """State columns, of the first row by ``start`` and of others by ``lets``: each step sees the state so far as p_<name> and the row's columns, the last one gives the new state."""
        name, row = f"r{len(self.parts)}", f"x.*, {', '.join(f'p.{c} AS p_{c}' for c in start)}"
        inner = f"SELECT {row} FROM {name} p JOIN {self.last} x ON x.user_id = p.user_id AND x.rn = p.rn + 1"
        for let in lets[:-1]:
            inner = f"SELECT *, {', '.join(f'{sql} AS {c}' for c, sql in let.items())} FROM ({inner})"
        step = ", ".join(lets[-1][c] for c in start)
        self.parts.append(f"{name} AS (SELECT user_id, rn, {', '.join(f'{sql} AS {c}' for c, sql in start.items())} FROM {self.last} WHERE rn = 1 UNION ALL SELECT user_id, rn, {step} FROM ({inner}))")
        self.parts.append(f"s{len(self.parts)} AS (SELECT * FROM {self.last} JOIN {name} USING (user_id, rn))")
        self.last, self.recursive = f"s{len(self.parts) - 1}", True
        return self

    def sql(self, x: str) -> str:
        return f"WITH {'RECURSIVE ' if self.recursive else ''}{BARS}, {', '.join(self.parts)} SELECT user_id, day, {FIXED(x)} AS x FROM {self.last} {WINDOWS}"


def weighted_sum(x: str, q: float, first: int) -> str:
    return f"list_sum(list_transform(list({x}) OVER u, lambda v, k: CASE WHEN k >= {first} THEN v * power({q!r}, rn - k) ELSE 0 END))"


def fin(x: str, n: float, start: int = 1, tail: bool = False) -> str:
    """The finite exponential mean by span of a column whose first value is in row ``start``; of the rows from there on alone with ``tail``."""
    q = 1 - 2 / (n + 1)
    first = start if start == 1 or tail else start + 1
    return f"CASE WHEN rn < {start} THEN {'NULL' if tail else '0'} WHEN rn = {start} THEN {x} ELSE {weighted_sum(x, q, first)} / ((1 - power({q!r}, rn - {start - 1})) / {1 - q!r}) END"


def plain(x: str, n: float, start: int = 1) -> str:
    """The plain one, of the rows from ``start`` on."""
    a = 2 / (n + 1)
    return f"CASE WHEN rn >= {start} THEN {a!r} * {weighted_sum(x, 1 - a, start + 1)} + power({1 - a!r}, rn - {start}) * (list({x}) OVER u)[{start}] END"


def zero_mean(x: str, a: float) -> str:
    """The one that begins at 0 in the row before the first."""
    return f"{a!r} * {weighted_sum(x, 1 - a, 1)}"


_q = 1 - 2 / 6.0
_moments = Steps(sw=f"(1 - power({_q!r}, rn)) / {1 - _q!r}", sw2=f"(1 - power({_q!r}, 2 * rn)) / {1 - _q * _q!r}").add(mx=f"{weighted_sum('close', _q, 1)} / sw", my=f"{weighted_sum('high', _q, 1)} / sw")
_co = lambda a, ma, b, mb: f"list_sum(list_transform(list_zip(list({a}) OVER u, list({b}) OVER u), lambda v, k: (v[1] - {ma}) * (v[2] - {mb}) * power({_q!r}, rn - k)))"
_moments.add(cxx=_co("close", "mx", "close", "mx"), cyy=_co("high", "my", "high", "my"), cxy=_co("close", "mx", "high", "my"))
_unbiased = "CASE WHEN rn > 1 THEN {} / sw * (sw * sw / (sw * sw - sw2)) END"


def _volatility(n: int) -> Steps:
    out = Steps()
    for c, before in (("close", "pc"), ("high", "ph"), ("low", "pl")):
        out.add(**{f"s_{c}": f"CASE WHEN rn >= {n} THEN stddev_samp({c}) OVER w{n} END"}).add(**{f"u_{c}": f"({c} > {before})::INT * s_{c}", f"d_{c}": f"({c} < {before})::INT * s_{c}"})
        out.add(**{f"eu_{c}": fin(f"u_{c}", n, n), f"ed_{c}": fin(f"d_{c}", n, n)})
    terms = [f"100 * eu_{c} / nullif(eu_{c} + ed_{c}, 0)" for c in ("close", "high", "low")]
    return out.add(rvi=f"CASE WHEN rn >= {n} THEN ({' + '.join(terms)}) / 3 END")


def _rsi(kind: str, n: int) -> Steps:
    ret = "close / pc - 1" if kind == "percentage" else "close - pc"
    out = Steps(ret=ret).walk({"up": "0::DOUBLE", "dn": "0::DOUBLE"}, {"up": f"CASE WHEN ret > 0 THEN (p_up * {n - 1} + ret) / {n} ELSE p_up END", "dn": f"CASE WHEN ret < 0 THEN (p_dn * {n - 1} - ret) / {n} ELSE p_dn END"})
    return out.add(rsi=f"CASE WHEN cnt > {n + 3} AND rn >= {n} THEN CASE WHEN dn > 0 THEN 100 - 100 / (1 + up / dn) WHEN up > 0 THEN 100 END END")


def _wma(x: str, n: int) -> str:
    return f"CASE WHEN rn >= {n} THEN ({' + '.join(f'{n - i} * ' + (f'lag({x}, {i}) OVER w' if i else x) for i in range(n))}) / {n * (n + 1) / 2} END"


_hull = Steps(h=_wma("close", 3), f=_wma("close", 6)).add(raw="CASE WHEN rn = cnt THEN h ELSE 2 * h - f END").add(praw="lag(raw) OVER w")
_kama = Steps(move="abs(close - pc)", change="abs(close - lag(close, 5) OVER w)").add(noise="sum(move) OVER w5").add(k=f"power(coalesce(change / nullif(noise, 0), 0) * {2 / 3 - 2 / 31!r} + {2 / 31!r}, 2)")
_kama.walk({"out": "NULL::DOUBLE"}, {"out": "CASE WHEN rn < 5 THEN NULL WHEN rn = 5 THEN 0 ELSE k * close + (1 - k) * p_out END"})
_fisher = Steps(m="(low + high) / 2").add(place="(m - min(m) OVER w5) / greatest(max(m) OVER w5 - min(m) OVER w5, 0.001) - 0.5")
_fisher.walk({"v": "0::DOUBLE", "f": "NULL::DOUBLE"}, {"v0": "CASE WHEN rn > 5 THEN 0.66 * place + 0.67 * p_v ELSE 0 END"}, {"v1": "CASE WHEN v0 > 0.99 THEN 0.999 WHEN v0 < -0.99 THEN -0.999 ELSE v0 END"},
             {"v": "v1", "f": "CASE WHEN rn < 5 THEN NULL WHEN rn = 5 THEN 0 ELSE 0.5 * (ln((1 + v1) / (1 - v1)) + p_f) END"})
_ppo = Steps(ppo="CASE WHEN rn >= 6 THEN 100 * (avg(close) OVER w3 - avg(close) OVER w6) / avg(close) OVER w6 END").add(sig=plain("ppo", 3, 7)).add(ahead="lead(sig, 6) OVER w")
_sar = Steps(l1="lag(low) OVER w", l2="lag(low, 2) OVER w", h1="lag(high) OVER w", h2="lag(high, 2) OVER w").walk(
    {"sar": "close", "bull": "true", "af": "0.02::DOUBLE", "hp": "high", "lp": "low"},
    {"s0": "CASE WHEN rn <= 2 THEN close ELSE p_sar + p_af * (CASE WHEN p_bull THEN p_hp ELSE p_lp END - p_sar) END"},
    {"turn": "rn > 2 AND CASE WHEN p_bull THEN low < s0 ELSE high > s0 END", "further": "rn > 2 AND CASE WHEN p_bull THEN high > p_hp ELSE low < p_lp END"},
    {
        "sar": "CASE WHEN rn <= 2 THEN close WHEN turn THEN CASE WHEN p_bull THEN p_hp ELSE p_lp END WHEN p_bull THEN least(s0, l1, l2) ELSE greatest(s0, h1, h2) END", "bull": "CASE WHEN turn THEN NOT p_bull ELSE p_bull END",
        "af": "CASE WHEN turn THEN 0.02 WHEN further THEN least(p_af + 0.02, 0.2) ELSE p_af END", "hp": "CASE WHEN turn AND NOT p_bull THEN high WHEN further AND p_bull AND NOT turn THEN high ELSE p_hp END",
        "lp": "CASE WHEN turn AND p_bull THEN low WHEN further AND NOT p_bull AND NOT turn THEN low ELSE p_lp END",
    },
)
_sine = Steps(k1="(1 - sin(9)) / cos(9)", d="exp(-sqrt(2) * pi() / 10)").add(c2="2 * d * cos(sqrt(2) * 18)", c3="-d * d").walk(
    {"hp": "0::DOUBLE", "f1": "0::DOUBLE", "f0": "0::DOUBLE", "out": "NULL::DOUBLE"}, {"h": "0.5 * (1 + k1) * (close - pc) + k1 * p_hp"}, {"f": "(1 - c2 - c3) * (h + p_hp) / 2 + c2 * p_f1 + c3 * p_f0"},
    {"hp": "h", "f1": "f", "f0": "p_f1", "out": "(f + p_f1 + p_f0) / 3 / sqrt(nullif((f * f + p_f1 * p_f1 + p_f0 * p_f0) / 3, 0))"},
)
_smooth = Steps(z="pi() * sqrt(2) / 10").add(a="exp(-z)").add(a1="-a * a", c0="2 * a * cos(z)").walk({"s1": "close", "s0": "NULL::DOUBLE"}, {"s1": "CASE WHEN rn <= 2 THEN close ELSE (1 - a1 - c0) * close + c0 * p_s1 + a1 * p_s0 END", "s0": "p_s1"})
_smooth3 = Steps(z="pi() / 10").add(a="exp(-z)").add(b="2 * a * cos(sqrt(3) * z)", a1="a * a").add(d0="a1 + b", d2="-a1 * (1 + b)", d3="a1 * a1").walk(
    {"s1": "close", "s0": "NULL::DOUBLE", "s2": "NULL::DOUBLE"}, {"s1": "CASE WHEN rn <= 3 THEN close ELSE (1 - d0 - d2 - d3) * close + d0 * p_s1 + d2 * p_s0 + d3 * p_s2 END", "s0": "p_s1", "s2": "p_s0"}
)
_vidya = Steps(g="coalesce(greatest(close - pc, 0), 0)", s="coalesce(greatest(pc - close, 0), 0)").add(k="coalesce(abs(sum(g) OVER w5 - sum(s) OVER w5) / nullif(sum(g) OVER w5 + sum(s) OVER w5, 0), 0) / 3")
_vidya.walk({"v": "0::DOUBLE"}, {"v": "CASE WHEN rn <= 5 THEN 0 ELSE k * close + p_v * (1 - k) END"})
_adx = Steps(nh="lead(high) OVER w", nl="lead(low) OVER w").add(up="nh - high", dn="low - nl", rg="coalesce(greatest(nh, close) - least(nl, close), 0)")
_adx.add(pm="CASE WHEN up > dn AND up > 0 THEN up ELSE 0 END", mm="CASE WHEN dn > up AND dn > 0 THEN dn ELSE 0 END").add(er=fin("rg", 5), ep=fin("pm", 5), em=fin("mm", 5))
_adx.add(pv="ep / nullif(er, 0)", mv="em / nullif(er, 0)").add(dx0="CASE WHEN rn < cnt THEN abs(pv - mv) / nullif(pv + mv, 0) END").add(dx="CASE WHEN rn = cnt THEN 0 ELSE coalesce(last_value(dx0 IGNORE NULLS) OVER u, 0) END").add(adx=fin("dx", 5))
_hwc_row = {"m": "nf + nv + 0.5 * na"}
_hwc = Steps().walk(
    {"f": "close", "v": "0::DOUBLE", "a": "0::DOUBLE", "vr": "0::DOUBLE", "pr": "close", "rs": "close", "mid": "close", "sd": "0::DOUBLE"},
    {"nf": "0.8 * (p_f + p_v + 0.5 * p_a) + 0.2 * close"}, {"nv": "0.9 * (p_v + p_a) + 0.1 * (nf - p_f)"}, {"na": "0.9 * p_a + 0.1 * (nv - p_v)"}, _hwc_row,
    {"f": "nf", "v": "nv", "a": "na", "vr": "0.9 * p_vr + 0.1 * power(p_pr - p_rs, 2)", "pr": "close", "rs": "m", "mid": "m", "sd": "sqrt(p_vr)"},
)
_ashi = Steps(hc="(open + high + low + close) / 4").add(phc="lag(hc) OVER w").walk({"ho": "(open + close) / 2"}, {"ho": "(p_ho + phc) / 2"})
_trix = Steps(e1=fin("close", 5)).add(e2=fin("e1", 5)).add(e3=fin("e2", 5))
_t3 = Steps(e1=plain("close", 5))
for _i in range(2, 7):
    _t3.add(**{f"e{_i}": plain(f"e{_i - 1}", 5)})
_kroll = Steps(atr=fin("tr", 3)).add(top="CASE WHEN rn >= 3 THEN max(high) OVER w3 END - 3 * atr", low_="CASE WHEN rn >= 3 THEN min(low) OVER w3 END + 3 * atr")
_qqe = _rsi("monetary", 5).add(r0=f"CASE WHEN cnt > 8 THEN {fin('rsi', 3, 5)} ELSE 0 END").add(ad="abs(r0 - lag(r0) OVER w)").add(d1=fin("ad", 9, 2)).add(d2=fin("d1", 9)).add(band="4.236 * d2", pr="lag(r0) OVER w")
_qqe.walk(
    {"lo": "0::DOUBLE", "lo0": "0::DOUBLE", "sh": "0::DOUBLE", "sh0": "0::DOUBLE", "up_": "true", "line": "r0"},
    {"nl": "CASE WHEN rn <= 2 THEN 0 WHEN pr > p_lo AND r0 > p_lo THEN greatest(p_lo, r0 - band) ELSE r0 - band END", "ns": "CASE WHEN rn <= 2 THEN 0 WHEN pr < p_sh AND r0 < p_sh THEN least(p_sh, r0 + band) ELSE r0 + band END"},
    {"nu": "CASE WHEN rn <= 2 THEN true WHEN (r0 > p_sh AND pr < p_sh0) OR (r0 <= p_sh AND pr >= p_sh0) THEN true WHEN (r0 > p_lo AND pr < p_lo0) OR (r0 <= p_lo AND pr >= p_lo0) THEN false ELSE p_up_ END"},
    {"lo": "nl", "lo0": "p_lo", "sh": "ns", "sh0": "p_sh", "up_": "nu", "line": "CASE WHEN rn <= 2 THEN p_line WHEN nu THEN nl ELSE ns END"},
)
_high = Steps(t="2 * pi() / 20").add(a="(cos(t) + sin(t) - 1) / cos(t)").walk({"f": "0::DOUBLE"}, {"f": "(close - pc) * (1 + a / 2) + p_f * (1 - a)"})
_band = Steps(t="2 * pi() / 20").add(g="1 / cos(0.3 * t)", b="cos(t)", x2="lag(close, 2) OVER w").add(a="g - sqrt(g * g - 1)").walk({"f1": "0::DOUBLE", "f0": "0::DOUBLE"}, {"f1": "CASE WHEN rn <= 2 THEN 0 ELSE (close - x2) * 0.5 * (1 - a) + p_f1 * b * (1 + a) - p_f0 * a END", "f0": "p_f1"})
_hwexp = Steps(nx="lead(close) OVER w").walk({"tf": "coalesce(nx - close, 0)", "out": "close"}, {"tf": "0.3 * (close - pc) + 0.7 * p_tf", "out": "0.5 * close + 0.5 * (pc + p_tf)"})
_mass = Steps(hl=nz("high", "low")).add(e1=plain("hl", 3)).add(e2=plain("e1", 3))
_rsx = Steps(mo="CASE WHEN rn > 6 THEN 100 * (close - pc) ELSE 0 END", am="CASE WHEN rn > 6 THEN abs(100 * (close - pc)) ELSE 0 END")
for _c in ("mo", "am"):
    for _i in range(3):
        _in = _c if not _i else f"{_c}{_i}v"
        _rsx.add(**{f"{_c}{_i}p": zero_mean(_in, 3 / 7)}).add(**{f"{_c}{_i}q": zero_mean(f"{_c}{_i}p", 3 / 7)}).add(**{f"{_c}{_i + 1}v": f"1.5 * {_c}{_i}p - 0.5 * {_c}{_i}q"})
_zl = Steps(z="2 * close - lag(close, 2) OVER w")
_dmove = Steps(ef="(close - pc) * volume", th="greatest(abs(low - pl), abs(high - ph))")
_all_rows = f"(list(close) OVER ({W_SQL} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"

for _name, _kernel, _columns, _output, _options, _steps, _x in (
    ("ewm_mean", Q.ewm_mean, ["close"], "ewm", {"value": 5.0}, Steps(), plain("close", 5)), ("ewm_finite", Q.ewm_mean, ["close"], "ewm", {"value": 5.0, "finite": True}, Steps(), fin("close", 5)),
    ("ewm_var", Q.ewm_var, ["close"], "var", {"value": 5.0}, _moments, _unbiased.format("cxx")), ("ewm_std", Q.ewm_var, ["close"], "std", {"value": 5.0}, _moments, f"sqrt({_unbiased.format('cxx')})"),
    ("ewm_cov", Q.ewm_cov, ["close", "high"], "cov", {"value": 5.0}, _moments, _unbiased.format("cxy")), ("ewm_corr", Q.ewm_cov, ["close", "high"], "corr", {"value": 5.0}, _moments, "CASE WHEN rn > 1 AND cxx > 1e-9 AND cyy > 1e-9 THEN cxy / sqrt(cxx * cyy) END"),
    ("zero_lag_mean", Q.zero_lag_mean, ["close"], "zlmm", {"n": 5}, _zl, fin("z", 5, 3, True)),
    ("macd", I.macd, ["close"], "macd", {"short": 3, "long": 6, "signal": 3}, Steps(), f"{plain('close', 3)} - {plain('close', 6)}"),
    ("macd_signal", I.macd, ["close"], "signal", {"short": 3, "long": 6, "signal": 3}, Steps(m=f"{plain('close', 3)} - {plain('close', 6)}"), plain("m", 3)),
    ("macd_histogram", I.macd, ["close"], "histogram", {"short": 3, "long": 6, "signal": 3}, Steps(m=f"{plain('close', 3)} - {plain('close', 6)}"), f"m - {plain('m', 3)}"),
    ("rsi", I.rsi, ["close"], "rsi", {"n": 5}, _rsi("percentage", 5), "rsi"), ("rsx", I.rsx, ["close"], "rsx", {"n": 5}, _rsx, "CASE WHEN rn = 5 THEN 0 WHEN rn > 10 THEN CASE WHEN am3v > 2.3e-16 THEN least(100, greatest(0, 50 * (mo3v / am3v + 1))) ELSE 50 END WHEN rn > 5 THEN 50 END"),
    ("relative_volatility", I.relative_volatility, ["close", "high", "low"], "rvi", {"n": 5}, _volatility(5), "rvi"),
    ("inertia", I.inertia, ["close", "high", "low"], "inertia", {"n": 5, "rvi": 4}, _volatility(4), f"CASE WHEN count(rvi) OVER {_BEFORE5} = 5 THEN avg(rvi) OVER {_BEFORE5} + regr_slope(rvi, rn) OVER {_BEFORE5} END"),
    ("mass_index", I.mass_index, ["low", "high"], "mass_index", {"fast": 3, "slow": 5}, _mass, "CASE WHEN rn >= 5 THEN sum(e1 / e2) OVER w5 END"),
    ("hull_mean", I.hull_mean, ["close"], "hull", {"n": 6}, _hull, "CASE WHEN rn >= 2 THEN CASE WHEN raw IS NULL THEN praw WHEN praw IS NULL THEN raw ELSE (praw + 2 * raw) / 3 END END"),
    ("kama", I.kama, ["close"], "kama", {"n": 5}, _kama, "out"), ("fisher_transform", I.fisher_transform, ["low", "high"], "fisher", {"n": 5}, _fisher, "f"),
    ("percent_price", I.percent_price, ["close"], "ppo", {"fast": 3, "slow": 6, "signal": 3}, _ppo, "ppo"), ("percent_price_histogram", I.percent_price, ["close"], "histogram", {"fast": 3, "slow": 6, "signal": 3}, _ppo, "CASE WHEN rn > 6 THEN ppo - ahead END"),
    ("parabolic_sar", I.parabolic_sar, ["low", "high", "close"], "sar", {}, _sar, "sar"), ("parabolic_long", I.parabolic_sar, ["low", "high", "close"], "long", {}, _sar, "CASE WHEN rn > 2 AND bull THEN sar END"),
    ("parabolic_short", I.parabolic_sar, ["low", "high", "close"], "short", {}, _sar, "CASE WHEN rn > 2 AND NOT bull THEN sar END"),
    ("even_better_sine", I.even_better_sine, ["close"], "sine", {}, _sine, "out"), ("super_smoother", I.super_smoother, ["close"], "smooth", {}, _smooth, "s1"), ("super_smoother_3", I.super_smoother, ["close"], "smooth", {"poles": 3}, _smooth3, "s1"),
    ("variable_index_average", I.variable_index_average, ["close"], "vidya", {"n": 5}, _vidya, "CASE WHEN rn > 5 THEN v END"), ("average_directional", I.average_directional, ["low", "high", "close"], "adx", {"n": 5}, _adx, "adx"),
    ("holt_winter_channel", I.holt_winter_channel, ["close"], "middle", {}, _hwc, "mid"), ("holt_winter_upper", I.holt_winter_channel, ["close"], "upper", {}, _hwc, "mid + sd"), ("heikin_ashi", I.heikin_ashi, ["low", "high", "open", "close"], "open", {}, _ashi, "ho"),
    ("heikin_ashi_high", I.heikin_ashi, ["low", "high", "open", "close"], "high", {}, _ashi, "CASE WHEN rn = 1 THEN high ELSE greatest(ho, high, hc) END"), ("keltner", I.keltner, ["low", "high", "close"], "upper", {"n": 5}, Steps(m=fin("close", 5), z=fin("tr", 5)), "m + 2 * z"),
    ("keltner_lower", I.keltner, ["low", "high", "close"], "lower", {"n": 5}, Steps(m=fin("close", 5), z=fin("tr", 5)), "m - 2 * z"), ("trix", I.trix, ["close"], "trix", {"n": 5}, _trix, "e3 / lag(e3) OVER w - 1"),
    ("pretty_good", I.pretty_good, ["low", "high", "close"], "pgo", {"n": 5}, Steps(a=fin("tr", 5)).add(e=fin("a", 5)), "CASE WHEN rn >= 5 THEN (close - avg(close) OVER w5) / e END"),
    ("t3", I.t3, ["close"], "t3", {"n": 5}, _t3, f"{-(0.7**3)!r} * e6 + {3 * (0.49 + 0.343)!r} * e5 + {-(6 * 0.49 + 2.1 + 3 * 0.343)!r} * e4 + {1 + 2.1 + 0.343 + 3 * 0.49!r} * e3"),
    ("elder_ray", I.elder_ray, ["close", "high", "low"], "bulls", {"n": 5}, Steps(), f"high - {fin('close', 5)}"), ("elder_ray_bears", I.elder_ray, ["close", "high", "low"], "bears", {"n": 5}, Steps(), f"low - {fin('close', 5)}"),
    ("elder_force", I.elder_force, ["close", "volume"], "efi", {"n": 5}, _dmove, fin("ef", 5, 2)), ("elder_thermometer", I.elder_thermometer, ["low", "high"], "mean", {"n": 5}, _dmove, fin("th", 5, 2)),
    ("chande_kroll", I.chande_kroll, ["low", "high", "close"], "long_stop", {"p": 3, "q": 5}, _kroll, "CASE WHEN rn >= 5 THEN max(top) OVER w5 END"), ("chande_kroll_short", I.chande_kroll, ["low", "high", "close"], "short_stop", {"p": 3, "q": 5}, _kroll, "CASE WHEN rn >= 5 THEN min(low_) OVER w5 END"),
    ("quantitative_qualitative", I.quantitative_qualitative, ["close"], "rsi_ma", {"n": 5, "smooth": 3}, _qqe, "r0"), ("quantitative_line", I.quantitative_qualitative, ["close"], "qqe", {"n": 5, "smooth": 3}, _qqe, "line"),
    ("high_pass", I.high_pass, ["close"], "filtered", {}, _high, "close - f"), ("band_pass", I.band_pass, ["close"], "filtered", {}, _band, "close - f1"), ("trend_smoother", I.trend_smoother, ["close"], "smooth", {}, _hwexp, "out"),
    ("average_true_range", I.average_true_range, ["low", "high", "close"], "atr", {"n": 5}, Steps(), fin("tr", 5)), ("expanding", Q.expanding, ["close"], "expanding", {}, Steps(), f"CASE WHEN rn >= 3 AND 2 * rn - 3 <= cnt THEN list_avg({_all_rows}[rn - 2:2 * rn - 3]) END"),
):
    _kernel_query(_name, _kernel, _columns, _output, _steps.sql(_x), **_options)
