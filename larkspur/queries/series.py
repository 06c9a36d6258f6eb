"""Kernels on whole series that give spectra, tests, forecasts, anomalies and distances."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from larkspur.functions import sequential as Q
from larkspur.plans import by_series, ordered, summarised
from larkspur.queries.registry import BARS, FIXED, bars, fixed, query

_ORDER = "PARTITION BY user_id ORDER BY day"
#: b: the bars with their number rn of cnt; f: the pairs of a row and a frequency k.
B = f"{BARS}, b AS (SELECT *, row_number() OVER ({_ORDER}) AS rn, count(*) OVER (PARTITION BY user_id) AS cnt FROM bars)"
DFT = f"{B}, f AS (SELECT user_id, k, any_value(cnt) AS cnt, sum(close * cos(2 * pi() * k * (rn - 1) / cnt)) AS re, -sum(close * sin(2 * pi() * k * (rn - 1) / cnt)) AS im FROM (SELECT user_id, rn, cnt, close, unnest(range(cnt)) AS k FROM b) GROUP BY 1, 2)"


def _of_users(name, kernel, columns, outputs, sql, picks=None, least=0, **options):
    """One row a user: ``outputs`` of the kernel; users with fewer than ``least`` bars have nulls."""
    def make(t):
        run = lambda *a: kernel(*a, **options) if len(a[0]) >= least else {n: float("nan") for n in outputs}
        out = summarised(bars(t), lambda *a: {n: float(v) for n, v in run(*a).items() if n in outputs}, columns, {n: "double" for n in outputs}, ["day"], ["user_id"])
        return out.select("user_id", *[fixed(n, (picks or {}).get(n, 5)).alias(n) for n in outputs])

    query(name, sql)(make)


def _of_rows(name, kernel, columns, output, sql, digits=5, heavy=False, **options):
    def make(t):
        out = by_series(bars(t), lambda *a: {"k_out": kernel(*a, **options)[output]}, columns, {"k_out": "double"}, ["day"], ["user_id"], heavy)
        return out.select("user_id", "day", fixed("k_out", digits).alias("x"))

    query(name, sql)(make)


# Correlations within a series

_of_users("partial_autocorrelation", lambda x: {"first": Q.partial_autocorrelation(x, 2)["pacf"][1]}, ["close"], ["first"], f"WITH {B} SELECT user_id, CASE WHEN count(*) >= 4 THEN {FIXED('sum(close * nx) / sum(CASE WHEN nx IS NOT NULL THEN close * close END)', 5)} END AS first FROM (SELECT *, lead(close) OVER ({_ORDER}) AS nx FROM b) GROUP BY 1", least=4)
_of_users("partial_autocorrelation_second", lambda x: {"second": Q.partial_autocorrelation(x, 3)["pacf"][2]}, ["close"], ["second"], f"""WITH {B}, p AS (SELECT user_id, cnt, close AS a, lead(close) OVER ({_ORDER}) AS c, lead(close, 2) OVER ({_ORDER}) AS y FROM b),
    s AS (SELECT user_id, any_value(cnt) AS cnt, sum(a * a) AS aa, sum(a * c) AS ac, sum(c * c) AS cc, sum(a * y) AS ay, sum(c * y) AS cy FROM p WHERE y IS NOT NULL GROUP BY 1) SELECT user_id, CASE WHEN cnt >= 5 THEN {FIXED('(aa * cy - ac * ay) / (aa * cc - ac * ac)', 4)} END AS second FROM (SELECT DISTINCT user_id FROM b) LEFT JOIN s USING (user_id)""", {"second": 4}, least=5)  # fmt: skip
_of_rows("fixed_autocorrelation", Q.fixed_autocorrelation, ["close"], "facf", f"""WITH {B}, i AS (SELECT user_id, day, rn, cnt, least(4, cnt - rn + 1 - 4) AS size FROM b), c AS (SELECT i.user_id, i.rn, corr(x.close, y.close) AS c, var_pop(x.close) AS vx, var_pop(y.close) AS vy FROM i JOIN b x ON x.user_id = i.user_id AND x.rn >= i.rn + 4 - size AND x.rn < i.rn + 4
    JOIN b y ON y.user_id = i.user_id AND y.rn = x.rn + size WHERE i.size > 1 GROUP BY 1, 2) SELECT i.user_id, i.day, CASE WHEN vx > 0 AND vy > 0 THEN {FIXED('c', 4)} END AS x FROM i LEFT JOIN c USING (user_id, rn)""", 4, lag=4)  # fmt: skip

# Spectra


def _spectrum(t):
    out = by_series(bars(t), Q.fft, ["close"], {"real": "double", "imag": "double", "magnitude": "double", "angle": "double"}, ["day"], ["user_id"])
    return out.select("user_id", "day", fixed("real", 4).alias("re"), fixed("magnitude", 4).alias("magnitude"))


query("fft", f"WITH {DFT} SELECT b.user_id, b.day, {FIXED('re', 4)} AS re, {FIXED('sqrt(re * re + im * im)', 4)} AS magnitude FROM b JOIN f ON f.user_id = b.user_id AND f.k = b.rn - 1")(_spectrum)

_KEPT = f"{DFT}, v AS (SELECT b.user_id, b.day, b.close, sum(re * cos(2 * pi() * k * (rn - 1) / b.cnt) - im * sin(2 * pi() * k * (rn - 1) / b.cnt)) / any_value(b.cnt) AS v FROM b JOIN f ON f.user_id = b.user_id AND f.k < 4 GROUP BY 1, 2, 3)"
_of_rows("fft_outliers", lambda x: {"k": Q.fft_outliers(x, 4, 150.0)["outlier"].astype(float)}, ["close"], "k", f"WITH {_KEPT} SELECT user_id, day, (abs(close - v) > 150)::INT::DOUBLE AS x FROM v")
_of_users("seasonal_period", lambda x: Q.seasonal_period(x, False), ["close"], ["period", "magnitude", "index"], f"""WITH {DFT}, m AS (SELECT *, sqrt(re * re + im * im) AS m FROM f WHERE k >= 1 AND k <= cnt // 2), p AS (SELECT user_id, any_value(cnt) AS cnt, max(m) AS magnitude, arg_max(k, m) AS k FROM m GROUP BY 1)
    SELECT user_id, CASE WHEN cnt >= 4 THEN {FIXED('cnt / k', 5)} END AS period, CASE WHEN cnt >= 4 THEN {FIXED('magnitude', 4)} END AS magnitude, CASE WHEN cnt >= 4 THEN k::DOUBLE END AS index FROM (SELECT DISTINCT user_id FROM b) LEFT JOIN p USING (user_id)""", {"magnitude": 4}, least=4)  # fmt: skip

# Tests

_FIT = f"{B}, e AS (SELECT user_id, rn, cnt, close - (regr_intercept(close, rn) OVER p + regr_slope(close, rn) OVER p * rn) AS e, close FROM b WINDOW p AS (PARTITION BY user_id)), s AS (SELECT *, sum(e) OVER (PARTITION BY user_id ORDER BY rn) AS c FROM e)"
_of_users("kpss", Q.kpss, ["close"], ["statistic", "level"], f"""WITH {_FIT}, k AS (SELECT user_id, any_value(cnt) AS cnt, sum(c * c) / (count(*) * count(*) * var_pop(e)) AS s FROM s GROUP BY 1)
    SELECT user_id, CASE WHEN cnt >= 5 THEN {FIXED('s', 5)} END AS statistic, CASE WHEN cnt >= 5 THEN CASE WHEN s < 0.347 THEN 0.1 WHEN s < 0.463 THEN 0.05 WHEN s < 0.574 THEN 0.025 WHEN s < 0.739 THEN 0.01 ELSE 0 END END::DOUBLE AS level FROM k""", least=5)  # fmt: skip
for _trend, _x in ((False, "close"), (True, "e")):
    _of_users("dickey_fuller_trend" if _trend else "dickey_fuller", Q.augmented_dickey_fuller, ["close"], ["statistic"], f"""WITH {_FIT}, d AS (SELECT *, {_x} - avg({_x}) OVER (PARTITION BY user_id) AS d FROM s), l AS (SELECT *, lag(d) OVER (PARTITION BY user_id ORDER BY rn) AS l FROM d)
        SELECT user_id, CASE WHEN count(*) >= 5 THEN {FIXED('sum(d * l) / (count(*) - 2) / var_pop(' + _x + ')', 5)} END AS statistic FROM l GROUP BY 1""", least=5, trend=_trend)  # fmt: skip

_ERF = "sign({z}) * exp(-{z} * {z}) * list_sum(list_transform(range(0, 120), lambda k: exp((2 * k + 1) * ln(greatest(abs({z}), 1e-300)) - lgamma(k + 1.5))))"
_CDF = f"c AS (SELECT c_nationkey, x, row_number() OVER (PARTITION BY c_nationkey ORDER BY x) AS i, count(*) OVER (PARTITION BY c_nationkey) AS n, 0.5 * (1 + {_ERF.format(z='z')}) AS f FROM (SELECT c_nationkey, c_acctbal AS x, (c_acctbal - avg(c_acctbal) OVER p) / stddev_samp(c_acctbal) OVER p / sqrt(2) AS z FROM customer WINDOW p AS (PARTITION BY c_nationkey)))"


def _of_nations(name, kernel, outputs, sql, least):
    def make(t):
        run = lambda x: {n: float(v) for n, v in kernel(x).items()} if len(x) >= least else {n: float("nan") for n in outputs}
        out = summarised(t("customer"), run, ["c_acctbal"], {n: "double" for n in outputs}, ["c_acctbal", "c_custkey"], ["c_nationkey"])
        return out.select("c_nationkey", *[fixed(n, 5).alias(n) for n in outputs])

    query(name, sql)(make)


_of_nations("anderson_darling", Q.anderson_darling, ["statistic", "p_value"], f"""WITH {_CDF}, a AS (SELECT c_nationkey, any_value(a.n) AS n, (-any_value(a.n) - sum((2 * a.i - 1) * (ln(a.f) + ln(1 - b.f))) / any_value(a.n)) * (1 + 4.0 / any_value(a.n) - 25.0 / power(any_value(a.n), 2)) AS s FROM c a JOIN c b USING (c_nationkey) WHERE b.i = a.n + 1 - a.i GROUP BY 1)
    SELECT c_nationkey, CASE WHEN n >= 20 THEN {FIXED('s', 5)} END AS statistic, CASE WHEN n >= 20 THEN {FIXED('CASE WHEN s < 0.2 THEN 1 - exp(-13.436 + 101.14 * s - 223.73 * s * s) WHEN s < 0.34 THEN 1 - exp(-8.318 + 42.796 * s - 59.938 * s * s) WHEN s < 0.6 THEN exp(0.9177 - 4.279 * s - 1.38 * s * s) ELSE exp(1.2937 - 5.709 * s + 0.0186 * s * s) END', 5)} END AS p_value FROM a""", 20)  # fmt: skip
_LEVELS = " ".join(f"WHEN s < {b} THEN {p}" for b, p in Q.CVM_LEVELS)
_of_nations("cramer_von_mises", Q.cramer_von_mises, ["statistic", "p_value"], f"WITH {_CDF}, a AS (SELECT c_nationkey, any_value(n) AS n, sum(power((2 * i - 1) / (2.0 * n) - f, 2)) + 1 / (12.0 * any_value(n)) AS s FROM c GROUP BY 1) SELECT c_nationkey, CASE WHEN n >= 3 THEN {FIXED('s', 5)} END AS statistic, CASE WHEN n >= 3 THEN {FIXED(f'CASE {_LEVELS} ELSE 2.220446049250313e-16 END', 5)} END AS p_value FROM a", 3)
_of_nations("shapiro_wilk", Q.shapiro_wilk, ["statistic", "p_value"], None, 4)

_of_users("hurst", Q.hurst, ["close"], ["hurst"], f"""WITH {B}, p AS (SELECT *, cnt // g AS n, (rn - 1) // greatest(cnt // g, 1) AS part FROM b, (VALUES (1), (2), (4)) v(g)), d AS (SELECT *, sum(close - m) OVER (PARTITION BY user_id, g, part ORDER BY rn) AS c FROM (SELECT *, avg(close) OVER (PARTITION BY user_id, g, part) AS m FROM p WHERE part < g)),
    r AS (SELECT user_id, g, any_value(n) AS n, part, (greatest(max(c), 0) - min(c)) / stddev_samp(close) AS rs FROM d GROUP BY user_id, g, part), l AS (SELECT user_id, g, ln(any_value(n)) AS x, ln(avg(rs)) AS y FROM r GROUP BY 1, 2)
    SELECT user_id, CASE WHEN any_value(cnt) >= 8 THEN {FIXED('any_value(h)', 4)} END AS hurst FROM b LEFT JOIN (SELECT user_id, regr_slope(y, x) AS h FROM l GROUP BY 1) USING (user_id) GROUP BY 1""", {"hurst": 4}, least=8)  # fmt: skip
_ALL = f"list(close) OVER ({_ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"


def _best_run(smallest: bool) -> str:
    pick = "arg_min" if smallest else "arg_max"
    return f"""WITH {B}, c AS (SELECT user_id, rn, close - 200 AS x FROM b), r AS (SELECT i.user_id, i.rn AS a, j.rn AS z, sum(c.x) AS s FROM c i JOIN c j ON j.user_id = i.user_id AND j.rn >= i.rn JOIN c ON c.user_id = i.user_id AND c.rn BETWEEN i.rn AND j.rn GROUP BY 1, 2, 3)
        SELECT user_id, {FIXED(('min' if smallest else 'max') + '(s)', 4)} AS sum FROM r GROUP BY 1""".replace("{pick}", pick)


for _smallest in (False, True):
    _of_users("min_sub_array" if _smallest else "max_sub_array", lambda x, s=_smallest: {"sum": Q.max_sub_array(x - 200, smallest=s)["sum"]}, ["close"], ["sum"], _best_run(_smallest), {"sum": 4})
_of_users("second_best_sub_array", lambda x: {"sum": ([*Q.n_max_sub_arrays(x - 200, 2)["sums"], float("nan"), float("nan")])[1]}, ["close"], ["sum"], None, {"sum": 4})

# Forecasts

_HOLT = f"""WITH RECURSIVE {B}, d AS (SELECT user_id, avg(nx - close) AS t FROM (SELECT *, lead(close) OVER ({_ORDER}) AS nx FROM b) WHERE rn <= 10 GROUP BY 1), h AS (SELECT b.user_id, rn, cnt, close AS l, t, close AS fit FROM b JOIN d USING (user_id) WHERE rn = 1
    UNION ALL SELECT x.user_id, x.rn, x.cnt, 0.25 * x.close + 0.75 * (p.l + p.t), 0.1 * (0.25 * x.close + 0.75 * (p.l + p.t) - p.l) + 0.9 * p.t, p.l + p.t FROM h p JOIN b x ON x.user_id = p.user_id AND x.rn = p.rn + 1)"""
_of_users("holt_winters", lambda x: dict(zip(("first", "third"), Q.holt_winters(x, 3)["forecast"][::2])), ["close"], ["first", "third"], f"{_HOLT} SELECT user_id, CASE WHEN cnt >= 5 THEN {FIXED('l + t', 5)} END AS first, CASE WHEN cnt >= 5 THEN {FIXED('l + 3 * t', 5)} END AS third FROM h WHERE rn = cnt", least=5)
_of_rows("holt_winters_fitted", lambda x: {"f": Q.holt_winters(x, 3)["fitted"] if len(x) > 1 else [math.nan] * len(x)}, ["close"], "f", f"{_HOLT} SELECT b.user_id, b.day, CASE WHEN b.cnt > 1 THEN {FIXED('fit', 9)} END AS x FROM b JOIN h USING (user_id, rn)", 9)
_of_users("holt_winters_seasonal", lambda x: {"first": Q.holt_winters(x, 3, 4)["forecast"][0]}, ["close"], ["first"], None, least=12)
_of_users("arima", lambda x: {"first": Q.arima(x, 3)["forecast"][0]}, ["close"], ["first"], None, least=16)


@query("lstm")
def _lstm(t):
    def run(series):
        found = iter(Q.lstm_many([x for x in series if len(x) >= 12], 1, 4, 5, 3))
        return [{"first": next(found)["forecast"][0] if len(x) >= 12 else math.nan} for x in series]

    out = summarised(bars(t), run, ["close"], {"first": "double"}, ["day"], ["user_id"], many=True)
    return out.select("user_id", fixed("first", 3).alias("first"))


# Smoothing and decomposition: these follow the published methods

_of_rows("lowess", lambda y: Q.lowess(y, list(range(len(y)))), ["close"], "lowess", None)
_of_rows("decompose", lambda y: Q.decompose(y, 4, 0.6) if len(y) >= 8 else {"trend": [math.nan] * len(y)}, ["close"], "trend", None)
_of_rows("cubic_spline", lambda y: Q.cubic_spline(list(range(len(y))), y) if len(y) > 3 else {"c": [math.nan] * len(y)}, ["close"], "c", None)

# Distances and anomalies

_of_users("dynamic_time_warp", Q.dynamic_time_warp, ["open", "close"], ["distance"], f"""WITH RECURSIVE {B}, o AS (SELECT user_id, list(close ORDER BY rn) AS ys FROM b GROUP BY 1), d AS (SELECT b.user_id, 0::BIGINT AS rn, any_value(cnt) AS cnt, list_concat([0::DOUBLE], list_transform(any_value(ys), lambda y: 'inf'::DOUBLE)) AS w FROM b JOIN o USING (user_id) GROUP BY 1
    UNION ALL SELECT p.user_id, p.rn + 1, p.cnt, list_reduce(list_transform(range(1, p.cnt + 1), lambda j: [abs(x.open - ys[j]), least(p.w[j], p.w[j + 1])]), lambda a, c: list_append(a, c[1] + least(a[-1], c[2])), ['inf'::DOUBLE]) FROM d p JOIN b x ON x.user_id = p.user_id AND x.rn = p.rn + 1 JOIN o ON o.user_id = p.user_id)
    SELECT user_id, {FIXED('w[-1]', 4)} AS distance FROM d WHERE rn = cnt""", {"distance": 4})  # fmt: skip
_NEAR = f"{B}, n AS (SELECT a.user_id, a.rn AS i, c.rn AS j, abs(a.close - c.close) AS d, row_number() OVER (PARTITION BY a.user_id, a.rn ORDER BY abs(a.close - c.close), c.rn) - 1 AS k FROM b a JOIN b c ON c.user_id = a.user_id)"
_of_rows("local_outliers", lambda x: Q.local_outliers(x, 3), ["close"], "score", f"""WITH {_NEAR}, r AS (SELECT n.user_id, n.i, n.j, greatest(n.d, abs(a.close - c.close)) AS reach FROM n JOIN b a ON a.user_id = n.user_id AND a.rn = n.k JOIN b c ON c.user_id = n.user_id AND c.rn = n.i WHERE n.k BETWEEN 1 AND 3),
    l AS (SELECT user_id, i, 3 / greatest(sum(reach), 1e-300) AS l FROM r GROUP BY 1, 2), s AS (SELECT r.user_id, r.i, avg(m.l) / any_value(o.l) AS s FROM r JOIN l m ON m.user_id = r.user_id AND m.i = r.j JOIN l o ON o.user_id = r.user_id AND o.i = r.i GROUP BY 1, 2)
    SELECT b.user_id, b.day, {FIXED('CASE WHEN cnt > 4 THEN s ELSE 1 END', 4)} AS x FROM b LEFT JOIN s ON s.user_id = b.user_id AND s.i = b.rn""", 4)  # fmt: skip
_of_rows("knn_outliers", lambda x: Q.knn_outliers(x, 3, 2), ["close"], "score", f"""WITH {B}, p AS (SELECT user_id, rn AS i, cnt, close AS a, lead(close) OVER ({_ORDER}) AS c, lead(close, 2) OVER ({_ORDER}) AS e FROM b QUALIFY e IS NOT NULL), d AS (SELECT x.user_id, x.i, sqrt(power(x.a - y.a, 2) + power(x.c - y.c, 2) + power(x.e - y.e, 2)) AS d FROM p x JOIN p y ON y.user_id = x.user_id),
    s AS (SELECT user_id, i, list_sum(list_sort(list(d))[1:3]) / 2 AS s FROM d GROUP BY 1, 2) SELECT b.user_id, b.day, CASE WHEN any_value(cnt) >= 5 THEN {FIXED('avg(s)', 4)} END AS x FROM b LEFT JOIN s ON s.user_id = b.user_id AND s.i BETWEEN b.rn - 2 AND b.rn GROUP BY 1, 2""", 4)  # fmt: skip
_of_rows("isolation_outliers", Q.isolation_outliers, ["close"], "score", None, heavy=True)


@query("kendall", f"""SELECT c_nationkey, {FIXED("sum(CASE WHEN (CASE WHEN a.c_acctbal < b.c_acctbal THEN -1 ELSE 1 END) * (CASE WHEN a.k < b.k THEN -1 ELSE 1 END) < 0 THEN -1 ELSE 1 END) / count(*)", 6)} AS kendall FROM (SELECT *, c_custkey % 11 AS k FROM customer) a JOIN (SELECT *, c_custkey % 11 AS k FROM customer) b USING (c_nationkey) WHERE a.c_custkey < b.c_custkey GROUP BY 1""")
def _kendall(t):
    c = t("customer").withColumn("k", (F.col("c_custkey") % 11).cast("double"))
    out = summarised(c, lambda x, y: Q.kendall(x, y) if len(x) > 1 else {"kendall": math.nan}, ["c_acctbal", "k"], {"kendall": "double"}, "c_custkey", ["c_nationkey"])
    return out.where("NOT isnan(kendall)").select("c_nationkey", fixed("kendall").alias("kendall"))


@query("lagrange_fill", f"""WITH {B}, g AS (SELECT user_id, day, rn, CASE WHEN rn % 3 = 2 THEN NULL ELSE close END AS x FROM b WHERE rn <= 6), w AS (SELECT g.user_id, g.rn, k.rn AS j, any_value(k.x) * product((g.rn - m.rn) / (k.rn - m.rn)) AS t FROM g JOIN g k ON k.user_id = g.user_id AND k.x IS NOT NULL JOIN g m ON m.user_id = g.user_id AND m.x IS NOT NULL AND m.rn <> k.rn WHERE g.x IS NULL GROUP BY 1, 2, 3)
    SELECT g.user_id, g.day, {FIXED('coalesce(g.x, s)', 3)} AS x FROM g LEFT JOIN (SELECT user_id, rn, sum(t) AS s FROM w GROUP BY 1, 2) w ON w.user_id = g.user_id AND w.rn = g.rn""")
def _lagrange(t):
    b = bars(t).withColumn("rn", F.row_number().over(ordered(["day"], ["user_id"])).cast("double")).where("rn <= 6")
    b = b.withColumn("g", F.when(F.col("rn") % 3 != 2, F.col("close")))
    run = lambda x, i: {"k_out": Q.lagrange_fill(x, i)["filled"] if (x == x).sum() > 1 else x}
    return by_series(b, run, ["g", "rn"], {"k_out": "double"}, ["day"], ["user_id"]).select("user_id", "day", fixed("k_out", 3).alias("x"))
