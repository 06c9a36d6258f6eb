"""Aggregates, order statistics, scaling, tests, fits, cumulative and rolling values, and the calendar."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.functions import aggregates as A, scalars as S, windows as W
from larkspur.operators import frame as O
from larkspur.plans import blocked, with_positions
from larkspur.queries.registry import AT, BY, FIXED, SERIES, fixed, query, r, rows

LINES = ["l_orderkey", "l_linenumber"]
QUANTILE = "(SELECT CASE WHEN n % 2 = 0 OR k < n * {q} THEN {pair} ELSE v[k] END FROM (SELECT v, n, greatest(1, least(n, floor(n * {q} + 0.5)::BIGINT)) AS k FROM (SELECT list({x} ORDER BY {x}) AS v, count({x}) AS n FROM {t})))"
MIDDLE = "(v[k] + v[least(n, k + 1)]) / 2"

# Aggregates


@query("moments", "SELECT l_returnflag, round(exp(avg(ln(l_quantity))), 6) AS geometric, round(count(*) / sum(1 / l_quantity), 6) AS harmonic, round(sqrt(sum(l_quantity * l_quantity) / count(*)), 6) AS quadratic, round(stddev_samp(l_quantity) / sqrt(count(*)), 6) AS sem, round(stddev_samp(l_quantity) / avg(l_quantity), 6) AS cv FROM lineitem GROUP BY 1")
def _moments(t):
    x = F.col("l_quantity")
    return t("lineitem").groupBy("l_returnflag").agg(r(A.geometric_mean(x)).alias("geometric"), r(A.harmonic_mean(x)).alias("harmonic"), r(A.quadratic_mean(x)).alias("quadratic"), r(A.sem(x)).alias("sem"), r(A.coefficient_of_variation(x)).alias("cv"))


@query("ends", "SELECT user_id, arg_min(value, (ts, event_id)) AS first, arg_max(value, (ts, event_id)) AS last, max(value) AS top, min(value) AS bottom, arg_max(event_id, (value, -event_id)) AS top_at, arg_min(event_id, (value, event_id)) AS bottom_at FROM events GROUP BY 1")
def _ends(t):
    e = t("events").withColumn("at", F.struct("ts", "event_id"))
    x, i = F.col("value"), F.col("event_id")
    return e.groupBy("user_id").agg(
        A.first(x, "at").alias("first"), A.last(x, "at").alias("last"), F.max(x).alias("top"), F.min(x).alias("bottom"), F.max_by(i, F.struct(x, -i)).alias("top_at"), F.min_by(i, F.struct(x, i)).alias("bottom_at")
    )


@query("extremum", "SELECT l_returnflag, max(l_extendedprice) AS top, min(l_extendedprice) AS bottom FROM lineitem GROUP BY 1")
def _extremum(t):
    x, i = F.col("l_extendedprice"), F.col("l_orderkey")
    return t("lineitem").groupBy("l_returnflag").agg(A.extremum(x, i)["value"].alias("top"), A.extremum(x, i, True)["value"].alias("bottom"))


@query("sums", f"SELECT l_linenumber, count(*) AS n, round(sum(l_extendedprice), 2) AS total, round(avg(l_extendedprice), 4) AS stable, {FIXED('exp(sum(ln(1 + l_discount / 1000)))', 6)} AS product, round(sqrt(sum(l_tax * l_tax)), 6) AS norm FROM lineitem GROUP BY 1")
def _sums(t):
    return t("lineitem").groupBy("l_linenumber").agg(
        F.count("*").alias("n"), r(F.sum("l_extendedprice"), 2).alias("total"), r(A.stable_mean(F.col("l_extendedprice")), 4).alias("stable"), fixed(A.product(1 + F.col("l_discount") / 1000)).alias("product"), r(A.euclidean_norm(F.col("l_tax"))).alias("norm")
    )


@query("weighted_position_mean", f"SELECT user_id, {FIXED('sum(value * n) / (count(*) * (count(*) + 1) / 2.0)')} AS x FROM (SELECT *, row_number() OVER ({SERIES}) AS n FROM events) GROUP BY 1")
def _weighted(t):
    e = t("events").withColumn("n", F.row_number().over(W.ordered(AT, BY)))
    return e.groupBy("user_id").agg(fixed(A.weighted_mean(F.col("value"), F.col("n"))).alias("x"))


for _small, _order in ((False, "DESC"), (True, "ASC")):

    def _extremes(t, small=_small):
        return A.n_extremum(t("orders"), "o_totalprice", 12, small, "o_orderkey")

    query("n_smallest_values" if _small else "n_largest_values", f"SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice {_order}, o_orderkey LIMIT 12")(_extremes)


@query("pairs", "SELECT round(covar_samp(l_extendedprice, l_quantity) / var_samp(l_quantity), 6) AS beta, round(corr(l_extendedprice, l_quantity), 6) AS corr, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(stddev_samp(l_tax - l_discount), 6) AS tracking FROM lineitem")
def _pairs(t):
    a, b = F.col("l_extendedprice"), F.col("l_quantity")
    return t("lineitem").agg(r(A.beta(a, b)).alias("beta"), r(F.corr(a, b)).alias("corr"), r(A.regression(b, a)["intercept"], 4).alias("intercept"), r(A.tracking_error(F.col("l_tax"), F.col("l_discount"))).alias("tracking"))


@query("dot_product", "SELECT round(sum(l_tax * l_discount), 6) AS dot, round(sqrt(sum(l_tax * l_tax)), 6) AS magnitude1, round(sqrt(sum(l_discount * l_discount)), 6) AS magnitude2, round(sqrt(sum(power(l_tax - l_discount, 2))), 6) AS euclidean, round(sum(abs(l_tax - l_discount)), 6) AS manhattan FROM lineitem")
def _dot(t):
    d = A.dot(F.col("l_tax"), F.col("l_discount"))
    return t("lineitem").agg(*[r(d[n]).alias(n) for n in ("dot", "magnitude1", "magnitude2", "euclidean", "manhattan")])


@query("stats", "SELECT round(sqrt(count(*)) * sum(power(l_quantity - m, 3)) / power(sum(power(l_quantity - m, 2)), 1.5), 5) AS skew, round(count(*) * sum(power(l_quantity - m, 4)) / power(sum(power(l_quantity - m, 2)), 2) - 3, 5) AS kurtosis FROM lineitem, (SELECT avg(l_quantity) AS m FROM lineitem)")
def _stats(t):
    s = A.stats(F.col("l_quantity"))
    return t("lineitem").agg(r(s["skew"], 5).alias("skew"), r(s["kurtosis"], 5).alias("kurtosis"))


@query("t_test", f"""SELECT {FIXED('(avg(l_tax) - avg(l_discount)) / sqrt(var_samp(l_tax) / count(*) + var_samp(l_discount) / count(*))', 5)} AS t, 2.0 * count(*) - 2 AS freedom, {FIXED('avg(l_tax - l_discount) / (stddev_samp(l_tax - l_discount) / sqrt(count(*)))', 5)} AS related, count(*) - 1.0 AS related_freedom FROM lineitem""")
def _t_test(t):
    x, y = F.col("l_tax"), F.col("l_discount")
    a, b = A.t_test(x, y, False), A.t_test(x, y, True)
    return t("lineitem").agg(fixed(a["t"], 5).alias("t"), a["freedom"].alias("freedom"), fixed(b["t"], 5).alias("related"), b["freedom"].alias("related_freedom"))


@query("chi_squared", f"SELECT {FIXED('sum(power(l_quantity - l_linenumber, 2) / l_linenumber)', 4)} AS x FROM lineitem")
def _chi(t):
    return t("lineitem").agg(fixed(A.chi_squared(F.col("l_quantity"), F.col("l_linenumber")), 4).alias("x"))


@query("jarque_bera", f"""WITH m AS (SELECT avg(l_quantity) AS m FROM lineitem), s AS (SELECT count(*) AS n, avg(power(l_quantity - m, 3)) / power(avg(power(l_quantity - m, 2)), 1.5) AS s, avg(power(l_quantity - m, 4)) / power(avg(power(l_quantity - m, 2)), 2) - 3 AS k FROM lineitem, m)
    SELECT {FIXED('n / 6.0 * (s * s + k * k / 4)', 3)} AS statistic, {FIXED('exp(-n / 12.0 * (s * s + k * k / 4))')} AS p_value FROM s""")
def _jb(t):
    j = A.jarque_bera(F.col("l_quantity"))
    return t("lineitem").agg(fixed(j["statistic"], 3).alias("statistic"), fixed(j["p_value"]).alias("p_value"))


_REGRESSION = lambda y, x, n: f"{FIXED(f'regr_slope({y}, {x})')} AS {n}_slope, {FIXED(f'regr_intercept({y}, {x})', 5)} AS {n}_intercept"


@query("curve_fits", f"SELECT {_REGRESSION('l_extendedprice', 'l_quantity', 'linear')}, {_REGRESSION('l_extendedprice', 'ln(l_quantity)', 'log')}, {_REGRESSION('ln(l_extendedprice)', 'l_quantity', 'exponential')}, {_REGRESSION('ln(l_extendedprice)', 'ln(l_quantity)', 'power')} FROM lineitem")
def _fits(t):
    x, y = F.col("l_quantity"), F.col("l_extendedprice")
    fits = {"linear": A.regression(x, y), "log": A.log_fit(x, y), "exponential": A.exponential_fit(x, y), "power": A.power_fit(x, y)}
    return t("lineitem").agg(*[c for n, f in fits.items() for c in (fixed(f["slope"]).alias(f"{n}_slope"), fixed(f["intercept"], 5).alias(f"{n}_intercept"))])


# Least squares by Cramer's rule on centred sums.
@query("polynomial_fit", f"""WITH m AS (SELECT avg(l_quantity) AS m FROM lineitem), c AS (SELECT l_quantity - m AS x, l_extendedprice AS y, m FROM lineitem, m),
    s AS (SELECT avg(x * x) AS s2, avg(x * x * x) AS s3, avg(x * x * x * x) AS s4, avg(y) AS t0, avg(x * y) AS t1, avg(x * x * y) AS t2, any_value(m) AS m FROM c), d AS (SELECT *, s2 * s4 - s3 * s3 - s2 * s2 * s2 AS det FROM s),
    k AS (SELECT *, (t0 * (s2 * s4 - s3 * s3) + s2 * (t1 * s3 - s2 * t2)) / det AS a0, (t1 * (s4 - s2 * s2) - s3 * (t2 - s2 * t0)) / det AS a1, (s2 * (t2 - s2 * t0) - s3 * t1) / det AS a2 FROM d)
    SELECT unnest([0, 1, 2])::INT AS power, round(unnest([a0 - a1 * m + a2 * m * m, a1 - 2 * a2 * m, a2]), 3) AS coefficient FROM k""")
def _poly(t):
    return A.polynomial_fit(t("lineitem"), "l_quantity", "l_extendedprice", 2).withColumn("coefficient", r("coefficient", 3))


@query("ratios", f"""SELECT {FIXED('avg(l_tax - l_discount) / stddev_samp(l_tax - l_discount)')} AS sharpe, {FIXED('(avg(l_tax - l_discount) - 0.01) / sqrt(sum(power(least(l_tax - l_discount - 0.01, 0), 2)) / count(*))')} AS sortino,
    {FIXED('avg(l_tax - l_discount) / (covar_samp(l_tax, l_discount) / var_samp(l_discount))', 3)} AS treynor FROM lineitem""")
def _ratios(t):
    a, b = F.col("l_tax"), F.col("l_discount")
    return t("lineitem").agg(fixed(A.sharpe(a, b)).alias("sharpe"), fixed(A.sharpe(a, b, True, 0.01)).alias("sortino"), fixed(A.treynor(a, b), 3).alias("treynor"))


_A, _M = "(l_quantity / 100)", "(0.1 + l_discount * 8)"
_LOSSES = {
    "kullback_leibler": f"sum({_A} * ln({_A} / {_M}))", "mean_abs_error": f"avg(abs({_A} - {_M}))", "mean_sqr_error": f"avg(power({_A} - {_M}, 2))", "mean_sqr_log_error": f"avg(power(ln(1 + {_A}) - ln(1 + {_M}), 2))", "cross_entropy": f"-sum({_A} * ln({_M})) / count(*)",
    "binary_cross_entropy": f"-avg({_A} * ln({_M}) + (1 - {_A}) * ln(1 - {_M}))", "categorical_hinge": f"greatest(max((1 - {_A}) * {_M}) - sum({_A} * {_M}) + 1, 0)", "cosine_similarity": f"sum({_A} * {_M}) / sqrt(sum({_A} * {_A}) * sum({_M} * {_M}))",
    "log_cosh": f"avg(ln((exp({_M} - {_A}) + exp({_A} - {_M})) / 2))",
}


@query("losses", "SELECT " + ", ".join(f"{FIXED(sql, 5)} AS {n}" for n, sql in _LOSSES.items()) + " FROM lineitem")
def _losses(t):
    a, m = F.col("l_quantity") / 100, 0.1 + F.col("l_discount") * 8
    return t("lineitem").agg(*[fixed(A.loss(n, a, m), 5).alias(n) for n in _LOSSES])


_SIMILAR = {
    "euclidean_dist": "sqrt(sum(power(o_custkey - o_orderkey, 2)))", "manhattan_dist": "sum(abs(o_custkey - o_orderkey))", "dot_product": "sum(o_custkey * o_orderkey)", "simple_similarity": "avg((o_custkey % 4 = o_orderkey % 4)::INT)",
    "cosine_similarity": "sum(o_custkey * o_orderkey) / sqrt(sum(o_custkey * o_custkey)::DOUBLE * sum(o_orderkey * o_orderkey))", "hamming_dist": "count(*) FILTER (o_custkey <> o_orderkey)",
}


@query("similarities", "SELECT " + ", ".join(f"{FIXED(sql, 3)} AS {n}" for n, sql in _SIMILAR.items()) + ", len(list_intersect(list(DISTINCT o_custkey), list(DISTINCT o_orderkey)))::DOUBLE / len(list_distinct(list_concat(list(DISTINCT o_custkey), list(DISTINCT o_orderkey)))) AS jaccard_similarity FROM orders")
def _similarities(t):
    a, b = F.col("o_custkey"), F.col("o_orderkey")
    of = lambda n: A.similarity(n, a % 4, b % 4) if n == "simple_similarity" else A.similarity(n, a.cast("double"), b.cast("double"))
    return t("orders").agg(*[fixed(of(n), 3).alias(n) for n in _SIMILAR], A.similarity("jaccard_similarity", a, b).alias("jaccard_similarity"))


for _kind, _sql in (("none", "-ln(p) * o_totalprice"), ("constant", "-ln(p) * (o_totalprice - 1000)"), ("mean", "-ln(p) * (o_totalprice - m)"), ("standardize", "-ln(p) * (o_totalprice - m) / s")):

    def _policy(t, kind=_kind):
        o = t("orders").withColumn("p", (F.col("o_orderkey") % 9 + 1) / 10)
        return A.policy_loss(o, "p", "o_totalprice", kind, 1000.0).select("o_orderkey", fixed("loss", 4).alias("loss"))

    query(f"policy_loss_{_kind}", f"SELECT o_orderkey, {FIXED(_sql, 4)} AS loss FROM (SELECT *, (o_orderkey % 9 + 1) / 10 AS p, avg(o_totalprice) OVER () AS m, stddev_samp(o_totalprice) OVER () AS s FROM orders)")(_policy)


# Order statistics


@query("quantile", f"SELECT round({QUANTILE.format(q=0.35, x='l_extendedprice', t='lineitem', pair=MIDDLE)}, 6) AS q0, round({QUANTILE.format(q=0.5, x='l_extendedprice', t='lineitem', pair=MIDDLE)}, 6) AS q1")
def _quantile(t):
    return O.quantiles(t("lineitem"), "l_extendedprice", [0.35, 0.5]).select(r("q0").alias("q0"), r("q1").alias("q1"))


for _kind, _pair in (("lower", "v[k]"), ("higher", "v[least(n, k + 1)]"), ("linear", "v[k] * (1 - {q}) + v[least(n, k + 1)] * {q}")):

    def _quantile_by(t, kind=_kind):
        return O.quantiles(t("lineitem"), "l_extendedprice", [0.35, 0.8], policy=kind).select(r("q0").alias("q0"), r("q1").alias("q1"))

    query(f"quantile_{_kind}", "SELECT " + ", ".join(f"round({QUANTILE.format(q=q, x='l_extendedprice', t='lineitem', pair=_pair.format(q=q))}, 6) AS q{i}" for i, q in enumerate((0.35, 0.8))))(_quantile_by)


@query("quantile_by_group", "SELECT user_id, CASE WHEN n % 2 = 0 OR k < n * 0.6 THEN (v[k] + v[least(n, k + 1)]) / 2 ELSE v[k] END AS q0 FROM (SELECT *, greatest(1, least(n, floor(n * 0.6 + 0.5)::BIGINT)) AS k FROM (SELECT user_id, list(value ORDER BY value) AS v, count(*) AS n FROM events GROUP BY 1))")
def _quantile_group(t):
    return O.quantiles(t("events"), "value", [0.6], BY)


@query("kth_value", "SELECT l_returnflag, list_sort(list(l_extendedprice))[1000] AS kth FROM lineitem GROUP BY 1 HAVING count(*) >= 1000")
def _kth(t):
    return A.kth_value(t("lineitem"), "l_extendedprice", 1000, by=["l_returnflag"])


@query("kth_value_known", "SELECT list_sort(list(x))[round(500.0 * count(x) / count(*))::BIGINT] AS kth FROM (SELECT CASE WHEN o_orderpriority <> '1-URGENT' THEN o_totalprice END AS x FROM orders)")
def _kth_known(t):
    return A.kth_value(t("orders").withColumn("x", F.when(F.col("o_orderpriority") != "1-URGENT", F.col("o_totalprice"))), "x", 500, True)


@query("mode", "SELECT l_quantity AS value, count(*) AS count FROM (SELECT *, row_number() OVER (ORDER BY l_orderkey, l_linenumber) AS p FROM lineitem) GROUP BY 1 ORDER BY 2 DESC, min(p) LIMIT 3")
def _mode(t):
    return A.mode(with_positions(t("lineitem"), LINES), "l_quantity", 3)


_Q50 = QUANTILE.format(q=0.5, x="{x}", t="{t}", pair=MIDDLE)
_CENTRES = {"median": _Q50.format(x="o_totalprice", t="orders"), "mean": "(SELECT avg(o_totalprice) FROM orders)"}
for _centre in _CENTRES:
    for _spread in ("median", "mean"):

        def _mad(t, centre=_centre, spread=_spread):
            return A.mad(t("orders"), "o_totalprice", centre, spread).select(r("mad", 4).alias("mad"))

        _away = f"(SELECT abs(o_totalprice - {_CENTRES[_centre]}) AS d FROM orders)"
        query(f"mad_{_spread}_around_{_centre}", f"SELECT round({_Q50.format(x='d', t=_away) if _spread == 'median' else f'(SELECT avg(d) FROM {_away})'}, 4) AS mad")(_mad)


_PEERS = "(SELECT c_custkey, rank() OVER (ORDER BY c_mktsegment) - 1 AS f, count(*) OVER (PARTITION BY c_mktsegment) AS n, row_number() OVER (ORDER BY c_mktsegment, c_custkey) - 1 AS a FROM customer)"
for _kind, _sql in (("average", "f + (n - 1) / 2"), ("first", "f"), ("last", "f + n - 1"), ("actual", "a")):

    def _rank(t, kind=_kind):
        return A.ranks(t("customer"), "c_mktsegment", kind, "c_custkey").select("c_custkey", F.col("rank").cast("double").alias("rank"))

    query("rank" if _kind == "average" else f"rank_{_kind}", f"SELECT c_custkey, ({_sql})::DOUBLE AS rank FROM {_PEERS}")(_rank)


@query("rank_by_group", "SELECT event_id, (rank() OVER (PARTITION BY user_id ORDER BY event_type) - 1)::DOUBLE AS rank FROM events")
def _rank_group(t):
    return A.ranks(t("events"), "event_type", "first", "event_id", BY).select("event_id", F.col("rank").cast("double").alias("rank"))


@query("spearman", f"SELECT {FIXED('1 - 6 * sum(power(a - b, 2)) / (count(*) * (power(count(*), 2) - 1))')} AS spearman FROM (SELECT row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS a, row_number() OVER (ORDER BY o_custkey, o_orderkey) AS b FROM orders)")
def _spearman(t):
    return A.spearman(t("orders"), "o_totalprice", "o_custkey", "o_orderkey").select(fixed("spearman").alias("spearman"))


@query("quantile_bins", """WITH s AS (SELECT list(o_totalprice ORDER BY o_totalprice) AS v, count(*) - 1 AS n FROM orders), e AS (SELECT list_transform(range(6), lambda i: CASE WHEN floor(i / 5 * n) < n THEN v[floor(i / 5 * n)::BIGINT + 1] * (1 - (i / 5 * n - floor(i / 5 * n))) + v[floor(i / 5 * n)::BIGINT + 2] * (i / 5 * n - floor(i / 5 * n)) ELSE v[-1] END) AS e FROM s)
    SELECT o_orderkey, least(len(list_filter(e, lambda x: x <= o_totalprice)) - 1, 4)::INT AS bin, round(e[least(len(list_filter(e, lambda x: x <= o_totalprice)), 5)], 4) AS bin_low FROM orders, e""")
def _bins(t):
    return A.quantile_bins(t("orders"), "o_totalprice", 5).select("o_orderkey", "bin", r("bin_low", 4).alias("bin_low"))


@query("bins", "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity >= 1 AND l_quantity <= 10 THEN 'low' WHEN l_quantity > 10 AND l_quantity <= 30 THEN 'mid' WHEN l_quantity > 30 AND l_quantity <= 45 THEN 'high' END AS bin FROM lineitem")
def _explicit_bins(t):
    return t("lineitem").select(*LINES, S.to_bins(F.col("l_quantity"), [1.0, 10.0, 30.0, 45.0], labels=["low", "mid", "high"], include_lowest=True).alias("bin"))


@query("equal_bins", "WITH m AS (SELECT 1 - 49 * 0.0001 AS a, 50 + 49 * 0.0001 AS z), e AS (SELECT list_transform(range(8), lambda i: trunc(a + i * (z - a) / 7)) AS e FROM m) SELECT l_orderkey, l_linenumber, list_position(list_transform(range(1, 8), lambda i: l_quantity > e[i] AND l_quantity <= e[i + 1]), true) - 1 AS bin FROM lineitem, e")
def _equal_bins(t):
    return t("lineitem").select(*LINES, S.to_bins(F.col("l_quantity"), S.equal_width_edges(1.0, 50.0, 7)).alias("bin"))


# Tests


@query("kolmogorov_smirnov", f"""WITH p AS (SELECT l_tax AS x, 1 AS a, 0 AS b FROM lineitem UNION ALL SELECT l_discount, 0, 1 FROM lineitem), d AS (SELECT abs(sum(a) OVER (ORDER BY x) / sum(a) OVER () - sum(b) OVER (ORDER BY x) / sum(b) OVER ()) AS d, sum(a) OVER () AS n FROM p)
    SELECT {FIXED('max(d)')} AS statistic, {FIXED('least(1, 2 * exp(-2 * max(n) / 2.0 * max(d) * max(d)))')} AS p_value FROM d""")
def _ks(t):
    return A.kolmogorov_smirnov(t("lineitem"), "l_tax", "l_discount").select(fixed("statistic").alias("statistic"), fixed("p_value").alias("p_value"))


@query("mann_whitney", f"""WITH p AS (SELECT l_tax AS x, 1 AS a FROM lineitem UNION ALL SELECT l_discount, 0 FROM lineitem), k AS (SELECT a, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2 AS k FROM p), s AS (SELECT sum(k * a) AS r1, sum(a)::DOUBLE AS n, sum(1 - a)::DOUBLE AS m FROM k), u AS (SELECT *, r1 - n * (n + 1) / 2 AS u1 FROM s)
    SELECT round(u1, 1) AS u1, round(n * m - u1, 1) AS u2, {FIXED('(least(u1, n * m - u1) - n * m / 2) / sqrt(n * m * (n + m + 1) / 12)', 5)} AS z FROM u""")
def _mwu(t):
    return A.mann_whitney(t("lineitem"), "l_tax", "l_discount").select(r("u1", 1).alias("u1"), r("u2", 1).alias("u2"), fixed("z", 5).alias("z"))


@query("durbin_watson", f"SELECT {FIXED('sum(d * d) / sum(value * value)')} AS d, {FIXED('1 - sum(d * d) / sum(value * value) / 2')} AS rho FROM (SELECT value, value - lag(value) OVER (ORDER BY ts, event_id) AS d FROM events)")
def _dw(t):
    return A.durbin_watson(t("events"), "value", AT).select(fixed("d").alias("d"), fixed("rho").alias("rho"))


@query("durbin_watson_by_user", f"SELECT user_id, {FIXED('sum(d * d) / sum(value * value)')} AS d FROM (SELECT user_id, value, value - lag(value) OVER ({SERIES}) AS d FROM events) GROUP BY 1")
def _dw_user(t):
    return A.durbin_watson(t("events"), "value", AT, BY).select("user_id", fixed("d").alias("d"))


_CENTRED = "(SELECT ts, event_id, value - avg(value) OVER () AS e FROM events)"


@query("ljung_box", f"""WITH e AS (SELECT e, {', '.join(f'lag(e, {k}) OVER (ORDER BY ts, event_id) AS l{k}' for k in (1, 2, 3))} FROM {_CENTRED}), s AS (SELECT count(*) AS n, {', '.join(f'sum(e * l{k}) / sum(e * e) AS a{k}' for k in (1, 2, 3))} FROM e),
    q AS (SELECT unnest([1, 2, 3]) AS lag, unnest([a1, a2, a3]) AS acf, unnest([n * (n + 2) * a1 * a1 / (n - 1), n * (n + 2) * (a1 * a1 / (n - 1) + a2 * a2 / (n - 2)), n * (n + 2) * (a1 * a1 / (n - 1) + a2 * a2 / (n - 2) + a3 * a3 / (n - 3))]) AS q FROM s)
    SELECT lag::INT AS lag, {FIXED('acf')} AS acf, {FIXED('q')} AS q, CASE WHEN lag = 2 THEN {FIXED('exp(-q / 2)')} END AS p_two FROM q""")
def _lb(t):
    out = A.ljung_box(t("events"), "value", 3, AT)
    return out.select("lag", fixed("acf").alias("acf"), fixed("q").alias("q"), F.when(F.col("lag") == 2, fixed("p_value")).alias("p_two"))


@query("autocorrelation", "SELECT 0 AS lag, round(corr(value, value), 6) AS corr FROM events UNION ALL SELECT 1, round(corr(value, l1), 6) FROM (SELECT value, lag(value) OVER (ORDER BY ts, event_id) AS l1 FROM events) UNION ALL SELECT 2, round(corr(value, l1), 6) FROM (SELECT value, lag(value, 2) OVER (ORDER BY ts, event_id) AS l1 FROM events)")
def _acf(t):
    return A.autocorrelation(t("events"), "value", 3, AT).select("lag", r("corr").alias("corr"))


@query("cross_correlation", " UNION ALL ".join(f"SELECT user_id, {k} AS lag, CASE WHEN count(*) FILTER (l IS NOT NULL) > 3 THEN round(corr({'value' if k >= 0 else 'b'}, l), 5) END AS corr FROM (SELECT *, {f'lag(b, {k})' if k >= 0 else f'lag(value, {-k})'} OVER ({SERIES}) AS l FROM (SELECT *, (event_id % 97)::DOUBLE AS b FROM events)) GROUP BY 1" for k in (-2, -1, 0, 1)))
def _ccf(t):
    e = t("events").withColumn("b", (F.col("event_id") % 97).cast("double"))
    few = e.groupBy("user_id").agg(F.count("*").alias("n"))
    out = A.cross_correlation(e, "value", "b", -2, 2, AT, BY).join(few, "user_id")
    return out.select("user_id", "lag", F.when(F.col("n") - F.abs("lag") > 3, r("corr", 5)).alias("corr"))


@query("mutual_information", "SELECT round(sum(n / t * log2(n * t / (a * b))), 6) AS mutual_information FROM (SELECT n, sum(n) OVER () AS t, sum(n) OVER (PARTITION BY l_returnflag) AS a, sum(n) OVER (PARTITION BY l_linestatus) AS b FROM (SELECT l_returnflag, l_linestatus, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1, 2))")
def _mutual(t):
    return A.mutual_information(t("lineitem"), "l_returnflag", "l_linestatus").select(r("mutual_information").alias("mutual_information"))


@query("z_outliers", "SELECT l_orderkey, l_linenumber FROM (SELECT *, abs(l_extendedprice - avg(l_extendedprice) OVER ()) / stddev_samp(l_extendedprice) OVER () AS z FROM lineitem) WHERE z > 2")
def _z(t):
    return A.z_outliers(t("lineitem"), "l_extendedprice", 2).select(*LINES)


@query("sample_z_score", f"SELECT {FIXED('(avg(s) - avg(l_tax)) / (stddev_samp(l_tax) / sqrt(count(s)))', 5)} AS z FROM (SELECT l_tax, CASE WHEN l_returnflag = 'R' THEN l_tax END AS s FROM lineitem)")
def _sample_z(t):
    return A.sample_z_score(t("lineitem").withColumn("s", F.when(F.col("l_returnflag") == "R", F.col("l_tax"))), "l_tax", "s").select(fixed("z", 5).alias("z"))


@query("confidence_interval", "SELECT l_returnflag, round(avg(l_quantity) - 1.96 * stddev_samp(l_quantity) / sqrt(count(*)), 6) AS low, round(avg(l_quantity) + 1.96 * stddev_samp(l_quantity) / sqrt(count(*)), 6) AS high, round((1.6449 + 0.02 / 0.05 * (1.96 - 1.6449)) * stddev_samp(l_quantity) / sqrt(count(*)), 6) AS margin_92 FROM lineitem GROUP BY 1")
def _interval(t):
    c, d = A.confidence_interval(F.col("l_quantity")), A.confidence_interval(F.col("l_quantity"), 0.92)
    return t("lineitem").groupBy("l_returnflag").agg(r(c["low"]).alias("low"), r(c["high"]).alias("high"), r(d["margin"]).alias("margin_92"))


# Scaling


_X = "o_totalprice"
_SCALED = {
    "z_score": f"({_X} - avg({_X}) OVER ()) / stddev_samp({_X}) OVER ()", "min_max": f"({_X} - min({_X}) OVER ()) / (max({_X}) OVER () - min({_X}) OVER ())", "simple": f"1e4 * {_X} / sum({_X}) OVER ()", "euclidean": f"1e4 * {_X} / sqrt(sum({_X} * {_X}) OVER ())",
    "maxi": f"{_X} / max({_X}) OVER ()", "decimal_scaling": f"{_X} / power(10, floor(log10(max(abs({_X})) OVER ())) + 1)", "log_transform": f"ln({_X})", "root_transform": f"sqrt({_X})", "share_log": f"1e4 * ln({_X}) / sum(ln({_X})) OVER ()",
}
for _kind, _sql in _SCALED.items():

    def _scaled(t, kind=_kind, times=1e4 if "1e4" in _sql else 1.0):
        return W.normalize(t("orders"), _X, kind, "x").select("o_orderkey", fixed(F.col("x") * times).alias("x"))

    query("z_score" if _kind == "z_score" else f"normalize_{_kind}", f"SELECT o_orderkey, {FIXED(_sql)} AS x FROM orders")(_scaled)

for _kind, _sql in (("arithmetic", "l_quantity / sum(l_quantity) OVER ()"), ("softmax", "exp(l_quantity) / sum(exp(l_quantity)) OVER ()"), ("pow2", "power(2, l_quantity) / sum(power(2, l_quantity)) OVER ()"), ("pow10", "power(10, l_quantity) / sum(power(10, l_quantity)) OVER ()")):

    def _probability(t, kind=_kind):
        return W.probability(t("lineitem"), "l_quantity", kind, "x").select(*LINES, fixed(F.col("x") * 1e4).alias("x"))

    query(f"probability_{_kind}", f"SELECT l_orderkey, l_linenumber, {FIXED(f'1e4 * {_sql}')} AS x FROM lineitem")(_probability)


@query("standardize_by_user", f"SELECT event_id, {FIXED('(value - avg(value) OVER p) / stddev_samp(value) OVER p')} AS x FROM events WINDOW p AS (PARTITION BY user_id)")
def _standardize(t):
    return W.z_score(t("events"), "value", "x", BY).select("event_id", fixed("x").alias("x"))


@query("unit_length", f"SELECT vec_id, {FIXED('embedding[1]::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda v: v::DOUBLE * v)))', 5)} AS x FROM embeddings")
def _unit(t):
    return t("embeddings").select("vec_id", fixed(W.unit_length(F.col("embedding"))[0], 5).alias("x"))


@query("categories", "SELECT event_id, dense_rank() OVER (ORDER BY f) - 1 AS category FROM (SELECT event_id, min(p) OVER (PARTITION BY event_type) AS f FROM (SELECT *, row_number() OVER (ORDER BY event_id) AS p FROM events))")
def _categories(t):
    return W.categories(rows(t, "events", "event_id"), "event_type").select("event_id", "category")


@query("factorize", "SELECT o_orderkey, coalesce(o_totalprice > 150000, false) AS big FROM orders")
def _factorize(t):
    return t("orders").select("o_orderkey", W.factorize(F.col("o_totalprice") > 150000).alias("big"))


for _kind, _sql in (
    ("logistic", "1 / (1 + exp(-x))"), ("algebraic", "1 / sqrt(1 + x * x)"), ("hyperbolic_tan", "(exp(x) - exp(-x)) / (exp(x) + exp(-x))"), ("arc_tan", "atan(x)"), ("gudermannian", "atan((exp(x) - exp(-x)) / 2)"), ("smoothstep", "CASE WHEN x <= 0 THEN 0 WHEN x >= 1 THEN 1 ELSE x * x * (3 - 2 * x) END"),
    ("error_function", "sign(x) * 2 / sqrt(pi()) * list_sum(list_transform(range(0, 200), lambda k: exp((2 * k + 1) * ln(greatest(abs(x), 1e-300)) + k * ln(2) - x * x - ((k + 1) * ln(2) + lgamma(k + 1.5) - ln(pi()) / 2))))"),
):

    def _sigmoids(t, kind=_kind):
        return t("lineitem").select(*LINES, fixed(S.sigmoid((F.col("l_quantity") - 25) / 8, kind)).alias("x"))

    query(f"sigmoid_{_kind}", f"SELECT l_orderkey, l_linenumber, {FIXED(_sql)} AS x FROM (SELECT *, (l_quantity - 25) / 8 AS x FROM lineitem)")(_sigmoids)

for _kind, _sql in (
    ("ReLU", "greatest(0, x)"), ("param_ReLU", "greatest(x, 0.1 * x)"), ("GeLU", "x * exp(-x * x / 2) / sqrt(2 * pi())"), ("SiLU", "x / (1 + exp(-x))"), ("softplus", "ln(1 + exp(0.1 * x)) / 0.1"), ("elu", "CASE WHEN x > 0 THEN x ELSE 0.1 * (exp(x) - 1) END"),
    ("mish", "x * (power(1 + exp(x), 2) - 1) / (power(1 + exp(x), 2) + 1)"), ("metallic_mean", "(x + sqrt(x * x + 4)) / 2"),
):

    def _rectified(t, kind=_kind):
        return t("lineitem").select(*LINES, fixed(S.rectify((F.col("l_quantity") - 25) / 8, kind, 0.1)).alias("x"))

    query(f"rectify_{_kind}", f"SELECT l_orderkey, l_linenumber, {FIXED(_sql)} AS x FROM (SELECT *, (l_quantity - 25) / 8 AS x FROM lineitem)")(_rectified)


@query("sigmoid", "SELECT l_orderkey, l_linenumber, round(1 / (1 + exp(-l_discount)), 6) AS s, round(greatest(0, l_quantity - 25), 6) AS relu FROM lineitem")
def _sigmoid(t):
    return t("lineitem").select(*LINES, r(S.sigmoid(F.col("l_discount"))).alias("s"), r(S.rectify(F.col("l_quantity") - 25)).alias("relu"))


for _kind, _sql in (("original", "(power(x, 0.4) - 1) / 0.4"), ("modulus", "sign(x) * (power(abs(x) + 1, 0.4) - 1) / 0.4"), ("exponential", "(exp(0.4 * x) - 1) / 0.4"), ("geometric_mean", "(power(x, 0.4) - 1) / (0.4 * power(3, -0.6))")):

    def _box_cox(t, kind=_kind):
        return t("lineitem").select(*LINES, fixed(S.box_cox(F.col("l_quantity") / 5, 0.4, kind, geometric=F.lit(3.0))).alias("x"))

    query(f"box_cox_{_kind}", f"SELECT l_orderkey, l_linenumber, {FIXED(_sql)} AS x FROM (SELECT *, l_quantity / 5 AS x FROM lineitem)")(_box_cox)


# Windows


@query("cumulative", f"SELECT event_id, round(sum(value) OVER w, 4) AS s, max(value) OVER w AS m, min(value) OVER w AS low, count(value) OVER w AS n FROM events WINDOW w AS ({SERIES} ROWS UNBOUNDED PRECEDING)")
def _cum(t):
    x = F.col("value")
    return t("events").select("event_id", r(W.cumulative(F.sum, x, AT, BY), 4).alias("s"), W.cumulative(F.max, x, AT, BY).alias("m"), W.cumulative(F.min, x, AT, BY).alias("low"), W.cumulative(F.count, x, AT, BY).alias("n"))


@query("simple_roll", f"SELECT event_id, CASE WHEN row_number() OVER ({SERIES}) >= 5 THEN round(avg(value) OVER ({SERIES} ROWS 4 PRECEDING), 6) END AS m FROM events")
def _roll(t):
    return t("events").select("event_id", r(W.rolling(F.avg, 5, F.col("value"), order=AT, by=BY)).alias("m"))


@query("whole_roll", "SELECT event_id, CASE WHEN row_number() OVER w >= 5 THEN max(value) OVER (ORDER BY ts, event_id ROWS 4 PRECEDING) END AS m FROM events WINDOW w AS (ORDER BY ts, event_id)")
def _whole_roll(t):
    e = blocked(with_positions(t("events"), AT), 4)
    return e.withColumn("m", W.rolling(F.max, 5, F.col("value"), by=["__block"])).where("__own").select("event_id", "m")


@query("step_roll", "SELECT user_id, max(value) AS top, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS p FROM events) WHERE p % 3 = 0 GROUP BY 1")
def _step(t):
    return W.step_roll(t("events"), 3, F.max("value").alias("top"), F.count("*").alias("n"), order=AT, by=BY)


@query("returns", f"SELECT event_id, round(value - lag(value) OVER ({SERIES}), 6) AS monetary, round(value - lag(value, 3) OVER ({SERIES}), 6) AS diff3 FROM events")
def _returns(t):
    return t("events").select("event_id", r(W.returns(F.col("value"), "monetary", 1, AT, BY)).alias("monetary"), r(W.diff(F.col("value"), 3, AT, BY)).alias("diff3"))


@query("diff_ahead", f"SELECT event_id, round(abs(value - lead(value, 2) OVER ({SERIES})), 6) AS x FROM events")
def _diff_ahead(t):
    return t("events").select("event_id", r(W.diff(F.col("value"), -2, AT, BY, True)).alias("x"))


# Calendar


@query("weekdays", "SELECT o_orderkey, (SELECT count(*) FROM range(o_orderdate::DATE + 1, o_orderdate::DATE + 31, INTERVAL 1 DAY) d(x) WHERE isodow(x) < 6) AS n, isodow(o_orderdate) > 5 AS weekend FROM orders")
def _weekdays(t):
    d = F.to_date("o_orderdate")
    return t("orders").select("o_orderkey", S.weekdays_between(d, F.date_add(d, 30)).cast("long").alias("n"), S.is_weekend(d).alias("weekend"))


_PART_SQL = {
    "date": "strftime(ts, '%Y%m%d')::INT", "year": "year(ts)", "month": "month(ts)", "dmonth": "day(ts)", "dyear": "dayofyear(ts)", "dweek": "dayofweek(ts) + 1", "hour": "hour(ts)", "minute": "minute(ts)", "sec": "second(ts)", "msec": "(epoch_us(ts) % 1000000) // 1000", "microsec": "epoch_us(ts) % 1000000",
    "nanosec": "epoch_us(ts) % 1000000 * 1000", "time": "epoch_us(ts) // 1000000", "days": "epoch_us(ts) // 86400000000", "long_time": "epoch_us(ts) * 1000", "double": "epoch_us(ts) / 1e6",
}


@query("time_parts", "SELECT event_id, " + ", ".join(f"({sql})::{'DOUBLE' if n == 'double' else 'BIGINT'} AS {n}" for n, sql in _PART_SQL.items()) + ", day(last_day(ts))::BIGINT AS days_in_month FROM events")
def _parts(t):
    a = F.col("ts")
    return t("events").select("event_id", *[S.part(a, n).cast("double" if n == "double" else "long").alias(n) for n in _PART_SQL], S.days_in_month(a).cast("long").alias("days_in_month"))


_FORMAT_SQL = {
    "AMR_DT": "%m/%d/%y", "AMR_DT_CTY": "%m/%d/%Y", "EUR_DT": "%d/%m/%y", "EUR_DT_CTY": "%d/%m/%Y", "DT_TM": "%m/%d/%Y %H:%M:%S", "SCT_DT": "%b %d, %Y", "DT_MMDDYYYY": "%m%d%Y", "DT_YYYYMMDD": "%Y%m%d", "DT_TM2": "%m/%d/%Y %H:%M:%S.%g", "DT_DATETIME": "%Y%m%d  %H:%M:%S.%g",
    "ISO_DT_TM": "%Y-%m-%d %H:%M:%S.%f", "ISO_DT": "%Y-%m-%d", "AMR_DT_TM": "%m/%d/%Y %H:%M:%S.%f", "EUR_DT_TM": "%d/%m/%Y %H:%M:%S.%f",
}


@query("time_formats", "SELECT event_id, " + ", ".join(f"strftime(ts, '{f}') AS {n}" for n, f in _FORMAT_SQL.items()) + ", strftime(ts, '%Y-%m-%d %H:%M:%S.%f') || '000' AS ISO_DT_NANO, (epoch_us(ts) // 1000000)::VARCHAR || '.' || (epoch_us(ts) % 1000000 * 1000)::VARCHAR AS DT_PRECISE FROM events")
def _formats(t):
    return t("events").select("event_id", *[S.string_format(F.col("ts"), n).alias(n) for n in (*_FORMAT_SQL, "ISO_DT_NANO", "DT_PRECISE")])


@query("time_construct", "SELECT event_id, date_trunc('second', ts) AS iso, date_trunc('second', ts) AS american, date_trunc('second', ts) AS european, date_trunc('day', ts) AS plain FROM events")
def _construct(t):
    a = F.col("ts")
    made = lambda form, style: S.construct(S.string_format(a, form), style).cast("timestamp_ntz")
    return t("events").select("event_id", S.construct(F.date_format(a, "yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz").alias("iso"), made("DT_TM", "AME").alias("american"), S.construct(F.date_format(a, "dd/MM/yyyy HH:mm:ss"), "EUR").cast("timestamp_ntz").alias("european"), made("DT_YYYYMMDD", "YYYYMMDD").alias("plain"))


@query("time_zones", "SELECT event_id, (ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS new_york, (ts AT TIME ZONE 'UTC') AT TIME ZONE 'Asia/Tokyo' AS tokyo, (ts AT TIME ZONE 'Europe/Berlin') AT TIME ZONE 'Asia/Tehran' AS tehran FROM events")
def _zones(t):
    a = F.col("ts").cast("timestamp")
    return t("events").select("event_id", S.to_zone(a, "AM_NEW_YORK").cast("timestamp_ntz").alias("new_york"), S.to_zone(a, "AS_TOKYO").cast("timestamp_ntz").alias("tokyo"), S.to_zone(a, "AS_TEHRAN", "EU_BERLIN").cast("timestamp_ntz").alias("tehran"))


@query("time_steps", "SELECT event_id, ts + INTERVAL 1000 SECOND AS seconds, ts + INTERVAL 40 DAY AS days, ts + INTERVAL 5 MONTH AS months, ts - INTERVAL 3 YEAR AS years, ts + INTERVAL 7 MICROSECOND AS nanoseconds FROM events")
def _steps(t):
    a = F.col("ts").cast("timestamp_ntz")
    more = {"seconds": 1000, "days": 40, "months": 5, "years": -3}
    return t("events").select("event_id", *[S.add(a, u, n).alias(u) for u, n in more.items()], S.add(a, "nanoseconds", 7000).cast("timestamp_ntz").alias("nanoseconds"))


@query("time_differences", "SELECT event_id, " + ", ".join(f"{FIXED(f'(epoch_us(ts) - epoch_us(TIMESTAMP {chr(39)}2024-01-01 00:00:00{chr(39)})) / {s}e6')} AS {u}" for u, s in (("seconds", 1), ("minutes", 60), ("hours", 3600), ("days", 86400), ("weeks", 604800))) + " FROM events")
def _differences(t):
    a, b = F.col("ts").cast("timestamp"), F.lit("2024-01-01 00:00:00").cast("timestamp")
    return t("events").select("event_id", *[fixed(S.time_difference(a, b, u)).alias(u) for u in ("seconds", "minutes", "hours", "days", "weeks")])


_NTH = lambda month, dow, n: f"(month(d) = {month} AND isodow(d) = {dow} AND (day(d) - 1) // 7 + 1 = {n})"
_ON = lambda month, day: f"((month(d) = {month} AND day(d) = {day}) OR (month(d) = {month} AND day(d) = {day + 1} AND isodow(d) = 1))"
_HOLIDAY = " OR ".join([_ON(1, 1), _NTH(1, 1, 3), _NTH(2, 1, 3), "(month(d) = 5 AND isodow(d) = 1 AND day(d) > 24)", _ON(6, 19), _ON(7, 4), _NTH(9, 1, 1), _NTH(10, 1, 2), _ON(11, 11), _NTH(11, 4, 4), _ON(12, 25)])


@query("time_tests", f"SELECT o_orderkey, month(d) = 1 AND day(d) = 1 AS newyear, month(d) = 12 AND day(d) = 25 AS xmas, (year(d) % 4 = 0 AND year(d) % 100 <> 0) OR year(d) % 400 = 0 AS leap, {_HOLIDAY} AS holiday, isodow(d) < 6 AND NOT ({_HOLIDAY}) AS business FROM (SELECT o_orderkey, o_orderdate::DATE AS d FROM orders)")
def _time_tests(t):
    d = F.to_date("o_orderdate")
    return t("orders").select("o_orderkey", S.is_new_year(d).alias("newyear"), S.is_christmas(d).alias("xmas"), S.is_leap_year(d).alias("leap"), S.is_us_bank_holiday(d).alias("holiday"), S.is_us_business_day(d).alias("business"))


@query("add_weekdays", "SELECT o_orderkey, (SELECT d::VARCHAR FROM (SELECT d, row_number() OVER (ORDER BY d) AS k FROM (SELECT (o_orderdate::DATE + i::INT) AS d FROM range(1, 40) r(i)) WHERE isodow(d) < 6) WHERE k = 13) AS later FROM orders")
def _add_weekdays(t):
    return t("orders").select("o_orderkey", S.add_weekdays(F.to_date("o_orderdate"), 13).cast("string").alias("later"))


# Generators


@query("number_rules", f"""SELECT 'log' AS rule, i AS id, {FIXED('power(2.0, 1 + i * 4 / 9.0)')} AS value FROM range(10) r(i) UNION ALL SELECT 'even', i, {FIXED('1 + i * 0.7')} FROM range(10) r(i) UNION ALL SELECT 'triangle', i - 3, (i * (i + 1) / 2)::DOUBLE FROM range(3, 14) r(i) UNION ALL SELECT 'symmetric', i, (least(i, 8 - i) + 1) / 25.0 FROM range(9) r(i)
    UNION ALL SELECT 'dft', i, {FIXED('CASE WHEN i < 5 THEN i ELSE i - 9 END / (9 * 0.5)')} FROM range(9) r(i)""")
def _rules(t):
    spark = t("region").sparkSession
    kinds = {"log": S.log_space(spark, 10, 1, 5, 2.0), "even": S.even_space(spark, 10, 1.0, 8.0), "triangle": S.triangular_numbers(spark, 100, 3), "symmetric": S.symmetric_numbers(spark, 9, 1.0, True), "dft": S.dft_frequencies(spark, 9, 0.5)}
    made = [df.select(F.lit(n).alias("rule"), "id", (fixed("value") if n in ("log", "even", "dft") else F.col("value").cast("double")).alias("value")) for n, df in kinds.items()]
    return O.pipe(made[0], *[(lambda df, more=m: df.unionByName(more)) for m in made[1:]])


_U = lambda stream=0: f"(('0x' || substr(md5('9:{stream}:' || event_id::VARCHAR), 1, 12))::BIGINT + 0.5) / 281474976710656.0"
_DRAWN = {
    "uniform_real": ({"low": 2.0, "high": 5.0}, f"2 + ({_U()}) * 3"), "uniform_int": ({"low": 3, "high": 9}, "3 + ('0x' || substr(md5('9:0:' || event_id::VARCHAR), 1, 12))::BIGINT % 7"), "bernoulli": ({"p": 0.3}, f"(({_U()}) < 0.3)::INT"),
    "binomial": ({"n": 4, "p": 0.3}, " + ".join(f"(({_U(i)}) < 0.3)::INT" for i in range(4))), "geometric": ({"p": 0.3}, f"floor(-ln({_U()}) / -ln(0.7))"), "exponential": ({"rate": 2.0}, f"-ln({_U()}) / 2"), "weibull": ({"shape": 1.5, "scale": 2.0}, f"2 * power(-ln({_U()}), 1 / 1.5)"),
    "extreme_value": ({}, f"-ln(-ln({_U()}))"), "cauchy": ({}, f"least(1e6, greatest(-1e6, tan(pi() * (({_U()}) - 0.5))))"), "normal": ({"mean": 1.0, "std": 2.0}, f"1 + 2 * sqrt(-2 * ln({_U(1)})) * cos(2 * pi() * ({_U(2)}))"), "lognormal": ({}, f"exp(sqrt(-2 * ln({_U(1)})) * cos(2 * pi() * ({_U(2)})))"),
    "poisson": ({"mean": 1.5}, "(SELECT count(*) FROM (SELECT sum(exp(-1.5) * power(1.5, k) / gamma(k + 1)) OVER (ORDER BY k) AS c FROM range(0, 30) r(k)) WHERE c < " + _U() + ")"),
}


@query("random_columns", "SELECT event_id, " + ", ".join(f"{FIXED(sql, 5)} AS {n}" for n, (_, sql) in _DRAWN.items()) + " FROM events")
def _random(t):
    made = {n: S.random_column(n, F.col("event_id"), 9, **p) for n, (p, _) in _DRAWN.items()}
    made["cauchy"] = F.least(F.lit(1e6), F.greatest(F.lit(-1e6), made["cauchy"]))
    return t("events").select("event_id", *[fixed(x.cast("int") if n == "bernoulli" else x, 5).alias(n) for n, x in made.items()])
