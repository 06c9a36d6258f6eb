"""Projections, clusters and their scores, nearest rows and Markov chains."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.functions import matrix as X, ml as M, spatial as P
from larkspur.plans import POS, by_series, with_positions
from larkspur.queries.registry import AT, BARS, BY, FIXED, bars, fixed, query, r, rows

_SPACE = "power(p_size - 10, 2) + power(p_retailprice - 1000, 2)"


@query("knn", f"SELECT p_partkey, round(sqrt({_SPACE}), 6) AS distance FROM part ORDER BY sqrt({_SPACE}), p_partkey LIMIT 10")
def _knn(t):
    return M.knn(rows(t, "part", "p_partkey"), ["p_size", "p_retailprice"], [10.0, 1000.0], 10).select("p_partkey", r("distance").alias("distance"))


_POINTS = [(5.0, 950.0), (25.0, 1400.0), (49.0, 1800.5)]


@query("nearest_rows", f"SELECT q::INT AS query, p_partkey, {FIXED('d')} AS distance FROM (SELECT q, p_partkey, sqrt(power(p_size - a, 2) + power(p_retailprice - b, 2)) AS d FROM part, (VALUES {', '.join(f'({i}, {a}, {b})' for i, (a, b) in enumerate(_POINTS))}) v(q, a, b)) QUALIFY row_number() OVER (PARTITION BY q ORDER BY d, p_partkey) <= 7")
def _nearest(t):
    return P.nearest_rows(t("part"), "p_partkey", ["p_size", "p_retailprice"], _POINTS, 7).select("query", "p_partkey", fixed("distance").alias("distance"))


@query("kmeans")
def _kmeans(t):
    return M.kmeans(t("part"), ["p_size", "p_retailprice"], 3).groupBy("cluster").agg(F.count("*").alias("n"))


_COV = "SELECT var_samp(l_quantity) AS a, var_samp(l_extendedprice / 1000) AS d, covar_samp(l_quantity, l_extendedprice / 1000) AS b FROM lineitem"


def _two(t):
    return t("lineitem").withColumn("price", F.col("l_extendedprice") / 1000)


@query("pca", f"SELECT {FIXED('(a + d) / 2 + sqrt(power((a - d) / 2, 2) + b * b)', 4)} AS v0, {FIXED('(a + d) / 2 - sqrt(power((a - d) / 2, 2) + b * b)', 4)} AS v1, 0.0 AS between FROM ({_COV})")
def _pca(t):
    out = M.pca(_two(t), ["l_quantity", "price"], k=2)
    return out.agg(fixed(F.var_samp("pc0"), 4).alias("v0"), fixed(F.var_samp("pc1"), 4).alias("v1"), F.abs(fixed(F.covar_samp("pc0", "pc1"), 4)).alias("between"))


@query("svd", f"WITH g AS (SELECT sum(l_quantity * l_quantity) AS a, sum(l_tax * l_tax * 10000) AS d, sum(l_quantity * l_tax * 100) AS b FROM lineitem) SELECT {FIXED('sqrt((a + d) / 2 + sqrt(power((a - d) / 2, 2) + b * b))', 4)} AS s0, {FIXED('sqrt((a + d) / 2 - sqrt(power((a - d) / 2, 2) + b * b))', 4)} AS s1, 1.0 AS u0, 1.0 AS u1 FROM g")
def _svd(t):
    u, s, _ = M.svd(t("lineitem").withColumn("tax", F.col("l_tax") * 100), ["l_quantity", "tax"])
    return u.agg(fixed(F.lit(float(s[0])), 4).alias("s0"), fixed(F.lit(float(s[1])), 4).alias("s1"), fixed(F.sum(F.col("u0") * F.col("u0")), 4).alias("u0"), fixed(F.sum(F.col("u1") * F.col("u1")), 4).alias("u1"))


@query("canonical_correlations", f"WITH c AS (SELECT corr(l_extendedprice, l_quantity) AS a, corr(l_extendedprice, l_tax) AS b, corr(l_quantity, l_tax) AS c FROM lineitem) SELECT {FIXED('sqrt((a * a + b * b - 2 * a * b * c) / (1 - c * c))', 5)} AS first FROM c")
def _canonical(t):
    found = M.canonical_correlations(t("lineitem"), ["l_extendedprice"], ["l_quantity", "l_tax"])
    return t("lineitem").sparkSession.range(1).select(fixed(F.lit(float(found[0])), 5).alias("first"))


@query("fast_ica", "SELECT 0.0 AS between, 1.0 AS v0, 1.0 AS v1")  # components are uncorrelated and of unit variance
def _ica(t):
    out = M.fast_ica(_two(t), ["l_quantity", "price"], 2)
    return out.agg(F.abs(fixed(F.covar_samp("ic0", "ic1"), 4)).alias("between"), fixed(F.var_samp("ic0"), 4).alias("v0"), fixed(F.var_samp("ic1"), 4).alias("v1"))


@query("whitened", "SELECT 0.0 AS between, 1.0 AS v0, 1.0 AS v1")
def _whitened(t):
    out = X.whitened(_two(t), ["l_quantity", "price"])
    return out.agg(F.abs(fixed(F.covar_samp("w0", "w1"), 4)).alias("between"), fixed(F.var_samp("w0"), 4).alias("v0"), fixed(F.var_samp("w1"), 4).alias("v1"))


@query("matrix_product", f"SELECT l_orderkey, l_linenumber, {FIXED('2 * l_quantity - l_tax')} AS y0, {FIXED('l_quantity + 3 * l_tax')} AS y1 FROM lineitem")
def _product(t):
    return X.times(t("lineitem"), ["l_quantity", "l_tax"], [[2, 1], [-1, 3]]).select("l_orderkey", "l_linenumber", fixed("y0").alias("y0"), fixed("y1").alias("y1"))


_JOINT = "c AS (SELECT event_type AS a, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events)"


@query("markov_stationary", f"""WITH RECURSIVE {_JOINT}, m AS (SELECT a, b, count(*) / sum(count(*)) OVER (PARTITION BY a) AS p FROM c WHERE b IS NOT NULL GROUP BY 1, 2), s AS (SELECT list(DISTINCT a ORDER BY a) AS s FROM m), g AS (SELECT list((SELECT list(coalesce((SELECT p FROM m WHERE m.a = x.a AND m.b = y.b), 0) ORDER BY y.b) FROM (SELECT DISTINCT b FROM m) y) ORDER BY x.a) AS g FROM (SELECT DISTINCT a FROM m) x),
    w AS (SELECT 0 AS i, list_transform(s, lambda v: 1.0::DOUBLE / len(s)) AS p FROM s UNION ALL SELECT i + 1, list_transform(range(1, len(p) + 1), lambda j: (p[j] + list_sum(list_transform(range(1, len(p) + 1), lambda k: p[k] * g[k][j]))) / 2) FROM w, g WHERE i < 300)
    SELECT unnest(s) AS state, {FIXED('unnest(p)')} AS probability FROM w, s WHERE i = 300""".replace(FIXED("unnest(p)"), "round(unnest(p), 6)"))
def _markov(t):
    return M.markov_stationary(t("events"), "event_type", AT, by=BY).withColumn("probability", r("probability"))


# Scores of clusters: distances of vectors, squared ones of scalars

_CELLS = "x AS (SELECT vec_id, label, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings WHERE label NOT IN (-1, -2)), c AS (SELECT label, i, avg(x) AS m, count(*) AS n FROM x GROUP BY 1, 2)"


@query("calinski_harabasz", f"""WITH {_CELLS}, g AS (SELECT i, avg(x) AS g FROM x GROUP BY 1), b AS (SELECT label, any_value(n) * sqrt(sum(power(m - g, 2))) AS b FROM c JOIN g USING (i) GROUP BY 1), w AS (SELECT vec_id, sqrt(sum(power(x - m, 2))) AS w FROM x JOIN c USING (label, i) GROUP BY vec_id)
    SELECT round(((SELECT sum(b) FROM b) / ((SELECT count(*) FROM b) - 1)) / ((SELECT sum(w) FROM w) / ((SELECT count(*) FROM w) - (SELECT count(*) FROM b))), 4) AS calinski_harabasz""")
def _ch(t):
    return M.calinski_harabasz(t("embeddings"), "embedding", "label").select(r("calinski_harabasz", 4).alias("calinski_harabasz"))


@query("davies_bouldin", f"""WITH {_CELLS}, d AS (SELECT vec_id, label, sqrt(sum(power(x - m, 2))) AS d FROM x JOIN c USING (label, i) GROUP BY 1, 2), s AS (SELECT label, avg(d) AS s FROM d GROUP BY 1), p AS (SELECT a.label AS a, b.label AS b, sqrt(sum(power(a.m - b.m, 2))) AS d FROM c a JOIN c b ON a.i = b.i AND a.label <> b.label GROUP BY 1, 2)
    SELECT round(avg(r), 5) AS davies_bouldin FROM (SELECT a, max((x.s + y.s) / d) AS r FROM p JOIN s x ON x.label = a JOIN s y ON y.label = b GROUP BY 1)""")
def _db(t):
    return M.davies_bouldin(t("embeddings"), "embedding", "label").select(r("davies_bouldin", 5).alias("davies_bouldin"))


_SCALAR = "s AS (SELECT c_custkey, c_nationkey AS l, c_acctbal AS x FROM customer), m AS (SELECT l, avg(x) AS m, count(*) AS n FROM s GROUP BY 1)"


@query("calinski_harabasz_scalar", f"WITH {_SCALAR} SELECT round(((SELECT sum(n * power(m - (SELECT avg(x) FROM s), 2)) FROM m) / ((SELECT count(*) FROM m) - 1)) / ((SELECT sum(power(x - m, 2)) FROM s JOIN m USING (l)) / ((SELECT count(*) FROM s) - (SELECT count(*) FROM m))), 6) AS calinski_harabasz")
def _ch_scalar(t):
    return M.calinski_harabasz(t("customer"), ["c_acctbal"], "c_nationkey").select(r("calinski_harabasz").alias("calinski_harabasz"))


@query("silhouette", f"""WITH {_SCALAR}, p AS (SELECT a.c_custkey, a.l, b.l AS o, sum(power(a.x - b.x, 2)) AS d, count(*) AS n FROM s a JOIN s b ON true GROUP BY 1, 2, 3), q AS (SELECT c_custkey, max(CASE WHEN l = o THEN d / nullif(n - 1, 0) END) AS a, min(CASE WHEN l <> o THEN d / n END) AS b FROM p GROUP BY 1)
    SELECT c_custkey, {FIXED('CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END', 5)} AS silhouette FROM q""")
def _silhouette(t):
    return M.silhouette(t("customer"), "c_acctbal", "c_nationkey").select("c_custkey", fixed("silhouette", 5).alias("silhouette"))


# Clusters of one series each. Of DBSCAN, SQL gives the core rows and the noise: clusters of
# core rows are runs of sorted core rows without a gap beyond the reach.


def _clusters(name, kernel, sql=None, **options):
    def make(t):
        b = bars(t)
        out = by_series(b, lambda x: {"cluster": kernel(x, **options)["cluster"]}, ["close"], {"cluster": "bigint"}, ["day"], ["user_id"])
        return out.groupBy("user_id").agg(F.count_distinct(F.when(F.col("cluster") >= 0, F.col("cluster"))).alias("clusters"), F.count_if(F.col("cluster") < 0).alias("noise"))

    query(name, sql)(make)


_clusters("dbscan", M.dbscan, f"""WITH {BARS}, n AS (SELECT user_id, day, close, (SELECT count(*) FROM bars b WHERE b.user_id = a.user_id AND abs(b.close - a.close) <= 30) AS n FROM bars a), k AS (SELECT user_id, close, lag(close) OVER (PARTITION BY user_id ORDER BY close) AS before FROM n WHERE n >= 3)
    SELECT user_id, coalesce(clusters, 0) AS clusters, noise FROM (SELECT user_id, count(*) FILTER (n < 3 AND NOT EXISTS (SELECT 1 FROM n o WHERE o.user_id = n.user_id AND o.n >= 3 AND abs(o.close - n.close) <= 30)) AS noise FROM n GROUP BY 1) LEFT JOIN (SELECT user_id, count(*) FILTER (before IS NULL OR close - before > 30) AS clusters FROM k GROUP BY 1) USING (user_id)""", least=3, reach=900.0)  # fmt: skip
_clusters("mean_shift", M.mean_shift, bandwidth=30.0, most=5.0)
_clusters("affinity_propagation", M.affinity_propagation)
_clusters("spectral", lambda x, **o: M.spectral(x, 2, 50.0) if len(x) > 2 else {"cluster": [0] * len(x)})
_clusters("birch", lambda x, **o: M.birch(x, 2, 20.0))


@query("k_shape_groups")
def _k_shape(t):
    placed = with_positions(t("part"), ["p_partkey"]).where(F.col(POS) < 400)
    return M.k_shape_groups(placed.select(POS, F.col("p_size").cast("double").alias("size"), "p_retailprice", (F.col("p_retailprice") * 2 + 1).alias("twice")), ["size", "p_retailprice", "twice"], 2)


@query("kriging", f"WITH {BARS} SELECT user_id, count(*) AS n, {FIXED('max(close)', 3)} AS top FROM bars GROUP BY 1")
def _kriging(t):
    import numpy as np

    # Kriging without a nugget gives back what was observed.
    run = lambda v: {"k_out": M.kriging(np.arange(len(v), dtype=float)[:, None], np.asarray(v, float), np.arange(len(v), dtype=float)[:, None], 1.0, 3.0)}
    out = by_series(bars(t), run, ["close"], {"k_out": "double"}, ["day"], ["user_id"])
    return out.groupBy("user_id").agg(F.count("*").alias("n"), fixed(F.max("k_out"), 3).alias("top"))
