"""Clustering, projections and scores.

What grows with the rows is an aggregate or a pyspark.ml model; the driver only solves
systems whose size is the number of columns. Methods that compare all pairs (affinity
propagation, spectral clustering, kriging) are kernels for one series at a time and hold
its pairs in one task.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from larkspur.plans import POS, by_series, joined_back, summarised

# By aggregates


def moments(df: DataFrame, names: Sequence[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, means and covariance of columns, in one aggregate."""
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    one = df.agg(F.count("*").alias("n"), *[F.avg(c).alias(f"m_{c}") for c in names], *[F.covar_samp(a, b).alias(f"{a}|{b}") for a, b in pairs]).first()
    cov = np.zeros((len(names), len(names)))
    for a, b in pairs:
        i, j = names.index(a), names.index(b)
        cov[i, j] = cov[j, i] = one[f"{a}|{b}"]
    return one["n"], np.array([one[f"m_{c}"] for c in names]), cov


def _projected(df: DataFrame, names: Sequence[str], means: np.ndarray, axes: np.ndarray, prefix: str) -> DataFrame:
    """Rows times ``axes``, as plain expressions."""
    return df.select("*", *[sum(((F.col(c) - float(m)) * float(w) for c, m, w in zip(names, means, axis)), F.lit(0.0)).alias(f"{prefix}{i}") for i, axis in enumerate(axes.T)])


def _signed(v: np.ndarray) -> np.ndarray:
    return v * np.where(v[np.abs(v).argmax(0), np.arange(v.shape[1])] < 0, -1, 1)


def pca(df: DataFrame, names: Sequence[str], explained: float = 0.9, k: int | None = None) -> DataFrame:
    """Adds pc0, pc1, ...: as many as explain the given share, or k."""
    _, means, cov = moments(df, list(names))
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values)
    values, vectors = values[order], _signed(vectors[:, order])
    k = k or int(np.searchsorted(np.cumsum(values) / values.sum(), explained - 1e-12) + 1)
    return _projected(df, names, means, vectors[:, :k], "pc")


def svd(df: DataFrame, names: Sequence[str]) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """U as columns u0, u1, ..., and the singular values and right vectors, from the Gram matrix."""
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    one = df.agg(*[F.sum(F.col(a) * F.col(b)).alias(f"{a}|{b}") for a, b in pairs]).first()
    g = np.zeros((len(names), len(names)))
    for a, b in pairs:
        i, j = names.index(a), names.index(b)
        g[i, j] = g[j, i] = one[f"{a}|{b}"]
    values, v = np.linalg.eigh(g)
    order = np.argsort(-values)
    s, v = np.sqrt(np.maximum(values[order], 0)), _signed(v[:, order])
    return _projected(df, names, np.zeros(len(names)), v / np.maximum(s, 1e-300), "u"), s, v


def canonical_correlations(df: DataFrame, xs: Sequence[str], ys: Sequence[str]) -> np.ndarray:
    _, _, cov = moments(df, [*xs, *ys])
    p = len(xs)
    a, b, c = cov[:p, :p], cov[p:, p:], cov[:p, p:]
    return np.sqrt(np.clip(np.sort(np.linalg.eigvals(np.linalg.solve(a, c) @ np.linalg.solve(b, c.T)).real)[::-1][: min(p, len(ys))], 0, 1))


def fast_ica(df: DataFrame, names: Sequence[str], k: int, loops: int = 50, seed: int = 0) -> DataFrame:
    """Adds ic0, ic1, ...: fixed-point iterations with tanh; each one is one aggregate over the whitened rows."""
    _, means, cov = moments(df, list(names))
    values, vectors = np.linalg.eigh(cov)
    white = vectors[:, np.argsort(-values)[:k]] / np.sqrt(np.maximum(np.sort(values)[::-1][:k], 1e-12))
    z = _projected(df, names, means, white, "__z").select(*[f"__z{i}" for i in range(k)])
    w = np.linalg.qr(np.random.default_rng(seed).normal(size=(k, k)))[0]
    for _ in range(loops):
        g = [F.tanh(sum((F.col(f"__z{j}") * float(w[j, i]) for j in range(k)), F.lit(0.0))) for i in range(k)]
        one = z.agg(*[F.avg(F.col(f"__z{j}") * g[i]).alias(f"a{j}_{i}") for i in range(k) for j in range(k)], *[F.avg(1 - g[i] * g[i]).alias(f"d{i}") for i in range(k)]).first()
        new = np.array([[one[f"a{j}_{i}"] - one[f"d{i}"] * w[j, i] for i in range(k)] for j in range(k)])
        u, _, vt = np.linalg.svd(new)
        new = u @ vt
        done = np.abs(np.abs((new * w).sum(0)) - 1).max() < 1e-6
        w = new
        if done:
            break
    return _projected(df, names, means, white @ w, "ic")


def distance(names: Sequence[str], target: Sequence[float]) -> Column:
    return F.sqrt(sum(((F.col(c) - float(t)) ** 2 for c, t in zip(names, target)), F.lit(0.0)))


def knn(df: DataFrame, names: Sequence[str], target: Sequence[float], k: int) -> DataFrame:
    return df.withColumn("distance", distance(names, target)).orderBy("distance", POS).limit(k)


def vector_distance(x: Column, target: Sequence[float]) -> Column:
    d = F.zip_with(x, F.array(*[F.lit(float(t)) for t in target]), lambda a, b: (a.cast("double") - b) * (a.cast("double") - b))
    return F.sqrt(F.aggregate(d, F.lit(0.0), lambda s, v: s + v))


def markov_stationary(df: DataFrame, name: str, order: str | Sequence[str] = POS, loops: int = 1000, epsilon: float = 1e-12, by: Sequence[str] = ()) -> DataFrame:
    """Stationary distribution of the states of a column from counts of its transitions, within each series of ``by``."""
    at = Window.partitionBy(*by).orderBy(*([order] if isinstance(order, str) else order))
    pairs = df.select(F.col(name).alias("a"), F.lead(name).over(at).alias("b")).where("b IS NOT NULL").groupBy("a", "b").agg(F.count("*").alias("n")).collect()
    states = sorted({r["a"] for r in pairs} | {r["b"] for r in pairs})
    m = np.zeros((len(states), len(states)))
    for r in pairs:
        m[states.index(r["a"]), states.index(r["b"])] = r["n"]
    m = m / np.maximum(m.sum(1, keepdims=True), 1)
    p = np.full(len(states), 1 / len(states))
    for _ in range(loops):
        new = (p + p @ m) / 2
        if np.abs(new - p).max() < epsilon:
            break
        p = new
    return df.sparkSession.createDataFrame([(s, float(v)) for s, v in zip(states, p)], ["state", "probability"])


def kmeans(df: DataFrame, names: Sequence[str], k: int, seed: int = 1, loops: int = 20) -> DataFrame:
    """Adds the column cluster."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    rows = VectorAssembler(inputCols=list(names), outputCol="__v").transform(df)
    return KMeans(k=k, seed=seed, maxIter=loops, featuresCol="__v", predictionCol="cluster").fit(rows).transform(rows).drop("__v")


def _clusters(df: DataFrame, vector: Column, label: str) -> DataFrame:
    """Rows that are no noise (labels -1 and -2) as __l and __x, an array, with their cluster's size __n and centre __c."""
    real = df.where(~F.col(label).isin(-1, -2)).select(F.col(label).alias("__l"), vector.alias("__x"))
    cells = real.select("__l", F.posexplode("__x").alias("i", "x")).groupBy("__l", "i").agg(F.avg("x").alias("m"), F.count(F.lit(1)).alias("n"))
    centres = cells.groupBy("__l").agg(F.max("n").alias("__n"), F.array_sort(F.collect_list(F.struct("i", "m"))).alias("c")).select("__l", "__n", F.col("c.m").alias("__c"))
    return joined_back(real, centres, ["__l"])


def _away(a: Column, b: Column) -> Column:
    """Squared distance of scalars (arrays of one element), distance of longer vectors."""
    squares = F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, v: s + v)
    return F.when(F.size(a) == 1, squares).otherwise(F.sqrt(squares))


def _vector(names: Sequence[str] | str) -> Column:
    return F.col(names) if isinstance(names, str) else F.array(*[F.col(c).cast("double") for c in names])


def calinski_harabasz(df: DataFrame, names: Sequence[str] | str, label: str) -> DataFrame:
    """Distances of centres to the whole's centre over distances of rows to theirs; ``names`` are columns or one array column."""
    rows = _clusters(df, _vector(names), label)
    per = rows.groupBy("__l").agg(F.first("__n").alias("n"), F.first("__c").alias("c"), F.sum(_away(F.col("__x"), F.col("__c"))).alias("w"))
    whole = rows.select(F.posexplode("__x").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m")).agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("g")).select(F.col("g.m").alias("g"))
    k, n = F.count("*"), F.sum("n")
    return joined_back(per, whole).agg(((F.sum(F.col("n") * _away(F.col("c"), F.col("g"))) / (k - 1)) / (F.sum("w") / (n - k))).alias("calinski_harabasz"))


def davies_bouldin(df: DataFrame, names: Sequence[str] | str, label: str) -> DataFrame:
    """Mean over clusters of the worst ratio of scatters to distance; only centres are paired."""
    per = _clusters(df, _vector(names), label).groupBy("__l").agg(F.first("__c").alias("c"), F.avg(_away(F.col("__x"), F.col("__c"))).alias("s"))
    a, b = per.select(F.col("__l").alias("a"), F.col("c").alias("ca"), F.col("s").alias("sa")), per.select(F.col("__l").alias("b"), F.col("c").alias("cb"), F.col("s").alias("sb"))
    pairs = a.join(b, F.col("a") != F.col("b")).groupBy("a").agg(F.max((F.col("sa") + F.col("sb")) / _away(F.col("ca"), F.col("cb"))).alias("r"))
    return pairs.agg(F.avg("r").alias("davies_bouldin"))


def silhouette(df: DataFrame, name: str, label: str, out: str = "silhouette") -> DataFrame:
    """Adds how much nearer a row is to its own cluster than to the next one, by squared distances.

    The mean squared distance to a cluster follows from its count, sum and sum of squares,
    so rows meet clusters and not each other. Noise, and rows of a cluster of one, have 0.
    """
    x, noise = F.col(name).cast("double"), F.col(label).isin(-1, -2)
    sums = df.where(~noise).groupBy(F.col(label).alias("l")).agg(F.count(x).cast("double").alias("n"), F.sum(x).alias("s"), F.sum(x * x).alias("q"))
    one = sums.agg(F.collect_list(F.struct("l", "n", "s", "q")).alias("__all"))
    far = lambda c: F.greatest(c["n"] * x * x - 2 * x * c["s"] + c["q"], F.lit(0.0))
    own = F.element_at(F.filter("__all", lambda c: c["l"] == F.col(label)), 1)
    a = far(own) / (own["n"] - 1)
    b = F.array_min(F.transform(F.filter("__all", lambda c: c["l"] != F.col(label)), lambda c: far(c) / c["n"]))
    score = F.when(noise | (F.size("__all") < 2) | (own["n"] < 2), 0.0).otherwise(F.coalesce(F.try_divide(b - a, F.greatest(a, b)), F.lit(0.0)))
    return joined_back(df, one).withColumn(out, score).drop("__all")


# Kernels on one series


def _within(x, reach):
    """Where the run of sorted rows begins and ends whose squared distance from each sorted row is at most ``reach``, as doubles subtract."""
    u, first, many = np.unique(x, return_index=True, return_counts=True)
    low, high = np.searchsorted(u, u - math.sqrt(reach), "left"), np.searchsorted(u, u + math.sqrt(reach), "right") - 1
    near = lambda at: (u - u[np.clip(at, 0, len(u) - 1)]) ** 2 <= reach
    # The sums round otherwise than the differences, so that some bounds are a value or two off.
    for ends, step, last in ((low, -1, 0), (high, 1, len(u) - 1)):
        while (more := near(ends + step) & (ends != last)).any():
            ends += step * more
        while (less := ((u - u[ends]) ** 2 > reach)).any():
            ends -= step * less
    return np.repeat(first[low], many), np.repeat(first[high] + many[high], many)


def dbscan(x, least=3, reach=1.0):
    """Clusters by density; scalars are compared by squared distance; -1 is noise. Neighbours are runs of the sorted rows."""
    x = np.asarray(x, float)
    order = np.argsort(x, kind="stable")
    place = np.empty(len(x), np.int64)
    place[order] = np.arange(len(x))
    low, high = (ends[place] for ends in _within(x[order], reach))
    core = high - low >= least
    out, cluster = np.full(len(x), -1), -1
    for i in np.flatnonzero(core):
        if out[i] >= 0:
            continue
        cluster += 1
        todo = [i]
        while todo:
            j = todo.pop()
            if out[j] < 0:
                out[j] = cluster
                if core[j]:
                    near = order[low[j] : high[j]]
                    todo += near[out[near] < 0].tolist()
    return {"cluster": out}


#: Weights of a row at the distance u, in bandwidths.
KERNELS = {
    "gaussian": lambda u: np.exp(-0.5 * u * u), "uniform": lambda u: (np.abs(u) <= 1) * 1.0, "triangular": lambda u: np.maximum(1 - np.abs(u), 0), "parabolic": lambda u: np.maximum(1 - u * u, 0),
    "biweight": lambda u: np.maximum(1 - u * u, 0) ** 2, "triweight": lambda u: np.maximum(1 - u * u, 0) ** 3, "tricube": lambda u: np.maximum(1 - np.abs(u) ** 3, 0) ** 3,
    "cosine": lambda u: (np.abs(u) <= 1) * np.cos(np.pi * np.clip(u, -1, 1) / 2), "logistic": lambda u: 1 / (np.exp(u) + 2 + np.exp(-u)), "sigmoid": lambda u: 1 / (np.exp(u) + np.exp(-u)),
    "silverman": lambda u: 0.5 * np.exp(-np.abs(u) / math.sqrt(2)) * np.sin(np.abs(u) / math.sqrt(2) + np.pi / 4),
}


def mean_shift(x, bandwidth=1.0, most=0.1, loops=50, kernel="gaussian"):
    """Rows move to the weighted mean of those around them; targets that end within ``most`` of each other are one cluster."""
    x = np.asarray(x, float)
    p = x.copy()
    for _ in range(loops):
        new = np.empty(len(p))
        for at in range(0, len(p), 1024):
            w = KERNELS[kernel]((p[at : at + 1024, None] - x[None]) / bandwidth)
            new[at : at + 1024] = (w * x).sum(1) / np.maximum(w.sum(1), 1e-300)
        done = np.abs(new - p).max(initial=0) < 1e-7
        p = new
        if done:
            break
    order = np.argsort(p)
    label = np.zeros(len(x), np.int64)
    label[order] = np.cumsum(np.concatenate([[0], np.diff(p[order]) > most]))[: len(x)]
    return {"cluster": label}


def affinity_propagation(x, loops=200, damping=0.7):
    x, n = np.asarray(x, float), len(x)
    s = -((x[:, None] - x[None]) ** 2)
    s[np.diag_indices(n)] = np.median(s[~np.eye(n, dtype=bool)]) if n > 1 else 0
    r, a = np.zeros((n, n)), np.zeros((n, n))
    for _ in range(loops):
        v = a + s
        best = v.argmax(1)
        first = v[np.arange(n), best]
        v[np.arange(n), best] = -np.inf
        new = s - first[:, None]
        new[np.arange(n), best] = s[np.arange(n), best] - v.max(1)
        r = damping * r + (1 - damping) * new
        p = np.maximum(r, 0)
        p[np.diag_indices(n)] = r[np.diag_indices(n)]
        new = np.minimum(0, p.sum(0)[None] - p)
        new[np.diag_indices(n)] = (p.sum(0) - p[np.diag_indices(n)])
        a = damping * a + (1 - damping) * new
    centres = (a + r).argmax(1)
    return {"cluster": np.unique(centres, return_inverse=True)[1]}


def _lloyd(rows, k, seed=0, loops=100):
    rng = np.random.default_rng(seed)
    centres = rows[rng.choice(len(rows), 1)]
    while len(centres) < min(k, len(rows)):
        d = ((rows[:, None] - centres[None]) ** 2).sum(2).min(1)
        centres = np.vstack([centres, rows[rng.choice(len(rows), p=d / d.sum() if d.sum() else None)]])
    for _ in range(loops):
        label = ((rows[:, None] - centres[None]) ** 2).sum(2).argmin(1)
        new = np.array([rows[label == i].mean(0) if (label == i).any() else centres[i] for i in range(len(centres))])
        if np.allclose(new, centres):
            break
        centres = new
    return label


def spectral(x, k=2, sigma=1.0, seed=0):
    x = np.asarray(x, float)
    w = np.exp(-((x[:, None] - x[None]) ** 2) / (2 * sigma**2))
    d = 1 / np.sqrt(w.sum(1))
    _, v = np.linalg.eigh(w * d[:, None] * d[None])
    u = v[:, -k:]
    return {"cluster": _lloyd(u / np.maximum(np.linalg.norm(u, axis=1, keepdims=True), 1e-12), k, seed)}


def birch(x, k=2, threshold=0.5, seed=0):
    """Features (count, sum, squares) that rows join while the radius stays below the threshold; then k-means of their centres."""
    x = np.asarray(x, float)
    n, s, q, own = [], [], [], np.zeros(len(x), np.int64)
    for i, v in enumerate(x):
        if n:
            j = int(np.argmin(np.abs(np.array(s) / np.array(n) - v)))
            m = n[j] + 1
            if math.sqrt(max(0, (q[j] + v * v) / m - ((s[j] + v) / m) ** 2)) <= threshold:
                n[j], s[j], q[j], own[i] = m, s[j] + v, q[j] + v * v, j
                continue
        n.append(1), s.append(v), q.append(v * v)
        own[i] = len(n) - 1
    return {"cluster": _lloyd((np.array(s) / np.array(n))[:, None], k, seed)[own]}


def k_shape(columns: np.ndarray, k: int, loops: int = 30, seed: int = 0) -> np.ndarray:
    """Clusters whole columns (axis 0) by the largest normalised cross-correlation."""
    z = (columns - columns.mean(1, keepdims=True)) / np.maximum(columns.std(1, keepdims=True), 1e-12)
    size = 1 << (2 * z.shape[1] - 1).bit_length()

    def best(a, b):
        c = np.fft.irfft(np.fft.rfft(a, size) * np.conj(np.fft.rfft(b, size)), size)
        at = int(c.argmax())
        return c[at] / max(np.linalg.norm(a) * np.linalg.norm(b), 1e-12), at - size if at > size // 2 else at

    label = np.random.default_rng(seed).integers(0, k, len(z))
    for _ in range(loops):
        centres = []
        for g in range(k):
            own = z[label == g]
            if not len(own):
                centres.append(z[g % len(z)])
                continue
            own = np.stack([np.roll(v, -best(v, own[0])[1]) for v in own])
            vec = np.linalg.eigh(own.T @ own)[1][:, -1]
            centres.append(vec if (own[0] - vec) @ (own[0] - vec) < (own[0] + vec) @ (own[0] + vec) else -vec)
        new = np.array([int(np.argmax([best(v, c)[0] for c in centres])) for v in z])
        if (new == label).all():
            break
        label = new
    return label


def kriging(coordinates: np.ndarray, values: np.ndarray, targets: np.ndarray, sill: float = 1.0, reach: float = 1.0, nugget: float = 0.0, model: str = "exponential") -> np.ndarray:
    """Ordinary kriging of ``targets``."""
    def gamma(h):
        h = h / reach
        f = {"exponential": 1 - np.exp(-3 * h), "gaussian": 1 - np.exp(-3 * h * h), "spherical": np.where(h < 1, 1.5 * h - 0.5 * h**3, 1.0), "linear": np.minimum(h, 1.0), "power": h**1.5, "nugget": (h > 0) * 1.0, "hole_effect": 1 - np.sinc(h)}[model]
        return np.where(h > 0, nugget + sill * f, 0.0)

    d = np.linalg.norm(coordinates[:, None] - coordinates[None], axis=2)
    n = len(values)
    a = np.ones((n + 1, n + 1))
    a[:n, :n], a[n, n] = gamma(d), 0
    b = np.ones((n + 1, len(targets)))
    b[:n] = gamma(np.linalg.norm(coordinates[:, None] - targets[None], axis=2))
    return np.linalg.lstsq(a, b, rcond=None)[0][:n].T @ values


def k_shape_groups(df: DataFrame, names: Sequence[str], k: int, order: str = POS, seed: int = 0) -> DataFrame:
    """The group of each of the columns ``names`` by the shape of its values in order; the columns meet in one task."""
    def run(*arrays):
        return {"names": list(names), "groups": k_shape(np.stack([np.asarray(a, float) for a in arrays]), k, seed=seed).tolist()}

    one = summarised(df, run, list(names), {"names": "array<string>", "groups": "array<int>"}, order)
    return one.select(F.explode(F.arrays_zip("names", "groups")).alias("r")).select(F.col("r.names").alias("name"), F.col("r.groups").alias("group"))


def split_by(df: DataFrame, kernel, name: str, order: str | Sequence[str] = POS, by: Sequence[str] = (), **options) -> DataFrame:
    """Adds ``cluster`` from one of the kernels above, run on each series of a column; a frame of each is a filter away."""
    return by_series(df, kernel, [name], {"cluster": "bigint"}, order, by, **options)
