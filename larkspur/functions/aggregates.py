"""Aggregates over one or more columns, as Column expressions unless a second pass is needed."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from larkspur.functions.scalars import erf
from larkspur.operators.frame import quantiles
from larkspur.plans import POS, Ranges, blocked, joined_back, missing, ordered, with_positions, with_running_totals


def clean(x: Column) -> Column:
    return F.when(~missing(x), x)


def first(x: Column, order: str = POS) -> Column:
    return F.min_by(x, F.col(order))


def last(x: Column, order: str = POS) -> Column:
    return F.max_by(x, F.col(order))


def extremum(x: Column, index: Column, smallest: bool = False) -> Column:
    return F.struct((F.min(x) if smallest else F.max(x)).alias("value"), (F.min_by(index, x) if smallest else F.max_by(index, x)).alias("index"))


def stable_mean(x: Column) -> Column:
    """The mean by exact sums with 16 decimals, in which the order of rows doesn't show; the plain one for values beyond them."""
    exact = x.cast("double").try_cast("decimal(38,16)")
    return F.when(F.count(exact) == F.count(x), F.avg(exact).cast("double")).otherwise(F.avg(x))


def product(x: Column) -> Column:
    """Of the values that are there; null without any."""
    return F.product(x)


def weighted_mean(x: Column, rank: Column) -> Column:
    """Mean with weights 1 to n by ``rank``, a 1-based row number."""
    n = F.count(x)
    return F.sum(x * rank) / (n * (n + 1) / 2)


def geometric_mean(x: Column) -> Column:
    return F.exp(F.avg(F.log(x)))


def harmonic_mean(x: Column) -> Column:
    return F.count(x) / F.sum(1 / x)


def quadratic_mean(x: Column) -> Column:
    return F.sqrt(F.sum(x * x)) / F.sqrt(F.count(x))


def euclidean_norm(x: Column) -> Column:
    return F.sqrt(F.sum(x * x))


def beta(x: Column, benchmark: Column) -> Column:
    v = F.var_samp(benchmark)
    return F.when(v != 0, F.covar_samp(x, benchmark) / v)


def sem(x: Column) -> Column:
    return F.stddev_samp(x) / F.sqrt(F.count(x))


def tracking_error(x: Column, y: Column) -> Column:
    return F.stddev_samp(x - y)


def dot(x: Column, y: Column) -> Column:
    return F.struct(
        F.sum(x * y).alias("dot"), F.sqrt(F.sum(x * x)).alias("magnitude1"), F.sqrt(F.sum(y * y)).alias("magnitude2"),
        F.sqrt(F.sum((x - y) * (x - y))).alias("euclidean"), F.sum(F.abs(x - y)).alias("manhattan"),
    )


def stats(x: Column) -> Column:
    return F.struct(F.count(x).alias("count"), F.avg(x).alias("mean"), F.var_samp(x).alias("variance"), F.stddev_samp(x).alias("std"), F.skewness(x).alias("skew"), F.kurtosis(x).alias("kurtosis"))


def coefficient_of_variation(x: Column) -> Column:
    return F.stddev_samp(x) / F.avg(x)


def t_test(x: Column, y: Column, related: bool) -> Column:
    n = F.count(x + y)
    if related:
        return F.struct((F.avg(x - y) / (F.stddev_samp(x - y) / F.sqrt(n))).alias("t"), (n - 1).cast("double").alias("freedom"))
    a, b = F.var_samp(x) / F.count(x), F.var_samp(y) / F.count(y)
    return F.struct(((F.avg(x) - F.avg(y)) / F.sqrt(a + b)).alias("t"), (F.count(x) + F.count(y) - 2).cast("double").alias("freedom"))


def chi_squared(observed: Column, expected: Column) -> Column:
    return F.sum(F.when(expected != 0, (observed - expected) * (observed - expected) / expected))


def jarque_bera(x: Column) -> Column:
    jb = F.count(x) / 6 * (F.skewness(x) * F.skewness(x) + F.kurtosis(x) * F.kurtosis(x) / 4)
    return F.struct(jb.alias("statistic"), F.exp(-jb / 2).alias("p_value"))


def regression(x: Column, y: Column) -> Column:
    """Slope, intercept and correlation of y on x."""
    return F.struct(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.corr(x, y).alias("corr"))


def log_fit(x: Column, y: Column) -> Column:
    return regression(F.log(x), y)


def exponential_fit(x: Column, y: Column) -> Column:
    """y = exp(intercept + slope * x)."""
    return regression(x, F.log(y))


def power_fit(x: Column, y: Column) -> Column:
    """y = exp(intercept) * x ^ slope."""
    return regression(F.log(x), F.log(y))


def sharpe(asset: Column, benchmark: Column, downside: bool = False, least: float = 0.0) -> Column:
    excess = asset - benchmark
    if not downside:
        return F.avg(excess) / F.stddev_samp(excess)
    low = F.least(excess - least, F.lit(0.0))
    return (F.avg(excess) - least) / F.sqrt(F.sum(low * low) / F.count(excess))


def treynor(asset: Column, benchmark: Column) -> Column:
    return F.avg(asset - benchmark) / beta(asset, benchmark)


def loss(kind: str, actual: Column, model: Column) -> Column:
    d = actual - model
    n = F.count(d)
    return {
        "kullback_leibler": F.sum(actual * F.log(F.try_divide(actual, model))), "mean_abs_error": F.avg(F.abs(d)), "mean_sqr_error": F.avg(d * d),
        "mean_sqr_log_error": F.avg(F.pow(F.log1p(actual) - F.log1p(model), 2)), "cross_entropy": -F.sum(actual * F.log(model)) / n,
        "binary_cross_entropy": -F.avg(actual * F.log(model) + (1 - actual) * F.log(1 - model)), "categorical_hinge": F.greatest(F.max((1 - actual) * model) - F.sum(actual * model) + 1, F.lit(0.0)),
        "cosine_similarity": F.sum(actual * model) / (F.sqrt(F.sum(actual * actual)) * F.sqrt(F.sum(model * model))), "log_cosh": F.avg(F.log(F.cosh(model - actual))),
    }[kind]


def policy_loss(df: DataFrame, probability: str, reward: str, baseline: str = "none", value: float | None = None, out: str = "loss") -> DataFrame:
    """Adds -log(p) * (reward - baseline) / scale; the baseline is none, constant, mean or standardize, which also scales."""
    if baseline == "constant" and value is None:
        raise ValueError("the constant baseline needs a value")
    one = df.agg(F.avg(reward).alias("__m"), F.stddev_samp(reward).alias("__s"))
    adjust = {"none": F.lit(0.0), "constant": F.lit(value), "mean": F.col("__m"), "standardize": F.col("__m")}[baseline]
    loss_ = -F.log(probability) * (F.col(reward) - adjust) / (F.col("__s") if baseline == "standardize" else F.lit(1.0))
    return joined_back(df, one).withColumn(out, loss_).drop("__m", "__s")


def similarity(kind: str, x: Column, y: Column) -> Column:
    return {
        "euclidean_dist": F.sqrt(F.sum((x - y) * (x - y))), "manhattan_dist": F.sum(F.abs(x - y)), "dot_product": F.sum(x * y), "simple_similarity": F.avg((x == y).cast("double")),
        "cosine_similarity": F.sum(x * y) / F.sqrt(F.sum(x * x) * F.sum(y * y)), "hamming_dist": F.count_if(x != y),
        "jaccard_similarity": F.size(F.array_intersect(F.collect_set(x), F.collect_set(y))) / F.size(F.array_union(F.collect_set(x), F.collect_set(y))),
    }[kind]


# Two passes, and results of several rows


def mode(df: DataFrame, name: str, n: int = 1) -> DataFrame:
    return df.groupBy(F.col(name).alias("value")).agg(F.count("*").alias("count"), F.min(POS).alias("first")).orderBy(F.desc("count"), "first").limit(n).select("value", "count")


def mad(df: DataFrame, name: str, centre: str = "median", spread: str = "median") -> DataFrame:
    """Mean or median of the absolute deviations from the mean or median."""
    one = (quantiles(df, name, [0.5]) if centre == "median" else df.agg(F.avg(clean(F.col(name))).alias("q0"))).withColumnRenamed("q0", "__c")
    away = joined_back(df, one).select(F.abs(F.col(name) - F.col("__c")).alias("mad"))
    return quantiles(away, "mad", [0.5]).withColumnRenamed("q0", "mad") if spread == "median" else away.agg(F.avg(clean(F.col("mad"))).alias("mad"))


def kth_value(df: DataFrame, name: str, k: int, skip_missing: bool = False, by: Sequence[str] = ()) -> DataFrame:
    """The k-th least value; with missing rows left out, k shrinks by their share."""
    x = F.col(name)
    sizes = df.groupBy(*by).agg(F.count("*").alias("__all"), F.count(clean(x)).alias("__known"))
    counts = df.where(~missing(x)).groupBy(*by, x.alias("kth")).agg(F.count("*").alias("__c"))
    ranges = Ranges(df.where(~missing(x)).select(*by, x.alias("kth")), [*by, "kth"], split_ties=False)
    upto = with_running_totals(counts, [*by, "kth"], {"__hi": "__c"}, ranges)
    start = joined_back(upto, upto.groupBy(*by).agg(F.min(F.col("__hi") - F.col("__c")).alias("__lo")), by)
    place = F.round(F.lit(float(k)) * F.col("__known") / F.col("__all")) if skip_missing else F.lit(float(k))
    here = F.col("__hi") - F.col("__lo")
    return joined_back(start, sizes, by).where((here - F.col("__c") < place) & (place <= here)).select(*by, "kth")


def n_extremum(df: DataFrame, name: str, n: int, smallest: bool = False, order: str = POS) -> DataFrame:
    """The n largest (smallest) values with their places, best first."""
    x = F.col(name)
    return df.where(~missing(x)).orderBy(x.asc() if smallest else x.desc(), order).limit(n).select(order, name)


def ranks(df: DataFrame, name: str, policy: str = "actual", order: str = POS, by: Sequence[str] = (), out: str = "rank") -> DataFrame:
    """Adds the 0-based rank: actual, first, last or average of equal values.

    Counts of distinct values are summed up over ranges of the values, so that neither a
    table without a series key nor a value that many rows hold is one task's work.
    """
    counts = df.groupBy(*by, name).agg(F.count("*").alias("__c"))
    ranges = Ranges(df.select(*by, name), [*by, name], split_ties=False)
    upto = with_running_totals(counts, [*by, name], {"__hi": "__c"}, ranges)
    placed = joined_back(upto, upto.groupBy(*by).agg(F.min(F.col("__hi") - F.col("__c")).alias("__lo")), by)
    last = F.col("__hi") - F.col("__lo") - 1
    first = last - F.col("__c") + 1
    if policy == "actual":
        rows = with_positions(df, [*by, name, order], "__at")
        return joined_back(rows, upto.groupBy(*by).agg(F.min(F.col("__hi") - F.col("__c")).alias("__lo")), by).withColumn(out, F.col("__at") - F.col("__lo")).drop("__at", "__lo")
    rank = {"first": first, "last": last, "average": (first + last) / 2}[policy]
    return joined_back(df, placed.select(*by, name, rank.alias("__r")), [*by, name]).withColumnRenamed("__r", out)


def spearman(df: DataFrame, a: str, b: str, order: str = POS) -> DataFrame:
    """From ranks without averaging of ties: 1 - 6 * sum(d ^ 2) / (n * (n ^ 2 - 1))."""
    both = with_positions(with_positions(df, [a, order], "__a"), [b, order], "__b")
    d, n = (F.col("__a") - F.col("__b")).cast("double"), F.count("*").cast("double")
    return both.agg((1 - 6 * F.sum(d * d) / (n * (n * n - 1))).alias("spearman"))


def _series_windows(df: DataFrame, order: str | Sequence[str], by: Sequence[str], reach: int) -> tuple[DataFrame, list[str], str | Sequence[str]]:
    """Rows, the keys of windows that reach ``reach`` rows back, and their order; a series without a key is dealt out in blocks."""
    if by:
        return df.withColumn("__own", F.lit(True)), list(by), order
    placed = df if order == POS and POS in df.columns else with_positions(df, order)
    return blocked(placed, reach), ["__block"], POS


def cross_correlation(df: DataFrame, a: str, b: str, low: int, high: int, order: str | Sequence[str] = POS, by: Sequence[str] = ()) -> DataFrame:
    """Correlation at each lag from ``low`` up to but without ``high``; a negative lag shifts the first column."""
    rows, keys, at = _series_windows(df, order, by, max(abs(low), abs(high - 1)))
    w = ordered(at, keys)
    lags = range(low, high)
    shifted = rows.select(*by, "__own", F.col(a).alias("a"), F.col(b).alias("b"), *[(F.lag(b, k) if k >= 0 else F.lag(a, -k)).over(w).alias(f"l{k}") for k in lags]).where("__own")
    picks = [F.struct(F.lit(k).alias("lag"), F.corr("a" if k >= 0 else "b", f"l{k}").alias("corr")) for k in lags]
    return shifted.groupBy(*by).agg(F.array(*picks).alias("r")).select(*by, F.explode("r").alias("r")).select(*by, "r.*")


def autocorrelation(df: DataFrame, name: str, max_lag: int, order: str | Sequence[str] = POS, by: Sequence[str] = ()) -> DataFrame:
    return cross_correlation(df, name, name, 0, max_lag, order, by)


def sample_z_score(df: DataFrame, population: str, sample: str) -> DataFrame:
    return df.agg(((F.avg(sample) - F.avg(population)) / (F.stddev_samp(population) / F.sqrt(F.count(sample)))).alias("z"))


def mutual_information(df: DataFrame, a: str, b: str, base: float = 2) -> DataFrame:
    pairs = df.groupBy(a, b).agg(F.count("*").alias("n"))
    sized = joined_back(joined_back(joined_back(pairs, df.groupBy(a).agg(F.count("*").alias("__a")), [a]), df.groupBy(b).agg(F.count("*").alias("__b")), [b]), df.agg(F.count("*").alias("__t")))
    p, pa, pb = (F.col(c) / F.col("__t") for c in ("n", "__a", "__b"))
    return sized.agg(F.sum(p * F.log(p / (pa * pb)) / math.log(base)).alias("mutual_information"))


def _pooled(df: DataFrame, a: str, b: str) -> DataFrame:
    """Distinct values x of both columns with their counts a and b and the running sums of these, a_upto and b_upto."""
    side = lambda name, s: F.struct(F.lit(s).alias("s"), F.col(name).cast("double").alias("x"))
    long = df.select(F.explode(F.array(side(a, 1), side(b, 0))).alias("v")).select("v.*").where(~missing(F.col("x")))
    counts = long.groupBy("x").agg(F.sum("s").alias("a"), F.sum(1 - F.col("s")).alias("b"))
    return with_running_totals(counts, ["x"], {"a_upto": "a", "b_upto": "b"}, Ranges(long.select("x"), ["x"], split_ties=False))


def kolmogorov_smirnov(df: DataFrame, a: str, b: str) -> DataFrame:
    """The largest distance of two empirical distributions, and the first term of its asymptotic p-value."""
    sizes = df.agg(F.count(clean(F.col(a))).alias("n"), F.count(clean(F.col(b))).alias("m"))
    d = joined_back(_pooled(df, a, b), sizes).agg(F.max(F.abs(F.col("a_upto") / F.col("n") - F.col("b_upto") / F.col("m"))).alias("statistic"), F.max(F.col("n") * F.col("m") / (F.col("n") + F.col("m"))).alias("e"))
    return d.select("statistic", F.least(F.lit(1.0), 2 * F.exp(-2 * F.col("e") * F.col("statistic") * F.col("statistic"))).alias("p_value"))


def mann_whitney(df: DataFrame, a: str, b: str) -> DataFrame:
    """U of both samples from average ranks of the pooled values, the normal z and the p-value for both tails."""
    both = F.col("a") + F.col("b")
    ranked = _pooled(df, a, b).withColumn("r", F.col("a_upto") + F.col("b_upto") - (both - 1) / 2)
    one = ranked.agg(F.sum(F.col("r") * F.col("a")).alias("r1"), F.sum("a").cast("double").alias("n"), F.sum("b").cast("double").alias("m"))
    n, m = F.col("n"), F.col("m")
    u1 = F.col("r1") - n * (n + 1) / 2
    z = (F.least(u1, n * m - u1) - n * m / 2) / F.sqrt(n * m * (n + m + 1) / 12)
    return one.select(u1.alias("u1"), (n * m - u1).alias("u2"), z.alias("z"), (1 - erf(F.abs(z) / math.sqrt(2))).alias("p_value"))


def durbin_watson(df: DataFrame, name: str, order: str | Sequence[str] = POS, by: Sequence[str] = ()) -> DataFrame:
    rows, keys, at = _series_windows(df, order, by, 1)
    d = rows.select(*by, "__own", F.col(name).alias("e"), (F.col(name) - F.lag(name).over(ordered(at, keys))).alias("d")).where("__own")
    squares = F.sum(F.col("e") * F.col("e"))
    return d.groupBy(*by).agg(F.when(squares > 1e-300, F.sum(F.col("d") * F.col("d")) / squares).otherwise(2.0).alias("d")).withColumn("rho", 1 - F.col("d") / 2)


def chi_squared_tail(x: float, freedom: int) -> float:
    """How likely a chi-squared value with whole degrees of freedom exceeds x, by its finite sums."""
    half = x / 2
    if x <= 0:
        return 1.0
    if freedom % 2:
        rest = sum(math.exp(-half + (j - 0.5) * math.log(half) - math.lgamma(j + 0.5)) for j in range(1, freedom // 2 + 1))
        return math.erfc(math.sqrt(half)) + rest
    return sum(math.exp(-half + j * math.log(half) - math.lgamma(j + 1)) for j in range(freedom // 2))


def ljung_box(df: DataFrame, name: str, max_lag: int, order: str | Sequence[str] = POS, adjust: int = 0) -> DataFrame:
    """Q = n (n + 2) * sum of acf ^ 2 / (n - k), cumulated over the lags, with its p-value; a constant column has 0 and 1."""
    import pandas as pd

    one = df.agg(F.avg(name).alias("__m"))
    rows, keys, at = _series_windows(joined_back(df, one), order, (), max_lag)
    e = rows.withColumn("e", F.col(name) - F.col("__m"))
    lags = e.select("__own", "e", *[F.lag("e", k).over(ordered(at, keys)).alias(f"l{k}") for k in range(1, max_lag + 1)]).where("__own")
    sums = lags.agg(F.count("e").alias("n"), F.sum(F.col("e") * F.col("e")).alias("s"), *[F.sum(F.col("e") * F.col(f"l{k}")).alias(f"s{k}") for k in range(1, max_lag + 1)])
    q, found = F.lit(0.0), []
    for k in range(1, max_lag + 1):
        acf = F.coalesce(F.try_divide(F.col(f"s{k}"), F.col("s")), F.lit(0.0))
        q = q + F.col("n") * (F.col("n") + 2) * acf * acf / (F.col("n") - k)
        found.append(F.struct(F.lit(k).alias("lag"), acf.alias("acf"), q.alias("q")))

    def judged(parts):
        for part in parts:  # one row for each lag
            yield part.assign(p_value=[chi_squared_tail(x, max(1, k - adjust)) for x, k in zip(part["q"], part["lag"])]) if len(part) else pd.DataFrame({"lag": [], "acf": [], "q": [], "p_value": []})

    return sums.select(F.explode(F.array(*found)).alias("r")).select("r.*").mapInPandas(judged, "lag int, acf double, q double, p_value double")


def tukey_hinges(df: DataFrame, name: str, high: float = 1.5, low: float = 1.5, flag: str | None = None) -> DataFrame:
    """Rows beyond the fences of the medians of the lower and upper half; with ``flag``, all rows and whether they are."""
    x = F.col(name)
    known = df.where(~missing(x)).select(x.cast("double").alias("v"))
    counts = with_running_totals(known.groupBy("v").agg(F.count("*").alias("c")), ["v"], {"hi": "c"}, Ranges(known, ["v"], split_ties=False))
    placed = joined_back(counts.withColumn("lo", F.col("hi") - F.col("c")), known.agg(F.count("*").alias("n")))
    half = F.floor(F.col("n") / 2)
    at = lambda j: F.max(F.when((F.col("lo") < j) & (j <= F.col("hi")), F.col("v")))
    mid = lambda shift: (at(F.floor((half + 1) / 2) + shift) + at(F.floor(half / 2) + 1 + shift)) / 2
    one = placed.agg(mid(F.lit(0)).alias("__q1"), mid(F.col("n") - half).alias("__q3"))
    d = F.col("__q3") - F.col("__q1")
    beyond = F.coalesce((x > F.col("__q3") + high * d) | (x < F.col("__q1") - low * d), F.lit(False))
    out = joined_back(df, one)
    return (out.withColumn(flag, beyond) if flag else out.where(beyond)).drop("__q1", "__q3")


def z_outliers(df: DataFrame, name: str, threshold: float, flag: str | None = None) -> DataFrame:
    """Rows further than ``threshold`` deviations from the mean; with ``flag``, all rows and whether they are."""
    one = df.agg(F.avg(clean(F.col(name))).alias("__m"), F.stddev_samp(clean(F.col(name))).alias("__s"))
    beyond = F.coalesce(F.abs((F.col(name) - F.col("__m")) / F.col("__s")) > threshold, F.lit(False))
    out = joined_back(df, one)
    return (out.withColumn(flag, beyond) if flag else out.where(beyond)).drop("__m", "__s")


#: Two-sided normal quantiles of confidence levels; others are interpolated.
Z_LEVELS = ((0.80, 1.2816), (0.85, 1.4395), (0.90, 1.6449), (0.95, 1.96), (0.98, 2.3263), (0.99, 2.5758), (0.999, 3.2905))


def confidence_interval(x: Column, level: float = 0.95) -> Column:
    if not Z_LEVELS[0][0] <= level <= Z_LEVELS[-1][0]:
        raise ValueError("the level must be from 0.8 to 0.999")
    z = next(za + (level - a) / (b - a) * (zb - za) for (a, za), (b, zb) in zip(Z_LEVELS, Z_LEVELS[1:]) if level <= b)
    margin = z * F.stddev_samp(x) / F.sqrt(F.count(x))
    return F.struct((F.avg(x) - margin).alias("low"), (F.avg(x) + margin).alias("high"), margin.alias("margin"))


def quantile_bins(df: DataFrame, name: str, qs: int | Sequence[float], out: str = "bin", labels: Sequence[str] | None = None) -> DataFrame:
    """Adds low and high edge and number (or label) of the quantile bin of each row; the top edge belongs to the last bin.

    Edges are percentiles by interpolation between the neighbours of q * (n - 1).
    """
    shares = [i / qs for i in range(qs + 1)] if isinstance(qs, int) else list(qs)
    known = df.where(~missing(F.col(name))).select(F.col(name).cast("double").alias("v"))
    counts = with_running_totals(known.groupBy("v").agg(F.count("*").alias("c")), ["v"], {"hi": "c"}, Ranges(known, ["v"], split_ties=False))
    placed = joined_back(counts, known.agg(F.count("*").alias("n")))
    at = lambda j: F.max(F.when((F.col("hi") - F.col("c") < j) & (j <= F.col("hi")), F.col("v")))
    edges = []
    for q in shares:
        pos = q * (F.col("n") - 1)
        i = F.floor(pos)
        share = F.max(pos - i)
        edges.append(at(i + 1) * (1 - share) + F.coalesce(at(F.least(i + 2, F.col("n"))), F.lit(0.0)) * share)
    one = placed.agg(F.array(*edges).alias("__edges"))
    x, e, last = F.col(name), F.col("__edges"), len(shares) - 2
    number = F.least(F.size(F.filter(e, lambda v: v <= x)) - 1, F.lit(last))
    inside = x.between(e[0], e[last + 1])
    got = F.element_at(F.array(*[F.lit(v) for v in labels]), number + 1) if labels else number
    return joined_back(df, one).select("*", F.when(inside, got).alias(out), F.when(inside, e[number]).alias(f"{out}_low"), F.when(inside, e[number + 1]).alias(f"{out}_high")).drop("__edges")


def polynomial_fit(df: DataFrame, x: str, y: str, degree: int) -> DataFrame:
    """Least squares by sums of powers in one aggregate; the driver solves a system of degree + 1."""
    import numpy as np

    one = df.agg(*[F.sum(F.pow(x, k)).alias(f"x{k}") for k in range(2 * degree + 1)], *[F.sum(F.pow(x, k) * F.col(y)).alias(f"y{k}") for k in range(degree + 1)]).first()
    a = np.array([[one[f"x{i + j}"] for j in range(degree + 1)] for i in range(degree + 1)], float)
    found = np.linalg.solve(a, np.array([one[f"y{i}"] for i in range(degree + 1)], float))
    return df.sparkSession.createDataFrame([(i, float(c)) for i, c in enumerate(found)], "power int, coefficient double")
