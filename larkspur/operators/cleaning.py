"""Anomalies found, removed or repaired, and series made stationary."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from larkspur.functions import aggregates as A, scalars as S, sequential as Q, windows as W
from larkspur.operators.frame import make_stationary as _by_expression
from larkspur.plans import POS, by_series, joined_back

METHODS = ("hampel", "zscore", "iqr", "fft", "lof", "isof")


def flagged(df: DataFrame, name: str, method: str, order: str | Sequence[str] = POS, by: Sequence[str] = (), flag: str = "outlier", **options) -> DataFrame:
    """Adds ``flag``: whether a row is an anomaly of its column.

    zscore and iqr judge by the whole column, hampel by windows of each series; fft, lof and
    isof are kernels on whole series, one task each.
    """
    if method == "zscore":
        return A.z_outliers(df, name, options.get("threshold", 3.0), flag)
    if method == "iqr":
        return A.tukey_hinges(df, name, options.get("high_fence", 1.5), options.get("low_fence", 1.5), flag)
    if method == "hampel":
        return W.hampel(df, name, options.get("window", 5), options.get("deviations", 3.0), options.get("kind", "median"), order, by, flag)
    kernel = {"fft": Q.fft_outliers, "lof": Q.local_outliers, "isof": Q.isolation_outliers}[method]
    return by_series(df, lambda x: {flag: kernel(x, **options)["outlier"]}, [name], {flag: "boolean"}, order, by)


def remove_anomalies(df: DataFrame, name: str, method: str, order: str | Sequence[str] = POS, by: Sequence[str] = (), **options) -> DataFrame:
    """The rows that ``flagged`` does not mark."""
    return flagged(df, name, method, order, by, "__outlier", **options).where("NOT __outlier").drop("__outlier")


def detect_and_change(df: DataFrame, names: Sequence[str], method: str, policy: str, index: str | None = None, order: str | Sequence[str] = POS, by: Sequence[str] = (), **options) -> DataFrame:
    """Repairs anomalies of each column from the rows next to them, left to right.

    policy is linear_interpolate (over the numeric column ``index``, or the places of rows),
    fill_forward, fill_backward or mid_point. A run of anomalies builds on what is repaired
    before it.
    """
    if policy not in ("linear_interpolate", "fill_forward", "fill_backward", "mid_point"):
        raise ValueError(f"unknown repair policy {policy}")
    for name in names:
        marked = flagged(df, name, method, order, by, "__outlier", **options)
        columns = [name, "__outlier", *([index] if index else [])]
        fixed = by_series(marked, lambda *a: {"__new": Q.repaired(*a, policy=policy)["repaired"]}, columns, {"__new": "double"}, order, by)
        df = fixed.withColumn(name, F.when(F.col("__outlier"), F.col("__new")).otherwise(F.col(name))).drop("__new", "__outlier").select(*df.columns)
    return df


def make_stationary(df: DataFrame, name: str, method: str, order: str | Sequence[str] = POS, by: Sequence[str] = (), **options) -> DataFrame:
    """differencing, log_trans, sqrt_trans, boxcox_trans, decomposition (what is left of it) or smoothing (an exponential mean)."""
    x = F.col(name)
    if method == "boxcox_trans":
        one = df.agg(F.min(name).alias("__least"), A.geometric_mean(F.when(x > 0, x)).alias("__g"))
        shift = F.when(F.col("__least") <= 0, 1 - F.col("__least")).otherwise(0.0)
        value = S.box_cox(x, options.get("lam", 0.0), options.get("kind", "original"), shift, F.col("__g"))
        return joined_back(df, one).withColumn(name, value).drop("__least", "__g")
    if method == "decomposition":
        kernel = lambda v: {"__new": Q.decompose(v, options.get("period", 12), options.get("frac", 0.3), options.get("multiplicative", False))["residual"]}
    elif method == "smoothing":
        kernel = lambda v: {"__new": Q.ewm_mean(v, options.get("kind", "span"), options.get("value", 10.0), options.get("finite", True))["ewm"]}
    else:
        return _by_expression(df, name, method, order, by)
    return by_series(df, kernel, [name], {"__new": "double"}, order, by).withColumn(name, F.col("__new")).drop("__new")
