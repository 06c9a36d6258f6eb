"""Grouping, counts, contingency and pivot tables, and consecutive buckets."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from larkspur.functions.windows import scaled
from larkspur.plans import INDEX, POS, as_number, joined_back


def groupby(df: DataFrame, keys: Sequence[str], *aggregates: Column, index: Column | None = None) -> DataFrame:
    return df.groupBy(*keys).agg(*([index.alias(INDEX)] if index is not None else []), *aggregates).orderBy(*keys)


def value_counts(df: DataFrame, name: str) -> DataFrame:
    return df.groupBy(F.col(name).alias(INDEX)).agg(F.count("*").alias("counts"))


def crosstab(df: DataFrame, row: str, column: str, values: Sequence, margins: bool = False, normalise: str | None = None) -> DataFrame:
    """Counts of each row value by each of ``values``; margins add All, normalise is all, row or column."""
    cells = df.where(F.col(row).isNotNull() & F.col(column).isNotNull())
    counts = cells.groupBy(row).pivot(column, list(values)).agg(F.count(F.lit(1)).cast("double")).na.fill(0.0)
    names = [str(v) for v in values]
    q = lambda n: F.col(f"`{n}`")
    total = sum((q(n) for n in names), F.lit(0.0))
    if margins:
        counts = counts.withColumn("All", total).withColumn(row, F.col(row).cast("string"))
        names = [*names, "All"]
        counts = counts.unionByName(counts.agg(F.lit("All").alias(row), *[F.sum(q(n)).alias(n) for n in names]))
        total = q("All")
    whole = Window.partitionBy()
    body = F.when(F.col(row) != "All", 1.0).otherwise(0.0) if margins else F.lit(1.0)
    if normalise == "row":
        return counts.select(row, *[(q(n) / total).alias(n) for n in names])
    if normalise == "column":
        return counts.select(row, *[(q(n) / F.sum(q(n) * body).over(whole)).alias(n) for n in names])
    if normalise == "all":
        return counts.select(row, *[(q(n) / F.sum(total * body).over(whole)).alias(n) for n in names])
    return counts


def pivot_table(df: DataFrame, row: str, column: str, values: Sequence, aggregate: Column) -> DataFrame:
    return df.groupBy(row).pivot(column, list(values)).agg(aggregate)


def covariance_matrix(df: DataFrame, names: Sequence[str], scaling: str | None = None) -> DataFrame:
    """One row per column; all pairs in one aggregate, of the columns as they are or scaled by one of ``windows.SCALINGS``."""
    for c in names if scaling else ():
        df = scaled(df, c, scaling)
    one = df.agg(*[F.covar_samp(a, b).alias(f"{a}|{b}") for i, a in enumerate(names) for b in names[i:]])
    cell = lambda a, b: F.col(f"`{a}|{b}`" if names.index(a) <= names.index(b) else f"`{b}|{a}`").alias(b)
    rows = F.array(*[F.struct(F.lit(a).alias("column"), *[cell(a, b) for b in names]) for a in names])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def bucketize_by_count(df: DataFrame, n: int, *aggregates: Column, by: Sequence[str] = (), keep_last: bool = False) -> DataFrame:
    """Chunks of n rows by position; the last chunk, even if full, is only emitted with ``keep_last``."""
    return _closed(df.groupBy(*by, F.floor(F.col(POS) / n).alias("bucket")).agg(*aggregates), by, keep_last)


def _bucket_rows(parts: Iterator[pd.DataFrame], by: Sequence[str], distance: float) -> Iterator[pd.DataFrame]:
    """Numbers the buckets of rows that come sorted by series and __at; only the open bucket is carried from part to part."""
    key, start, bucket = None, 0.0, 0
    for part in parts:
        values, out = part["__at"].to_numpy(), np.zeros(len(part), np.int64)
        keys = [tuple(None if pd.isna(v) else v for v in k) for k in part[list(by)].itertuples(index=False, name=None)] if by else []
        cuts = [0, *[i for i in range(1, len(keys)) if keys[i] != keys[i - 1]], len(part)]
        for a, b in zip(cuts, cuts[1:]):
            own = keys[a] if keys else ()
            if own != key:
                key, start, bucket = own, values[a], 0
            while a < b:  # from one bucket's first row to the next one's
                end = a + int(np.searchsorted(values[a:b], start + distance, "left"))
                out[a:end] = bucket
                if end < b:
                    bucket, start = bucket + 1, values[end]
                a = end
        yield part.drop(columns="__at").assign(bucket=out)


def distance_buckets(df: DataFrame, index: str, distance: float, by: Sequence[str] = (), columns: Sequence[str] | None = None) -> DataFrame:
    """Adds ``bucket``: each begins at its first row and ends before the first row ``distance`` or more away.

    Only ``columns`` (all by default) of the rows go to Python, in parts; a series of any
    length takes the memory of one part. A table without series is walked by one task.
    """
    rows = df.select(*dict.fromkeys([*by, index, *(columns if columns is not None else df.columns)]))
    schema = T.StructType([*rows.schema.fields, T.StructField("bucket", T.LongType())])
    rows = rows.withColumn("__at", as_number(rows, index)).where("__at IS NOT NULL")
    dealt = (rows.repartition(*by) if by else rows.repartition(1)).sortWithinPartitions(*by, "__at")
    return dealt.mapInPandas(lambda parts: _bucket_rows(parts, by, distance), schema)


def _closed(buckets: DataFrame, by: Sequence[str], keep_last: bool) -> DataFrame:
    """Without the last bucket of each series, which no later row has closed."""
    if keep_last:
        return buckets
    last = buckets.groupBy(*by).agg(F.max("bucket").alias("__l"))
    return joined_back(buckets, last, by).where("bucket < __l").drop("__l")


def bucketize_by_distance(df: DataFrame, index: str, distance: float, *aggregates: Column, by: Sequence[str] = (), keep_last: bool = False, columns: Sequence[str] | None = None) -> DataFrame:
    """Aggregates of ``distance_buckets``; ``columns`` are those that the aggregates read."""
    return _closed(distance_buckets(df, index, distance, by, columns).groupBy(*by, "bucket").agg(*aggregates), by, keep_last)


#: Beginning of the calendar unit of a time; weeks begin on Sunday.
CALENDAR = {
    "annual": lambda x: F.date_trunc("year", x), "monthly": lambda x: F.date_trunc("month", x), "weekly": lambda x: F.date_trunc("week", x + F.expr("interval 1 day")) - F.expr("interval 1 day"),
}
SECONDS = {"secondly": 1, "minutely": 60, "hourly": 3600, "daily": 86400}


def resample(df: DataFrame, index: str, frequency: str, n: int, *aggregates: Column, by: Sequence[str] = (), keep_last: bool = False, columns: Sequence[str] | None = None) -> DataFrame:
    """Buckets of time. Weeks, months and years are counted as far as they have rows, ``n`` of them a bucket, named by
    the first; days and shorter units are measured from the first row of each bucket."""
    if frequency in SECONDS:
        return bucketize_by_distance(df, index, SECONDS[frequency] * n, *aggregates, by=by, keep_last=keep_last, columns=columns)
    if frequency not in CALENDAR:
        raise ValueError(f"no time frequency: {frequency}")
    rows = df.where(F.col(index).isNotNull()).withColumn("__unit", CALENDAR[frequency](F.col(index)))
    if n == 1:
        return _closed(rows.groupBy(*by, F.col("__unit").alias("bucket")).agg(*aggregates), by, keep_last)
    units = rows.select(*by, "__unit").distinct().withColumn("__group", F.floor((F.row_number().over(Window.partitionBy(*by).orderBy("__unit")) - 1) / n))
    first = units.withColumn("bucket", F.min("__unit").over(Window.partitionBy(*by, "__group"))).drop("__group")
    return _closed(joined_back(rows, first, [*by, "__unit"]).groupBy(*by, "bucket").agg(*aggregates), by, keep_last)


def volume_weighted_prices(df: DataFrame, index: str, price: str, size: str, interval: float, by: Sequence[str] = (), most: float = 0.0) -> DataFrame:
    """One row for each distance bucket of a series: its prices weighted by sizes, events, volume and extremes, and all of these so far.

    Rows whose size is ``most`` or more count in no sum (0: all count).
    """
    rows = distance_buckets(df, index, interval, by, [price, size])
    p, s = (F.when((F.col(size) < most) if most else F.lit(True), F.col(c)) for c in (price, size))
    sums = rows.groupBy(*by, "bucket").agg(
        F.min(index).alias("index"), F.count(p).alias("event_count"), F.sum(p).alias("__p"), F.sum(p * s).alias("__ps"), F.sum(s).alias("total_volume"), F.max(p).alias("high_price"), F.min(p).alias("low_price")
    ).where("event_count > 0")
    so_far = Window.partitionBy(*by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    out = sums.withColumns({f"cumulative_{c}": f(c).over(so_far) for c, f in (("event_count", F.sum), ("total_volume", F.sum), ("high_price", F.max), ("low_price", F.min), ("__ps", F.sum))})
    weighted = lambda a, v: F.when(F.col(v) > 0, F.col(a) / F.col(v))
    out = out.withColumns({"average_price": F.when(F.col("total_volume") > 0, F.col("__p") / F.col("event_count")), "vwap": weighted("__ps", "total_volume"), "cumulative_vwap": weighted("cumulative___ps", "cumulative_total_volume")})
    return out.drop("__p", "__ps", "cumulative___ps")


def volume_weighted_spreads(df: DataFrame, index: str, bid: str, ask: str, bid_size: str, ask_size: str, interval: float, by: Sequence[str] = ()) -> DataFrame:
    """One row for each distance bucket: ask less bid, of plain means and of means weighted by sizes, in per cent of the bid, and so far."""
    rows = distance_buckets(df, index, interval, by, [bid, ask, bid_size, ask_size])
    sums = rows.groupBy(*by, "bucket").agg(
        F.min(index).alias("index"), F.count(F.lit(1)).alias("event_count"), F.avg(ask).alias("__a"), F.avg(bid).alias("__b"), F.sum(F.col(ask) * F.col(ask_size)).alias("__as"), F.sum(F.col(bid) * F.col(bid_size)).alias("__bs"),
        F.sum(ask_size).alias("total_ask_volume"), F.sum(bid_size).alias("total_bid_volume"), F.max(ask).alias("high_ask_price"), F.min(ask).alias("low_ask_price"), F.max(bid).alias("high_bid_price"), F.min(bid).alias("low_bid_price"),
    )
    so_far = Window.partitionBy(*by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    per = lambda a, v, f: F.try_divide(f(a), f(v))
    here, all_ = F.col, lambda c: F.sum(c).over(so_far)
    vwa, vwb = per("__as", "total_ask_volume", here), per("__bs", "total_bid_volume", here)
    out = sums.withColumns({
        "spread": here("__a") - here("__b"), "percent_spread": 100 * F.try_divide(here("__a") - here("__b"), here("__b")), "vwbas": vwa - vwb, "percent_vwbas": 100 * F.try_divide(vwa - vwb, vwb),
        "cumulative_vwbas": per("__as", "total_ask_volume", all_) - per("__bs", "total_bid_volume", all_),
    })
    return out.drop("__a", "__b", "__as", "__bs")
