"""Time buckets of a stream, with watermarks for late rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def resample_stream(events: DataFrame, time: str, width: str, late: str, *aggregates: Column, by: tuple[str, ...] = ()) -> DataFrame:
    """Tumbling buckets by key; a bucket is final once the watermark has passed its end."""
    return events.withWatermark(time, late).groupBy(*by, F.window(time, width).alias("bucket")).agg(*aggregates)


def distinct_stream(events: DataFrame, time: str, late: str, *keys: str) -> DataFrame:
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(list(keys))
