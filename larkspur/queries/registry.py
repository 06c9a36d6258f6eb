"""Names of queries, their functions and SQL, and what several of them share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from larkspur.plans import with_positions

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    """Registers a function of (table reader) as the query ``name``; the reader takes a table's name."""

    def add(make):
        QUERIES[name] = lambda spark, sf_dir: make(lambda t: table(spark, sf_dir, t))
        if sql:
            ORACLE_SQL[name] = sql
        return make

    return add


def r(x, n: int = 6):
    """Rounded, so that the order of sums doesn't show."""
    return F.round(x, n)


def fixed(x: Column | str, n: int = 6) -> Column:
    """Cut to n digits by the same double operations as ``FIXED``; what is no finite number is null."""
    v = F.col(x) if isinstance(x, str) else x
    v = v.cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) < 1e12), F.floor(v * 10.0**n + 0.5) / 10.0**n)


def FIXED(sql: str, n: int = 6) -> str:  # noqa: N802
    return f"(CASE WHEN NOT isnan(({sql})::DOUBLE) AND abs({sql}) < 1e12 THEN floor(({sql})::DOUBLE * {10.0**n!r} + 0.5) / {10.0**n!r} END)"


def rows(t, name: str, key: str) -> DataFrame:
    return with_positions(t(name), [key])


BY, AT = ["user_id"], ["ts", "event_id"]
SERIES = "PARTITION BY user_id ORDER BY ts, event_id"
#: Prices of a day: first, highest, lowest and last value of a user's events, and how many.
BARS = """bars AS (SELECT user_id, date_trunc('day', ts) AS day, arg_min(value, event_id) FILTER (rf = 1) AS open, max(value) AS high, min(value) AS low, arg_min(value, event_id) FILTER (rl = 1) AS close, count(*)::DOUBLE AS volume
    FROM (SELECT *, row_number() OVER (PARTITION BY user_id, date_trunc('day', ts) ORDER BY ts, event_id) AS rf, row_number() OVER (PARTITION BY user_id, date_trunc('day', ts) ORDER BY ts DESC, event_id DESC) AS rl FROM events) GROUP BY 1, 2)"""


def bars(t) -> DataFrame:
    key = F.struct("ts", "event_id")
    return (
        t("events").groupBy("user_id", F.date_trunc("day", "ts").alias("day"))
        .agg(F.min_by("value", key).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", key).alias("close"), F.count("*").cast("double").alias("volume"))
    )


DAY = {"order": ["day"], "by": ["user_id"]}
