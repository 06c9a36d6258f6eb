"""Columns and rows put into a table, and a table laid over another index."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F, types as T

from larkspur.functions import sequential as Q
from larkspur.functions.scalars import drawn
from larkspur.operators.joins import asof_join
from larkspur.plans import INDEX, POS, as_number, by_series, joined_back, with_positions


def load_data(spark: SparkSession, index: Sequence, index_type: str = "long", **columns: tuple[str, Sequence]) -> DataFrame:
    """A table of an index and columns given as name=(type, values); short columns end in nulls, longer ones are an error."""
    if any(len(v) > len(index) for _, v in columns.values()):
        raise ValueError("a column has more values than the index")
    schema = f"{POS} long, {INDEX} {index_type}" + "".join(f", `{n}` {t}" for n, (t, _) in columns.items())
    return spark.createDataFrame([(i, x, *[v[i] if i < len(v) else None for _, v in columns.values()]) for i, x in enumerate(index)], schema)


def load_index(df: DataFrame, values: DataFrame, column: str, index: str = INDEX) -> DataFrame:
    """Replaces the index by a column of ``values``, position by position."""
    return load_column(df.drop(index), values, column, index).select(*df.columns)


def append_index(df: DataFrame, values: DataFrame, column: str, index: str = INDEX) -> DataFrame:
    """More rows that have an index only; they follow the others."""
    kind = df.schema[index].dataType
    more = joined_back(values.select(POS, F.col(column).cast(kind).alias(index)), df.agg(F.coalesce(F.max(POS) + 1, F.lit(0)).alias("__n")))
    return df.unionByName(more.withColumn(POS, F.col(POS) + F.col("__n")).drop("__n"), allowMissingColumns=True)


def load_column(df: DataFrame, values: DataFrame, column: str, name: str, pad: bool = True) -> DataFrame:
    """Attaches a column of ``values`` by position; rows beyond its end are null, or are left out without ``pad``.

    Values beyond the table's end have no row and are an error when the plan runs.
    """
    got = values.select(POS, F.col(column).alias("__value"), F.lit(True).alias("__has"))
    joined = df.withColumn("__row", F.lit(True)).join(got, POS, "full" if pad else "right")
    checked = F.when(F.col("__row").isNull(), F.raise_error(F.lit(f"{name}: more values than rows"))).otherwise(F.col("__value"))
    return joined.withColumn("__value", checked).drop("__row", "__has", *([name] if name in df.columns else [])).withColumnRenamed("__value", name)


def derive_column(df: DataFrame, name: str, value: Column) -> DataFrame:
    return df.withColumn(name, value)


def append_column(df: DataFrame, name: str, values: DataFrame, column: str) -> DataFrame:
    """Values for the rows behind the last one that has a value in the column."""
    filled = df.agg(F.coalesce(F.max(F.when(F.col(name).isNotNull(), F.col(POS) + 1)), F.lit(0)).alias("__n"))
    late = joined_back(values.select(POS, F.col(column).alias("__value")), filled).select((F.col(POS) + F.col("__n")).alias(POS), "__value")
    return df.join(late, POS, "left").withColumn(name, F.coalesce(F.col(name), F.col("__value"))).drop("__value").select(*df.columns)


def load_align_column(df: DataFrame, values: DataFrame, column: str, name: str, interval: float, from_start: bool = True, empty=None, index: str = INDEX, by: Sequence[str] = ()) -> DataFrame:
    """Lays a coarser column over the index, a value every ``interval``; other rows are ``empty``. ``values`` has a position (and ``by``)."""

    def slots(t):
        found = Q.align_slots(t, interval, from_start)
        return {"__slot": found["slot"], "__low": found["first"]}

    placed = by_series(df.withColumn("__at", as_number(df, index)), slots, ["__at"], {"__slot": "bigint", "__low": "bigint"}, index, by)
    # Of several values that come to one row the last one stays that there is.
    placed = joined_back(placed, values.groupBy(*by).agg(F.max(POS).alias("__top")), by)
    placed = placed.withColumn("__slot", F.when(F.col("__top") >= F.col("__low"), F.least("__slot", "__top")).otherwise(F.col("__slot")))
    got = values.select(*by, F.col(POS).alias("__slot"), F.col(column).alias("__value"), F.lit(True).alias("__has"))
    out = placed.join(got, [*by, "__slot"], "left")
    return out.select(*df.columns, F.when(F.col("__has"), F.col("__value")).otherwise(F.lit(empty)).alias(name))


def load_random_sample(df: DataFrame, values: DataFrame, column: str, name: str, seed: int = 0, n: int | None = None) -> DataFrame:
    """A column drawn with replacement from a column of ``values``, by digests of positions; rows from the n-th on are null."""
    sized = joined_back(df, values.agg((F.max(POS) + 1).alias("__n")))
    sized = sized.withColumn("__pick", F.when(F.lit(True) if n is None else F.col(POS) < n, drawn(F.col(POS), seed) % F.col("__n")))
    got = values.select(F.col(POS).alias("__pick"), F.col(column).alias(name))
    return sized.join(got, "__pick", "left").select(*df.columns, name)


def append_row(df: DataFrame, **cells) -> DataFrame:
    """One more row at the end; cells that are not named are null."""
    fields = [f for f in df.schema.fields if f.name != POS]
    row = df.sparkSession.createDataFrame([Row(*[cells.get(f.name) for f in fields])], T.StructType([T.StructField(f.name, f.dataType) for f in fields]))
    if POS in df.columns:
        row = joined_back(row, df.agg(F.coalesce(F.max(POS) + 1, F.lit(0)).alias(POS)))
    return df.unionByName(row.select(*df.columns))


def change_freq(df: DataFrame, step: int, unit: str | None = None, index: str = INDEX, names: Sequence[str] | None = None) -> DataFrame:
    """The table at every ``step`` of its index (of ``unit`` for times) and at its last one: each column's last value up to there."""
    names = list(names or [c for c in df.columns if c not in (index, POS)])
    ends = df.agg(F.min(index).alias("a"), F.max(index).alias("b"))
    stride = F.expr(f"interval {step} {unit}") if unit else F.lit(step).cast(df.schema[index].dataType)
    points = ends.select(F.explode(F.array_distinct(F.concat(F.sequence("a", "b", stride), F.array("b")))).alias(index))
    rows = df if POS in df.columns else with_positions(df, [index])
    return asof_join(points, rows.select(POS, index, *names), index, names)


def fill_from(df: DataFrame, other: DataFrame, name: str, index: str = INDEX) -> DataFrame:
    """Missing cells take the value of the other table's row at the same position, where its index is the same too."""
    got = other.select(POS, F.col(index).alias("__index"), F.col(name).alias("__value"))
    same = F.col(index).eqNullSafe(F.col("__index"))
    return df.join(got, POS, "left").withColumn(name, F.coalesce(F.col(name), F.when(same, F.col("__value")))).select(*df.columns)
