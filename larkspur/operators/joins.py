"""Joins by index or column, by position, as of a time, and element-wise over frames."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from larkspur.plans import INDEX, POS, Ranges, as_number, ordered

HOW = {"inner_join": "inner", "left_join": "left", "right_join": "right", "left_right_join": "full"}


def _renamed(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    same = [c for c in a.columns if c in b.columns and c not in keys]
    return a.withColumnsRenamed({c: f"lhs.{c}" for c in same}), b.withColumnsRenamed({c: f"rhs.{c}" for c in same})


def join_by_index(a: DataFrame, b: DataFrame, policy: str = "inner_join", index: str = INDEX) -> DataFrame:
    """Relational join on the index; columns of one name become lhs.x and rhs.x. Sorting is left to the caller."""
    a, b = _renamed(a, b, [index])
    return a.join(b, index, HOW[policy])


def join_by_column(a: DataFrame, b: DataFrame, name: str, policy: str = "inner_join") -> DataFrame:
    a, b = _renamed(a, b, [name])
    return a.join(b, name, HOW[policy])


def join_literal(a: DataFrame, b: DataFrame, key: str, policy: str = "inner_join", order: str = POS) -> DataFrame:
    """The form in which only the first left row of a key meets all right rows, and the others its last one."""
    rank = lambda df, n, m: df.withColumn(n, F.row_number().over(Window.partitionBy(key).orderBy(order))).withColumn(m, F.count("*").over(Window.partitionBy(key)))
    x, y = rank(a, "__r", "__k"), rank(b, "__s", "__m")
    x, y = _renamed(x, y, [key])
    keep = ((F.col("__s") == 1) | (F.col("__r") == F.col("__k"))) if policy == "right_join" else ((F.col("__r") == 1) | (F.col("__s") == F.col("__m")))
    joined = x.join(y, key, HOW[policy])
    return joined.where(F.col("__r").isNull() | F.col("__s").isNull() | keep).drop("__r", "__k", "__s", "__m")


def gen_join(a: DataFrame, b: DataFrame, choose: Callable[[], Column]) -> DataFrame:
    """Rows of one position, up to the shorter side; ``choose`` gives include_left, include_right, include_both or no_match from lhs.x and rhs.x."""
    x, y = a.withColumnsRenamed({c: f"lhs.{c}" for c in a.columns if c != POS}), b.withColumnsRenamed({c: f"rhs.{c}" for c in b.columns if c != POS})
    z = x.join(y, POS).withColumn("__is", choose()).where("__is <> 'no_match'")
    left, right = F.col("__is") != "include_right", F.col("__is") != "include_left"
    return z.select(POS, *[F.when(left if c.startswith("lhs.") else right, F.col(f"`{c}`")).alias(c) for c in z.columns if c not in (POS, "__is")])


def asof_join(a: DataFrame, b: DataFrame, on: str, values: Sequence[str], policy: str = "backward", tolerance=None, by: Sequence[str] = ()) -> DataFrame:
    """For each left row the nearest right row before (backward), after (forward) or on either side (nearest, ties backward).

    Both sides are tagged and united; a window carries the last right row along. Of right
    rows equal to the left one the first counts, of earlier ones the last. Work is spread by
    ``by``, or without it by ranges of ``on``. ``tolerance`` is in units of ``on``.
    """
    right = b.withColumn("__n", as_number(b, on)).groupBy(*by, on).agg(F.first("__n").alias("__n"), F.min_by(F.struct(*values), F.col(POS)).alias("eq"), F.max_by(F.struct(*values), F.col(POS)).alias("lt"))
    left = a.select("*", F.lit(1).alias("__side"), F.col(on).alias("__t"))
    fill = [F.lit(None).cast(left.schema[c].dataType).alias(c) for c in a.columns if c not in by]
    tagged = right.select(*by, *[x for x in fill], F.lit(0).alias("__side"), F.col(on).alias("__t"), F.struct(F.col(on).alias("t"), F.col("__n").alias("n"), "eq", "lt").alias("__r"))
    both = left.withColumn("__r", F.lit(None).cast(tagged.schema["__r"].dataType)).unionByName(tagged)
    if by:
        keys, rows = list(by), both
    else:  # ranges of the time; the nearest right rows of the ranges around are carried along
        keys, ranges = ["__part"], Ranges(both.select("__t"), ["__t"], split_ties=False)
        rows = ranges.placed(both)
    back = F.last("__r", ignorenulls=True).over(ordered(["__t", "__side"], keys).rowsBetween(Window.unboundedPreceding, 0))
    # Backwards, since Spark sums up a frame that reaches to the end anew for each row.
    ahead = F.last("__r", ignorenulls=True).over(Window.partitionBy(*keys).orderBy(F.desc("__t"), "__side").rowsBetween(Window.unboundedPreceding, 0))
    found = rows.withColumn("__b", back).withColumn("__f", ahead).where("__side = 1")
    if not by:
        edges = rows.groupBy("__part").agg(F.max_by("__r", "__r.t").alias("__last"), F.min_by("__r", "__r.t").alias("__first"))
        parts = Window.orderBy("__part")
        carried = edges.select(
            F.col("__part").alias("__range"), F.last("__last", ignorenulls=True).over(parts.rowsBetween(Window.unboundedPreceding, -1)).alias("__cb"),
            F.first("__first", ignorenulls=True).over(parts.rowsBetween(1, Window.unboundedFollowing)).alias("__cf"),
        )
        found = found.join(F.broadcast(carried), F.col("__part") == F.col("__range")).withColumn("__b", F.coalesce("__b", "__cb")).withColumn("__f", F.coalesce("__f", "__cf"))
    here = as_number(a, on)
    gap = lambda c: F.abs(here - F.col(f"{c}.n"))
    pick = {"backward": F.col("__b"), "forward": F.col("__f"), "nearest": F.when(F.col("__f").isNull() | (gap("__b") <= gap("__f")), F.col("__b")).otherwise(F.col("__f"))}[policy]
    out = found.withColumn("__p", pick)
    if tolerance:
        out = out.withColumn("__p", F.when(gap("__p") <= tolerance, F.col("__p")))
    got = lambda v: F.when(F.col("__p.t") == F.col(on), F.col(f"__p.eq.{v}")).otherwise(F.col(f"__p.{'eq' if policy == 'forward' else 'lt'}.{v}")).alias(f"rhs.{v}" if v in a.columns else v)
    return out.select(*a.columns, *[got(v) for v in values])


def modify_by_idx(a: DataFrame, b: DataFrame, index: str = INDEX) -> DataFrame:
    """Cells of ``a`` take the value of ``b`` where the index is in both."""
    names = [c for c in a.columns if c in b.columns and c != index]
    other = b.dropDuplicates([index]).select(index, F.lit(True).alias("__in"), *[F.col(c).alias(f"__{c}") for c in names])
    out = a.join(other, index, "left")
    return out.withColumns({c: F.when(F.col("__in"), F.col(f"__{c}")).otherwise(F.col(c)) for c in names}).select(*a.columns)


def combine(frames: Sequence[DataFrame], name: str, how: Callable[..., Column]) -> DataFrame:
    """One column over frames, row by row by position."""
    out = frames[0].select(POS, F.col(name).alias("__0"))
    for i, f in enumerate(frames[1:], 1):
        out = out.join(f.select(POS, F.col(name).alias(f"__{i}")), POS)
    return out.select(POS, how(*[F.col(f"__{i}") for i in range(len(frames))]).alias(name))


def arithmetic(a: DataFrame, b: DataFrame | float, how: Callable[[Column, Column], Column], index: str = INDEX) -> DataFrame:
    """Frame with frame by index, over the columns that both have, or frame with scalar."""
    if not isinstance(b, DataFrame):
        return a.select(index, *[how(F.col(c), F.lit(b)).alias(c) for c in a.columns if c != index])
    names = [c for c in a.columns if c in b.columns and c != index]
    x, y = a.select(index, *[F.col(c).alias(f"__a{c}") for c in names]), b.select(index, *[F.col(c).alias(f"__b{c}") for c in names])
    return x.join(y, index).select(index, *[how(F.col(f"__a{c}"), F.col(f"__b{c}")).alias(c) for c in names])
