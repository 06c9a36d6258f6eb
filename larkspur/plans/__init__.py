"""Row order, series keys and the runner for algorithms that need a whole series in order."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F, types as T

INDEX, POS = "INDEX", "__pos"


def ordered(order: str | Sequence[str] = POS, by: Sequence[str] = ()) -> WindowSpec:
    """Rows in ``order`` within each series; without a series key the whole table is one task's work."""
    order = [order] if isinstance(order, str) else list(order)
    return (Window.partitionBy(*by) if by else Window.partitionBy()).orderBy(*order)


def trailing(n: int, order: str | Sequence[str] = POS, by: Sequence[str] = ()) -> WindowSpec:
    return ordered(order, by).rowsBetween(-(n - 1), 0)


def full(n: int, value: Column, order: str | Sequence[str] = POS, by: Sequence[str] = ()) -> Column:
    """``value`` where a window of ``n`` rows is complete, else null."""
    return F.when(F.row_number().over(ordered(order, by)) >= n, value)


def missing(x: Column) -> Column:
    """Null, or not a number."""
    return x.isNull() | F.isnan(x.cast("double"))


def as_number(df: DataFrame, name: str) -> Column:
    """A column as a double: seconds since 1970 for times."""
    kind = df.schema[name].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.unix_micros(F.col(name).cast("timestamp")) / 1e6
    return F.col(name).cast("double")


def joined_back(df: DataFrame, small: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``df`` with the columns of ``small``: its only row without keys, else the row of the same keys, of which null is one."""
    if not by:
        return df.crossJoin(F.broadcast(small))  # an aggregate without keys: exactly one row
    renamed = small.withColumnsRenamed({c: f"__by{i}" for i, c in enumerate(by)})
    same = F.lit(True)
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"__by{i}"))
    return df.join(renamed, same, "left").drop(*[f"__by{i}" for i in range(len(by))])


#: Sampled rows for each range that a table is cut into.
SAMPLES = 50

#: Sort directions by name: whether the absolute value counts, and whether the largest comes first.
DIRECTIONS = {"ascen": (False, False), "desce": (False, True), "abs_ascen": (True, False), "abs_desce": (True, True)}
Key = str | tuple[str, str]


def _keys(df: DataFrame, order: Key | Sequence[Key]) -> list[tuple[Column, bool, T.DataType]]:
    """Value, direction (True for descending) and type of each sort key; times as numbers, so that literals are exact."""
    out = []
    for key in [order] if isinstance(order, str | tuple) else order:
        name, spec = (key, "ascen") if isinstance(key, str) else key
        absolute, descending = DIRECTIONS[spec]
        kind, x = df.schema[name].dataType, F.col(f"`{name}`")
        if isinstance(kind, T.TimestampType | T.TimestampNTZType):
            kind, x = T.LongType(), F.unix_micros(x.cast("timestamp"))
        elif isinstance(kind, T.DateType):
            kind, x = T.IntegerType(), F.unix_date(x)
        elif not isinstance(kind, T.AtomicType):
            raise ValueError(f"rows can't be cut into ranges by {name} of type {kind.simpleString()}")
        out.append((F.abs(x) if absolute else x, descending, kind))
    return out


def sort_columns(df: DataFrame, order: Key | Sequence[Key]) -> list[Column]:
    return [x.desc() if down else x.asc() for x, down, _ in _keys(df, order)]


def _plain(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return all(_plain(f.dataType) for f in kind.fields)
    return _plain(kind.elementType) if isinstance(kind, T.ArrayType) else not isinstance(kind, T.MapType | T.VariantType)


def _tie(df: DataFrame) -> Column:
    """A hash of the whole row: decides between rows of equal keys, and splits a value that many rows hold."""
    return F.xxhash64(*[F.col(f"`{f.name}`") for f in df.schema.fields if _plain(f.dataType)])


def numeric_bounds(df: DataFrame, names: Sequence[str], parts: int | None = None) -> list[list[float]]:
    """For each numeric column ascending values that cut its rows into about equal ranges, from mergeable sketches in one pass."""
    parts = parts or range_count(df)
    shares = [i / parts for i in range(1, parts)]
    x = {c: F.col(f"`{c}`").cast("double") for c in names}
    one = df.agg(*[F.percentile_approx(F.when(~F.isnan(x[c]), x[c]), shares, 10 * parts).alias(f"b{i}") for i, c in enumerate(names)]).first()
    return [sorted({v for v in b or () if abs(v) < float("inf")}) for b in one]


def range_count(df: DataFrame) -> int:
    return 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def bucketed(df: DataFrame, names: Sequence[str], bounds: Sequence[Sequence[float]], outs: Sequence[str]) -> DataFrame:
    """Adds for each numeric column how many of its bounds a value reaches: a search in compiled code; missing values are -1."""
    from pyspark.ml.feature import Bucketizer

    doubles = [f"__x{i}" for i in range(len(names))]
    rows = df.withColumns({d: F.col(f"`{c}`").cast("double") for d, c in zip(doubles, names)})
    real = [i for i, b in enumerate(bounds) if b]
    if real:
        splits = [[-float("inf"), *bounds[i], float("inf")] for i in real]
        rows = Bucketizer(inputCols=[doubles[i] for i in real], outputCols=[f"__b{i}" for i in real], splitsArray=splits, handleInvalid="keep").transform(rows)
    found = {o: F.when(F.col(d).isNull(), -1).otherwise(F.col(f"__b{i}") if i in real else 0).cast("long") for i, (o, d) in enumerate(zip(outs, doubles))}
    return rows.withColumns(found).drop(*doubles, *[f"__b{i}" for i in real])


class Ranges:
    """Cuts rows into ranges of about equal size in the order of some keys.

    The bounds of a single number or time come from a sketch of its quantiles, others from a
    random sample of the keys, whose size is SAMPLES for each range and doesn't grow with the
    rows; any bounds give right results. Where one value of the keys fills several ranges, a
    hash of the row is the last key, so that it is split too.
    """

    def __init__(self, df: DataFrame, order: Key | Sequence[Key], parts: int | None = None, split_ties: bool = True):
        self.order, self.with_tie, self.number = order, False, False
        parts = parts or range_count(df)
        keys = _keys(df, order)
        if len(keys) == 1 and isinstance(keys[0][2], T.NumericType):
            self.bounds = numeric_bounds(df.select(keys[0][0].alias("k")), ["k"], parts)[0]
            # A value that fills more than one range leaves fewer bounds than asked for.
            if not split_ties or len(self.bounds) == parts - 1:
                self.number = True
                return
        count = df.count()
        self.bounds = self._cut(df, parts, count)
        if split_ties and len(self.bounds) < min(parts, count) - 1 and any(a == b for a, b in zip(self.picked, self.picked[1:])):
            self.with_tie = True
            self.bounds = self._cut(df, parts, count)

    def _all_keys(self, df: DataFrame) -> list[tuple[Column, bool, T.DataType]]:
        return _keys(df, self.order) + ([(_tie(df), False, T.LongType())] if self.with_tie else [])

    def _cut(self, df: DataFrame, parts: int, count: int) -> list[tuple]:
        keys = self._all_keys(df)
        names = [f"k{i}" for i in range(len(keys))]
        some = df if count <= SAMPLES * parts else df.where(F.rand(11) < SAMPLES * parts / count)
        sample = some.select(*[x.alias(n) for (x, _, _), n in zip(keys, names)])
        ordering = [F.col(n).desc() if down else F.col(n).asc() for n, (_, down, _) in zip(names, keys)]
        seen = [tuple(r) for r in sample.repartition(1).sortWithinPartitions(*ordering).collect()]
        self.picked = [seen[len(seen) * i // parts] for i in range(1, parts)] if seen else []
        return [b for i, b in enumerate(self.picked) if not i or b != self.picked[i - 1]]

    def placed(self, df: DataFrame) -> DataFrame:
        """Adds __part, the number of the range that a row is in."""
        if not self.number:
            return df.withColumn("__part", self.part(df))
        (x, down, _), last = _keys(df, self.order)[0], len(self.bounds)
        found = bucketed(df.withColumn("__k", x), ["__k"], [self.bounds], ["__part"]).drop("__k")
        part = F.col("__part")
        part = F.when(part < 0, last + 2).otherwise(last + 1 - part) if down else part
        return found.withColumn("__part", F.when(F.spark_partition_id() < 0, F.lit(-2)).otherwise(part).cast("long"))  # see ``part``

    def part(self, df: DataFrame) -> Column:
        """The number of the range that a row of ``df`` is in; a binary search among literals."""
        keys = self._all_keys(df)
        if not self.bounds:
            return F.lit(0).cast("long")
        columns = [F.array(*[F.lit(b[i]).cast(kind) for b in self.bounds]) for i, (_, _, kind) in enumerate(keys)]

        def reached(at: Column, i: int = 0) -> Column:
            """Whether the row is at or behind the bound ``at``, from its i-th key on."""
            if i == len(keys):
                return F.lit(True)
            (x, down, _), b = keys[i], F.element_at(columns[i], at)
            behind = (x.isNull() & b.isNotNull()) | F.coalesce(x < b, F.lit(False)) if down else (x.isNotNull() & b.isNull()) | F.coalesce(x > b, F.lit(False))
            return behind | (x.eqNullSafe(b) & reached(at, i + 1))

        steps = F.array(*[F.lit(1 << i) for i in reversed(range(len(self.bounds).bit_length()))])
        found = F.aggregate(steps, F.lit(0), lambda done, step: F.when((done + step <= len(self.bounds)) & reached(F.least(done + step, F.lit(len(self.bounds)))), done + step).otherwise(done))
        # Not deterministic in name only: else the optimizer derives a filter on the search itself for the other side of a join.
        return F.when(F.spark_partition_id() < 0, F.lit(-1)).otherwise(found).cast("long")

    def sorting(self, df: DataFrame) -> list[Column]:
        return [*sort_columns(df, self.order), _tie(df).asc()]


def _before(placed: DataFrame, size: Column, name: str) -> DataFrame:
    """What the ranges before each range sum up to: one row for each range, whose number is bounded."""
    counts = placed.groupBy("__part").agg(size.alias("__n"))
    upto = F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    return counts.select(F.col("__part").alias("__range"), F.coalesce(upto, F.lit(0)).alias(name))


def with_positions(df: DataFrame, order: Key | Sequence[Key] | None = None, name: str = POS) -> DataFrame:
    """Adds ``name``, the rows' 0-based place in ``order``, without a single-task window over the rows.

    The table is cut into ranges; rows are numbered within their range, and the sizes of the
    ranges before are added. Only these sizes meet in one task. Keys are names, or (name,
    direction). Rows with equal keys are placed by a hash of all their cells. Without
    ``order``, rows are numbered as the source gives them; the source's splits then must not
    change between jobs.
    """
    if not order:
        numbered = df.withColumn("__at", F.monotonically_increasing_id())
        part, row = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
        placed = numbered.withColumn("__part", part).withColumn("__row", row).drop("__at")
    else:
        ranges = Ranges(df, order)
        placed = ranges.placed(df)
        placed = placed.withColumn("__row", F.row_number().over(Window.partitionBy("__part").orderBy(*ranges.sorting(df))) - 1)
    out = placed.join(F.broadcast(_before(placed, F.count("*"), "__before")), F.col("__part") == F.col("__range"))
    return out.withColumn("__place", F.col("__before") + F.col("__row")).drop("__part", "__row", "__before", "__range", *([name] if name in df.columns else [])).withColumnRenamed("__place", name)


def with_running_totals(df: DataFrame, order: Key | Sequence[Key], totals: dict[str, str], ranges: Ranges | None = None) -> DataFrame:
    """Adds for each (new name, column) the sum of the column over the rows up to and with this one in ``order``.

    Rows are cut into ranges as in ``with_positions``; one row for each range meets in one
    task. ``order`` must tell all rows apart where running totals of single rows matter.
    """
    ranges = ranges or Ranges(df, order)
    placed = ranges.placed(df)
    within = Window.partitionBy("__part").orderBy(*ranges.sorting(df)).rowsBetween(Window.unboundedPreceding, 0)
    sizes = placed.groupBy("__part").agg(*[F.sum(c).alias(f"__s{i}") for i, c in enumerate(totals.values())])
    ahead = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select(F.col("__part").alias("__range"), *[F.coalesce(F.sum(f"__s{i}").over(ahead), F.lit(0)).alias(f"__s{i}") for i in range(len(totals))])
    out = placed.select("*", *[F.sum(c).over(within).alias(n) for n, c in totals.items()]).join(F.broadcast(before), F.col("__part") == F.col("__range"))
    return out.withColumns({n: F.col(n) + F.col(f"__s{i}") for i, n in enumerate(totals)}).drop("__part", "__range", *[f"__s{i}" for i in range(len(totals))])


#: Neighbouring positions that one task takes when a series without a key is dealt out.
BLOCK = 1 << 16


def blocked(df: DataFrame, back: int, ahead: int = 0, size: int | None = None) -> DataFrame:
    """Rows with POS dealt out in blocks of neighbours, so that windows of bounded reach run on many tasks.

    Adds __block, the key of such windows, and __own, which is false for copies: the last
    ``back`` rows of the block before and the first ``ahead`` rows of the one behind. Rows
    of a window reach no further than these. Copies are to be filtered after the window.
    """
    size = max(size or BLOCK, back, ahead, 1)
    own, at = F.floor(F.col(POS) / size).cast("long"), F.col(POS) % size
    copies = F.array(own, *([F.when(at >= size - back, own + 1)] if back else []), *([F.when((at < ahead) & (own > 0), own - 1)] if ahead else []))
    dealt = df.withColumn("__own_block", own).withColumn("__block", F.explode(F.array_compact(copies)))
    return dealt.withColumn("__own", F.col("__block") == F.col("__own_block")).drop("__own_block")


def _series(parts: Iterator[pd.DataFrame], by: Sequence[str]) -> Iterator[tuple[pd.DataFrame, list[tuple[int, int]]]]:
    """Whole series at the front of each part and where they begin and end; rows come sorted by series."""
    rest: pd.DataFrame | None = None
    for part in parts:
        table = part if rest is None or not len(rest) else pd.concat([rest, part], ignore_index=True)
        cuts = _cuts(table, by)
        if len(cuts) > 2:
            yield table.iloc[: cuts[-2]], list(zip(cuts[:-2], cuts[1:-1]))
            table = table.iloc[cuts[-2] :].reset_index(drop=True)
        rest = table
    if rest is not None and len(rest):
        cuts = _cuts(rest, by)
        yield rest, list(zip(cuts, cuts[1:]))


def _cuts(table: pd.DataFrame, by: Sequence[str]) -> list[int]:
    change = np.zeros(max(0, len(table) - 1), bool)
    for c in by:
        x, empty = table[c].to_numpy(), table[c].isna().to_numpy()
        change |= (x[1:] != x[:-1]) & ~(empty[1:] & empty[:-1])
    return [0, *(np.flatnonzero(change) + 1).tolist(), len(table)]


def _dealt(df: DataFrame, order: str | Sequence[str], by: Sequence[str], heavy: bool = False) -> DataFrame:
    """Series of a task together and in order. Of a kernel that is ``heavy`` for its rows all partitions stay, which Spark joins by bytes otherwise."""
    keys = [*by, *([order] if isinstance(order, str) else order)]
    parts = [int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))] if heavy else []
    return (df.repartition(*parts, *by) if by else df.repartition(1)).sortWithinPartitions(*keys)


def by_series(df: DataFrame, kernel: Callable[..., dict], columns: Sequence[str], outputs: dict[str, str], order: str | Sequence[str] = POS, by: Sequence[str] = (), heavy: bool = False, **options) -> DataFrame:
    """Adds ``outputs`` (name to type), computed by ``kernel`` from the arrays of ``columns`` of each series in order.

    Spark deals out and sorts the rows; a task walks through its series one after another
    and holds one of them at a time besides the batch it reads.
    """
    schema = T.StructType([*df.schema.fields, *T.StructType.fromDDL(", ".join(f"`{n}` {t}" for n, t in outputs.items())).fields])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for table, ranges in _series(parts, by):
            arrays = [table[c].to_numpy() for c in columns]
            found = [kernel(*[x[a:b] for x in arrays], **options) for a, b in ranges]
            yield table.assign(**{n: np.concatenate([np.asarray(f[n]) for f in found]) for n in outputs})

    return _dealt(df, order, by, heavy).mapInPandas(run, schema)


#: Rows of whole series that a task gathers for a kernel of several series.
GATHERED = 1 << 18


def _gathered(series: Iterator[tuple[pd.DataFrame, list[tuple[int, int]]]]) -> Iterator[tuple[pd.DataFrame, list[tuple[int, int]]]]:
    """The same series in larger tables."""
    held, n = [], 0
    for part in series:
        held, n = [*held, part], n + len(part[0])
        if n >= GATHERED:
            yield _together(held)
            held, n = [], 0
    if held:
        yield _together(held)


def _together(held: list[tuple[pd.DataFrame, list[tuple[int, int]]]]) -> tuple[pd.DataFrame, list[tuple[int, int]]]:
    starts = np.cumsum([0, *(len(table) for table, _ in held)]).tolist()
    return pd.concat([table for table, _ in held], ignore_index=True), [(a + start, b + start) for start, (_, ranges) in zip(starts, held) for a, b in ranges]


def summarised(df: DataFrame, kernel: Callable[..., dict], columns: Sequence[str], outputs: dict[str, str], order: str | Sequence[str] = POS, by: Sequence[str] = (), many: bool = False, **options) -> DataFrame:
    """One row for each series: its key and what ``kernel`` returns for its columns in order.

    With ``many`` a kernel takes for each column a list of arrays, one of each of many series,
    and returns a list; a task gathers GATHERED rows for it, or one series if that is longer.
    """
    schema = T.StructType([*(df.schema[c] for c in by), *T.StructType.fromDDL(", ".join(f"`{n}` {t}" for n, t in outputs.items())).fields])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        series = _series(parts, by)
        for table, ranges in _gathered(series) if many else series:
            arrays = [table[c].to_numpy() for c in columns]
            if many:
                rows = kernel(*[[x[a:b] for a, b in ranges] for x in arrays], **options)
            else:
                rows = [kernel(*[x[a:b] for x in arrays], **options) for a, b in ranges]
            found = pd.DataFrame(rows)
            keys = table.iloc[[a for a, _ in ranges]][list(by)].reset_index(drop=True)
            yield pd.concat([keys, found], axis=1)[[*by, *outputs]]

    return _dealt(df.select(*dict.fromkeys([*by, *columns, *([order] if isinstance(order, str) else order)])), order, by, heavy=many).mapInPandas(run, schema)
