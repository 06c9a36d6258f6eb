"""Projection, filters, ordering, sets, reshaping and repair of missing values."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from larkspur.functions.scalars import drawn
from larkspur.plans import INDEX, POS, Key, Ranges, as_number, blocked, bucketed, joined_back, missing, numeric_bounds, ordered, sort_columns, with_positions

# Projection and columns


def get_data(df: DataFrame, names: Sequence[str], index: str = INDEX) -> DataFrame:
    return df.select(*dict.fromkeys([index, *names]))


def create_column(df: DataFrame, name: str, kind: str) -> DataFrame:
    return df.withColumn(name, F.lit(None).cast(kind))


def remove_column(df: DataFrame, *names: str) -> DataFrame:
    return df.drop(*names)


def rename_column(df: DataFrame, old: str, new: str) -> DataFrame:
    return df.withColumnRenamed(old, new)


def retype_column(df: DataFrame, name: str, convert: Callable[[Column], Column] | str) -> DataFrame:
    return df.withColumn(name, F.col(name).cast(convert) if isinstance(convert, str) else convert(F.col(name)))


def get_column(df: DataFrame, name: str) -> DataFrame:
    """One column; an unknown name is an error, as everywhere."""
    return df.select(name)


def get_index(df: DataFrame, index: str = INDEX) -> DataFrame:
    return df.select(index)


def has_column(df: DataFrame, name: str | int) -> bool:
    return name in df.columns if isinstance(name, str) else 0 <= name < len(df.columns)


def column_number(df: DataFrame, name: str) -> int:
    return df.columns.index(name)


def column_name(df: DataFrame, number: int) -> str:
    return df.columns[number]


def columns_info(df: DataFrame) -> DataFrame:
    """Number, name, type and rows of each column; the rows are counted in one pass."""
    names = [c for c in df.columns if c != POS]
    counted = df.agg(*[F.count(F.lit(1)).alias(c) for c in names])
    kinds = {c: df.schema[c].dataType.simpleString() for c in names}
    return counted.select(F.explode(F.array(*[F.struct(F.lit(i).alias("number"), F.lit(c).alias("name"), F.lit(kinds[c]).alias("type"), F.col(f"`{c}`").alias("rows")) for i, c in enumerate(names)])).alias("c")).select("c.*")


def get_matrix(df: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """Rows of a matrix: the numeric columns as one array, in place of them."""
    numeric = names or [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name != POS]
    return df.select(*[c for c in (INDEX, POS) if c in df.columns], F.array(*[F.col(c).cast("double") for c in numeric]).alias("row"))


def pipe(df: DataFrame, *changes: Callable[[DataFrame], DataFrame]) -> DataFrame:
    for change in changes:
        df = change(df)
    return df


def multi_visit(df: DataFrame, by: Sequence[str] = (), **visits: Column) -> DataFrame:
    """Several aggregates, by name, in one pass."""
    return df.groupBy(*by).agg(*[v.alias(n) for n, v in visits.items()])


def mask(df: DataFrame, name: str, test: Callable[[Column], Column], out: str = "mask") -> DataFrame:
    return df.withColumn(out, test(F.col(name)))


def get_reindexed(df: DataFrame, name: str, old_index: str | None = None, index: str = INDEX) -> DataFrame:
    """Makes a column the index; the old one is dropped or kept under a new name."""
    df = df.withColumnRenamed(index, old_index) if old_index else df.drop(index)
    return df.withColumnRenamed(name, index)


def get_row(df: DataFrame, at: int, names: Sequence[str] | None = None) -> DataFrame:
    return df.where(F.col(POS) == at).select(*(names or df.columns))


def is_equal(a: DataFrame, b: DataFrame) -> bool:
    return a.schema == b.schema and a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def consolidate(df: DataFrame, olds: Sequence[str], new: str, fuse: Callable[..., Column], drop: bool = True) -> DataFrame:
    out = df.withColumn(new, fuse(*[F.col(c) for c in olds]))
    return out.drop(*[c for c in olds if c != new]) if drop else out


def apply(df: DataFrame, name: str, change: Callable[[Column], tuple[Column, Column]], order: str = POS, by: Sequence[str] = ()) -> DataFrame:
    """Changes a column up to and including the first row whose second result is false."""
    value, going = change(F.col(name))
    so_far = F.coalesce(F.min(going.cast("int")).over(ordered(order, by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(1))
    return df.withColumn(name, F.when(so_far == 1, value).otherwise(F.col(name)))


def string_stats(df: DataFrame, name: str) -> DataFrame:
    """Mean and deviation of lengths, and shares of kinds of characters in all characters."""
    x = F.col(name)
    total = F.sum(F.char_length(x))
    share = lambda p: F.sum(F.char_length(x) - F.char_length(F.regexp_replace(x, p, ""))) / total
    return df.agg(
        F.avg(F.char_length(x)).alias("avg_size"), F.stddev_samp(F.char_length(x)).alias("std_size"), share("[A-Za-z]").alias("avg_alphabets"), share("[A-Z]").alias("avg_caps"),
        share("[0-9]").alias("avg_digits"), share(r"[ \t\n\x0B\f\r]").alias("avg_spaces"), share(r"[-+/*]").alias("avg_arithmetic"), share("\n").alias("avg_line_feed"), share(r"[!-/:-@\[-`{-~]").alias("avg_puncts"),
    )


def quantile_of(array: Column, q: float, policy: str = "mid_point") -> Column:
    """The reference rule on an ascending array: the k-th least for k = round(q * n), averaged with the next when n is even or k was rounded down."""
    n = F.size(array)
    k = F.floor(n * q + 0.5).cast("int")
    at = lambda i: F.element_at(array, F.greatest(F.lit(1), F.least(n, i)).cast("int"))
    pair = (k < n) & ((n % 2 == 0) | (k < n * q))
    mid = {"lower": at(k), "higher": at(k + 1), "linear": at(k) * (1 - q) + at(k + 1) * q}.get(policy, (at(k) + at(k + 1)) / 2)
    return F.when(n > 0, F.when(pair, mid).otherwise(at(k)))


def describe(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """COUNT, MISSING, MEAN, STD, MIN, MAX, 25%, 50% and 75% of each column, one row per statistic.

    Sums and extremes are one pass over the columns; quartiles are exact, see ``quantiles``.
    """
    parts = []
    for i, c in enumerate(names):
        x, bad = F.col(c).cast("double"), missing(F.col(c))
        good = F.when(~bad, x)
        parts += [F.struct(F.lit(c).alias("name"), *[v.alias(n) for n, v in (("COUNT", F.count(F.lit(1)).cast("double")), ("MISSING", F.count_if(bad).cast("double")), ("MEAN", F.avg(good)), ("STD", F.stddev_samp(good)), ("MIN", F.min(good)), ("MAX", F.max(good)))]).alias(f"c{i}")]
    base = df.agg(*parts).select(F.explode(F.array(*[f"c{i}" for i in range(len(names))])).alias("c")).select("c.*")
    quarters = column_quantiles(df, names, [0.25, 0.5, 0.75])
    wide = joined_back(base, quarters.withColumnsRenamed({"q0": "25%", "q1": "50%", "q2": "75%"}), ["name"])
    return wide.unpivot("name", ["COUNT", "MISSING", "MEAN", "STD", "MIN", "MAX", "25%", "50%", "75%"], "statistic", "value")


POLICIES = ("mid_point", "lower", "higher", "linear")


def quantiles(df: DataFrame, name: str, qs: Sequence[float], by: Sequence[str] = (), policy: str = "mid_point") -> DataFrame:
    """Exact reference quantiles q0, q1, ... of a column, for each series of ``by``; see ``column_quantiles``."""
    x = F.col(name).cast("double")
    rows = df.where(~missing(x)).select(*by, x.alias("__v"))
    if not by:
        return _picked(bucketed(rows, ["__v"], numeric_bounds(rows, ["__v"]), ["__part"]), qs, [], policy, few=True)
    return _picked(Ranges(rows, [*by, "__v"], split_ties=False).placed(rows), qs, by, policy, few=False)


def column_quantiles(df: DataFrame, names: Sequence[str], qs: Sequence[float], policy: str = "mid_point") -> DataFrame:
    """name, q0, q1, ...: exact quantiles of each column that has values.

    The values are cut into ranges, whose rows are counted where they are; only rows of the
    ranges in which a quantile lies are shuffled, as counts of distinct values. Such a range
    is one task's work, and there are as many ranges as ``plans.range_count`` says.
    """
    outs = [f"__p{i}" for i in range(len(names))]
    placed = bucketed(df.select(*names), names, numeric_bounds(df, names), outs)
    cells = [F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("__v"), F.col(p).alias("__part")) for c, p in zip(names, outs)]
    long = placed.select(F.explode(F.array(*cells)).alias("v")).select("v.*").where(~missing(F.col("__v")))
    return _picked(long, qs, ["name"], policy, few=True)


def _picked(placed: DataFrame, qs: Sequence[float], by: Sequence[str], policy: str, few: bool) -> DataFrame:
    """Quantiles of __v for each series of rows that are placed in ranges __part; ``few`` series have a small table of ranges."""
    if policy not in POLICIES:
        raise ValueError(f"unknown quantile policy {policy}")
    series = Window.partitionBy(*by)  # over one row for each range and series
    sizes = placed.groupBy(*by, "__part").agg(F.count("*").alias("__c"))
    upto = F.sum("__c").over(series.orderBy("__part"))
    sizes = sizes.select(*by, "__part", (upto - F.col("__c")).alias("__lo"), upto.alias("__hi"), F.sum("__c").over(series).alias("__n"))
    n = F.col("__n")
    places = [(k, F.least(n, k + 1)) for k in (F.greatest(F.lit(1), F.least(n, F.floor(n * q + 0.5))) for q in qs)]
    wanted = reduce(lambda a, b: a | b, [(F.col("__lo") < p) & (p <= F.col("__hi")) for pair in places for p in pair])
    some = sizes.where(wanted).drop("__hi").withColumnsRenamed({c: f"__by{i}" for i, c in enumerate([*by, "__part"])})
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__by{i}")) for i, c in enumerate([*by, "__part"])])
    near = placed.join(F.broadcast(some) if few else some, same)  # of few series, two rows a quantile each
    counts = near.groupBy(*by, "__part", "__lo", "__n", "__v").agg(F.count("*").alias("__c"))
    within = F.sum("__c").over(Window.partitionBy(*by, "__part").orderBy("__v")) + F.col("__lo")
    found = counts.select(*by, "__v", (within - F.col("__c")).alias("__lo"), within.alias("__hi"), "__n")
    picks = []
    for i, (q, (k, second)) in enumerate(zip(qs, places)):
        at = lambda j: F.max(F.when((F.col("__lo") < j) & (j <= F.col("__hi")), F.col("__v")))
        pair = F.max(((n % 2 == 0) | (F.floor(n * q + 0.5) < n * q)).cast("int")) == 1
        value = {"mid_point": (at(k) + at(second)) / 2, "lower": at(k), "higher": at(second), "linear": at(k) * (1 - q) + at(second) * q}[policy]
        picks.append(F.when(pair, value).otherwise(at(k)).alias(f"q{i}"))
    return found.groupBy(*by).agg(*picks)


# Filters


def get_data_by_sel(df: DataFrame, where: Column) -> DataFrame:
    return df.where(where)


def remove_data_by_sel(df: DataFrame, where: Column) -> DataFrame:
    return df.where(~F.coalesce(where, F.lit(False)))


def get_data_by_idx(df: DataFrame, begin=None, end=None, values: Sequence | None = None, index: str = INDEX) -> DataFrame:
    """The inclusive range, or the rows whose index is among ``values``."""
    return df.where(F.col(index).isin(list(values)) if values is not None else F.col(index).between(begin, end))


def _by_loc(df: DataFrame, begin: int, end: int, inclusive: str) -> tuple[DataFrame, Column]:
    p, first, last = F.col(POS), F.lit(begin), F.lit(end)
    if begin < 0 or end < 0:
        df = joined_back(df, df.agg((F.max(POS) + 1).alias("__n")))
        first = F.col("__n") + begin if begin < 0 else first
        last = F.col("__n") + end + 1 if end < 0 else last
    return df, (p >= first if inclusive in ("begin", "both") else p > first) & (p <= last if inclusive in ("end", "both") else p < last)


def get_data_by_loc(df: DataFrame, begin: int, end: int, inclusive: str = "begin") -> DataFrame:
    """Rows by position; negative positions count from the end."""
    rows, inside = _by_loc(df, begin, end, inclusive)
    return rows.where(inside).select(*df.columns)


def remove_data_by_loc(df: DataFrame, begin: int, end: int, inclusive: str = "begin") -> DataFrame:
    rows, inside = _by_loc(df, begin, end, inclusive)
    return rows.where(~inside).select(*df.columns)


def remove_data_by_idx(df: DataFrame, begin=None, end=None, values: Sequence | None = None, index: str = INDEX) -> DataFrame:
    return remove_data_by_sel(df, F.col(index).isin(list(values)) if values is not None else F.col(index).between(begin, end))


def truncate(df: DataFrame, before, after, index: str = INDEX) -> DataFrame:
    """Keeps the rows whose index is from ``before`` to ``after``, both included."""
    return df.where(F.col(index).between(before, after))


def get_data_by_locs(df: DataFrame, locations: Sequence[int]) -> DataFrame:
    """The rows at each listed position, in the list's order and as often as it names them."""
    spark = df.sparkSession
    wanted = spark.createDataFrame(list(enumerate(locations)), f"__order long, {POS} long")
    return df.join(F.broadcast(wanted), POS).orderBy("__order")


def glob_to_regex(pattern: str, escape: str = "\\") -> str:
    """An anchored regular expression for *, ?, [...] and [^...] with an escape character."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == escape and i + 1 < len(pattern):
            i += 1
            out.append(re.escape(pattern[i]))
        elif c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[" and "]" in pattern[i + 1 :]:
            end = pattern.index("]", i + 2 if pattern[i + 1 : i + 2] != "^" else i + 3)
            inner = pattern[i + 1 : end].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "\\&&")
            out.append(f"[{inner}]")
            i = end
        else:
            out.append(re.escape(c))
        i += 1
    return "(?s)^" + "".join(out) + "$"


def like(x: Column, pattern: str, case_insensitive: bool = False, escape: str = "\\") -> Column:
    return x.rlike(("(?i)" if case_insensitive else "") + glob_to_regex(pattern, escape))


def get_data_by_like(df: DataFrame, patterns: dict[str, str], case_insensitive: bool = False, escape: str = "\\", remove: bool = False) -> DataFrame:
    where = F.lit(True)
    for name, pattern in patterns.items():
        where = where & like(F.col(name), pattern, case_insensitive, escape)
    return remove_data_by_sel(df, where) if remove else df.where(where)


def get_data_every_n(df: DataFrame, n: int, start: int = 0) -> DataFrame:
    return df.where((F.col(POS) >= start) & ((F.col(POS) - start) % n == 0))


#: Draws that one row stands for before they are dealt out.
DRAWS = 1 << 16


def get_data_by_rand(df: DataFrame, n: float, seed: int = 0, fraction: bool = False) -> DataFrame:
    """Draws n positions with replacement and returns their rows once each, in order.

    Draws come from digests of their numbers and the seed, the same in every run.
    """
    one = df.agg((F.max(POS) + 1).alias("__n")).where("__n > 0")
    many = F.floor(F.col("__n") * n).cast("long") if fraction else F.lit(int(n)).cast("long")
    starts = one.withColumn("__many", many).where("__many > 0").select("__n", "__many", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__many") - 1, F.lit(DRAWS).cast("long"))).alias("__from")).repartition("__from")
    numbers = starts.select("__n", F.explode(F.sequence("__from", F.least(F.col("__from") + DRAWS, F.col("__many")) - 1)).alias("__draw"))
    return df.join(numbers.select((drawn(F.col("__draw"), seed) % F.col("__n")).alias(POS)).distinct(), POS, "left_semi")


def micros_of_day(at: Column) -> Column:
    minutes = F.hour(at).cast("long") * 60 + F.minute(at)
    return minutes * 60_000_000 + (F.extract(F.lit("SECOND"), at) * 1_000_000).cast("long")


def _clock(h: int, m: int = 0, s: int = 0, ms: int = 0) -> int:
    return ((h * 60 + m) * 60 + s) * 1_000_000 + ms * 1000


def at_times(df: DataFrame, index: str, hour: int, minute: int = 0, second: int = 0, ms: int = 0) -> DataFrame:
    """Within the given millisecond."""
    at = _clock(hour, minute, second, ms)
    return df.where(micros_of_day(F.col(index)).between(at, at + 999))


def before_times(df: DataFrame, index: str, hour: int, minute: int = 0, second: int = 0, ms: int = 0, literal: bool = False) -> DataFrame:
    """Earlier in the day; ``literal`` gives the comparison that tests each part without requiring the greater ones to be equal."""
    x = F.col(index)
    if literal:
        return df.where((F.hour(x) < hour) | ((F.hour(x) == hour) & (F.minute(x) < minute)) | ((F.minute(x) == minute) & (F.second(x) < second)))
    return df.where(micros_of_day(x) < _clock(hour, minute, second, ms))


def after_times(df: DataFrame, index: str, hour: int, minute: int = 0, second: int = 0, ms: int = 0, literal: bool = False) -> DataFrame:
    x = F.col(index)
    if literal:
        return df.where((F.hour(x) > hour) | ((F.hour(x) == hour) & (F.minute(x) > minute)) | ((F.minute(x) == minute) & (F.second(x) > second)))
    return df.where(micros_of_day(x) > _clock(hour, minute, second, ms))


def between_times(df: DataFrame, index: str, start: tuple, end: tuple, inclusive: str = "neither", literal: bool = False) -> DataFrame:
    """Between two times of day; ``inclusive`` is neither, begin, end or both.

    ``literal`` gives the form whose including side wants each part of the clock, by itself,
    at or beyond that of the bound.
    """
    x = F.col(index)
    if literal:

        def each(bound: tuple, up: bool) -> Column:
            parts = zip((F.hour(x), F.minute(x), F.second(x)), (*bound, 0, 0))
            return reduce(lambda a, b: a & b, [(v >= b) if up else (v <= b) for v, b in parts])

        begun = df.where(each(start, True)) if inclusive in ("begin", "both") else after_times(df, index, *start, literal=True)
        return begun.where(each(end, False)) if inclusive in ("end", "both") else before_times(begun, index, *end, literal=True)
    low, high, now = _clock(*start), _clock(*end), micros_of_day(x)
    return df.where((now >= low if inclusive in ("begin", "both") else now > low) & (now <= high if inclusive in ("end", "both") else now < high))


def on_days(df: DataFrame, index: str, days: Sequence[int]) -> DataFrame:
    """Days of the week, from 1 for Sunday."""
    return df.where(F.dayofweek(index).isin(list(days)))


def on_days_in_month(df: DataFrame, index: str, days: Sequence[int]) -> DataFrame:
    return df.where(F.dayofmonth(index).isin(list(days)))


def in_months(df: DataFrame, index: str, months: Sequence[int]) -> DataFrame:
    return df.where(F.month(index).isin(list(months)))


def by_stdev(df: DataFrame, name: str, high: float, low: float, remove: bool = False) -> DataFrame:
    """Rows whose population z-score is strictly between; or, removing, all but those beyond either."""
    x = F.when(~missing(F.col(name)), F.col(name))
    z = (F.col(name) - F.col("__m")) / F.col("__s")
    joined = joined_back(df, df.agg(F.avg(x).alias("__m"), F.stddev_pop(x).alias("__s")))
    return joined.where(~((z > high) | (z < low)) if remove else (z > low) & (z < high)).drop("__m", "__s")


def by_quantile(df: DataFrame, name: str, q: float, above: bool = True, remove: bool = False) -> DataFrame:
    joined = joined_back(df, quantiles(df, name, [q]).withColumnRenamed("q0", "__q"))
    x, v = F.col(name), F.col("__q")
    where = (~(x > v) if above else ~(x < v)) if remove else (x >= v if above else x < v)
    return joined.where(where).drop("__q")


def in_between(x: Column, low, high, inclusive: str = "begin") -> Column:
    left = x >= low if inclusive in ("begin", "both") else x > low
    right = x <= high if inclusive in ("end", "both") else x < high
    return (left & right).cast("int")


def _flag(test: Column, negate: bool = False) -> Column:
    found = F.coalesce(test, F.lit(False))
    return (~found if negate else found).cast("int")


def starts_with(x: Column, prefix: str) -> Column:
    return _flag(x.startswith(prefix))


def ends_with(x: Column, suffix: str) -> Column:
    return _flag(x.endswith(suffix))


def is_nan_mask(x: Column, negate: bool = False) -> Column:
    return _flag(missing(x), negate)


def is_infinity_mask(x: Column, negate: bool = False) -> Column:
    return _flag(F.abs(x) == float("inf"), negate)


def is_default_mask(x: Column, default=0, negate: bool = False) -> Column:
    """1 where a cell holds its type's default: 0, an empty text or false."""
    return _flag(x == F.lit(default), negate)


def peaks(x: Column, n: int, order: str = POS, by: Sequence[str] = (), valleys: bool = False) -> Column:
    """1 where a value is strictly above (below) its n neighbours on each side; 0 near the ends."""
    w = ordered(order, by)
    tests = [(x < f(x, i).over(w)) if valleys else (x > f(x, i).over(w)) for i in range(1, n + 1) for f in (F.lag, F.lead)]
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return F.coalesce(out, F.lit(False)).cast("int")


def class_count(df: DataFrame, to_class: Column) -> DataFrame:
    return df.groupBy(to_class.alias("class")).agg(F.count("*").alias("count"))


def pattern_match(df: DataFrame, name: str, pattern: str, order: str | Sequence[str] = POS, by: Sequence[str] = (), epsilon: float = 0.0) -> DataFrame:
    """Whether a whole column rises, falls, or spreads as a normal one by the three-sigma rule.

    Neighbours of a series without a key are compared in blocks, on many tasks.
    """
    x = F.col(name)
    if pattern.endswith(("increasing", "decreasing")):
        if by:
            rows, before = df, F.lag(x).over(ordered(order, by))
        else:
            rows = blocked(df if order == POS and POS in df.columns else with_positions(df, order), 1)
            before = F.lag(x).over(ordered(POS, ["__block"]))
        ok = {
            "monotonic_increasing": x >= before - epsilon, "strictly_monotonic_increasing": x > before,
            "monotonic_decreasing": x <= before + epsilon, "strictly_monotonic_decreasing": x < before,
        }[pattern]
        return rows.select(ok.alias("ok")).agg(F.coalesce(F.bool_and("ok"), F.lit(True)).alias("matches"))
    v = F.log(x) if pattern == "log_normally_distributed" else x
    one = df.agg(F.avg(v).alias("__m"), F.stddev_samp(v).alias("__s"))
    centre, spread = (F.lit(0.0), F.lit(1.0)) if pattern == "standard_normally_distributed" else (F.col("__m"), F.col("__s"))
    d = F.abs(v - centre) / spread
    near = lambda k, share: F.abs(F.avg((d <= k).cast("double")) - share) <= 0.01 + epsilon
    return joined_back(df, one).agg((near(1, 0.68) & near(2, 0.95) & near(3, 0.997)).alias("matches"))


def unique_values(df: DataFrame, name: str) -> DataFrame:
    return df.groupBy(name).agg(F.min(POS).alias(POS)).orderBy(POS)


def first_last_valid(df: DataFrame, name: str) -> DataFrame:
    ok = F.when(~missing(F.col(name)), F.col(POS))
    return df.agg(F.min(ok).alias("first_valid"), F.max(ok).alias("last_valid"))


# Order


def sort(df: DataFrame, keys: dict[str, str], place: str | None = None) -> DataFrame:
    """Keys with ascen, desce, abs_ascen or abs_desce; with ``place``, each row's 0-based place instead of an order of rows."""
    order = list(keys.items())
    return with_positions(df, order, place) if place else df.orderBy(*sort_columns(df, order))


def sort_freq(df: DataFrame, name: str, spec: str = "ascen", place: str | None = None, then: Sequence[Key] = ()) -> DataFrame:
    """By how often a value occurs, then by the value, both in the same direction."""
    x = F.abs(name) if spec.startswith("abs") else F.col(name)
    keyed = df.withColumn("__x", x)
    counted = joined_back(keyed, keyed.groupBy("__x").agg(F.count("*").alias("__n")), ["__x"])
    direction = "desce" if spec.endswith("desce") else "ascen"
    return sort(counted, {"__n": direction, "__x": direction} | {k if isinstance(k, str) else k[0]: "ascen" if isinstance(k, str) else k[1] for k in then}, place).drop("__n", "__x")


def permutation(df: DataFrame, keys: dict[str, str]) -> DataFrame:
    """POS of the row that belongs at each ``place`` of the sorted table; equal rows keep their order."""
    return with_positions(df.select(POS, *[k for k in keys if k != POS]), [*keys.items(), POS], "place").select("place", POS)


def top_n(df: DataFrame, name: str, n: int, smallest: bool = False, absolute: bool = False, sorted_by_value: bool = False, order: str = POS) -> DataFrame:
    """The n largest rows: in their old order, or sorted by the value; of equal rows the first by ``order``."""
    x = F.abs(name) if absolute else F.col(name)
    picked = df.where(~missing(F.col(name))).orderBy(x.asc() if smallest else x.desc(), order).limit(n)
    return picked if sorted_by_value else picked.orderBy(order)


def remove_top_n(df: DataFrame, name: str, n: int, smallest: bool = False, order: str = POS) -> DataFrame:
    """``order`` tells rows apart."""
    return df.join(F.broadcast(top_n(df, name, n, smallest, order=order).select(order)), order, "left_anti")  # n rows


def shuffle(df: DataFrame, names: Sequence[str], seed: int = 0) -> DataFrame:
    """Each named column is dealt out anew over the rows, independently of the others, by digests of places and seed."""
    out = df
    for i, name in enumerate(names):
        dealt = with_positions(df.select(POS, F.col(name).alias("__new"), drawn(F.col(POS), seed, i).alias("__draw")), ["__draw", POS], "__to")
        out = out.join(dealt.select(F.col("__to").alias(POS), "__new"), POS).drop(name).withColumnRenamed("__new", name)
    return out.select(*df.columns)


# Sets


def concat(a: DataFrame, b: DataFrame, policy: str = "all_columns") -> DataFrame:
    if policy == "all_columns":
        return a.unionByName(b, allowMissingColumns=True)
    common = [c for c in a.columns if c in b.columns]
    return a.select(common).unionByName(b.select(common)) if policy == "common_columns" else a.unionByName(b.select(common), allowMissingColumns=True)


def difference(a: DataFrame, b: DataFrame, index: str = INDEX) -> DataFrame:
    """Rows of equal index in which any common cell differs, with both cells."""
    names = [c for c in a.columns if c in b.columns and c != index]
    x, y = a.select(index, *[F.col(c).alias(f"self.{c}") for c in names]), b.select(index, *[F.col(c).alias(f"other.{c}") for c in names])
    differs = F.lit(False)
    for c in names:
        differs = differs | ~F.col(f"`self.{c}`").eqNullSafe(F.col(f"`other.{c}`"))
    return x.join(y, index).where(differs)


def remove_duplicates(df: DataFrame, names: Sequence[str], keep: str = "first", order: str = POS) -> DataFrame:
    """keep is first, last or none; of the first two Spark keeps one row a key before it shuffles."""
    if keep == "none":
        return joined_back(df, df.groupBy(*names).agg(F.count("*").alias("__n")), names).where("__n = 1").drop("__n")
    rank = F.row_number().over(Window.partitionBy(*names).orderBy(F.col(order).asc() if keep == "first" else F.col(order).desc()))
    return df.withColumn("__n", rank).where("__n = 1").drop("__n")


def duplication_mask(df: DataFrame, names: Sequence[str], binary: bool = False) -> DataFrame:
    """How often each cell's value occurs in its column, or whether more than once; counts are joined back."""
    for c in names:
        n = F.col("__n")
        df = joined_back(df, df.groupBy(c).agg(F.count("*").alias("__n")), [c]).withColumn(f"{c}_dup", (n > 1).cast("int") if binary else n).drop("__n")
    return df


# Shape


def explode(df: DataFrame, name: str, place: str | None = None) -> DataFrame:
    """One row per element of an array or entry of a map, numbered in ``place`` if that is given; empty ones disappear."""
    x = F.map_entries(name) if df.schema[name].dataType.typeName() == "map" else F.col(name)
    if place:
        return df.select(*[c for c in df.columns if c != name], F.posexplode(x).alias(place, name))
    return df.withColumn(name, F.explode(x))


def unpivot(df: DataFrame, pivot: str, values: Sequence[str], variable: str = "variable", value: str = "values") -> DataFrame:
    return df.unpivot(pivot, list(values), variable, value)


def pivot(df: DataFrame, names: str, values: Sequence[str], index: str = INDEX, known: Sequence | None = None, pick: Callable[[str], Column] = F.first) -> DataFrame:
    """Long to wide; ``pick`` chooses among rows of one index and name."""
    grouped = df.groupBy(index).pivot(names, known) if known else df.groupBy(index).pivot(names)
    return grouped.agg(*[pick(v).alias(v) for v in values])


def transpose(df: DataFrame, names: Sequence[str], new_names: Sequence[str], order: str = POS) -> DataFrame:
    """Rows become columns; one row for each old column."""
    long = df.unpivot(order, list(names), "column", "value")
    picks = [F.max(F.when(F.col(order) == i, F.col("value"))).alias(n) for i, n in enumerate(new_names)]
    return long.groupBy("column").agg(*picks)


def load_indicators(df: DataFrame, name: str, values: Sequence, prefix: str = "") -> DataFrame:
    return df.select("*", *[F.coalesce(F.col(name) == v, F.lit(False)).cast("int").alias(f"{prefix}{v}") for v in values])


def from_indicators(df: DataFrame, names: Sequence[str], category: str, prefix: str = "") -> DataFrame:
    return df.withColumn(category, F.coalesce(*[F.when(F.col(n) != 0, F.lit(n[len(prefix) :])) for n in names]))


def shift(df: DataFrame, names: Sequence[str], n: int, up: bool = False, order: str = POS, by: Sequence[str] = ()) -> DataFrame:
    f = F.lead if up else F.lag
    return df.withColumns({c: f(c, n).over(ordered(order, by)) for c in names})


def rotate(df: DataFrame, names: Sequence[str], n: int, up: bool = False, by: Sequence[str] = ()) -> DataFrame:
    """Circular shift, by a join on the position that each value moves to."""
    size = df.groupBy(*by).agg(F.count("*").alias("__n")) if by else df.agg(F.count("*").alias("__n"))
    sized = df.join(size, list(by)) if by else joined_back(df, size)
    to = F.pmod(F.col(POS) + (-n if up else n), F.col("__n")).cast("long")
    moved = sized.select(*by, to.alias(POS), *names)
    return df.drop(*names).join(moved, [*by, POS]).select(*df.columns)


# Missing values


def fill_missing(df: DataFrame, name: str, policy: str, value=None, limit: int | None = None, index: str = INDEX, order: str = POS, by: Sequence[str] = ()) -> DataFrame:
    """value, fill_forward, fill_backward, linear_interpolate (over the index) or mid_point; ``limit`` bounds the fills of the column."""
    x = F.when(~missing(F.col(name)), F.col(name))
    w = ordered(order, by)
    # Values behind a row are found by walking backwards, since Spark sums up a frame that reaches to the end anew for each row.
    placed = df.withColumn("__n", F.row_number().over(w)) if policy in ("fill_backward", "mid_point", "linear_interpolate") else df
    back, ahead = w.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*by).orderBy(F.desc("__n")).rowsBetween(Window.unboundedPreceding, -1)
    last, following = F.last(x, ignorenulls=True).over(back), F.last(x, ignorenulls=True).over(ahead)
    if policy == "value":
        filled = F.lit(value)
    elif policy == "fill_forward":
        filled = last
    elif policy == "fill_backward":
        filled = following
    elif policy == "mid_point":
        filled = (F.lag(x).over(w) + following) / 2
    elif policy == "linear_interpolate":
        i = as_number(df, index)
        known = F.when(x.isNotNull(), i)
        i0, i1 = F.last(known, ignorenulls=True).over(back), F.last(known, ignorenulls=True).over(ahead)
        filled = last + (following - last) * (i - i0) / (i1 - i0)
    else:
        raise ValueError(f"unknown fill policy {policy}")
    out = placed.withColumn("__fill", filled).withColumn("__can", x.isNull() & F.col("__fill").isNotNull())
    allowed = F.col("__can") if limit is None else F.col("__can") & (F.sum(F.col("__can").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)) <= limit)
    return out.withColumn(name, F.when(allowed, F.col("__fill")).otherwise(F.col(name))).drop("__fill", "__can", "__n")


def drop_missing(df: DataFrame, names: Sequence[str], policy: str = "any", threshold: int = 0) -> DataFrame:
    """any, all, or threshold: rows with more than ``threshold`` missing cells go."""
    n = sum((missing(F.col(c)).cast("int") for c in names), F.lit(0))
    return df.where({"any": n == 0, "all": n < len(names), "threshold": n <= threshold}[policy])


def replace(df: DataFrame, name: str, olds: Sequence | Callable[[Column], Column], news: Sequence = (), limit: int = -1, order: str = POS, by: Sequence[str] = ()) -> DataFrame:
    """Listed values by others, at most ``limit`` of them; or each value by a function of it, null where it stays."""
    x = F.col(name)
    found = olds(x) if callable(olds) else F.coalesce(*[F.when(x == a, F.lit(b)) for a, b in zip(olds, news)])
    if limit < 0:
        return df.withColumn(name, F.coalesce(found, x))
    hits = F.sum(found.isNotNull().cast("int")).over(ordered(order, by).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("__hits", hits).withColumn(name, F.when((F.col("__hits") <= limit) & found.isNotNull(), found).otherwise(x)).drop("__hits")


def make_stationary(df: DataFrame, name: str, method: str, order: str = POS, by: Sequence[str] = ()) -> DataFrame:
    """differencing (the first row copies the second), log_trans or sqrt_trans; see ``cleaning`` for the other methods."""
    x, w = F.col(name), ordered(order, by)
    value = {"differencing": F.coalesce(x - F.lag(x).over(w), F.lead(x).over(w) - x), "log_trans": F.log(x), "sqrt_trans": F.sqrt(x)}[method]
    return df.withColumn(name, value)
