"""Expressions of single rows: activations, transforms, calendar and time."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F


def erf(x: Column) -> Column:
    """The error function: its power series up to 3, beyond it the continued fraction of its complement."""
    a = F.least(F.abs(x), F.lit(27.0))
    term, series = F.lit(1.0), a * a
    for k in reversed(range(1, 50)):  # sum of 2^k a^2k / (1 * 3 * ... * (2k + 1)), from the inside
        term = 1 + 2 * series / (2 * k + 1) * term
    small = 2 / math.sqrt(math.pi) * a * F.exp(-series) * term
    tail = a
    for k in reversed(range(1, 40)):
        tail = a + k / 2 / tail
    large = 1 - F.exp(-series) / math.sqrt(math.pi) / tail
    return F.signum(x) * F.when(a <= 3, small).otherwise(large)


def sigmoid(x: Column, kind: str = "logistic") -> Column:
    return {
        "logistic": 1 / (1 + F.exp(-x)), "algebraic": 1 / F.sqrt(1 + x * x), "hyperbolic_tan": F.tanh(x), "arc_tan": F.atan(x), "error_function": erf(x),
        "gudermannian": 2 * F.atan(F.tanh(x / 2)), "smoothstep": F.when(x <= 0, 0.0).when(x >= 1, 1.0).otherwise(x * x * (3 - 2 * x)),
    }[kind]


def rectify(x: Column, kind: str = "ReLU", p: float = 1.0) -> Column:
    return {
        "ReLU": F.greatest(F.lit(0.0), x), "param_ReLU": F.greatest(x, p * x), "GeLU": x * F.exp(-x * x / 2) / math.sqrt(2 * math.pi), "SiLU": x / (1 + F.exp(-x)),
        "softplus": F.log1p(F.exp(p * x)) / p, "elu": F.when(x > 0, x).otherwise(p * F.expm1(x)), "mish": x * F.tanh(F.log1p(F.exp(x))), "metallic_mean": (x + F.sqrt(x * x + 4)) / 2,
    }[kind]


def box_cox(x: Column, lam: float, kind: str = "original", shift: Column | None = None, geometric: Column | None = None) -> Column:
    """original, geometric_mean, modulus or exponential; ``shift`` makes all values positive, ``geometric`` is their geometric mean."""
    y = x + shift if shift is not None else x
    power = lambda v: (F.pow(v, F.lit(float(lam))) - 1) / lam
    if kind == "original":
        return F.log(y) if lam == 0 else power(y)
    if kind == "geometric_mean":
        return geometric * F.log(y) if lam == 0 else power(y) / F.pow(geometric, F.lit(float(lam - 1)))
    if kind == "modulus":
        return F.signum(x) * (F.log(F.abs(x) + 1) if lam == 0 else power(F.abs(x) + 1))
    return x if lam == 0 else (F.exp(lam * x) - 1) / lam


def clip(x: Column, low, high) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def to_bins(x: Column, edges: list[float], right: bool = True, labels: list | None = None, include_lowest: bool = False) -> Column:
    """The label, or else the number, of the interval that holds x; null outside all. ``include_lowest`` closes the first one below."""
    out = F.lit(None)
    for i, (a, b) in reversed(list(enumerate(zip(edges, edges[1:])))):
        low = (x >= a) if not right or (include_lowest and i == 0) else (x > a)
        inside = low & ((x <= b) if right else (x < b))
        out = F.when(inside, F.lit(labels[i] if labels else i)).otherwise(out)
    return out


def equal_width_edges(low: float, high: float, bins: int) -> list[float]:
    """Edges of bins of one width over a range widened by 0.01 % on either side, cut to whole numbers."""
    low, high = low - (high - low) * 0.0001, high + (high - low) * 0.0001
    return [float(int(low + i * (high - low) / bins)) for i in range(bins + 1)]


def weekdays_between(a: Column, b: Column) -> Column:
    """Weekdays after a up to b, in closed form: whole weeks and what is left."""
    days = F.datediff(b, a)
    start = F.weekday(a)
    rest = days % 7
    extra = F.lit(0)
    for i in range(1, 7):
        extra = extra + F.when((F.lit(i) <= rest) & (((start + i) % 7) < 5), 1).otherwise(0)
    return F.floor(days / 7) * 5 + extra


def add_weekdays(a: Column, n: int) -> Column:
    """The n-th weekday after the date a; a weekend counts from the Friday before."""
    day = F.weekday(a)
    base = F.date_sub(a, F.greatest(F.lit(0), day - 4))
    at = F.least(day, F.lit(4))
    return F.date_add(base, (F.floor((at + n) / 5) * 7 + (at + n) % 5 - at).cast("int"))


def is_leap_year(a: Column) -> Column:
    y = F.year(a)
    return ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)


def is_weekend(a: Column) -> Column:
    return F.dayofweek(a).isin(1, 7)


def is_new_year(a: Column) -> Column:
    return (F.month(a) == 1) & (F.dayofmonth(a) == 1)


def is_christmas(a: Column) -> Column:
    return (F.month(a) == 12) & (F.dayofmonth(a) == 25)


def days_in_month(a: Column) -> Column:
    return F.dayofmonth(F.last_day(a))


#: Parts of a time by name; week days count from 1 for Sunday, and nanoseconds are those of whole microseconds.
PARTS = {
    "date": lambda a: F.date_format(a, "yyyyMMdd").cast("int"), "year": F.year, "month": F.month, "dmonth": F.dayofmonth, "dyear": F.dayofyear, "dweek": F.dayofweek, "hour": F.hour, "minute": F.minute, "sec": F.second,
    "msec": lambda a: F.floor(F.pmod(F.unix_micros(a.cast("timestamp")), F.lit(1000000)) / 1000).cast("int"), "microsec": lambda a: F.pmod(F.unix_micros(a.cast("timestamp")), F.lit(1000000)).cast("int"),
    "nanosec": lambda a: (F.pmod(F.unix_micros(a.cast("timestamp")), F.lit(1000000)) * 1000).cast("int"),
    "time": lambda a: F.floor(F.unix_micros(a.cast("timestamp")) / 1000000).cast("long"), "days": lambda a: F.unix_date(F.to_date(a)), "long_time": lambda a: F.unix_micros(a.cast("timestamp")) * 1000,
    "double": lambda a: F.unix_micros(a.cast("timestamp")) / 1e6,
}


def part(a: Column, name: str) -> Column:
    return PARTS[name](a)


# Names of the text forms of a time, and their patterns.
FORMATS = {
    "AMR_DT": "MM/dd/yy", "AMR_DT_CTY": "MM/dd/yyyy", "EUR_DT": "dd/MM/yy", "EUR_DT_CTY": "dd/MM/yyyy", "DT_TM": "MM/dd/yyyy HH:mm:ss", "SCT_DT": "MMM dd, yyyy", "DT_MMDDYYYY": "MMddyyyy", "DT_YYYYMMDD": "yyyyMMdd",
    "DT_TM2": "MM/dd/yyyy HH:mm:ss.SSS", "DT_DATETIME": "yyyyMMdd  HH:mm:ss.SSS", "ISO_DT_TM": "yyyy-MM-dd HH:mm:ss.SSSSSS", "ISO_DT": "yyyy-MM-dd", "ISO_DT_NANO": "yyyy-MM-dd HH:mm:ss.SSSSSSSSS",
    "AMR_DT_TM": "MM/dd/yyyy HH:mm:ss.SSSSSS", "EUR_DT_TM": "dd/MM/yyyy HH:mm:ss.SSSSSS",
}


def string_format(a: Column, form: str) -> Column:
    """A time as text; DT_PRECISE is seconds since 1970, a point and the nanoseconds, without leading zeros."""
    if form == "DT_PRECISE":
        return F.concat_ws(".", part(a, "time").cast("string"), part(a, "nanosec").cast("string"))
    return F.date_format(a, FORMATS[form])


# Names of the time zones, and what the tz database calls them.
ZONES = {
    "GMT": "Etc/GMT", "AM_BUENOS_AIRES": "America/Argentina/Buenos_Aires", "AM_CHICAGO": "America/Chicago", "AM_LOS_ANGELES": "America/Los_Angeles", "AM_MEXICO_CITY": "America/Mexico_City", "AM_NEW_YORK": "America/New_York",
    "AS_DUBAI": "Asia/Dubai", "AS_HONG_KONG": "Asia/Hong_Kong", "AS_SHANGHAI": "Asia/Shanghai", "AS_SINGAPORE": "Asia/Singapore", "AS_TEHRAN": "Asia/Tehran", "AS_TEL_AVIV": "Asia/Tel_Aviv", "AS_TOKYO": "Asia/Tokyo",
    "AU_MELBOURNE": "Australia/Melbourne", "AU_SYDNEY": "Australia/Sydney", "BR_RIO_DE_JANEIRO": "America/Sao_Paulo", "EU_BERLIN": "Europe/Berlin", "EU_LONDON": "Europe/London", "EU_MOSCOW": "Europe/Moscow", "EU_PARIS": "Europe/Paris",
    "EU_ROME": "Europe/Rome", "EU_VIENNA": "Europe/Vienna", "EU_ZURICH": "Europe/Zurich", "UTC": "UTC", "AS_SEOUL": "Asia/Seoul", "AS_TAIPEI": "Asia/Taipei", "EU_STOCKHOLM": "Europe/Stockholm", "NZ": "NZ", "EU_OSLO": "Europe/Oslo",
    "EU_WARSAW": "Europe/Warsaw", "EU_BUDAPEST": "Europe/Budapest",
}


def to_zone(a: Column, zone: str, of: str = "UTC") -> Column:
    """The wall clock in ``zone`` at the wall clock ``a`` of another zone."""
    return F.from_utc_timestamp(F.to_utc_timestamp(a, ZONES[of]), ZONES[zone])


def add(a: Column, unit: str, n: int) -> Column:
    """A time n nanoseconds, seconds, minutes, hours, days, weekdays, months or years later; months keep to their last day."""
    if unit == "weekdays":
        return add_weekdays(F.to_date(a), n)
    if unit == "nanoseconds":
        return F.timestamp_micros(F.unix_micros(a.cast("timestamp")) + n // 1000)
    names = {"seconds": "secs", "minutes": "mins"}
    interval = F.make_interval(**{names.get(unit, unit): F.lit(n)})
    return a + interval


def construct(text: Column, style: str = "ISO", zone: str | None = None) -> Column:
    """A time from YYYYMMDD, AME (month first), EUR (day first) or ISO text, with or without a clock; null if it is none."""
    body = {"YYYYMMDD": "yyyyMMdd", "AME": "M/d/yyyy", "EUR": "d/M/yyyy", "ISO": "y-M-d"}[style]
    found = F.coalesce(*[F.try_to_timestamp(text, F.lit(body + clock)) for clock in ("", " H:m:s", " H:m:s.SSS", " H:m:s.SSSSSS")])
    return F.to_utc_timestamp(found, ZONES[zone]) if zone else found


def is_us_bank_holiday(a: Column) -> Column:
    """Federal bank holidays by their rules; those on a Sunday are kept on Monday."""
    m, d, w = F.month(a), F.dayofmonth(a), F.dayofweek(a)
    fixed = lambda month, day: ((m == month) & (d == day)) | ((m == month) & (d == day + 1) & (w == 2))
    nth = lambda month, day, n: (m == month) & (w == day) & (F.ceil(d / 7) == n)
    memorial = (m == 5) & (w == 2) & (d > 24)
    return fixed(1, 1) | nth(1, 2, 3) | nth(2, 2, 3) | memorial | fixed(6, 19) | fixed(7, 4) | nth(9, 2, 1) | nth(10, 2, 2) | fixed(11, 11) | nth(11, 5, 4) | fixed(12, 25)


def is_us_business_day(a: Column) -> Column:
    return ~F.dayofweek(a).isin(1, 7) & ~is_us_bank_holiday(a)


def time_difference(a: Column, b: Column, unit: str) -> Column:
    """b from a in fractional units."""
    seconds = {"seconds": 1, "minutes": 60, "hours": 3600, "days": 86400, "weeks": 604800}[unit]
    return (F.unix_micros(a) - F.unix_micros(b)) / (1e6 * seconds)


def datetime_index(spark, start: str, end: str, unit: str, step: int = 1) -> DataFrame:
    """Timestamps from start up to end."""
    return spark.range(1).select(F.explode(F.expr(f"sequence(timestamp'{start}', timestamp'{end}', interval {step} {unit})")).alias("INDEX")).where(F.col("INDEX") < F.lit(end).cast("timestamp"))


def sequence_index(spark, start: int, end: int, step: int = 1) -> DataFrame:
    return spark.range(start, end, step).withColumnRenamed("id", "INDEX")


# Numbers by rule: row ``id`` of spark.range(n)


def log_space(spark, n: int, first: float, last: float, base: float = 10.0) -> DataFrame:
    return spark.range(n).select("id", F.pow(F.lit(float(base)), F.lit(float(first)) + F.col("id") * ((last - first) / (n - 1))).alias("value"))


def even_space(spark, n: int, first: float, last: float) -> DataFrame:
    """Begins with ``first`` and ends one step short of ``last``."""
    return spark.range(n).select("id", (F.lit(float(first)) + F.col("id") * ((last - first) / n)).alias("value"))


def triangular_numbers(spark, last: int, first: int = 1) -> DataFrame:
    """i * (i + 1) / 2 from i = ``first`` while it is at most ``last``."""
    most = (math.isqrt(8 * last + 1) - 1) // 2
    return spark.range(first, most + 1).select((F.col("id") - first).alias("id"), (F.col("id") * (F.col("id") + 1) / 2).cast("long").alias("value"))


def symmetric_numbers(spark, n: int, start: float = 1.0, normalize: bool = False) -> DataFrame:
    """Rises by 1 from ``start`` to the middle and falls again."""
    height = F.lit(float(start)) + F.least(F.col("id"), n - 1 - F.col("id"))
    total = sum(start + min(i, n - 1 - i) for i in range(n)) if normalize else 1.0
    return spark.range(n).select("id", (height / total).alias("value"))


def dft_frequencies(spark, n: int, spacing: float = 1.0) -> DataFrame:
    """0 and the positive frequencies, then as many negative ones; the middle one of an even n is left out."""
    middle = (n - 1) // 2 + 1
    return spark.range(2 * middle - 1).select("id", (F.when(F.col("id") < middle, F.col("id")).otherwise(F.col("id") - (2 * middle - 1)) / (n * spacing)).alias("value"))


def drawn(key: Column, seed: int, stream: int = 0) -> Column:
    """A whole number below 2 ** 48 from a digest of a row's key: the same wherever and whenever the row is read."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.lit(stream), key.cast("string"))), 1, 12), 16, 10).cast("long")


def uniform(key: Column, seed: int, stream: int = 0) -> Column:
    """Evenly between 0 and 1, without either."""
    return (drawn(key, seed, stream) + 0.5) / float(1 << 48)


def gauss(key: Column, seed: int, stream: int = 0) -> Column:
    return F.sqrt(-2 * F.log(uniform(key, seed, 2 * stream + 1))) * F.cos(2 * math.pi * uniform(key, seed, 2 * stream + 2))


def _poisson(u: Column, mean: float) -> Column:
    """By its distribution function, up to where no double tells the rest from 1."""
    p, total, bounds, k = math.exp(-mean), 0.0, [], 0
    while total < 1 - 1e-15 and k < 20 * mean + 60:
        total += p
        bounds.append(total)
        k += 1
        p *= mean / k
    return F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b < u)).cast("long")


def _gamma(key: Column, seed: int, shape: float) -> Column:
    """Marsaglia and Tsang's method: the first of 24 tries that is accepted (all fail in less than one row in 10 ** 30)."""
    d = max(shape, shape + 1 if shape < 1 else shape) - 1 / 3
    c, tries = 1 / math.sqrt(9 * d), []
    for i in range(24):
        z, u = gauss(key, seed, 10 + i), uniform(key, seed, 100 + i)
        v = F.pow(1 + c * z, F.lit(3.0))
        tries.append(F.when((1 + c * z > 0) & (F.log(u) < 0.5 * z * z + d - d * v + d * F.log(v)), d * v))
    out = F.coalesce(*tries, F.lit(d))
    return out * F.pow(uniform(key, seed, 7), F.lit(1 / shape)) if shape < 1 else out


def random_column(kind: str, key: Column, seed: int, **p) -> Column:
    """Random values of many distributions, each drawn from a row's ``key``, so that lost rows are drawn again alike."""
    u, z = uniform(key, seed), gauss(key, seed)
    inverse = -F.log(u)
    chi = lambda freedom, s: 2 * _gamma(key, s, freedom / 2)
    prob = p.get("p", 0.5)
    return {
        "uniform_real": lambda: p.get("low", 0.0) + u * (p.get("high", 1.0) - p.get("low", 0.0)), "uniform_int": lambda: (F.lit(p["low"]) + drawn(key, seed) % (p["high"] - p["low"] + 1)).cast("long"),
        "bernoulli": lambda: u < prob, "binomial": lambda: sum(((uniform(key, seed, i) < prob).cast("long") for i in range(p["n"])), F.lit(0)),
        "geometric": lambda: F.floor(inverse / -math.log(1 - prob)).cast("long"), "negative_binomial": lambda: sum((F.floor(-F.log(uniform(key, seed, i)) / -math.log(1 - prob)).cast("long") for i in range(p["n"])), F.lit(0)),
        "poisson": lambda: _poisson(u, p.get("mean", 1.0)), "exponential": lambda: inverse / p.get("rate", 1.0), "gamma": lambda: p.get("scale", 1.0) * _gamma(key, seed, p.get("shape", 1.0)),
        "weibull": lambda: p.get("scale", 1.0) * F.pow(inverse, F.lit(1 / p.get("shape", 1.0))), "extreme_value": lambda: p.get("a", 0.0) - p.get("b", 1.0) * F.log(inverse),
        "normal": lambda: p.get("mean", 0.0) + p.get("std", 1.0) * z, "lognormal": lambda: F.exp(p.get("mean", 0.0) + p.get("std", 1.0) * z), "chi_squared": lambda: chi(p["n"], seed),
        "cauchy": lambda: p.get("a", 0.0) + p.get("b", 1.0) * F.tan(math.pi * (u - 0.5)), "fisher_f": lambda: chi(p["m"], seed) / p["m"] / (chi(p["n"], seed + 1) / p["n"]), "student_t": lambda: z / F.sqrt(chi(p["n"], seed + 1) / p["n"]),
    }[kind]()
