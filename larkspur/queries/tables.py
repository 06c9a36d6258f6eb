"""Selection, joins, groups, order, sets, shape and missing values."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.functions import scalars as S, sequential as Q
from larkspur.operators import cleaning as C, frame as O, grouping as G, joins as J, loading as L
from larkspur.plans import POS, summarised
from larkspur.queries.registry import AT, BARS, BY, FIXED, SERIES, bars, fixed, query, r, rows

@query(
    "groupby2",
    """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(avg(l_extendedprice), 4) AS mean_price, count(*) AS n
    FROM lineitem GROUP BY 1, 2 ORDER BY 1, 2""",
)
def _groupby2(t):
    return G.groupby(t("lineitem"), ["l_returnflag", "l_linestatus"], F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.avg("l_extendedprice"), 4).alias("mean_price"), F.count("*").alias("n"))


# Selection


@query("get_data", "SELECT o_orderkey, o_totalprice FROM orders")
def _get_data(t):
    return O.get_data(t("orders"), ["o_totalprice"], "o_orderkey")


@query("get_data_by_sel", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 30 AND l_discount < 0.05")
def _sel(t):
    return O.get_data_by_sel(t("lineitem"), (F.col("l_quantity") > 30) & (F.col("l_discount") < 0.05)).select("l_orderkey", "l_linenumber", "l_quantity")


@query("get_data_by_idx", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey BETWEEN 100 AND 5000")
def _idx(t):
    return O.get_data_by_idx(t("orders"), 100, 5000, index="o_orderkey").select("o_orderkey", "o_custkey")


@query("get_data_by_loc", "SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS p, count(*) OVER () AS n FROM orders) WHERE p >= 10 AND p < n - 9")
def _loc(t):
    return O.get_data_by_loc(rows(t, "orders", "o_orderkey"), 10, -10).select("o_orderkey")


@query("get_data_by_like", "SELECT p_partkey, p_name FROM part WHERE regexp_matches(lower(p_name), '^.*a[^x-z].e.*$')")
def _like(t):
    return O.get_data_by_like(t("part"), {"p_name": "*A[^x-z]?e*"}, case_insensitive=True).select("p_partkey", "p_name")


@query("get_data_every_n", "SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS p FROM orders) WHERE p >= 3 AND (p - 3) % 7 = 0")
def _every(t):
    return O.get_data_every_n(rows(t, "orders", "o_orderkey"), 7, 3).select("o_orderkey")


def draw(seed: int, stream: int, key: str) -> str:
    return f"('0x' || substr(md5('{seed}:{stream}:' || ({key})::VARCHAR), 1, 12))::BIGINT"


@query("get_data_by_rand", f"SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS p FROM orders) WHERE p IN (SELECT {draw(5, 0, 'i')} % (SELECT count(*) FROM orders) FROM range((SELECT floor(count(*) * 0.1)::BIGINT FROM orders)) d(i))")
def _rand(t):
    return O.get_data_by_rand(rows(t, "orders", "o_orderkey"), 0.1, 5, True).select("o_orderkey")


@query("get_data_by_locs", "SELECT i AS place, o_orderkey FROM (VALUES (0, 5), (1, 2), (2, 5), (3, 700)) v(i, p) JOIN (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS p FROM orders) USING (p)")
def _locs(t):
    return O.get_data_by_locs(rows(t, "orders", "o_orderkey"), [5, 2, 5, 700]).select(F.col("__order").cast("int").alias("place"), "o_orderkey")


@query("remove_data_by_loc", "SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS p, count(*) OVER () AS n FROM orders) WHERE NOT (p >= 10 AND p < n - 9)")
def _not_loc(t):
    return O.remove_data_by_loc(rows(t, "orders", "o_orderkey"), 10, -10).select("o_orderkey")


@query("remove_data_by_idx", "SELECT o_orderkey FROM orders WHERE NOT o_orderkey BETWEEN 100 AND 5000")
def _not_idx(t):
    return O.remove_data_by_idx(t("orders"), 100, 5000, index="o_orderkey").select("o_orderkey")


@query("remove_data_by_sel", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE NOT (l_quantity > 30 AND l_discount < 0.05)")
def _not_sel(t):
    return O.remove_data_by_sel(t("lineitem"), (F.col("l_quantity") > 30) & (F.col("l_discount") < 0.05)).select("l_orderkey", "l_linenumber")


@query("remove_data_by_like", "SELECT p_partkey FROM part WHERE NOT regexp_matches(lower(p_name), '^.*a[^x-z].e.*$')")
def _not_like(t):
    return O.get_data_by_like(t("part"), {"p_name": "*A[^x-z]?e*"}, case_insensitive=True, remove=True).select("p_partkey")


@query("truncate", "SELECT o_orderkey FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1996-06-30'")
def _truncate(t):
    return O.truncate(t("orders"), F.lit("1995-01-01").cast("timestamp"), F.lit("1996-06-30").cast("timestamp"), "o_orderdate").select("o_orderkey")


@query("get_row", "SELECT c_name, c_acctbal FROM (SELECT *, row_number() OVER (ORDER BY c_custkey) - 1 AS p FROM customer) WHERE p = 41")
def _row(t):
    return O.get_row(rows(t, "customer", "c_custkey"), 41, ["c_name", "c_acctbal"])


@query("get_reindexed", 'SELECT c_name AS "INDEX", c_custkey AS old, c_acctbal FROM customer')
def _reindexed(t):
    return O.get_reindexed(t("customer").select("c_custkey", "c_name", "c_acctbal"), "c_name", "old", "c_custkey").withColumnRenamed("c_custkey", "INDEX")


@query("manage_columns", "SELECT s_suppkey AS key, s_acctbal::BIGINT AS balance, NULL::DOUBLE AS empty FROM (SELECT s_suppkey, trunc(s_acctbal) AS s_acctbal FROM supplier)")
def _columns(t):
    df = O.create_column(O.rename_column(O.remove_column(t("supplier"), "s_name", "s_nationkey"), "s_suppkey", "key"), "empty", "double")
    return O.rename_column(O.retype_column(df, "s_acctbal", "bigint"), "s_acctbal", "balance")


@query("columns_info", "SELECT * FROM (VALUES (0, 's_suppkey', 'bigint'), (1, 's_name', 'string'), (2, 's_nationkey', 'int'), (3, 's_acctbal', 'double')) v(number, name, type), (SELECT count(*) AS rows FROM supplier)")
def _info(t):
    df = t("supplier")
    assert O.has_column(df, "s_name") and not O.has_column(df, "x") and O.column_name(df, O.column_number(df, "s_name")) == "s_name"
    return O.columns_info(df)


@query("get_matrix", "SELECT p, i, CASE i WHEN 0 THEN c_custkey::DOUBLE WHEN 1 THEN c_nationkey::DOUBLE ELSE c_acctbal END AS x FROM (SELECT *, row_number() OVER (ORDER BY c_custkey) - 1 AS p FROM customer), range(3) r(i)")
def _matrix(t):
    return O.explode(O.get_matrix(rows(t, "customer", "c_custkey")), "row", "i").select(F.col(POS).alias("p"), F.col("i").cast("long").alias("i"), F.col("row").alias("x"))


@query("transpose", "SELECT name AS column, max(v) FILTER (r_regionkey = 0) AS a, max(v) FILTER (r_regionkey = 1) AS b, max(v) FILTER (r_regionkey = 2) AS c FROM (SELECT r_regionkey, unnest(['r_regionkey', 'size']) AS name, unnest([r_regionkey::BIGINT, length(r_name)]) AS v FROM region) GROUP BY 1")
def _transpose(t):
    df = rows(t, "region", "r_regionkey").select(POS, F.col("r_regionkey").cast("long").alias("r_regionkey"), F.char_length("r_name").cast("long").alias("size"))
    return O.transpose(df, ["r_regionkey", "size"], ["a", "b", "c"])


@query("apply", f"SELECT event_id, CASE WHEN coalesce(bool_and(value < 300) OVER ({SERIES} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) THEN value * 2 ELSE value END AS value FROM events")
def _apply(t):
    return O.apply(t("events"), "value", lambda x: (x * 2, x < 300), AT, BY).select("event_id", "value")


@query("pipe", "SELECT l_returnflag, max(l_quantity) AS top, count(*) AS n FROM lineitem WHERE l_tax > 0.02 GROUP BY 1")
def _pipe(t):
    return O.pipe(t("lineitem"), lambda df: df.where("l_tax > 0.02"), lambda df: O.multi_visit(df, ["l_returnflag"], top=F.max("l_quantity"), n=F.count("*")))


@query("before_times", "SELECT event_id FROM events WHERE ts::TIME < TIME '10:30:00'")
def _before(t):
    return O.before_times(t("events"), "ts", 10, 30).select("event_id")


@query("between_times", "SELECT event_id FROM events WHERE ts::TIME > TIME '09:00:00' AND ts::TIME < TIME '17:30:00'")
def _between(t):
    return O.between_times(t("events"), "ts", (9, 0), (17, 30)).select("event_id")


@query("after_times", "SELECT event_id FROM events WHERE ts::TIME > TIME '10:30:00'")
def _after(t):
    return O.after_times(t("events"), "ts", 10, 30).select("event_id")


@query("before_times_literal", "SELECT event_id FROM events WHERE hour(ts) < 10 OR (hour(ts) = 10 AND minute(ts) < 30) OR (minute(ts) = 30 AND second(ts) < 20)")
def _before_literal(t):
    return O.before_times(t("events"), "ts", 10, 30, 20, literal=True).select("event_id")


@query("after_times_literal", "SELECT event_id FROM events WHERE hour(ts) > 10 OR (hour(ts) = 10 AND minute(ts) > 30) OR (minute(ts) = 30 AND second(ts) > 20)")
def _after_literal(t):
    return O.after_times(t("events"), "ts", 10, 30, 20, literal=True).select("event_id")


@query("between_times_inclusive", "SELECT event_id FROM events WHERE ts::TIME >= TIME '09:00:00' AND ts::TIME <= TIME '17:30:00'")
def _between_both(t):
    return O.between_times(t("events"), "ts", (9, 0), (17, 30), "both").select("event_id")


@query("between_times_literal", "SELECT event_id FROM events WHERE hour(ts) >= 9 AND minute(ts) >= 10 AND second(ts) >= 0 AND hour(ts) <= 17 AND minute(ts) <= 30 AND second(ts) <= 40")
def _between_literal(t):
    return O.between_times(t("events"), "ts", (9, 10), (17, 30, 40), "both", True).select("event_id")


@query("at_times", "SELECT event_id FROM events WHERE hour(ts) = 12 AND minute(ts) = 0 AND second(ts) = 0 AND microsecond(ts) % 1000000 < 1000")
def _at(t):
    return O.at_times(t("events"), "ts", 12).select("event_id")


@query("on_days", "SELECT event_id FROM events WHERE dayofweek(ts) IN (0, 6)")
def _days(t):
    return O.on_days(t("events"), "ts", [1, 7]).select("event_id")


@query("on_days_in_month", "SELECT o_orderkey FROM orders WHERE day(o_orderdate) IN (1, 15)")
def _month_days(t):
    return O.on_days_in_month(t("orders"), "o_orderdate", [1, 15]).select("o_orderkey")


@query("in_months", "SELECT o_orderkey FROM orders WHERE month(o_orderdate) IN (2, 11)")
def _months(t):
    return O.in_months(t("orders"), "o_orderdate", [2, 11]).select("o_orderkey")


@query("get_data_by_stdev", "SELECT o_orderkey FROM (SELECT o_orderkey, (o_totalprice - avg(o_totalprice) OVER ()) / stddev_pop(o_totalprice) OVER () AS z FROM orders) WHERE z > -1 AND z < 1")
def _stdev(t):
    return O.by_stdev(t("orders"), "o_totalprice", 1, -1).select("o_orderkey")


_QUANTILE = "(SELECT CASE WHEN n % 2 = 0 OR k < n * {q} THEN (v[k] + v[least(n, k + 1)]) / 2 ELSE v[k] END FROM (SELECT v, n, greatest(1, least(n, floor(n * {q} + 0.5)::BIGINT)) AS k FROM (SELECT list({x} ORDER BY {x}) AS v, count({x}) AS n FROM {t})))"


@query("above_quantile", f"SELECT o_orderkey FROM orders WHERE o_totalprice >= {_QUANTILE.format(q=0.9, x='o_totalprice', t='orders')}")
def _above(t):
    return O.by_quantile(t("orders"), "o_totalprice", 0.9).select("o_orderkey")


@query("remove_below_quantile", f"SELECT o_orderkey FROM orders WHERE NOT o_totalprice < {_QUANTILE.format(q=0.3, x='o_totalprice', t='orders')}")
def _below(t):
    return O.by_quantile(t("orders"), "o_totalprice", 0.3, above=False, remove=True).select("o_orderkey")


@query("below_quantile", f"SELECT o_orderkey FROM orders WHERE o_totalprice < {_QUANTILE.format(q=0.3, x='o_totalprice', t='orders')}")
def _below_data(t):
    return O.by_quantile(t("orders"), "o_totalprice", 0.3, above=False).select("o_orderkey")


@query("remove_above_quantile", f"SELECT o_orderkey FROM orders WHERE NOT o_totalprice > {_QUANTILE.format(q=0.9, x='o_totalprice', t='orders')}")
def _not_above(t):
    return O.by_quantile(t("orders"), "o_totalprice", 0.9, remove=True).select("o_orderkey")


@query("remove_data_by_stdev", "SELECT o_orderkey FROM (SELECT o_orderkey, (o_totalprice - avg(o_totalprice) OVER ()) / stddev_pop(o_totalprice) OVER () AS z FROM orders) WHERE NOT (z > 1 OR z < -1)")
def _not_stdev(t):
    return O.by_stdev(t("orders"), "o_totalprice", 1, -1, remove=True).select("o_orderkey")


@query("more_masks", "SELECT event_id, ends_with(event_type, 'e')::INT AS ends, starts_with(event_type, 'c')::INT AS begins, (value < 5)::INT AS boundless, (value >= 5)::INT AS bounded, (value::INT = 7)::INT AS seven, (value::INT <> 7)::INT AS other, (value >= 5)::INT AS known FROM events")
def _more_masks(t):
    x, far = F.col("value"), F.when(F.col("value") < 5, float("inf")).otherwise(F.col("value"))
    whole = F.bround("value").cast("int")
    return t("events").select(
        "event_id", O.ends_with(F.col("event_type"), "e").alias("ends"), O.starts_with(F.col("event_type"), "c").alias("begins"), O.is_infinity_mask(far).alias("boundless"), O.is_infinity_mask(far, True).alias("bounded"),
        O.is_default_mask(whole, 7).alias("seven"), O.is_default_mask(whole, 7, True).alias("other"), O.is_nan_mask(F.when(x >= 5, x), True).alias("known"),
    )


@query("masks", "SELECT c_custkey, (c_acctbal >= 0 AND c_acctbal < 1000)::INT AS small, starts_with(c_name, 'Customer')::INT AS named, (c_acctbal IS NULL OR isnan(c_acctbal))::INT AS bad FROM customer")
def _masks(t):
    return t("customer").select("c_custkey", O.in_between(F.col("c_acctbal"), 0, 1000).alias("small"), O.starts_with(F.col("c_name"), "Customer").alias("named"), O.missing(F.col("c_acctbal")).cast("int").alias("bad"))


@query("peaks", f"SELECT event_id, coalesce(value > lag(value) OVER w AND value > lead(value) OVER w AND value > lag(value, 2) OVER w AND value > lead(value, 2) OVER w, false)::INT AS peak, coalesce(value < lag(value) OVER w AND value < lead(value) OVER w, false)::INT AS valley FROM events WINDOW w AS ({SERIES})")
def _peaks(t):
    return t("events").select("event_id", O.peaks(F.col("value"), 2, AT, BY).alias("peak"), O.peaks(F.col("value"), 1, AT, BY, True).alias("valley"))


@query("class_count", "SELECT CASE WHEN l_quantity < 10 THEN 'low' WHEN l_quantity < 40 THEN 'mid' ELSE 'high' END AS class, count(*) AS count FROM lineitem GROUP BY 1")
def _class(t):
    q = F.col("l_quantity")
    return O.class_count(t("lineitem"), F.when(q < 10, "low").when(q < 40, "mid").otherwise("high"))


@query("count_if", "SELECT count(*) FILTER (l_quantity > 25 AND l_tax < 0.04) AS n FROM lineitem")
def _count(t):
    return t("lineitem").agg(F.count_if((F.col("l_quantity") > 25) & (F.col("l_tax") < 0.04)).alias("n"))


_RISING = "(SELECT coalesce(bool_and(ok), true) FROM (SELECT {test} AS ok FROM (SELECT {x} AS x, lag({x}) OVER (ORDER BY ts, event_id) AS b FROM events)))"
_NEAR = "(SELECT bool_and(abs(s - e) <= 0.01) FROM (SELECT unnest([avg((d <= 1)::INT), avg((d <= 2)::INT), avg((d <= 3)::INT)]) AS s, unnest([0.68, 0.95, 0.997]) AS e FROM (SELECT abs(v - {m}) / {s} AS d FROM (SELECT {v} AS v FROM orders))))"
_PATTERNS = (
    ("monotonic_increasing", "event_id", _RISING.format(x="event_id", test="x >= b")), ("strictly_monotonic_increasing", "event_id", _RISING.format(x="event_id", test="x > b")), ("monotonic_decreasing", "value", _RISING.format(x="value", test="x <= b")),
    ("strictly_monotonic_decreasing", "value", _RISING.format(x="value", test="x < b")), ("normally_distributed", "o_totalprice", _NEAR.format(v="o_totalprice", m="(SELECT avg(o_totalprice) FROM orders)", s="(SELECT stddev_samp(o_totalprice) FROM orders)")),
    ("standard_normally_distributed", "o_totalprice", _NEAR.format(v="o_totalprice", m="0", s="1")), ("log_normally_distributed", "o_totalprice", _NEAR.format(v="ln(o_totalprice)", m="(SELECT avg(ln(o_totalprice)) FROM orders)", s="(SELECT stddev_samp(ln(o_totalprice)) FROM orders)")),
)


@query("pattern_match", " UNION ALL ".join(f"SELECT '{p}' AS pattern, {sql} AS matches" for p, _, sql in _PATTERNS))
def _pattern(t):
    found = [O.pattern_match(t("orders") if x == "o_totalprice" else t("events"), x, p, "o_orderkey" if x == "o_totalprice" else AT).select(F.lit(p).alias("pattern"), "matches") for p, x, _ in _PATTERNS]
    return O.pipe(found[0], *[(lambda df, more=f: df.unionByName(more)) for f in found[1:]])


@query("unique_values", "SELECT o_orderpriority, min(p) AS first_at FROM (SELECT o_orderpriority, row_number() OVER (ORDER BY o_orderkey) - 1 AS p FROM orders) GROUP BY 1")
def _unique(t):
    return O.unique_values(rows(t, "orders", "o_orderkey"), "o_orderpriority").withColumnRenamed(POS, "first_at")


@query("first_last_valid", "SELECT min(p) AS first_valid, max(p) AS last_valid FROM (SELECT o_totalprice, o_orderpriority, row_number() OVER (ORDER BY o_orderkey) - 1 AS p FROM orders) WHERE o_orderpriority = '2-HIGH' AND o_totalprice > 300000")
def _valid(t):
    gaps = rows(t, "orders", "o_orderkey").withColumn("x", F.when((F.col("o_orderpriority") == "2-HIGH") & (F.col("o_totalprice") > 300000), F.col("o_totalprice")))
    return O.first_last_valid(gaps, "x")


@query("inversion_count", "SELECT n_regionkey, count(*) FILTER (a.n_nationkey > b.n_nationkey) AS inversions FROM (SELECT n_regionkey, n_nationkey, n_name FROM nation) a JOIN nation b USING (n_regionkey) WHERE a.n_name < b.n_name GROUP BY 1")
def _inversions(t):
    return summarised(t("nation"), Q.inversions, ["n_nationkey"], {"inversions": "bigint"}, "n_name", ["n_regionkey"])


_KINDS = {"avg_alphabets": "[A-Za-z]", "avg_caps": "[A-Z]", "avg_digits": "[0-9]", "avg_spaces": r"[ \t\n\x0B\f\r]", "avg_arithmetic": "[-+/*]", "avg_line_feed": r"\n", "avg_puncts": r"[!-/:-@\[-`{-~]"}


@query("string_stats", "SELECT round(avg(length(text)), 6) AS avg_size, round(stddev_samp(length(text)), 6) AS std_size, " + ", ".join(f"round(sum(length(text) - length(regexp_replace(text, '{p}', '', 'g'))) / sum(length(text)), 9) AS {n}" for n, p in _KINDS.items()) + " FROM documents")
def _strings(t):
    return O.string_stats(t("documents"), "text").select(r("avg_size").alias("avg_size"), r("std_size").alias("std_size"), *[r(n, 9).alias(n) for n in _KINDS])


_DESCRIBE = " UNION ALL ".join(
    f"""SELECT '{c}' AS name, s AS statistic, round(v, 6) AS value FROM (SELECT unnest(['COUNT', 'MISSING', 'MEAN', 'STD', 'MIN', 'MAX', '25%', '50%', '75%']) AS s,
    unnest([count(*)::DOUBLE, 0.0, avg({c}), stddev_samp({c}), min({c}), max({c}), {_QUANTILE.format(q=0.25, x=c, t="lineitem")}, {_QUANTILE.format(q=0.5, x=c, t="lineitem")}, {_QUANTILE.format(q=0.75, x=c, t="lineitem")}]) AS v FROM lineitem)"""
    for c in ("l_quantity", "l_extendedprice")
)


@query("describe", _DESCRIBE)
def _describe(t):
    return O.describe(t("lineitem"), ["l_quantity", "l_extendedprice"]).withColumn("value", r("value"))


@query("consolidate", "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net FROM lineitem")
def _consolidate(t):
    return O.consolidate(t("lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_discount"), ["l_extendedprice", "l_discount"], "net", lambda a, b: r(a * (1 - b), 4))


# Joins


for _policy, _sql in (("inner_join", "JOIN"), ("left_join", "LEFT JOIN"), ("right_join", "RIGHT JOIN"), ("left_right_join", "FULL JOIN")):

    def _joined(t, policy=_policy):
        return J.join_by_column(t("orders").select("o_custkey", "o_orderkey"), t("customer").select(F.col("c_custkey").alias("o_custkey"), "c_name"), "o_custkey", policy)

    query(f"join_by_column_{_policy}", f"SELECT coalesce(o_custkey, c_custkey) AS o_custkey, o_orderkey, c_name FROM orders {_sql} customer ON o_custkey = c_custkey")(_joined)

    # Keys beyond the other table's on either side, so that some rows have no partner.
    def _outside(t, policy=_policy):
        a = t("supplier").select((F.col("s_suppkey") * 7).alias("k"), "s_name", F.col("s_acctbal").alias("x"))
        return J.join_by_index(a, t("customer").select((F.col("c_custkey") * 5).alias("k"), F.col("c_acctbal").alias("x")), policy, "k")

    query(f"join_by_index_{_policy}", f'SELECT coalesce(s_suppkey * 7, c_custkey * 5) AS k, s_name, s_acctbal AS "lhs.x", c_acctbal AS "rhs.x" FROM supplier {_sql} customer ON s_suppkey * 7 = c_custkey * 5')(_outside)


@query("join_literal", """WITH a AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS i FROM customer), b AS (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS j, count(*) OVER (PARTITION BY s_nationkey) AS m FROM supplier)
    SELECT c_custkey, s_suppkey FROM a JOIN b ON c_nationkey = s_nationkey WHERE i = 1 OR j = m""")
def _literal(t):
    a, b = rows(t, "customer", "c_custkey").select(POS, F.col("c_nationkey").alias("k"), "c_custkey"), rows(t, "supplier", "s_suppkey").select(POS, F.col("s_nationkey").alias("k"), "s_suppkey")
    return J.join_literal(a, b, "k").select("c_custkey", "s_suppkey")


@query("join_by_index", "SELECT n.n_regionkey AS r_regionkey, n_name, r_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey")
def _join_index(t):
    return J.join_by_index(t("nation").select(F.col("n_regionkey").alias("r_regionkey"), "n_name"), t("region"), "inner_join", "r_regionkey")


@query("gen_join", """SELECT a.p AS __pos, CASE WHEN c_acctbal >= s_acctbal THEN c_custkey END AS "lhs.c_custkey", CASE WHEN c_acctbal < s_acctbal THEN s_suppkey END AS "rhs.s_suppkey"
    FROM (SELECT *, row_number() OVER (ORDER BY c_custkey) - 1 AS p FROM customer) a JOIN (SELECT *, row_number() OVER (ORDER BY s_suppkey) - 1 AS p FROM supplier) b USING (p)""")
def _gen(t):
    out = J.gen_join(rows(t, "customer", "c_custkey"), rows(t, "supplier", "s_suppkey"), lambda: F.when(F.col("`lhs.c_acctbal`") >= F.col("`rhs.s_acctbal`"), "include_left").otherwise("include_right"))
    return out.select(POS, "`lhs.c_custkey`", "`rhs.s_suppkey`")


_QUOTES = "q AS (SELECT user_id, ts, min(value) AS quote FROM events WHERE event_type = (SELECT min(event_type) FROM events) GROUP BY 1, 2)"


def _asof(t, policy, tolerance=None, by=BY):
    e = t("events")
    kind = e.agg(F.min("event_type").alias("__k"))
    quotes = e.join(F.broadcast(kind), F.col("event_type") == F.col("__k")).groupBy(*by, "ts").agg(F.min("value").alias("quote")).withColumn(POS, F.lit(0))
    return J.asof_join(e.select("event_id", "user_id", "ts"), quotes, "ts", ["quote"], policy, tolerance, by).select("event_id", "quote")


@query("asof_join_backward", f"WITH {_QUOTES} SELECT event_id, quote FROM events e ASOF LEFT JOIN q ON e.user_id = q.user_id AND e.ts >= q.ts")
def _asof_back(t):
    return _asof(t, "backward")


@query("asof_join_forward", f"WITH {_QUOTES} SELECT event_id, quote FROM events e ASOF LEFT JOIN q ON e.user_id = q.user_id AND e.ts <= q.ts")
def _asof_ahead(t):
    return _asof(t, "forward")


@query("asof_join_nearest", f"WITH {_QUOTES}, b AS (SELECT event_id, e.ts, q.ts AS bt, quote AS bq FROM events e ASOF LEFT JOIN q ON e.user_id = q.user_id AND e.ts >= q.ts), f AS (SELECT event_id, q.ts AS ft, quote AS fq FROM events e ASOF LEFT JOIN q ON e.user_id = q.user_id AND e.ts <= q.ts) SELECT event_id, CASE WHEN bt IS NOT NULL AND (ft IS NULL OR ts - bt <= ft - ts) THEN bq ELSE fq END AS quote FROM b JOIN f USING (event_id)")
def _asof_near(t):
    return _asof(t, "nearest")


@query("asof_join_tolerance", f"WITH {_QUOTES} SELECT event_id, CASE WHEN epoch_us(e.ts) - epoch_us(q.ts) <= 3600000000 THEN quote END AS quote FROM events e ASOF LEFT JOIN q ON e.user_id = q.user_id AND e.ts >= q.ts")
def _asof_near_enough(t):
    return _asof(t, "backward", 3600)


# One series of all users: ranges of time in place of keys.
_MARKET = "q AS (SELECT ts, min(value) AS quote FROM events WHERE event_type = (SELECT min(event_type) FROM events) GROUP BY 1)"
for _policy, _sign in (("backward", ">="), ("forward", "<=")):

    def _whole_asof(t, policy=_policy):
        return _asof(t, policy, None, [])

    query(f"asof_join_whole_{_policy}", f"WITH {_MARKET} SELECT event_id, quote FROM events e ASOF LEFT JOIN q ON e.ts {_sign} q.ts")(_whole_asof)


@query("combine", "SELECT a.p AS __pos, a.c_acctbal + b.s_acctbal AS c_acctbal FROM (SELECT *, row_number() OVER (ORDER BY c_custkey) - 1 AS p FROM customer) a JOIN (SELECT *, row_number() OVER (ORDER BY s_suppkey) - 1 AS p FROM supplier) b USING (p)")
def _combine(t):
    return J.combine([rows(t, "customer", "c_custkey"), rows(t, "supplier", "s_suppkey").withColumnRenamed("s_acctbal", "c_acctbal")], "c_acctbal", lambda a, b: a + b)


@query("modify_by_idx", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN c_custkey * 2.0 ELSE c_acctbal END AS c_acctbal FROM customer")
def _modify(t):
    c = t("customer").select("c_custkey", "c_acctbal")
    return J.modify_by_idx(c, c.where("c_acctbal < 0").withColumn("c_acctbal", F.col("c_custkey") * 2.0), "c_custkey")


for _name, _sign, _how in (("plus", "+", lambda a, b: a + b), ("minus", "-", lambda a, b: a - b), ("multiplies", "*", lambda a, b: a * b), ("divides", "/", F.try_divide)):

    def _frames(t, how=_how):
        a = t("customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("x"))
        b = t("supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("x"))
        return J.arithmetic(a, b, lambda x, y: fixed(how(x, y)), "k")

    query(f"frame_{_name}", f"SELECT c_custkey AS k, {FIXED(f'c_acctbal {_sign} nullif(s_acctbal, 0)' if _sign == '/' else f'c_acctbal {_sign} s_acctbal')} AS x FROM customer JOIN supplier ON c_custkey = s_suppkey")(_frames)

    def _scalar(t, how=_how):
        return J.arithmetic(t("orders").select("o_orderkey", "o_totalprice"), 2.5, lambda x, y: fixed(how(x, y)), "o_orderkey")

    query(f"scalar_{_name}", f"SELECT o_orderkey, {FIXED(f'o_totalprice {_sign} 2.5')} AS o_totalprice FROM orders")(_scalar)


@query("frame_arithmetic", "SELECT o_orderkey, round(o_totalprice + o_totalprice / 2, 4) AS o_totalprice FROM orders")
def _arith(t):
    o = t("orders").select("o_orderkey", "o_totalprice")
    return J.arithmetic(o, J.arithmetic(o, 2.0, lambda a, b: a / b, "o_orderkey"), lambda a, b: r(a + b, 4), "o_orderkey")


# Groups


@query("groupby1", "SELECT l_returnflag, max(l_orderkey) AS \"INDEX\", round(avg(l_quantity), 6) AS m, count(*) AS n FROM lineitem GROUP BY 1")
def _group1(t):
    return G.groupby(t("lineitem"), ["l_returnflag"], r(F.avg("l_quantity")).alias("m"), F.count("*").alias("n"), index=F.max("l_orderkey"))


@query("groupby3", "SELECT l_returnflag, l_linestatus, l_linenumber, round(stddev_samp(l_quantity), 6) AS s FROM lineitem GROUP BY 1, 2, 3")
def _group3(t):
    return G.groupby(t("lineitem"), ["l_returnflag", "l_linestatus", "l_linenumber"], r(F.stddev_samp("l_quantity")).alias("s"))


@query("value_counts", "SELECT o_orderpriority AS \"INDEX\", count(*) AS counts FROM orders GROUP BY 1")
def _counts(t):
    return G.value_counts(t("orders"), "o_orderpriority")


@query("crosstab", "SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F')::DOUBLE AS \"F\", count(*) FILTER (o_orderstatus = 'O')::DOUBLE AS \"O\", count(*) FILTER (o_orderstatus = 'P')::DOUBLE AS \"P\" FROM orders GROUP BY 1")
def _crosstab(t):
    return G.crosstab(t("orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "P"])


_CROSS = "SELECT o_orderpriority AS r, count(*) FILTER (o_orderstatus = 'F')::DOUBLE AS f, count(*) FILTER (o_orderstatus = 'O')::DOUBLE AS o, count(*) FILTER (o_orderstatus = 'P')::DOUBLE AS p, count(*)::DOUBLE AS a FROM orders GROUP BY 1"


@query("crosstab_margins", f"WITH c AS ({_CROSS}) SELECT r AS o_orderpriority, f AS \"F\", o AS \"O\", p AS \"P\", a AS \"All\" FROM c UNION ALL SELECT 'All', sum(f), sum(o), sum(p), sum(a) FROM c")
def _margins(t):
    return G.crosstab(t("orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "P"], margins=True)


for _norm, _by in (("all", "sum(a) OVER ()"), ("row", "a"), ("column", "sum({}) OVER ()")):

    def _normalised(t, norm=_norm):
        c = G.crosstab(t("orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "P"], normalise=norm)
        return c.select("o_orderpriority", *[fixed(n, 9).alias(n) for n in ("F", "O", "P")])

    query(f"crosstab_{_norm}", f"WITH c AS ({_CROSS}) SELECT r AS o_orderpriority, " + ", ".join(f'{FIXED(f"{n} / {_by.format(n)}", 9)} AS "{n.upper()}"' for n in "fop") + " FROM c")(_normalised)


@query("pivot_table", "SELECT l_returnflag, round(avg(l_quantity) FILTER (l_linestatus = 'F'), 6) AS \"F\", round(avg(l_quantity) FILTER (l_linestatus = 'O'), 6) AS \"O\" FROM lineitem GROUP BY 1")
def _pivot_table(t):
    return G.pivot_table(t("lineitem"), "l_returnflag", "l_linestatus", ["F", "O"], r(F.avg("l_quantity")))


@query("covariance_matrix", "SELECT unnest(['l_quantity', 'l_discount']) AS \"column\", round(unnest([covar_samp(l_quantity, l_quantity), covar_samp(l_quantity, l_discount)]), 6) AS l_quantity, round(unnest([covar_samp(l_quantity, l_discount), covar_samp(l_discount, l_discount)]), 6) AS l_discount FROM lineitem")
def _cov(t):
    return G.covariance_matrix(t("lineitem"), ["l_quantity", "l_discount"]).select("column", r("l_quantity").alias("l_quantity"), r("l_discount").alias("l_discount"))


@query("covariance_scaled", "WITH s AS (SELECT (l_quantity - min(l_quantity) OVER ()) / (max(l_quantity) OVER () - min(l_quantity) OVER ()) AS a, (l_discount - min(l_discount) OVER ()) / (max(l_discount) OVER () - min(l_discount) OVER ()) AS b FROM lineitem) SELECT unnest(['l_quantity', 'l_discount']) AS \"column\", round(unnest([covar_samp(a, a), covar_samp(a, b)]), 7) AS l_quantity, round(unnest([covar_samp(a, b), covar_samp(b, b)]), 7) AS l_discount FROM s")
def _cov_scaled(t):
    return G.covariance_matrix(t("lineitem"), ["l_quantity", "l_discount"], "min_max").select("column", r("l_quantity", 7).alias("l_quantity"), r("l_discount", 7).alias("l_discount"))


@query("bucketize_by_count", "SELECT bucket, n FROM (SELECT p // 100 AS bucket, max(p // 100) OVER () AS l, count(*) AS n FROM (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS p FROM orders) GROUP BY 1) WHERE bucket < l")
def _by_count(t):
    return G.bucketize_by_count(rows(t, "orders", "o_orderkey"), 100, F.count("*").alias("n"))


def anchored(keys: str, order: str, at: str, distance: float, source: str = "events") -> str:
    """CTEs: e, the rows numbered in their series, and g, with the bucket that each is in and where it began."""
    same = " AND ".join(f"p.{k} = x.{k}" for k in keys.split(", ")) + " AND " if keys else ""
    return f"""e AS (SELECT *, row_number() OVER ({'PARTITION BY ' + keys if keys else ''} ORDER BY {order}) AS rn, {at} AS tt FROM {source}),
    g AS (SELECT *, tt AS start, 0 AS bucket FROM e WHERE rn = 1 UNION ALL SELECT x.*, CASE WHEN x.tt - p.start >= {distance} THEN x.tt ELSE p.start END, p.bucket + (x.tt - p.start >= {distance})::INT FROM g p JOIN e x ON {same}x.rn = p.rn + 1)"""


@query("bucketize_by_distance", f"WITH RECURSIVE {anchored('user_id', 'ts, event_id', 'epoch_us(ts) / 1e6', 86400)}, c AS (SELECT user_id, bucket, count(*) AS n, round(avg(value), 6) AS m FROM g GROUP BY 1, 2) SELECT user_id, bucket::BIGINT AS bucket, n, m FROM (SELECT *, max(bucket) OVER (PARTITION BY user_id) AS l FROM c) WHERE bucket < l")
def _by_distance(t):
    return G.bucketize_by_distance(t("events"), "ts", 86400.0, F.count("*").alias("n"), r(F.avg("value")).alias("m"), by=BY, columns=["value"])


@query("resample_hourly", f"WITH RECURSIVE {anchored('user_id', 'ts, event_id', 'epoch_us(ts) / 1e6', 7200)} SELECT user_id, bucket::BIGINT AS bucket, count(*) AS n FROM g GROUP BY 1, 2")
def _hourly(t):
    return G.resample(t("events"), "ts", "hourly", 2, F.count("*").alias("n"), by=BY, keep_last=True, columns=[])


_WEEK = "(date_trunc('week', o_orderdate + INTERVAL 1 DAY) - INTERVAL 1 DAY)"
for _frequency, _n, _unit in (("weekly", 1, _WEEK), ("weekly", 3, _WEEK), ("monthly", 5, "date_trunc('month', o_orderdate)"), ("annual", 2, "date_trunc('year', o_orderdate)")):

    def _calendar(t, frequency=_frequency, n=_n):
        return G.resample(t("orders"), "o_orderdate", frequency, n, F.count("*").alias("n"), r(F.max("o_totalprice"), 2).alias("top"))

    query(f"resample_{_n}_{_frequency}", f"""WITH u AS (SELECT *, ({_unit})::TIMESTAMP AS unit FROM orders), k AS (SELECT unit, (row_number() OVER (ORDER BY unit) - 1) // {_n} AS g FROM (SELECT DISTINCT unit FROM u)),
        c AS (SELECT min(unit) AS bucket, count(*) AS n, max(o_totalprice) AS top FROM u JOIN k USING (unit) GROUP BY g) SELECT bucket, n, top FROM c WHERE bucket < (SELECT max(bucket) FROM c)""")(_calendar)


@query("vwap", f"""WITH RECURSIVE {anchored('user_id', 'ts, event_id', 'epoch_us(ts) / 1e6', 259200)}, c AS (SELECT user_id, bucket, count(*) AS n, avg(value) AS a, sum(value * s) AS ps, sum(s) AS v, max(value) AS hi, min(value) AS lo FROM (SELECT *, length(event_type)::DOUBLE AS s FROM g) GROUP BY 1, 2)
    SELECT user_id, bucket::BIGINT AS bucket, n AS event_count, {FIXED('a')} AS average_price, {FIXED('ps / v')} AS vwap, v AS total_volume, hi AS high_price, lo AS low_price, {FIXED('sum(ps) OVER w / sum(v) OVER w')} AS cumulative_vwap, max(hi) OVER w AS cumulative_high_price FROM c WINDOW w AS (PARTITION BY user_id ORDER BY bucket)""")
def _vwap(t):
    e = t("events").withColumn("s", F.char_length("event_type").cast("double"))
    out = G.volume_weighted_prices(e, "ts", "value", "s", 259200.0, BY)
    return out.select("user_id", "bucket", "event_count", fixed("average_price").alias("average_price"), fixed("vwap").alias("vwap"), "total_volume", "high_price", "low_price", fixed("cumulative_vwap").alias("cumulative_vwap"), "cumulative_high_price")


@query("vwbas", f"""WITH RECURSIVE {BARS}, {anchored('user_id', 'day', 'epoch(day)', 604800, 'bars')}, c AS (SELECT user_id, bucket, avg(high) - avg(low) AS sp, avg(low) AS b, sum(high * volume) / sum(volume) AS va, sum(low * volume) / sum(volume) AS vb, sum(high * volume) AS ha, sum(low * volume) AS lb, sum(volume) AS v FROM g GROUP BY 1, 2)
    SELECT user_id, bucket::BIGINT AS bucket, {FIXED('sp')} AS spread, {FIXED('100 * sp / b')} AS percent_spread, {FIXED('va - vb')} AS vwbas, {FIXED('100 * (va - vb) / vb')} AS percent_vwbas, {FIXED('sum(ha) OVER w / sum(v) OVER w - sum(lb) OVER w / sum(v) OVER w')} AS cumulative_vwbas FROM c WINDOW w AS (PARTITION BY user_id ORDER BY bucket)""")
def _vwbas(t):
    out = G.volume_weighted_spreads(bars(t), "day", "low", "high", "volume", "volume", 604800.0, BY)
    return out.select("user_id", "bucket", *[fixed(c).alias(c) for c in ("spread", "percent_spread", "vwbas", "percent_vwbas", "cumulative_vwbas")])


@query("resample_monthly", "SELECT bucket, n, total FROM (SELECT date_trunc('month', o_orderdate) AS bucket, count(*) AS n, round(sum(o_totalprice), 2) AS total, max(date_trunc('month', o_orderdate)) OVER () AS l FROM orders GROUP BY 1) WHERE bucket < l")
def _resample(t):
    return G.resample(t("orders"), "o_orderdate", "monthly", 1, F.count("*").alias("n"), r(F.sum("o_totalprice"), 2).alias("total"))


# Order, sets, shape


@query("top_n", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def _top(t):
    return O.top_n(t("orders"), "o_totalprice", 20, order="o_orderkey").select("o_orderkey", "o_totalprice")


@query("bottom_n", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 20")
def _bottom(t):
    return O.top_n(t("orders"), "o_totalprice", 20, smallest=True, order="o_orderkey").select("o_orderkey", "o_totalprice")


@query("n_smallest", "SELECT c_custkey, c_acctbal FROM customer ORDER BY abs(c_acctbal), c_custkey LIMIT 15")
def _small(t):
    return O.top_n(t("customer"), "c_acctbal", 15, True, True, True, "c_custkey").select("c_custkey", "c_acctbal")


@query("n_largest", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 15")
def _large(t):
    return O.top_n(t("customer"), "c_acctbal", 15, sorted_by_value=True, order="c_custkey").select("c_custkey", "c_acctbal")


@query("remove_top_n", "SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) WHERE k > 50")
def _remove_top(t):
    return O.remove_top_n(t("orders"), "o_totalprice", 50, order="o_orderkey").select("o_orderkey")


@query("remove_bottom_n", "SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS k FROM orders) WHERE k > 50")
def _remove_bottom(t):
    return O.remove_top_n(t("orders"), "o_totalprice", 50, True, "o_orderkey").select("o_orderkey")


# Places show the order, which rows of a result don't have.
@query("sort", "SELECT c_custkey, c_acctbal, row_number() OVER (ORDER BY abs(c_acctbal) DESC, c_custkey) - 1 AS place FROM customer")
def _sort(t):
    return O.sort(t("customer").select("c_custkey", "c_acctbal"), {"c_acctbal": "abs_desce", "c_custkey": "ascen"}, "place")


@query("sort_by_text", "SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_returnflag DESC, l_shipdate, l_orderkey DESC, l_linenumber) - 1 AS place FROM lineitem")
def _sort_text(t):
    return O.sort(t("lineitem"), {"l_returnflag": "desce", "l_shipdate": "ascen", "l_orderkey": "desce", "l_linenumber": "ascen"}, "place").select("l_orderkey", "l_linenumber", "place")


@query("sort_freq", "SELECT s_suppkey, s_nationkey, row_number() OVER (ORDER BY n DESC, s_nationkey DESC, s_suppkey) - 1 AS place FROM (SELECT *, count(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier)")
def _freq(t):
    return O.sort_freq(t("supplier").select("s_suppkey", "s_nationkey"), "s_nationkey", "desce", "place", ["s_suppkey"])


@query("permutation", "SELECT row_number() OVER (ORDER BY c_mktsegment DESC, p) - 1 AS place, p AS __pos FROM (SELECT *, row_number() OVER (ORDER BY c_custkey) - 1 AS p FROM customer)")
def _permutation(t):
    return O.permutation(rows(t, "customer", "c_custkey"), {"c_mktsegment": "desce"})


@query("shuffle", f"""WITH s AS (SELECT *, row_number() OVER (ORDER BY s_suppkey) - 1 AS p FROM supplier), a AS (SELECT s_acctbal AS x, row_number() OVER (ORDER BY {draw(3, 0, 'p')}, p) - 1 AS p FROM s), b AS (SELECT s_name AS y, row_number() OVER (ORDER BY {draw(3, 1, 'p')}, p) - 1 AS p FROM s)
    SELECT s_suppkey, x AS s_acctbal, y AS s_name FROM s JOIN a USING (p) JOIN b USING (p)""")
def _shuffle(t):
    return O.shuffle(rows(t, "supplier", "s_suppkey"), ["s_acctbal", "s_name"], 3).select("s_suppkey", "s_acctbal", "s_name")


for _policy, _sql in (("common_columns", "SELECT c_custkey AS k, c_name AS name FROM customer UNION ALL SELECT s_suppkey, s_name FROM supplier"), ("lhs_and_common_columns", "SELECT c_custkey AS k, c_name AS name, c_acctbal AS b FROM customer UNION ALL SELECT s_suppkey, s_name, NULL FROM supplier")):

    def _concat_policy(t, policy=_policy):
        return O.concat(t("customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("b")), t("supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("z")), policy)

    query(f"concat_{_policy}", _sql)(_concat_policy)


@query("concat", "SELECT c_custkey AS k, c_name AS name, c_acctbal AS b FROM customer UNION ALL SELECT s_suppkey, s_name, NULL FROM supplier")
def _concat(t):
    return O.concat(t("customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("b")), t("supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name")))


@query("difference", """SELECT c_custkey, c_acctbal AS "self.c_acctbal", c_acctbal + 1 AS "other.c_acctbal" FROM customer WHERE c_mktsegment = (SELECT min(c_mktsegment) FROM customer)""")
def _difference(t):
    c = t("customer")
    first = c.agg(F.min("c_mktsegment").alias("__s"))
    other = c.crossJoin(F.broadcast(first)).select("c_custkey", (F.col("c_acctbal") + (F.col("c_mktsegment") == F.col("__s")).cast("int")).alias("c_acctbal"))
    return O.difference(c.select("c_custkey", "c_acctbal"), other, "c_custkey")


@query("remove_duplicates_first", "SELECT min(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey, o_orderstatus")
def _dups_first(t):
    return O.remove_duplicates(t("orders"), ["o_custkey", "o_orderstatus"], "first", "o_orderkey").select("o_orderkey")


@query("remove_duplicates_none", "SELECT min(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey, o_orderstatus HAVING count(*) = 1")
def _dups_none(t):
    return O.remove_duplicates(t("orders"), ["o_custkey", "o_orderstatus"], "none").select("o_orderkey")


@query("remove_duplicates", "SELECT max(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey, o_orderstatus")
def _dups(t):
    return O.remove_duplicates(t("orders"), ["o_custkey", "o_orderstatus"], "last", "o_orderkey").select("o_orderkey")


@query("duplication_mask", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey) AS o_custkey_dup FROM orders")
def _dup_mask(t):
    return O.duplication_mask(t("orders"), ["o_custkey"]).select("o_orderkey", "o_custkey_dup")


@query("explode", "SELECT vec_id, i - 1 AS at, embedding[i] AS x FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)")
def _explode(t):
    return O.explode(t("embeddings").select("vec_id", "embedding"), "embedding", "at").select("vec_id", "at", F.col("embedding").alias("x"))


@query("unpivot", "SELECT l_orderkey, variable, values FROM (UNPIVOT (SELECT l_orderkey, l_quantity, l_discount FROM lineitem) ON l_quantity, l_discount INTO NAME variable VALUE values)")
def _unpivot(t):
    return O.unpivot(t("lineitem"), "l_orderkey", ["l_quantity", "l_discount"])


@query("pivot", "SELECT o_custkey, max(o_totalprice) FILTER (o_orderstatus = 'F') AS \"F\", max(o_totalprice) FILTER (o_orderstatus = 'O') AS \"O\" FROM orders GROUP BY 1")
def _pivot(t):
    return O.pivot(t("orders"), "o_orderstatus", ["o_totalprice"], "o_custkey", ["F", "O"], F.max)


@query("indicators", "SELECT o_orderkey, (o_orderstatus = 'F')::INT AS is_F, (o_orderstatus = 'O')::INT AS is_O, (o_orderstatus = 'P')::INT AS is_P, o_orderstatus AS back FROM orders")
def _indicators(t):
    o = O.load_indicators(t("orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", ["F", "O", "P"], "is_")
    return O.from_indicators(o.drop("o_orderstatus"), ["is_F", "is_O", "is_P"], "back", "is_")


@query("change_freq", """WITH b AS (SELECT min(o_orderkey) AS a, max(o_orderkey) AS z FROM orders), g AS (SELECT unnest(range(a, z, 50)) AS k FROM b UNION SELECT z FROM b)
    SELECT k AS o_orderkey, o_totalprice FROM g ASOF JOIN orders o ON g.k >= o.o_orderkey""")
def _freq_change(t):
    return L.change_freq(t("orders").select("o_orderkey", "o_totalprice"), 50, index="o_orderkey")


@query("change_freq_time", """WITH q AS (SELECT ts, min(event_id) AS e FROM events GROUP BY 1), b AS (SELECT min(ts) AS a, max(ts) AS z FROM q), g AS (SELECT unnest(generate_series(a, z, INTERVAL 6 HOUR)) AS k FROM b UNION SELECT z FROM b)
    SELECT g.k AS ts, e FROM g ASOF JOIN q ON g.k >= q.ts""")
def _time_change(t):
    q = t("events").groupBy("ts").agg(F.min("event_id").alias("e"))
    return L.change_freq(q, 6, "hours", "ts")


@query("shift", f"SELECT event_id, lag(value, 2) OVER ({SERIES}) AS value FROM events")
def _shift(t):
    return O.shift(t("events"), ["value"], 2, order=AT, by=BY).select("event_id", "value")


@query("rotate", "SELECT a.s_suppkey, b.s_acctbal FROM (SELECT *, row_number() OVER (ORDER BY s_suppkey) - 1 AS p, count(*) OVER () AS n FROM supplier) a JOIN (SELECT *, row_number() OVER (ORDER BY s_suppkey) - 1 AS p FROM supplier) b ON b.p = (a.p - 3 + a.n) % a.n")
def _rotate(t):
    return O.rotate(rows(t, "supplier", "s_suppkey"), ["s_acctbal"], 3).select("s_suppkey", "s_acctbal")


# Loading


_PLACED = "(SELECT *, row_number() OVER (ORDER BY {k}) - 1 AS p FROM {t})"


@query("load_column", f"SELECT c_custkey, s_acctbal AS got FROM {_PLACED.format(k='c_custkey', t='customer')} LEFT JOIN {_PLACED.format(k='s_suppkey', t='supplier')} USING (p)")
def _load_column(t):
    return L.load_column(rows(t, "customer", "c_custkey"), rows(t, "supplier", "s_suppkey"), "s_acctbal", "got").select("c_custkey", "got")


@query("load_index", f"SELECT s_suppkey, c_acctbal FROM {_PLACED.format(k='s_suppkey', t='supplier')} LEFT JOIN (SELECT c_custkey + 1000 AS key, c_acctbal, p FROM {_PLACED.format(k='c_custkey', t='customer')}) c USING (p)".replace("SELECT s_suppkey,", "SELECT key AS s_suppkey,").replace(", c_acctbal FROM", ", s_acctbal FROM", 1))
def _load_index(t):
    new = rows(t, "customer", "c_custkey").withColumn("key", F.col("c_custkey") + 1000).join(rows(t, "supplier", "s_suppkey").select(POS), POS, "left_semi")
    return L.load_index(rows(t, "supplier", "s_suppkey"), new, "key", "s_suppkey").select("s_suppkey", "s_acctbal")


@query("append_index", "SELECT s_suppkey, s_acctbal, s_suppkey - (SELECT min(s_suppkey) FROM supplier) AS p FROM supplier UNION ALL SELECT r_regionkey, NULL, (SELECT count(*) FROM supplier) + r_regionkey FROM region")
def _append_index(t):
    return L.append_index(rows(t, "supplier", "s_suppkey"), rows(t, "region", "r_regionkey"), "r_regionkey", "s_suppkey").select("s_suppkey", "s_acctbal", F.col(POS).alias("p"))


@query("append_row", "SELECT r_regionkey, r_name FROM region UNION ALL SELECT 99, 'NEW'")
def _append_row(t):
    return L.append_row(rows(t, "region", "r_regionkey"), r_regionkey=99, r_name="NEW").select("r_regionkey", "r_name")


@query("append_column", f"SELECT c_custkey, CASE WHEN p < 200 THEN c_acctbal ELSE s_acctbal END AS x FROM {_PLACED.format(k='c_custkey', t='customer')} c LEFT JOIN (SELECT s_acctbal, p + 200 AS p FROM {_PLACED.format(k='s_suppkey', t='supplier')}) s USING (p)")
def _append_column(t):
    c = rows(t, "customer", "c_custkey").withColumn("x", F.when(F.col(POS) < 200, F.col("c_acctbal")))
    return L.append_column(c, "x", rows(t, "supplier", "s_suppkey"), "s_acctbal").select("c_custkey", "x")


@query("load_random_sample", f"WITH s AS {_PLACED.format(k='s_suppkey', t='supplier')}, c AS {_PLACED.format(k='c_custkey', t='customer')} SELECT c_custkey, s_acctbal AS got FROM c LEFT JOIN s ON s.p = CASE WHEN c.p < 1000 THEN {draw(4, 0, 'c.p')} % (SELECT count(*) FROM supplier) END")
def _random_sample(t):
    return L.load_random_sample(rows(t, "customer", "c_custkey"), rows(t, "supplier", "s_suppkey"), "s_acctbal", "got", 4, 1000).select("c_custkey", "got")


@query("load_align_column", """WITH RECURSIVE e AS (SELECT *, (epoch(day) / 86400)::BIGINT AS tt, row_number() OVER (PARTITION BY user_id ORDER BY day) AS rn, lag((epoch(day) / 86400)::BIGINT) OVER (PARTITION BY user_id ORDER BY day) AS prev FROM (SELECT DISTINCT user_id, date_trunc('day', ts) AS day FROM events)),
    w AS (SELECT user_id, rn, tt AS ref, 1::BIGINT AS k, [rn] AS slots FROM e WHERE rn = 1 UNION ALL SELECT x.user_id, x.rn, CASE WHEN x.tt - p.ref = 4 THEN x.tt WHEN x.tt - p.ref > 4 THEN x.prev ELSE p.ref END, p.k + (x.tt - p.ref >= 4)::INT,
        CASE WHEN x.tt - p.ref = 4 THEN list_append(p.slots, x.rn) WHEN x.tt - p.ref > 4 THEN list_append(p.slots, x.rn - 1) ELSE p.slots END FROM w p JOIN e x ON x.user_id = p.user_id AND x.rn = p.rn + 1),
    f AS (SELECT user_id, slots FROM w QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY rn DESC) = 1), s AS (SELECT user_id, unnest(slots) AS rn, unnest(range(len(slots))) AS slot FROM f)
    SELECT e.user_id, e.day, max(CASE WHEN slot < 5 THEN slot * 10 END) AS got FROM e LEFT JOIN s ON s.user_id = e.user_id AND s.rn = e.rn GROUP BY 1, 2""")
def _align(t):
    days = t("events").select("user_id", F.date_trunc("day", "ts").alias("day")).distinct()
    coarse = days.select("user_id").distinct().select("user_id", F.explode(F.expr("sequence(0L, 4L)")).alias(POS)).withColumn("v", F.col(POS) * 10)
    return L.load_align_column(days, coarse, "v", "got", 4 * 86400.0, True, None, "day", BY)


@query("gen_datetime_index", "SELECT unnest(range(TIMESTAMP '2020-01-31 10:00:00', TIMESTAMP '2020-02-03 09:00:00', INTERVAL 5 HOUR)) AS \"INDEX\"")
def _datetimes(t):
    return S.datetime_index(t("region").sparkSession, "2020-01-31 10:00:00", "2020-02-03 09:00:00", "hours", 5).select(F.col("INDEX").cast("timestamp_ntz").alias("INDEX"))


@query("gen_sequence_index", 'SELECT unnest(range(5, 500, 7)) AS "INDEX"')
def _sequence(t):
    return S.sequence_index(t("region").sparkSession, 5, 500, 7)


# Missing values


_GAPS = "g AS (SELECT user_id, ts, event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS x FROM events)"


def gaps(t):
    return t("events").select("user_id", "ts", "event_id", F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("x"))


@query("fill_forward", f"WITH {_GAPS} SELECT event_id, last_value(x IGNORE NULLS) OVER ({SERIES} ROWS UNBOUNDED PRECEDING) AS x FROM g")
def _ffill(t):
    return O.fill_missing(gaps(t), "x", "fill_forward", order=AT, by=BY).select("event_id", "x")


@query("fill_backward", f"WITH {_GAPS} SELECT event_id, first_value(x IGNORE NULLS) OVER ({SERIES} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS x FROM g")
def _bfill(t):
    return O.fill_missing(gaps(t), "x", "fill_backward", order=AT, by=BY).select("event_id", "x")


@query("fill_linear", f"""WITH {_GAPS}, k AS (SELECT *, last_value(x IGNORE NULLS) OVER ({SERIES} ROWS UNBOUNDED PRECEDING) AS a, last_value(CASE WHEN x IS NOT NULL THEN epoch_us(ts) END IGNORE NULLS) OVER ({SERIES} ROWS UNBOUNDED PRECEDING) AS ta,
    first_value(x IGNORE NULLS) OVER ({SERIES} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b, first_value(CASE WHEN x IS NOT NULL THEN epoch_us(ts) END IGNORE NULLS) OVER ({SERIES} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS tb FROM g)
    SELECT event_id, round(coalesce(x, a + (b - a) * ((epoch_us(ts) - ta) / (tb - ta))), 4) AS x FROM k""")
def _linear(t):
    return O.fill_missing(gaps(t), "x", "linear_interpolate", index="ts", order=AT, by=BY).select("event_id", r("x", 4).alias("x"))


@query("fill_value", f"WITH {_GAPS} SELECT event_id, coalesce(x, -1) AS x FROM g")
def _vfill(t):
    return O.fill_missing(gaps(t), "x", "value", -1.0, order=AT, by=BY).select("event_id", "x")


@query("fill_limited", f"WITH {_GAPS}, k AS (SELECT *, last_value(x IGNORE NULLS) OVER ({SERIES} ROWS UNBOUNDED PRECEDING) AS f FROM g), n AS (SELECT *, sum((x IS NULL AND f IS NOT NULL)::INT) OVER ({SERIES}) AS c FROM k) SELECT event_id, CASE WHEN x IS NULL AND c <= 4 THEN f ELSE x END AS x FROM n")
def _lfill(t):
    return O.fill_missing(gaps(t), "x", "fill_forward", limit=4, order=AT, by=BY).select("event_id", "x")


@query("fill_mid_point", f"WITH {_GAPS} SELECT event_id, round(coalesce(x, (lag(x) OVER ({SERIES}) + first_value(x IGNORE NULLS) OVER ({SERIES} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)) / 2), 6) AS x FROM g")
def _mfill(t):
    return O.fill_missing(gaps(t), "x", "mid_point", order=AT, by=BY).select("event_id", r("x").alias("x"))


@query("fill_from", f"SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN c_acctbal WHEN c_custkey = s_suppkey THEN s_acctbal END AS c_acctbal FROM {_PLACED.format(k='c_custkey', t='customer')} LEFT JOIN {_PLACED.format(k='s_suppkey', t='supplier')} USING (p)")
def _from(t):
    c = rows(t, "customer", "c_custkey").select(POS, "c_custkey", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("c_acctbal"))
    other = rows(t, "supplier", "s_suppkey").select(POS, F.col("s_suppkey").alias("c_custkey"), F.col("s_acctbal").alias("c_acctbal"))
    return L.fill_from(c, other, "c_acctbal", "c_custkey").select("c_custkey", "c_acctbal")


_MISSING = "((c_acctbal < 0)::INT + (c_nationkey < 5)::INT + (c_mktsegment = 'BUILDING')::INT)"
for _policy, _sql in (("all", "n < 3"), ("threshold", "n <= 1")):

    def _drop_policy(t, policy=_policy):
        c = t("customer").select("c_custkey", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("a"), F.when(F.col("c_nationkey") >= 5, F.col("c_nationkey")).alias("b"), F.when(F.col("c_mktsegment") != "BUILDING", 1).alias("c"))
        return O.drop_missing(c, ["a", "b", "c"], policy, 1).select("c_custkey")

    query(f"drop_missing_{_policy}", f"SELECT c_custkey FROM (SELECT *, {_MISSING} AS n FROM customer) WHERE {_sql}")(_drop_policy)


@query("drop_missing", f"WITH {_GAPS} SELECT event_id FROM g WHERE x IS NOT NULL")
def _drop(t):
    return O.drop_missing(gaps(t), ["x"]).select("event_id")


@query("replace", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def _replace(t):
    return O.replace(t("orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", ["F", "O"], ["done", "open"])


@query("make_stationary", f"SELECT event_id, round(coalesce(value - lag(value) OVER w, lead(value) OVER w - value), 6) AS value FROM events WINDOW w AS ({SERIES})")
def _stationary(t):
    return O.make_stationary(t("events"), "value", "differencing", AT, BY).select("event_id", r("value").alias("value"))


@query("replace_limited", f"SELECT event_id, CASE WHEN event_type = 'click' AND sum((event_type = 'click')::INT) OVER ({SERIES}) <= 3 THEN 'tap' ELSE event_type END AS event_type FROM events")
def _replace_limited(t):
    return O.replace(t("events").select("event_id", "user_id", "ts", "event_type"), "event_type", ["click"], ["tap"], 3, AT, BY).select("event_id", "event_type")


@query("replace_by_function", "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 200000 ELSE o_totalprice END AS o_totalprice FROM orders")
def _replace_function(t):
    return O.replace(t("orders").select("o_orderkey", "o_totalprice"), "o_totalprice", lambda x: F.when(x > 200000, 200000.0))


for _method, _sql in (("log_trans", "ln(o_totalprice)"), ("sqrt_trans", "sqrt(o_totalprice)"), ("boxcox_trans", "(power(o_totalprice, 0.3) - 1) / 0.3")):

    def _stationary_by(t, method=_method):
        out = C.make_stationary(t("orders").select("o_orderkey", "o_totalprice"), "o_totalprice", method, **({"lam": 0.3} if method == "boxcox_trans" else {}))
        return out.select("o_orderkey", fixed("o_totalprice").alias("x"))

    query(f"make_stationary_{_method}", f"SELECT o_orderkey, {FIXED(_sql)} AS x FROM orders")(_stationary_by)

_TUKEY = """(SELECT [median(v) FILTER (k <= n // 2), median(v) FILTER (k > n - n // 2)] FROM (SELECT {x} AS v, row_number() OVER (ORDER BY {x}) AS k, count(*) OVER () AS n FROM {t}))"""
_FENCES = "SELECT {key} FROM {t}, (SELECT {tukey} AS q) WHERE {x} > q[2] + 0.5 * (q[2] - q[1]) OR {x} < q[1] - 0.5 * (q[2] - q[1])"
_FENCED = {"key": "o_orderkey", "t": "orders", "x": "o_totalprice", "tukey": _TUKEY.format(x="o_totalprice", t="orders")}


@query("iqr_outliers", _FENCES.format(**_FENCED))
def _iqr(t):
    return C.flagged(t("orders"), "o_totalprice", "iqr", high_fence=0.5, low_fence=0.5).where("outlier").select("o_orderkey")


@query("remove_data_by_iqr", f"SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN ({_FENCES.format(**_FENCED)})")
def _remove_iqr(t):
    return C.remove_anomalies(t("orders"), "o_totalprice", "iqr", high_fence=0.5, low_fence=0.5).select("o_orderkey")


@query("remove_data_by_zscore", "SELECT o_orderkey FROM (SELECT o_orderkey, abs(o_totalprice - avg(o_totalprice) OVER ()) / stddev_samp(o_totalprice) OVER () AS z FROM orders) WHERE NOT z > 1.2")
def _remove_z(t):
    return C.remove_anomalies(t("orders"), "o_totalprice", "zscore", threshold=1.2).select("o_orderkey")


def hampel_sql(f: str) -> str:
    """Events with their flag out: away from the rolling median or mean of 5 rows by more than 1.5 scaled ones of these distances."""
    w = f"({SERIES} ROWS 4 PRECEDING)"
    return f"SELECT *, coalesce(n >= 5 AND d > 1.5 * 1.4826 * {f}(d) OVER {w}, false) AS out FROM (SELECT *, CASE WHEN n >= 5 THEN abs(value - {f}(value) OVER {w}) END AS d FROM (SELECT *, row_number() OVER ({SERIES}) AS n FROM events))"


for _kind, _f in (("median", "median"), ("mean", "avg")):

    def _hampel(t, kind=_kind):
        return C.flagged(t("events"), "value", "hampel", AT, BY, window=5, deviations=1.5, kind=kind).where("outlier").select("event_id")

    query("hampel" if _kind == "median" else "hampel_mean", f"SELECT event_id FROM ({hampel_sql(_f)}) WHERE out")(_hampel)


@query("remove_data_by_hampel", f"SELECT event_id FROM ({hampel_sql('median')}) WHERE NOT out")
def _remove_hampel(t):
    return C.remove_anomalies(t("events"), "value", "hampel", AT, BY, window=5, deviations=1.5).select("event_id")


# Each repaired value can be the neighbour of the next one, so SQL walks the rows too.
for _policy, _own, _edge in (("fill_forward", "p.v", "x.rn > 1"), ("mid_point", "(x.nx + p.v) * 0.5", "x.rn > 1 AND x.nx IS NOT NULL"), ("linear_interpolate", "p.v + (x.tt - x.pa) / (x.na - x.pa) * (x.nx - p.v)", "x.rn > 1 AND x.nx IS NOT NULL")):

    def _repair(t, policy=_policy):
        e = t("events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
        return C.detect_and_change(e, ["value"], "hampel", policy, "at", AT, BY, window=5, deviations=1.5).select("event_id", fixed("value").alias("x"))

    query(f"detect_and_change_{_policy}", f"""WITH RECURSIVE e AS (SELECT *, row_number() OVER ({SERIES}) AS rn, lead(value) OVER ({SERIES}) AS nx, epoch_us(ts) / 1e6 AS tt, lag(epoch_us(ts) / 1e6) OVER ({SERIES}) AS pa, lead(epoch_us(ts) / 1e6) OVER ({SERIES}) AS na FROM ({hampel_sql('median')})),
        f AS (SELECT user_id, rn, event_id, value AS v FROM e WHERE rn = 1 UNION ALL SELECT x.user_id, x.rn, x.event_id, CASE WHEN x.out AND {_edge} THEN {_own} ELSE x.value END FROM f p JOIN e x ON x.user_id = p.user_id AND x.rn = p.rn + 1) SELECT event_id, {FIXED('v')} AS x FROM f""")(_repair)


@query("detect_and_change_zscore", f"WITH z AS (SELECT *, abs(value - avg(value) OVER ()) / stddev_samp(value) OVER () > 1.9 AS out FROM events) SELECT event_id, {FIXED('value')} AS x FROM z WHERE NOT out")
def _repair_z(t):
    e = C.detect_and_change(t("events").withColumn("old", F.col("value")), ["value"], "zscore", "fill_forward", None, AT, BY, threshold=1.9)
    unchanged = C.remove_anomalies(e, "old", "zscore", threshold=1.9)
    return unchanged.select("event_id", fixed("value").alias("x"))


# The published comparison: three aggregates, and a selection


@query("bench_calculation", "SELECT round(avg(l_quantity), 6) AS mean, round(var_samp(l_discount), 8) AS variance, round(corr(l_discount, l_tax), 6) AS corr FROM lineitem")
def _calculation(t):
    return t("lineitem").agg(r(F.avg("l_quantity")).alias("mean"), r(F.var_samp("l_discount"), 8).alias("variance"), r(F.corr("l_discount", "l_tax")).alias("corr"))


@query("bench_selection", "SELECT * FROM lineitem WHERE l_extendedprice > 50000")
def _selection(t):
    return O.get_data_by_sel(t("lineitem"), F.col("l_extendedprice") > 50000)
