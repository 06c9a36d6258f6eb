import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.functions import indicators as I, ml as M, scalars as S, sequential as Q, windows as W
from larkspur.operators import frame as O, grouping as G, joins as J
from larkspur.plans import POS, by_series, summarised, with_positions
from larkspur.sources import frames


@pytest.fixture(scope="module")
def small(spark):
    return spark.createDataFrame([(i, float(v) if v is not None else None, s) for i, (v, s) in enumerate([(3, "a"), (1, "b"), (None, "a"), (4, "c"), (1, "a")])], f"{POS} long, x double, s string")


def values(df, name="x", order=POS):
    return [r[name] for r in df.orderBy(order).collect()]


def test_positions_are_contiguous(spark):
    df = with_positions(spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k")), ["k"])
    assert [(r["k"], r[POS]) for r in df.orderBy("k").collect()] == [(i, i) for i in range(1000)]


def test_asof_join(spark):
    left = spark.createDataFrame([(t, t * 1.1) for t in (1, 3, 5, 7, 9)], "t long, price double")
    right = spark.createDataFrame([(i, t, t * 10.0) for i, t in enumerate((2, 4, 6))], f"{POS} long, t long, quote double")
    got = lambda **o: values(J.asof_join(left, right, "t", ["quote"], **o), "quote", "t")
    assert got() == [None, 20, 40, 60, 60]
    assert got(policy="forward") == [20, 40, 60, None, None]
    assert got(policy="nearest") == [20, 20, 40, 60, 60]
    assert got(tolerance=1) == [None, 20, 40, 60, None]


def test_literal_join_counts(spark):
    left = spark.createDataFrame([(i, 1, f"l{i}") for i in range(3)], f"{POS} long, k int, a string")
    right = spark.createDataFrame([(i, 1, f"r{i}") for i in range(4)], f"{POS} long, k int, b string")
    assert J.join_literal(left, right, "k").count() == 4 + 3 - 1
    assert J.join_by_column(left, right, "k").count() == 12


def test_fill_policies(small):
    assert values(O.fill_missing(small, "x", "fill_forward")) == [3, 1, 1, 4, 1]
    assert values(O.fill_missing(small, "x", "fill_backward")) == [3, 1, 4, 4, 1]
    assert values(O.fill_missing(small, "x", "value", 9.0)) == [3, 1, 9, 4, 1]
    assert values(O.fill_missing(small, "x", "linear_interpolate", index=POS)) == [3, 1, 2.5, 4, 1]
    assert values(O.fill_missing(small, "x", "value", 9.0, limit=0)) == [3, 1, None, 4, 1]


def test_drop_and_duplicates(small):
    assert O.drop_missing(small, ["x"]).count() == 4
    assert sorted(values(O.remove_duplicates(small, ["s"], "last"), POS)) == [1, 3, 4]
    assert values(O.remove_duplicates(small, ["s"], "none"), POS) == [1, 3]


def test_quantile_rule(spark):
    df = spark.createDataFrame([(float(v),) for v in range(1, 11)], "x double")
    assert O.quantiles(df, "x", [0.5, 0.25]).first() == (5.5, 3.5)
    odd = spark.createDataFrame([(float(v),) for v in range(1, 10)], "x double")
    assert O.quantiles(odd, "x", [0.5]).first()[0] == 5


def test_glob():
    import re

    match = lambda p, t: bool(re.match(O.glob_to_regex(p), t))
    assert match("a*c", "abbbc") and not match("a*c", "abbb")
    assert match("[^x]?z", "abz") and not match("[^x]?z", "xbz")
    assert match("a\\*", "a*") and not match("a\\*", "ab")


def test_buckets_drop_the_last(spark):
    df = spark.createDataFrame([(i, float(t)) for i, t in enumerate([0, 1, 5, 6, 11, 12])], f"{POS} long, t double")
    assert [r["n"] for r in G.bucketize_by_distance(df, "t", 5.0, F.count("*").alias("n")).orderBy("bucket").collect()] == [2, 2]
    assert [r["n"] for r in G.bucketize_by_distance(df, "t", 5.0, F.count("*").alias("n"), keep_last=True).orderBy("bucket").collect()] == [2, 2, 2]
    assert G.bucketize_by_count(df, 2, F.count("*").alias("n")).count() == 2


def test_crosstab_and_pivot(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x")], "r string, c string")
    got = {r["r"]: (r["x"], r["y"], r["All"]) for r in G.crosstab(df, "r", "c", ["x", "y"], margins=True).collect()}
    assert got == {"a": (1, 1, 2), "b": (1, 0, 1), "All": (2, 1, 3)}


def test_cumulative_product(small):
    out = values(small.withColumn("x", W.cumulative_product(F.col("x"))))
    assert [None if v is None else round(v, 9) for v in out] == [3, 3, None, 12, 12]


def test_kernels_by_hand():
    assert np.allclose(Q.ewm([1.0, 2.0, 3.0], 0.5), [1, 1.5, 2.25])
    nan = float("nan")
    # Rows before the first number are 0, and the finite form forgets that number's value.
    assert np.allclose(Q.ewm([nan, 4.0, 2.0], 0.5), [0, 4, 3]) and np.allclose(Q.ewm([nan, 4.0, 2.0, 6.0], 0.5, True), [0, 4, 2 / 1.5, 7 / 1.75])
    assert Q.inversions([3, 1, 2])["inversions"] == 2
    assert Q.max_sub_array([1, -2, 3, 4, -1]) == {"sum": 7, "begin": 2, "end": 4}
    assert Q.dynamic_time_warp([1, 2, 3], [1, 2, 2, 3])["distance"] == 0
    assert np.allclose(Q.lagrange_fill([1, float("nan"), 9], [1, 2, 3])["filled"], [1, 5, 9])
    assert I.rsi(np.arange(1.0, 30.0))["rsi"][-1] == 100
    assert set(Q.dynamic_time_warp([0], [1]).values()) == {1.0}


def test_ewm_covariance_is_the_weighted_one():
    x, a = np.array([1.0, 4.0, 2.0, 8.0]), 0.3
    w = (1 - a) ** np.arange(len(x))[::-1]
    m = (w * x).sum() / w.sum()
    var = (w * (x - m) ** 2).sum() / w.sum() * w.sum() ** 2 / (w.sum() ** 2 - (w**2).sum())
    assert np.isclose(Q.ewm_var(x, "fixed", a)["var"][-1], var)


def test_clusters():
    x = np.array([0, 0.1, 0.2, 10, 10.1, 10.2, 50])
    assert M.dbscan(x, 2, 0.05)["cluster"].tolist() == [0, 0, 0, 1, 1, 1, -1]
    assert len(set(M.mean_shift(x, 0.5, 1.0)["cluster"])) == 3
    assert len(set(M.spectral(x[:6], 2, 1.0)["cluster"])) == 2
    assert np.allclose(M.kriging(np.array([[0.0], [1.0]]), np.array([1.0, 3.0]), np.array([[0.0]])), [1.0])


def test_series_runner(spark):
    df = spark.createDataFrame([(k, i, float(i)) for k in "ab" for i in range(4)], f"k string, {POS} long, x double")
    out = by_series(df, Q.ewm_mean, ["x"], {"ewm": "double"}, by=["k"], kind="fixed", value=1.0)
    assert values(out.where("k = 'a'"), "ewm") == [0, 1, 2, 3]


def test_calendar(spark):
    df = spark.createDataFrame([("2024-07-04", 1), ("2024-11-28", 1), ("2024-07-05", 0), ("2021-12-27", 0)], "d string, holiday int").withColumn("d", F.to_date("d"))
    assert all(bool(r["holiday"]) == r["got"] for r in df.withColumn("got", S.is_us_bank_holiday(F.col("d"))).collect())
    assert df.select(S.add_weekdays(F.lit("2024-07-05").cast("date"), 1)).first()[0].isoformat() == "2024-07-08"


def test_text_formats(spark, tmp_path):
    text = "INDEX:3:<long>:1,2,3,\nv:2:<dbl_vec>:2[1.5|2],0[],\ns:3:<string>:a,,c,\n"
    df = frames.from_string(spark, text)
    assert [(r["INDEX"], r["v"], r["s"]) for r in df.orderBy(POS).collect()] == [(1, [1.5, 2.0], "a"), (2, [], None), (3, None, "c")]
    assert frames.from_string(spark, frames.to_string(df)).orderBy(POS).collect()[0]["v"] == [1.5, 2.0]
    (tmp_path / "x.csv").write_text("INDEX:3:<long>,d:3:<double>,t:3:<DateTimeAME>\n1,2.5,01/02/2020\n2,,01/03/2020 10:11:12\n")
    got = frames.read_csv2(spark, str(tmp_path / "x.csv")).orderBy(POS).collect()
    assert [(r["INDEX"], r["d"], str(r["t"])) for r in got] == [(1, 2.5, "2020-01-02 00:00:00"), (2, None, "2020-01-03 10:11:12")]
    assert "| INDEX |" in frames.render(df.select(POS, "INDEX"), "markdown")


def test_anderson_darling_far_from_normal():
    found = Q.anderson_darling(np.linspace(0, 1, 40000))
    assert found["statistic"] > 400 and found["p_value"] == np.inf
    assert Q.anderson_darling(np.linspace(0, 1, 1000))["p_value"] < 1


def test_looking_ahead_takes_no_frame_to_the_end(spark):
    """Such a frame is summed up anew for each row, which is quadratic in a range or series."""
    points = spark.range(20).select(F.col("id").alias(POS), F.col("id").alias("t"), F.when(F.col("id") % 7 == 3, F.col("id") * 1.0).alias("x"))
    joined = J.asof_join(points.select("t"), points.where("x is not null"), "t", ["x"], "forward")
    filled = [O.fill_missing(points, "x", policy, index="t") for policy in ("fill_backward", "mid_point", "linear_interpolate")]
    assert values(joined, "x", "t") == [3] * 4 + [10] * 7 + [17] * 7 + [None] * 2
    assert values(filled[0], "x") == values(joined, "x", "t")
    assert values(filled[2], "x") == [None] * 3 + list(range(3, 18)) + [None] * 2
    for df in (joined, *filled):
        to_end = [line for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "unboundedfollowing" in line]
        assert all("__first" in line for line in to_end)  # one row for each range, a bounded number


def test_isolation_searches_runs_of_sorted_rows():
    x = np.array([3.0, 1.0, 1.0, 8.0, 2.5, 40.0])
    found = Q.isolation_outliers(x, trees=3)["score"]
    # Scores of the code before, which searched the rows of each node anew.
    assert found.tolist() == [0.42586291127308745, 0.40934935668872435, 0.40934935668872435, 0.5501598248578027, 0.3910180454839654, 0.7740712644423979]
    # One Python search a node; the code before made several passes of NumPy over its rows.
    began = time.process_time()
    Q.isolation_outliers(np.random.default_rng(1).normal(size=200000))
    assert time.process_time() - began < 5


def test_heavy_series_keep_their_partitions(spark):
    df = spark.range(40).select((F.col("id") % 8).alias("k"), "id", F.col("id").cast("double").alias("x"))
    run = lambda heavy: by_series(df, lambda x: {"y": x}, ["x"], {"y": "double"}, "id", ["k"], heavy=heavy).rdd.getNumPartitions()
    assert run(True) == 4


def test_lstm_side_by_side(spark, monkeypatch):
    """Series of any lengths are fitted together, to what each one gives alone and gave before."""
    series = [[(i * i + k) % 7 + i / 3 for i in range(k)] for k in (3, 14, 5, 20)]
    want = [[np.float64(2.754279053), np.float64(2.729568862)], [np.float64(4.515337258), np.float64(4.507564892)], [np.float64(3.352311349), np.float64(3.344041865)], [np.float64(5.717591768), np.float64(5.716751321)]]
    monkeypatch.setattr(Q, "SIDE_BY_SIDE", 3)
    assert np.allclose([f["forecast"] for f in Q.lstm_many(series, 2, 4, 5, 3)], want, atol=1e-7)
    assert np.allclose([Q.lstm(x, 2, 4, 5, 3)["forecast"] for x in series], want, atol=1e-7)


def test_kernels_of_many_series(spark):
    """All series reach the kernel once and keep their keys, and calls are fewer than series."""
    df = spark.range(3000).select((F.col("id") % 700).alias("k"), "id", F.col("id").cast("double").alias("x")).coalesce(1)
    run = lambda series: [{"total": float(x.sum()), "together": float(len(series))} for x in series]
    got = summarised(df, run, ["x"], {"total": "double", "together": "double"}, "id", ["k"], many=True).toPandas()
    assert dict(zip(got["k"], got["total"])) == {k: float(sum(range(k, 3000, 700))) for k in range(700)}
    assert got["together"].min() > 100
