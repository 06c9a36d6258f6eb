"""Every query with SQL gives the rows that DuckDB gives."""

import datetime
import math
import os

import duckdb
import pandas as pd
import pytest

from larkspur.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def plain(df: pd.DataFrame) -> tuple:
    def cell(x):
        if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and math.isnan(x)):
            return "null"
        x = x.item() if hasattr(x, "item") else x
        return f"{x:.6g}" if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)

    columns = sorted(df.columns)
    return columns, sorted(tuple(map(cell, r)) for r in df[columns].itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    assert plain(QUERIES[name](spark, SF).toPandas()) == plain(duck.sql(ORACLE_SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_few_queries_lack_sql():
    assert len(set(QUERIES) - set(ORACLE_SQL)) <= 20


def test_markov_over_all_users(spark, tmp_path):
    series = {1: "abacab", 70: "bbca", 99: "cabbcaacb"}
    # Users alternate in time, and ids run against it.
    rows = [(1000 - 10 * i - u % 7, datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=10 * i + u % 7), u, x) for u, s in series.items() for i, x in enumerate(s)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    m = [[sum(s[i : i + 2] == a + b for s in series.values() for i in range(len(s) - 1)) for b in "abc"] for a in "abc"]
    p = [1 / 3] * 3
    for _ in range(2000):
        p = [(p[j] + sum(p[i] * m[i][j] / sum(m[i]) for i in range(3))) / 2 for j in range(3)]
    got = {r["state"]: r["probability"] for r in QUERIES["markov_stationary"](spark, str(tmp_path)).collect()}
    assert got == pytest.approx(dict(zip("abc", p)), abs=2e-6)


@pytest.mark.parametrize("policy, kept", [("inner_join", ""), ("left_join", "l"), ("right_join", "r"), ("left_right_join", "lr")])
def test_joins_with_unmatched_rows(spark, tmp_path, policy, kept):
    orders, customers = [(i, i % 8) for i in range(1, 31)] + [(31, None)], [(c, f"c{c}") for c in range(3, 12)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(customers, "c_custkey long, c_name string").write.parquet(f"{tmp_path}/customer.parquet")
    names, used = dict(customers), {c for _, c in orders}
    want = [(c, o, names.get(c)) for o, c in orders if c in names or "l" in kept] + [(c, None, n) for c, n in customers if c not in used and "r" in kept]
    got = QUERIES[f"join_by_column_{policy}"](spark, str(tmp_path)).select("o_custkey", "o_orderkey", "c_name").collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def _compared(spark, tmp_path, name, days):
    """Rows of a query and of its SQL for one user, whose events of a day are given as a list each."""
    rows = [(i, datetime.datetime(2024, 1, 1 + day, 9 + at), 1, "view", float(v)) for i, (day, at, v) in enumerate((d, a, v) for d, values in enumerate(days) for a, v in enumerate(values))]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    return plain(QUERIES[name](spark, str(tmp_path)).toPandas()), plain(con.sql(ORACLE_SQL[name]).df())


@pytest.mark.parametrize("name", ["acceleration_bands", "acceleration_lower", "coppock", "entropy", "garman_klass", "hodges_tompkins", "parkinson", "price_volume_trend", "rsi"])
def test_prices_of_zero(spark, tmp_path, name):
    """Over a price of 0 doubles are infinite or not a number, and so is what a window makes of them."""
    days = [[5, 9, 7], [4, 8, 6], [0], [0, 3], [6, 2], [5, 7, 6], [9, 4], [3, 8], [7, 5], [4, 6], [8, 3], [2, 9], [6, 5], [0, 0], [0], [7, 9]]
    got, want = _compared(spark, tmp_path, name, days)
    assert got == want
    assert any(row[-1] != "null" for row in want[1])


def test_dbscan_at_its_reach(spark, tmp_path):
    """As doubles, 32.02 - 2.02 is above 30 while 2.02 + 30 is 32.02."""
    got, want = _compared(spark, tmp_path, "dbscan", [[2.02], [32.02]] * 3 + [[500]])
    assert got == want == (["clusters", "noise", "user_id"], [("2", "1", "1")])


@pytest.mark.parametrize("name", ["after_times", "before_times", "between_times", "between_times_inclusive", "at_times"])
def test_times_of_day_to_the_microsecond(spark, tmp_path, name):
    bounds = [datetime.datetime(2024, 1, 1, *clock) for clock in ((9,), (10, 30), (12,), (17, 30))]
    rows = [(i, at + datetime.timedelta(microseconds=m)) for i, (at, m) in enumerate((at, m) for at in bounds for m in (-1000, -999, -1, 0, 1, 999, 1000))]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert plain(QUERIES[name](spark, str(tmp_path)).toPandas()) == plain(con.sql(ORACLE_SQL[name]).df())


def test_aligned_value_stays_without_a_next_one(spark, tmp_path):
    """On the 17th come the last value there is and, as the next day is nine days on, the place of one more."""
    days = [[1] if d in (0, 4, 8, 12, 16, 25) else [] for d in range(26)]
    got, want = _compared(spark, tmp_path, "load_align_column", days)
    assert got == want and sum(row[1] == "40" for row in want[1]) == 1
