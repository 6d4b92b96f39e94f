"""Windows against brute force, on the sliding, the running and the hot-group plans."""

import math
import statistics

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from paysieve.operators import windows as W
from paysieve.operators.windows import HOUR, MINUTE, Measure

SCHEMA = "event_id long, us long, key string, other string, cents long"
MEASURES = [Measure("cnt", "v", 10, "count"), Measure("sum", "v", 10, "sum"), Measure("std", "v", 25, "std"),
            Measure("mean", "v", 25, "mean")]
rows_strategy = st.lists(
    st.tuples(st.integers(0, 60), st.sampled_from(["a", "b", None]), st.sampled_from(["x", "y", "z", None]),
              st.one_of(st.none(), st.integers(1, 500))),
    min_size=1, max_size=30)
quick = settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def frame(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], SCHEMA)


def expected(rows, i, width):
    t, key = rows[i][0], rows[i][1]
    return [r[3] for r in rows if r[1] == key and t - width <= r[0] < t and r[3] is not None]


def check(spark, rows, method):
    out = W.trailing(frame(spark, rows), ["key"], "us", {"v": F.col("cents")}, MEASURES, method=method)
    got = {r["event_id"]: r for r in out.collect()}
    assert len(got) == len(rows)
    for i in range(len(rows)):
        near, far = expected(rows, i, 10), expected(rows, i, 25)
        assert got[i]["cnt"] == len(near)
        assert got[i]["sum"] == sum(near)
        assert (got[i]["mean"] is None) == (not far)
        if far:
            assert math.isclose(got[i]["mean"], statistics.fmean(far))
        if len(far) > 1:
            assert math.isclose(got[i]["std"], statistics.stdev(far), abs_tol=1e-9)
        else:
            assert got[i]["std"] is None


@pytest.mark.parametrize("method", ["sliding", "running"])
@quick
@given(rows=rows_strategy)
def test_trailing_equals_brute_force(spark, method, rows):
    check(spark, rows, method)


@quick
@given(rows=rows_strategy)
def test_hot_groups_give_the_same(spark, small_tasks, rows):
    check(spark, rows, "running")


@quick
@given(rows=rows_strategy)
def test_distinct_exact_and_approx(spark, small_tasks, rows):
    df = frame(spark, rows)
    exact = {r["event_id"]: r["d"] for r in W.pit_distinct_exact(df, ["key"], "us", "other", 10, "event_id", "d").collect()}
    rough = {r["event_id"]: r["d"] for r in W.pit_distinct_approx(df, ["key"], "us", "other", 10, "event_id", "d").collect()}
    for i, (t, key, _, _) in enumerate(rows):
        inside = [r for r in rows if r[1] == key and t - 10 <= r[0] < t]
        assert exact[i] == len({r[2] for r in inside})
        assert rough[i] <= len(inside)


@quick
@given(rows=rows_strategy)
def test_first_row_and_previous_row(spark, small_tasks, rows):
    df = frame(spark, rows)
    first = {r["event_id"]: r["f"] for r in W.first_occurrence(df, "key", "other", "us", "event_id", "f").collect()}
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0], i))
    seen = set()
    for i in order:
        assert first[i] == (rows[i][1:3] not in seen)
        seen.add(rows[i][1:3])


def test_current_row_is_outside_its_window(spark):
    df = spark.sql("SELECT id AS event_id, id * 600000000 AS us, 'a' AS pan_token, id + 1 AS cents FROM range(3)")
    out = W.pit_count(df, ["pan_token"], "us", HOUR, F.col("cents")).orderBy("us").collect()
    assert [r["cnt"] for r in out] == [0, 1, 2]


def test_null_keys_can_be_left_out(spark):
    df = frame(spark, [(0, None, None, 5), (1, None, None, 6), (2, "a", None, 7)])
    out = {r["event_id"]: r["cnt"] for r in W.pit_count(df, ["key"], "us", 10, F.col("cents"), nulls="zero").collect()}
    assert out == {0: 0, 1: 0, 2: 0}
    grouped = {r["event_id"]: r["cnt"] for r in W.pit_count(df, ["key"], "us", 10, F.col("cents")).collect()}
    assert grouped[1] == 1


def test_wide_amounts_stay_exact(spark):
    big = 3_000_000_000
    df = frame(spark, [(0, "a", None, big), (1, "a", None, big + 2), (2, "a", None, 1)])
    out = W.pit_std(df, ["key"], "us", 100, F.col("cents"), method="running").orderBy("us").collect()
    assert math.isclose(out[2]["std"], statistics.stdev([big, big + 2]), rel_tol=1e-9)


def test_window_text():
    assert W.window_micros("60s") == MINUTE and W.window_micros("10min") == 10 * MINUTE
    assert W.window_micros("7d") == 7 * 24 * HOUR
