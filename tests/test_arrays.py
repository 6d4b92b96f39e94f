"""Whole groups as arrays, maxima over slices, nearest rows: against plain versions and the other plans."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from paysieve.operators import graph as G
from paysieve.operators import models as L
from paysieve.operators import trailing_arrays as A
from paysieve.operators import validation as C
from paysieve.operators import windows as W
from paysieve.operators.registry import check_parameters, claim_problems, claims
from paysieve.plans.scan import order_statistic

KEYS = {"user": "user", "device": "device", "nobody": None}


def events(spark, n=400, top=500):
    r = np.random.default_rng(5)
    data = [(i, int(r.integers(0, 60)) * 1_000_000, int(r.integers(0, 4)), None if i % 9 == 0 else int(r.integers(0, 2)), None if i % 13 == 0 else int(r.integers(-top, top)), None if i % 7 == 0 else int(r.integers(0, 2)))
            for i in range(n)]
    return spark.createDataFrame(data, "event_id long, us long, user int, device int, cents long, declined int").repartition(3)


@pytest.mark.parametrize("top", [500, (1 << 31) - 1])
def test_arrays_equal_running_sums(spark, top):
    """The same block by both plans, with ties in time, null keys, values and flags, and values whose squares fill two words."""
    df, windows = events(spark, top=top), {"5s": 5_000_000, "30s": 30_000_000}
    block = lambda method: {r.event_id: r for r in W.velocity_block(df, "event_id", "us", F.col("cents"), F.col("declined"), KEYS, windows, method=method).collect()}
    arrays, running = block("arrays"), block("running")
    assert arrays.keys() == running.keys() and len(arrays) == 400
    for k in arrays:
        a, b = arrays[k].asDict(), running[k].asDict()
        assert a.keys() == b.keys() and all(a[c] == pytest.approx(b[c], rel=1e-12, abs=1e-9) for c in a)
    assert {r["cnt_nobody_5s"] for r in arrays.values()} == {0.0} and max(r["cnt_user_30s"] for r in arrays.values()) > 20


def test_event_ids_must_be_unique(spark):
    df = events(spark, 20)
    with pytest.raises(Exception, match="unique"):
        W.velocity_block(df.union(df), "event_id", "us", F.col("cents"), F.col("declined"), KEYS, {"5s": 5_000_000}, method="arrays").collect()


def test_groups_stay_whole_over_batches():
    keys = np.sort(np.random.default_rng(0).integers(0, 9, 500))
    table = pa.table({"k": pa.array([None if k == 8 else int(k) for k in keys]), "x": np.arange(500)})
    parts = list(A.whole_groups(table.to_batches(max_chunksize=7), (0,), rows=40))
    assert pa.concat_tables(parts).equals(table) and len(parts) > 4
    seen = [set(p["k"].to_pylist()) for p in parts]
    assert all(not a & b for i, a in enumerate(seen) for b in seen[:i])
    assert list(A.whole_groups([], (0,))) == []


def test_spread_is_exact():
    r = np.random.default_rng(1)
    for scale in (100, 1 << 20, 1 << 31):
        x = r.integers(-scale, scale, (50, 300))
        q = [[int(v) ** 2 for v in row] for row in x]
        high, low = (np.array([sum(f(v) for v in row) for row in q]) for f in (lambda v: v >> A.LOW, lambda v: v & ((1 << A.LOW) - 1)))
        n, s = np.full(50, 300), x.sum(axis=1)
        want = [300 * sum(row) - int(t) ** 2 for row, t in zip(q, s)]
        assert A._spread(n, s, high, low).tolist() == [float(w) for w in want]
    values = np.concatenate([r.integers(0, 1 << 38, 500), [0, 1, (1 << 23) - 1, 1 << 23, (1 << 38) - 1]])
    assert A._high(values).tolist() == [int(v) ** 2 >> A.LOW for v in values]


def test_positions_where_places_do_not_fit_one_number(monkeypatch):
    group, at = np.repeat([0, 1, 2], [3, 2, 4]), np.array([5, 9, 9, 1, 2, 0, 3, 3, 8])
    whole = A._positions(group, at, [4])
    monkeypatch.setattr(A, "SAFE", 20)
    split = A._positions(group, at, [4])
    assert whole[0].tolist() == split[0].tolist() == [0, 1, 1, 3, 4, 5, 6, 6, 8]
    assert whole[1][0].tolist() == split[1][0].tolist() == [0, 0, 0, 3, 3, 5, 5, 5, 8]


def test_neighbours_before_over_slices(spark, small_tasks):
    """Maxima and deviations carried over slices of a few rows equal a plain version."""
    df = events(spark, 120).select("event_id", "us", "user", F.col("cents").cast("double").alias("x"))
    rows = sorted((r.us, r.event_id, r.user, r.x) for r in df.collect())
    for r in G.neighbour_aggregate_before(df, "user", ["x"]).collect():
        seen = [x for us, _, user, x in rows if user == r.user and us < r.us and x is not None]
        assert r.nbmean_x == pytest.approx(np.mean(seen) if seen else 0, abs=1e-7) and r.nbmax_x == (max(seen) if seen else 0)
        assert r.nbstd_x == pytest.approx(np.std(seen, ddof=1) if len(seen) > 1 else 0, abs=1e-6)


@pytest.mark.parametrize("share", [0.0, 0.37, 1.0])
def test_order_statistic_by_share(spark, share):
    df = events(spark, 90)
    order = sorted((r.us, r.event_id) for r in df.collect())
    k = int(90 * share)
    assert order_statistic(df, "us", "event_id", lambda n: int(n * share)) == (order[k - 1] if k else None)


def test_every_row_finds_its_nearest(spark):
    r = np.random.default_rng(2)
    known, rows = r.normal(size=(60, 3)), r.normal(size=(700, 3))
    rows[5] = known[7]
    frame = lambda x: spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "_id long, a double, b double, c double")
    got = {q._id: q.distance for q in L.nearest_distance(frame(known), frame(rows), ["a", "b", "c"], block=64).collect()}
    want = np.sqrt(((rows[:, None] - known[None]) ** 2).sum(axis=2)).min(axis=1)
    assert len(got) == 700 and got[5] == 0.0 and np.allclose([got[i] for i in range(700)], want, atol=1e-12)


def test_gate_says_what_it_left_out(spark):
    rows = lambda *made: spark.createDataFrame(list(made), "layer string, metric string, value double, passed boolean")
    df = events(spark, 5)

    def broken(a, b):
        raise ValueError("no")

    layers = {"marginal": lambda a, b: rows(("marginal", "m", 1.0, False)), "behavioral": broken, "privacy": lambda a, b: rows(("privacy", "min_dcr", 0.1, True))}
    gate = L.run_gate(df, df, 0, layers)
    assert (gate.passed, gate.shadow, gate.shadow_failed, gate.composite, gate.failed) == (False, "marginal", True, 20.0, ("behavioral",))
    assert gate.summary().first().failed == "behavioral"
    assert L.run_gate(df, df, 1, {"marginal": layers["privacy"]}).passed
    few = {r.metric: (r.value, r.passed) for r in L.transfer_ratio(df, df).collect()}
    assert few == {"tstr_ratio": (1.0, True), "too_few_rows": (5.0, True)}


def test_digits_and_unknown_columns(spark):
    df = spark.createDataFrame([("a", "12.34", None), ("b", "1.001", None), ("c", "1000000000000", "x"), ("d", "999999999999.99", None)], "n string, amount string, hat string")
    out = {r.n: set(r.violations) for r in C.with_violations(df.withColumn("amount", F.col("amount").cast("decimal(20,4)")), allow=["n"]).collect()}
    found = {n: {v for v in x if v.endswith((":digits", ":unknown"))} for n, x in out.items()}
    assert found == {"a": set(), "b": {"amount:digits"}, "c": {"amount:digits", "hat:unknown"}, "d": set()}


def test_claims(spark):
    row = ("k", "v", "s", "vendor", "a", "t", "")
    assert claim_problems(claims(spark, [row])).count() == 0
    bad = claims(spark, [row, ("k", None, "s", "vendor", "a", "t", ""), ("z", "v", "s", "rumour", "a", "t", "")])
    assert sorted(map(tuple, claim_problems(bad).collect())) == [("duplicate_key", "k"), ("missing_value", "k"), ("provenance", "z")]
    assert [r.rule for r in claim_problems(bad.limit(0)).collect()] == ["no_claims"]


def test_parameters_that_are_no_numbers(spark):
    base = {"perturbation_budget": 0.5}
    rows = [("V22", base, {"target_feature": "sum_ip_1h"}, None, "ok"), ("V22", base, {}, None, "schema: missing"), ("V22", base, {"target_feature": "payer_pagerank"}, None, "schema: not a controllable feature"),
            ("V28", {"fan_in_degree": 5.0, "hop_count": 2.0, "dwell_minutes": 3.0}, {}, [1.0] * 9, "schema: ladder steps"), ("V28", {"fan_in_degree": 5.5, "hop_count": 2.0, "dwell_minutes": 3.0}, {}, None, "schema: not an integer"),
            ("V20", {"attestation_invalid_frac": 0.5}, {}, [1.0] * 4, "schema: unknown parameter"), ("V28", {"fan_in_degree": 5.0, "hop_count": 2.0, "dwell_minutes": 3.0, "amount_ladder": 1.0}, {}, None, "schema: not a number")]
    df = spark.createDataFrame([(v, p, t, {"amount_ladder": l} if l else {}, None, None) for v, p, t, l, _ in rows],
                               "vector_id string, params map<string,double>, texts map<string,string>, lists map<string,array<double>>, band_low double, band_high double")
    assert [r.reason for r in check_parameters(df).collect()] == [x[-1] for x in rows]


@pytest.mark.parametrize("top", [500, (1 << 31) - 1])
def test_hot_groups_in_slices_equal_running_sums(spark, small_tasks, top, monkeypatch):
    """Some groups hot and some not, slices shorter and longer than a window: the same block, without signed sums of all groups."""
    df, windows = events(spark, top=top).withColumn("device", F.expr("CASE WHEN event_id % 40 = 0 THEN event_id + 100 ELSE device END")), {"5s": 5_000_000, "30s": 30_000_000}
    block = lambda method: {r.event_id: r for r in W.velocity_block(df, "event_id", "us", F.col("cents"), F.col("declined"), KEYS, windows, method=method).collect()}
    running = block("running")
    for limit in ("4", "90"):
        spark.conf.set("paysieve.rowsPerTask", limit)
        with monkeypatch.context() as m:
            m.setattr(W, "_signed_sums", None)
            sliced = block("auto")
        assert sliced.keys() == running.keys() and len(sliced) == 400
        for k in sliced:
            a, b = sliced[k].asDict(), running[k].asDict()
            assert a.keys() == b.keys() and all(a[c] == pytest.approx(b[c], rel=1e-12, abs=1e-9) for c in a)


def test_totals_go_on_from_table_to_table():
    """A slice in one table or in many: the same sums, and what it was handed counts from its first event on."""
    r, kinds = np.random.default_rng(3), [("key", pa.int32()), ("at", pa.int64()), ("step", pa.int32()), ("cents", pa.int64()), ("flag", pa.int32()), ("carry", pa.list_(pa.int64()))]
    rows = [(k, -(1 << 62), s, None, None, [3 - s, 10 * (3 - s), 2, 1, 0, 900 * (3 - s)]) for k in (0, 1) for s in (0, 1)]
    rows += [(k, int(t), int(s), int(c), int(c) % 2, None) for k in (0, 1) for t, s, c in zip(r.integers(0, 12, 60), r.integers(0, 2, 60), r.integers(1, 50, 60))]
    rows.sort(key=lambda x: x[:2])
    batch = pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], t) for i, (_, t) in enumerate(kinds)], names=[n for n, _ in kinds])
    scan = lambda size: [[c.to_pylist() for c in blocks[0]] for _, _, blocks in A.sliced_velocity(A.whole_groups([batch.slice(i, 3) for i in range(0, len(rows), 3)], [0, 1], size), [0], 1, 2, 3, 4, 5, 1, 1)]
    whole, pieces = scan(10_000), scan(3)
    assert len(whole) == 1 and len(pieces) > 8
    assert whole[0] == [sum((p[i] for p in pieces), []) for i in range(4)]
    assert whole[0][0][0] == 1.0 and whole[0][1][0] == 10.0
