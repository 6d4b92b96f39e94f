"""Streams over several files against their batch twins."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from paysieve.operators.windows import HOUR, Measure, trailing
from paysieve.plans.durable import scratch_path
from paysieve.streaming import joins as J
from paysieve.streaming import runner as R
from paysieve.streaming import stateful as S
from paysieve.streaming import velocity as V


def _write(spark, n=200, files=4):
    path = scratch_path(spark, "stream_in")
    df = spark.range(n).select(
        F.col("id").alias("event_id"), (F.col("id") % 5).alias("user_id"), (F.col("id") * 37 % 500 + 1).alias("amount_c"),
        F.timestamp_micros(F.lit(1_700_000_000_000_000) + F.col("id") * 700_000_000).alias("event_ts"))
    for i in range(files):  # files in time order, one micro-batch each
        lo, hi = i * n // files, (i + 1) * n // files
        df.filter((F.col("event_id") >= lo) & (F.col("event_id") < hi)).coalesce(1).write.mode("append").parquet(path)
    return path, df


def test_trailing_state_across_batches(spark):
    path, df = _write(spark)
    out = R.land(S.trailing_stream(R.stream_parquet(spark, path, "*.parquet", 1), "user_id", {"6h": 6 * HOUR}))
    got = {r["event_id"]: (r["cnt_6h"], r["sum_6h"]) for r in out.collect()}
    m = [Measure("c", "v", 6 * HOUR, "count"), Measure("s", "v", 6 * HOUR, "sum")]
    twin = trailing(df.withColumn("us", F.unix_micros("event_ts")), ["user_id"], "us", {"v": F.col("amount_c")}, m)
    assert got == {r["event_id"]: (r["c"], r["s"]) for r in twin.collect()}


def test_velocity_complete_equals_batch_and_append_leaves_open_windows(spark):
    path, df = _write(spark)
    args = (["user_id"], "event_ts", F.col("amount_c"), F.lit(0), "3 hours")
    batch = sorted(map(tuple, V.window_velocity(df, *args).collect()))
    stream = lambda: V.window_velocity(R.stream_parquet(spark, path, "*.parquet", 1), *args)
    assert sorted(map(tuple, R.land(stream(), "complete").collect())) == batch
    closed = sorted(map(tuple, R.land(stream(), "append").collect()))
    assert len(closed) < len(batch) and set(closed) <= set(batch)


def test_sketch_rollup_is_near_the_truth(spark):
    df = spark.range(5000).select((F.col("id") % 2).alias("device"), F.col("id").alias("user"),
                                  F.timestamp_micros(F.col("id") * 1_000_000).alias("at"))
    for r in V.roll_up(V.hourly_sketches(df, ["device"], "user", "at"), ["device"]).collect():
        assert abs(r["distinct"] - 2500) < 2500 * 0.05


def test_repeated_delivery_is_dropped(spark):
    path, df = _write(spark, 40, 1)
    df.limit(10).write.mode("append").parquet(path)
    out = R.land(J.drop_late(R.stream_parquet(spark, path, "*.parquet", 1), "event_ts", ["event_id"], "30 days"))
    assert out.count() == 40


def _events(spark, files=5, late=()):
    """Files in time order but for late ids, which come one file later than their time."""
    path, n = scratch_path(spark, "stream_in"), 240
    df = spark.range(n).select(
        F.col("id").alias("event_id"), (F.col("id") % 3).alias("user_id"), F.when(F.col("id") % 11 > 0, (F.col("id") * 7) % 9).alias("payee_id"),
        ((F.col("id") * 13) % 4).cast("int").alias("category"), (F.col("id") * 37 % 500 + 1).alias("amount_c"),
        F.timestamp_micros(F.lit(1_700_000_000_000_000) + F.col("id") * 300_000_000).alias("event_ts"))
    part = F.least(F.floor(F.col("event_id") * files / n) + F.col("event_id").isin(*late).cast("int"), F.lit(files - 1))
    for i in range(files):
        df.filter(part == i).coalesce(1).write.mode("append").parquet(path)
    return path, df


def _measured(df, width):
    """Per event: the measures of earlier events of the user in [t - width, t)."""
    rows = sorted(((int(r.event_ts.timestamp() * 1_000_000), r.event_id, r.user_id, r.payee_id, r.category, r.amount_c) for r in df.collect()))
    out, last = {}, {}
    fresh = {}
    for us, event, user, payee, _, _ in rows:
        before = last.get((user, payee))
        fresh[event] = (before is None or us - before >= width, before is None)
        last[user, payee] = us
    for us, event, user, _, _, _ in rows:
        inside = [x for x in rows if x[2] == user and us - width <= x[0] < us]
        cents = [x[5] for x in inside]
        std = round(float(np.std(cents, ddof=1)) / 100, 6) if len(cents) > 1 else None
        out[event] = (len(inside), sum(cents), std, sum(fresh[x[1]][0] for x in inside), int(fresh[event][1]), *[sum(x[4] == c for x in inside) for c in range(4)])
    return out


@pytest.mark.parametrize("late", [(), (47, 95, 143)])
def test_measures_on_a_stream_equal_a_plain_version(spark, late):
    """Several micro-batches; late rows within the lateness see all that came before them, and only they are compared where order matters."""
    path, df = _events(spark, late=late)
    out = R.land(S.measures_stream(R.stream_parquet(spark, path, "*.parquet", 1), "user_id", 4 * HOUR, "payee_id", "category", 4, lateness="2 hours"))
    got = {r.event_id: (r.cnt, r.cents, None if r["std"] is None else round(r["std"], 6), r["distinct"], r["first"], r.c0, r.c1, r.c2, r.c3) for r in out.collect()}
    want = _measured(df, 4 * HOUR)
    assert got.keys() == want.keys()
    if not late:
        assert got == want
    for event in late:  # counts of a late row are exact: all that is earlier has come
        assert got[event][:3] == want[event][:3] and got[event][5:] == want[event][5:]


def test_changed_keys_alone_are_written(spark):
    path, df = _events(spark)
    stream = V.window_velocity(R.stream_parquet(spark, path, "*.parquet", 1), ["user_id"], "event_ts", F.col("amount_c"), F.lit(0), "3 hours", "1 hour")
    landed = scratch_path(spark, "landed")
    out = R.land_updates(stream, ["user_id", "start_us"], landed)
    batch = sorted(map(tuple, V.window_velocity(df, ["user_id"], "event_ts", F.col("amount_c"), F.lit(0), "3 hours", "1 hour").collect()))
    assert sorted(map(tuple, out.collect())) == batch
    sizes = [r["count"] for r in spark.read.parquet(landed).groupBy(R.BATCH).count().collect()]
    assert len(sizes) == 5 and max(sizes) < len(batch) / 2
    again = spark.read.parquet(landed).filter(f"{R.BATCH} = 2").drop(R.BATCH)
    again.collect()
    R.write_batch(spark.createDataFrame(again.collect(), again.schema), 2, landed)  # the batch is delivered once more
    assert sorted(map(tuple, R.latest(spark, landed, ["user_id", "start_us"], stream.schema).collect())) == batch


def test_counter_dies_unless_it_is_renewed(spark):
    """One key is used every half hour, the other pauses for three hours; counters live for one."""
    path, minute = scratch_path(spark, "stream_in"), 60_000_000
    rows = [("kept", f"a{i % 7}", i * 30) for i in range(16)] + [("dies", f"b{i}", t) for i, t in enumerate((0, 20, 50, 240, 250, 260, 265))] + [("kept", None, 485)]
    for low, high in ((0, 100), (100, 255), (255, 1000)):  # two cuts, one of them inside a living counter
        part = [(k, o, t) for k, o, t in rows if low <= t < high]
        spark.createDataFrame(part, "key string, other string, t int").select(
            "key", "other", F.timestamp_micros(F.lit(1_700_000_000_000_000) + F.col("t").cast("long") * minute).alias("event_ts")).coalesce(1).write.mode("append").parquet(path)
    out = R.land_updates(S.living_counter(R.stream_parquet(spark, path, "*.parquet", 1), "key", "other", 60 * minute), ["key", "start_us"])
    got = sorted((r.key, (r.start_us - 1_700_000_000_000_000) // minute, r["distinct"]) for r in out.collect())
    assert got == [("dies", 0, 3), ("dies", 240, 4), ("kept", 0, 7)]


@pytest.mark.parametrize("n", [0, 1, 100, 5_000, 200_000])
def test_sketch_is_within_three_per_cent(n):
    registers, hashes = np.zeros(1 << S.REGISTER_BITS, np.uint8), np.random.default_rng(n).integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2)
    for part in np.array_split(hashes, 3):
        S.sketch_add(registers, part)
        S.sketch_add(registers, part)
    assert abs(S.sketch_estimate(registers) - n) <= max(1, 0.03 * n)


class _Held:
    """A key's state in memory: one value, a list or a map, and how often it is called."""

    def __init__(self):
        self.value, self.rows, self.map, self.calls = None, [], {}, 0

    def _call(self, answer=None):
        self.calls += 1
        return answer

    def exists(self):
        return self._call(bool(self.rows or self.map) or self.value is not None)

    def get(self):
        return self._call(self.value if self.value is not None else iter(list(self.rows)) if self.rows else None)

    def update(self, value):
        self.value = self._call(value)

    def put(self, rows):
        self.rows = self._call(list(rows))

    def appendList(self, rows):
        self.rows = self._call([*self.rows, *rows])

    def containsKey(self, key):
        return self._call(key in self.map)

    def getValue(self, key):
        return self._call(self.map[key])

    def updateValue(self, key, value):
        self.map[key] = self._call(value)


class _Handle:
    def __init__(self):
        self.states = {}

    def _state(self, name, *_):
        return self.states.setdefault(name, _Held())

    getListState = getMapState = getValueState = _state


def test_a_batch_calls_the_state_a_few_times_however_many_rows_it_has():
    """40 others and 400 rows of a key in two batches; 32 calls and more a batch, when each other was a call."""
    handle, processor = _Handle(), S.TrailingMeasures(HOUR, 2)
    processor.init(handle)
    for batch in range(2):
        i = np.arange(400) + 400 * batch
        rows = pd.DataFrame({"us": i * 1_000_000, "event_id": i, "cents": i, "other": [str(x % 40) for x in i], "category": i % 2})
        before = sum(s.calls for s in handle.states.values())
        out = pd.concat(list(processor.handleInputRows(("a",), iter([rows]), None)))
        assert sum(s.calls for s in handle.states.values()) - before <= 6
        assert out["first"].sum() == (40 if batch == 0 else 0) and out["cnt"].tolist() == i.tolist() and out["distinct"].tolist() == np.minimum(i, 40).tolist()


def test_buckets_of_others_hold_what_one_table_would():
    """Others by the thousand over many batches, null among them, some earlier than what is held; a batch touches its own buckets alone."""
    r, state, size, plain = np.random.default_rng(3), _Held(), (), {}
    for batch in range(30):
        seen = S.SeenOthers(state, *size)
        for _ in range(300):
            name, at = (None if r.random() < 0.01 else f"p{r.integers(5_000)}"), (int(r.integers(1_000)) + 500 * batch, int(r.integers(9)))
            before = plain.get(name)
            assert seen.meet(name, *at) == before
            plain[name] = at if before is None else max(at, before)
        seen.write()
        size = (seen.others, seen.buckets)
    assert size[0] == len(plain) and size[1] == -(-len(plain) // S.BUCKET) and set(state.map) == {(i,) for i in range(size[1])}
    one = S.SeenOthers(state, *size)
    assert one.meet("p1", 10**9, 0) == plain["p1"] and len(one.loaded) == 1
