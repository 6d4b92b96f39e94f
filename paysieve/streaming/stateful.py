"""Per-key state: exact trailing windows per event, and nonce replay."""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql import functions as F

from paysieve.streaming.runner import use_rocksdb


class TrailingWindows(StatefulProcessor):
    """Keeps the events of the longest window per key and emits count and sum over ``[t - w, t)``.

    Rows older than the watermark never arrive here; a row that is late but within it sees the
    events stored so far, and earlier outputs are not revised. Events are kept for the longest
    window and the lateness, so that a late row finds all that came before it.
    """

    def __init__(self, windows: Mapping[str, int], late_us: int = 0):
        self.windows = dict(windows)
        self.longest = max(windows.values()) + late_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.recent = handle.getListState("recent", "us long, cents long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fresh = pd.concat(list(rows), ignore_index=True).sort_values(["us", "event_id"], kind="stable")
        stored = list(self.recent.get()) if self.recent.exists() else []
        us = np.concatenate([np.array([r[0] for r in stored], dtype="int64"), fresh["us"].to_numpy("int64")])
        cents = np.concatenate([np.array([r[1] for r in stored], dtype="int64"), fresh["cents"].to_numpy("int64")])
        order = np.argsort(us, kind="stable")
        us, cents = us[order], cents[order]
        total = np.concatenate([[0], np.cumsum(cents)])
        at = fresh["us"].to_numpy("int64")
        hi = np.searchsorted(us, at, side="left")
        out = {"key": [key[0]] * len(fresh), "event_id": fresh["event_id"].to_numpy()}
        for name, width in self.windows.items():
            lo = np.searchsorted(us, at - width, side="left")
            out[f"cnt_{name}"], out[f"sum_{name}"] = hi - lo, total[hi] - total[lo]
        keep = us >= us[-1] - self.longest
        self.recent.put([(int(a), int(b)) for a, b in zip(us[keep], cents[keep])])
        self.handle.registerTimer(int((us[-1] + self.longest) // 1000) + 1)
        yield pd.DataFrame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        expiry = expiredTimerInfo.getExpiryTimeInMs()
        kept = [r for r in self.recent.get() if (r[0] + self.longest) // 1000 >= expiry] if self.recent.exists() else []
        if kept:
            self.recent.put(kept)
        else:
            self.recent.clear()
        return iter(())

    def close(self) -> None:
        pass


def _micros(events: DataFrame, span: str) -> int:
    return events.sparkSession.sql(f"SELECT CAST(unix_micros(TIMESTAMP_SECONDS(0) + INTERVAL {span}) AS BIGINT) AS us").first()["us"]


def trailing_stream(events: DataFrame, key: str, windows: Mapping[str, int], at="event_ts", tie="event_id", cents="amount_c",
                    lateness="10 minutes") -> DataFrame:
    """(key, event_id, cnt_/sum_ per window) per event of a stream, strictly before the event."""
    use_rocksdb(events.sparkSession)
    columns = ", ".join(f"cnt_{n} long, sum_{n} long" for n in windows)
    rows = events.select(F.col(key).cast("string").alias("key"), F.col(tie).alias("event_id"), F.col(at).alias("at"),
                         F.unix_micros(at).alias("us"), F.col(cents).cast("long").alias("cents")).withWatermark("at", lateness)
    return rows.groupBy("key").transformWithStateInPandas(
        statefulProcessor=TrailingWindows(windows, _micros(events, lateness)), outputStructType=f"key string, event_id long, {columns}",
        outputMode="append", timeMode="EventTime")


BUCKET, BLOCK = 64, 10_000  # others in a bucket on average; rows in an entry of a list


def bucket_of(name: str | None, buckets: int) -> int:
    """The bucket of a name among so many; one bucket more takes names from one bucket alone."""
    top = 1 << (buckets.bit_length() - 1)
    place = (0 if name is None else zlib.crc32(name.encode())) & (2 * top - 1)
    return place if place < buckets else place - top


class SeenOthers:
    """When each other of a key was last seen: buckets of names in a map state, one more whenever they are full on average.

    A batch loads and writes the buckets of its own others, each in one call, however many others the key has.
    """

    def __init__(self, state, others: int = 0, buckets: int = 0):
        self.state, self.others, self.buckets = state, others, buckets
        self.loaded: dict[int, dict] = {}
        if not buckets:
            self.buckets, self.loaded[0] = 1, {}

    def bucket(self, number: int) -> dict:
        if number not in self.loaded:
            names, times = self.state.getValue((number,))
            self.loaded[number] = dict(zip(names, map(tuple, np.frombuffer(bytes(times), "int64").reshape(-1, 2).tolist())))
        return self.loaded[number]

    def meet(self, name: str | None, us: int, event_id: int) -> tuple[int, int] | None:
        """When the other was last seen, by time and id; from now on this event, unless it is earlier."""
        held = self.bucket(bucket_of(name, self.buckets))
        before = held.get(name)
        if before is None or (us, event_id) > before:
            held[name] = (us, event_id)
        if before is None:
            self.others += 1
            if self.others > BUCKET * self.buckets:
                self._split()
        return before

    def _split(self) -> None:
        new = self.buckets
        held = self.bucket(new - (1 << (new.bit_length() - 1)))
        self.buckets += 1
        self.loaded[new] = {name: held.pop(name) for name in [n for n in held if bucket_of(n, self.buckets) == new]}

    def write(self) -> None:
        for number, held in self.loaded.items():
            self.state.updateValue((number,), (list(held), np.array(list(held.values()), "int64").tobytes()))


class TrailingMeasures(StatefulProcessor):
    """Exact trailing measures of a key beyond count and sum: deviation, counts by category, distinct others, first use.

    State: the rows of the longest window in a list of blocks that batches append to (it is rewritten only once half of it has
    expired), and buckets that tell of every other of the key when it was last seen; being there is also what tells that
    a pair was seen before. Rows and others travel packed, many in a call of the state: a call costs far more than a row.
    """

    def __init__(self, width: int, categories: int, late_us: int = 0):
        self.width, self.categories, self.kept_us = width, categories, width + late_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.recent = handle.getListState("recent", "rows binary")  # longs: time, hundredths, category, whether its other was new
        self.seen = handle.getMapState("seen", "bucket int", "names array<string>, times binary")  # longs: time, id
        self.size = handle.getValueState("size", "others long, buckets int")

    def _arrived(self, seen: SeenOthers, rows) -> tuple[np.ndarray, np.ndarray]:
        """Per new row, whether its other was not seen in the window before it, and whether it never was."""
        before = [seen.meet(other, us, event_id) for us, event_id, other in rows]
        new = [b is None or us - b[0] >= self.width for b, (us, _, _) in zip(before, rows)]
        return np.array(new, bool), np.array([b is None for b in before], bool)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        parts = list(rows)
        fresh = parts[0] if len(parts) == 1 else pd.concat(parts, ignore_index=True)
        at, event_id, cents, category = (_longs(fresh[c]) for c in ("us", "event_id", "cents", "category"))
        order = np.lexsort((event_id, at))
        at, event_id = at[order], event_id[order]
        others = [x if isinstance(x, str) else None for x in fresh["other"].to_numpy()[order]]
        size = self.size.get()
        seen = SeenOthers(self.seen, *(size or ()))
        new, first = self._arrived(seen, list(zip(at.tolist(), event_id.tolist(), others)))
        seen.write()
        if size != (seen.others, seen.buckets):
            self.size.update((seen.others, seen.buckets))
        added = np.stack([at, cents[order], category[order], new])
        stored = [np.frombuffer(bytes(r[0]), "int64").reshape(4, -1) for r in self.recent.get()] if size is not None else []
        table = np.concatenate([*stored, added], axis=1)
        table = table[:, np.argsort(table[0], kind="stable")]
        us, cents, category, new = table
        low, high = np.searchsorted(us, at - self.width, side="left"), np.searchsorted(us, at, side="left")
        off = cents - int(cents.mean())
        values = np.stack([cents, new, off, off**2, *[category == k for k in range(self.categories)]])
        total = np.zeros((len(values), len(us) + 1), "int64")
        np.cumsum(values, axis=1, out=total[:, 1:])
        cents, distinct, moved, square, *counts = total[:, high] - total[:, low]
        n = high - low
        with np.errstate(divide="ignore", invalid="ignore"):
            std = np.sqrt(np.maximum(n * square.astype("float64") - moved.astype("float64") ** 2, 0) / (n * (n - 1.0))) / 100
        out = {"key": [key[0]] * len(at), "event_id": event_id, "cnt": n, "cents": cents, "std": np.where(n > 1, std, np.nan),
               "distinct": distinct, "first": first.astype("int32")}
        out |= {f"c{k}": c for k, c in enumerate(counts)}
        live = us >= us[-1] - self.kept_us
        if 2 * live.sum() < len(us):
            self.recent.put(_blocks(table[:, live]))
        else:
            self.recent.appendList(_blocks(added))
        yield pd.DataFrame(out)

    def close(self) -> None:
        pass


def _longs(column: pd.Series) -> np.ndarray:
    return column.to_numpy() if column.dtype == "int64" else column.astype("int64").to_numpy()  # raises where a value is missing


def _blocks(table: np.ndarray) -> list[tuple]:
    """A table cut into packed blocks of rows."""
    return [(table[:, i : i + BLOCK].tobytes(),) for i in range(0, table.shape[1], BLOCK)]


def measures_stream(events: DataFrame, key: str, width: int, other: str, category: str, categories: int, at="event_ts", tie="event_id",
                    cents="amount_c", lateness="10 minutes") -> DataFrame:
    """(key, event_id, cnt, cents, std, distinct, first, c0..) per event of a stream, over ``[t - width, t)``.

    ``distinct`` counts the window's events whose other was not seen in the window before them, ``first`` marks the first
    event ever of a (key, other) pair by arrival, ``c0..`` count the window's events by category.
    """
    use_rocksdb(events.sparkSession)
    columns = "key string, event_id long, cnt long, cents long, std double, distinct long, first int, " + ", ".join(f"c{k} long" for k in range(categories))
    rows = events.select(F.col(key).cast("string").alias("key"), F.col(tie).alias("event_id"), F.col(at).alias("at"), F.unix_micros(at).alias("us"),
                         F.col(cents).cast("long").alias("cents"), F.col(other).cast("string").alias("other"), F.col(category).cast("int").alias("category")).withWatermark("at", lateness)
    return rows.groupBy("key").transformWithStateInPandas(
        statefulProcessor=TrailingMeasures(width, categories, _micros(events, lateness)), outputStructType=columns, outputMode="append", timeMode="EventTime")


REGISTER_BITS = 14


def sketch_add(registers: np.ndarray, hashes: np.ndarray) -> None:
    """Adds 64-bit hashes to a counter of 2**14 registers, in place: each keeps the longest run of leading zeros it has met."""
    place = (hashes >> np.uint64(64 - REGISTER_BITS)).astype(np.int64)
    rest = (hashes << np.uint64(REGISTER_BITS)) | np.uint64((1 << REGISTER_BITS) - 1)
    run = 65 - np.frexp(rest.astype(np.float64))[1]
    np.maximum.at(registers, place, np.minimum(run, 64 - REGISTER_BITS + 1).astype(np.uint8))


def sketch_estimate(registers: np.ndarray) -> float:
    """Distinct values in the counter; linear counting while many registers are empty."""
    m = len(registers)
    raw = 0.7213 / (1 + 1.079 / m) * m * m / np.exp2(-registers.astype("float64")).sum()
    empty = int((registers == 0).sum())
    return m * np.log(m / empty) if raw <= 2.5 * m and empty else raw


class LivingCounter(StatefulProcessor):
    """A distinct counter that lives as long as adds renew it: one sketch in value state, updated in place.

    Every add moves the time of death to its event time plus ``ttl_us``; an add at or after that begins a new counter.
    """

    def __init__(self, ttl_us: int):
        self.ttl_us = ttl_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counter = handle.getValueState("counter", "start_us long, last_us long, registers binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fresh = pd.concat(list(rows), ignore_index=True).sort_values("us", kind="stable")
        us = fresh["us"].to_numpy("int64")
        hashes = fresh["hash"].to_numpy("int64").view("uint64")
        counted = fresh["counted"].to_numpy(bool)
        start, last, registers = None, None, np.zeros(1 << REGISTER_BITS, np.uint8)
        if self.counter.exists():
            start, last, held = self.counter.get()
            registers = np.frombuffer(bytes(held), np.uint8).copy()
        out, begin = [], 0
        edges = [0] if last is None or us[0] - last >= self.ttl_us else []
        edges += (np.flatnonzero(np.diff(us) >= self.ttl_us) + 1).tolist()
        for low, high in zip([begin, *[e for e in edges if e]], [*[e for e in edges if e], len(us)]):
            if low in edges:
                start, registers = int(us[low]), np.zeros(1 << REGISTER_BITS, np.uint8)
            sketch_add(registers, hashes[low:high][counted[low:high]])
            out.append((key[0], start, int(round(sketch_estimate(registers)))))
        last = max(int(us[-1]), last or int(us[-1]))
        self.counter.update((start, last, registers.tobytes()))
        self.handle.registerTimer((last + self.ttl_us) // 1000 + 1)
        yield pd.DataFrame(out, columns=["key", "start_us", "distinct"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.counter.exists() and (self.counter.get()[1] + self.ttl_us) // 1000 < expiredTimerInfo.getExpiryTimeInMs():
            self.counter.clear()  # unless a later add has renewed it
        return iter(())

    def close(self) -> None:
        pass


def living_counter(events: DataFrame, key: str, other: str, ttl_us: int, at="event_ts", lateness="10 minutes") -> DataFrame:
    """(key, start_us, distinct) in update mode: the counters that a batch's adds began or renewed. Null others renew, and are not counted."""
    use_rocksdb(events.sparkSession)
    rows = events.select(F.col(key).cast("string").alias("key"), F.col(at).alias("at"), F.unix_micros(at).alias("us"),
                         F.xxhash64(F.col(other).cast("string")).alias("hash"), F.col(other).isNotNull().alias("counted")).withWatermark("at", lateness)
    return rows.groupBy("key").transformWithStateInPandas(
        statefulProcessor=LivingCounter(ttl_us), outputStructType="key string, start_us long, distinct long", outputMode="update", timeMode="EventTime")


class FirstUse(StatefulProcessor):
    """Remembers who used a nonce first and emits every later use; never forgets unless
    ``ttl_ms`` of event time is given, after which a nonce counts as new.
    """

    def __init__(self, ttl_ms: int | None = None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.first = handle.getValueState("first", "us long, event_id long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fresh = pd.concat(list(rows), ignore_index=True).sort_values(["us", "event_id"])
        if self.first.exists():
            known = self.first.get()
        else:
            head = fresh.iloc[0]
            known = (int(head["us"]), int(head["event_id"]))
            self.first.update(known)
            if self.ttl_ms is not None:
                self.handle.registerTimer(known[0] // 1000 + self.ttl_ms)
            fresh = fresh.iloc[1:]
        if len(fresh):
            yield pd.DataFrame({"nonce": [key[0]] * len(fresh), "event_id": fresh["event_id"].to_numpy("int64"),
                                "first_event_id": np.full(len(fresh), known[1], dtype="int64")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.first.clear()
        return iter(())

    def close(self) -> None:
        pass


def nonce_replays(events: DataFrame, nonce="mandate_nonce", at="event_ts", tie="event_id", ttl_ms: int | None = None,
                  lateness="10 minutes") -> DataFrame:
    """(nonce, event_id, first_event_id) for each reuse of a nonce on a stream."""
    use_rocksdb(events.sparkSession)
    rows = events.filter(F.col(nonce).isNotNull()).select(
        F.col(nonce).cast("string").alias("nonce"), F.col(tie).alias("event_id"), F.col(at).alias("at"),
        F.unix_micros(at).alias("us")).withWatermark("at", lateness)
    return rows.groupBy("nonce").transformWithStateInPandas(
        statefulProcessor=FirstUse(ttl_ms), outputStructType="nonce string, event_id long, first_event_id long",
        outputMode="append", timeMode="EventTime")
