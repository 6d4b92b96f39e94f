"""Point-in-time aggregates: every value describes rows strictly earlier than the event.

Values are integers (money in minor units), so running sums are exact and subtracting them
loses nothing. The frame is ``[t - w, t)``: rows with the same timestamp are outside.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paysieve.operators import trailing_arrays as A
from paysieve.plans.scan import first_rows, previous_row, running_totals
from paysieve.plans.skew import CHUNK, Layout, attach_group_stats, join_on_keys, plan_layout, with_chunks, with_hot_flag

SECOND = 1_000_000
MINUTE = 60 * SECOND
HOUR = 3600 * SECOND
DAY = 24 * HOUR
VELOCITY_WINDOWS = {"60s": MINUTE, "10min": 10 * MINUTE, "1h": HOUR, "24h": DAY, "7d": 7 * DAY}
VELOCITY_KEYS = ("pan_token", "device_id", "ip", "merchant_id", "payee_entity_id", "agent_id")
VELOCITY_AGGREGATIONS = ("cnt", "sum", "declrate", "amtstd")
# Above this group size re-aggregating every frame costs more than one extra row per window.
SLIDING_GROUP_ROWS = 1_000

_UNITS = {"s": SECOND, "min": MINUTE, "h": HOUR, "d": DAY}


def window_micros(text: str) -> int:
    """'60s', '10min', '1h', '24h', '7d' in microseconds."""
    digits = "".join(c for c in text if c.isdigit())
    return int(digits) * _UNITS[text[len(digits):]]


@dataclass(frozen=True)
class Measure:
    """One output column: an aggregate of a named value over a trailing window."""

    name: str
    value: str
    window: int
    kind: str  # count | sum | mean | std
    scale: int = 1  # divide sums, means and deviations by this (100 for cents)


def _wide(value: Column) -> Column:
    return value.cast("decimal(19,0)")


# Squares of values below this fit a long and are summed as two longs; others as decimals.
NARROW = 1 << 31


def _accumulators(measures: Sequence[Measure], narrow: bool) -> list[tuple[int, str, str]]:
    needed = {"count": "n", "sum": "s", "mean": "ns", "std": "nshl" if narrow else "nsq"}
    out = {}
    for m in measures:
        for part in needed[m.kind]:
            out[(m.window, m.value, part)] = None
    return list(out)


def _name(window: int, value: str, part: str) -> str:
    return f"_{part}_{window}_{value}"


def _part(value: Column, part: str) -> Column:
    if part == "n":
        return F.when(value.isNotNull(), F.lit(1).cast("bigint"))
    if part == "s":
        return value.cast("bigint")
    if part in "hl":
        square = value.cast("bigint") * value.cast("bigint")
        return F.shiftright(square, 31) if part == "h" else square.bitwiseAND(F.lit(NARROW - 1).cast("bigint"))
    return _wide(value) * _wide(value)


def all_narrow(df: DataFrame, values: Sequence[Column]) -> bool:
    """Whether every value that is squared stays below NARROW (one scan of those columns)."""
    top = df.agg(F.greatest(F.lit(0), *[F.max(F.abs(v.cast("bigint"))) for v in values]).alias("m")).first()["m"]
    return (top or 0) < NARROW


def std_from_sums(n: Column, s: Column, q: Column) -> Column:
    """Sample deviation from exact integer sums; null below two values."""
    exact = F.try_subtract(
        F.try_multiply(n.cast("decimal(19,0)"), q.cast("decimal(38,0)")),
        F.try_multiply(s.cast("decimal(19,0)"), s.cast("decimal(19,0)")),
    ).cast("double")
    rough = n.cast("double") * q.cast("double") - s.cast("double") * s.cast("double")
    spread = F.greatest(F.coalesce(exact, rough), F.lit(0.0))
    return F.when(n > 1, F.sqrt(spread / (n.cast("double") * (n - 1).cast("double"))))


def _finish(m: Measure, narrow: bool) -> Column:
    n, s, q = (F.col(_name(m.window, m.value, p)) for p in "nsq")
    if narrow:
        high, low = (F.col(_name(m.window, m.value, p)).cast("decimal(19,0)") for p in "hl")
        q = high * F.lit(NARROW).cast("decimal(10,0)") + low
    if m.kind == "count":
        return F.coalesce(n, F.lit(0)).cast("bigint")
    if m.kind == "sum":
        total = F.coalesce(s, F.lit(0)).cast("bigint")
        return total if m.scale == 1 else total.cast("double") / m.scale
    if m.kind == "mean":
        return F.when(n > 0, s.cast("double") / n.cast("double") / m.scale)
    if m.kind == "std":
        return std_from_sums(n, s, q) / m.scale
    raise ValueError(f"unknown aggregate {m.kind}")


def trailing(
    df: DataFrame,
    keys: Sequence[str],
    at: str,
    values: Mapping[str, Column],
    measures: Sequence[Measure],
    *,
    method: str = "auto",
    nulls: str = "group",
    layout: Layout | None = None,
    narrow: bool | None = None,
) -> DataFrame:
    """Adds one column per measure.

    ``sliding`` re-aggregates each frame (cheap for small groups). ``running`` emits one
    expiry row per event and window and takes signed running sums: linear in the rows
    whatever the group size, and hot groups are cut into time slices. ``auto`` chooses from
    the measured largest group. ``narrow`` says whether squared values are known to stay below
    NARROW; without it their columns are scanned. ``nulls='zero'`` gives rows without a key empty frames
    instead of treating them as one group.
    """
    if nulls == "zero":
        missing = F.lit(False)
        for k in keys:
            missing = missing | F.col(k).isNull()
        present = trailing(df.filter(~missing), keys, at, values, measures, method=method, layout=layout, narrow=narrow)
        empty = df.filter(missing)
        for m in measures:
            zero = F.lit(0) if m.kind in ("count", "sum") else F.lit(None)
            empty = empty.withColumn(m.name, zero.cast(present.schema[m.name].dataType))
        return present.unionByName(empty)
    if method == "auto" or (method == "running" and layout is None):
        layout = layout or plan_layout(df, keys, F.col(at))
        if method == "auto":
            small = layout.largest <= SLIDING_GROUP_ROWS and not layout.spread
            method = "sliding" if small else "running"
    squared = [values[n] for n in dict.fromkeys(m.value for m in measures if m.kind == "std")]
    narrow = bool(squared) and (all_narrow(df, squared) if narrow is None else narrow)
    named = df.select("*", *[e.alias(f"_v_{n}") for n, e in values.items()])
    parts = _accumulators(measures, narrow)
    if method == "sliding":
        sums = []
        for window, value, part in parts:
            frame = Window.partitionBy(*keys).orderBy(at).rangeBetween(-window, -1)
            sums.append(F.sum(_part(F.col(f"_v_{value}"), part)).over(frame).alias(_name(window, value, part)))
        scanned = named.select("*", *sums)
    elif method == "running":
        scanned = _signed_sums(named, keys, at, [f"_v_{n}" for n in values], parts, layout)
    else:
        raise ValueError(f"unknown method {method}")
    return scanned.select(*df.columns, *[_finish(m, narrow).alias(m.name) for m in measures])


def _signed_sums(named, keys, at, value_columns, parts, layout):
    windows = sorted({w for w, _, _ in parts})
    needed = {at, *keys, *value_columns}
    steps = F.array(*[F.lit(w).cast("bigint") for w in [0, *windows]])
    expanded = named.select("*", F.posexplode(steps).alias("_step", "_ahead"))
    # Expiry rows carry the key, the shifted time and the values; the payload stays behind.
    expanded = expanded.select(
        *[
            F.col(c) if c in needed and c != at else
            (F.col(at) + F.col("_ahead")).alias(at) if c == at else
            F.when(F.col("_step") == 0, F.col(c)).alias(c)
            for c in named.columns
        ],
        "_step",
    )
    sums = {}
    for window, value, part in parts:
        amount = _part(F.col(f"_v_{value}"), part)
        step = windows.index(window) + 1
        sums[_name(window, value, part)] = F.when(F.col("_step") == 0, amount).when(
            F.col("_step") == step, -amount
        )
    return running_totals(expanded, keys, at, sums, layout=layout).filter("_step = 0").drop("_step")


def pit_count(df, keys, at, window, value, name="cnt", **kw):
    return trailing(df, keys, at, {"v": value}, [Measure(name, "v", window, "count")], **kw)


def pit_sum(df, keys, at, window, value, name="sum", scale=1, **kw):
    return trailing(df, keys, at, {"v": value}, [Measure(name, "v", window, "sum", scale)], **kw)


def pit_mean(df, keys, at, window, value, name="mean", scale=1, **kw):
    return trailing(df, keys, at, {"v": value}, [Measure(name, "v", window, "mean", scale)], **kw)


def pit_std(df, keys, at, window, value, name="std", scale=1, **kw):
    return trailing(df, keys, at, {"v": value}, [Measure(name, "v", window, "std", scale)], **kw)


def pit_category_counts(df, keys, at, window, code, categories, prefix="c", **kw):
    """One count column per category value (``prefix0``..), all over one frame."""
    values = {f"k{c}": F.when(code == c, F.lit(1)) for c in range(categories)}
    measures = [Measure(f"{prefix}{c}", f"k{c}", window, "count") for c in range(categories)]
    return trailing(df, keys, at, values, measures, **kw)


def pit_distinct_approx(df, keys, at, other, window, tie, name="distinct", **kw):
    """Events in the frame whose (key, other) pair was not seen within ``window`` before them.

    An under-count of the true distinct number: a pair last seen just outside the frame is
    missed. See pit_distinct_exact.
    """
    return distinct_approx_block(df, keys, at, {name: (other, window)}, tie, **kw)


def distinct_approx_block(df, keys, at, columns: Mapping[str, tuple[str, int]], tie, **kw):
    """Several approximate distinct counts under one key: one scan for all of them."""
    flagged = df
    values, measures = {}, []
    for name, (other, window) in columns.items():
        flagged = previous_row(flagged, [*keys, other], at, tie, {f"_p_{name}": F.col(at)})
        gap = F.col(at) - F.col(f"_p_{name}")
        flagged = flagged.withColumn(f"_new_{name}", (gap.isNull() | (gap >= window)).cast("int")).drop(
            f"_p_{name}"
        )
        values[name] = F.col(f"_new_{name}")
        measures.append(Measure(name, name, window, "sum"))
    out = trailing(flagged, keys, at, values, measures, **kw)
    return out.drop(*[f"_new_{n}" for n in columns])


def pit_distinct_exact(df, keys, at, other, window, tie, name="distinct"):
    """True number of distinct ``other`` values in ``[t - w, t)``; a null counts as one value.

    An event stands for its pair from its own time until the pair occurs again or leaves the
    window, whichever is first. So each event adds +1 and -1 once: linear, no sets kept.
    """
    nxt = previous_row(df, [*keys, other], at, tie, {"_next": F.col(at)}, descending=True)
    leaves = F.least(F.col(at) + F.lit(window), F.coalesce("_next", F.col(at) + F.lit(window)))
    both = nxt.select(
        "*", F.posexplode(F.array(F.col(at), leaves)).alias("_step", "_when")
    ).select(
        *[
            F.col("_when").alias(at) if c == at else
            F.col(c) if c in keys else
            F.when(F.col("_step") == 0, F.col(c)).alias(c)
            for c in df.columns
        ],
        "_step",
    )
    signed = F.when(F.col("_step") == 0, F.lit(1)).otherwise(F.lit(-1)).cast("bigint")
    return running_totals(both, keys, at, {name: signed}).filter("_step = 0").select(*df.columns, name)


def velocity_block(
    df: DataFrame,
    event_id: str,
    at: str,
    cents: Column,
    declined: Column,
    keys: Mapping[str, str | None],
    windows: Mapping[str, int] = VELOCITY_WINDOWS,
    *,
    scale: int = 100,
    method: str = "auto",
    fill: float | None = 0.0,
    layouts: Mapping[str, Layout] | None = None,
    narrow: bool | None = None,
    beside: DataFrame | None = None,
) -> DataFrame:
    """(event_id, cnt/sum/declrate/amtstd per key and window, other columns of ``beside``).

    ``keys`` maps feature names to columns; a None column gives constant ``fill``. All keys
    go through one exchange as (key number, key value) rows and come back per event id: whole groups as arrays, hot groups
    as slices with their totals so far (``arrays``); by signed sums of all groups only where squares need more bits. With the ``layouts`` of the keys, none of which has a hot group, nothing is measured again.
    ``beside`` has one row per event; it is joined where an event's rows come side by side, and events it lacks are left out. The
    block is of floats then, as in a matrix of features, else of doubles.
    """
    live = {n: c for n, c in keys.items() if c is not None and c in df.columns}
    whole = all(df.schema[c].dataType.typeName() in ("byte", "short", "integer", "long") for c in live.values())
    value_type = "bigint" if whole else "string"
    number = {n: i for i, n in enumerate(live)}
    rows = df.select(
        F.col(event_id).alias("_id"),
        F.col(at).alias("_at"),
        cents.cast("bigint").alias("_cents"),
        declined.cast("int").alias("_decl"),
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(number[n]).alias("key_no"), F.col(c).cast(value_type).alias("key_value"))
                    for n, c in live.items()
                ]
            )
        ).alias("_k"),
    ).select("_id", "_at", "_cents", "_decl", "_k.key_no", "_k.key_value")
    measures = []
    for label, width in windows.items():
        measures += [
            Measure(f"cnt_{label}", "amount", width, "count"),
            Measure(f"sum_{label}", "amount", width, "sum", scale),
            Measure(f"declrate_{label}", "declined", width, "mean"),
            Measure(f"amtstd_{label}", "amount", width, "std", scale),
        ]
    values = {"amount": F.col("_cents"), "declined": F.col("_decl")}
    layout = None
    if layouts is not None and all(n in layouts and layouts[n].hot is None for n in live):
        parts = [layouts[n] for n in live]
        layout = Layout(sum(p.rows for p in parts), max((p.largest for p in parts), default=0), parts[0].limit) if parts else None
    if method == "auto" and layout is None:
        layout = plan_layout(rows, ["key_no", "key_value"], F.col("_at"))
    if method in ("arrays", "auto"):
        if narrow is None:
            narrow = all_narrow(df, [cents])
        if narrow:
            return _velocity_arrays(rows, event_id, number, keys, windows, scale, fill, layout, beside)
    scanned = trailing(rows, ["key_no", "key_value"], "_at", values, measures, method=method, layout=layout, narrow=narrow)
    stats = F.struct(*[F.col(m.name).cast("double").alias(m.name) for m in measures])
    # At most one row per key name and event: the list is bounded by the number of keys.
    per_event = scanned.groupBy("_id").agg(
        F.map_from_entries(F.collect_list(F.struct("key_no", stats))).alias("_by_key")
    )
    columns = []
    for key in keys:
        for label in windows:
            for kind in VELOCITY_AGGREGATIONS:
                value = (
                    F.col("_by_key")[F.lit(number[key])][f"{kind}_{label}"] if key in live else F.lit(None).cast("double")
                )
                if fill is not None:
                    value = F.coalesce(value, F.lit(float(fill)))
                columns.append(value.cast("double" if beside is None else "float").alias(f"{kind}_{key}_{label}"))
    block = per_event.select(F.col("_id").alias(event_id), *columns)
    if beside is None:
        return block
    return beside.join(block.hint("merge"), event_id).select(*block.columns, *[c for c in beside.columns if c != event_id])


def _velocity_arrays(rows: DataFrame, event_id: str, number: Mapping[str, int], keys, windows: Mapping[str, int], scale: int, fill, layout: Layout | None = None,
                     beside: DataFrame | None = None) -> DataFrame:
    """The block as arrays: (key number, key value) groups are scanned where one exchange puts them, hot ones in slices, and a
    second exchange brings an event's rows side by side.
    """
    spread = layout is not None and layout.spread
    if spread:
        flagged = with_hot_flag(rows, ["key_no", "key_value"], layout.hot)
        rows, hot = flagged.filter(~F.col("_hot")).drop("_hot"), flagged.filter("_hot").drop("_hot")
    kind, widths = rows.schema["_id"].dataType.simpleString(), list(windows.values())
    number_type, value = ("double", pa.float64()) if beside is None else ("float", pa.float32())
    made = [f"{agg}_{label}" for label in windows for agg in VELOCITY_AGGREGATIONS]
    sorted_rows = rows.select("_id", "key_no", "key_value", "_at", "_cents", "_decl").repartition("key_no", "key_value").sortWithinPartitions("key_no", "key_value", "_at")

    def scan(batches):
        for table in A.whole_groups(batches, (1, 2)):
            columns = [c.cast(value) for block in A.velocity(table, (1, 2), 3, 4, 5, widths, scale) for c in block]
            yield from pa.Table.from_arrays([table.column(0), table.column(1), *columns], names=["_id", "key_no", *made]).to_batches(max_chunksize=20_000)

    scanned = sorted_rows.mapInArrow(scan, f"_id {kind}, key_no int, " + ", ".join(f"{n} {number_type}" for n in made))
    if spread:
        scanned = scanned.unionByName(_sliced_scan(hot, layout, widths, scale, scanned.schema, made, value))
    live = len(number)
    order = [f"{agg}_{key}_{label}" for key in keys for label in windows for agg in VELOCITY_AGGREGATIONS]

    def side_by_side(batches):
        for table in A.whole_groups(batches, (0,)):
            starts = np.flatnonzero(A.group_starts(table.column(0)))
            if table.num_rows != live * len(starts) or (np.diff(np.append(starts, table.num_rows)) != live).any():
                raise ValueError(f"{event_id} must be unique")
            columns = {}
            for key, i in number.items():
                part = table.take(pa.array(starts + i))
                for n in made:
                    agg, label = n.split("_", 1)
                    column = part.column(n)
                    columns[f"{agg}_{key}_{label}"] = column if fill is None else column.fill_null(float(fill))
            blank = pa.nulls(len(starts), value) if fill is None else pa.array(np.full(len(starts), float(fill)), value)
            own = [table.column("_rest").take(pa.array(starts))] if more else []
            out = pa.Table.from_arrays([table.column(0).take(pa.array(starts)), *(columns.get(n, blank) for n in order), *own], names=["_id", *order, *["_rest" for _ in own]])
            yield from out.to_batches(max_chunksize=10_000)

    paired, more = scanned.repartition("_id"), ""
    if beside is not None:  # joined with an event's first row, before the block is wide, so that the wide rows need no exchange
        rest = beside.select(F.col(event_id).alias("_event"), F.struct(*[c for c in beside.columns if c != event_id]).alias("_rest"))
        paired = paired.join(rest.hint("merge"), (F.col("_id") == F.col("_event")) & (F.col("key_no") == 0), "left").drop("_event")
        more = f", _rest {rest.schema['_rest'].dataType.simpleString()}"
    paired = paired.sortWithinPartitions("_id", "key_no")
    out = paired.mapInArrow(side_by_side, f"_id {kind}, " + ", ".join(f"`{n}` {number_type}" for n in order) + more).withColumnRenamed("_id", event_id)
    return out.filter("_rest IS NOT NULL").select(event_id, *order, "_rest.*") if more else out


def _sliced_scan(hot: DataFrame, layout: Layout, widths: Sequence[int], scale: int, schema, made: Sequence[str], value: pa.DataType) -> DataFrame:
    """The measures of hot groups' rows, linear in the rows: an event is followed by one row per window at the time it leaves it, slices
    of that time are scanned by one task each, and a slice begins with rows that hold what all slices before it add up to.
    """
    keys = ["key_no", "key_value"]
    latest = hot.agg(F.max("_at").alias("t")).first()["t"]  # what leaves a window later is seen by no event
    steps = F.array(*[F.lit(w).cast("bigint") for w in [0, *widths]])
    moved = hot.select("*", F.posexplode(steps).alias("_step", "_ahead")).select(
        F.when(F.col("_step") == 0, F.col("_id")).alias("_id"), *keys, (F.col("_at") + F.col("_ahead")).alias("_at"), "_cents", "_decl", "_step").filter(F.col("_at") <= latest)
    placed = with_chunks(moved, [], F.col("_at"), layout)  # all rows are of hot groups
    square = F.col("_cents") * F.col("_cents")
    parts = [F.count("_cents"), F.sum("_cents"), F.count("_decl"), F.sum(F.col("_decl").cast("bigint")),
             F.sum(F.shiftright(square, A.LOW)), F.sum(square.bitwiseAND(F.lit((1 << A.LOW) - 1).cast("bigint")))]
    totals = placed.groupBy(*keys, CHUNK, "_step").agg(*[F.coalesce(p, F.lit(0)).alias(f"_p{i}") for i, p in enumerate(parts)])
    # A row per slice and step: what came before the next slice, though a slice in between may hold nothing of the step.
    slices = totals.select(*keys, CHUNK).distinct().crossJoin(hot.sparkSession.range(len(widths) + 1).select(F.col("id").cast("int").alias("_step")))
    earlier = Window.partitionBy(*keys, "_step").orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    carry = join_on_keys(slices, totals, [*keys, CHUNK, "_step"]).select(*keys, CHUNK, "_step", F.array(*[
        F.coalesce(F.sum(f"_p{i}").over(earlier), F.lit(0)).cast("bigint") for i in range(len(parts))]).alias("_carry"))
    begins = carry.select(F.lit(None).cast(hot.schema["_id"].dataType).alias("_id"), *keys, F.lit(-(1 << 62)).cast("bigint").alias("_at"),
                          F.lit(None).cast("bigint").alias("_cents"), F.lit(None).cast("int").alias("_decl"), "_step", CHUNK, "_carry")
    columns = begins.columns
    rows = placed.withColumn("_carry", F.lit(None).cast("array<bigint>")).select(*columns).unionByName(begins)
    sorted_rows = rows.repartition(*keys, CHUNK).sortWithinPartitions(*keys, CHUNK, "_at")
    place = {c: i for i, c in enumerate(columns)}
    group, windows = [place[c] for c in (*keys, CHUNK)], len(widths)

    def scan(batches):
        tables = A.whole_groups(batches, [*group, place["_at"]])
        for events, table, blocks in A.sliced_velocity(tables, group, place["_at"], place["_step"], place["_cents"], place["_decl"], place["_carry"], windows, scale):
            own = [table.column(place[c]).take(events) for c in ("_id", "key_no")]
            yield from pa.Table.from_arrays([*own, *[c.cast(value) for block in blocks for c in block]], names=["_id", "key_no", *made]).to_batches(max_chunksize=20_000)

    return sorted_rows.mapInArrow(scan, schema)


def first_occurrence(df, left, right, at, tie, name="first"):
    """1 on the earliest row of each (left, right) pair over the whole table."""
    return first_rows(df, [left, right], at, tie, name)


def age_since_first(df, left, right, at, name="age_hours", layout=None):
    """Hours since the first row of the pair; 0 on that row."""
    keys = [left, right]
    firsts = df.groupBy(*keys).agg(F.min(at).alias("_first"))
    joined = attach_group_stats(df, keys, firsts, layout)
    return joined.withColumn(name, (F.col(at) - F.col("_first")) / F.lit(float(HOUR))).drop("_first")


def reused(df, nonce, at, tie, name="reused"):
    """1 where the non-null nonce was already presented by an earlier row."""
    marked = first_rows(df, [nonce], at, tie, "_f")
    return marked.withColumn(
        name, (F.col(nonce).isNotNull() & (F.col("_f") == 0)).cast("int")
    ).drop("_f")


def expanding_zscore(df, key, at, tie, cents, name="z", scale=100, layout=None):
    """Deviation from the mean of all earlier rows of the key, in their population deviation."""
    value = cents.cast("bigint")
    sums = {
        "_n": F.when(value.isNotNull(), F.lit(1).cast("bigint")),
        "_s": value,
        "_q": _wide(value) * _wide(value),
    }
    scanned = running_totals(df, [key], at, sums, tie=tie, layout=layout)
    n, s = F.col("_n").cast("double"), F.col("_s").cast("double")
    exact = (
        F.col("_n").cast("decimal(19,0)") * F.col("_q").cast("decimal(38,0)")
        - F.col("_s").cast("decimal(19,0)") * F.col("_s").cast("decimal(19,0)")
    ).cast("double")
    std = F.sqrt(F.greatest(exact, F.lit(0.0))) / n
    z = F.when(
        F.col("_n") >= 2, F.when(std / scale > 1e-9, (value.cast("double") - s / n) / std).otherwise(0.0)
    ).otherwise(0.0)
    return scanned.withColumn(name, z).drop("_n", "_s", "_q")


def expanding_hour_loglik(df, key, at, tie, hour, name="loglik", layout=None):
    """ln((1 + earlier rows of the key in this hour) / (24 + earlier rows of the key)).

    Both scans are planned from the input: where no key is hot, no (key, hour) is.
    """
    layout = layout or plan_layout(df, [key], F.col(at))
    staged = df.withColumn("_hour", hour)
    one = F.lit(1).cast("bigint")
    by_hour = layout if layout.hot is None else plan_layout(staged, [key, "_hour"], F.col(at))
    same_hour = running_totals(staged, [key, "_hour"], at, {"_h": one}, tie=tie, layout=by_hour)
    total = running_totals(same_hour, [key], at, {"_n": one}, tie=tie, layout=layout)
    ratio = (1 + F.col("_h")).cast("double") / (24 + F.col("_n")).cast("double")
    return total.withColumn(name, F.log(ratio)).drop("_hour", "_h", "_n")


def inter_event_time(df, key, at, tie, name="gap_s", layout=None):
    """Seconds since the previous event of the key; rows without a key are dropped."""
    seen = previous_row(df.filter(F.col(key).isNotNull()), [key], at, tie, {"_p": F.col(at)}, layout=layout)
    return seen.withColumn(name, (F.col(at) - F.col("_p")) / F.lit(float(SECOND))).drop("_p")


def lag1_autocorr(df, key, at, tie, min_gaps=5):
    """(key, gaps, corr): correlation of ln(gap) with the next ln(gap) of the same key."""
    layout = plan_layout(df.filter(F.col(key).isNotNull()), [key], F.col(at))  # serves both scans
    gaps = inter_event_time(df, key, at, tie, layout=layout).filter("gap_s > 0").select(
        key, at, tie, F.log("gap_s").alias("x")
    )
    pairs = previous_row(gaps, [key], at, tie, {"y": F.col("x")}, descending=True, layout=layout)
    per_key = pairs.groupBy(key).agg(
        F.count(F.lit(1)).alias("gaps"),
        F.stddev_pop("x").alias("_sd"),
        F.corr("x", "y").alias("corr"),
    )
    usable = (F.col("gaps") >= min_gaps) & (F.col("_sd") > 0) & F.col("corr").isNotNull() & ~F.isnan("corr")
    return per_key.filter(usable).drop("_sd")


def weighted_autocorr(df, key, at, tie, min_gaps=5):
    """One row: the mean of lag1_autocorr weighted by gaps - 1 (0 when no key qualifies)."""
    per_key = lag1_autocorr(df, key, at, tie, min_gaps)
    weight = (F.col("gaps") - 1).cast("double")
    return per_key.agg(
        F.coalesce(F.sum(F.col("corr") * weight) / F.sum(weight), F.lit(0.0)).alias("autocorr"),
        F.count(F.lit(1)).alias("keys"),
    )


def burstiness(df, key, at, tie, min_gaps=5):
    """(key, gaps, burstiness): (sd - mean) / (sd + mean) of the gaps."""
    gaps = inter_event_time(df, key, at, tie).filter("gap_s IS NOT NULL")
    per_key = gaps.groupBy(key).agg(
        F.count(F.lit(1)).alias("gaps"), F.avg("gap_s").alias("_m"), F.stddev_pop("gap_s").alias("_s")
    )
    total = F.col("_s") + F.col("_m")
    return per_key.filter((F.col("gaps") >= min_gaps) & (total > 0)).select(
        key, "gaps", ((F.col("_s") - F.col("_m")) / total).alias("burstiness")
    )
