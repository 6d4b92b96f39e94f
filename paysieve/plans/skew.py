"""Finding groups too large for one task, and spreading them.

A group is hot when it holds more rows than one task should see. By counting, at most
``rows / threshold`` groups can be hot, so the list of hot keys has a size bound and may be
broadcast. Cold groups keep the plain one-shuffle plan.
"""

from __future__ import annotations

import math
import os
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS_PER_TASK_KEY = "paysieve.rowsPerTask"
DEFAULT_ROWS_PER_TASK = 2_000_000
MAX_HOT_GROUPS = 100_000
MAX_CHUNKS = 10_000  # quantiles that one aggregate takes
CHUNK = "_chunk"
ROWS_PER_ROUND_TASK, ROUND_TASKS, MOST_ROWS_PER_ROUND_TASK = 40_000, 16, 500_000


def rows_per_task(spark: SparkSession) -> int:
    return int(spark.conf.get(ROWS_PER_TASK_KEY, str(DEFAULT_ROWS_PER_TASK)))


def for_rounds(df: DataFrame, rows: int) -> DataFrame:
    """A table of so many rows that is scanned again in each of many short rounds, dealt to a fitting number of tasks.

    That number depends on the rows alone, not on the files they came in: one small file would keep all rounds on one core,
    and many files would send that many results to the driver in every round. Tables of one task's rows stay as they are.
    """
    if rows <= ROWS_PER_ROUND_TASK:
        return df
    return df.repartition(max(min(ROUND_TASKS, math.ceil(rows / ROWS_PER_ROUND_TASK)), math.ceil(rows / MOST_ROWS_PER_ROUND_TASK)))


@dataclass(frozen=True)
class Layout:
    """Row counts of a grouping, its hot keys (or None) and order-column cut points."""

    rows: int
    largest: int
    limit: int
    hot: DataFrame | None = None
    splits: tuple[float, ...] = ()
    skip: int = 0  # characters that all texts of the order column share

    @property
    def spread(self) -> bool:
        return bool(self.splits)

    @property
    def salts(self) -> int:
        return max(1, math.ceil(self.largest / max(self.limit, 1)))


def _kind(df: DataFrame, at: Column) -> str:
    return df.select(at.alias("_at")).schema[0].dataType.typeName()


def _common_start(df: DataFrame, at: Column) -> int:
    """Length of what the least and the greatest text have in common; all between share it."""
    ends = df.agg(F.min(at).alias("a"), F.max(at).alias("b")).first()
    return len(os.path.commonprefix([ends["a"] or "", ends["b"] or ""]))


def _order_number(df: DataFrame, at: Column, skip: int) -> Column:
    """A number that never falls as the column rises, to cut slices by.

    Texts give the first six bytes after the start that all of them share; values that are equal
    in these stay in one slice.
    """
    kind = _kind(df, at)
    if kind == "date":
        return F.unix_date(at).cast("double")
    if kind not in ("string", "binary"):
        return at.cast("double")
    head = F.substring(F.hex(F.encode(F.substring(at, skip + 1, 6), "utf-8")), 1, 12)
    return F.conv(F.rpad(head, 12, "0"), 16, 10).cast("double")


def _cut_points(df: DataFrame, at: Column, rows: int, limit: int, skip: int) -> tuple[float, ...]:
    """Cut points of the order column, so close that a slice holds about `limit` rows.

    One aggregate takes at most MAX_CHUNKS quantiles; where that is too few, a second one cuts every slice again. There are
    rows / limit points in all.
    """
    pieces = max(2, math.ceil(rows / limit))
    level = min(MAX_CHUNKS, pieces)
    number = _order_number(df, at, skip)
    quantiles = lambda n: F.percentile_approx("_cut_at", [i / n for i in range(1, n)], max(10_000, 20 * n)).alias("p")
    values = df.select(number.alias("_cut_at"))
    points = sorted(set(values.agg(quantiles(level)).first()["p"] or []))
    if pieces > level and points:
        inner = min(MAX_CHUNKS, math.ceil(pieces / level))
        cutter = Bucketizer(splits=[-math.inf, *points, math.inf], inputCol="_cut_at", outputCol="_slice", handleInvalid="keep")
        again = cutter.transform(values).groupBy("_slice").agg(quantiles(inner)).collect()  # rows / limit numbers
        points = sorted({*points, *(x for r in again for x in r["p"] or [])})
    return tuple(points)


def plan_layout(df: DataFrame, keys: Sequence[str], at: Column | None = None) -> Layout:
    """Count the groups of ``keys``; where some are hot, list them and cut ``at`` evenly.

    With no keys the whole table is one group.
    """
    limit = rows_per_task(df.sparkSession)
    if not keys:
        rows = df.count()
        if rows <= limit or at is None:
            return Layout(rows, rows, limit)
        skip = _common_start(df, at) if _kind(df, at) == "string" else 0
        return Layout(rows, rows, limit, None, _cut_points(df, at, rows, limit, skip), skip)
    layout = layout_of_sizes(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")), keys)
    if layout.hot is None or at is None:
        return layout
    inside = with_hot_flag(df, keys, layout.hot).filter("_hot")
    skip = _common_start(inside, at) if _kind(df, at) == "string" else 0
    return replace(layout, splits=_cut_points(inside, at, inside.count(), limit, skip), skip=skip)


def layout_of_sizes(sizes: DataFrame, keys: Sequence[str]) -> Layout:
    """Layout of groups whose numbers of rows are known as ``_n``, without cut points."""
    limit = rows_per_task(sizes.sparkSession)
    total = sizes.agg(F.sum("_n").alias("rows"), F.max("_n").alias("largest")).first()
    rows, largest = total["rows"] or 0, total["largest"] or 0
    threshold = max(limit, rows // MAX_HOT_GROUPS)
    if largest <= threshold:
        return Layout(rows, largest, limit)
    found = sizes.filter(F.col("_n") > threshold).select(*keys)  # at most rows / threshold keys
    return Layout(rows, largest, limit, sizes.sparkSession.createDataFrame([tuple(r) for r in found.collect()], found.schema))


def plan_layouts(df: DataFrame, key_sets: Mapping[str, Sequence[str]], at: Column | None = None) -> dict[str, Layout]:
    """Layouts of several groupings of one table from one pass over it.

    Every row counts once for each key set, by a hash of its key (two groups that share a hash
    only make the group seem larger). Sets without a hot group are done; the few others are
    planned by themselves. Sets with a missing column are left out.
    """
    limit = rows_per_task(df.sparkSession)
    known = {n: list(k) for n, k in key_sets.items() if all(c in df.columns for c in k)}
    if not known:
        return {}
    pairs = F.array(*[F.struct(F.lit(n).alias("set"), F.xxhash64(*k).alias("h")) for n, k in known.items()])
    sizes = df.select(F.inline(pairs)).groupBy("set", "h").agg(F.count(F.lit(1)).alias("n"))
    found = {r["set"]: r for r in sizes.groupBy("set").agg(F.sum("n").alias("rows"), F.max("n").alias("largest")).collect()}  # one row per set
    out = {}
    for name, keys in known.items():
        rows, largest = (found[name]["rows"], found[name]["largest"]) if name in found else (0, 0)
        hot = largest > max(limit, rows // MAX_HOT_GROUPS)
        out[name] = plan_layout(df, keys, at) if hot else Layout(rows, largest, limit)
    return out


def join_on_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Null-safe equi join that keeps the left key columns once."""
    renamed = right.select(
        *[F.col(k).alias(f"_r_{k}") if k in keys else F.col(k) for k in right.columns]
    )
    condition = None
    for name in keys:
        part = F.col(name).eqNullSafe(F.col(f"_r_{name}"))
        condition = part if condition is None else condition & part
    return left.join(renamed, condition, how).drop(*[f"_r_{k}" for k in keys])


def with_hot_flag(df: DataFrame, keys: Sequence[str], hot: DataFrame) -> DataFrame:
    """Adds ``_hot``; the hot list is bounded by MAX_HOT_GROUPS, hence the broadcast."""
    flagged = join_on_keys(df, F.broadcast(hot.withColumn("_hot", F.lit(True))), keys)
    return flagged.withColumn("_hot", F.coalesce("_hot", F.lit(False)))


def with_chunks(df: DataFrame, keys: Sequence[str], at: Column, layout: Layout) -> DataFrame:
    """Adds CHUNK: 0 for cold groups, 1.. for consecutive slices of ``at`` in hot groups."""
    if not layout.spread:
        return df.withColumn(CHUNK, F.lit(0))
    edges = [-math.inf, *layout.splits, math.inf]
    cutter = Bucketizer(splits=edges, inputCol="_cut_at", outputCol="_slice", handleInvalid="keep")
    sliced = cutter.transform(df.withColumn("_cut_at", _order_number(df, at, layout.skip)))
    slice_no = F.col("_slice").cast("int") + 1
    if keys:
        sliced = with_hot_flag(sliced, keys, layout.hot)
        slice_no = F.when(F.col("_hot"), slice_no).otherwise(0)
    return sliced.withColumn(CHUNK, slice_no).drop("_cut_at", "_slice", "_hot")


def _row_hash(df: DataFrame) -> Column:
    """Same row, same salt: a recomputed task sends its rows where the first run sent them."""
    return F.xxhash64(*[f.name for f in df.schema.fields if f.dataType.typeName() != "map"])


def attach_group_stats(
    df: DataFrame, keys: Sequence[str], stats: DataFrame, layout: Layout | None = None
) -> DataFrame:
    """Left join per-group values onto the rows; rows of hot groups are salted.

    Only the few hot groups are copied once per salt on the small side.
    """
    layout = layout or plan_layout(df, keys)
    if layout.hot is None:
        return join_on_keys(df, stats, keys)
    salts = layout.salts
    left = with_hot_flag(df, keys, layout.hot).withColumn(
        "_salt", F.when(F.col("_hot"), F.pmod(_row_hash(df), F.lit(salts)).cast("int")).otherwise(0)
    )
    right = with_hot_flag(stats, keys, layout.hot).withColumn(
        "_salt",
        F.explode(
            F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
        ),
    )
    return join_on_keys(left.drop("_hot"), right.drop("_hot"), [*keys, "_salt"]).drop("_salt")
