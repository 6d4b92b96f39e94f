"""Isolation trees: fitted in tasks, each on a bounded row sample, scored by all tasks.

The sample per tree is part of the method (a tree isolates points of a small sample), so a
tree never sees more than ``sample_rows`` rows whatever the table size. Scores are not equal
to another library's to the bit.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paysieve.operators.splits import smallest
from paysieve.plans.durable import durable, scratch_path

TREES = 200
SAMPLE_ROWS = 65_536
EULER = 0.5772156649015329
NODE = np.dtype([("feature", "<i2"), ("left", "<i4"), ("value", "<f8")])  # 14 bytes
NODE_SCHEMA = "tree int, nodes binary"
WHOLE_MB = 40  # a smaller forest is broadcast whole; of a larger one each task gets a part
PART_MB = 125  # of trees that a task holds (not quite twice as much unpacked): every row moves once for each part
PART_ROWS = 1_000_000  # that one task scores with its part


def _expected_path(n):
    n = np.asarray(n, dtype="float64")
    safe = np.maximum(n, 2.0)
    return np.where(n > 2, 2 * (np.log(safe - 1) + EULER) - 2 * (safe - 1) / safe, np.where(n == 2, 1.0, 0.0))


def _grow(rows: np.ndarray, seed: int) -> np.ndarray:
    """Nodes level by level, the two children of a node side by side; feature -1 marks a leaf, whose value is its path."""
    rng = np.random.default_rng(seed)
    limit = math.ceil(math.log2(max(len(rows), 2)))
    levels, start, depth = [], np.zeros(1, "int64"), 0
    done = 0  # nodes of the levels before this one
    while len(start):
        sizes = np.diff(np.append(start, len(rows)))
        nodes = np.zeros(len(start), NODE)
        nodes["feature"], nodes["value"] = -1, depth + _expected_path(sizes)
        levels.append(nodes)
        if depth == limit or not len(rows):
            break
        low, high = np.minimum.reduceat(rows, start), np.maximum.reduceat(rows, start)
        usable = (high > low) & np.isfinite(high - low)
        inner = usable.any(axis=1)
        at = np.flatnonzero(inner)
        feature = np.where(usable, rng.random(usable.shape), -1.0).argmax(axis=1)[at]
        least, most = low[at, feature], high[at, feature]
        cut = np.minimum(least + rng.random(len(at)) * (most - least), np.nextafter(most, least))  # neither side is empty
        done += len(start)
        nodes["feature"][at], nodes["value"][at], nodes["left"][at] = feature, cut, done + 2 * np.arange(len(at))
        rows = rows[np.repeat(inner, sizes)]
        of = np.repeat(np.arange(len(at)), sizes[at])
        child = 2 * of + (rows[np.arange(len(rows)), feature[of]] > cut[of])
        rows = rows[np.argsort(child, kind="stable")]
        start = np.append(0, np.cumsum(np.bincount(child, minlength=2 * len(at)))[:-1]) if len(at) else at
        depth += 1
    return np.concatenate(levels)


@dataclass(frozen=True)
class IsolationModel:
    nodes: DataFrame  # one row per tree, of 2 x sample_rows nodes of 14 bytes at most, in the shared folder
    features: tuple[str, ...]
    sample_size: int
    trees: int
    low: float | None = None
    high: float | None = None


def fit_isolation(
    df: DataFrame, features: Sequence[str], tie="event_id", trees: int = TREES, sample_rows: int = SAMPLE_ROWS, seed: int = 42,
) -> IsolationModel:
    """Each tree takes ``sample_rows`` rows at random, or all if there are fewer.

    Rows come from a pool of about trees x sample_rows. Trees are dealt to groups: with a small pool every group has all
    of it; with a larger one every tree is its own group, and each row goes to one tree of every ``width`` by hash, which
    leaves a tree more rows than it takes.
    """
    sample_rows = min(sample_rows, SAMPLE_ROWS)
    enough = sample_rows + 8 * math.isqrt(sample_rows) + 8  # dealt by hash, so a tree's share varies
    pool = smallest(
        df.select(tie, *features).withColumn("_order", F.xxhash64(F.lit(seed), F.col(tie))), "_order", tie, trees * enough
    ).drop("_order").persist()
    size = pool.count()
    width = min(max(1, size // enough), trees)
    groups = trees if width > 1 else min(trees, df.sparkSession.sparkContext.defaultParallelism)
    first = F.col("_c") * width
    spread = F.pmod(F.xxhash64(F.lit(seed + 1), F.col("_c"), F.col(tie)), F.least(F.lit(width), F.lit(groups) - first))
    dealt = pool.select(
        *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in features], tie,
        F.explode(F.sequence(F.lit(0), F.lit(math.ceil(groups / width) - 1))).alias("_c")
    ).withColumn("group", (first + spread).cast("int"))
    names = list(features)

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        group = int(pdf["group"].iloc[0])
        rows = pdf.sort_values(tie)[names].fillna(0.0).to_numpy("float64")
        out = []
        for tree in range(group, trees, groups):
            taken = rows if len(rows) <= sample_rows else rows[np.random.default_rng(seed + tree).permutation(len(rows))[:sample_rows]]
            out.append((tree, _grow(taken, seed * 1000 + tree).tobytes()))
        return pd.DataFrame(out, columns=["tree", "nodes"])

    path = scratch_path(df.sparkSession, "forest")
    dealt.groupBy("group").applyInPandas(grow, NODE_SCHEMA).write.parquet(path)
    nodes = df.sparkSession.read.schema(NODE_SCHEMA).parquet(path)
    grown = nodes.select("tree").distinct().count()
    pool.unpersist()
    return IsolationModel(nodes, tuple(names), min(sample_rows, size), grown)


def _unpacked(tree: bytes) -> tuple[np.ndarray, ...]:
    """(feature, left, cut, value) of every node; a leaf leads to itself."""
    nodes = np.frombuffer(tree, NODE)
    leaves = np.flatnonzero(nodes["feature"] < 0)
    feature, left, cut = nodes["feature"].astype("int32"), nodes["left"].astype("int32"), nodes["value"].copy()
    feature[leaves], left[leaves], cut[leaves] = 0, leaves, np.inf
    return feature, left, cut, np.ascontiguousarray(nodes["value"])


def _paths(trees: Sequence[tuple[np.ndarray, ...]], x: np.ndarray) -> np.ndarray:
    """Sum of the path lengths of all rows over some unpacked trees; all rows take a step together until none moves."""
    total = np.zeros(len(x))
    flat, first = np.ascontiguousarray(x).ravel(), np.arange(len(x)) * x.shape[1]
    for feature, left, cut, value in trees:
        at = np.zeros(len(x), dtype="int32")  # root first
        while True:
            after = left.take(at)
            after += flat.take(first + feature.take(at)) > cut.take(at)
            if np.array_equal(after, at):
                break
            at = after
        total += value.take(at)
    return total


def _score(total: np.ndarray, trees: int, sample_size: int) -> np.ndarray:
    scale = float(_expected_path(sample_size)) or 1.0
    return np.power(2.0, -(total / max(trees, 1)) / scale)


def _raw_scores(model: IsolationModel, df: DataFrame, name: str, whole_mb: float = WHOLE_MB, part_mb: float = PART_MB) -> DataFrame:
    most = 2 * max(model.sample_size, 1) * NODE.itemsize  # of one tree
    if model.trees * most > min(whole_mb, part_mb) * 1e6:
        return _scores_by_parts(model, df, name, max(1, int(part_mb * 1e6) // most))
    packed = [bytes(r["nodes"]) for r in model.nodes.select("nodes").toLocalIterator()]  # whole_mb at most
    shared = df.sparkSession.sparkContext.broadcast(packed)
    features = list(model.features)

    def score(batches):
        held = [_unpacked(t) for t in shared.value]
        for pdf in batches:
            x = pdf[features].astype("float64").fillna(0.0).to_numpy()
            yield pdf.assign(**{name: _score(_paths(held, x), trees, sample_size)})

    trees, sample_size = model.trees, model.sample_size
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.DoubleType())])
    return df.mapInPandas(score, schema)


def _scores_by_parts(model: IsolationModel, df: DataFrame, name: str, per_part: int, part_rows: int = PART_ROWS) -> DataFrame:
    """Scores where the forest is too large for one task: trees are dealt to parts, every task scores rows with its part.

    Rows are numbered once. They and the trees meet by (part, salt), the trees first, and the partial sums of a row's
    paths are added up; the forest never passes the driver.
    """
    spark, features = df.sparkSession, list(model.features)
    path = scratch_path(spark, "numbered")
    df.withColumn("_no", F.monotonically_increasing_id()).write.parquet(path)
    numbered = spark.read.schema(T.StructType([*df.schema.fields, T.StructField("_no", T.LongType())])).parquet(path)
    salts = max(1, -(-numbered.count() // part_rows))
    parts = -(-model.trees // per_part)
    x = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features])
    rows = numbered.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.pmod(F.xxhash64("_no"), F.lit(salts)).cast("int").alias("salt"),
                           F.col("_no").alias("no"), x.alias("x"), F.lit(None).cast("binary").alias("nodes"))
    trees = model.nodes.select("tree", "nodes").withColumn("part", F.floor(F.col("tree") / per_part).cast("int")).select(
        "part", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(None).cast("long").alias("no"), F.lit(None).cast("array<double>").alias("x"), "nodes")
    both = trees.unionByName(rows).repartition(parts * salts, "part", "salt").sortWithinPartitions("part", "salt", F.col("no").asc_nulls_first())

    def partial(batches):
        key, held = None, []
        for batch in batches:
            here = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            cuts = [i for i in range(len(here)) if not i or here[i] != here[i - 1]]
            for low, high in zip(cuts, [*cuts[1:], len(here)]):
                if here[low] != key:
                    key, held = here[low], []
                piece = batch.slice(low, high - low)
                known = piece.column(2).null_count  # trees come first
                held += [_unpacked(t.as_py()) for t in piece.column(4).slice(0, known)]
                rows = piece.slice(known)
                if rows.num_rows:
                    values = rows.column(3).flatten().to_numpy(zero_copy_only=False).reshape(rows.num_rows, -1)
                    yield pa.RecordBatch.from_arrays([rows.column(2), pa.array(_paths(held, values))], names=["no", "total"])

    sums = both.mapInArrow(partial, "no long, total double").groupBy("no").agg(F.sum("total").alias("_total"))
    scale = float(_expected_path(model.sample_size)) or 1.0
    scored = numbered.join(sums, F.col("_no") == F.col("no"))
    return scored.withColumn(name, F.pow(F.lit(2.0), -(F.col("_total") / max(model.trees, 1)) / scale)).select(*[f"`{c}`" for c in df.columns], name)


def rescale(df: DataFrame, raw: str, low: float | None = None, high: float | None = None, name="anomaly") -> DataFrame:
    """Clip to [0, 1] between the 1st and 99th percentile, of this batch unless given."""
    if low is None or high is None:
        cuts = df.agg(F.percentile(raw, F.array(F.lit(0.01), F.lit(0.99))).alias("p")).first()["p"]
        low, high = cuts
    if high <= low:
        return df.withColumn(name, F.lit(0.5))
    return df.withColumn(name, F.least(F.greatest((F.col(raw) - low) / (high - low), F.lit(0.0)), F.lit(1.0)))


def isolation_scores(model: IsolationModel, df: DataFrame, name="anomaly", by_batch: bool = False) -> DataFrame:
    """Scores in [0, 1]; the percentiles stored at fit time are used unless ``by_batch``."""
    raw = _raw_scores(model, df, "_raw")
    if by_batch or model.low is None:
        raw = durable(raw)
        out = rescale(raw, "_raw", name=name)
    else:
        out = rescale(raw, "_raw", model.low, model.high, name)
    return out.drop("_raw")


def with_percentiles(model: IsolationModel, df: DataFrame) -> IsolationModel:
    """The model with the 1st and 99th percentile of its scores on df."""
    low, high = _ends(_raw_scores(model, df, "_raw"))
    return replace(model, low=low, high=high)


def fitted_scores(model: IsolationModel, df: DataFrame, name="anomaly") -> tuple[IsolationModel, DataFrame]:
    """(the model with the percentiles of its scores on df, df with these scores): a row goes through the forest once."""
    raw = durable(_raw_scores(model, df, "_raw"))
    low, high = _ends(raw)
    return replace(model, low=low, high=high), rescale(raw, "_raw", low, high, name).drop("_raw")


def _ends(raw: DataFrame) -> tuple[float, float]:
    return raw.agg(F.percentile_approx("_raw", [0.01, 0.99], 100_000).alias("p")).first()["p"]
