"""Boosted trees as node tables: margins after every round, the round to keep, and contributions along the paths.

A fitted ensemble is written to the shared folder and read back as a table with one row per node. It is bounded by the
parameters (rounds * 2 ** (depth + 1) nodes), so it travels to the tasks with the function that scores; rows are scored
batch by batch, all rows of a batch going down one tree together.

The trainer cuts a feature into at most 32 bins, so rows in equal bins are equal to it. Large tables are cut and counted
here first: a round then costs what the different rows cost, however many copies of each there are.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paysieve.operators import metrics as M
from paysieve.plans.durable import scratch_path

BINS = 32  # of the trainer
CUT_ACCURACY = 10_000


@dataclass(frozen=True)
class TreeTable:
    """Nodes of all trees one after another; feature -1 marks a leaf, children are places in the whole table."""

    roots: np.ndarray
    weights: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    @property
    def rounds(self) -> int:
        return len(self.roots)

    def first(self, rounds: int) -> TreeTable:
        """The ensemble as it was after that many rounds."""
        end = self.roots[rounds] if rounds < self.rounds else len(self.feature)
        nodes = (x[:end] for x in (self.feature, self.threshold, self.left, self.right, self.value))
        return TreeTable(self.roots[:rounds], self.weights[:rounds], *nodes)

    def steps(self, x: np.ndarray, tree: int):
        """(rows, nodes before, nodes after) while the rows go down one tree."""
        at = np.full(len(x), self.roots[tree])
        live = np.flatnonzero(self.feature[at] >= 0)
        while len(live):
            here = at[live]
            goes_left = x[live, self.feature[here]] <= self.threshold[here]
            after = np.where(goes_left, self.left[here], self.right[here])
            yield live, here, after
            at[live] = after
            live = live[self.feature[after] >= 0]

    def leaves(self, x: np.ndarray, tree: int) -> np.ndarray:
        at = np.full(len(x), self.roots[tree])
        for rows, _, after in self.steps(x, tree):
            at[rows] = after
        return at

    def staged(self, x: np.ndarray) -> np.ndarray:
        """Margin of every row (first axis) after every round (second axis)."""
        out = np.empty((len(x), self.rounds))
        total = np.zeros(len(x))
        for t in range(self.rounds):
            total = total + self.weights[t] * self.value[self.leaves(x, t)]
            out[:, t] = total
        return out

    def margins(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for t in range(self.rounds):
            total += self.weights[t] * self.value[self.leaves(x, t)]
        return total

    def base(self) -> float:
        """Margin of a row that has not gone down any tree yet."""
        return float((self.weights * self.value[self.roots]).sum())

    def contributions(self, x: np.ndarray) -> np.ndarray:
        """What each feature's splits add to the margin on a row's paths; with the base they sum to the margin."""
        out = np.zeros(x.shape)
        for t in range(self.rounds):
            for rows, before, after in self.steps(x, t):
                np.add.at(out, (rows, self.feature[before]), self.weights[t] * (self.value[after] - self.value[before]))
        return out


def tree_table(model: GBTClassificationModel, spark) -> TreeTable:
    """The node table of a fitted ensemble over numeric features."""
    path = scratch_path(spark, "trees")
    model.write().save(path)
    node, split = F.col("nodeData"), F.col("nodeData.split")
    rows = spark.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"), node["id"].alias("id"), split["featureIndex"].alias("feature"),
        F.element_at(F.when(F.size(split["leftCategoriesOrThreshold"]) > 0, split["leftCategoriesOrThreshold"]), 1).alias("threshold"),
        node["leftChild"].alias("left"), node["rightChild"].alias("right"), node["prediction"].alias("value"),
    ).orderBy("tree", "id").toPandas()  # rounds * 2 ** (depth + 1) rows at most
    tree = rows["tree"].to_numpy()
    roots = np.flatnonzero(np.insert(tree[1:] != tree[:-1], 0, True))
    shift = roots[tree]
    return TreeTable(roots, np.array(model.treeWeights, "float64"), rows["feature"].to_numpy(), rows["threshold"].fillna(0.0).to_numpy("float64"),
                     rows["left"].to_numpy() + shift, rows["right"].to_numpy() + shift, rows["value"].to_numpy("float64"))


def number(column: str) -> Column:
    """A feature as a finite double; null, NaN and infinite values count as 0."""
    x = F.col(column).cast("double")
    return F.when(F.abs(x) < float("inf"), x).otherwise(0.0)


def cut_points(df: DataFrame, features: Sequence[str]) -> list[np.ndarray]:
    """At most BINS - 1 rising cuts of each feature, from all rows: half way between the values where there are no more than BINS, else quantiles."""
    at = [i / BINS for i in range(1, BINS)]
    found = df.agg(*[F.percentile_approx(f, at, CUT_ACCURACY).alias(f"q_{i}") for i, f in enumerate(features)],
                   *[F.approx_count_distinct(f).alias(f"n_{i}") for i, f in enumerate(features)]).first()
    few = [i for i in range(len(features)) if found[f"n_{i}"] <= 2 * BINS]  # an estimate, so some to spare
    values = df.agg(*[F.collect_set(features[i]).alias(f"v_{i}") for i in few]).first() if few else {}
    cuts = []
    for i in range(len(features)):
        known = np.unique(values[f"v_{i}"]) if i in few else None
        cuts.append(np.unique(found[f"q_{i}"] or []) if known is None or len(known) > BINS else (known[1:] + known[:-1]) / 2)
    return cuts


def counted(df: DataFrame, features: Sequence[str], cuts: Sequence[np.ndarray], label: str) -> DataFrame:
    """(label, a bin number for each feature, how many rows): one row for all rows of equal bins and label."""
    own = [f"_x_{i}" for i in range(len(features))]
    plain = df.select(label, *[number(f).alias(x) for f, x in zip(features, own)])

    def run(batches):
        for batch in batches:
            codes = [pa.array(np.searchsorted(c, x).astype("int8")) for c, x in zip(cuts, _matrix(batch, own).T)]  # cuts below the value
            yield pa.RecordBatch.from_arrays([batch.column(0), *codes], names=batch.schema.names)

    coded = plain.mapInArrow(run, ", ".join([f"`{label}` {df.schema[label].dataType.simpleString()}", *[f"{x} tinyint" for x in own]]))
    return coded.groupBy(label, *own).agg(F.count(F.lit(1)).alias("_rows")).withColumnsRenamed(dict(zip(own, features)))


def with_cuts(table: TreeTable, cuts: Sequence[np.ndarray]) -> TreeTable:
    """A table over bin numbers as one over the features' values."""
    inner = np.flatnonzero(table.feature >= 0)
    threshold = table.threshold.copy()
    threshold[inner] = [cuts[f][int(t)] for f, t in zip(table.feature[inner], table.threshold[inner])]
    return replace(table, threshold=threshold)


def _matrix(batch: pa.RecordBatch, features: Sequence[str]) -> np.ndarray:
    """Feature columns as doubles."""
    columns = [batch.column(batch.schema.get_field_index(f)).cast(pa.float64()).to_numpy(zero_copy_only=False) for f in features]
    return np.stack(columns, axis=1) if batch.num_rows else np.zeros((0, len(columns)))


def _with_columns(df: DataFrame, features: Sequence[str], made: str, columns) -> DataFrame:
    """df with more columns: `columns` gives their arrays for a feature matrix, `made` their names and types."""
    names = [part.split()[0] for part in made.split(", ")]
    plain = df.select("*", *[number(f).alias(f"_x_{i}") for i, f in enumerate(features)])
    own = [f"_x_{i}" for i in range(len(features))]
    width = len(df.columns)

    def run(batches):
        for batch in batches:
            arrays = columns(_matrix(batch, own))
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], *arrays], names=[*batch.schema.names[:width], *names])

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields], made])
    return plain.mapInArrow(run, schema)


def with_margin(df: DataFrame, table: TreeTable, features: Sequence[str], name: str) -> DataFrame:
    return _with_columns(df, features, f"{name} double", lambda x: [pa.array(table.margins(x))])


def with_staged_margins(df: DataFrame, table: TreeTable, features: Sequence[str], name: str, start: int = 0) -> DataFrame:
    """One array per row: margins after the rounds from `start` on, from one pass over the rows."""
    def columns(x):
        values = np.ascontiguousarray(table.staged(x)[:, start:])
        ends = np.arange(len(x) + 1, dtype=np.int32) * values.shape[1]
        return [pa.ListArray.from_arrays(pa.array(ends), pa.array(values.ravel()))]

    return _with_columns(df, features, f"{name} array<double>", columns)


def with_contributions(df: DataFrame, table: TreeTable, features: Sequence[str], names: Sequence[str], margin: str) -> DataFrame:
    """One column per feature, and the margin; contributions and the table's base sum to it."""
    made = ", ".join([*[f"{n} double" for n in names], f"{margin} double"])
    return _with_columns(df, features, made, lambda x: [*[pa.array(c) for c in table.contributions(x).T], pa.array(table.margins(x))])


def round_quality(validation: DataFrame, table: TreeTable, features: Sequence[str], label: str, start: int = 0, rows: str | None = None) -> DataFrame:
    """(round, average_precision) for every round after `start`, all ranked by one grouped aggregate; `rows` may say how many rows a row stands for."""
    kept = [F.col(label).cast("int").alias("_y"), *[F.col(rows).alias("_rows") for _ in [rows] if rows]]
    staged = with_staged_margins(validation.select(*kept, *[f for f in features if f != label]), table, features, "_m", start)
    count = ["_rows"] if rows else []
    exploded = staged.select("_y", *count, F.posexplode("_m").alias("_at", "_s")).select("_y", *count, "_s", (F.col("_at") + start + 1).alias("round"))
    return M.average_precision(exploded, "_y", "_s", ["round"], *count)
