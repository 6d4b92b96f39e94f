"""The nearest row of another table, exact, for all rows of both tables, without comparing all pairs.

The known points are dealt to boxes of about BOX_ROWS by a k-d tree. The tree is laid out on a sample, which decides only how
even the boxes are. A row first meets the points of its own box; the distance found is a bound, and the row goes on to
just those other boxes that begin nearer than that. A task holds one box and PART_ROWS rows, whatever the tables' sizes; a box
with many rows is met in parts.

The cost is linear in the rows times the boxes a row can't rule out: few where points are dense in a few dimensions, up to all
where the dimensions are many or the rows lie far from every point.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from paysieve.operators.trees import TreeTable, _matrix
from paysieve.plans.durable import stored

BOX_ROWS, PART_ROWS = 16_384, 16_384
SAMPLED = 100  # points that lay out a box
NEAR_ROWS = 256  # points of a box that a block of rows meets at a time


def halves(x: np.ndarray, most: int) -> tuple[TreeTable, list[np.ndarray]]:
    """A k-d tree that cuts the widest column near its middle until no group of different points has more than ``most``, and its groups.

    The value of a leaf is the number of its group; ``TreeTable.leaves`` finds the leaf of any point.
    """
    nodes, groups, todo = [], [], [(np.arange(len(x)), -1, 0)]
    while todo:
        rows, parent, side = todo.pop()
        at = len(nodes)
        nodes.append([-1, 0.0, -1, -1, -1.0])
        if parent >= 0:
            nodes[parent][side] = at
        width = np.ptp(x[rows], axis=0) if len(rows) > most else np.zeros(1)
        if not width.max() > 0:
            nodes[at][4] = float(len(groups))
            groups.append(rows)
            continue
        f = int(width.argmax())
        v = x[rows, f]
        cut = np.partition(v, (len(v) - 1) // 2)[(len(v) - 1) // 2]
        if cut == v.max():
            cut = v[v < cut].max()
        nodes[at][:2] = f, float(cut)
        todo += [(rows[v <= cut], at, 2), (rows[v > cut], at, 3)]
    feature, threshold, left, right, value = (np.array(c) for c in zip(*nodes))
    return TreeTable(np.zeros(1, int), np.ones(1), feature, threshold, left, right, value), groups


def group_of(tree: TreeTable, x: np.ndarray) -> np.ndarray:
    return tree.value[tree.leaves(x, 0)].astype(int)


def beyond(low: np.ndarray, high: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> np.ndarray:
    """Squared distances between ranges (first axis) and boxes (second axis); 0 where they overlap."""
    out = np.zeros((len(low), len(lows)))
    for j in range(low.shape[1]):
        gap = np.maximum(lows[:, j] - high[:, j:j + 1], low[:, j:j + 1] - highs[:, j])
        out += np.square(np.maximum(gap, 0.0, out=gap), out=gap)
    return out


def least_squares(x: np.ndarray, points: np.ndarray, block: int) -> np.ndarray:
    """Squared distance of every row to its nearest point, from the differences themselves; a block is small enough for a core's cache."""
    out, columns = np.empty(len(x)), np.ascontiguousarray(points.T)
    for i in range(0, len(x), block):
        part = x[i:i + block]
        total = np.zeros((len(part), len(points)))
        for j, column in enumerate(columns):
            gap = part[:, j:j + 1] - column
            total += np.multiply(gap, gap, out=gap)
        out[i:i + block] = total.min(axis=1)
    return out


def within(x: np.ndarray, points: np.ndarray, best: np.ndarray, block: int) -> list[np.ndarray]:
    """Lowers ``best``, squared distances, to those of the nearest points; returns groups of rows that lie near each other."""
    tree, groups = halves(points, NEAR_ROWS)
    held = [points[g] for g in groups]
    lows, highs = np.array([p.min(axis=0) for p in held]), np.array([p.max(axis=0) for p in held])
    own = group_of(tree, x)
    near = np.split(np.argsort(own, kind="stable"), np.cumsum(np.bincount(own, minlength=len(groups)))[:-1])
    for g, rows in enumerate(near):
        best[rows] = np.minimum(best[rows], least_squares(x[rows], held[g], block))
    met = [[] for _ in groups]
    for g, rows in enumerate(near):
        for r, other in _open(x, rows, best, lows, highs):
            if other != g:
                met[other].append(r)
    for g, parts in enumerate(met):
        if parts:
            rows = np.concatenate(parts)
            rows = rows[beyond(x[rows], x[rows], lows[g:g + 1], highs[g:g + 1])[:, 0] < best[rows]]  # bounds have fallen meanwhile
            best[rows] = np.minimum(best[rows], least_squares(x[rows], held[g], block))
    return near


def _open(x: np.ndarray, rows: np.ndarray, best: np.ndarray, lows: np.ndarray, highs: np.ndarray):
    """(rows, box) for the boxes that begin nearer than the rows' best; rows that lie near each other rule out most boxes together."""
    if not len(rows):
        return
    part = x[rows]
    some = np.flatnonzero(beyond(part.min(axis=0)[None], part.max(axis=0)[None], lows, highs)[0] < best[rows].max())
    there = beyond(part, part, lows[some], highs[some]) < best[rows][:, None]
    for i, box in enumerate(some):
        if there[:, i].any():
            yield rows[there[:, i]], box


def _met(rows: DataFrame, points: DataFrame, run, schema: str) -> DataFrame:
    """``run(rows, points)`` for every box and part of its rows, a task at a time."""
    parts = rows.groupBy("_box").agg(F.ceil(F.count(F.lit(1)) / PART_ROWS).cast("int").alias("_parts"))
    sizes = [tuple(r) for r in parts.collect()]  # one row per box
    tasks = max(1, sum(n for _, n in sizes))
    parts = F.broadcast(rows.sparkSession.createDataFrame(sizes, "_box int, _parts int"))
    a = rows.join(parts, "_box").withColumn("_part", F.pmod(F.xxhash64("_row"), "_parts").cast("int")).drop("_parts")
    b = points.join(parts, "_box").withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    a, b = (t.repartition(tasks, "_box", "_part").groupBy("_box", "_part") for t in (a, b))
    return a.cogroup(b).applyInArrow(run, schema)


def nearest_distance(known: DataFrame, rows: DataFrame, columns: Sequence[str], block: int = 64) -> DataFrame:
    """(_id, distance): for every row the distance to its nearest row of ``known``, infinite where that has none.

    Columns are finite numbers. Both tables may be of any size; see the module for how they meet.
    """
    names = list(columns)
    doubles = [F.col(c).cast("double").alias(c) for c in names]
    points = stored(known.select(*doubles).distinct(), "points")
    kind = rows.schema["_id"].dataType
    count = points.count()
    if not count:
        return rows.select("_id", F.lit(float("inf")).alias("distance"))
    sample = points.sample(SAMPLED / BOX_ROWS, seed=1) if count > BOX_ROWS else points.limit(1)
    tree, _ = halves(sample.toPandas().to_numpy("float64"), SAMPLED)  # SAMPLED rows per box
    dealt, shape = [f"`{c}` double" for c in names], [("_id", kind.simpleString()), ("_row", "long")]

    def boxed(df, carried):
        def run(batches):
            for batch in batches:
                box = group_of(tree, _matrix(batch, names)).astype("int32")
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(box)], names=[*batch.schema.names, "_box"])

        return df.mapInArrow(run, ", ".join([*[f"{n} {t}" for n, t in carried], *dealt, "_box int"]))

    points = stored(boxed(points, []), "points")
    ends = points.groupBy("_box").agg(*[f(c).alias(f"{n}_{c}") for c in names for n, f in (("low", F.min), ("high", F.max))]).orderBy("_box").collect()  # one row per box
    numbers = np.array([r["_box"] for r in ends])
    lows, highs = (np.array([[r[f"{n}_{c}"] for c in names] for r in ends]) for n in ("low", "high"))
    numbered = rows.select("_id", F.monotonically_increasing_id().alias("_row"), *doubles)
    numbered = stored(boxed(numbered, shape), "rows")
    id_type = to_arrow_type(kind)

    def first(rows: pa.Table, points: pa.Table) -> pa.Table:
        x, own = _matrix(rows, names), rows.column("_box")[0].as_py() if rows.num_rows else -1
        best = np.full(len(x), np.inf)
        others = [[] for _ in range(len(x))]
        if len(x):
            for near in within(x, _matrix(points, names), best, block):
                for some, box in _open(x, near, best, lows, highs):
                    if numbers[box] != own:
                        for r in some:
                            others[r].append(int(numbers[box]))
        return pa.table([rows.column("_id").cast(id_type), rows.column("_row"), *[rows.column(c) for c in names], pa.array(best), pa.array(others, pa.list_(pa.int32()))],
                        names=["_id", "_row", *names, "_best", "_others"])

    def again(rows: pa.Table, points: pa.Table) -> pa.Table:
        best = rows.column("_best").to_numpy().copy()
        if len(best):
            within(_matrix(rows, names), _matrix(points, names), best, block)
        return pa.table([rows.column("_id").cast(id_type), rows.column("_row"), pa.array(best)], names=["_id", "_row", "_best"])

    kept = ", ".join(f"{n} {t}" for n, t in shape)
    met = stored(_met(numbered, points, first, ", ".join([kept, *dealt, "_best double, _others array<int>"])), "met")
    more = met.select("_id", "_row", *names, "_best", F.explode("_others").alias("_box"))
    nearer = _met(more, points, again, f"{kept}, _best double").groupBy("_row").agg(F.first("_id").alias("_id"), F.min("_best").alias("_best"))
    out = met.filter(F.size("_others") == 0).select("_id", "_best").unionByName(nearer.select("_id", "_best"))
    return out.select("_id", F.sqrt("_best").alias("distance"))
