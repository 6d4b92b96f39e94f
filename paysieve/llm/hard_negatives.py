"""Hard negatives by slots: for every anchor and each of its positives, the best-scoring rows of other labels in a window
of scores that ends at the positive's.

A score is the integer inner product of two vectors whose components are floor(256 * x). Anchors are a stated share of the
rows and are compared with all of them, block by block: rows and anchors are written as packed blocks, every pair of blocks
is one matrix product, and what leaves a task is bounded by its anchors. Spark picks how the blocks meet by their measured
size (a broadcast if the anchors are small, a product of partitions if not).

1. Positives: the best `positives` rows of the anchor's label, by top-k combiners in the tasks and a ranked window after.
2. Slots: the scores of an anchor's positives p1 >= p2 >= ... are the upper limits of its windows and cut the scores into
   disjoint slots, (p2, p1], (p3, p2], ..., the last of them open below down to the least lower limit. Every score falls into
   one slot at most, and a task keeps the best `negatives` rows of each slot.
3. Suffix merge: the window of p_i begins in slot i and goes on downwards, so its best rows are those of slot i followed by
   those of the window of p_(i+1). One descending list for each anchor, of at most positives * negatives rows, answers all its
   windows; then rows under a window's lower limit go. Overlapping windows never scan a row twice.

A pair of blocks keeps only scores that reach the worst of the best held so far, and a task passes on what it holds when
that grows, so memory is bounded however many rows tie. Nothing is collected.

Rows with a null label or vector, or a null, NaN or infinite component, take no part. Vectors of other lengths are compared in
the components that both have. Scores are exact while they fit in 64 bits. Ties go to the smaller id; a row without an id is
no anchor and comes last. Rows that share an id are rows of their own, but not positives of one another; each of them that
is an anchor gets its own result. Equal vectors are rows like any others. Only id, label and vector are read, by position, so extra columns cannot clash;
an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paysieve.plans.durable import scratch_path

POSITIVES, NEGATIVES = 5, 5
LOW = (80, 100)  # a window reaches down to this share of the positive's score
SCALE = 256
ROW_BLOCK, ANCHOR_BLOCK = 1_024, 512
HELD_ROWS = 500_000  # of partial results, before a task passes them on
EXACT = float(1 << 53)


def _usable(rows: DataFrame, key: str, label: str, vector: str, anchor: Column) -> DataFrame:
    """(id, label, vector, anchor) of the rows that take part, components scaled and floored."""
    x = F.col(vector).cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    scaled = F.transform(x, lambda v: F.floor(v * SCALE).cast("double"))
    return (rows.select(F.col(key).alias("id"), F.col(label).cast("long").alias("label"), scaled.alias("vector"), F.coalesce(anchor, F.lit(False)).alias("anchor"), finite.alias("finite"))
            .filter("label IS NOT NULL AND vector IS NOT NULL AND finite").drop("finite"))


def _packer(size: int, extra: tuple[str, ...]):
    """Packs rows (id, label, vector, ...) into blocks of at most `size`, the vectors as one matrix of doubles."""

    def run(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, size):
                part = batch.slice(low, size)
                lists = part.column(2)
                lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
                wide = int(lengths.max(initial=0))
                matrix = np.zeros((part.num_rows, wide))
                matrix[np.repeat(np.arange(len(lengths)), lengths), np.concatenate([np.arange(n) for n in lengths])] = lists.flatten().to_numpy() if wide else 0
                ends = pa.array([0, part.num_rows], pa.int32())
                columns = [pa.ListArray.from_arrays(ends, part.column(i)) for i in (0, 1, *range(3, 3 + len(extra)))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([wide], pa.int32()), pa.array([matrix.tobytes()], pa.binary())],
                                                 names=["ids", "labels", *extra, "wide", "matrix"])

    return run


def _blocks(rows: DataFrame, size: int, extra: dict[str, str] | None = None) -> DataFrame:
    """Packed blocks of rows (id, label, vector, extra columns), written to the shared folder."""
    spark, extra = rows.sparkSession, extra or {}
    kind = rows.schema["id"].dataType.simpleString()
    shape = f"ids array<{kind}>, labels array<long>, " + "".join(f"{n} array<{t}>, " for n, t in extra.items()) + "wide int, matrix binary"
    path = scratch_path(spark, "blocks")
    rows.select("id", "label", "vector", *extra).mapInArrow(_packer(size, tuple(extra)), shape).write.parquet(path)
    return spark.read.schema(shape).parquet(path)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of all rows of a with all of b, as 64-bit integers."""
    wide = min(a.shape[1], b.shape[1])
    a, b = a[:, :wide], b[:, :wide]
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    if np.abs(a).max() * np.abs(b).max() * wide < EXACT:
        return (a @ b.T).astype(np.int64)
    whole = a.astype(np.int64).astype(object) @ b.astype(np.int64).astype(object).T
    return np.clip(whole, -(1 << 63), (1 << 63) - 1).astype(np.int64)


def best(rows: pa.Table, k: int) -> pa.Table:
    """The first k rows of every (no, slot), the highest score first and the smaller id among equals."""
    order = pc.sort_indices(rows, sort_keys=[("no", "ascending"), ("slot", "ascending"), ("score", "descending"), ("id", "ascending")])
    rows = rows.take(order)
    no, slot = rows["no"].to_numpy(), rows["slot"].to_numpy()
    if not len(no):
        return rows
    new = np.insert((no[1:] != no[:-1]) | (slot[1:] != slot[:-1]), 0, True)
    turn = np.arange(len(no)) - np.flatnonzero(new)[np.cumsum(new) - 1]
    return rows.filter(pa.array(turn < k))


def _scan(slots: int, k: int, low: tuple[int, int]):
    """Rows (ids, labels, wide, matrix, anchor block) -> (no, slot, score, id): the best of each anchor and slot in this task.

    With slots = 0 anchors have no limits, and rows of their own label are kept, in slot 0.
    """

    def unpacked(batch, i, names):
        out = {}
        for n in names:
            out[n] = batch.column(batch.schema.get_field_index(n))[i]
        return out

    def run(batches):
        held, cuts, total = {}, {}, 0
        for batch in batches:
            kind = batch.schema.field("ids").type.value_type
            for i in range(batch.num_rows):
                row = unpacked(batch, i, batch.schema.names)
                ids, labels = row["ids"].values, np.array(row["labels"].values, np.int64)
                a_ids, a_labels, no = row["a_ids"].values, np.array(row["a_labels"].values, np.int64), np.array(row["a_no"].values, np.int64)
                x = np.frombuffer(row["matrix"].as_buffer(), np.float64).reshape(len(labels), -1) if row["wide"].as_py() else np.zeros((len(labels), 0))
                y = np.frombuffer(row["a_matrix"].as_buffer(), np.float64).reshape(len(no), -1) if row["a_wide"].as_py() else np.zeros((len(no), 0))
                score = products(y, x)
                cut = cuts.setdefault(int(no[0]), np.full((len(no), max(slots, 1)), -(1 << 63), np.int64))
                if slots:
                    limits = np.array(row["a_limits"].values.to_pylist(), np.int64).reshape(len(no), slots)
                    floor = np.array(row["a_floor"].values, np.int64)
                    slot = (score[:, :, None] <= limits[:, None, :]).sum(axis=2) - 1
                    ok = (slot >= 0) & (low[1] * score >= floor[:, None]) & (a_labels[:, None] != labels[None, :])
                    a, r = np.nonzero(ok)
                    s = slot[a, r]
                else:
                    a, r = np.nonzero(a_labels[:, None] == labels[None, :])
                    s = np.zeros(len(a), np.int64)
                reach = score[a, r] >= cut[a, s]
                a, r, s = a[reach], r[reach], s[reach]
                if not slots and len(a):
                    other = pc.fill_null(pc.not_equal(ids.take(pa.array(r)), a_ids.take(pa.array(a))), True).to_numpy(zero_copy_only=False)
                    a, r, s = a[other], r[other], s[other]
                if not len(a):
                    continue
                found = pa.table({"no": no[a], "slot": s.astype(np.int32), "score": score[a, r], "id": ids.take(pa.array(r)).cast(kind)})
                before = held.get(int(no[0]))
                kept = best(found if before is None else pa.concat_tables([before, found]), k)
                total += kept.num_rows - (before.num_rows if before is not None else 0)
                held[int(no[0])] = kept
                at, where = kept["no"].to_numpy(), kept["slot"].to_numpy()
                last = np.flatnonzero((at[k - 1:] == at[: len(at) - k + 1]) & (where[k - 1:] == where[: len(at) - k + 1])) + k - 1 if len(at) >= k else np.zeros(0, np.int64)
                rank = {int(n): j for j, n in enumerate(no)}
                cut[[rank[int(n)] for n in at[last]], where[last]] = kept["score"].to_numpy()[last]
                if total > HELD_ROWS:
                    for table in held.values():
                        yield from table.to_batches()
                    held, cuts, total = {}, {}, 0
        for table in held.values():
            yield from table.to_batches()

    return run


def _met(blocks: DataFrame, anchors: DataFrame, slots: int, k: int, low: tuple[int, int]) -> DataFrame:
    """The best k rows of every anchor and slot: (no, slot, score, id), with their place among them."""
    kind = blocks.schema["ids"].dataType.elementType.simpleString()
    against = anchors.select(*[F.col(c).alias(f"a_{c}") for c in anchors.columns])
    found = blocks.crossJoin(against).mapInArrow(_scan(slots, k, low), f"no long, slot int, score long, id {kind}")  # a row is a pair of blocks
    place = Window.partitionBy("no", "slot").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    return found.withColumn("place", F.row_number().over(place)).filter(F.col("place") <= k)


def mine(rows: DataFrame, anchor: Column, key: str = "vec_id", label: str = "label", vector: str = "embedding", positives: int = POSITIVES,
         negatives: int = NEGATIVES, low: tuple[int, int] = LOW) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of every anchor and positive.

    `anchor` is a condition over the input's columns. A window holds the scores with
    low[0] * positive_score <= low[1] * score <= low[1] * positive_score.
    """
    spark = rows.sparkSession
    usable = _usable(rows, key, label, vector, anchor)
    blocks = _blocks(usable, ROW_BLOCK)
    path = scratch_path(spark, "anchors")
    usable.filter("anchor AND id IS NOT NULL").select("id", "label", "vector", F.monotonically_increasing_id().alias("no")).write.parquet(path)
    anchors = spark.read.parquet(path)
    dealt = max(1, -(-anchors.count() // ANCHOR_BLOCK))

    path = scratch_path(spark, "positives")
    found = _met(blocks, _blocks(anchors.repartition(dealt), ANCHOR_BLOCK, {"no": "bigint"}), 0, positives, low)
    found.select("no", "place", "score", "id").write.parquet(path)
    ranked = spark.read.schema(found.select("no", "place", "score", "id").schema).parquet(path)
    lists = ranked.groupBy("no").agg(F.sort_array(F.collect_list(F.struct("place", "score", "id"))).alias("p"))  # at most `positives` entries

    # slots end at the positives' scores; anchors with fewer positives repeat the last limit, which leaves empty slots
    limits = F.transform(F.sequence(F.lit(1), F.lit(positives)), lambda i: F.element_at("p", F.least(i, F.size("p")))["score"])
    floor = F.array_min(F.transform(F.filter("p", lambda p: p["score"] >= 0), lambda p: p["score"])) * low[0]
    limited = anchors.join(lists, "no").select("id", "label", "vector", "no", limits.alias("limits"), floor.alias("floor")).filter("floor IS NOT NULL")
    slotted = _met(blocks, _blocks(limited.repartition(dealt), ANCHOR_BLOCK, {"no": "bigint", "limits": "array<bigint>", "floor": "bigint"}), positives, negatives, low)

    # slots follow one another downwards, so one list sorted by slot and place is all windows' descending order
    merged = slotted.groupBy("no").agg(F.sort_array(F.collect_list(F.struct("slot", "place", "score", "id"))).alias("n"))  # at most positives * negatives entries
    windows = anchors.select("no", F.col("id").alias("anchor_id")).join(lists, "no").join(merged, "no")
    each = windows.select("anchor_id", "n", F.explode("p").alias("p"))
    begins = F.filter("n", lambda n: n["score"] <= F.col("p")["score"])
    inside = F.filter(F.slice(begins, 1, negatives), lambda n: low[1] * n["score"] >= low[0] * F.col("p")["score"])
    out = each.select("anchor_id", F.col("p")["id"].alias("positive_id"), F.col("p")["score"].alias("positive_score"), F.posexplode(inside).alias("at", "n"))
    return out.select("anchor_id", "positive_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("n")["id"].alias("negative_id"), "positive_score",
                      F.col("n")["score"].alias("negative_score"))
