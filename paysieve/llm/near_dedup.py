"""Near-duplicates by BagMinHash signatures, banding, and exact overlap of word-shingle multisets.

A document is the multiset of its five-word shingles (a shorter one, of its words together). Each shingle owns Poisson
processes over the weight axis, one for [0, 1) and one for each [2**(j-1), 2**j): the count of a shingle opens those
processes that begin below it, and points beyond the count itself are thinned away by their place. Points come in order of
time, each falls to one of SIZE components, and a component's value is the time of its first point; two documents agree in
a component with the probability of their weighted Jaccard similarity, without bias. Processes are followed only as far as
components are still open, so a document costs about SIZE * ln(SIZE) points however large its counts are.

Signatures are cut into BANDS bands (a pair of similarity 0.8 misses all of them with a probability under 4e-6). Links:

1. Equal multisets are one node, represented by the row of least id.
2. In every band key all nodes are compared, exactly, with the one among them that shares most keys with others (the
   centre of a group of copies); links join components.
3. Keys that still hold several components are searched for the remaining links across them, key by key inside tasks. A
   pair is left out if no link is possible: its sizes differ too much, or its distances to the common node do (1 -
   similarity is a metric). It is also left out if fewer than AGREE components of its signatures agree, which happens to a
   pair of similarity 0.8 with a probability under 2e-5. The others are compared exactly, the likeliest first, each in the
   first of their common keys, until their components are joined. Only links leave the task.

No pair inside a component is needed for the classes, so a group of copies costs one comparison for each member and key.
Keys with more than BLOCK nodes are searched in blocks of that size, each pair of blocks by a task of its own.
Comparison is dealt by (common node, salt), with the salts of a node in proportion to its partners. Nothing is collected.

Null and empty texts have no shingle and are alone in their class; so are rows without an id. Rows that share an id are one
document and in one class, with the copies and near copies of each of their texts, as every text is a node of its own.
Only id and text are read.
"""

from __future__ import annotations

import gc

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paysieve.llm import buffers as B
from paysieve.operators.graph import connected_components
from paysieve.plans.durable import durable, scratch_path

SHINGLE = 5
SIMILAR = 0.8
BANDS, ROWS = 24, 4
SIZE = BANDS * ROWS
LOW_BITS = 12  # of a shingle's hash, left out to make room for the row while sorting
AGREE = 60  # of SIZE components
BLOCK = 2_000  # nodes of one key that a task searches, twice that with another block
PARTNERS = 500  # pairs that one task compares with the same node in a row


class Shingler:
    def __init__(self, k: int = SHINGLE):
        self.k, self.hash = k, B.SpanHash(31)

    def multisets(self, array: pa.Array):
        """Row, shingle hash and count, sorted by row and hash."""
        data, offsets = B.utf8(array)
        starts, ends = B.runs(B.NOT_WHITE[data], offsets)
        at = np.searchsorted(starts, offsets)
        words, n = self.hash.of_bytes(data, starts, ends), np.diff(at)
        size = np.where(n >= self.k, n - self.k + 1, 0)
        row = np.repeat(np.arange(len(n)), size)
        gram = B.gram_hash(words, self.k)[B.ragged(at[:-1], size)] if len(row) else np.zeros(0, np.uint64)
        few = np.flatnonzero((n > 0) & (n < self.k))
        row = np.concatenate([row, few])
        gram = np.concatenate([gram, self.hash.of(words, at[few], at[few + 1])])
        gram >>= np.uint64(LOW_BITS)
        if len(n) <= 1 << LOW_BITS:  # row and hash in one word, for one plain sort
            packed = np.sort((row.astype(np.uint64) << np.uint64(64 - LOW_BITS)) | gram)
            row, gram = (packed >> np.uint64(64 - LOW_BITS)).astype(np.int64), packed & np.uint64((1 << 64 - LOW_BITS) - 1)
        else:
            order = np.lexsort((gram, row))
            row, gram = row[order], gram[order]
        first = np.flatnonzero(np.insert((row[1:] != row[:-1]) | (gram[1:] != gram[:-1]), 0, True)) if len(row) else np.zeros(0, np.int64)
        return row[first], gram[first], np.diff(np.append(first, len(row)))


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)


def signatures(row: np.ndarray, gram: np.ndarray, count: np.ndarray, rows: int, size: int = SIZE) -> np.ndarray:
    """Times of the first points by row and component; infinite for rows without a shingle."""
    out = np.full(rows * size, np.inf)
    if not len(row):
        return out.reshape(rows, size)
    levels = 1 + np.ceil(np.log2(np.maximum(count, 1))).astype(np.int64)  # processes that begin below the count
    which = np.repeat(np.arange(len(row)), levels)
    level = B.ragged(np.zeros(len(row), np.int64), levels)
    low = np.where(level > 0, 1 << np.maximum(level - 1, 0), 0)
    width = np.where(level > 0, low, 1)
    seed = B.mix(gram[which] + B.mix(level.astype(np.uint64) + np.uint64(91)))
    weight = np.maximum(np.bincount(row, weights=count, minlength=rows), 1)
    horizon = (np.log(size) + 0.5) / weight
    # open processes: seed, row, next time, mean gap, begin and width, count
    state = [seed, row[which], -np.log(_uniform(B.mix(seed))) / (width * size), 1 / (width * size), low, width, count[which]]
    draws = seed.copy()
    filled = np.bincount(row, minlength=rows) == 0
    while True:
        early = state[2] < horizon[state[1]]
        later, late_draws = [[x[~early] for x in state]], [draws[~early]]
        now, draw = [x[early] for x in state], draws[early]
        while len(draw):
            seeds, owner, time, gap, begin, wide, limit = now
            draw = B.mix(draw + seeds)
            stays = (wide == 1) | (begin + (_uniform(B.mix(draw)) * wide).astype(np.int64) < limit) if (wide > 1).any() else slice(None)
            np.minimum.at(out, (owner * size + (draw >> np.uint64(40)).astype(np.int64) % size)[stays], time[stays])
            time = time - np.log(_uniform(draw * np.uint64(0xD1342543DE82EF95))) * gap
            now = [seeds, owner, time, gap, begin, wide, limit]
            early = time < horizon[owner]
            later.append([x[~early] for x in now])
            late_draws.append(draw[~early])
            now, draw = [x[early] for x in now], draw[early]
        filled |= np.isfinite(out.reshape(rows, size)).all(axis=1)
        if filled.all():
            return out.reshape(rows, size)
        horizon[~filled] += 0.7 / weight[~filled]
        draws, state = np.concatenate(late_draws), [np.concatenate(x) for x in zip(*later)]
        live = ~filled[state[1]]
        draws, state = draws[live], [x[live] for x in state]


def _sign(batches):
    shingler = Shingler()
    for batch in B.slices(batches):
        row, gram, count = shingler.multisets(batch.column(2))
        rows = batch.num_rows
        values = signatures(row, gram, count, rows)
        bits = values.view(np.uint64).reshape(rows, BANDS, ROWS)
        keys = np.tile(np.arange(BANDS, dtype=np.uint64) + np.uint64(1), (rows, 1))
        for r in range(ROWS):
            keys = B.mix(keys * np.uint64(0x9E3779B97F4A7C15) + bits[:, :, r])
        sketch = (B.mix(values.view(np.uint64)) & np.uint64(255)).astype(np.uint8)
        total = np.bincount(row, weights=count, minlength=rows).astype(np.int64)
        weighed = [B.mix(gram + B.mix(count.astype(np.uint64) + np.uint64(s))) for s in (1, 2)]
        marks = [np.zeros(rows, np.uint64), np.zeros(rows, np.uint64)]
        for mark, w in zip(marks, weighed):
            np.add.at(mark, row, w)
        there = np.bincount(row, minlength=rows) > 0
        chosen = np.flatnonzero(there)
        flat = pa.array(B.signed(keys[chosen].ravel()))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(chosen) + 1, dtype=np.int32) * BANDS), flat)
        yield pa.RecordBatch.from_arrays([*(c.take(pa.array(chosen)) for c in batch.columns[:2]), pa.array(B.signed(marks[0][chosen])), pa.array(B.signed(marks[1][chosen])), lists,
                                          pa.array(total[chosen]), pa.array([x.tobytes() for x in sketch[chosen]], pa.binary())],
                                         names=["id", "th", "f1", "f2", "bands", "total", "sketch"])


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two multisets given as sorted hashes and counts."""
    (x, n), (y, m) = a, b
    if not len(x) or not len(y):
        return 0.0
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    common = np.minimum(n, m[at])[y[at] == x].sum()
    return common / (n.sum() + m.sum() - common)


def _compare(batches):
    """Rows (node, salt, other, text) sorted so that the text of the node, without another, precedes its partners'."""
    shingler, node, kept = Shingler(), None, None
    for batch in B.slices(batches):
        row, gram, count = shingler.multisets(batch.column(3))
        at = np.searchsorted(row, np.arange(batch.num_rows + 1))
        nodes, others = batch.column(0).to_pylist(), batch.column(2).to_pylist()
        out = []
        for i, (x, other) in enumerate(zip(nodes, others)):
            mine = gram[at[i]: at[i + 1]], count[at[i]: at[i + 1]]
            if other is None:
                node, kept = x, mine
            elif x == node:
                out.append((x, other, overlap(kept, mine)))
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _, _ in out], batch.column(0).type), pa.array([y for _, y, _ in out], batch.column(0).type),
                                          pa.array([z for _, _, z in out], pa.float64())], names=["node", "other", "similar"])


def compared(pairs: DataFrame, texts: DataFrame, partners: int = PARTNERS) -> DataFrame:
    """Exact similarity of distinct pairs (node, other), given (id, text) with one row for each id."""
    salts = pairs.groupBy("node").agg(F.ceil(F.count("*") / partners).cast("int").alias("salts"))
    dealt = pairs.join(salts, "node").select("node", F.pmod(F.xxhash64("other"), "salts").cast("int").alias("salt"), "other")
    nodes = salts.join(texts, salts.node == texts.id).select("node", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"),
                                                             F.lit(None).cast(pairs.schema["other"].dataType).alias("other"), "text")
    others = dealt.join(texts, dealt.other == texts.id).select("node", "salt", "other", "text")
    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = nodes.unionByName(others).repartition(n, "node", "salt").sortWithinPartitions("node", "salt", F.col("other").asc_nulls_first())
    kind = pairs.schema["node"].dataType.simpleString()
    return rows.mapInArrow(_compare, f"node {kind}, other {kind}, similar double")


def _texts(docs: DataFrame, nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """(id, text) of every node that occurs in a column of the rows; docs has (id, th, text), nodes their row of least id."""
    wanted = rows.select(F.explode(F.array(*rows.columns)).alias("node")).distinct()
    places = nodes.join(wanted, "node").select("node", F.col("rep.id").alias("id"), F.col("rep.th").alias("th"))
    found = docs.join(places, ["id", "th"]).groupBy("id", "th", "node").agg(F.min("text").alias("text"))  # repeated rows, where they are
    return found.select(F.col("node").alias("id"), "text")


def _search(similar: float):
    """Links across components within each group of rows (band, i, j), which come sorted by them."""
    shingler = Shingler()

    def groups(batches):
        held, last = [], None
        for batch in batches:
            key = np.stack([batch.column(c).to_numpy() for c in range(3)], axis=1)
            cuts = np.flatnonzero(np.append(True, (key[1:] != key[:-1]).any(axis=1))) if len(key) else []
            for s, e in zip(cuts, np.append(cuts[1:], len(key)) if len(key) else []):
                if held and (key[s] != last).any():
                    yield pa.Table.from_batches(held)
                    held = []
                held.append(batch.slice(s, e - s))
                last = key[s]
        if held:
            yield pa.Table.from_batches(held)

    def run(batches):
        for table in groups(batches):
            n, ids = table.num_rows, table["other"].combine_chunks()
            crossed = table["i"][0].as_py() != table["j"][0].as_py()
            block, far, total = (table[c].to_numpy() for c in ("block", "far", "total"))
            part = table["component"].combine_chunks().dictionary_encode()
            part = (part.combine_chunks() if isinstance(part, pa.ChunkedArray) else part).indices.to_numpy()
            sketch = np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint8).reshape(n, SIZE)
            lists = table["earlier"].combine_chunks()
            own = int(table["number"].to_numpy().min())
            earlier = lists.values.to_numpy()[lists.offsets.to_numpy()[:-1, None] + np.arange(own)]  # whole keys of the bands before this one
            pairs, step = [], max(1, 8_000_000 // (n * SIZE))
            for begin in range(0, n, step):
                u = np.arange(begin, min(n, begin + step))
                fits = (part[u, None] != part[None, :]) & (np.abs(far[u, None] - far[None, :]) <= 1 - similar + 1e-9)
                fits &= np.minimum(total[u, None], total[None, :]) >= similar * np.maximum(total[u, None], total[None, :]) - 1e-9
                fits &= (block[u, None] < block[None, :]) if crossed else (u[:, None] < np.arange(n)[None, :])
                x, y = np.nonzero(fits)
                for low in range(0, len(x), 100_000):
                    a, b = u[x[low: low + 100_000]], y[low: low + 100_000]
                    agree = (sketch[a] == sketch[b]).sum(axis=1)
                    good = np.flatnonzero(agree >= AGREE)
                    good = good[~(earlier[a[good]] == earlier[b[good]]).any(axis=1)]  # others have met under an earlier key
                    pairs.append(np.stack([agree[good], a[good], b[good]]))
            pairs = np.concatenate(pairs, axis=1) if pairs else np.zeros((3, 0), np.int64)
            yield from linked(pairs[:, np.argsort(-pairs[0], kind="stable")], part, table, ids)

    def linked(pairs, part, table, ids):
        """The pairs that are links, the likeliest first, skipping those whose components have been joined."""
        parent, sets, out = {}, {}, []

        def root(x):
            while parent.get(x, x) != x:
                x = parent[x]
            return x

        used = np.unique(pairs[1:])
        for begin in range(0, len(used), 256):
            some = used[begin: begin + 256]
            row, gram, count = shingler.multisets(table["text"].combine_chunks().take(pa.array(some)))
            at = np.searchsorted(row, np.arange(len(some) + 1))
            sets |= {int(x): (gram[at[i]: at[i + 1]], count[at[i]: at[i + 1]]) for i, x in enumerate(some)}
        for _, x, y in pairs.T.tolist():
            a, b = root(part[x]), root(part[y])
            if a != b and (found := overlap(sets[x], sets[y])) >= similar:
                parent[a] = b
                out.append((x, y, float(found)))
        for low in range(0, len(out), 10_000):
            x, y, found = zip(*out[low: low + 10_000])
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(x)), ids.take(pa.array(y)), pa.array(found, pa.float64())], names=["a", "b", "similar"])

    return run


def _across(rows: DataFrame, similar: float) -> DataFrame:
    """Links (node, other, similar) across components, from rows of keys with several."""
    spark = rows.sparkSession
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    rows = rows.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("other"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = rows.select("band", F.least("block", "with").cast("int").alias("i"), F.greatest("block", "with").cast("int").alias("j"), "block", "other", "component", "far", "total", "sketch", "number", "earlier", "text")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(n, "band", "i", "j").sortWithinPartitions("band", "i", "j")
    kind = rows.schema["other"].dataType.simpleString()
    found = dealt.mapInArrow(_search(similar), f"a {kind}, b {kind}, similar double")
    return found.groupBy(F.least("a", "b").alias("node"), F.greatest("a", "b").alias("other")).agg(F.max("similar").alias("similar"))


def _settled(df: DataFrame) -> DataFrame:
    """A durable copy; shuffle files that led to it are no longer needed, and are let go at once.

    Spark drops them when the objects that stand for them are collected, which may otherwise be long after.
    """
    out = durable(df)
    gc.collect()
    df.sparkSession._jvm.System.gc()
    return out


def classes(docs: DataFrame, text: str = "text", key: str = "doc_id", similar: float = SIMILAR) -> DataFrame:
    """One row per input row: id, class_id (the least id of the class), whether it is that one, and n_links.

    n_links counts verified links of the row's node to other nodes, of the node with most where an id has several; equal
    multisets have none among themselves.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text"))
    known = base.filter("id IS NOT NULL").select("id", F.xxhash64("text").alias("th"), "text")
    path = scratch_path(spark, "signatures")
    kind = base.schema["id"].dataType.simpleString()
    known.mapInArrow(_sign, f"id {kind}, th long, f1 long, f2 long, bands array<long>, total long, sketch binary").write.parquet(path)
    signed = spark.read.parquet(path)

    firsts = signed.groupBy("f1", "f2").agg(F.min(F.struct("id", "th")).alias("rep"))
    nodes = _settled(firsts.withColumn("node", F.monotonically_increasing_id()))  # numbers stay as they are once written
    copies = _settled(signed.select("id", "f1", "f2").join(nodes, ["f1", "f2"]).select("id", "node", F.col("rep.id").alias("rep")))
    own = nodes.select("node", F.col("rep.id").alias("id"), F.col("rep.th").alias("th"))
    keys = signed.join(own, ["id", "th"]).select(F.col("node").alias("rep"), F.posexplode("bands").alias("number", "band"))

    crowds = keys.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1")
    crowded = _settled(keys.join(crowds, "band"))
    shared = crowded.groupBy("rep").agg(F.sum("n").alias("score"))
    centres = crowded.join(shared, "rep").groupBy("band").agg(F.max(F.struct("score", "rep"))["rep"].alias("node"))
    stars = _settled(crowded.join(centres, "band").select("band", "number", "node", F.col("rep").alias("other"), "n"))
    pairs = stars.filter("node <> other").select("node", "other").distinct()
    done = _settled(compared(pairs, _texts(known, nodes, pairs)))

    # ids with several texts hold their nodes together
    several = copies.groupBy("id").agg(F.min("node").alias("least"), F.max("node").alias("most")).filter("least <> most")
    same = copies.join(several, "id").filter("node <> least").select(F.col("least").alias("node"), F.col("node").alias("other"))
    links = done.filter(F.col("similar") >= similar).select("node", "other").union(same).distinct()
    parts = _settled(connected_components(links, src="node", dst="other"))

    members = _settled(stars.join(parts.withColumnRenamed("id", "other"), "other", "left")
               .join(done, ["node", "other"], "left")
               .select("band", "number", "other", "n", F.coalesce("component", "other").alias("component"),
                       F.when(F.col("node") == F.col("other"), 0.0).otherwise(1 - F.col("similar")).alias("far")))
    mixed = members.groupBy("band").agg(F.min("component").alias("a"), F.max("component").alias("b")).filter("a <> b").select("band")
    opened = _settled(members.join(mixed, "band", "left_semi"))
    wanted = own.join(opened.select(F.col("other").alias("node")).distinct(), "node", "left_semi")
    sketches = signed.join(wanted, ["id", "th"]).groupBy("id", "th", "node").agg(F.max(F.struct("total", "sketch", "bands")).alias("s")).drop("id", "th")
    open_ = opened.join(sketches, F.col("other") == sketches["node"]).select(
        "band", "number", "n", "other", "component", "far", "s.total", "s.sketch", F.slice("s.bands", 1, F.col("number")).alias("earlier"))
    more = _settled(_across(open_.join(_texts(known, nodes, opened.select("other")), F.col("other") == F.col("id")), similar))
    if not more.isEmpty():
        done = done.unionByName(more.join(done.select("node", "other"), ["node", "other"], "left_anti"))
        links = links.union(more.select("node", "other")).distinct()
        parts = _settled(connected_components(links, src="node", dst="other"))

    degree = (done.filter(F.col("similar") >= similar).select(F.explode(F.array("node", "other")).alias("id")).groupBy("id").agg(F.count("*").alias("n_links")))
    # the least id of a class, over the nodes that are in one with others
    linked = _settled(parts.withColumnRenamed("id", "node").join(own.select("node", "id"), "node"))
    least = linked.groupBy("component").agg(F.min("id").alias("class_id"))
    linked = linked.join(least, "component").select("node", "class_id").join(degree.withColumnRenamed("id", "node"), "node", "left")
    classed = copies.join(linked, "node", "left").groupBy("id").agg(F.min(F.coalesce("class_id", "rep")).alias("class_id"), F.max("n_links").alias("n_links"))
    out = base.select("id").join(classed, "id", "left")
    least = F.coalesce("class_id", "id")
    return out.select(F.col("id").alias(key), least.alias("class_id"), F.coalesce(F.col("id") == least, F.lit(True)).alias("is_first"),
                      F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def keep_first(docs: DataFrame, text: str = "text", key: str = "doc_id", similar: float = SIMILAR) -> DataFrame:
    """The input rows without those whose class has a smaller id; all columns stay. Rows without an id stay."""
    gone = classes(docs, text, key, similar).filter("NOT is_first").select(F.col(key).alias("_gone")).distinct()
    return docs.join(gone, docs[key] == gone["_gone"], "left_anti")
