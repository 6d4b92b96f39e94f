"""Ranked lexical search over bit-sliced Bloom signatures.

Index, one narrow pass over the texts: documents of like size are gathered into blocks. A block's signature is a bit matrix
with a row for each position of a Bloom filter and a column for each document, so a term's bitmap over the block is the AND
of a few rows. Beside a term itself, its frequency levels are entered ((term, 1) if it occurs twice or more, (term, 2) from
four times, and so on), so the bitmaps bound frequencies too. The block also holds the documents' lengths, their sorted
term hashes with frequencies for exact scores, and its vocabulary with document frequencies.

Search, for groups of queries against every block:

1. The bitmaps of a query's terms overestimate presence: no document with the term is left out, some without it may be in.
2. Weighted slice sums: per level, the weights of the terms whose bitmap holds the document are added up. Times what a level
   can add to the saturated frequency in a document of that length, they are an upper bound of its score.
3. Documents are scored exactly from their own frequencies, the highest bounds first, until no bound reaches the query's
   k-th best score so far in this task. All others are provably not among the best.

A task gives the k best of each query over all its blocks; a ranked window over these is the result. Blocks meet groups of
queries as rows, so Spark chooses by measured size how (a broadcast, or a product of partitions), and nothing is collected but
the two numbers of the collection. The scores are integers (see SCORING), so results don't depend on the order of sums.

Null and empty texts have no term and are no document of the collection; queries without one have no result. Rows that share
a document id are documents of their own; rows that share a query id are one query, of all their terms. Ids may have any name
and type; a null document id comes last among equal scores, null query ids are one query. Very long texts are documents of a
block of their own. A term is known by a 64-bit hash. Only ids and texts are read, so extra columns cannot clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from paysieve.llm import buffers as B
from paysieve.plans.durable import scratch_path

BEST = 20
#: SCORING: w = floor(1000 ln((2N+2) / (2df+1))); m = 75 + 25nN div L; a term adds w * (10^9 tf div (1000 tf + 12 m)).
UNIT = 1_000_000_000
HASHES = 3  # rows of a term
BITS = 8  # positions for each entry of the largest document of a block
BLOCK_DOCS, BLOCK_ENTRIES, BLOCK_CELLS = 2_048, 1 << 18, 1 << 24  # a task's arrays grow with these, when it indexes and when it searches
FEW_DOCS = 256  # at the end of a task, fewer than these join the next larger documents
GROUP_TERMS = 20_000  # of queries searched together
HELD_ROWS = 500_000  # of partial results, before a task passes them on
ROUND = 256  # documents scored before bounds are looked at again
#: A block is a row of megabytes; a reader and a writer hold a row group at a time, which by itself would be looked at after 100 rows.
WRITTEN = {"parquet.block.row.count.limit": "4", "parquet.page.size.row.check.min": "1", "parquet.enable.dictionary": "false"}


def term_counts(array: pa.Array, hasher: B.SpanHash) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, term hash and frequency, sorted by row and hash."""
    data, offsets = B.utf8(array)
    data = B.LOWER[data]
    starts, ends = B.runs(B.ALNUM[data], offsets)
    row = np.searchsorted(offsets, starts, "right") - 1
    term = hasher.of_bytes(data, starts, ends)
    order = np.lexsort((term, row))
    row, term = row[order], term[order]
    first = np.flatnonzero(np.insert((row[1:] != row[:-1]) | (term[1:] != term[:-1]), 0, True)) if len(row) else np.zeros(0, np.int64)
    return row[first], term[first], np.diff(np.append(first, len(row)))


def levels_of(tf: np.ndarray) -> np.ndarray:
    """Entries of a term: one, and one more for each doubling of its frequency."""
    return np.frexp(tf.astype(np.float64))[1].astype(np.int64)


def positions(term: np.ndarray, level: np.ndarray | int, wide: int) -> np.ndarray:
    """Rows of the signature, HASHES for each entry."""
    seed = B.mix(term + np.asarray(level).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return np.stack([B.mix(seed + np.uint64(i)) & np.uint64(wide - 1) for i in range(HASHES)], axis=-1).astype(np.int64)


class Block:
    """Documents of one block, gathered until it is full."""

    def __init__(self):
        self.parts, self.docs, self.entries = [], 0, 0

    def add(self, ids: pa.Array, size: np.ndarray, term: np.ndarray, tf: np.ndarray, entries: int) -> None:
        self.parts.append((ids, size, term, tf))
        self.docs += len(size)
        self.entries += entries

    def take(self, other: Block) -> None:
        self.parts += other.parts
        self.docs += other.docs
        self.entries += other.entries

    def record(self) -> pa.RecordBatch:
        ids = pa.concat_arrays([p[0] for p in self.parts])
        size, term, tf = (np.concatenate([p[i] for p in self.parts]) for i in (1, 2, 3))
        doc = np.repeat(np.arange(len(size)), size)
        levels = levels_of(tf)
        most = int(np.bincount(doc, weights=levels, minlength=len(size)).max())
        wide = 1 << max(6, int(BITS * most - 1).bit_length())
        bits = np.zeros((wide, len(size)), bool)
        for level in range(int(levels.max())):
            has = levels > level
            bits[positions(term[has], level, wide), doc[has][:, None]] = True
        vocabulary, df = np.unique(term, return_counts=True)
        length = np.bincount(doc, weights=tf, minlength=len(size)).astype(np.int64)
        one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
        raw = lambda values: pa.array([values.tobytes()], pa.binary())
        return pa.RecordBatch.from_arrays([one(ids), raw(length), pa.array([wide], pa.int64()), pa.array([int(levels.max())], pa.int32()), raw(np.packbits(bits, axis=1)),
                                           raw(size.astype(np.int64)), raw(term), raw(tf.astype(np.uint32)), one(pa.array(B.signed(vocabulary))), one(pa.array(df.astype(np.int64))),
                                           pa.array([len(size)], pa.int64()), pa.array([int(tf.sum())], pa.int64())],
                                          names=["ids", "length", "wide", "levels", "slices", "size", "term", "tf", "vocabulary", "df", "n_docs", "n_terms"])


def _index(batches):
    """Rows (id, text) -> blocks."""
    hasher, held = B.SpanHash(53), {}
    for batch in B.slices(batches):
        row, term, tf = term_counts(batch.column(1), hasher)
        rows = batch.num_rows
        size = np.bincount(row, minlength=rows)
        entries = np.bincount(row, weights=levels_of(tf), minlength=rows).astype(np.int64)
        begin = np.cumsum(size) - size
        kind = np.where(size > 0, (np.frexp(np.maximum(entries, 1).astype(np.float64))[1] + 1) // 2, -1)  # one more for each quadrupling
        for k in np.unique(kind[kind >= 0]).tolist():
            docs = np.flatnonzero(kind == k)
            most = max(1, min(BLOCK_DOCS, BLOCK_CELLS // (BITS << 2 * k)))
            for low in range(0, len(docs), most):
                some = docs[low: low + most]
                at = B.ragged(begin[some], size[some])
                block = held.setdefault(k, Block())
                block.add(batch.column(0).take(pa.array(some)), size[some], term[at], tf[at], int(entries[some].sum()))
                if block.docs >= most or block.entries >= BLOCK_ENTRIES:
                    yield held.pop(k).record()
    small = Block()
    for k in sorted(held):
        small.take(held[k])
        if small.docs >= FEW_DOCS:
            yield small.record()
            small = Block()
    if small.docs:
        yield small.record()


def index(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The blocks of a collection, written to the shared folder; the texts are not needed after it."""
    kind = docs.schema[key].dataType.simpleString()
    shape = (f"ids array<{kind}>, length binary, wide long, levels int, slices binary, size binary, term binary, tf binary, vocabulary array<long>, df array<long>, "
             "n_docs long, n_terms long")
    path = scratch_path(docs.sparkSession, "signatures")
    docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(_index, shape).write.options(**WRITTEN).parquet(path)
    return docs.sparkSession.read.schema(shape).parquet(path)


def frequencies(term: np.ndarray, tf: np.ndarray, begin: np.ndarray, end: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """tf of each wanted term in documents given as ranges of their sorted terms; 0 where there is none."""
    low, high = np.repeat(begin[:, None], len(wanted), axis=1), np.repeat(end[:, None], len(wanted), axis=1)
    while (open_ := low < high).any():
        middle = (low + high) >> 1
        less = open_ & (term[np.minimum(middle, len(term) - 1)] < wanted)
        low, high = np.where(less, middle + 1, low), np.where(open_ & ~less, middle, high)
    at = np.minimum(low, len(term) - 1)
    return np.where((low < end[:, None]) & (term[at] == wanted), tf[at], 0).astype(np.int64)


def saturated(tf, m: np.ndarray) -> np.ndarray:
    return UNIT * tf // (1000 * tf + 12 * m)


class Searched:
    """A block, ready to be searched."""

    def __init__(self, row: dict, n_docs: int, n_terms: int):
        self.ids = row["ids"].values
        length, self.size, self.term = (np.frombuffer(row[c].as_buffer(), t) for c, t in (("length", np.int64), ("size", np.int64), ("term", np.uint64)))
        self.tf = np.frombuffer(row["tf"].as_buffer(), np.uint32).astype(np.int64)
        self.docs, self.wide, self.levels = len(length), row["wide"].as_py(), row["levels"].as_py()
        self.slices = np.frombuffer(row["slices"].as_buffer(), np.uint8).reshape(self.wide, -1)
        self.end = np.cumsum(self.size)
        grown = 25 * int(length.max()) * n_docs < 1 << 63
        self.m = 75 + ((25 * length * n_docs) // n_terms if grown else np.array([25 * int(n) * n_docs // n_terms for n in length], np.int64))
        # what each frequency level can add at most to a document's saturated frequency
        steps = [saturated((2 << level) - 1, self.m) for level in range(self.levels)]
        self.adds = [s - (steps[i - 1] if i else 0) for i, s in enumerate(steps)]

    def bitmaps(self, terms: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per level, the places of terms whose bitmap is not empty, and these bitmaps, unpacked."""
        out, left, packed = [], np.arange(len(terms)), None
        for level in range(self.levels):
            rows = positions(terms[left], level, self.wide)
            found = np.bitwise_and.reduce(self.slices[rows], axis=1) if packed is None else np.bitwise_and.reduce(self.slices[rows], axis=1) & packed
            some = found.any(axis=1)
            left, packed = left[some], found[some]
            if not len(left):
                break
            out.append((left, np.unpackbits(packed, axis=1, count=self.docs)))
        return out

    def scores(self, docs: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        tf = frequencies(self.term, self.tf, (self.end - self.size)[docs], self.end[docs], terms)
        return (weights * saturated(tf, self.m[docs][:, None])).sum(axis=1)


def _search(n_docs: int, n_terms: int, best: int, kind):
    """Rows (block, group of queries) -> (no, score, id): the best documents of each query in this task."""

    def run(batches):
        held, total = {}, 0

        def out():
            for no, rows in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([no] * len(rows), pa.int64()), pa.array([-s for s, _, _ in rows], pa.int64()), pa.array([i for _, _, i in rows], kind)],
                                                 names=["no", "score", "id"])

        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(j)[i] for j, n in enumerate(batch.schema.names)}
                block = Searched(row, n_docs, n_terms)
                group = row["queries"].values
                numbers, lists = group.field("no").to_numpy(), group.field("terms")
                cuts = lists.offsets.to_numpy()
                flat = lists.values
                terms, weights = flat.field("term").to_numpy().view(np.uint64), flat.field("weight").to_numpy()
                distinct, of = np.unique(terms[cuts[0]: cuts[-1]], return_inverse=True)
                levels = []
                for left, bits in block.bitmaps(distinct):
                    place = np.full(len(distinct), -1)
                    place[left] = np.arange(len(left))
                    levels.append((place, bits))
                for no, low, high in zip(numbers.tolist(), cuts[:-1], cuts[1:]):
                    bound = np.zeros(block.docs, np.int64)
                    for (place, bits), add in zip(levels, block.adds):
                        at = place[of[low - cuts[0]: high - cuts[0]]]
                        there = at >= 0
                        if not there.any():
                            break
                        bound += (weights[low:high][there].astype(np.float64) @ bits[at[there]]).astype(np.int64) * add  # a slice sum stays far below 2**53
                    rows = held.get(no, [])
                    least = -rows[-1][0] if len(rows) == best else 1
                    open_ = np.flatnonzero(bound >= least)
                    open_ = open_[np.argsort(-bound[open_], kind="stable")]
                    while len(open_):
                        step = 2 * best if len(rows) < best else ROUND
                        some, open_ = open_[:step], open_[step:]
                        score = block.scores(some, terms[low:high], weights[low:high])
                        good = score >= least
                        ids = block.ids.take(pa.array(some[good])).to_pylist()
                        rows = sorted([*rows, *((-s, x is None, x) for s, x in zip(score[good].tolist(), ids))], key=_order)[:best]
                        if len(rows) == best:
                            least = -rows[-1][0]
                            open_ = open_[bound[open_] >= least]
                    if rows:
                        total += len(rows) - len(held.get(no, ()))
                        held[no] = rows
                if total > HELD_ROWS:
                    yield from out()
                    held, total = {}, 0
        yield from out()

    return run


def _order(row):
    score, missing, key = row
    return (score, missing) if missing else (score, missing, key)


def _terms(batches):
    """Rows (id, text) -> (id, term, n)."""
    hasher = B.SpanHash(53)
    for batch in B.slices(batches):
        row, term, tf = term_counts(batch.column(1), hasher)
        for low in range(0, len(row), 50_000):
            part = slice(low, low + 50_000)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row[part])), pa.array(B.signed(term[part])), pa.array(tf[part].astype(np.int64))], names=["id", "term", "n"])


def search(blocks: DataFrame, queries: DataFrame, text: str = "text", key: str = "item_id", doc_key: str = "doc_id", best: int = BEST) -> DataFrame:
    """(query id, rank, document id, score): the best documents of every query with a score above 0, ties by document id."""
    spark = blocks.sparkSession
    counted = blocks.agg(F.sum("n_docs").alias("docs"), F.sum("n_terms").alias("terms")).first()
    n_docs, n_terms = counted["docs"] or 0, counted["terms"] or 1
    doc_type = blocks.schema["ids"].dataType.elementType
    query_kind, doc_kind = queries.schema[key].dataType.simpleString(), doc_type.simpleString()

    asked = queries.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(_terms, f"id {query_kind}, term long, n long")
    asked = asked.groupBy("id", "term").agg(F.sum("n").alias("n"))
    wanted = asked.select("term").distinct()
    df = blocks.select(F.explode(F.arrays_zip("vocabulary", "df")).alias("v")).select(F.col("v.vocabulary").alias("term"), F.col("v.df").alias("df"))
    df = df.join(wanted, "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log((F.lit(2.0 * n_docs) + 2) / (2 * F.col("df") + 1))).cast("long") * F.col("n")
    weighed = asked.join(df, "term").groupBy("id").agg(F.collect_list(F.struct("term", weight.alias("weight"))).alias("terms"))  # the terms of one query

    path = scratch_path(spark, "queries")
    weighed.withColumn("no", F.monotonically_increasing_id()).write.parquet(path)
    numbered = spark.read.schema(f"id {query_kind}, terms array<struct<term: long, weight: long>>, no long").parquet(path)
    n_groups = max(1, -(-(numbered.agg(F.sum(F.size("terms"))).first()[0] or 0) // GROUP_TERMS))
    grouped = numbered.groupBy(F.pmod(F.xxhash64("no"), F.lit(n_groups)).alias("g")).agg(F.collect_list(F.struct("no", "terms")).alias("queries"))  # about GROUP_TERMS terms
    path = scratch_path(spark, "groups")
    grouped.select("queries").write.parquet(path)
    groups = spark.read.schema("queries array<struct<no: long, terms: array<struct<term: long, weight: long>>>>").parquet(path)

    pairs = blocks.select("ids", "length", "wide", "levels", "slices", "size", "term", "tf").crossJoin(groups)  # a row is a block and a group of queries
    found = pairs.mapInArrow(_search(n_docs, n_terms, best, to_arrow_type(doc_type)), f"no long, score long, id {doc_kind}")
    place = Window.partitionBy("no").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    top = found.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= best)
    names = numbered.select(F.col("no").alias("_no"), F.col("id").alias("_query"))
    return top.join(names, F.col("no") == F.col("_no")).select(F.col("_query").alias(key), F.col("rank").cast("int").alias("rank"), F.col("id").alias(doc_key), "score")

