"""Substring dedup by relative Lempel-Ziv parsing against indexed reference blocks.

A passage of WINDOW words that occurs elsewhere is to go. Parsing every document against every block of the corpus would
be quadratic; instead the blocks are formed by content. In each window the smallest hash of ANCHOR consecutive words is
the window's anchor; equal windows have equal anchors, so it is enough to meet the windows with the same anchor.
Neighbouring windows with one anchor form a segment.

1. Each document gives its segments as (anchor, hash of the segment, place). Anchors that occur once in the corpus are
   left behind; what stays is what can repeat.
2. Equal segments are merged before any text moves. One copy of each is cut from its document and dealt by anchor into
   reference blocks, where a suffix array indexes the words of the block.
3. Each segment is factored greedily against its block: the factor at a word is the longest run that also begins at
   another place of the block. Factors of WINDOW words or more are duplicate spans. Parsing goes on WINDOW - 1 words before
   the end of a factor, so that windows across factor boundaries are judged too.
4. Spans return to all copies of the segment, and documents are cut.

Anchors that many different segments share (more than HOT_SEGMENTS) are cut into single windows and dealt by the window's
own hash, where equal windows have merged; so no block grows with a hot group. Segments are compared as 64-bit hashes of
words; merging uses 128 bits.

Null or short texts have no window. Rows are told apart by (id, hash of the text); repeated rows of the same id and text
count as copies of each other and get equal results. Only the id and the text are read, so other names cannot clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paysieve.llm import buffers as B
from paysieve.plans.durable import scratch_path

WINDOW = 35
ANCHOR = 12
BLOCK_WORDS = 200_000
HOT_SEGMENTS = 20_000
LONGEST = 64  # factors are measured up to so many words; longer ones go on as a further factor


class Cutter:
    """Words, word hashes and segments of a slice of texts."""

    def __init__(self, window: int, anchor: int):
        self.window, self.anchor = window, anchor
        self.bytes, self.words = B.SpanHash(11), B.SpanHash(12)

    def tokens(self, array):
        data, offsets = B.utf8(array)
        starts, ends = B.runs(B.NOT_WHITE[data], offsets)
        at = np.searchsorted(starts, offsets)
        return data, offsets, starts, ends, at, self.bytes.of_bytes(data, starts, ends)

    def segments(self, words: np.ndarray, at: np.ndarray):
        """Row, first word, number of words, anchor, hash and occurrences of the anchor, of each segment."""
        counts = np.diff(at)
        windows = np.maximum(0, counts - self.window + 1)
        starts = B.ragged(at[:-1], windows)
        if not len(starts):
            return [np.zeros(0, np.int64)] * 6
        grams = B.gram_hash(words, self.anchor)
        width = self.window - self.anchor + 1
        least, reach = grams, 1
        while reach * 2 <= width:
            least = np.minimum(least[:-reach], least[reach:])
            reach *= 2
        if reach < width:
            least = np.minimum(least[: len(least) - (width - reach)], least[width - reach:])
        anchor, row = least[starts], np.repeat(np.arange(len(counts)), windows)
        first = np.flatnonzero(np.insert((anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1]), 0, True))
        last = np.append(first[1:], len(starts)) - 1
        begin, end = starts[first], starts[last] + self.window
        found = anchor[first]
        # occurrences of the anchor in the segment, to see repeats inside one segment
        spread = B.ragged(begin, end - begin - self.anchor + 1)
        same = (grams[spread] == np.repeat(found, end - begin - self.anchor + 1)).astype(np.int64)
        bounds = np.cumsum(end - begin - self.anchor + 1)
        total = np.concatenate([[0], np.cumsum(same)])
        times = total[bounds] - total[bounds - (end - begin - self.anchor + 1)]
        return row[first], begin - at[row[first]], end - begin, found, self.words.of(words, begin, end), times


def factor_lengths(words: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For every word of the block the longest run from there that also begins at another place (up to LONGEST words).

    The index is a suffix array by prefix doubling; the longest match of a suffix is with one of its two neighbours.
    words: codes from 0; ends: for each position, the end of its segment, which no run crosses.
    """
    n = len(words)
    if n < 2:
        return np.zeros(n, np.int64)
    ranks, reach, place = [words.astype(np.int64)], 1, np.arange(n)
    while reach < LONGEST:
        rank = ranks[-1]
        beyond = place + reach
        second = np.where(beyond < ends, rank[np.minimum(beyond, n - 1)] + 1, -place - 1)  # an end differs from everything
        order = np.lexsort((second, rank))
        new = np.insert((rank[order][1:] != rank[order][:-1]) | (second[order][1:] != second[order][:-1]), 0, True)
        fresh = np.empty(n, np.int64)
        fresh[order] = np.cumsum(new) - 1
        ranks.append(fresh)
        reach *= 2
    order = np.argsort(ranks[-1], kind="stable")
    a, b = order[:-1], order[1:]
    common, step = np.zeros(n - 1, np.int64), reach
    for rank in reversed(ranks):
        x, y = a + common, b + common
        fits = (x + step <= ends[a]) & (y + step <= ends[b]) & (common + step <= LONGEST)
        xs, ys = np.minimum(x, n - 1), np.minimum(y, n - 1)
        common += step * (fits & (rank[xs] == rank[ys]))
        step //= 2
    best = np.zeros(n, np.int64)
    best[a] = common
    best[b] = np.maximum(best[b], common)
    return best


def factor(words: np.ndarray, begins: np.ndarray, ends: np.ndarray, copies: np.ndarray, window: int):
    """Greedy factors of `window` words or more: (segment, first word, end), first and end within the segment."""
    size = ends - begins
    longest = factor_lengths(np.unique(words, return_inverse=True)[1], np.repeat(ends, size))
    place = B.ragged(np.zeros(len(size), np.int64), size)
    rest = np.repeat(size, size) - place
    longest = np.where(np.repeat(copies > 1, size), rest, longest)  # merged copies: all of it occurs elsewhere
    # the next place at which a factor of `window` words begins, from any place on
    good = np.where(longest >= window, np.arange(len(words)), len(words))
    following = np.minimum.accumulate(good[::-1])[::-1] if len(good) else good
    out, active, cursor = [], np.arange(len(begins)), begins.copy()
    while len(active):
        at = np.where(cursor[active] < ends[active], following[np.minimum(cursor[active], len(words) - 1)], len(words))
        alive = at < ends[active]
        active, at = active[alive], at[alive]
        stop = at + longest[at]
        out.append((active, at - begins[active], stop - begins[active]))
        cursor[active] = stop - window + 1  # windows across the boundary come next
    return [np.concatenate(x) if out else np.zeros(0, np.int64) for x in (zip(*out) if out else ([], [], []))]


def _places(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    """Anchor, hash, place, size and occurrences of the anchor for all segments."""
    def run(batches):
        cutter = Cutter(window, anchor)
        for batch in B.slices(batches):
            *_, at, words = cutter.tokens(batch.column(2))
            row, first, size, found, seg, times = cutter.segments(words, at)
            yield pa.RecordBatch.from_arrays(
                [pa.array(B.signed(found)), pa.array(B.signed(seg)), batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)),
                 pa.array(first, pa.int32()), pa.array(size, pa.int32()), pa.array(np.minimum(times, 2), pa.int32())],
                names=["anchor", "seg", "id", "th", "first", "size", "times"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(run, f"anchor long, seg long, id {kind}, th long, first int, size int, times int")


def _texts_of(rows: DataFrame, window: int) -> DataFrame:
    """Cut the listed segments from their documents: (anchor, seg, copies, text); hot ones as single windows."""
    def run(batches):
        cutter = Cutter(window, ANCHOR)
        for batch in B.slices(batches):
            data, offsets, starts, ends, at, words = cutter.tokens(batch.column(0))
            lists = batch.column(1)
            flat, sizes = lists.flatten(), np.diff(np.frombuffer(lists.buffers()[1], np.int32)[lists.offset: lists.offset + len(lists) + 1])
            anchor, seg, first, size, copies, hot = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(6))
            row = np.repeat(np.arange(len(sizes)), sizes)
            begin = at[row] + first
            cold = np.flatnonzero(~hot)
            warm = np.flatnonzero(hot)
            n = size[warm] - window + 1
            one = B.ragged(begin[warm], n)  # first words of single windows
            w = np.repeat(warm, n)
            begins, stops = np.concatenate([begin[cold], one]), np.concatenate([begin[cold] + size[cold], one + window])
            if not len(begins):
                continue
            low, high = starts[begins], ends[stops - 1]
            texts = np.concatenate([[0], np.cumsum(high - low)])
            blob = data[B.ragged(low, high - low)]
            text = pa.LargeStringArray.from_buffers(len(low), pa.py_buffer(texts.astype(np.int64)), pa.py_buffer(blob)).cast(pa.string())
            single = cutter.words.of(words, one, one + window)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([anchor[cold], B.signed(single)])), pa.array(np.concatenate([seg[cold], seg[w]])),
                 pa.array(np.concatenate([np.zeros(len(cold), np.int32), (one - begin[w]).astype(np.int32)])),
                 pa.array(np.concatenate([copies[cold], copies[w]])), pa.array(np.concatenate([anchor[cold], anchor[w]])), text,
                 pa.array(np.arange(len(low)) >= len(cold))],
                names=["block", "seg", "shift", "copies", "anchor", "text", "single"])

    return rows.mapInArrow(run, "block long, seg long, shift int, copies long, anchor long, text string, single boolean")


def _parse(window: int, block_words: int):
    """Factor the segments of a partition sorted by block, a bounded block of whole groups at a time."""
    def blocks(batches):
        cutter, held, size, last = Cutter(window, ANCHOR), [], 0, None
        for batch in B.slices(batches):
            key = batch.column(0).to_numpy()
            *_, at, words = cutter.tokens(batch.column(5))
            cuts = np.flatnonzero(np.insert(key[1:] != key[:-1], 0, True))
            for s, e in zip(cuts, np.append(cuts[1:], len(key))):
                if size > block_words and key[s] != last:
                    yield held
                    held, size = [], 0
                held.append((batch.slice(s, e - s), words[at[s]: at[e]], np.diff(at[s: e + 1])))
                size, last = size + int(at[e] - at[s]), key[s]
        if held:
            yield held

    def run(batches):
        for held in blocks(batches):
            rows = pa.Table.from_batches([h[0] for h in held]).combine_chunks()
            words, size = np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held])
            ends = np.cumsum(size)
            which, first, stop = factor(words, ends - size, ends, rows["copies"].to_numpy(), window)
            shift = rows["shift"].to_numpy()[which]
            picked = rows.take(pa.array(which))
            yield from pa.table([picked["block"], picked["anchor"], picked["seg"], pa.array((first + shift).astype(np.int32)), pa.array((stop + shift).astype(np.int32))],
                                names=["block", "anchor", "seg", "s", "e"]).to_batches()

    return run


def _parsed(cut: DataFrame, window: int, block_words: int) -> DataFrame:
    n = int(cut.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = cut.repartition(n, "block").sortWithinPartitions("block")
    return blocks.mapInArrow(_parse(window, block_words), "block long, anchor long, seg long, s int, e int")


def duplicate_spans(docs: DataFrame, text: str = "text", key: str = "doc_id", window: int = WINDOW, anchor: int = ANCHOR,
                    block_words: int = BLOCK_WORDS, hot_segments: int = HOT_SEGMENTS) -> tuple[DataFrame, DataFrame]:
    """(documents as id, th, text; duplicate spans by document as id, th, spans of first and end words)."""
    spark = docs.sparkSession
    base = docs.select(F.col(key).alias("id"), F.xxhash64(F.col(text)).alias("th"), F.col(text).cast("string").alias("text"))
    scratch = scratch_path(spark, "segments")
    _places(base, window, anchor).write.parquet(scratch + "-all")
    places = spark.read.parquet(scratch + "-all")
    shared = places.groupBy("anchor").agg(F.sum("times").alias("n")).filter("n > 1").select("anchor")
    places.join(shared, "anchor", "left_semi").drop("times").write.parquet(scratch + "-shared")
    places = spark.read.parquet(scratch + "-shared")

    different = places.groupBy("anchor", "seg").agg(F.count("*").alias("copies"), F.min(F.struct("id", "th", "first", "size")).alias("one"))
    hot = (different.groupBy("anchor").agg(F.count("*").alias("n")).filter(F.col("n") > hot_segments).select("anchor", F.lit(True).alias("hot")))
    chosen = (different.join(hot, "anchor", "left")
              .select("one.id", "one.th", F.struct("anchor", "seg", "one.first", "one.size", "copies", F.coalesce("hot", F.lit(False)).alias("hot")).alias("x")))
    wanted = chosen.groupBy("id", "th").agg(F.collect_list("x").alias("list"))  # at most the segments of one text
    # repeated rows share id and th; one of them is enough to cut from
    cut = _texts_of(base.join(wanted, _same(base, wanted)).select(base.text, wanted.list), window)
    found = _parsed(cut.filter("NOT single"), window, block_words).select("anchor", "seg", "s", "e")
    if not hot.isEmpty():  # single windows of hot anchors merge by content, are parsed once, and give their result to all
        ones = cut.filter("single")
        merged = ones.groupBy("block").agg(F.sum("copies").alias("copies"), F.min(F.struct("anchor", "seg", "shift", "text")).alias("one"))
        merged = merged.select("block", "one.seg", "one.shift", "copies", "one.anchor", "one.text", F.lit(True).alias("single"))
        again = ones.join(_parsed(merged, window, block_words).select("block").distinct(), "block")
        found = found.unionByName(again.select("anchor", "seg", F.col("shift").alias("s"), (F.col("shift") + window).cast("int").alias("e")))
    found = found.groupBy("anchor", "seg").agg(F.collect_set(F.struct("s", "e")).alias("spans"))
    spans = (places.join(found, ["anchor", "seg"])
             .select("id", "th", F.transform("spans", lambda x: F.struct((x.s + F.col("first")).alias("s"), (x.e + F.col("first")).alias("e"))).alias("spans"))
             .groupBy("id", "th").agg(F.array_distinct(F.flatten(F.collect_list("spans"))).alias("spans")))
    return base, spans


def _same(a: DataFrame, b: DataFrame):
    return a.id.eqNullSafe(b.id) & a.th.eqNullSafe(b.th)


def dedup(docs: DataFrame, text: str = "text", key: str = "doc_id", **options) -> DataFrame:
    """Per input row: id, n_words, n_removed and `kept`, the words left joined by one space."""
    base, spans = duplicate_spans(docs, text, key, **options)
    rows = base.join(spans, _same(base, spans), "left").select(base.id, base.text, spans.spans)

    def run(batches):
        cutter = Cutter(options.get("window", WINDOW), ANCHOR)
        for batch in B.slices(batches):
            data, offsets, starts, ends, at, _ = cutter.tokens(batch.column(1))
            lists, total = batch.column(2), len(starts)
            sizes = np.array([0 if x is None else x for x in pc.list_value_length(lists).to_pylist()], np.int64)
            flat = lists.flatten()
            s, e = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(2))
            row = np.repeat(np.arange(len(sizes)), sizes)
            depth = np.zeros(total + 1, np.int64)
            np.add.at(depth, at[row] + s, 1)
            np.add.at(depth, at[row] + e, -1)
            gone = np.cumsum(depth)[:-1] > 0
            n = np.diff(at)
            removed = np.bincount(np.repeat(np.arange(len(n)), n)[gone], minlength=len(n))
            # kept words with one space each between them
            raw, kept = data.tobytes(), []
            stay = np.flatnonzero(~gone)
            bounds = np.searchsorted(stay, at)
            s_of, e_of = starts[stay].tolist(), ends[stay].tolist()
            for r in range(len(n)):
                kept.append(b" ".join([raw[s_of[i]: e_of[i]] for i in range(bounds[r], bounds[r + 1])]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
                                             names=["id", "n_words", "n_removed", "kept"])

    kind = base.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, n_words long, n_removed long, kept string").withColumnRenamed("id", key)


