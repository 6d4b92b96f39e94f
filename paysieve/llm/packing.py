"""Best-fit packing of tokenised documents into sequences, by patterns of few pieces fitted to the histogram of lengths.

A document's tokens and its end mark are one piece, or, if longer than a sequence, several: the first takes what does not
fill a sequence, the others are whole sequences. Only the histogram of piece lengths decides which lengths go together, and
it has as many entries as a sequence has tokens, whatever the corpus:

1. Patterns: all sets of one to three lengths that fill a sequence exactly, the longest of them in a band of lengths. The
   bands go downwards, (1/2, 1] and (1/3, 1/2] of a sequence, so that short pieces go to the long ones first.
2. Non-negative least squares: repeat counts x >= 0 of the patterns with the least squared difference between the pieces
   they use and the histogram, by coordinate descent, in each round over patterns that share no length.
3. Rounding: whole repeats, the largest first, never more than there are pieces.
4. Residuals: what is left of a band opens sequences of its own, longest first, which go on with the longest piece that
   fits; after the last band so does all the rest. Sequences of the same content are handled as one row with a count.

The result is a table of patterns and repeats (a few entries for each length). A piece of length l and rank r among those of
its length finds its pattern, sequence and offset by arithmetic on the running repeats of l. Ranks need no sort: a task
numbers its pieces within each length as it writes them, and the counts by (task, length) give where each task begins. So
documents are read and tokenised once, in place, and of a piece only a few numbers are shuffled. A length that a third of
all pieces share (empty texts, copies) is spread over all tasks that hold any.

Null and empty texts are one piece, the end mark alone. Repeated rows and ids are documents of their own. The key may have any
name and type and may be null; no other columns but key and text are read, so names cannot clash. Very long texts are
tokenised whole. An empty table gives no pieces. Reruns give equal sequences as long as the input is dealt to tasks alike.
"""

from __future__ import annotations

import itertools
import json
import os
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paysieve.llm import buffers as B
from paysieve.plans.durable import scratch_path

CAPACITY = 2048
END_MARK = 0
ROUNDS = 80  # of the least squares
STEPS = 2_048  # patterns tried in a round
MEMO_ENTRIES = 400_000  # distinct words whose tokens a task remembers
MEMO_SIZE = 8_000_000  # characters of them, besides those of the present slice
SLICE_BYTES = 4 << 20
RANK_BITS = 48


PRINTED = np.array([0x20 < x < 0x7F for x in range(256)])
ASCII_ALNUM = np.array([chr(x).isalnum() and x < 0x80 for x in range(256)])
PUNCTUATION = PRINTED & ~ASCII_ALNUM


#: Words that are one piece to every byte-level pattern: letters of the Latin blocks, which all Unicode versions know.
PLAIN = re.compile("\x20?[A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F]+")


def byte_characters() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: visible Latin-1 itself, the others from 256 on."""
    visible = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xFF and b != 0xAD]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


def plain_encoder(definition: str):
    """A faster encoder for PLAIN words from the same file, or None if the file isn't byte-level with merges in the order of ids."""
    import tiktoken

    spec = json.loads(definition)
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    if model.get("type") != "BPE" or spec.get("normalizer") or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
        return None
    if model.get("dropout") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix") or model.get("ignore_merges"):
        return None
    made = [model["vocab"].get("".join(m.split(" ") if isinstance(m, str) else m), -1) for m in model["merges"]]
    byte = byte_characters()
    if made != sorted(set(made)) or made[:1] == [-1] or len(made) + 256 != len(model["vocab"]) or not all(c in model["vocab"] for c in byte):
        return None
    ranks = {bytes(byte[c] for c in token): i for token, i in model["vocab"].items()}
    return tiktoken.Encoding("plain", pat_str=r" ?[^ \n]+|\n", mergeable_ranks=ranks, special_tokens={})


class Tokens:
    """Token ids of texts by a tokenizer file of the tokenizers library, byte-level with its usual splitting pattern.

    Such a pattern always begins a token at a space before a printable character, and at a mark that follows a letter or
    digit, so the words between such places are tokenised one by one, and most of them have been seen before. Slices that
    hold the text of a special token are tokenised row by row. New words of plain letters go through a second encoder of
    the same vocabulary and merges, all others through the library.
    """

    def __init__(self, definition: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_str(definition)
        self.special = [t.content.encode() for t in self.model.get_added_tokens_decoder().values()]
        self.plain = plain_encoder(definition)
        self._forget()

    def _forget(self) -> None:
        self.known, self.ids, self.used, self.starts, self.size = {}, np.zeros(1 << 16, np.uint32), 0, np.zeros(1, np.int64), 0

    def _add(self, words: list[str]) -> None:
        plain = [w for w in words if PLAIN.fullmatch(w)] if self.plain else []
        if plain:
            ids = self.plain.encode_to_numpy("\n".join(plain))
            between = ids == self.plain.encode_ordinary("\n")[0]
            self._keep(plain, ids[~between], np.diff(np.concatenate([[-1], np.flatnonzero(between), [len(ids)]])) - 1)
            words = [w for w in words if not PLAIN.fullmatch(w)]
        found = [e.ids for e in self.model.encode_batch_fast(words, add_special_tokens=False)]
        sizes = np.array([len(x) for x in found], np.int64)
        self._keep(words, np.fromiter(itertools.chain.from_iterable(found), np.uint32, int(sizes.sum())), sizes)

    def _keep(self, words: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        end = self.used + len(ids)
        if end > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), len(ids)), np.uint32)])
        self.ids[self.used: end] = ids
        self.known.update(zip(words, range(len(self.starts) - 1, len(self.starts) - 1 + len(words))))
        self.starts = np.concatenate([self.starts, self.used + np.cumsum(sizes)])
        self.used = end
        self.size += sum(map(len, words))

    def breaks(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Beginnings of the words of all rows; rows that are not empty begin one."""
        new = np.zeros(len(data) + 1, bool)
        raw = data.tobytes()
        if len(data) > 2 and not any(x in raw for x in self.special):
            printed, alnum, mark = PRINTED[data], ASCII_ALNUM[data], PUNCTUATION[data]
            new[1:-2] = (data[1:-1] == 0x20) & (printed[2:] | (data[2:] >= 0x80) & printed[:-2])
            new[1:-1] |= alnum[:-1] & mark[1:]
        new[offsets[:-1]] = True
        return np.flatnonzero(new[:-1])

    def of(self, array: pa.Array, last: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows one after another, each row closed by `last`, and where each row begins."""
        data, offsets = B.utf8(array)
        begin = self.breaks(data, offsets)
        words = pa.LargeStringArray.from_buffers(len(begin), pa.py_buffer(np.append(begin, len(data)).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data)))
        coded = words.dictionary_encode()
        distinct, which = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        if len(self.known) > MEMO_ENTRIES or self.size > MEMO_SIZE:
            self._forget()
        self._add([w for w in distinct if w not in self.known])
        entry = np.array([self.known[w] for w in distinct], np.int64)
        first, sizes = (self.starts[entry][which], np.diff(self.starts)[entry][which]) if len(entry) else (np.zeros(0, np.int64),) * 2
        row_of = np.searchsorted(offsets, begin, "right") - 1
        lengths = np.bincount(row_of, weights=sizes, minlength=len(array)).astype(np.int64) + 1
        where = np.concatenate([[0], np.cumsum(lengths)])
        out = np.full(where[-1], last, np.uint32)
        inside = np.ones(len(out), bool)
        inside[where[1:] - 1] = False
        out[inside] = self.ids[B.ragged(first, sizes)]
        return out, where


def patterns(histogram: np.ndarray, low: int, high: int) -> np.ndarray:
    """Rows of three lengths, falling, 0 for none, that fill a sequence, the longest in (low, high], all of them present."""
    capacity, found = len(histogram) - 1, [np.zeros((0, 3), np.int64)]
    for a in range(high, low, -1):
        if not histogram[a]:
            continue
        rest = capacity - a
        b = np.arange((rest + 1) // 2, min(a, rest) + 1)
        c = rest - b
        there = (histogram[b] > 0) & ((histogram[c] > 0) | (c == 0)) if rest else np.ones(1, bool)
        found.append(np.stack([np.full(len(b), a), b, c], axis=1)[there])
    return np.concatenate(found)


def fitted(rows: np.ndarray, histogram: np.ndarray, rounds: int = ROUNDS, steps: int = STEPS) -> np.ndarray:
    """Repeat counts of the patterns by non-negative least squares.

    One coordinate's best value is known in closed form; each round changes those that lower the sum of squares most and
    share no length with another, so their changes do not disturb one another.
    """
    x, left = np.zeros(len(rows)), histogram.astype(np.float64)
    left[0] = 0
    a, b, c = rows.T
    norm = (rows > 0).sum(axis=1) + 2.0 * ((a == b) + ((b == c) & (c > 0)) + ((a == c) & (c > 0)))
    for _ in range(rounds):
        slope = left[a] + left[b] + left[c]
        change = np.maximum(slope / norm, -x)
        gain = change * (slope - 0.5 * change * norm)
        top = np.argpartition(-gain, min(steps, len(gain) - 1))[:steps]
        top = top[np.argsort(-gain[top], kind="stable")]
        used, chosen = np.zeros(len(histogram), bool), []
        for i in top[gain[top] > 1e-9].tolist():
            if not (used[a[i]] or used[b[i]] or used[c[i]]):
                used[rows[i]] = True
                used[0] = False
                chosen.append(i)
        if not chosen:
            break
        x[chosen] += change[chosen]
        for column in (a, b, c):
            np.subtract.at(left, column[chosen], change[chosen])
        left[0] = 0
    return x


def rounded(rows: np.ndarray, x: np.ndarray, left: np.ndarray) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Whole repeats of the patterns, the largest first; what they use is taken out of `left`."""
    out = []
    order = np.argsort(-x, kind="stable")
    for i in order[x[order] >= 0.5].tolist():
        lengths, times = np.unique(rows[i][rows[i] > 0], return_counts=True)
        n = int(min(round(x[i]), (left[lengths] // times).min()))
        if n > 0:
            left[lengths] -= n * times
            out.append((tuple(zip(lengths.tolist(), times.tolist())), n))
    return out


def greedy(left: np.ndarray, down_to: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Sequences that open with the longest piece left, of more than down_to tokens, and go on with the longest that fits."""
    capacity, out = len(left) - 1, []

    def longest(free: int) -> int:
        found = np.flatnonzero(left[1: free + 1])
        return int(found[-1]) + 1 if len(found) else 0

    while (top := longest(capacity)) > down_to:
        times = int(min(capacity // top, left[top]))
        n = int(left[top] // times)
        left[top] -= n * times
        stack = [(capacity - top * times, ((top, times),), n)]
        while stack:
            free, made, n = stack.pop()
            nxt = longest(free)
            if not nxt:
                out.append((made, n))
                continue
            times = int(min(free // nxt, max(1, left[nxt] // n)))
            some = int(min(n, left[nxt] // times))
            left[nxt] -= some * times
            if some < n:
                stack.append((free, made, n - some))
            stack.append((free - nxt * times, (*made, (nxt, times)), some))
    return out


def plan(histogram: np.ndarray) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Rows (((length, times), ...), repeats) that use every piece of histogram[1:] once."""
    capacity, left, out = len(histogram) - 1, histogram.astype(np.int64).copy(), []
    for high, low in ((capacity, capacity // 2), (capacity // 2, capacity // 3)):
        rows = patterns(left, low, high)
        if len(rows):
            out += rounded(rows, fitted(rows, left), left)
        out += greedy(left, low)
    return out + greedy(left, 0)


def places(made: list[tuple[tuple[tuple[int, int], ...], int]]) -> dict[str, np.ndarray]:
    """For each length and pattern: key (length, first rank), first sequence, times in a sequence, offset there."""
    first, used, rows = 0, {}, []
    for content, repeats in made:
        offset = 0
        for length, times in content:
            rows.append((length << RANK_BITS | used.get(length, 0), first, times, offset, length))
            used[length] = used.get(length, 0) + repeats * times
            offset += length * times
        first += repeats
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return dict(zip(("key", "first", "times", "offset", "length"), table.T.copy()))


def placed(table: dict[str, np.ndarray], length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of pieces of a length with a rank among those of the length."""
    key = (length << RANK_BITS) | rank
    at = np.searchsorted(table["key"], key, "right") - 1
    turn = key - table["key"][at]
    times = table["times"][at]
    return table["first"][at] + turn // times, table["offset"][at] + turn % times * length


def _cut(definition: str, capacity: int, end_mark: int, with_ids: bool, key: str):
    """Pieces of (key, text) rows, with their rank among those of equal length that this task has written."""

    def run(batches):
        tokens, task = Tokens(definition), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in B.slices(batches, most=SLICE_BYTES):
            ids, where = tokens.of(batch.column(1), end_mark)
            sizes = np.diff(where)
            parts = (sizes + capacity - 1) // capacity
            row = np.repeat(np.arange(len(sizes)), parts)
            piece = B.ragged(np.zeros(len(parts), np.int64), parts)
            head = (sizes - 1) % capacity + 1
            start = np.where(piece > 0, head[row] + (piece - 1) * capacity, 0)
            length = np.where(piece > 0, capacity, head[row])
            order = np.argsort(length, kind="stable")
            ordered = length[order]
            new = np.insert(ordered[1:] != ordered[:-1], 0, True)
            turn = np.arange(len(ordered)) - np.flatnonzero(new)[np.cumsum(new) - 1]
            rank = np.empty(len(length), np.int64)
            rank[order] = turn + seen[ordered]
            seen += np.bincount(length, minlength=capacity + 1)
            raw, at = memoryview(ids.astype("<u4").tobytes()), (where[row] + start) * 4
            blobs = [raw[s: e] for s, e in zip(at.tolist(), (at + length * 4).tolist())]
            columns = {key: batch.column(0).take(pa.array(row)), "piece": pa.array(piece, pa.int32()), "start": pa.array(start), "length": pa.array(length),
                       "ids_crc32": pa.array([zlib.crc32(b) for b in blobs], pa.int64()), "_task": pa.array(np.full(len(row), task, np.int64)), "_rank": pa.array(rank)}
            if with_ids:
                columns["ids"] = pa.array([bytes(b) for b in blobs], pa.binary())
            for low in range(0, len(row), 20_000):
                yield pa.RecordBatch.from_pydict({n: c.slice(low, 20_000) for n, c in columns.items()})

    return run


def pack(docs: DataFrame, tokenizer: str, text: str = "text", key: str = "doc_id", capacity: int = CAPACITY, end_mark: int = END_MARK,
         with_ids: bool = False) -> DataFrame:
    """One row per piece: key, piece, start, length, ids_crc32, sequence_id, offset, and `ids` (32-bit little-endian) if asked for.

    tokenizer is the path of the tokenizer file on the driver; tasks get its content.
    """
    with open(tokenizer, encoding="utf-8") as f:
        definition = f.read()
    spark, kind = docs.sparkSession, docs.schema[key].dataType.simpleString()
    path = scratch_path(spark, "pieces")
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    shape = f"key {kind}, piece int, start long, length long, ids_crc32 long, _task long, _rank long" + (", ids binary" if with_ids else "")
    rows.mapInArrow(_cut(definition, capacity, end_mark, with_ids, "key"), shape).write.parquet(path)
    pieces = spark.read.schema(shape).parquet(path)

    path = scratch_path(spark, "lengths")
    pieces.groupBy("_task", "length").agg(F.count("*").alias("n")).write.parquet(path)
    counts = spark.read.schema("_task long, length long, n long").parquet(path)
    histogram = np.zeros(capacity + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).toLocalIterator():  # at most one row per length up to capacity
        histogram[r["length"]] = r["n"]
    table = places(plan(histogram))

    before = Window.partitionBy("length").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)  # a row per task
    begins = counts.select("_task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_begin"))
    ranked = pieces.join(begins, ["_task", "length"]).withColumn("_rank", F.col("_rank") + F.col("_begin"))
    names = ["key", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]

    def place(batches):
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "_rank"))
            sequence, offset = placed(table, length, rank)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    kinds = {f.name: f.dataType.simpleString() for f in pieces.schema.fields}
    out = ranked.select(*names, "_rank").mapInArrow(place, ", ".join(f"{n} {kinds[n]}" for n in names) + ", sequence_id long, offset long")
    return out.withColumnRenamed("key", key)


def sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, n_pieces, ids): the token ids of every sequence, from pieces with ids; a sequence is bounded by its capacity."""
    ordered = F.sort_array(F.collect_list(F.struct("offset", "length", "ids")))
    grouped = pieces.groupBy("sequence_id").agg(ordered.alias("p"))
    return grouped.select("sequence_id", F.aggregate("p", F.lit(0).cast("long"), lambda n, x: n + x["length"]).alias("n_tokens"), F.size("p").alias("n_pieces"),
                          F.aggregate("p", F.lit(b""), lambda joined, x: F.concat(joined, x["ids"])).alias("ids"))
