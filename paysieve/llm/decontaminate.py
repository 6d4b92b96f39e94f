"""Benchmark decontamination with generalised suffix automata of the normalised test items.

The items' words are spelt into automata that accept every run of item words; a document streams through, the automaton
keeps the length of the longest run that ends at each word, and every word inside a run of `window` words, or inside a
whole item that is shorter than that, is a hit.

Scale: an automaton is broadcast, and its size is bounded: items are dealt into groups of at most GROUP_WORDS words (an
item that is longer alone is cut into overlapping pieces), and documents stream through one group after another inside
the same task, so the text is read once; what a task holds at a time is one group. Documents are never shuffled, so hot
sources or groups of copies need no care. A prefilter by word pairs of the items keeps the automaton away from runs that
cannot match; it drops nothing, as a match consists of such pairs.

Null texts have no words; an item without words has no window; repeated rows, of documents or items, are handled like
single ones; items with the same id are one item with several texts.
"""

from __future__ import annotations

import hashlib
import pickle
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paysieve.llm import buffers as B

WINDOW = 10
GROUP_WORDS = 200_000  # words of items in one automaton, some tens of MB in a task


def normal_words(text: str | None) -> list[bytes]:
    """Lower-cased ASCII letters, digits and anything outside ASCII, as UTF-8."""
    data, offsets = B.utf8(pa.array([text], pa.string()))
    low = B.LOWER[data]
    raw = low.tobytes()
    return [raw[s:e] for s, e in zip(*B.runs(B.ALNUM[low], offsets))]


class Automaton:
    """Suffix automaton of several word sequences; states know the items whose windows end in them."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.ids = {w: i for i, w in enumerate(sorted({w for _, words in items for w in words}))}
        self.next, self.link, self.length = [{}], [-1], [0]
        ends = defaultdict(set)  # items with an occurrence that ends in a state
        whole = defaultdict(set)  # short items that are a run as a whole, by their words
        pairs, self.least = set(), window
        for item, words in items:
            codes, state = [self.ids[w] for w in words], 0
            pairs.update(zip(codes, codes[1:]))
            for code in codes:
                state = self._extend(state, code)
                ends[state].add(item)
            if 0 < len(codes) < window:
                whole[tuple(codes)].add(item)
                self.least = min(self.least, len(codes))
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            if self.length[self.link[state]] >= window:
                ends[self.link[state]] |= ends[state]
        self.items = {s: frozenset(x) for s, x in ends.items() if self.length[s] >= window}
        self.short = defaultdict(list)  # by state: (length, items) of whole short items
        for codes, names in whole.items():
            state = 0
            for code in codes:
                state = self.next[state][code]
            self.short[state].append((len(codes), frozenset(names)))
        hasher = B.SpanHash(3)
        words = sorted(self.ids)
        blob = np.frombuffer(b"".join(words), np.uint8)
        ends_at = np.cumsum([len(w) for w in words], dtype=np.int64)
        hashes = hasher.of_bytes(blob, ends_at - np.array([len(w) for w in words], np.int64), ends_at) if words else np.zeros(0, np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.codes = hashes[order], order.astype(np.int64)
        self.pairs = np.sort(np.array([a * len(words) + b for a, b in pairs], np.int64))

    def _extend(self, last: int, code: int) -> int:
        found = self.next[last].get(code)
        if found is not None and self.length[found] == self.length[last] + 1:
            return found
        if found is not None:
            return self._clone(last, code, found)
        new = self._state(self.length[last] + 1, {})
        while last != -1 and code not in self.next[last]:
            self.next[last][code] = new
            last = self.link[last]
        if last == -1:
            self.link[new] = 0
        else:
            found = self.next[last][code]
            self.link[new] = found if self.length[found] == self.length[last] + 1 else self._clone(last, code, found)
        return new

    def _state(self, length: int, edges: dict) -> int:
        self.next.append(edges)
        self.link.append(0)
        self.length.append(length)
        return len(self.next) - 1

    def _clone(self, last: int, code: int, found: int) -> int:
        copy = self._state(self.length[last] + 1, dict(self.next[found]))
        self.link[copy], self.link[found] = self.link[found], copy
        while last != -1 and self.next[last].get(code) == found:
            self.next[last][code] = copy
            last = self.link[last]
        return copy

    def stream(self, codes: list[int], hit: np.ndarray, names: set) -> None:
        """Mark words inside windows and collect the items they belong to."""
        state, run, window = 0, 0, self.window
        edges, link, length = self.next, self.link, self.length
        for i, code in enumerate(codes):
            while state and code not in edges[state]:
                state = link[state]
                run = length[state]
            if code in edges[state]:
                state, run = edges[state][code], run + 1
            if run >= window:
                hit[i + 1 - run: i + 1] = True
                at = state
                while length[link[at]] >= window:
                    at = link[at]
                names |= self.items[at]
            if self.short:
                at, most = state, run
                while at > 0:
                    for size, items in self.short.get(at, ()):
                        if size <= most:
                            hit[i + 1 - size: i + 1] = True
                            names |= items
                    at = link[at]
                    most = length[at]


def groups(items: list[tuple[str, list[bytes]]], window: int = WINDOW, most: int = GROUP_WORDS) -> list[list[tuple[str, list[bytes]]]]:
    """Deal items into groups of bounded size; pieces of a long item overlap by a window less one word."""
    out, size = [[]], 0
    for item, words in items:
        step = max(1, most - window + 1)
        for begin in range(0, max(1, len(words) - window + 1), step) if len(words) > most else (0,):
            piece = words[begin: begin + most] if len(words) > most else words
            if size and size + len(piece) > most:
                out.append([])
                size = 0
            out[-1].append((item, piece))
            size += len(piece)
    return out


def automata(items: DataFrame, text: str = "text", key: str = "item_id", window: int = WINDOW, most: int = GROUP_WORDS) -> list[bytes]:
    """Pickled automata of the items, one for each group; test sets are small next to any corpus, and each is bounded."""
    rows = items.select(F.col(key).cast("string").alias("k"), F.col(text).alias("t")).distinct().orderBy("k", "t").toLocalIterator()
    out, group, size = [], [], 0
    for k, t in rows:
        words = normal_words(t)
        for part in groups([(k or "", words)], window, most) if words else ():
            n = sum(len(w) for _, w in part)
            if size and size + n > most:
                out.append(cloudpickle.dumps(Automaton(group, window)))
                group, size = [], 0
            group += part
            size += n
    return out + ([cloudpickle.dumps(Automaton(group, window))] if group else [])


def _codes(words: np.ndarray, automaton: Automaton) -> np.ndarray:
    """Vocabulary number of each word, -1 if it is in no item."""
    if not len(automaton.hashes):
        return np.full(len(words), -1, np.int64)
    at = np.minimum(np.searchsorted(automaton.hashes, words), len(automaton.hashes) - 1)
    return np.where(automaton.hashes[at] == words, automaton.codes[at], -1)


def _candidates(codes: np.ndarray, row_of: np.ndarray, automaton: Automaton) -> list[tuple[int, int]]:
    """Ranges of words in which every neighbouring pair is a pair of some item, long enough for a window."""
    if not len(codes) or not len(automaton.hashes):
        return []
    pair = codes[:-1] * len(automaton.ids) + codes[1:]
    joined = (codes[:-1] >= 0) & (codes[1:] >= 0) & (row_of[1:] == row_of[:-1])
    if len(automaton.pairs):
        at = np.minimum(np.searchsorted(automaton.pairs, pair), len(automaton.pairs) - 1)
        joined &= automaton.pairs[at] == pair
    else:
        joined[:] = False
    first = np.flatnonzero(np.insert(~joined, 0, True))
    last = np.append(first[1:], len(codes))
    fits = (last - first >= automaton.least) & (codes[first] >= 0)
    return list(zip(first[fits].tolist(), last[fits].tolist()))


def _scanned(batches, text: str, load):
    """Slices with word boundaries, hit flags, and the item names of each row."""
    hasher = B.SpanHash(3)
    for batch in B.slices(batches, text):
        data, offsets = B.utf8(batch.column(batch.schema.get_field_index(text)))
        low = B.LOWER[data]
        starts, ends = B.runs(B.ALNUM[low], offsets)
        counts = np.diff(np.searchsorted(starts, offsets))
        row_of = np.repeat(np.arange(batch.num_rows), counts)
        words = hasher.of_bytes(low, starts, ends)
        hit, names = np.zeros(len(words), bool), defaultdict(set)
        for automaton in load():
            codes = _codes(words, automaton)
            for s, e in _candidates(codes, row_of, automaton):
                automaton.stream(codes[s:e].tolist(), hit[s:e], names[row_of[s]])
        yield batch, data, offsets, starts, ends, counts, row_of, hit, names


def _loader(shared):
    """Automata one at a time; a single one stays loaded."""
    single = [pickle.loads(shared[0].value)] if len(shared) == 1 else None

    def load():
        if single:
            yield from single
        else:
            for part in shared:
                yield pickle.loads(part.value)

    return load


def scan(docs: DataFrame, items: DataFrame, text: str = "text", key: str = "doc_id", window: int = WINDOW) -> DataFrame:
    """Per document: n_words, n_hit, the sorted ids of items with occurring windows, and whether any word is hit."""
    context = docs.sparkSession.sparkContext
    shared = [context.broadcast(x) for x in automata(items, window=window)]

    def run(batches):
        load = _loader(shared)
        for batch, _, _, _, _, counts, row_of, hit, names in _scanned(batches, text, load):
            found = [sorted(names.get(r, ())) for r in range(batch.num_rows)]
            hits = np.bincount(row_of[hit], minlength=batch.num_rows)
            digest = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(hits, pa.int64()), pa.array([len(x) for x in found], pa.int64()),
                 pa.array(digest), pa.array(hits > 0), pa.array(found, pa.list_(pa.string()))],
                names=[key, "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key), F.col(text).alias(text))
    return rows.mapInArrow(run, f"`{key}` {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>")


def clean(docs: DataFrame, items: DataFrame, text: str = "text", window: int = WINDOW, most_share: float = 0.25) -> DataFrame:
    """Documents with their hit spans cut out; a document goes as a whole if more than `most_share` of its words are hit,
    whatever its length. All columns stay; clean documents stay byte for byte."""
    context = docs.sparkSession.sparkContext
    shared = [context.broadcast(x) for x in automata(items, window=window)]
    columns = docs.columns

    def run(batches):
        load = _loader(shared)
        for batch, data, offsets, starts, ends, counts, row_of, hit, _ in _scanned(batches, text, load):
            hits = np.bincount(row_of[hit], minlength=batch.num_rows)
            stays = hits <= most_share * counts
            at, column = np.searchsorted(starts, offsets), batch.schema.get_field_index(text)
            texts = batch.column(column)
            if hits.any():
                values = texts.to_pylist()
                for r in np.flatnonzero((hits > 0) & stays):
                    raw, pieces, begin = data[offsets[r]: offsets[r + 1]].tobytes(), [], 0
                    h = hit[at[r]: at[r + 1]].astype(np.int8)
                    edges = np.diff(np.concatenate([[0], h, [0]]))
                    for s, e in zip(np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)):
                        pieces.append(raw[begin: starts[at[r] + s] - offsets[r]])
                        begin = ends[at[r] + e - 1] - offsets[r]
                    values[r] = b"".join([*pieces, raw[begin:]]).decode()
                texts = pa.array(values, texts.type)
            out = pa.RecordBatch.from_arrays([texts if i == column else c for i, c in enumerate(batch.columns)], names=columns)
            yield out.filter(pa.array(stays))

    return docs.mapInArrow(run, docs.schema)
