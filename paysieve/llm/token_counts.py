"""Token counts of a unigram vocabulary by Viterbi search, without building the tokens.

An Aho-Corasick automaton lists every vocabulary piece that ends at each character; the search carries, for every
position, only the best score and the number of pieces on the way there. The rules that decide are the tokenizer's own:
scores are added from left to right, only a strictly better path replaces one found earlier, and paths are met in the order
of their beginnings, so among equals the one with the longest last piece stays. A character with no piece of its own is
an unknown of the lowest score less PENALTY, and counts as its UTF-8 bytes (byte fallback).

Text is cut before each mark of a word, as the tokenizer does, so counts add up over words; counts of words are kept in a
bounded table per task. Narrow: one pass without a shuffle. Null and empty texts have 0 tokens; repeated rows count alike.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paysieve.llm import buffers as B

MARK = "▁"
PENALTY = 10.0
CACHE_WORDS = 600_000  # emptied beyond that: some 100 MB
CACHED_LENGTH = 64
LOWEST = float("-inf")


def vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a published model file, in order of their ids."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


class Counter:
    """Pieces of a vocabulary as an automaton; special pieces (unknown, control, bytes) are never matched."""

    def __init__(self, pieces: list[tuple[str, float]], specials: frozenset[str] = frozenset(("<unk>", "<s>", "</s>"))):
        self.matcher = ahocorasick.Automaton()
        usable = [(p, s) for p, s in pieces if p not in specials and not (len(p) == 6 and p.startswith("<0x")) and "\0" not in p]
        for piece, score in usable:
            self.matcher.add_word(piece, (len(piece), score))
        self.matcher.make_automaton()
        self.feeds_alone = not any("\n" in p for p, _ in usable)
        self.unknown = min(s for _, s in pieces) - PENALTY
        self.cache: dict[str, int] = {}

    def count(self, word: str) -> int:
        """Pieces on the best path over one pre-token."""
        n = len(word)
        score, pieces = [0.0] * (n + 1), [0] * (n + 1)
        best, steps, known, end = LOWEST, 0, False, 1
        for last, (size, value) in self.matcher.iter(word):  # at each end the earliest beginning comes first
            while end <= last:
                if not known:
                    best, steps = self._unknown(word, end, score, pieces, best, steps)
                score[end], pieces[end] = best, steps
                best, steps, known, end = LOWEST, 0, False, end + 1
            total = score[end - size] + value
            if total > best:
                best, steps = total, pieces[end - size] + 1
            if size == 1:
                known = True
        while end <= n:
            if not known:
                best, steps = self._unknown(word, end, score, pieces, best, steps)
            score[end], pieces[end] = best, steps
            best, steps, known, end = LOWEST, 0, False, end + 1
        return pieces[n]

    def _unknown(self, word: str, end: int, score: list, pieces: list, best: float, steps: int) -> tuple[float, int]:
        """The character before `end` as an unknown, where that is better than the pieces that end there."""
        total = score[end - 1] + self.unknown
        if total <= best:
            return best, steps
        return total, pieces[end - 1] + len(word[end - 1].encode())

    def of(self, text: str | None) -> int:
        """Tokens of a text: a mark before it, marks for spaces, a cut before every mark.

        Characters that no piece holds stand alone on every path, so text is also cut at line feeds if those are such.
        """
        if not text:
            return 0
        marked = text.replace(" ", MARK)
        marked = marked if marked.startswith(MARK) else MARK + marked
        total, cache = marked.count("\0"), self.cache
        if self.feeds_alone:
            total += marked.count("\n")
            marked = marked.replace("\n", "\0")
        words = marked.replace(MARK, "\0" + MARK).split("\0")
        counts = list(map(cache.get, words))
        if None in counts:
            for i, word in enumerate(words):
                if counts[i] is None:
                    counts[i] = n = cache[word] if word in cache else self.count(word)
                    if len(word) <= CACHED_LENGTH:
                        cache[word] = n
            if len(cache) >= CACHE_WORDS:
                cache.clear()
        return total + sum(counts)


def count_tokens(docs: DataFrame, pieces: list[tuple[str, float]], text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per document: the id, n_tokens, and n_chars measured from the text."""
    shared = docs.sparkSession.sparkContext.broadcast(pieces)  # a vocabulary, whatever the corpus

    def run(batches):
        counter = Counter(shared.value)
        for batch in B.slices(batches, text):
            texts = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([counter.of(t) for t in texts], pa.int64()),
                                              pa.array(np.array([len(t or "") for t in texts], np.int64))], names=[key, "n_tokens", "n_code_points"])

    rows = docs.select(F.col(key), F.col(text).alias(text))
    return rows.mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, n_tokens long, n_code_points long")
