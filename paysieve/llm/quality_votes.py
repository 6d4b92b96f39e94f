"""Quality by nearest-neighbour voting in a latent-semantic space.

Texts become frequencies of hashed words and word shapes, square-rooted, weighted by rarity among the references, and
projected on the leading singular directions of the references. The references are a bounded sample of labelled rows
(PER_CLASS for each label, a documented limit of the fit); their vectors are broadcast, a few MB whatever the corpus.
Every document is compared with all of them by exact cosine products, in blocks of a slice; its NEIGHBOURS nearest vote
with their labels, weighted by similarity.

Scoring is one narrow pass, so hot sources and copies need no care. Null and empty texts have a direction of their own
(no words); a text that resembles no reference, or any text where there are no labels, scores 0.5. Repeated rows score
alike. The label columns, lang, source and ids are never read by a score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paysieve.llm import buffers as B

PER_CLASS = 1500
NEIGHBOURS = 15
DIMENSIONS = 48
TIE = 1e-6  # references as similar as the last neighbour vote too
WORDS, SHAPES, TRAITS = 1536, 448, 64  # widths of the three parts of a vector
SIZE = WORDS + SHAPES + TRAITS
SHARE = (0.5, 1.0, 1.5)  # weight of each part


def _kinds() -> np.ndarray:
    """0 lower or non-ASCII letter, 1 upper, 2 digit, 3 sentence mark, 4 other sign."""
    out = np.full(256, 4, np.int64)
    out[0x61:0x7B] = out[0x80:] = 0
    out[0x41:0x5B] = 1
    out[0x30:0x3A] = 2
    out[list(b".,;:!?'\"()-")] = 3
    return out


class Features:
    def __init__(self):
        self.hash, self.kinds = B.SpanHash(21), _kinds()

    def of(self, array: pa.Array) -> np.ndarray:
        """One row of SIZE frequencies for each text, each part of unit length."""
        data, offsets = B.utf8(array)
        rows = len(offsets) - 1
        starts, ends = B.runs(B.NOT_WHITE[data], offsets)
        n = np.diff(np.searchsorted(starts, offsets))
        row = np.repeat(np.arange(rows), n)
        words = self.hash.of_bytes(B.LOWER[data], starts, ends)
        kinds = self.kinds[data]

        def inside(kind):
            total = np.concatenate([[0], np.cumsum(kinds == kind)])
            return total[ends] - total[starts]

        size, upper, other, digits, marks = ends - starts, inside(1), inside(4), inside(2), inside(3)
        again = np.concatenate([[False], (words[1:] == words[:-1]) & (row[1:] == row[:-1])]) if len(words) else np.zeros(0, bool)
        loud = (upper == size - marks - other) & (upper > 1)
        shape = kinds[starts] + 5 * kinds[ends - 1] + 25 * np.minimum(other, 3) + 100 * loud + 200 * again + 400 * np.minimum(size // 4, 5) if len(words) else np.zeros(0, np.int64)
        out = np.zeros((rows, SIZE), np.float32)

        def counted(codes, width):
            return np.bincount(row * width + codes, minlength=rows * width).reshape(rows, width)

        out[:, :WORDS] = np.sqrt(counted((words % np.uint64(WORDS)).astype(np.int64), WORDS) / np.maximum(n, 1)[:, None])
        out[:, WORDS: WORDS + SHAPES] = np.sqrt(counted((B.mix(shape.astype(np.uint64)) % np.uint64(SHAPES)).astype(np.int64), SHAPES) / np.maximum(n, 1)[:, None])

        def share(values):
            return np.bincount(row, weights=values, minlength=rows) / np.maximum(n, 1)

        pairs = row * (1 << 32) + (words >> np.uint64(32)).astype(np.int64)
        different = np.bincount(np.unique(pairs) >> 32, minlength=rows) / np.maximum(n, 1)
        traits = [share(again), np.minimum(1, share(other)), share(loud), share(digits > 0), 1 - different, np.minimum(1, share(size) / 16)]
        base = WORDS + SHAPES
        for i, value in enumerate(traits):  # each in tenths, neighbouring tenths share
            low = np.minimum(9, (value * 10).astype(np.int64))
            rest = value * 10 - low
            out[np.arange(rows), base + 10 * i + low] += np.sqrt(1 - np.minimum(rest, 1) / 2)
            out[np.arange(rows), base + 10 * i + np.minimum(9, low + 1)] += np.sqrt(np.minimum(rest, 1) / 2)
        out[n == 0, base:] = 0
        out[n == 0, SIZE - 1] = 1
        return out


def _scaled(x: np.ndarray, rarity: np.ndarray) -> np.ndarray:
    x = x * rarity
    for begin, end, weight in ((0, WORDS, SHARE[0]), (WORDS, WORDS + SHAPES, SHARE[1]), (WORDS + SHAPES, SIZE, SHARE[2])):
        norm = np.linalg.norm(x[:, begin:end], axis=1, keepdims=True)
        x[:, begin:end] *= weight / np.maximum(norm, 1e-9)
    return x


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def fit(texts: pa.Array, labels: np.ndarray, dimensions: int = DIMENSIONS) -> dict:
    """Rarity, directions, and the references' vectors and labels."""
    raw = Features().of(texts)
    rarity = np.log((1 + len(raw)) / (1 + (raw > 0).sum(axis=0))).astype(np.float32) + 1
    x = _scaled(raw, rarity)
    _, vectors = np.linalg.eigh(x.T.astype(np.float64) @ x)
    directions = vectors[:, ::-1][:, :dimensions].astype(np.float32)
    return {"rarity": rarity, "directions": directions, "vectors": _unit(x @ directions), "labels": labels.astype(np.float32)}


class Voter:
    def __init__(self, model: dict, neighbours: int = NEIGHBOURS):
        self.model, self.neighbours, self.features = model, min(neighbours, len(model["labels"])), Features()

    def scores(self, array: pa.Array) -> np.ndarray:
        m = self.model
        mine = _unit(_scaled(self.features.of(array), m["rarity"]) @ m["directions"])
        out = np.empty(len(mine))
        for begin in range(0, len(mine), 512):
            similar = mine[begin: begin + 512] @ m["vectors"].T
            least = -np.partition(-similar, self.neighbours - 1, axis=1)[:, self.neighbours - 1, None]
            weight = np.where(similar >= least - TIE, np.maximum(similar, 0), 0).astype(np.float64) ** 4
            total, voted = weight.sum(axis=1), weight @ m["labels"]
            out[begin: begin + 512] = np.where(total > 0, voted / np.where(total > 0, total, 1), 0.5)
        return np.clip(out, 0, 1)


def references(docs: DataFrame, labels: DataFrame, text: str, key: str, label: str, per_class: int = PER_CLASS) -> tuple[pa.Array, np.ndarray]:
    """Texts and labels of the bounded sample: of each label the rows with the smallest hash of the id."""
    rows = labels.filter(F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(F.col(key).alias("_k")).agg(F.max(label).alias("_q"))
    picked = [rows.filter(F.col("_q") == q).orderBy(F.xxhash64("_k"), "_k").limit(per_class) for q in (0, 1)]
    ids = F.broadcast(picked[0].union(picked[1]))  # at most 2 * per_class rows
    found = docs.select(F.col(key).alias("_k"), F.col(text).alias("_t")).join(ids, "_k").dropDuplicates(["_k"]).select("_k", "_t", "_q").toPandas().sort_values("_k")
    return pa.array(found["_t"].tolist(), pa.string()), found["_q"].to_numpy(np.float32)


def score(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality", per_class: int = PER_CLASS) -> DataFrame:
    """Per document: id and score, higher where label 1 is likelier. `labels` are the rows that may be learnt from."""
    texts, values = references(docs, labels, text, key, label, per_class)
    model = docs.sparkSession.sparkContext.broadcast(fit(texts, values)) if len(values) else None

    def run(batches):
        voter = Voter(model.value) if model is not None else None
        for batch in B.slices(batches, text):
            scores = voter.scores(batch.column(1)) if voter else np.full(batch.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=[key, "score"])

    rows = docs.select(F.col(key), F.col(text).alias(text))
    return rows.mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, score double")
