"""Ranked search, hard negatives and packing against plain versions."""

import math
import random
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyarrow.parquet import ParquetFile
from pyspark.sql import functions as F

from paysieve.llm import hard_negatives, packing, ranked_search

from . import helpers as H
from .test_operators import frame, some_texts

TOKENIZER = Path("/opt/tokenizers/byte_bpe_50k.json")
TERM = H.re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def ranked(docs, queries, best=20):
    """docs, queries: (id, text) -> rows (query, rank, doc, score); null document ids last among equals."""
    split = [(i, TERM.findall(H.lower(t))) for i, t in docs]
    split = [(i, w, Counter(w)) for i, w in split if w]
    n_docs, n_terms = len(split), sum(len(w) for _, w, _ in split)
    df = Counter(x for _, _, c in split for x in c)
    asked = {}
    for q, t in queries:
        asked.setdefault(q, Counter()).update(TERM.findall(H.lower(t)))
    out = []
    for q, terms in asked.items():
        rows = []
        for i, w, c in split:
            m = 75 + 25 * len(w) * n_docs // n_terms
            score = sum(n * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * (10**9 * c[x] // (1000 * c[x] + 12 * m)) for x, n in terms.items() if x in c)
            if score > 0:
                rows.append((-score, i is None, i if i is not None else "", i))
        out += [(q, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(rows, key=lambda x: x[:3])[:best], 1)]
    return Counter(out)


def result(df, *columns):
    return Counter(tuple(r) for r in df.select(*columns).collect())


@pytest.mark.parametrize("small", [False, True])
def test_ranked_search(spark, monkeypatch, small):
    if small:  # many blocks and groups, partial results passed on
        for name, value in (("BLOCK_DOCS", 8), ("FEW_DOCS", 3), ("GROUP_TERMS", 20), ("HELD_ROWS", 10), ("ROUND", 4)):
            monkeypatch.setattr(ranked_search, name, value)
    texts = some_texts(11)
    items = [(i, t[:200]) for i, t in enumerate(texts[:8])] + [(3, texts[9][:50]), (90, ""), (91, None), (92, "unheard"), (None, texts[1][:30])]
    queries = spark.createDataFrame(items, "item_id int, text string")
    got = result(ranked_search.search(ranked_search.index(frame(spark, texts)), queries, best=7), "item_id", "rank", "doc_id", "score")
    want = ranked(list(enumerate(texts)), items, 7)
    assert got == want and len(want) > 40


def test_a_row_group_of_the_index_holds_few_blocks(spark):
    """A reader holds a whole row group, so it must not grow with the blocks of a task."""
    docs = [(i, f"w{i % 977} w{i % 13}") for i in range(12_000)]
    blocks = ranked_search.index(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1))
    groups = [m.row_group(i).num_rows for f in blocks.inputFiles() for m in [ParquetFile(f.removeprefix("file://")).metadata] for i in range(m.num_row_groups)]
    assert sum(groups) > 4 and max(groups) <= 4
    found = ranked_search.search(blocks, spark.createDataFrame([("a", "w5 w900")], "item_id string, text string"))
    assert Counter((r.item_id, r["rank"], r.doc_id, r.score) for r in found.collect()) == ranked(docs, [("a", "w5 w900")])


def test_ranked_search_odd_rows(spark):
    docs = H.odd_docs(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    queries = docs.select(F.col("doc_id").alias("item_id"), "text", "size", "band").filter("length(text) < 3000")
    want = ranked(rows, [(r.item_id, r.text) for r in queries.collect()])
    assert result(ranked_search.search(ranked_search.index(docs), queries), "item_id", "rank", "doc_id", "score") == want
    named = docs.select(F.col("doc_id").cast("string").alias("term"), "text")
    found = ranked_search.search(ranked_search.index(named, key="term"), queries.withColumnRenamed("item_id", "no"), key="no", doc_key="term")
    assert found.columns == ["no", "rank", "term", "score"] and sum(r.score for r in found.collect()) == sum(k[3] * n for k, n in want.items())
    for empty, q in ((docs.limit(0), queries), (docs, queries.limit(0)), (docs.filter("text IS NULL"), queries)):
        assert ranked_search.search(ranked_search.index(empty), q).count() == 0


def test_signature_bounds_never_lie_below_scores():
    r = random.Random(0)
    texts = [" ".join(r.choice("abcdefghijklmnop") * r.randint(1, 2) for _ in range(r.randint(1, 300))) for _ in range(50)]
    import pyarrow as pa
    batch = pa.RecordBatch.from_arrays([pa.array(range(50)), pa.array(texts)], names=["id", "text"])
    for record in ranked_search._index([batch]):
        row = {n: record.column(i)[0] for i, n in enumerate(record.schema.names)}
        block = ranked_search.Searched(row, 50, 7000)
        terms = np.unique(block.term)
        tf = ranked_search.frequencies(block.term, block.tf, block.end - block.size, block.end, terms)
        top = np.zeros_like(tf)
        for (left, bits), add in zip(block.bitmaps(terms), block.adds):
            top[:, left] += bits.T.astype(np.int64) * add[:, None]
        exact = ranked_search.saturated(tf, block.m[:, None])
        assert (top >= exact).all() and (top == 0).any() and (tf > 3).any()


def mined(rows, is_anchor, positives=5, negatives=5):
    """rows: (id, label, vector) -> rows (anchor, positive, rank, negative, scores)."""
    live = []
    for i, label, v in rows:
        if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            live.append((i, label, [math.floor(256 * x) for x in v]))
    order = lambda x: (-x[0], x[1] is None, x[1] or 0)
    out = []
    for i, label, v in live:
        if i is None or not is_anchor(i):
            continue
        scored = [(sum(a * b for a, b in zip(v, w)), j, k) for j, k, w in live]
        good = sorted([x for x in scored if x[2] == label and x[1] != i], key=order)[:positives]
        other = sorted([x for x in scored if x[2] != label], key=order)
        for p in good:
            inside = [x for x in other if 80 * p[0] <= 100 * x[0] <= 100 * p[0]][:negatives]
            out += [(i, p[1], r, x[1], p[0], x[0]) for r, x in enumerate(inside, 1)]
    return Counter(out)


MINED = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


@pytest.mark.parametrize("small", [False, True])
def test_hard_negatives(spark, monkeypatch, small):
    if small:
        for name, value in (("ROW_BLOCK", 16), ("ANCHOR_BLOCK", 3), ("HELD_ROWS", 20)):
            monkeypatch.setattr(hard_negatives, name, value)
    r = random.Random(12)
    rows = [(i, r.randrange(3), [r.choice((-0.5, 0.25, 0.5, r.uniform(-1, 1))) for _ in range(4)]) for i in range(120)]
    rows += [(200 + i, 1, [0.5, 0.5, 0.25, 0.25]) for i in range(30)] + [(300 + i, 2, [0.5, 0.5, 0.25, 0.25]) for i in range(30)]  # equal vectors
    rows += [(400, None, [1.0] * 4), (410, 1, None), (420, 1, [1.0, None, 1.0, 1.0]), (430, 1, [1.0, float("nan"), 1.0, 1.0]), (440, 1, [float("inf")] * 4),
             (450, 1, [0.5, 0.5]), (460, 2, []), (470, 0, [9e5, -7e5, 3.25, 1.0]), (None, 1, [0.5] * 4), (None, 2, [0.5] * 4), (10, 1, [0.25] * 4), (10, 1, [0.25] * 4), (480, 77, [0.5] * 4)]
    df = spark.createDataFrame([(*x, 1, 2, "x", 3) for x in rows], "vec_id long, label int, embedding array<double>, id int, no int, slot string, limits int").repartition(3)
    got = result(hard_negatives.mine(df, F.col("vec_id") % 10 == 0), *MINED)
    want = mined(rows, lambda i: i % 10 == 0)
    assert got == want and len(want) > 150 and any(x[4] == 0 for x in want) and {x[2] for x in want} == {1, 2, 3, 4, 5}


def test_hard_negatives_without_rows(spark):
    df = spark.createDataFrame([(100, 1, [1.0]), (7, 1, [1.0])], "vec_id long, label int, embedding array<float>")
    for rows in (df, df.limit(0), df.filter("vec_id = 7"), df.withColumn("label", F.lit(None).cast("int"))):
        assert hard_negatives.mine(rows, F.col("vec_id") % 100 == 0).count() == 0
    text = spark.createDataFrame([("a", 1, [1.0]), ("b", 1, [1.0]), ("c", 2, [0.9])], "vec_id string, label int, embedding array<float>")
    assert result(hard_negatives.mine(text, F.col("vec_id") == "a"), *MINED) == Counter([("a", "b", 1, "c", 65536, 256 * 230)])


def test_products_beyond_doubles():
    a, b = np.array([[2.0**40, 3.0]]), np.array([[2.0**20, 1.0], [1.0, 5.0]])
    assert hard_negatives.products(a, b).tolist() == [[2**60 + 3, 2**40 + 15]]


def histogram(lengths, capacity):
    return np.bincount(lengths, minlength=capacity + 1).astype(np.int64)


@pytest.mark.parametrize("capacity", [1, 2, 3, 16, 100, 512])
def test_plan_uses_every_piece_once(capacity):
    r = np.random.default_rng(capacity)
    cases = [r.integers(1, capacity + 1, n) for n in (0, 1, 50, 3000)] + [np.full(1000, 1), np.full(777, capacity), np.full(50, max(1, capacity // 2 + 1)),
             np.clip(r.lognormal(math.log(capacity) - 1.5, 1, 5000).astype(int), 1, capacity)]
    for lengths in cases:
        wanted = histogram(lengths, capacity)
        made = packing.plan(wanted)
        used = np.zeros_like(wanted)
        for content, n in made:
            assert n > 0 and 0 < sum(l * t for l, t in content) <= capacity
            for l, t in content:
                used[l] += n * t
        assert (used == wanted).all()
        least = max(-(-int(lengths.sum()) // capacity), int((lengths > capacity / 2).sum()))
        assert sum(n for _, n in made) <= 1.01 * least + 2
        # places: gapless from 0 in every sequence
        table, filled = packing.places(made), {}
        for l in np.flatnonzero(wanted):
            sequence, offset = packing.placed(table, np.full(wanted[l], l), np.arange(wanted[l]))
            for s, o in zip(sequence.tolist(), offset.tolist()):
                filled.setdefault(s, []).append((o, int(l)))
        for parts in filled.values():
            at = 0
            for o, l in sorted(parts):
                assert o == at
                at += l


def test_fit_is_non_negative_least_squares():
    r = np.random.default_rng(3)
    wanted = histogram(r.integers(1, 25, 4000), 24)
    rows = packing.patterns(wanted, 8, 24)
    assert sorted(map(tuple, rows)) == sorted({tuple(sorted(x, reverse=True)) for a in range(25) for b in range(25) for c in range(25)
                                               if sum(x := (a, b, c)) == 24 and max(x) > 8})
    matrix = np.zeros((25, len(rows)))
    for j, row in enumerate(rows):
        for l in row[row > 0]:
            matrix[l, j] += 1
    loss = lambda x: ((matrix @ x - wanted) ** 2).sum()
    x, step = np.zeros(len(rows)), 1 / np.linalg.norm(matrix, 2) ** 2
    for _ in range(20_000):
        x = np.maximum(0, x - step * (matrix.T @ (matrix @ x - wanted)))
    found = packing.fitted(rows, wanted, rounds=2000)
    assert (found >= 0).all() and loss(found) <= loss(x) + 1e-3 * (wanted**2).sum()


SPECIAL = ["<|endoftext|> a<|endoftext|>", "it's  we'll\n\n x", "日本 語  テ😀 é", "a\tb \tc\x1c d", " ", "  ", "tail  ", "   x  　 y", "3.14, (x)--'re 'q'", "word " * 3000, "x" * 5000]


@pytest.mark.skipif(not TOKENIZER.exists(), reason="no vocabulary here")
def test_tokens_like_the_tokenizer():
    import pyarrow as pa
    from tokenizers import Tokenizer
    model, fast = Tokenizer.from_file(str(TOKENIZER)), packing.Tokens(TOKENIZER.read_text())
    r = random.Random(13)
    parts = ["a", "Ab", " ", "  ", "\n", "'s", "'", ".", ",", "1", "é", " ", "　", "語", "\t", "-", "\x1c", "\x85", "ll", "😀"]
    texts = [None, "", *["".join(r.choice(parts) for _ in range(r.randint(0, 30))) for _ in range(3000)]]
    letters = "etaoinshrdluETÀÖØöøÿĀŁȏſ"
    words = ["".join(r.choice(letters) for _ in range(r.randint(1, 12))) for _ in range(5000)]
    texts += [" ".join(r.choice(words) for _ in range(60)) for _ in range(200)]
    assert fast.plain is not None
    for group in (texts, SPECIAL, texts[::-1]):
        ids, at = fast.of(pa.array(group, pa.string()), 0)
        for i, t in enumerate(group):
            assert ids[at[i]: at[i + 1]].tolist() == [*model.encode(t or "", add_special_tokens=False).ids, 0], t


@pytest.mark.skipif(not TOKENIZER.exists(), reason="no vocabulary here")
def test_plain_words_need_a_file_of_the_usual_form():
    import json
    spec = json.loads(TOKENIZER.read_text())
    assert packing.plain_encoder(json.dumps(spec)) is not None
    for change in ({"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True}},
                   {"model": spec["model"] | {"merges": spec["model"]["merges"][::-1]}}, {"model": spec["model"] | {"type": "Unigram"}}):
        assert packing.plain_encoder(json.dumps(spec | change)) is None


@pytest.mark.skipif(not TOKENIZER.exists(), reason="no vocabulary here")
def test_packing(spark):
    from tokenizers import Tokenizer
    model = Tokenizer.from_file(str(TOKENIZER))
    texts = some_texts(14) + SPECIAL
    docs = frame(spark, texts).unionByName(H.odd_docs(spark).select("doc_id", "text", "size", "band"), allowMissingColumns=True)
    for capacity in (64, 2048):
        rows = packing.pack(docs, str(TOKENIZER), capacity=capacity, with_ids=True).collect()
        want = Counter()
        for d in docs.collect():
            ids = [*model.encode(d.text or "", add_special_tokens=False).ids, 0]
            head = (len(ids) - 1) % capacity + 1
            cuts = [0, *range(head, len(ids) + 1, capacity)]
            for piece, (s, e) in enumerate(zip(cuts, cuts[1:])):
                want[d.doc_id, piece, s, e - s, zlib.crc32(np.array(ids[s:e], "<u4").tobytes())] += 1
        assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
        whole = {}
        for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
            assert r.offset == len(whole.setdefault(r.sequence_id, b"")) // 4
            whole[r.sequence_id] += bytes(r.ids)
        assert max(map(len, whole.values())) <= 4 * capacity
        assert len(whole) <= 1.02 * sum(r.length for r in rows) / capacity + 2
    pieces = packing.pack(docs, str(TOKENIZER), with_ids=True)
    joined = {r.sequence_id: r for r in packing.sequences(pieces).collect()}
    want = Counter()
    for r in pieces.collect():
        want[r.sequence_id] += r.length
        at = r.offset * 4
        assert bytes(joined[r.sequence_id].ids)[at: at + 4 * r.length] == bytes(r.ids)
    assert {k: v.n_tokens for k, v in joined.items()} == want
    renamed = docs.select(F.col("doc_id").cast("string").alias("length"), F.col("text").alias("_rank"), F.lit(1).alias("piece"))
    assert packing.pack(renamed.limit(0), str(TOKENIZER), text="_rank", key="length").count() == 0


def test_blocks_of_the_index_stay_small():
    """A task holds a block's arrays in memory, at indexing and again at searching."""
    import pyarrow as pa

    from paysieve.llm import ranked_search

    texts = [" ".join(f"w{(i * 31 + j * 7) % 5000}" for j in range(100)) for i in range(6_000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(6_000), pa.int64()), pa.array(texts)], names=["id", "text"])
    made = list(ranked_search._index([batch]))
    docs, sizes = ([x for b in made for x in b.column(b.schema.get_field_index(c)).to_pylist()] for c in ("n_docs", "term"))
    assert sum(docs) == 6_000 and max(docs) < 2 * 2_048  # one slice of texts more than full
    assert max(len(s) for s in sizes) < 2 * 8 * 2_048 * 128
