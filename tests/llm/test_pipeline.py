from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from paysieve.llm import quality_rules

from . import helpers as H
from .test_operators import fair_targets

SF = Path("/root/testdata/sf0.001")


def brute(rows, items):
    """The stages one after another: rows are dicts of documents."""
    rules = dict(quality_rules.RULES)

    def accepted(text):
        names = dict(zip(quality_rules.MEASURES, H.measures(text)))
        return not any(eval(rules[r].replace(" AND ", " and ").replace(" OR ", " or ").replace(" DIV ", " // "), {}, names) for r in quality_rules.POLICIES["v2"])

    rows = [r for r in rows if accepted(r["text"])]
    for r, (_, dropped, kept) in zip(rows, H.without_lines([(r["doc_id"], r["text"]) for r in rows])):
        r["text"] = kept if dropped else r["text"]
    classes = H.near_classes([(r["doc_id"], r["text"]) for r in rows])
    rows = [r for r in rows if classes[r["doc_id"]] == r["doc_id"]]
    out = []
    for r, (n, hit, _) in zip(rows, H.benchmark_hits([r["text"] for r in rows], items)):
        if len(hit) <= 0.25 * n:
            found = list(H.NORMAL.finditer(H.lower(r["text"])))
            pieces, begin, i = [], 0, 0
            while i < len(found):
                if i in hit:
                    pieces.append(r["text"][begin: found[i].start()])
                    while i + 1 in hit:
                        i += 1
                    begin = found[i].end()
                i += 1
            out.append(r | {"text": "".join([*pieces, r["text"][begin:]])})
    return out


def test_stages_equal_a_plain_version(spark):
    if not SF.exists():
        pytest.skip("driver tables not present")
    read = lambda name: spark.read.parquet(f"{SF}/{name}.parquet")
    rows = [r.asDict() for r in read("documents").collect()]
    items = [(str(r.item_id), r.text) for r in read("benchmark").collect()]
    want = brute(rows, items)
    docs = read("documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(SF))
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), docs.schema)
    got = docs.collect()
    assert {r.doc_id: r.text for r in got} == {r["doc_id"]: r["text"] for r in want} and len(got) == len(want)
    assert all(r.n_chars == len(r.text) for r in got)
    sizes = {}
    for r in want:
        sizes[r["source"]] = sizes.get(r["source"], 0) + len(H.words(r["text"]))
    targets, taken = fair_targets(sizes), {}
    for r in corpus_pipeline.mixed(spark, docs, str(SF)).collect():
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert all(targets[s] - 1 - 1e-6 <= taken[s] <= targets[s] + 1e-6 for s in sizes)


def test_run_gives_the_mix_of_what_is_left(spark):
    if not SF.exists():
        pytest.skip("driver tables not present")
    out = corpus_pipeline.run(spark, str(SF))
    assert out.count() > 0 and out.agg(F.sum("taken")).first()[0] > 0
