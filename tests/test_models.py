"""Fitted models: bounds on data where the answer is known."""

import numpy as np
from pyspark.sql import functions as F

from paysieve.operators import isolation as I
from paysieve.operators import metrics as M
from paysieve.operators import models as L
from paysieve.operators import nearest as NN


def _rows(spark, n=600):
    return spark.range(n).select(
        F.col("id").alias("event_id"), F.col("id").alias("us"), (F.col("id") % 10 == 0).cast("int").alias("is_fraud"),
        ((F.col("id") * 37) % 100 / 100.0 + F.when(F.col("id") % 10 == 0, 3.0).otherwise(0.0)).alias("x"),
        ((F.col("id") * 53) % 100 / 100.0).alias("y"))


def test_trees_and_calibration_separate(spark):
    df = _rows(spark)
    scored = L.gbdt_scores(L.fit_gbdt(df, ["x", "y"], iterations=3), df)
    out = L.platt_scores(L.platt(scored), scored)
    assert M.roc_auc(out).first()["roc_auc"] > 0.99
    assert out.filter("score < 0 OR score > 1").count() == 0


def test_outliers_score_higher(spark):
    df = _rows(spark)
    out = I.isolation_scores(I.fit_isolation(df, ["x", "y"], trees=16, sample_rows=64), df, by_batch=True)
    assert M.roc_auc(out, score="anomaly").first()["roc_auc"] > 0.8


def test_resampled_columns_keep_their_margins(spark, small_tasks):
    df = _rows(spark, 50)
    out = L.row_independent_baseline(df, ["x", "y"])
    for c in ("x", "y"):
        assert sorted(r[0] for r in out.select(c).collect()) == sorted(r[0] for r in df.select(c).collect())


def test_forest_has_its_whole_size(spark):
    """200 trees over all rows of a table that is smaller than a sample, here and in a detector unless told otherwise."""
    df = _rows(spark)
    model = I.fit_isolation(df, ["x", "y"])
    assert (model.trees, model.sample_size) == (200, 600)
    assert M.roc_auc(I.isolation_scores(model, df, by_batch=True), score="anomaly").first()["roc_auc"] > 0.8
    df = df.withColumn("amount_c", F.lit(1000))
    few = L.fit_detector(df, df, ["x", "y"], iterations=2, isolation_trees=8, isolation_rows=128).isolation
    assert (few.trees, few.sample_size) == (8, 128)


def test_every_tree_takes_its_whole_sample(spark):
    """Also where rows are dealt by hash: a node's path tells the rows of a tree that cannot be cut."""
    df = spark.range(4000).select(F.col("id").alias("event_id"), F.lit(1.0).alias("x"))
    roots = [np.frombuffer(r["nodes"], I.NODE)["value"][0] for r in I.fit_isolation(df, ["x"], trees=7, sample_rows=100).nodes.collect()]
    assert roots == [float(I._expected_path(100))] * 7
    assert np.isclose(I._grow(np.array([[0.0], [1.0]]), 3)["value"][1:], 1.0).all()


def test_forest_in_parts_scores_like_a_whole_one(spark):
    """Trees dealt to tasks, rows dealt by salt: the same scores, all columns and rows there."""
    df = _rows(spark).withColumn("x", F.when(F.col("event_id") % 7 > 0, F.col("x"))).repartition(3)
    model = I.fit_isolation(df, ["x", "y"], trees=11, sample_rows=64)
    whole = {r.event_id: r["s"] for r in I._raw_scores(model, df, "s").collect()}
    parts = I._scores_by_parts(model, df, "s", 3, part_rows=100)
    assert parts.columns == [*df.columns, "s"]
    got = {r.event_id: r["s"] for r in parts.collect()}
    assert got.keys() == whole.keys() and max(abs(got[k] - whole[k]) for k in got) < 1e-12
    assert I._raw_scores(model, df, "s", part_mb=0.004).count() == 600


def test_logistic_scores_are_the_models_own_without_functions_in_the_plan(spark):
    df = spark.range(400).selectExpr("id AS event_id", "id / 400.0D AS a", "(id * 37 % 400) / 400.0D AS b", "CAST(id + id * 37 % 400 > 420 AS INT) AS is_fraud")
    blend, curve = L.stack(df, ["a", "b"]), L.platt(df, margin="a")
    for model, out, own in ((blend, L.stack_scores(blend, df), "_sp"), (curve, L.platt_scores(curve, df), "_pp")):
        assert "UDF" not in out._jdf.queryExecution().optimizedPlan().toString()
        want = {r["event_id"]: float(r[own][1]) for r in model.transform(df).collect()}
        assert all(abs(r["score"] - want[r["event_id"]]) < 1e-12 for r in out.collect())


def test_isotonic_scores_are_the_models_own_without_functions_in_the_plan(spark):
    """Before the first step, on steps, between them and after the last; a row without a margin has no score."""
    df = spark.range(300).selectExpr("id AS event_id", "CASE WHEN id <> 7 THEN (id * 37 % 300) / 300.0D - 0.5D END AS _margin", "CAST(id * 37 % 300 + id % 90 > 190 AS INT) AS is_fraud")
    model = L.isotonic(df.filter("_margin BETWEEN -0.4 AND 0.4"))
    out = L.isotonic_scores(model, df, "iso")
    assert out.columns == [*df.columns, "iso"] and "UDF(" not in out._jdf.queryExecution().optimizedPlan().toString()
    known = df.filter("_margin IS NOT NULL").withColumn("_ix", F.col("_margin"))
    want = {r["event_id"]: r["_ip"] for r in model.transform(known).collect()}
    got = {r["event_id"]: r["iso"] for r in out.collect()}
    assert got.pop(7) is None and got.keys() == want.keys() and len(set(want.values())) > 3
    assert all(abs(got[k] - min(max(want[k], 0.0), 1.0)) < 1e-12 for k in want)


def test_rows_go_through_the_forest_once(spark, monkeypatch):
    """Percentiles and scores come from one pass; they are those of a model fitted first; trees are unpacked once a task."""
    df = _rows(spark).coalesce(1)
    model = I.fit_isolation(df, ["x", "y"], trees=9, sample_rows=64)
    first = I.with_percentiles(model, df)
    want = {r["event_id"]: r["anomaly"] for r in I.isolation_scores(first, df).collect()}
    passes, raw = [], I._raw_scores
    monkeypatch.setattr(I, "_raw_scores", lambda *a, **kw: passes.append(1) or raw(*a, **kw))
    fitted, out = I.fitted_scores(model, df)
    assert (fitted.low, fitted.high) == (first.low, first.high) and out.columns == [*df.columns, "anomaly"]
    assert {r["event_id"]: r["anomaly"] for r in out.collect()} == want and len(passes) == 1


def test_paths_are_those_of_each_row_alone():
    r = np.random.default_rng(5)
    tree = I._grow(r.normal(size=(300, 3)).round(1), 4)
    x = np.vstack([r.normal(size=(200, 3)), [[np.inf, -np.inf, 0.0]]])

    def alone(row, at=0):
        node = tree[at]
        return node["value"] if node["feature"] < 0 else alone(row, node["left"] + int(row[node["feature"]] > node["value"]))

    assert np.array_equal(I._paths([I._unpacked(tree.tobytes())] * 2, x), [2 * alone(row) for row in x])
    leaf = I._grow(np.zeros((4, 3)), 1)
    assert np.array_equal(I._paths([I._unpacked(leaf.tobytes())], x), np.full(len(x), leaf["value"][0]))


def test_nearest_distance_equals_all_pairs(spark):
    r = np.random.default_rng(2)
    known, rows = r.normal(size=(70, 3)), np.vstack([r.normal(size=(150, 3)), r.normal(size=(1, 3)) + 1e4])
    rows[3] = known[5]
    frame = lambda a: spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(a)], "_id long, a double, b double, c double").coalesce(1)
    got = [x["distance"] for x in L.nearest_distance(frame(known), frame(rows), ["a", "b", "c"], block=16).orderBy("_id").collect()]
    assert np.allclose(got, np.sqrt(((rows[:, None] - known[None]) ** 2).sum(axis=2)).min(axis=1), rtol=1e-12, atol=0) and got[3] == 0.0
    assert L.nearest_distance(frame(known[:0]), frame(rows), ["a", "b", "c"]).first()["distance"] == float("inf")


def test_nearest_distance_over_many_boxes_and_parts(spark, monkeypatch):
    """Rows near the edges of boxes, far outside, repeated points and ids: each row has its own exact distance."""
    monkeypatch.setattr(NN, "BOX_ROWS", 500)
    monkeypatch.setattr(NN, "PART_ROWS", 120)
    r = np.random.default_rng(4)
    known = np.column_stack([r.normal(size=4000) ** 3, r.integers(0, 3, 4000), r.normal(size=4000)])
    known = np.vstack([known, known[:50], np.zeros((300, 3))])
    rows = np.vstack([known[100:400] + r.normal(size=(300, 3)) * 0.05, r.normal(size=(300, 3)) * 4, [[1e4, -50.0, 3.0]], known[17:18]])
    want = np.sqrt(((rows[:, None] - known[None]) ** 2).sum(axis=2)).min(axis=1)
    frame = lambda a, key: spark.createDataFrame([(key(i), *map(float, v)) for i, v in enumerate(a)], "_id string, a double, b double, c double")
    met = []
    monkeypatch.setattr(NN, "_met", lambda *a, f=NN._met: met.append(a[0].select("_box").distinct().count()) or f(*a))
    got = L.nearest_distance(frame(known, str), frame(rows, lambda i: str(i // 2)), ["a", "b", "c"]).collect()
    by_id = {i: sorted(x["distance"] for x in got if x["_id"] == str(i)) for i in range(len(rows) // 2)}
    assert len(got) == len(rows) and all(np.array_equal(by_id[i], sorted(want[2 * i: 2 * i + 2])) for i in by_id)
    assert len(met) == 2 and min(met) > 2  # rows met more boxes than their own


def test_membership_takes_every_batch_row(spark):
    """The members are copies of batch rows beyond any fixed number of them."""
    batch = spark.range(9001).selectExpr("id AS _id", "id * 1.0D AS a", "CAST(id % 2 AS DOUBLE) AS b")
    reference = batch.withColumn("a", F.when(L.is_member("_id"), F.col("a")).otherwise(F.col("a") + 0.25))
    got = L.membership_auc(batch, reference).first()
    assert (got["mia_auc"], got["shadow"], got["members"] + got["others"]) == (1.0, 9001, 9001)
