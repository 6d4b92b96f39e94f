"""Node tables, the choice of the round, the graph channel and contributions."""

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from paysieve.operators import metrics as M
from paysieve.operators import models as L
from paysieve.operators import trees as T

X = ["x", "y", "z"]


def rows(spark, n=900, seed=1):
    r = np.random.default_rng(seed)
    x, y, z = r.normal(size=(3, n))
    label = (x * y + 0.3 * z + r.normal(size=n) * 0.7 > 0.8).astype(int)
    data = [(i, i, i % 30, int(l), float(a), float(b), None if i % 50 == 0 else float(c), 1000) for i, (a, b, c, l) in enumerate(zip(x, y, z, label))]
    return spark.createDataFrame(data, "event_id long, us long, payee long, is_fraud int, x double, y double, z double, amount_c long").coalesce(2).persist()


@pytest.fixture(scope="module")
def slices(spark):
    df = rows(spark)
    return df.filter("event_id < 600"), df.filter("event_id >= 600")


def refit(train, rounds):
    """One fit of so many rounds by the trainer alone, and its own margins."""
    y = F.col("is_fraud").cast("double")
    p, n = train.agg(F.sum(y), F.count("*")).first()
    marked = train.withColumn("_y", y).withColumn("_w", F.when(F.col("_y") == 1, F.lit((n - p) / p)).otherwise(1.0))
    design = VectorAssembler(inputCols=X, outputCol="_x")
    marked = marked.fillna(0.0)
    model = GBTClassifier(featuresCol="_x", labelCol="_y", weightCol="_w", maxIter=rounds, maxDepth=5, seed=42, maxMemoryInMB=1024, stepSize=0.1, subsamplingRate=0.8).fit(design.transform(marked))
    return lambda df: model.transform(design.transform(df.fillna(0.0))).withColumn("m", vector_to_array("rawPrediction")[1])


def test_table_scores_like_the_trainer(slices):
    train, valid = slices
    model = L.fit_gbdt(train, X, iterations=7)
    assert model.table.rounds == 7 and abs(sum(model.importances) - 1) < 1e-9
    own = {r.event_id: r for r in L.gbdt_scores(model, valid).collect()}
    for r in refit(train, 7)(valid).select("event_id", "m", vector_to_array("probability")[1].alias("p")).collect():
        assert own[r.event_id]._margin == pytest.approx(r.m, abs=1e-9) and own[r.event_id].gbdt == pytest.approx(r.p, abs=1e-9)


def test_round_is_that_of_a_refit_loop(slices):
    """The kept round and all measured ones equal fits of 1, 2, 3 ... rounds, stopped by the same rule."""
    train, valid = slices
    model = L.fit_gbdt(train, X, validation=valid, iterations=12, patience=3)
    want, best = [], 0
    for rounds in range(1, 13):
        want.append((rounds, M.average_precision(refit(train, rounds)(valid), score="m").first()[0]))
        if want[-1][1] > want[best][1]:
            best = rounds - 1
        elif rounds - 1 - best >= 3:
            break
    assert model.table.rounds == want[best][0]
    assert [m[0] for m in model.measured] == [w[0] for w in want]
    assert [m[1] for m in model.measured] == pytest.approx([w[1] for w in want], abs=1e-9)
    assert model.measured[model.table.rounds - 1][1] == max(m[1] for m in model.measured)


def test_kept_round():
    assert L.kept_round([(1, 0.1), (2, 0.3), (3, 0.3), (4, 0.2), (5, 0.9)], 2) == 2
    assert L.kept_round([(1, 0.1), (2, 0.3), (3, 0.3), (4, 0.2), (5, 0.9)], 3) == 5
    assert L.kept_round([(1, 0.0)], 3) == 1 and L.kept_round([], 3) == 1


def test_contributions_sum_to_the_margin(slices):
    train, valid = slices
    model = L.fit_gbdt(train, X, iterations=6)
    seen = np.zeros(3)
    for r in L.tree_contributions(model, valid).collect():
        parts = np.array([r.by_x, r.by_y, r.by_z])
        seen += abs(parts)
        assert model.table.base() + parts.sum() == pytest.approx(r._margin, abs=1e-9)
    assert (seen > 0).all()


def test_one_tree_contributions_by_hand():
    table = T.TreeTable(np.array([0]), np.array([2.0]), np.array([0, -1, 1, -1, -1]), np.array([1.5, 0, 0.0, 0, 0]), np.array([1, -1, 3, -1, -1]),
                        np.array([2, -1, 4, -1, -1]), np.array([0.1, -1.0, 0.5, 0.2, 0.9]))
    x = np.array([[1.0, 5.0], [2.0, 5.0], [2.0, -5.0], [np.nan, np.nan]])
    assert np.allclose(table.margins(x), [-2.0, 1.8, 0.4, 1.8]) and table.base() == 0.2
    assert np.allclose(table.contributions(x), [[-2.2, 0], [0.8, 0.8], [0.8, -0.6], [0.8, 0.8]])


def detector(train, valid, **kw):
    return L.fit_detector(train, valid, ["x", "y"], iterations=6, isolation_trees=4, isolation_rows=64, graph_rounds=6, **kw)


def test_graph_channel_is_kept_by_its_lift(spark, slices):
    """A column that tells the label through the payee lifts the stack; a useless one goes."""
    train, valid = (s.withColumn("payee", F.col("is_fraud") * 30 + F.col("payee")).withColumn("fan", F.col("payee").cast("double")) for s in slices)
    good = detector(train, valid, graph_columns=["fan"], graph_key="payee")
    assert good.channels == ["gbdt_p", "graph", "anomaly"] and good.measured["graph_lift"] >= 0.03 and good.measured["graph_kept"] == 1
    assert M.average_precision(L.score(good, valid)).first()[0] > 0.99
    train, valid = (s.withColumn("fan", F.lit(1.0)) for s in slices)
    bad = detector(train, valid, graph_columns=["fan"], graph_key="payee")
    assert bad.channels == ["gbdt_p", "anomaly"] and bad.graph is None and bad.measured["graph_lift"] < 0.03
    scored = L.channel_scores(bad, valid)
    assert "graph" not in scored.columns and scored.count() == valid.count()


def test_detectors_score_without_functions_in_the_plan(slices):
    """Fitting may run the trainer's function objects; calibrated channels and their blend are arithmetic on what was fitted."""
    train, valid = (s.withColumn("fan", F.col("payee").cast("double")) for s in slices)
    made = detector(train, valid, graph_columns=["fan"], graph_key="payee", bar=-1.0)
    assert made.graph is not None
    for out in (L.channel_scores(made, valid), L.score(made, valid)):
        assert "UDF(" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_blind_cohort_must_be_disjoint(spark, slices):
    train, valid = slices
    with pytest.raises(ValueError, match="event_id"):
        detector(train, valid, blind=valid.limit(3), blind_keys=["event_id"])
    with pytest.raises(ValueError, match="payee"):
        L.assert_blind_disjoint(train, valid.withColumn("event_id", F.col("event_id") + 10_000), ["event_id", "payee"])
    L.assert_blind_disjoint(train, valid, ["event_id"])
    L.assert_blind_disjoint(train, None)


def test_histories_restart_at_cuts(spark):
    from paysieve.operators.windows import pit_count

    df = spark.range(20).select(F.col("id").alias("event_id"), (F.col("id") * 10).alias("us"), (F.col("id") % 2).alias("key"))
    out = L.restart_at(df, [70, 140], lambda part: pit_count(part, ["key"], "us", 1000, F.lit(1)))
    got = {r.event_id: r.cnt for r in out.collect()}
    for i in range(20):
        low = 0 if i < 7 else 7 if i < 14 else 14
        assert got[i] == sum(1 for j in range(low, i) if j % 2 == i % 2)


def test_twice_the_rounds_are_fitted_again_and_scopes_side_by_side(spark, slices, monkeypatch):
    """Rounds fitted in all stay below four times those needed; the parties' detectors are fitted at the same time, in their order."""
    import threading

    train, valid = slices
    fitted, trainer = [], L.GBTClassifier
    monkeypatch.setattr(L, "GBTClassifier", lambda **kw: fitted.append(kw["maxIter"]) or trainer(**kw))
    monkeypatch.setattr(L, "kept_round", lambda measured, patience: min(len(measured), 5))
    model = L.fit_gbdt(train, X, validation=valid, iterations=40, patience=2)
    assert fitted == [4, 8] and model.table.rounds == 5
    together = threading.Barrier(2, timeout=60)
    monkeypatch.setattr(L, "MIN_SCOPE_ROWS", 10)
    monkeypatch.setattr(L, "fit_detector", lambda *a, **kw: together.wait())
    monkeypatch.setattr(L, "score", lambda detector, df: df.withColumn("score", F.col("x")))
    train, valid = (s.withColumn("issuer_id", F.lit(0)) for s in slices)
    status, scores = L.scope_matrix(train, valid, valid, X, {"NETWORK": None, "ISSUER": 0})
    assert [r["scope"] for r in status.collect()] == ["NETWORK", "ISSUER"] and [r["scope"] for r in scores.collect()] == ["NETWORK", "ISSUER"]


def test_equal_rows_are_counted_once(spark, slices, monkeypatch):
    """Beyond a size a round costs what the different rows cost: copies change only counts, and scores need the features alone."""
    train, valid = slices
    cuts = T.cut_points(train.select(*[T.number(f).alias(f) for f in X]), X)
    assert all(len(c) == T.BINS - 1 for c in cuts)
    copies = train.crossJoin(spark.range(7).select("id")).drop("id")
    once, often = (T.counted(d, X, cuts, "is_fraud") for d in (train, copies))
    assert once.count() == often.count() and often.agg(F.sum("_rows")).first()[0] == 7 * train.count()
    few = train.select(F.col("payee").alias("a"), F.lit(1.0).alias("b"))
    assert [len(c) for c in T.cut_points(few, ["a", "b"])] == [29, 0]

    fitted, trainer = [], L.VectorAssembler.transform
    monkeypatch.setattr(L.VectorAssembler, "transform", lambda self, df: fitted.append(df.count()) or trainer(self, df))
    monkeypatch.setattr(L, "COUNTED_FROM", 500)
    plain, many = (L.fit_gbdt(d, X, validation=valid, iterations=12) for d in (train, copies))
    assert fitted == [once.count()] * 2
    assert many.table.rounds > 1 and [m[0] for m in many.measured] == list(range(1, 13))
    for model in (plain, many):  # as measured over counted rows, so over the rows themselves
        scored = L.gbdt_scores(model, valid)
        assert M.average_precision(scored, score="_margin").first()[0] == pytest.approx(model.measured[model.table.rounds - 1][1], abs=1e-12)
    monkeypatch.setattr(L, "COUNTED_FROM", 10_000)
    exact = L.fit_gbdt(train, X, validation=valid, iterations=12)
    assert plain.measured[-1][1] == pytest.approx(exact.measured[-1][1], abs=0.08)


def test_the_last_doubling_goes_to_the_end(slices, monkeypatch):
    """A fit that would end shortly before all rounds is not made only to be made again."""
    train, valid = slices
    fitted, trainer = [], L.GBTClassifier
    monkeypatch.setattr(L, "GBTClassifier", lambda **kw: fitted.append(kw["maxIter"]) or trainer(**kw))
    monkeypatch.setattr(L, "kept_round", lambda measured, patience: len(measured))
    assert L.fit_gbdt(train, X, validation=valid, iterations=11, patience=1).table.rounds == 11
    assert fitted == [2, 4, 11]
    monkeypatch.setattr(L, "LONG_FROM", 100)
    assert L.fit_gbdt(train, X, validation=valid, iterations=10, patience=1).table.rounds == 10
    assert fitted == [2, 4, 11, 2, 10]
