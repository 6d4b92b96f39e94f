"""Detectors on MLlib: boosted trees, calibration, stacking, and the layers that fit a model."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import IsotonicRegression
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paysieve.operators import isolation as I
from paysieve.operators import metrics as M
from paysieve.operators.realism import _standardised, numeric_view, verdict
from paysieve.operators import trees as T
from paysieve.operators.graph import neighbour_aggregate
from paysieve.operators.nearest import nearest_distance
from paysieve.operators.splits import balanced_sample, downsample_negatives, positional_cut
from paysieve.operators.validation import SCOPE_MASKS, assert_no_leakage, party_view
from paysieve.plans.durable import durable, ensure_checkpoint_dir, stored
from paysieve.plans.scan import rank_in_group
from paysieve.plans.skew import for_rounds

# Sizes of the reference's ensembles, and rounds without a better one that end boosting.
ROUNDS, COMPARED_ROUNDS, GRAPH_ROUNDS, PATIENCE = 600, 300, 300, 32
MIN_POSITIVES = 30
# End of fixed values.
MIN_SCOPE_ROWS, MIN_SCOPE_POSITIVES = 2_000, 2
# How far a scope came.
FITTED, TOO_FEW_ROWS, TOO_FEW_POSITIVES, NO_EVALUATION_FRAUD = "fitted", "too_few_rows", "too_few_positives", "no_fraud_in_evaluation_window"
# End of fixed values.
DATA_ERRORS = (ValueError, KeyError, ZeroDivisionError, AnalysisException)  # what a table can cause; other errors are faults of the code
TRANSFER_MIN_RATIO = 0.90
UTILITY_CATEGORIES = ("rail", "currency", "pos_entry_mode")
DISCRIMINATOR_MAX, SIGMAS = 0.65, 3.0
MIN_UTILITY_ROWS, MIN_DISCRIMINATOR_ROWS = 200, 400
MEMBERSHIP_MIN, MEMBERSHIP_MAX, MEMBERSHIP_ROWS = 0.50, 0.55, 5_000
MODEL_MEMORY_MB = 1024
LONG_FROM = 200_000  # rows from which a round's time grows with them
COUNTED_FROM = 1_000_000  # rows; fewer cost a round little beside its fixed cost, and stay as they are


@dataclass(frozen=True)
class Boosted:
    """The kept rounds of boosted trees, the features' importances, and (round, average precision) as measured."""

    features: tuple[str, ...]
    table: T.TreeTable
    importances: tuple[float, ...]
    measured: tuple[tuple[int, float], ...] = ()


@dataclass(frozen=True)
class Detector:
    """Fitted channels, the stacked model, the threshold and what the fit measured."""

    features: tuple[str, ...]
    gbdt: Boosted
    platt: PipelineModel
    isolation: I.IsolationModel | None = None
    stack: PipelineModel | None = None
    threshold: float = 0.5
    measured: Mapping[str, float] = field(default_factory=dict)
    graph: Boosted | None = None
    graph_columns: tuple[str, ...] = ()
    graph_key: str = ""

    @property
    def channels(self) -> list[str]:
        return ["gbdt_p", *(["graph"] if self.graph else []), *(["anomaly"] if self.isolation else [])]


def fit_gbdt(train: DataFrame, features: Sequence[str], label="is_fraud", validation: DataFrame | None = None,
             iterations=ROUNDS, depth=5, seed=42, weigh_positives=True, patience=PATIENCE) -> Boosted:
    """Boosted trees with positives weighted by neg/pos.

    With validation rows the round of the best average precision there is kept, the first of equals; boosting ends
    once ``patience`` rounds have brought nothing better. The trainer can't be halted from outside, but its first rounds do
    not depend on how many follow, so it is run for 2 x patience rounds first and for twice as many as long as that is needed: doubling
    keeps the rounds fitted in all at about four times the rounds needed. Where twice as many come close to ``iterations``, all of
    these are fitted at once, from LONG_FROM rows on, where rounds are dear, a step earlier: 792 rounds at most for 600 instead of 1,560.
    Rows beyond COUNTED_FROM are counted by their bins first, so that a round costs no more than the different rows do.
    """
    y = F.col(label).cast("double")
    plain = train.select(*[T.number(f).alias(f) for f in features], y.alias("_y")).persist()
    different = points = judged = cuts = None
    try:
        counts = plain.agg(F.sum("_y").alias("p"), F.count(F.lit(1)).alias("n")).first()
        positives = counts["p"] or 0
        if weigh_positives and positives < MIN_POSITIVES:
            raise ValueError(f"only {int(positives)} positives in the training rows; {MIN_POSITIVES} are needed")
        weight = max((counts["n"] - positives) / max(positives, 1), 1.0) if weigh_positives else 1.0
        balance = F.when(F.col("_y") == 1, F.lit(float(weight))).otherwise(F.lit(1.0))
        ensure_checkpoint_dir(train.sparkSession)  # the trainer cuts its lineage there
        if counts["n"] > COUNTED_FROM:
            cuts = T.cut_points(plain, features)
            different = T.counted(plain, features, cuts, "_y").persist()
            rows, marked = different.count(), different.withColumn("_w", balance * F.col("_rows"))
        else:
            rows, marked = counts["n"], plain.withColumn("_w", balance)
        assembler = VectorAssembler(inputCols=list(features), outputCol="_x")
        points = assembler.transform(for_rounds(marked, rows)).select("_x", "_y", "_w").persist()

        def boosted(rounds: int):
            trees = GBTClassifier(featuresCol="_x", labelCol="_y", weightCol="_w", maxIter=rounds, maxDepth=depth, seed=seed, maxBins=T.BINS,
                                  maxMemoryInMB=MODEL_MEMORY_MB, stepSize=0.1, subsamplingRate=0.8)
            model = trees.fit(points)
            return T.tree_table(model, train.sparkSession), tuple(float(x) for x in model.featureImportances.toArray())

        def final(table: T.TreeTable) -> T.TreeTable:
            return table if cuts is None else T.with_cuts(table, cuts)

        if validation is None:
            table, importances = boosted(iterations)
            return Boosted(tuple(features), final(table), importances)
        measured, rounds = [], min(iterations, 2 * patience)
        if cuts is None:
            judged = validation.select(F.col(label), *[T.number(f).alias(f) for f in features if f != label])
            judged = for_rounds(judged, validation.count()).persist()
        else:
            judged = T.counted(validation, features, cuts, label).persist()
        while True:
            table, importances = boosted(rounds)
            found = T.round_quality(judged, table, features, label, len(measured), None if cuts is None else "_rows").collect()  # one row per round
            measured += sorted((r["round"], r["average_precision"] or 0.0) for r in found)
            kept = kept_round(measured, patience)
            if rounds >= iterations or kept + patience <= rounds:
                return Boosted(tuple(features), final(table.first(kept)), importances, tuple(measured[: kept + patience]))
            rounds = 2 * rounds if (3 if rows < LONG_FROM else 5) * rounds < iterations else iterations
    finally:
        for held in (plain, different, points, judged):
            if held is not None:
                held.unpersist()


def kept_round(measured: Sequence[tuple[int, float]], patience: int) -> int:
    """The first best round, looking no further than ``patience`` rounds beyond the best so far."""
    best = 0
    for i, (_, quality) in enumerate(measured):
        if quality > measured[best][1]:
            best = i
        elif i - best >= patience:
            break
    return measured[best][0] if measured else 1


def gbdt_scores(model: Boosted, df: DataFrame, name="gbdt", margin="_margin") -> DataFrame:
    """Adds the probability and the margin (weighted sum of trees)."""
    out = T.with_margin(df, model.table, model.features, margin)
    return out.withColumn(name, 1 / (1 + F.exp(-2 * F.col(margin))))


def tree_contributions(model: Boosted, df: DataFrame, prefix="by_", margin="_margin") -> DataFrame:
    """Adds one column per feature, what its splits add to the margin on the row's paths; they sum to margin less base."""
    return T.with_contributions(df, model.table, model.features, [f"{prefix}{f}" for f in model.features], margin)


def platt(scored: DataFrame, label="is_fraud", margin="_margin") -> PipelineModel:
    """Logistic curve on the margin, fitted on rows the trees did not see."""
    data = scored.select(margin, F.col(label).cast("double").alias("_y"))
    lr = LogisticRegression(featuresCol="_mx", labelCol="_y", probabilityCol="_pp", rawPredictionCol="_pr", predictionCol="_pc")
    return Pipeline(stages=[VectorAssembler(inputCols=[margin], outputCol="_mx"), lr]).fit(data)


def _logistic(model: PipelineModel, columns: Sequence[str]) -> Column:
    """The fitted curve as a column: plain arithmetic on the coefficients, so that no function object travels in the plan."""
    fitted = model.stages[-1]
    line = F.lit(float(fitted.intercept))
    for c, w in zip(columns, fitted.coefficients.toArray()):
        line = line + F.col(c) * float(w)
    return 1 / (1 + F.exp(-line))


def platt_scores(model: PipelineModel, scored: DataFrame, name="score") -> DataFrame:
    return scored.withColumn(name, _logistic(model, model.stages[0].getInputCols()))


def isotonic(scored: DataFrame, label="is_fraud", margin="_margin"):
    data = scored.select(F.col(margin).alias("_ix"), F.col(label).cast("double").alias("_y"))
    return IsotonicRegression(featuresCol="_ix", labelCol="_y", predictionCol="_ip").fit(data)


def isotonic_scores(model, scored: DataFrame, name="score", margin="_margin") -> DataFrame:
    """Adds the fitted steps' value at the margin, straight lines between them; no function object of the trainer travels in the plan."""
    import numpy as np
    import pyarrow as pa

    at, value = model.boundaries.toArray(), model.predictions.toArray()
    place = scored.columns.index(margin)

    def run(batches):
        for batch in batches:
            x = batch.column(place).cast(pa.float64())
            known = np.asarray(x.is_valid())
            made = np.clip(np.interp(np.asarray(x.fill_null(0.0)), at, value), 0.0, 1.0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, mask=~known)], names=[*batch.schema.names, name])

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in scored.schema.fields], f"`{name}` double"])
    return scored.mapInArrow(run, schema)


def compare_calibrators(df: DataFrame, features: Sequence[str], at="Time", tie="row_id", label="Class",
                        train_fraction=0.6, validation_fraction=0.2, iterations=COMPARED_ROUNDS) -> DataFrame:
    """(method, average_precision, roc_auc, brier, ece, worst_bin, saturated) on one later slice."""
    train, rest = positional_cut(df, at, tie, train_fraction)
    valid, test = positional_cut(rest, at, tie, validation_fraction / (1 - train_fraction))
    trees = fit_gbdt(train, features, label, iterations=iterations)
    on_valid, on_test = durable(gbdt_scores(trees, valid, "p")), durable(gbdt_scores(trees, test, "p"))
    scored = {
        "uncalibrated": on_test.withColumn("s", F.col("p")),
        "sigmoid": platt_scores(platt(on_valid, label), on_test, "s"),
        "isotonic": isotonic_scores(isotonic(on_valid, label), on_test, "s"),
    }
    rows = None
    for method, part in scored.items():
        part = part.select(F.lit(method).alias("method"), F.col(label).alias("_l"), "s")
        rows = part if rows is None else rows.unionByName(part)
    quality = M.ranking_summary(rows, "_l", "s", ["method"]).drop("recall_at_precision")
    return quality.join(M.calibration(rows, 10, "_l", "s", ["method"]), "method")


def stack(df: DataFrame, channels: Sequence[str], label="is_fraud") -> PipelineModel:
    """Logistic blend of channel scores."""
    data = df.select(*channels, F.col(label).cast("double").alias("_y"))
    lr = LogisticRegression(featuresCol="_sx", labelCol="_y", probabilityCol="_sp", rawPredictionCol="_sr", predictionCol="_sc")
    return Pipeline(stages=[VectorAssembler(inputCols=list(channels), outputCol="_sx"), lr]).fit(data)


def stack_scores(model: PipelineModel, df: DataFrame, name="score") -> DataFrame:
    return df.withColumn(name, _logistic(model, model.stages[0].getInputCols()))


def linear_contributions(model: PipelineModel, df: DataFrame, channels: Sequence[str], key="event_id") -> DataFrame:
    """(key, one column per channel): coefficient x (value - mean) of the stacked model, in its
    log-odds space.
    """
    weights = model.stages[-1].coefficients.toArray()
    means = df.agg(*[F.avg(c).alias(c) for c in channels]).first()
    return df.select(key, *[((F.col(c) - F.lit(means[c])) * F.lit(float(w))).alias(c) for c, w in zip(channels, weights)])


def graph_design(df: DataFrame, columns: Sequence[str], key: str) -> tuple[DataFrame, list[str]]:
    """The rows with mean, max and deviation of their graph columns over all rows of the key, and the design's columns."""
    known = [c for c in columns if c in df.columns]
    out = neighbour_aggregate(df, key, known)
    return out, [*known, *[f"nb{n}_{c}" for c in known for n in ("mean", "max", "std")]]


def fit_graph_channel(train: DataFrame, validation: DataFrame, columns: Sequence[str], key: str, label="is_fraud", scored="gbdt_p",
                      iterations=GRAPH_ROUNDS, bar=M.GRAPH_LIFT_BAR) -> tuple[Boosted, DataFrame, Mapping[str, float]]:
    """(trees on neighbour aggregates, validation rows with `graph`, base / fused / lift / keep).

    Aggregates are of the slice itself, for training as for validation.
    """
    design, names = graph_design(train, columns, key)
    trees = fit_gbdt(design, names, label, iterations=iterations)
    on_valid = gbdt_scores(trees, graph_design(validation, columns, key)[0], "graph", "_graph_margin").select(*validation.columns, "graph")
    lift = M.graph_channel_lift(on_valid, scored, "graph", label, bar).first()
    return trees, on_valid, lift.asDict()


def assert_blind_disjoint(pool: DataFrame, blind: DataFrame | None, keys: Sequence[str] = ("event_id", "payer_entity_id")) -> None:
    """Raise if the blind cohort shares an event or an entity with the pool."""
    if blind is None:
        return
    for key in keys:
        known = blind.filter(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("_k")).distinct()
        if not pool.select(F.col(key).cast("string").alias("_k")).join(known, "_k", "left_semi").isEmpty():
            raise ValueError(f"the blind cohort and the training pool share values of {key}")


def restart_at(df: DataFrame, cuts: Sequence[int], features, at="us") -> DataFrame:
    """``features(rows)`` of every slice between the cuts by itself, so that histories begin anew at each cut."""
    edges, out = [None, *sorted(cuts), None], None
    for low, high in zip(edges, edges[1:]):
        part = df
        if low is not None:
            part = part.filter(F.col(at) >= F.lit(low))
        if high is not None:
            part = part.filter(F.col(at) < F.lit(high))
        made = features(part)
        out = made if out is None else out.unionByName(made)
    return out


def fit_detector(train: DataFrame, validation: DataFrame, features: Sequence[str], label="is_fraud", cents="amount_c",
                 tie="event_id", with_isolation=True, iterations=ROUNDS, legit_only_anomaly=False,
                 isolation_trees=I.TREES, isolation_rows=I.SAMPLE_ROWS, graph_columns: Sequence[str] = (), graph_key: str | None = None,
                 graph_rounds=GRAPH_ROUNDS, bar=M.GRAPH_LIFT_BAR, blind: DataFrame | None = None,
                 blind_keys: Sequence[str] = ("event_id", "payer_entity_id")) -> Detector:
    """Trees on the training slice; calibration, stack and threshold on the later slice.

    The isolation forest has ``isolation_trees`` trees of ``isolation_rows`` training rows each. With graph columns a third
    channel is fitted on neighbour aggregates by ``graph_key``; it stays in the stack only if averaging it in lifts the
    average precision by ``bar``. A blind cohort that shares an event or entity with either slice raises.
    """
    assert_no_leakage(train.select(*features))
    for part in (train, validation):
        assert_blind_disjoint(part, blind, blind_keys)
    trees = fit_gbdt(train, features, label, validation, iterations)
    on_valid = gbdt_scores(trees, validation)
    curve = platt(on_valid, label)
    on_valid = platt_scores(curve, on_valid, "gbdt_p")
    forest = graph = None
    measured = {}
    if graph_columns:
        graph, on_valid, measured = fit_graph_channel(train, durable(on_valid), graph_columns, graph_key, label, iterations=graph_rounds, bar=bar)
        if not measured["keep"]:
            graph = None
    if with_isolation:
        base = train.filter(~F.col(label).cast("boolean")) if legit_only_anomaly else train
        forest, on_valid = I.fitted_scores(I.fit_isolation(base, features, tie, isolation_trees, isolation_rows), on_valid)
    made = Detector(tuple(features), trees, curve, forest, graph=graph, graph_columns=tuple(graph_columns), graph_key=graph_key or "")
    on_valid = durable(on_valid)
    blend = stack(on_valid, made.channels, label)
    final = stack_scores(blend, on_valid)
    best = M.optimal_threshold(final, label=label, cents=cents).first()
    quality = M.ranking_summary(final, label).first()
    found = {"validation_average_precision": quality["average_precision"], "validation_roc_auc": quality["roc_auc"], "rounds": trees.table.rounds}
    if graph_columns:
        found |= {"graph_base": measured["base"], "graph_fused": measured["fused"], "graph_lift": measured["lift"], "graph_kept": float(measured["keep"])}
    return replace(made, stack=blend, threshold=best["threshold"], measured=found)


def channel_scores(detector: Detector, df: DataFrame) -> DataFrame:
    """Adds one column per channel; neighbour aggregates are of the rows given."""
    out = platt_scores(detector.platt, gbdt_scores(detector.gbdt, df), "gbdt_p")
    if detector.graph is not None:
        design, _ = graph_design(out, detector.graph_columns, detector.graph_key)
        out = gbdt_scores(detector.graph, design, "graph", "_graph_margin").select(*out.columns, "graph")
    if detector.isolation is not None:
        out = I.isolation_scores(detector.isolation, out)
    return out


def score(detector: Detector, df: DataFrame, name="score") -> DataFrame:
    return stack_scores(detector.stack, channel_scores(detector, df), name)


def evaluate(detector: Detector, df: DataFrame, label="is_fraud", cents="amount_c") -> DataFrame:
    """One row: ranking quality, error rates and cost at the detector's threshold."""
    scored = durable(score(detector, df))
    one = F.lit(1).alias("one")
    a = M.ranking_summary(scored, label).withColumn("one", one)
    b = M.flag_rates(scored, detector.threshold, label).withColumn("one", one)
    c = M.expected_cost(scored, detector.threshold, label, cents=cents).withColumn("one", one)
    return a.join(b, "one").join(c, "one").drop("one").withColumn("threshold", F.lit(detector.threshold))


def scope_matrix(train: DataFrame, validation: DataFrame, test: DataFrame, features: Sequence[str],
                 parties: Mapping[str, object], label="is_fraud", vector: str | None = None, **kw) -> tuple[DataFrame, DataFrame]:
    """(status by scope; average precision by scope and attack vector).

    Each party's detector is fitted on the rows and the columns of its own view. The status says
    how far it came: too few rows, too few positives, no fraud to test on, or fitted. A vector's
    precision takes its own frauds and all legitimate rows of the test part.
    """
    spark = train.sparkSession
    ensure_checkpoint_dir(spark)

    def of_scope(scope, party):
        """(its status row, its score rows)"""
        parts = [party_view(p, scope, party) for p in (train, validation, test)]
        seen = [c for c in features if c not in SCOPE_MASKS[scope]]
        sizes = [p.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.col(label).cast("int")), F.lit(0)).alias("p")).first() for p in parts]
        rows, positives = sizes[0]["n"] + sizes[1]["n"] + sizes[2]["n"], sum(s["p"] for s in sizes)
        said = FITTED
        if rows < MIN_SCOPE_ROWS:
            said = TOO_FEW_ROWS
        elif positives < MIN_SCOPE_POSITIVES or sizes[0]["p"] < MIN_POSITIVES:
            said = TOO_FEW_POSITIVES
        elif not sizes[2]["p"]:
            said = NO_EVALUATION_FRAUD
        row = (scope, said, rows, positives, ",".join(seen))
        if said != FITTED:
            return row, []
        detector = fit_detector(parts[0], parts[1], seen, label, with_isolation=False, **kw)
        scored = score(detector, parts[2])
        found = M.average_precision_by_vector(scored, vector, label) if vector else M.average_precision(scored, label).withColumn("ALL", F.lit("ALL"))
        return row, [(scope, str(r[vector or "ALL"]), r["average_precision"]) for r in found.collect()]  # one row per vector

    with ThreadPoolExecutor(len(SCOPE_MASKS)) as pool:  # a boosting round is many short jobs, which leave most cores idle
        made = list(pool.map(of_scope, parties.keys(), parties.values()))
    return (spark.createDataFrame([row for row, _ in made], "scope string, status string, rows long, positives long, columns string"),
            spark.createDataFrame([r for _, rows in made for r in rows], "scope string, vector string, average_precision double"))


def external_train(features_df: DataFrame, features: Sequence[str], at="us", tie="event_id", label="is_fraud",
                   negative_ratio: float | None = 10.0, validation_fraction=0.2, iterations=ROUNDS):
    """(trees, calibration) on one corpus: negatives thinned for the fit only, never for the
    calibration slice, which also decides the round to keep.
    """
    train, valid = positional_cut(features_df, at, tie, 1 - validation_fraction)
    fit = downsample_negatives(train, negative_ratio) if negative_ratio else train
    trees = fit_gbdt(fit, features, label, valid, iterations)
    return trees, platt(gbdt_scores(trees, valid), label)


def external_evaluate(trees, curve, features_df: DataFrame, label="is_fraud") -> DataFrame:
    scored = platt_scores(curve, gbdt_scores(trees, features_df), "score")
    base = F.avg(F.col(label).cast("int"))
    return M.ranking_summary(scored, label).withColumn("one", F.lit(1)).join(
        scored.agg(F.count(F.lit(1)).alias("rows"), base.alias("prevalence"), F.lit(1).alias("one")), "one").drop("one")


def graph_only_scoping(graph_features: DataFrame, features: Sequence[str], at="us", tie="event_id",
                       label="is_laundering", bar=M.GRAPH_LIFT_BAR, train_fraction=0.7, iterations=GRAPH_ROUNDS):
    """(one row: average precision, base rate, lift, passed; and a table of importances)."""
    train, test = positional_cut(graph_features, at, tie, train_fraction)
    trees = fit_gbdt(train, features, label, iterations=iterations)
    scored = gbdt_scores(trees, test, "s")
    quality = M.average_precision(scored, label, "s").withColumn("one", F.lit(1))
    base = scored.agg(F.avg(F.col(label).cast("int")).alias("base_rate"), F.lit(1).alias("one"))
    lift = F.col("average_precision") - F.col("base_rate")
    report = quality.join(base, "one").drop("one").withColumns({"lift": lift, "passed": lift >= bar})
    ranked = train.sparkSession.createDataFrame(list(zip(trees.features, trees.importances)), "feature string, importance double")
    return report, ranked.orderBy(F.col("importance").desc())


# --- realism layers that fit a model ------------------------------------------------------

def _codes(df: DataFrame, reference: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Category columns as numbers: the place of the value among the reference's sorted values, -1
    for values it does not have. The level table has one row per value and is joined.
    """
    value = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("__missing__"))
    for c in columns:
        if c in reference.columns and c in df.columns:
            levels = reference.select(value(c).alias(f"_l_{c}")).distinct()
            levels = rank_in_group(levels, [], f"_l_{c}", f"_l_{c}", f"_c_{c}").withColumn(f"_c_{c}", (F.col(f"_c_{c}") - 1).cast("double"))
            df = df.join(levels, value(c) == F.col(f"_l_{c}"), "left").drop(f"_l_{c}").fillna(-1.0, [f"_c_{c}"])
    return df


def _too_few(batch: DataFrame, reference: DataFrame, layer: str, neutral: Mapping[str, float], least: int) -> DataFrame | None:
    """Layer rows of a test that is left out as a table has fewer rows than it needs, or None."""
    rows = min(d.limit(least).count() for d in (batch, reference))
    if rows >= least:
        return None
    made = [(layer, m, float(v), True) for m, v in [*neutral.items(), ("too_few_rows", rows)]]
    return batch.sparkSession.createDataFrame(made, "layer string, metric string, value double, passed boolean")


def transfer_ratio(batch: DataFrame, reference: DataFrame, at="us", tie="event_id", iterations=60) -> DataFrame:
    """Layer rows: quality of a decline model trained on the batch over one trained on the
    reference, both tested on the later 30 % of the reference. Tables of a few rows pass, with a row that says so.
    """
    few = _too_few(batch, reference, "utility", {"tstr_ratio": 1.0}, MIN_UTILITY_ROWS)
    if few is not None:
        return few
    categories = [c for c in UTILITY_CATEGORIES if c in reference.columns and c in batch.columns]

    def design(df):
        view = numeric_view(_codes(df, reference, categories), [at, tie, *[f"_c_{c}" for c in categories]])
        return view.select(at, tie, "hour_of_day", "day_of_week", "cross_border_num", *[f"_c_{c}" for c in categories],
                           F.col("is_decline").alias("y"))

    features = ["hour_of_day", "day_of_week", "cross_border_num", *[f"_c_{c}" for c in categories]]
    train, test = positional_cut(design(reference), at, tie, 0.7)
    quality = []
    for source in (design(batch), train):
        model = fit_gbdt(source, features, "y", iterations=iterations, weigh_positives=False)
        quality.append(M.average_precision(gbdt_scores(model, test, "s"), "y", "s").first()[0] or 0.0)
    ratio = quality[0] / quality[1] if quality[1] > 0 else 0.0
    row = batch.sparkSession.createDataFrame([(*quality, ratio)], "tstr double, trtr double, ratio double")
    return verdict(row, "utility", {"tstr_pr_auc": "tstr", "trtr_pr_auc": "trtr", "tstr_ratio": "ratio"},
                   F.col("ratio") >= TRANSFER_MIN_RATIO)


def discriminator_auc(batch: DataFrame, reference: DataFrame, tie="event_id", rows=20_000, iterations=80) -> DataFrame:
    """Layer rows: how well a model tells the two tables apart.

    It is fitted on equal-sized samples of at most ``rows`` rows each, and tested on three tenths of
    all rows, which no sample holds. Tables of a few rows pass, with a row that says so.
    """
    few = _too_few(batch, reference, "adversarial", {"discriminator_auc": 0.5}, MIN_DISCRIMINATOR_ROWS)
    if few is not None:
        return few
    held = F.pmod(F.col("_order"), F.lit(10)) < 3
    a, b = (numeric_view(d, [tie]).withColumn("_order", F.xxhash64(tie)) for d in (batch, reference))
    names = [c for c in a.columns if c in b.columns and c not in (tie, "_order")]

    def stacked(left, right):
        return left.select(*names, F.lit(1).alias("y")).unionByName(right.select(*names, F.lit(0).alias("y"))).fillna(0.0, names)

    model = fit_gbdt(stacked(*balanced_sample(a.filter(~held), b.filter(~held), rows, "_order", tie)), names, "y", iterations=iterations, weigh_positives=False)
    test = stacked(a.filter(held), b.filter(held))
    n = test.count()
    floor = 0.5 - SIGMAS / (2 * max(n, 1) ** 0.5)
    auc = M.roc_auc(gbdt_scores(model, test, "s"), "y", "s").withColumn("floor", F.lit(floor))
    return verdict(auc, "adversarial", {"discriminator_auc": "roc_auc", "auc_floor": "floor"},
                   F.col("roc_auc").between(floor, DISCRIMINATOR_MAX))


def is_member(key: str) -> Column:
    """A fixed half of the rows, by a digest of the id that any engine can compute."""
    return F.conv(F.substring(F.md5(F.concat(F.lit("member:"), F.col(key).cast("string"))), 1, 1), 16, 10).cast("int") < 8


def membership_auc(batch: DataFrame, reference: DataFrame) -> DataFrame:
    """One row (mia_auc, shadow, members, others): can nearness to the nearest batch row tell reference members from non-members.

    A shadow attack: every reference row, half of them members, against every batch row. Inverting the rule is no merit, so
    the AUC is at least 0.5.
    """
    names = [c for c in batch.columns if c in reference.columns and c != "_id"]
    near, far = _standardised(batch, reference, names, batch)
    scored = stored(nearest_distance(near, far, names).select(is_member("_id").cast("int").alias("member"), (-F.col("distance")).alias("score")), "nearness")
    counts = scored.agg(F.count_if(F.col("member") == 1).alias("members"), F.count_if(F.col("member") == 0).alias("others"), F.lit(1).alias("one"))
    auc = M.roc_auc(scored, "member", "score").withColumn("one", F.lit(1))
    size = batch.agg(F.count(F.lit(1)).alias("shadow"), F.lit(1).alias("one"))
    value = F.coalesce(F.greatest("roc_auc", 1 - F.col("roc_auc")), F.lit(0.5))
    return auc.join(counts, "one").join(size, "one").select(value.alias("mia_auc"), "shadow", "members", "others")


def privacy_layer(batch: DataFrame, reference: DataFrame, least_rows: int = MEMBERSHIP_ROWS) -> DataFrame:
    """Layer rows from closest record and membership; below ``least_rows`` batch rows membership is noise and left out, and a
    row ``membership_skipped`` says so, with the batch's rows as its value.
    """
    from paysieve.operators.realism import closest_record, proximity_view

    a, b = proximity_view(batch), proximity_view(reference)
    near = closest_record(a, b).withColumn("one", F.lit(1))
    rows = batch.limit(least_rows).count()
    if rows < least_rows:
        return verdict(near.withColumn("rows", F.lit(rows)), "privacy", {"min_dcr": "min_distance", "membership_skipped": "rows"}, F.col("min_distance") > 0)
    both = near.join(membership_auc(a, b).withColumn("one", F.lit(1)), "one")
    return verdict(both, "privacy", {"mia_auc": "mia_auc", "min_dcr": "min_distance"},
                   (F.col("min_distance") > 0) & F.col("mia_auc").between(MEMBERSHIP_MIN, MEMBERSHIP_MAX))


ROTATED = ("marginal", "joint", "adversarial")


@dataclass(frozen=True)
class Gate:
    """What the layers said: their rows with the rotated layer marked, the verdict, and what it rests on."""

    rows: DataFrame
    passed: bool
    shadow: str
    shadow_failed: bool
    composite: float
    failed: tuple[str, ...]

    def summary(self) -> DataFrame:
        """One row of the verdict."""
        row = (self.passed, self.shadow, self.shadow_failed, self.composite, ",".join(self.failed))
        return self.rows.sparkSession.createDataFrame([row], "passed boolean, shadow string, shadow_failed boolean, composite double, failed string")


def run_gate(batch: DataFrame, reference: DataFrame, round_no: int, layers: Mapping | None = None) -> Gate:
    """All layers, one of three left out of the verdict by turns. A layer that raises has failed; a behavioural one that
    raises has twice the largest composite.
    """
    from paysieve.operators import realism as L

    if batch.isEmpty() or reference.isEmpty():
        raise ValueError("the gate needs rows in the batch and in the reference")
    layers = layers or {
        "marginal": L.marginal_layer, "joint": L.joint_layer, "behavioral": L.behavioural_layer,
        "utility": transfer_ratio, "adversarial": discriminator_auc, "privacy": privacy_layer}
    shadow = ROTATED[round_no % len(ROTATED)]
    spark, rows = batch.sparkSession, []
    for name, layer in layers.items():
        try:
            rows += [tuple(r) for r in layer(batch, reference).select("layer", "metric", "value", "passed").collect()]  # a few metrics
        except DATA_ERRORS as broken:  # a layer that the data does not allow to run has failed
            rows.append((name, f"error:{type(broken).__name__}", None, False))
            if name == "behavioral":
                rows.append((name, "composite", 2 * L.BEHAVIOURAL_MAX, False))
    table = spark.createDataFrame(rows, "layer string, metric string, value double, passed boolean").withColumn(
        "counts", F.col("layer") != shadow)
    failed = tuple(n for n in layers if n != shadow and not all(r[3] for r in rows if r[0] == n))
    composite = next((r[2] for r in rows if r[:2] == ("behavioral", "composite")), float("nan"))
    return Gate(table, not failed, shadow, not all(r[3] for r in rows if r[0] == shadow), composite, failed)


def row_independent_baseline(df: DataFrame, columns: Sequence[str], at="us", tie="event_id", seed=7) -> DataFrame:
    """Every column resampled on its own: same margins, no links between columns or rows.

    Each column is ranked in its own hash order and the columns meet again by rank: one ranked
    shuffle and one equi join per column.
    """
    from paysieve.plans.scan import rank_in_group

    out = None
    for i, c in enumerate(columns):
        part = df.select(F.col(c), F.col(tie).alias("_t"), F.xxhash64(F.lit(seed + i), F.col(tie)).alias("_o"))
        part = rank_in_group(part, [], "_o", "_t", "_rank").select("_rank", c)
        out = part if out is None else out.join(part, "_rank")
    return out.withColumnRenamed("_rank", tie)


def gaussian_copula(df: DataFrame, columns: Sequence[str], rows: int, tie="event_id", seed=11) -> DataFrame:
    """Numeric columns sampled with the observed margins and the rank correlation, rows independent.

    Ranks become normal scores; their correlation matrix (a few numbers) goes to the driver;
    normals are drawn per partition and mapped back through a table of 1,000 quantiles.
    """
    import numpy as np
    from pyspark.ml.stat import Correlation

    from paysieve.plans.scan import rank_in_group

    n = df.count()
    ranked = None
    for c in columns:
        part = rank_in_group(df.select(F.col(c).cast("double").alias(c), F.col(tie).alias("_t")).na.fill(0.0), [], c, "_t", f"_r_{c}").select("_t", f"_r_{c}")
        ranked = part if ranked is None else ranked.join(part, "_t")

    def normal_scores(batches):
        from statistics import NormalDist

        inverse = np.vectorize(NormalDist().inv_cdf)
        for pdf in batches:
            yield pdf[[f"_r_{c}" for c in columns]].apply(lambda s: inverse((s - 0.5) / n)).set_axis(list(columns), axis=1)

    scores = ranked.mapInPandas(normal_scores, ", ".join(f"`{c}` double" for c in columns))
    vectors = VectorAssembler(inputCols=list(columns), outputCol="v").transform(scores)
    matrix = np.nan_to_num(Correlation.corr(vectors, "v").first()[0].toArray(), nan=0.0)
    np.fill_diagonal(matrix, 1.0)
    root = np.linalg.cholesky(matrix + 1e-9 * np.eye(len(columns)))
    grid = [i / 1000 for i in range(1001)]
    tables = df.agg(*[F.percentile_approx(F.col(c).cast("double"), grid, 100_000).alias(c) for c in columns]).first()
    quantiles = np.array([tables[c] for c in columns])

    def draw(batches):
        from math import erf

        phi = np.vectorize(lambda z: 0.5 * (1 + erf(z / 2 ** 0.5)))
        for pdf in batches:
            ids = pdf["id"].to_numpy()
            # Seeded by row id: a recomputed task draws the same rows.
            z = np.stack([np.random.default_rng((seed, int(i))).standard_normal(len(columns)) for i in ids]) if len(ids) else np.empty((0, len(columns)))
            u = phi(z @ root.T) if len(ids) else z
            yield pd.DataFrame({tie: ids, **{c: np.interp(u[:, k], grid, quantiles[k]) for k, c in enumerate(columns)}})

    import pandas as pd

    return df.sparkSession.range(rows).mapInPandas(draw, f"{tie} long, " + ", ".join(f"`{c}` double" for c in columns))
