"""Queries over fitted models."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from paysieve.catalog.base import Catalog, r6
from paysieve.catalog.realism_q import _NUM, _PROX, sides
from paysieve.catalog.sources_q import pca_rows
from paysieve.catalog.splits_q import START
from paysieve.catalog.views import acct_edges, canonical, evt, with_views
from paysieve.operators import decisions as D
from paysieve.operators import graph as G
from paysieve.operators import isolation as I
from paysieve.operators import metrics as M
from paysieve.operators import models as L
from paysieve.operators import realism as R
from paysieve.operators.splits import temporal_split
from paysieve.plans.durable import durable
from paysieve.plans.scan import previous_row

query = Catalog()
FEATURES = ["amount", "k", "payee", "hour", "decl"]


def design(spark, d):
    return evt(spark, d).select(
        "event_id", "us", "amount", "amount_c", "is_fraud", "issuer_id", "acquirer_id", F.col("k").cast("double").alias("k"),
        F.col("payee_id").cast("double").alias("payee"), F.hour("event_ts").cast("double").alias("hour"),
        F.col("declined").cast("double").alias("decl"))


def parts(spark, d):
    split = temporal_split(design(spark, d), START, 20, 0)
    return split["train"], split["validation"], split["test"]


_LATER = f"us >= {START + 20 * 86_400_000_000}"


def facts(row, **claims):
    """One row of what holds of a result: counts as they are, claims as booleans."""
    return row.select(*[F.coalesce(c, F.lit(False)).alias(n) if c is not None else F.col(n) for n, c in claims.items()])


def valid_scores(df, *scores):
    """How many rows have all scores between 0 and 1."""
    fits = [F.coalesce(F.col(c).between(0, 1), F.lit(False)) for c in scores]
    return df.agg(F.count_if(reduce(lambda a, b: a & b, fits)).alias("rows"))


def beside(*tables):
    """One-row tables side by side."""
    keyed = [t.withColumn("_one", F.lit(1)) for t in tables]
    return reduce(lambda a, b: a.join(b, "_one"), keyed).drop("_one")


def falls(df, at, score, tie="event_id"):
    """How often a score falls while another rises, over the whole table."""
    seen = previous_row(df.select(tie, at, score), [], at, tie, {"_before": F.col(score)})
    return seen.agg(F.count_if(F.col("_before") > F.col(score) + 1e-12).alias(f"falls_{score}"))


def measured_rounds(spark, model):
    return spark.createDataFrame(list(model.measured), "round int, average_precision double")


@query("m14_fit_gbdt", with_views("evt", f"""SELECT count(*) AS rows, true AS ranks, true AS first_best_kept, true AS ended_in_time, 600 AS most_rounds
FROM evt WHERE {_LATER}"""))
def _(spark, d):
    """Scores of the later rows: all there, far better than chance (the label follows from two features), the first best round kept."""
    train, valid, test = parts(spark, d)
    model = L.fit_gbdt(train, FEATURES, validation=valid)
    on_test = durable(L.gbdt_scores(model, test))
    kept, quality = model.table.rounds, [q for _, q in model.measured]
    return facts(beside(valid_scores(on_test, "gbdt"), M.ranking_summary(on_test, score="gbdt")), rows=None,
                 ranks=(F.col("average_precision") > 0.9) & (F.col("roc_auc") > 0.97), first_best_kept=F.lit(quality.index(max(quality)) + 1 == kept),
                 ended_in_time=F.lit(len(quality) <= min(L.ROUNDS, kept + L.PATIENCE))).withColumn("most_rounds", F.lit(L.ROUNDS))


@query("m14b_boosting_rounds")
def _(spark, d):
    train, valid, _ = parts(spark, d)
    return measured_rounds(spark, L.fit_gbdt(train, FEATURES, validation=valid))


@query("m14c_scores")
def _(spark, d):
    train, valid, test = parts(spark, d)
    return L.gbdt_scores(L.fit_gbdt(train, FEATURES, validation=valid, iterations=64), test).select("event_id", "gbdt", "_margin")


def calibrated(spark, d):
    train, valid, test = parts(spark, d)
    model = L.fit_gbdt(train, FEATURES, validation=valid, iterations=64)
    on_valid, on_test = durable(L.gbdt_scores(model, valid)), L.gbdt_scores(model, test)
    out = L.platt_scores(L.platt(on_valid), on_test, "sigmoid")
    return durable(L.isotonic_scores(L.isotonic(on_valid), out, "isotonic"))


@query("m15_platt_isotonic", with_views("evt", f"SELECT count(*) AS rows, 0 AS falls_sigmoid, 0 AS falls_isotonic, true AS sigmoid_ranks_alike, true AS closer FROM evt WHERE {_LATER}"))
def _(spark, d):
    """Calibration keeps the order of the margins, and brings scores closer to the labels than weighted trees are."""
    out = calibrated(spark, d)
    brier = out.agg(*[F.avg(F.pow(F.col(c) - F.col("is_fraud"), 2)).alias(f"brier_{c}") for c in ("gbdt", "sigmoid", "isotonic")])
    alike = beside(*[M.roc_auc(out, score=c).withColumnRenamed("roc_auc", f"auc_{c}") for c in ("_margin", "sigmoid")])
    all_ = beside(valid_scores(out, "sigmoid", "isotonic"), falls(out, "_margin", "sigmoid"), falls(out, "_margin", "isotonic"), brier, alike)
    return facts(all_, rows=None, falls_sigmoid=None, falls_isotonic=None, sigmoid_ranks_alike=F.abs(F.col("auc__margin") - F.col("auc_sigmoid")) < 1e-9,
                 closer=(F.col("brier_sigmoid") < F.col("brier_gbdt") + 0.01) & (F.col("brier_isotonic") < F.col("brier_gbdt") + 0.01))


@query("m15b_calibrated_scores")
def _(spark, d):
    return calibrated(spark, d).select("event_id", "_margin", "sigmoid", "isotonic")


def compared(spark, d, iterations=L.COMPARED_ROUNDS):
    rows = pca_rows(spark, d).withColumn("row_id", F.xxhash64("Time", "Amount"))
    return L.compare_calibrators(rows, [f"V{i}" for i in range(1, 29)] + ["Amount"], iterations=iterations)


@query("m16_compare_calibrators")
def _(spark, d):
    return compared(spark, d)


@query("m16b_calibrator_facts", "SELECT * FROM (VALUES ('isotonic', true, true, true), ('sigmoid', true, true, true), ('uncalibrated', true, true, true)) t(method, ranks, bounded, ranks_like_raw)")
def _(spark, d):
    """Every method ranks above chance; a logistic curve leaves the order as it is, isotonic steps only tie neighbours."""
    rows = durable(compared(spark, d, 30))
    raw = rows.filter("method = 'uncalibrated'").select(F.col("roc_auc").alias("_raw"))
    slack = F.when(F.col("method") == "isotonic", 0.2).otherwise(1e-9)
    return rows.crossJoin(raw).select("method", (F.col("roc_auc") > 0.5).alias("ranks"), (F.col("brier").between(0, 1) & F.col("ece").between(0, 1)).alias("bounded"),
                                      (F.abs(F.col("roc_auc") - F.col("_raw")) < slack).alias("ranks_like_raw"))


def forest_scores(spark, d):
    df = design(spark, d)
    return I.isolation_scores(I.fit_isolation(df, FEATURES), df, by_batch=True)


@query("m17_isolation_scores", with_views("evt", "SELECT count(*) AS rows, true AS spans, true AS clipped, true AS outliers_higher FROM evt"))
def _(spark, d):
    """Scores span 0 to 1 with a hundredth clipped at either end; the hundredth of rows with the greatest amounts lies far above the rest."""
    out = durable(forest_scores(spark, d))
    cut = out.agg(F.percentile("amount", 0.99).alias("p")).first()["p"]
    n = F.count(F.lit(1))
    row = out.agg(F.count_if(F.col("anomaly").between(0, 1)).alias("rows"), ((F.min("anomaly") == 0) & (F.max("anomaly") == 1)).alias("spans"),
                  (F.count_if(F.col("anomaly").isin(0.0, 1.0)) / n).alias("ends"), F.avg(F.when(F.col("amount") >= cut, F.col("anomaly"))).alias("far"), F.avg("anomaly").alias("mean"))
    return facts(row, rows=None, spans=F.col("spans"), clipped=F.col("ends").between(0.015, 0.06), outliers_higher=F.col("far") > F.col("mean") + 0.2)


@query("m17c_forest_scores")
def _(spark, d):
    return forest_scores(spark, d).select("event_id", "anomaly")


@query("m17b_rescale", with_views("evt", """
WITH p AS (SELECT quantile_cont(score, 0.01) AS lo, quantile_cont(score, 0.99) AS hi FROM evt)
SELECT event_id, round(least(greatest((score - lo) / (hi - lo), 0), 1), 6) AS anomaly FROM evt, p"""))
def _(spark, d):
    return I.rescale(evt(spark, d), "score").select("event_id", r6("anomaly"))


def blended(spark, d):
    df = evt(spark, d).withColumn("other", F.col("k") / 100.0)
    model = L.stack(df, ["score", "other"])
    return model, L.stack_scores(model, df, "blend")


@query("m18_stack", with_views("evt", "SELECT count(*) AS rows, true AS no_worse_than_a_channel, true AS logistic FROM evt"))
def _(spark, d):
    """The blend is the logistic curve of the weighted channels and ranks at least as well as either."""
    model, out = blended(spark, d)
    fitted = model.stages[-1]
    a, b = (float(x) for x in fitted.coefficients.toArray())
    line = F.lit(float(fitted.intercept)) + a * F.col("score") + b * F.col("other")
    off = out.agg(F.max(F.abs(1 / (1 + F.exp(-line)) - F.col("blend"))).alias("off"))
    ranks = beside(*[M.roc_auc(out, score=c).withColumnRenamed("roc_auc", c) for c in ("blend", "score", "other")])
    return facts(beside(valid_scores(out, "blend"), ranks, off), rows=None, no_worse_than_a_channel=F.col("blend") >= F.greatest("score", "other") - 0.01, logistic=F.col("off") < 1e-9)


@query("m18b_blend")
def _(spark, d):
    return blended(spark, d)[1].select("event_id", "blend")


def graph_parts(spark, d):
    """The slices with graph columns that follow from the event."""
    more = {"payee_pagerank": F.col("payee") / 40, "fanin_payee_24h": F.col("k") % 7, "cnt_payee_entity_id_24h": F.col("hour")}
    return [p.withColumns(more).withColumn("payee_id", F.col("payee").cast("long")) for p in parts(spark, d)]


def whole_detector(spark, d):
    train, valid, test = graph_parts(spark, d)
    found = L.fit_detector(train, valid, FEATURES, iterations=128, graph_columns=["payee_pagerank", "fanin_payee_24h", "cnt_payee_entity_id_24h"], graph_key="payee_id",
                           graph_rounds=32, isolation_trees=50, isolation_rows=4096, blind=test, blind_keys=["event_id"])
    return found, test


@query("m20_detector", "SELECT true AS ranks, true AS rates, true AS on_grid, true AS lift_decides, true AS lift_is_the_difference, true AS blind_disjoint")
def _(spark, d):
    """Three channels on the training slice, the graph channel kept by its lift alone; evaluated on rows that neither slice holds."""
    detector, test = whole_detector(spark, d)
    found, m = L.evaluate(detector, test), detector.measured
    share = F.col("threshold") * 1000
    return facts(found, ranks=(F.col("average_precision") > 0.9) & (F.col("roc_auc") > 0.97), rates=(F.col("fpr") < 0.2) & (F.col("evasion") < 0.5) & (F.col("cost") > 0),
                 on_grid=F.abs(share - F.round(share)) < 1e-6, lift_decides=F.lit((m["graph_lift"] >= M.GRAPH_LIFT_BAR) == ("graph" in detector.channels) == bool(m["graph_kept"])),
                 lift_is_the_difference=F.lit(abs(m["graph_fused"] - m["graph_base"] - m["graph_lift"]) < 1e-12), blind_disjoint=F.lit(True))


@query("m20b_detector_rows")
def _(spark, d):
    """(metric, value): what the fit measured, the channels kept, and quality on the later rows."""
    detector, test = whole_detector(spark, d)
    row = L.evaluate(detector, test)
    fitted = spark.createDataFrame([*[(k, float(v)) for k, v in detector.measured.items()], *[(f"channel_{c}", 1.0) for c in detector.channels]], "metric string, value double")
    return fitted.unionByName(row.select(F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in row.columns]))))


_SCOPED = [*FEATURES, "amount_z_vs_entity_history", "merchant_control_strength", "payer_kyc_level"]
_SCOPE_COLUMNS = {"NETWORK": "amount,k,payee,hour,decl,amount_z_vs_entity_history,merchant_control_strength",
                  "ISSUER": "amount,k,payee,hour,decl,amount_z_vs_entity_history,payer_kyc_level",
                  "ACQUIRER": "amount,k,payee,hour,decl,merchant_control_strength"}
_PARTIES = {"NETWORK": None, "ISSUER": 7, "ACQUIRER": 3}


@query("m21_scope_matrix", with_views("evt", f"""
WITH s AS ({" UNION ALL ".join(f"SELECT '{k}' AS scope, '{c}' AS columns, us, is_fraud FROM evt WHERE {w}" for (k, c), w in zip(_SCOPE_COLUMNS.items(), ("true", "issuer_id = 7", "acquirer_id = 3")))}),
b AS (SELECT *, us < {START + 20 * 86_400_000_000} AS early FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY early ORDER BY us) AS n FROM (SELECT us, us < {START + 20 * 86_400_000_000} AS early FROM evt)),
e AS (SELECT max(us) AS cut FROM r WHERE early AND n <= CAST(floor((SELECT count(*) FROM r WHERE early) * 0.8) AS BIGINT)),
c AS (SELECT scope, columns, count(*) AS rows, CAST(sum(is_fraud) AS BIGINT) AS positives, coalesce(sum(is_fraud) FILTER (WHERE early AND us <= cut), 0) AS fit,
  coalesce(sum(is_fraud) FILTER (WHERE NOT early), 0) AS later FROM b, e GROUP BY 1, 2)
SELECT scope, CASE WHEN rows < 2000 THEN 'too_few_rows' WHEN positives < 2 OR fit < 30 THEN 'too_few_positives'
  WHEN later = 0 THEN 'no_fraud_in_evaluation_window' ELSE 'fitted' END AS status, rows, positives, columns FROM c"""))
def _(spark, d):
    more = {"amount_z_vs_entity_history": F.col("amount") / 100, "merchant_control_strength": F.col("k") / 50, "payer_kyc_level": F.col("payee") % 3}
    train, valid, test = (p.withColumns(more) for p in parts(spark, d))
    return L.scope_matrix(train, valid, test, _SCOPED, _PARTIES)[0]


@query("m21c_scope_scores")
def _(spark, d):
    train, valid, test = (p.withColumn("vector_id", F.concat(F.lit("V"), F.col("k").cast("int") % 4)) for p in parts(spark, d))
    return L.scope_matrix(train, valid, test, FEATURES, _PARTIES, vector="vector_id")[1]


@query("m25_linear_contributions", with_views("evt", "SELECT event_id, true AS sums FROM evt"))
def _(spark, d):
    """Contributions and the value at the mean sum to the log-odds whose curve every row's blend is."""
    df = evt(spark, d).withColumn("other", F.col("k") / 100.0)
    model = L.stack(df, ["score", "other"])
    parts_ = L.linear_contributions(model, df, ["score", "other"]).withColumnsRenamed({"score": "by_score", "other": "by_other"})
    means, fitted = df.agg(F.avg("score"), F.avg("other")).first(), model.stages[-1]
    middle = float(fitted.intercept) + float(fitted.coefficients[0]) * means[0] + float(fitted.coefficients[1]) * means[1]
    blend = L.stack_scores(model, df, "blend").select("event_id", "blend")
    odds = F.col("by_score") + F.col("by_other") + middle
    return parts_.join(blend, "event_id").select("event_id", (F.abs(1 / (1 + F.exp(-odds)) - F.col("blend")) < 1e-9).alias("sums"))


@query("m25b_contribution_rows")
def _(spark, d):
    df = evt(spark, d).withColumn("other", F.col("k") / 100.0)
    return L.linear_contributions(L.stack(df, ["score", "other"]), df, ["score", "other"])


def tree_parts(spark, d, iterations=20):
    train, _, test = parts(spark, d)
    model = L.fit_gbdt(train, FEATURES, iterations=iterations)
    return model, L.tree_contributions(model, test)


@query("m25c_tree_contributions", with_views("evt", f"SELECT event_id, true AS sums FROM evt WHERE {_LATER}"))
def _(spark, d):
    """What the features add along the paths, and the base, sum to every row's margin."""
    model, out = tree_parts(spark, d)
    total = reduce(lambda a, b: a + b, [F.col(f"by_{f}") for f in FEATURES]) + model.table.base()
    return out.select("event_id", (F.abs(total - F.col("_margin")) < 1e-9).alias("sums"))


@query("m23b_tree_reasons", with_views("evt", f"SELECT event_id, 3 AS reasons, true AS falling, true AS coded FROM evt WHERE {_LATER}"))
def _(spark, d):
    """Three reasons for every row, from the trees' own contributions, the greatest first."""
    _, out = tree_parts(spark, d)
    reasons = D.reason_codes(out, {f: F.col(f"by_{f}") for f in FEATURES}, 3)
    rows = F.sort_array(F.collect_list(F.struct("rank", F.abs("value").alias("size"), "code")))  # three entries
    falling = F.forall(F.sequence(F.lit(1), F.lit(2)), lambda i: F.col("r")[i - 1]["size"] >= F.col("r")[i]["size"])
    return reasons.groupBy("event_id").agg(rows.alias("r")).select("event_id", F.size("r").alias("reasons"), falling.alias("falling"),
                                                                    F.forall("r", lambda x: x["code"].rlike("^R[0-9]{3}$")).alias("coded"))


@query("m34b_tree_importance", "SELECT * FROM (VALUES ('k', true), ('payee', true), ('amount', false), ('hour', false), ('decl', false)) t(feature, decides)")
def _(spark, d):
    """The label is a sum of two features; they carry the contributions."""
    _, out = tree_parts(spark, d)
    found = D.feature_importance(out, {f: F.col(f"by_{f}") for f in FEATURES})
    return found.crossJoin(found.agg(F.sum("importance").alias("_all"))).select("feature", (F.col("importance") > 0.2 * F.col("_all")).alias("decides"))


def external(spark, d):
    train, _, test = parts(spark, d)
    trees, curve = L.external_train(train, FEATURES)
    return trees, L.external_evaluate(trees, curve, test)


@query("m30_external_train")
def _(spark, d):
    return external(spark, d)[1]


@query("m30b_external_facts", with_views("evt", f"SELECT count(*) AS rows, round(avg(is_fraud), 6) AS prevalence, true AS ranks, true AS first_best_kept FROM evt WHERE {_LATER}"))
def _(spark, d):
    trees, row = external(spark, d)
    quality = [q for _, q in trees.measured]
    return facts(row.withColumn("prevalence", F.round("prevalence", 6)), rows=None, prevalence=None, ranks=(F.col("average_precision") > 0.9) & (F.col("roc_auc") > 0.97),
                 first_best_kept=F.lit(quality.index(max(quality)) + 1 == trees.table.rounds))


def legit_forest(spark, d):
    df = design(spark, d)
    model = I.fit_isolation(df.filter("is_fraud = 0"), FEATURES)
    return I.fitted_scores(model, df)[1]


@query("m31_legit_only_anomaly", with_views("evt", "SELECT count(*) AS rows, true AS frauds_stand_out FROM evt"))
def _(spark, d):
    out = durable(legit_forest(spark, d))
    return facts(beside(valid_scores(out, "anomaly"), M.roc_auc(out, score="anomaly")), rows=None, frauds_stand_out=F.col("roc_auc") > 0.6)


@query("m31b_anomaly_rows")
def _(spark, d):
    return legit_forest(spark, d).select("event_id", "anomaly")


_GRAPH_ONLY = ["src_out_degree", "src_in_degree", "dst_out_degree", "dst_in_degree", "src_unique_targets",
               "dst_unique_sources", "is_reciprocated", "is_self_loop", "src_fanout_ratio", "dst_fanin_ratio", "amount_usd_log"]


@query("m32_graph_only_scoping")
def _(spark, d):
    return L.graph_only_scoping(G.account_graph_features(acct_edges(spark, d)), _GRAPH_ONLY)[0]


@query("m32b_graph_importance", "SELECT 11 AS features, true AS sums_to_one, true AS falling")
def _(spark, d):
    _, weights = L.graph_only_scoping(G.account_graph_features(acct_edges(spark, d)), _GRAPH_ONLY, iterations=8)
    found = [r["importance"] for r in weights.collect()]  # one row per feature
    return spark.createDataFrame([(len(found), abs(sum(found) - 1) < 1e-9, found == sorted(found, reverse=True))], "features int, sums_to_one boolean, falling boolean")


def moved(df):
    """A batch unlike its reference: other amounts, hours and categories."""
    return df.withColumns({"amount": F.col("amount") * 3 + 1000, "event_ts": F.col("event_ts") + F.expr("INTERVAL 7 HOURS"), "cross_border": F.lit(True)})


@query("l12_transfer_ratio", """SELECT * FROM (VALUES ('few', 'too_few_rows', 150.0::DOUBLE, true), ('few', 'tstr_ratio', 1.0::DOUBLE, true), ('all', 'ratio_is_quotient', 1.0::DOUBLE, true),
  ('all', 'verdict_by_ratio', 1.0::DOUBLE, true)) t(tables, metric, value, holds)""")
def _(spark, d):
    """The ratio is that of the two qualities and alone decides; a small table passes and says why."""
    batch, reference = sides(spark, d)
    few = L.transfer_ratio(batch.orderBy("event_id").limit(150), reference).select(F.lit("few").alias("tables"), "metric", "value", F.col("passed").alias("holds"))
    rows = {r["metric"]: (r["value"], r["passed"]) for r in L.transfer_ratio(batch, reference, iterations=20).collect()}
    ratio, passed = rows["tstr_ratio"]
    quotient = abs(ratio - rows["tstr_pr_auc"][0] / rows["trtr_pr_auc"][0]) < 1e-12
    return few.unionByName(spark.createDataFrame([("all", "ratio_is_quotient", 1.0, quotient), ("all", "verdict_by_ratio", 1.0, passed == (ratio >= L.TRANSFER_MIN_RATIO))], few.schema))


@query("l12b_transfer_rows")
def _(spark, d):
    return L.transfer_ratio(*sides(spark, d))


@query("l13_discriminator_auc", """SELECT * FROM (VALUES ('alike', 'within_band', true), ('moved', 'told_apart', true), ('moved', 'fails', true), ('few', 'passes_with_reason', true)) t(tables, fact, holds)""")
def _(spark, d):
    """A batch like its reference can't be told from it, a moved one can; a small table passes and says why."""
    batch, reference = sides(spark, d)
    same, apart = ({r["metric"]: (r["value"], r["passed"]) for r in L.discriminator_auc(b, reference, iterations=20).collect()} for b in (batch, moved(batch)))
    few = {r["metric"]: (r["value"], r["passed"]) for r in L.discriminator_auc(batch.orderBy("event_id").limit(150), reference).collect()}
    auc, floor = same["discriminator_auc"][0], same["auc_floor"][0]
    rows = [("alike", "within_band", 0.3 < auc < 0.7 and same["discriminator_auc"][1] == (floor <= auc <= L.DISCRIMINATOR_MAX)), ("moved", "told_apart", apart["discriminator_auc"][0] > 0.9),
            ("moved", "fails", not apart["discriminator_auc"][1]), ("few", "passes_with_reason", few == {"discriminator_auc": (0.5, True), "too_few_rows": (150.0, True)})]
    return spark.createDataFrame(rows, "tables string, fact string, holds boolean")


@query("l13b_discriminator_rows")
def _(spark, d):
    return L.discriminator_auc(*sides(spark, d))


@query("l15_membership_auc", with_views("evt", f"""WITH {_NUM}, n2 AS (SELECT *, us / CAST(1000000 AS DOUBLE) AS ep FROM num),
st AS (SELECT {", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in _PROX)} FROM n2 WHERE side = 1),
z AS (SELECT side, event_id, {", ".join(f"(coalesce({c}, 0) - m_{c}) / CASE WHEN s_{c} = 0 THEN 1 ELSE s_{c} END AS {c}" for c in _PROX)} FROM n2, st),
n AS (SELECT b.event_id, min({" + ".join(f"(a.{c} - b.{c}) * (a.{c} - b.{c})" for c in _PROX)}) AS q FROM z a JOIN z b ON a.side = 1 AND b.side = 0 GROUP BY 1),
m AS (SELECT q, CAST('0x' || substr(md5('member:' || CAST(event_id AS VARCHAR)), 1, 1) AS INT) < 8 AS member FROM n),
r AS (SELECT q, member, (rank() OVER (ORDER BY q DESC) + count(*) OVER (ORDER BY q DESC) ) / 2.0E0 AS r FROM m),
t AS (SELECT count(*) FILTER (WHERE member) AS members, count(*) FILTER (WHERE NOT member) AS others, sum(r) FILTER (WHERE member) AS ranks FROM r),
u AS (SELECT *, (ranks - members * (members + 1) / 2.0E0) / (CAST(members AS DOUBLE) * others) AS auc FROM t)
SELECT round(greatest(auc, 1 - auc), 5) AS mia_auc, (SELECT count(*) FROM num WHERE side = 1) AS shadow, members, others FROM u"""))
def _(spark, d):
    """Every reference row against every batch row."""
    batch, reference = (R.proximity_view(x) for x in sides(spark, d))
    return L.membership_auc(batch, reference).withColumn("mia_auc", F.round("mia_auc", 5))


def gate(spark, d):
    batch, reference = sides(spark, d)
    return L.run_gate(batch, reference, 0, {
        "marginal": R.marginal_layer, "joint": R.joint_layer, "behavioral": R.behavioural_layer,
        "utility": lambda a, b: L.transfer_ratio(a, b, iterations=20), "adversarial": lambda a, b: L.discriminator_auc(a, b, iterations=20),
        "privacy": lambda a, b: L.privacy_layer(a, b)})


@query("l16_run_gate", with_views("evt", """WITH b AS (SELECT count(*) FILTER (WHERE user_id % 2 = 1) AS n FROM evt)
SELECT layer, layer <> 'marginal' AS counts, metrics + CASE WHEN layer = 'privacy' THEN 0 ELSE 0 END AS metrics, CASE WHEN layer = 'privacy' THEN n < 5000 ELSE false END AS skipped
FROM (VALUES ('marginal', 4), ('joint', 2), ('behavioral', 6), ('utility', 3), ('adversarial', 2), ('privacy', 2)) t(layer, metrics), b"""))
def _(spark, d):
    """Each layer with its metrics, the rotated one marked, and whether a test was left out."""
    return gate(spark, d).rows.groupBy("layer").agg(F.min("counts").alias("counts"), F.count(F.lit(1)).alias("metrics"),
                                                    F.max(F.col("metric") == "membership_skipped").alias("skipped"))


@query("l16b_gate_verdict", "SELECT true AS verdict_by_failures, 'marginal' AS shadow, true AS composite_there")
def _(spark, d):
    found = gate(spark, d)
    return found.summary().select((F.col("passed") == (F.col("failed") == "")).alias("verdict_by_failures"), "shadow", (F.col("composite") > 0).alias("composite_there"))


@query("l16c_gate_rows")
def _(spark, d):
    found = gate(spark, d)
    return found.rows.unionByName(found.summary().select(F.lit("gate").alias("layer"), F.lit("composite").alias("metric"), F.col("composite").alias("value"), "passed", F.lit(True).alias("counts")))


@query("l18_row_independent_baseline")
def _(spark, d):
    return L.row_independent_baseline(evt(spark, d), ["k", "user_id", "amount_c", "mcc"])


@query("l18b_baseline_margins", with_views("evt", """
SELECT 'k' AS col, CAST(k AS VARCHAR) AS value, count(*) AS n FROM evt GROUP BY 2 UNION ALL SELECT 'mcc', mcc, count(*) FROM evt GROUP BY 2"""))
def _(spark, d):
    out = L.row_independent_baseline(evt(spark, d), ["k", "mcc"])
    count = lambda c: out.groupBy(F.lit(c).alias("col"), F.col(c).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return count("k").unionByName(count("mcc"))


@query("l18c_gaussian_copula")
def _(spark, d):
    e = evt(spark, d)
    return L.gaussian_copula(e, ["amount", "k", "score"], e.count())
