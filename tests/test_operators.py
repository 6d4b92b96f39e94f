"""Hand-computed cases for validation, splits, metrics, graph and realism."""

import math

import pytest
from pyspark.sql import functions as F

from paysieve import schema as S
from paysieve.operators import decisions as D
from paysieve.operators import graph as G
from paysieve.operators import metrics as M
from paysieve.operators import realism as R
from paysieve.operators import registry as K
from paysieve.operators import splits as P
from paysieve.operators import validation as V
from paysieve.operators.features import FEATURE_NAMES
from paysieve.plans.scan import order_statistic, rank_in_group


def test_schema_and_feature_counts():
    assert len(S.CES_SCHEMA.fields) == 84
    assert len(FEATURE_NAMES) == 151 and len(set(FEATURE_NAMES)) == 151


def test_strict_validation_lists_bad_rows(spark):
    df = spark.createDataFrame([("x", "UPI")], "event_id string, rail string")
    with pytest.raises(ValueError, match="1 invalid rows"):
        V.validate(df)
    assert V.validate(df, strict=False).count() == 0


def test_leakage_guard(spark):
    V.assert_no_leakage(spark.range(1).select(F.lit(1).alias("cnt_ip_1h")))
    with pytest.raises(ValueError, match="pan_token"):
        V.assert_no_leakage(spark.range(1).select(F.lit(1).alias("pan_token")))


def test_disjoint_guard_fires(spark):
    a, b = spark.range(3).toDF("payer"), spark.range(2, 5).toDF("payer")
    V.assert_disjoint({"a": a, "b": b.filter("payer > 2")}, "payer")
    with pytest.raises(ValueError, match="shared"):
        V.assert_disjoint({"a": a, "b": b}, "payer")


def test_order_statistic_with_ties(spark, small_tasks):
    df = spark.range(100).select(F.col("id").alias("event_id"), (F.col("id") % 3).alias("at"))
    want = sorted((i % 3, i) for i in range(100))
    for k in (1, 34, 35, 50, 100):
        assert order_statistic(df, "at", "event_id", k) == want[k - 1]
    assert order_statistic(df, "at", "event_id", 101) is None
    ranks = {r["event_id"]: r["rank"] for r in rank_in_group(df, [], "at", "event_id").collect()}
    assert [e for _, e in want] == sorted(ranks, key=ranks.get)


def test_caps_raise_when_not_reachable(spark):
    df = spark.range(10).selectExpr("id AS event_id", "'UPI' AS rail", "true AS is_fraud")
    with pytest.raises(ValueError, match="prevalence"):
        P.enforce_caps(df, {"UPI": 1.0}, -0.1)


def test_lenient_caps_return_what_two_rounds_leave(spark):
    df = spark.range(100_000).selectExpr("id AS event_id", "'UPI' AS rail", "id % 5 = 0 AS is_fraud")
    kept = P.enforce_caps(df, {"UPI": 1.0}, 0.03, strict=False).groupBy("is_fraud").count().collect()
    assert dict(map(tuple, kept)) == {False: 80_000, True: 2_490}  # 3,000 of 100,000, then 3 % of 83,000
    with pytest.raises(ValueError, match="prevalence"):
        P.enforce_caps(df, {"UPI": 1.0}, 0.03)


def zero_amount(spark, tmp_path):
    """An events table of one event of amount 0 and a later one."""
    rows = [(1, "2024-01-01 00:00:00", 5, "view", 0.0, '{"k": 3}'), (41, "2024-01-01 01:00:00", 5, "view", 2.5, '{"k": 3}')]
    events = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string")
    events.withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(f"{tmp_path}/events.parquet")
    return str(tmp_path)


def test_digit_sum_counts_amount_zero_as_one_as_its_sql(spark, tmp_path):
    from paysieve.catalog.features_q import query as catalog

    got = dict(map(tuple, catalog.queries["f10b_benford_digit_sum"](spark, zero_amount(spark, tmp_path)).collect()))
    assert got[41] == round(1 - math.log10(2) + sum(math.log10(1 + 1 / d) for d in range(2, 10)), 6)


def test_amount_zero_is_no_fault_of_the_given_table(spark, tmp_path):
    from paysieve.catalog.splits_q import query as catalog

    folder = zero_amount(spark, tmp_path)
    assert catalog.queries["v01_validate"](spark, folder).collect() == []
    assert [tuple(r) for r in catalog.queries["v02_quarantine"](spark, folder).collect()] == [("valid", 2)]


LABELS = [0, 0, 1, 1, 0, 1, 0, 0]
SCORES = [.05, .10, .80, .65, .20, .90, .02, .30]
AMOUNTS = [50, 90, 400, 120, 70, 900, 30, 60]


def scored(spark):
    rows = [(i, y, s, a * 100) for i, (y, s, a) in enumerate(zip(LABELS, SCORES, AMOUNTS))]
    return spark.createDataFrame(rows, "event_id long, is_fraud int, score double, amount_c long")


def test_optimal_threshold_is_the_grid_minimum(spark):
    def cost(t):
        return sum((a + 25) if y and s < t else (.22 * a + .32 * 1800) if not y and s >= t else 0
                   for y, s, a in zip(LABELS, SCORES, AMOUNTS))

    best = min(cost(k / 1000) for k in range(1, 1000))
    row = M.optimal_threshold(scored(spark)).first()
    assert math.isclose(row["cost"], best) and math.isclose(cost(row["threshold"]), best)


def test_separable_scores_are_perfect(spark, small_tasks):
    row = M.ranking_summary(scored(spark)).first()
    assert row["average_precision"] == 1.0 and row["roc_auc"] == 1.0 and row["recall_at_precision"] == 1.0


def test_reliability_counts_and_saturation(spark):
    df = spark.createDataFrame([(0, .05), (1, .85), (0, .15), (1, .75), (1, .95), (0, .25)], "is_fraud int, score double")
    assert M.reliability_curve(df).agg(F.sum("n")).first()[0] == 6
    part = spark.createDataFrame([(0, 0.0), (0, .5), (1, 1.0), (0, .2)], "is_fraud int, score double")
    assert M.brier_and_saturation(part).first()["saturated"] == 0.5


def test_calibration_error_ignores_thin_bins(spark):
    curve = spark.createDataFrame([(.001, .001, 100000), (.20, 1.00, 2)], "mean_predicted double, observed_rate double, n long")
    row = M.curve_error(curve).first()
    assert row["ece"] < 1e-4 and row["worst_bin"] < 1e-9
    thin = spark.createDataFrame([(.2, 1.0, 3)], curve.schema)
    assert M.curve_error(thin).first()["worst_bin"] is None


def test_triangles_of_a_complete_graph(spark, small_tasks):
    edges = spark.createDataFrame([(i, j) for i in range(6) for j in range(6)], "src_id long, dst_id long")
    assert G.triangles(edges).first()[0] == 20
    assert G.two_stars(edges).first()[0] == 6 * 10


def test_components_of_a_long_path(spark, small_tasks):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (200, 200)], "src_id long, dst_id long")
    sizes = {r["id"]: r["component_size"] for r in G.component_size(edges).collect()}
    assert sizes[0] == sizes[40] == 41 and sizes[101] == 2 and sizes[200] == 1


def test_pagerank_sums_to_one_with_dangling_and_hot_vertices(spark, small_tasks):
    edges = spark.createDataFrame([("h", f"v{i}", 1) for i in range(20)] + [("v1", "h", 2)], "src_id string, dst_id string, weight long")
    ranks, _ = G.pagerank(edges, max_iterations=5)
    assert math.isclose(ranks.agg(F.sum("rank")).first()[0], 1.0, abs_tol=1e-9)


def _events(spark, shift=0.0, n=400):
    return spark.range(n).select(
        F.col("id").alias("event_id"), (F.col("id") * 3_600_000_000).alias("us"), F.timestamp_micros(F.col("id") * 3_600_000_000).alias("event_ts"),
        ((F.col("id") * 7919) % 997 + 1 + shift).alias("amount"), (F.col("id") % 2 == 0).alias("cross_border"),
        F.lit("00").alias("response_code"), F.lit(False).alias("is_fraud"))


def test_ks_is_zero_on_itself_and_one_when_apart(spark, small_tasks):
    a = R.numeric_view(_events(spark))
    same = {r["column"]: r for r in R.ks_two_sample(a, a).collect()}
    assert same["amount"]["statistic"] == 0.0 and same["amount"]["p_value"] == 1.0
    far = {r["column"]: r for r in R.ks_two_sample(a, R.numeric_view(_events(spark, 5000.0))).collect()}
    assert far["amount"]["statistic"] == 1.0 and far["amount"]["p_value"] < 1e-6


def test_copied_record_has_distance_zero(spark):
    a, b = R.proximity_view(_events(spark)), R.proximity_view(_events(spark).filter("event_id = 17"))
    assert R.closest_record(b, a).first()[0] == 0.0
    assert R.closest_record(R.proximity_view(_events(spark, 0.25, 50)), a).first()[0] > 0.0


def test_registry_is_sound_and_checks_fire(spark):
    table = K.vectors(spark)
    assert K.registry_problems(table).count() == 0
    assert {r["rule"] for r in K.registry_problems(table.union(table.limit(1))).collect()} >= {"size", "duplicate_id"}


def test_reason_texts(spark):
    row = spark.range(1).select(
        D.reason_label(F.lit("declrate_payee_entity_id_24h")).alias("v"), D.reason_code(F.lit("cross_border")).alias("c"),
        D.reason_code(F.lit("what_is_this")).alias("g")).first()
    assert row == ("Decline rate to this beneficiary over the last 24h", "R058", "R000")
