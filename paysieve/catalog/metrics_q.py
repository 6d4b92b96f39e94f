"""Queries over evaluation, cost, reasons and the registry."""

from __future__ import annotations

from pyspark.sql import functions as F

from paysieve.catalog.base import Catalog, r6
from paysieve.catalog.splits_q import RAIL, RAIL_SQL
from paysieve.catalog.views import canonical, evt, with_views
from paysieve.operators import decisions as D
from paysieve.operators import features as P
from paysieve.operators.features import FEATURE_NAMES
from paysieve.operators import metrics as M
from paysieve.operators import registry as R

query = Catalog()
CURVE = """
g AS (SELECT {s} AS score, sum(is_fraud) AS pos, count(*) AS n FROM {src} GROUP BY 1),
c AS (SELECT *, sum(pos) OVER w AS tp, sum(n) OVER w AS cum FROM g
  WINDOW w AS (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""
AP = "sum(pos * CAST(tp AS DOUBLE) / cum) / sum(pos)"


@query("m01_average_precision", with_views("evt", f"WITH {CURVE.format(s='score', src='evt')} SELECT round({AP}, 6) AS average_precision FROM c"))
def _(spark, d):
    return M.average_precision(evt(spark, d)).select(r6("average_precision"))


@query("m02_roc_auc", with_views("evt", f"""WITH {CURVE.format(s='score', src='evt')}
SELECT round(sum((n - pos) * (tp - pos + pos / 2.0)) / (CAST(sum(pos) AS DOUBLE) * sum(n - pos)), 6) AS roc_auc FROM c"""))
def _(spark, d):
    return M.roc_auc(evt(spark, d)).select(r6("roc_auc"))


@query("m03_precision_recall", with_views("evt", f"""WITH {CURVE.format(s='score', src='evt')},
t AS (SELECT is_fraud, row_number() OVER (ORDER BY score DESC, event_id) AS rn, count(*) OVER () AS n FROM evt)
SELECT (SELECT round(avg(is_fraud), 6) FROM t WHERE rn <= greatest(n // 1000, 1)) AS precision_at_k,
  (SELECT round(coalesce(max(CASE WHEN CAST(tp AS DOUBLE) / cum >= 0.95 THEN tp END) / CAST(sum(pos) AS DOUBLE), 0), 6) FROM c) AS recall_at_precision,
  (SELECT round(count(*) FILTER (WHERE is_fraud = 0) / CAST(count(*) FILTER (WHERE is_fraud = 1) AS DOUBLE), 6) FROM evt WHERE score >= 0.7) AS fp_tp_ratio"""))
def _(spark, d):
    e = evt(spark, d)
    one = F.lit(1).alias("one")
    a = M.precision_at_k(e).select(one, r6("precision_at_k"))
    b = M.ranking_summary(e).select(one, r6("recall_at_precision"))
    c = M.confusion(e, 0.7).select(one, r6("fp_tp_ratio"))
    return a.join(b, "one").join(c, "one").drop("one")


@query("m04_flag_rates", with_views("evt", """
SELECT round(avg(CASE WHEN score >= 0.7 THEN 1 ELSE 0 END) FILTER (WHERE is_fraud = 0), 6) AS fpr,
  round(avg(CASE WHEN score < 0.7 THEN 1 ELSE 0 END) FILTER (WHERE is_fraud = 1), 6) AS evasion FROM evt"""))
def _(spark, d):
    return M.flag_rates(evt(spark, d), 0.7).select(r6("fpr"), r6("evasion"))


def _recall_sql(key):
    return f"""SELECT {key}, count(*) AS rows, round(avg(CASE WHEN score >= 0.8 THEN 1 ELSE 0 END), 6) AS recall,
  round(avg(CASE WHEN score < 0.8 THEN 1 ELSE 0 END), 6) AS evasion FROM evt WHERE is_fraud = 1 GROUP BY 1"""


@query("m05_evasion_per_campaign", with_views("evt", _recall_sql("campaign_no")))
def _(spark, d):
    return M.recall_by(evt(spark, d), "campaign_no", 0.8).select("campaign_no", "rows", r6("recall"), r6("evasion"))


@query("m05b_recall_per_vector", with_views("evt", _recall_sql("vector_no")))
def _(spark, d):
    return M.recall_by(evt(spark, d), "vector_no", 0.8).select("vector_no", "rows", r6("recall"), r6("evasion"))


@query("m06_pr_auc_per_vector", with_views("evt", """
WITH v AS (SELECT DISTINCT vector_no FROM evt WHERE is_fraud = 1),
g AS (SELECT v.vector_no, score, sum(is_fraud) AS pos, count(*) AS n FROM v JOIN evt ON is_fraud = 0 OR evt.vector_no = v.vector_no GROUP BY 1, 2),
c AS (SELECT *, sum(pos) OVER w AS tp, sum(n) OVER w AS cum FROM g
  WINDOW w AS (PARTITION BY vector_no ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT vector_no, round(sum(pos * CAST(tp AS DOUBLE) / cum) / sum(pos), 6) AS average_precision FROM c GROUP BY 1"""))
def _(spark, d):
    return M.average_precision_by_vector(evt(spark, d), "vector_no").select("vector_no", r6("average_precision"))


_BINS = "bins AS (SELECT CAST(least(floor(score * 10), 9) AS INT) AS bin, avg(score) AS mp, avg(is_fraud) AS ob, count(*) AS n FROM evt GROUP BY 1)"


@query("m07_reliability_curve", with_views("evt", f"""WITH {_BINS}
SELECT bin, round(mp, 6) AS mean_predicted, round(ob, 6) AS observed_rate, n FROM bins"""))
def _(spark, d):
    return M.reliability_curve(evt(spark, d)).select("bin", r6("mean_predicted"), r6("observed_rate"), "n")


@query("m08_calibration", with_views("evt", f"""WITH {_BINS}
SELECT round(sum(n * abs(mp - ob)) / sum(n), 6) AS ece, round(max(CASE WHEN n >= 30 THEN abs(mp - ob) END), 6) AS worst_bin,
  (SELECT round(avg((score - is_fraud) * (score - is_fraud)), 6) FROM evt) AS brier,
  (SELECT round(avg(CASE WHEN score <= 0 OR score >= 1 THEN 1 ELSE 0 END), 6) FROM evt) AS saturated FROM bins"""))
def _(spark, d):
    return M.calibration(evt(spark, d)).select(r6("ece"), r6("worst_bin"), r6("brier"), r6("saturated"))


_COST = ("CASE WHEN is_fraud = 1 AND score < {t} THEN amount_c * 100 + 250000 WHEN is_fraud = 0 AND score >= {t} "
         "THEN amount_c * 22 + 5760000 ELSE 0 END")


@query("m09_expected_cost", with_views("evt", f"""
SELECT round(sum({_COST.format(t='0.55')}) / CAST(10000 AS DOUBLE), 2) AS cost,
  round(sum({_COST.format(t='0.55')}) / CAST(10000 AS DOUBLE) / count(*) * 100000, 2) AS cost_per_100k FROM evt"""))
def _(spark, d):
    return M.expected_cost(evt(spark, d), 0.55).select(r6("cost", 2), r6("cost_per_100k", 2))


_GRID = f"""
WITH t AS (SELECT i AS threshold_no, i / CAST(1000 AS DOUBLE) AS t FROM range(1, 1000) r(i)),
c AS (SELECT threshold_no, sum({_COST.format(t='t')}) / CAST(10000 AS DOUBLE) AS cost,
  count(*) FILTER (WHERE is_fraud = 1 AND score >= t) AS tp, count(*) FILTER (WHERE is_fraud = 0 AND score >= t) AS fp,
  count(*) FILTER (WHERE is_fraud = 1 AND score < t) AS fn FROM t, evt GROUP BY 1)"""


@query("m10_optimal_threshold", with_views("evt", _GRID + """
SELECT round(threshold_no / CAST(1000 AS DOUBLE), 6) AS threshold, round(cost, 2) AS cost FROM c ORDER BY c.cost, threshold_no LIMIT 1"""))
def optimal(spark, d):
    return M.optimal_threshold(evt(spark, d)).select(r6("threshold"), r6("cost", 2))


@query("m11_closed_form_threshold", with_views("evt", """
SELECT event_id, round((amount * 0.22 + 576) / (amount * 0.22 + 576 + amount + 25), 6) AS threshold FROM evt"""))
def _(spark, d):
    return evt(spark, d).select("event_id", F.round(M.closed_form_threshold(F.col("amount")), 6).alias("threshold"))


@query("m12_cost_curve", with_views("evt", _GRID + " SELECT threshold_no, round(cost, 2) AS cost, tp, fp, fn FROM c"))
def _(spark, d):
    return M.cost_curve(evt(spark, d)).select(
        "threshold_no", r6("cost", 2), *[F.col(c).cast("bigint").alias(c) for c in ("tp", "fp", "fn")])


@query("m12b_confusion_median", with_views("evt", """
WITH a AS (SELECT count(*) FILTER (WHERE is_fraud = 1 AND score >= 0.6) AS tp, count(*) FILTER (WHERE is_fraud = 0 AND score >= 0.6) AS fp,
  count(*) FILTER (WHERE is_fraud = 1 AND score < 0.6) AS fn FROM evt),
m AS (SELECT amount_c / 100.0 AS x FROM (SELECT amount_c, row_number() OVER (ORDER BY amount_c, event_id) AS rn, count(*) OVER () AS n FROM evt)
  WHERE rn = n // 2 + 1)
SELECT tp, fp, fn, round(tp / CAST(tp + fp AS DOUBLE), 6) AS precision, round(tp / CAST(tp + fn AS DOUBLE), 6) AS recall,
  round(CAST(x AS DOUBLE), 2) AS median_amount, round((x * 0.22 + 576) / (x * 0.22 + 576 + x + 25), 6) AS threshold FROM a, m"""))
def _(spark, d):
    e, one = evt(spark, d), F.lit(1).alias("one")
    a = M.confusion(e, 0.6).select(one, "tp", "fp", "fn", r6("precision"), r6("recall"))
    b = M.median_threshold(e).select(one, r6("median_amount", 2), r6("threshold"))
    return a.join(b, "one").drop("one")


_BAND = "CASE WHEN score < 0.3 THEN 'APPROVE' WHEN score < 0.7 THEN 'STEP_UP' WHEN score < 0.9 THEN 'HOLD' ELSE 'DECLINE_REVIEW' END"


@query("m13_ladder_band", with_views("evt", f"""
WITH b AS (SELECT {_BAND} AS band FROM (SELECT score FROM evt UNION ALL SELECT CAST(event_id % 101 AS DOUBLE) / CAST(100 AS DOUBLE) FROM evt))
SELECT band, count(*) AS events, CASE band WHEN 'APPROVE' THEN 'Frictionless approval'
  WHEN 'STEP_UP' THEN 'EMV 3DS 2.x challenge / biometric / push confirmation'
  WHEN 'HOLD' THEN '15-minute settlement delay + dynamic risk warning'
  ELSE 'Decline + SAR / AML analyst queue' END AS action FROM b GROUP BY 1"""))
def _(spark, d):
    e = evt(spark, d)
    e = e.select("score").union(e.select((F.col("event_id") % 101).cast("double") / 100))  # so that every band occurs
    e = e.withColumn("band", D.ladder_band(F.col("score")))
    return e.withColumn("action", D.band_action(F.col("band"))).groupBy("band", "action").agg(F.count(F.lit(1)).alias("events"))


_GRAPH_SCORE = "CAST((event_id * 31) % 100 AS DOUBLE) / CAST(100 AS DOUBLE)"


def _two_ap_sql(first, second):
    return f"""
WITH s AS (SELECT is_fraud, {first} AS a, {second} AS b FROM evt),
ga AS (SELECT a AS score, sum(is_fraud) AS pos, count(*) AS n FROM s GROUP BY 1),
ca AS (SELECT *, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(n) OVER (ORDER BY score DESC) AS cum FROM ga),
gb AS (SELECT b AS score, sum(is_fraud) AS pos, count(*) AS n FROM s GROUP BY 1),
cb AS (SELECT *, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(n) OVER (ORDER BY score DESC) AS cum FROM gb),
r AS (SELECT (SELECT {AP} FROM ca) AS x, (SELECT {AP} FROM cb) AS y)"""


@query("m19_graph_channel_lift", with_views("evt", _two_ap_sql("score", f"(score + {_GRAPH_SCORE}) / 2") + """
SELECT round(x, 6) AS base, round(y, 6) AS fused, round(y - x, 6) AS lift, y - x >= 0.03 AS keep FROM r"""))
def _(spark, d):
    e = evt(spark, d).withColumn("graph_score", F.expr(_GRAPH_SCORE))
    return M.graph_channel_lift(e).select(r6("base"), r6("fused"), r6("lift"), "keep")


@query("m22_candidate_is_kept", with_views("evt", _two_ap_sql("score", _GRAPH_SCORE) + """
SELECT round(x, 6) AS incumbent, round(y, 6) AS candidate, y >= x AS kept FROM r"""))
def _(spark, d):
    e = evt(spark, d).withColumn("other", F.expr(_GRAPH_SCORE))
    return M.candidate_is_kept(e, "score", "other").select(r6("incumbent"), r6("candidate"), "kept")


_CONTRIB = {"cross_border": "amount_c % 101 - 50", "cnt_ip_1h": "k - 50", "unheard_of": "device_id - 12"}
_CONTRIB_SQL = " UNION ALL ".join(
    f"SELECT event_id, '{n}' AS feature, CAST({e} AS DOUBLE) AS value, {i} AS place FROM evt"
    for i, (n, e) in enumerate(_CONTRIB.items()))


def _contributions():
    return {n: F.expr(e).cast("double") for n, e in _CONTRIB.items()}


@query("m23_reason_codes", with_views("evt", f"""
WITH c AS ({_CONTRIB_SQL}), r AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY abs(value) DESC, place) AS rank FROM c)
SELECT event_id, CAST(rank AS INT) AS rank, feature, CASE feature WHEN 'cross_border' THEN 'R058' WHEN 'cnt_ip_1h' THEN 'R080' ELSE 'R000' END AS code,
  CASE feature WHEN 'cross_border' THEN 'Payment crosses a border' WHEN 'cnt_ip_1h' THEN 'Transaction count on this network over the last 1h'
    ELSE 'Model score driven by an unmapped feature' END AS label, value FROM r WHERE rank <= 2"""))
def _(spark, d):
    return D.reason_codes(evt(spark, d), _contributions(), 2)


@query("m24_fired_reasons", with_views("evt", """
WITH f AS (SELECT event_id, CASE WHEN cart_hash_at_intent <> cart_hash_at_settle THEN 1 ELSE 0 END AS a,
  CASE WHEN agent_attestation_valid = false THEN 1 ELSE 0 END AS b, CAST(k % 3 AS INT) AS c FROM evt),
s AS (SELECT event_id, 'cart_hash_mismatch' AS feature, a AS value, 1 AS place FROM f WHERE a <> 0
  UNION ALL SELECT event_id, 'attestation_invalid', b, 2 FROM f WHERE b <> 0 UNION ALL SELECT event_id, 'fanin_payee_24h', c, 3 FROM f WHERE c <> 0)
SELECT event_id, feature, CAST(row_number() OVER (PARTITION BY event_id ORDER BY value DESC, place) AS INT) AS rank, CAST(value AS DOUBLE) AS value FROM s"""))
def _(spark, d):
    df = P.agentic(P.prepare(canonical(spark, d))).withColumn("fanin_payee_24h", F.col("k") % 3)
    out = D.fired_reasons(df, ["cart_hash_mismatch", "attestation_invalid", "fanin_payee_24h"])
    return out.select("event_id", "feature", "rank", "value")


@query("m26_alerts", with_views("evt", f"""
WITH n AS (SELECT *, row_number() OVER (PARTITION BY mandate_nonce ORDER BY us, event_id) AS turn FROM evt)
SELECT event_id, round(score, 4) AS score, {_BAND} AS band, coalesce(cart_hash_at_intent = cart_hash_at_settle, true) AS cart_ok,
  NOT (coalesce(amount > mandate_amount_max, false) OR coalesce(us > mandate_expiry_us, false) OR coalesce(allowed_payee <> payee_id, false)) AS in_scope,
  mandate_nonce IS NOT NULL AND turn > 1 AS replayed, agent_attestation_valid IS DISTINCT FROM false AS attested,
  CASE WHEN abs(k - 50) >= abs(issuer_id * 10 - 45) THEN 'cross_border,cnt_ip_1h' ELSE 'cnt_ip_1h,cross_border' END AS reasons
FROM n ORDER BY n.score DESC, event_id LIMIT 200"""))
def _(spark, d):
    df = P.agentic(P.prepare(canonical(spark, d)))
    out = D.alerts(df, contributions={"cross_border": (F.col("k") - 50) * 1.0, "cnt_ip_1h": (F.col("issuer_id") * 10 - 45) * 1.0})
    i = F.col("invariants")
    return out.select("event_id", r6("score", 4), "band", i["cart_hash_match"].alias("cart_ok"), i["mandate_in_scope"].alias("in_scope"), i["nonce_reused"].alias("replayed"),
                      i["attestation_valid"].alias("attested"), F.array_join(F.transform("reasons", lambda x: x["feature"]), ",").alias("reasons"))


_VECTOR = "concat('V', lpad(CAST(5 + user_id % 20 AS STRING), 2, '0'))"


def _vector_recall(spark, d):
    return M.recall_by(evt(spark, d).withColumn("vector_id", F.expr(_VECTOR)), "vector_id", 0.75)


_REGISTRY_SQL = "reg(vector_id, status, has_generator, rails, holdout) AS (VALUES " + ", ".join(
    f"('{v.vector_id}', '{v.status}', {v.has_generator}, '{','.join(v.rails)}', {v.held_out})" for v in R.VECTORS) + ")"
_RECALL_SQL = "rec AS (SELECT 'V' || lpad(CAST(5 + user_id % 20 AS VARCHAR), 2, '0') AS vector_id, avg(CASE WHEN score >= 0.75 THEN 1 ELSE 0 END) AS recall, count(*) AS rows FROM evt WHERE is_fraud = 1 GROUP BY 1)"


_SOME_FEATURES = tuple(f for f in FEATURE_NAMES if f not in ("bin_seq_entropy", "payer_pagerank", "nonce_reused"))
_COVERED_SQL = f"""covered AS (SELECT reg.vector_id, status, has_generator, CASE WHEN has_generator THEN recall END AS recall,
  reg.vector_id NOT IN ({", ".join(f"'{v.vector_id}'" for v in R.VECTORS if not set(v.expected_features) <= set(_SOME_FEATURES))}) AS has_expected_features,
  coalesce(CASE WHEN has_generator THEN recall END >= 0.6, false) AS detected FROM reg LEFT JOIN rec USING (vector_id))"""


@query("m27_coverage", with_views("evt", f"""WITH {_REGISTRY_SQL}, {_RECALL_SQL}, {_COVERED_SQL}
SELECT vector_id, has_generator, round(recall, 6) AS recall, has_expected_features, detected FROM covered"""))
def _(spark, d):
    out = R.coverage(R.vectors(spark), _vector_recall(spark, d), features=_SOME_FEATURES)
    return out.select("vector_id", "has_generator", r6("recall"), "has_expected_features", "detected")


@query("m27b_coverage_totals", with_views("evt", f"""WITH {_REGISTRY_SQL}, {_RECALL_SQL}, {_COVERED_SQL}
SELECT count(*) AS total_vectors, count(*) FILTER (WHERE has_generator) AS with_generator, round(count(*) FILTER (WHERE has_generator) / 32.0E0, 6) AS coverage,
  {", ".join(f"count(*) FILTER (WHERE status = '{x}') AS {x}" for x in R.STATUSES)}, count(*) FILTER (WHERE has_expected_features) AS with_features,
  count(*) FILTER (WHERE detected) AS detected, 8 AS injector_modules, 12 AS injector_classes, 0.6E0 AS recall_bar FROM covered"""))
def _(spark, d):
    out = R.coverage_totals(R.coverage(R.vectors(spark), _vector_recall(spark, d), features=_SOME_FEATURES))
    return out.withColumn("coverage", F.round("coverage", 6))


@query("s10_registry_events", with_views("evt", f"""WITH {_REGISTRY_SQL}, {_RECALL_SQL}
SELECT vector_id, status, holdout AS blind_holdout, coalesce(rows, 0) AS rows, 0 AS problems FROM reg LEFT JOIN rec USING (vector_id)"""))
def _(spark, d):
    table = R.vectors(spark)
    problems = R.registry_problems(table).count()
    seen = _vector_recall(spark, d).select("vector_id", "rows")
    return table.join(seen, "vector_id", "left").select(
        "vector_id", "status", "blind_holdout", F.coalesce("rows", F.lit(0)).alias("rows"), F.lit(problems).alias("problems"))


#: A registry row for each user, with faults at known ids; the first of every rule's rows are sound.
_FAULTS = {"missing_value": "user_id % 29 = 0", "status": "user_id % 31 = 0", "signals": "user_id % 11 = 0", "mechanism_length": "user_id % 13 = 0",
           "banned_verb": "user_id % 7 = 0", "difficulty": "user_id % 17 = 0", "countermeasure": "user_id % 19 = 0"}


@query("s10b_registry_rules", with_views("evt", f"""WITH u AS (SELECT DISTINCT user_id FROM evt), r AS ({" UNION ALL ".join(f"SELECT '{rule}' AS rule, count(*) FILTER (WHERE {where}) AS rows FROM u" for rule, where in _FAULTS.items())}
UNION ALL SELECT 'size', CASE WHEN count(*) + 1 = 32 THEN 0 ELSE 1 END FROM u UNION ALL SELECT 'duplicate_id', 1 UNION ALL SELECT 'one_holdout', 1 FROM u HAVING count(*) FILTER (WHERE user_id % 2 = 0) + 1 <> 1)
SELECT rule, rows FROM r WHERE rows > 0"""))
def _(spark, d):
    """Every rule of the registry fires on the rows altered for it, and on no others."""
    users = evt(spark, d).select("user_id").distinct()
    one = users.agg(F.min("user_id").alias("user_id")).selectExpr("user_id", "true AS twin")
    rows = users.selectExpr("user_id", "false AS twin").unionByName(one)
    clean = "twin"
    said = lambda rule, good, bad: f"CASE WHEN NOT ({clean}) AND {_FAULTS[rule]} THEN {bad} ELSE {good} END"
    table = rows.selectExpr(
        "concat('V', user_id) AS vector_id", said("missing_value", "'name'", "CAST(NULL AS STRING)") + " AS name", "array('UPI') AS rails", "1 AS tier",
        f"concat({said('banned_verb', repr('the card is presented; then'), repr('agents (Bypass) checks, then'))}, {said('mechanism_length', repr(' it settles'), 'repeat(' + repr(' x') + ', 120)')}) AS mechanism",
        said("signals", "array('a', 'b', 'c')", "array('a', 'b')") + " AS observable_signals", said("status", "'emerging'", "'rumoured'") + " AS status",
        said("difficulty", "'low'", "'none'") + " AS sim_difficulty", said("countermeasure", "'limits'", "''") + " AS countermeasure", "user_id % 2 = 0 OR twin AS blind_holdout")
    return R.registry_problems(table).groupBy("rule").agg(F.count(F.lit(1)).alias("rows"))


@query("s10c_claim_rules", with_views("evt", """WITH u AS (SELECT DISTINCT user_id FROM evt), r AS (
SELECT 'missing_value' AS rule, count(*) FILTER (WHERE user_id % 5 = 0) AS rows FROM u UNION ALL SELECT 'provenance', count(*) FILTER (WHERE user_id % 7 = 0) FROM u
UNION ALL SELECT 'duplicate_key', count(*) FROM (SELECT user_id // 2 AS k FROM u GROUP BY 1 HAVING count(*) > 1))
SELECT rule, rows FROM r WHERE rows > 0"""))
def _(spark, d):
    table = evt(spark, d).select("user_id").distinct().selectExpr(
        "concat('claim ', user_id DIV 2) AS key", "CASE WHEN user_id % 5 = 0 THEN NULL ELSE '0.9' END AS value", "'cards' AS scope",
        "CASE WHEN user_id % 7 = 0 THEN 'hearsay' ELSE 'vendor' END AS provenance", "'a report' AS attribution", "'text' AS approved_text", "'' AS suffix")
    return R.claim_problems(table).groupBy("rule").agg(F.count(F.lit(1)).alias("rows"))


@query("m28_survivors", with_views("evt", f"WITH {_RECALL_SQL} SELECT vector_id, round(recall, 6) AS recall FROM rec WHERE recall < 0.6"))
def _(spark, d):
    return R.survivors(_vector_recall(spark, d)).select("vector_id", r6("recall"))


@query("m29_round_metrics", with_views("evt", f"""WITH {CURVE.format(s='score', src='evt')}, v AS (SELECT vector_no, avg(CASE WHEN score >= 0.7 THEN 1 ELSE 0 END) AS recall FROM evt WHERE is_fraud = 1 GROUP BY 1),
m AS (SELECT campaign_no, count(*) AS n, avg(CASE WHEN score >= 0.7 THEN 0 ELSE 1 END) AS evasion FROM evt WHERE is_fraud = 1 GROUP BY 1)
SELECT 2 AS round, (SELECT round({AP}, 6) FROM c) AS average_precision,
  (SELECT round(avg(CASE WHEN score >= 0.7 THEN 1 ELSE 0 END), 6) FROM evt WHERE is_fraud = 0) AS fpr,
  (SELECT round(sum({_COST.format(t='0.7')}) / CAST(10000 AS DOUBLE), 2) FROM evt) AS cost,
  (SELECT string_agg(vector_no || ':' || CAST(round(recall * 1000) AS INT), ',' ORDER BY vector_no) FROM v) AS recalls,
  (SELECT string_agg(campaign_no || ':' || n || ':' || CAST(round(evasion * 1000) AS INT), ',' ORDER BY CAST(campaign_no AS VARCHAR)) FROM m) AS campaigns,
  (SELECT round(avg(CASE WHEN score >= 0.7 THEN 0 ELSE 1 END), 6) FROM evt WHERE is_fraud = 1 AND in_blind_cohort) AS evasion_blind,
  (SELECT count(*) FROM evt WHERE event_id % 4 < 3) AS proposals_total, (SELECT count(*) FROM evt WHERE event_id % 4 < 3 AND k BETWEEN 1 AND 20 AND event_id % 4 <> 1) AS proposals_valid,
  'MODEL_REGRESSION_KEPT_PREVIOUS' AS status, false AS model_retained, false AS suspicious, false AS gate_passed, 'joint' AS shadow"""))
def _(spark, d):
    """All verdict columns of a round whose model was worse than the one before."""
    from paysieve.operators.models import Gate

    df = evt(spark, d)
    offers = df.filter("event_id % 4 < 3").selectExpr("IF(event_id % 4 = 1, 'V99', 'V20') AS vector_id", "map('attestation_invalid_frac', 0.5D, 'spoofed_operator_count', CAST(k AS DOUBLE)) AS params",
                                                      "CAST(NULL AS DOUBLE) AS band_low", "CAST(NULL AS DOUBLE) AS band_high")
    gate = Gate(df, False, "joint", True, 1.5, ("privacy",))
    out = D.round_record(df, 2, 0.7, D.ROUND_STATUSES[3], vector="vector_no", campaign="campaign_no", blind=df.filter("in_blind_cohort"), proposals=R.check_parameters(offers), gate=gate)
    thousandths = lambda x: F.round(x * 1000).cast("int").cast("string")
    recalls = F.array_sort(F.transform(F.map_entries("per_vector_recall"), lambda x: F.concat_ws(":", x["key"], thousandths(x["value"]))))
    campaigns = F.transform("campaigns", lambda x: F.concat_ws(":", x["campaign_id"], x["n_events"].cast("string"), thousandths(x["evasion"])))
    return out.select("round", r6("average_precision"), r6("fpr"), r6("cost", 2), F.array_join(recalls, ",").alias("recalls"), F.array_join(campaigns, ",").alias("campaigns"),
                      r6("evasion_blind"), "proposals_total", "proposals_valid", "status", "model_retained", "suspicious", "gate_passed", "shadow")


@query("m33_constraints", with_views("evt", """
SELECT event_id, CASE WHEN event_id % 5 = 3 THEN 'unknown vector'
  WHEN event_id % 7 = 0 THEN 'schema: missing' WHEN event_id % 23 = 0 THEN 'schema: not a number' WHEN event_id % 5 < 3 AND event_id % 13 = 0 THEN 'schema: not an integer'
  WHEN event_id % 5 = 4 AND k > 90 OR event_id % 5 < 3 AND k < 1 OR event_id % 5 = 0 AND k * 5 > 400 OR event_id % 5 = 1 AND (k > 40 OR k < 3) OR event_id % 5 = 2 AND k < 5 THEN 'schema: out of range'
  WHEN event_id % 11 = 0 THEN 'schema: unknown parameter'
  WHEN event_id % 5 = 4 AND event_id % 3 = 0 THEN 'schema: not a controllable feature'
  WHEN event_id % 5 = 1 AND event_id % 9 < 2 THEN 'schema: ladder steps'
  WHEN event_id % 5 = 0 AND amount * 1200 > 500000 THEN 'amount exceeds rail limit'
  WHEN event_id % 5 = 0 AND event_id % 3 = 0 AND amount > 0 THEN 'amount band order' ELSE 'ok' END AS reason FROM evt"""))
def _(spark, d):
    first = "CASE event_id % 5 WHEN 0 THEN 'n_merchants' WHEN 1 THEN 'fan_in_degree' WHEN 2 THEN 'victim_count' WHEN 4 THEN 'perturbation_budget' ELSE 'x' END"
    value = "CAST(CASE event_id % 5 WHEN 0 THEN k * 5 WHEN 4 THEN IF(k > 90, 2, 0.5) ELSE k END AS DOUBLE) + IF(event_id % 5 < 3 AND event_id % 13 = 0, 0.5D, 0D)"
    df = evt(spark, d).selectExpr(
        "event_id", "CASE event_id % 5 WHEN 0 THEN 'V01' WHEN 1 THEN 'V28' WHEN 2 THEN 'V05' WHEN 4 THEN 'V22' ELSE 'V99' END AS vector_id",
        f"""map_filter(map_concat(map({first}, CASE WHEN event_id % 7 <> 0 THEN {value} END),
          map('probes_per_min', IF(event_id % 5 = 0, 2D, NULL), 'hop_count', IF(event_id % 5 = 1, 2D, NULL),
              'dwell_minutes', IF(event_id % 5 = 1, 9D, NULL), 'first_payment_ratio', IF(event_id % 5 = 2, 0.5D, NULL),
              'surprise', IF(event_id % 11 = 0, 1D, NULL), 'amount_band', IF(event_id % 23 = 0, 1D, NULL))), (a, b) -> b IS NOT NULL) AS params""",
        "CASE WHEN event_id % 5 = 0 THEN amount * 1200 * IF(event_id % 3 = 0, 2, 0.5) END AS band_low",
        "CASE WHEN event_id % 5 = 0 THEN amount * 1200 END AS band_high",
        "map_filter(map('target_feature', CASE WHEN event_id % 5 = 4 THEN IF(event_id % 3 = 0, 'payer_pagerank', 'cnt_device_id_24h') END), (a, b) -> b IS NOT NULL) AS texts",
        "map_filter(map('amount_ladder', CASE WHEN event_id % 5 = 1 THEN array_repeat(10D, IF(event_id % 9 < 2, 2, 4)) END), (a, b) -> b IS NOT NULL) AS lists")
    return R.check_parameters(df).select("event_id", "reason")


@query("m34_feature_importance", with_views("evt", f"""WITH c AS ({_CONTRIB_SQL})
SELECT feature, round(avg(abs(value)), 6) AS importance FROM c GROUP BY 1"""))
def _(spark, d):
    return D.feature_importance(evt(spark, d), _contributions()).select("feature", r6("importance"))


@query("m35_recall_matrix", with_views("evt", """
WITH r AS (SELECT 'V0' || CAST(vector_no AS VARCHAR) AS vector_id, rail_no % 3 AS round, avg(CASE WHEN score >= 0.8 THEN 1 ELSE 0 END) AS recall
  FROM evt WHERE is_fraud = 1 AND rail_no % 3 < 2 GROUP BY 1, 2)
SELECT vector_id, round(max(recall) FILTER (WHERE round = 0), 6) AS "R1", round(max(recall) FILTER (WHERE round = 1), 6) AS "R2" FROM r GROUP BY 1"""))
def _(spark, d):
    fraud = evt(spark, d).filter("is_fraud = 1").withColumns(
        {"round": F.col("rail_no") % 3, "v": F.concat(F.lit("V0"), F.col("vector_no").cast("string"))})
    per = fraud.groupBy("round", "v").agg(F.avg((F.col("score") >= 0.8).cast("int")).alias("recall"))
    entry = F.when(F.col("round") < 2, F.struct("v", "recall"))
    rounds = per.groupBy("round").agg(F.map_from_entries(F.collect_list(entry)).alias("per_vector_recall"))
    return D.recall_matrix(rounds).select("vector_id", r6("R1"), r6("R2"))


@query("m36_coverage_in_view", with_views("evt", f"""WITH {_REGISTRY_SQL}, {_RECALL_SQL}
SELECT count(*) AS rows, count(*) FILTER (WHERE has_generator) AS simulated, round(count(*) FILTER (WHERE has_generator) / CAST(count(*) AS DOUBLE), 6) AS share
FROM reg WHERE status = 'documented' AND contains(rails, 'UPI') AND vector_id IN (SELECT vector_id FROM rec)"""))
def _(spark, d):
    table = R.vectors(spark).join(_vector_recall(spark, d).select("vector_id"), "vector_id", "left_semi")
    return R.coverage_in_view(table, ["UPI"], ["documented"]).select("rows", "simulated", r6("share"))


@query("m21_scope_collapse", with_views("evt", """
WITH s AS (SELECT 'NETWORK' AS scope, score, is_fraud FROM evt UNION ALL SELECT 'ISSUER', score, is_fraud FROM evt WHERE issuer_id = 7),
g AS (SELECT scope, score, sum(is_fraud) AS pos, count(*) AS n FROM s GROUP BY 1, 2),
c AS (SELECT *, sum(pos) OVER w AS tp, sum(n) OVER w AS cum FROM g WINDOW w AS (PARTITION BY scope ORDER BY score DESC)),
a AS (SELECT scope, sum(pos * CAST(tp AS DOUBLE) / cum) / sum(pos) AS ap FROM c GROUP BY 1)
SELECT round(max(ap) FILTER (WHERE scope = 'NETWORK') - max(ap) FILTER (WHERE scope = 'ISSUER'), 6) AS gap,
  max(ap) FILTER (WHERE scope = 'NETWORK') - max(ap) FILTER (WHERE scope = 'ISSUER') > 0.2 AS collapsed FROM a"""))
def _(spark, d):
    from paysieve.operators.validation import party_view
    e = evt(spark, d)
    both = e.withColumn("scope", F.lit("NETWORK")).unionByName(party_view(e, "ISSUER", 7).withColumn("scope", F.lit("ISSUER")))
    return D.scope_collapse(M.average_precision(both, keys=["scope"])).select(r6("gap"), "collapsed")
