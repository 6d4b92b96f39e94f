"""Queries over the typology detectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from paysieve.catalog.base import Catalog, frame, r6
from paysieve.catalog.features_q import _distinct_sql
from paysieve.catalog.views import acct_edges, canonical, evt, with_views
from paysieve.operators import features as P
from paysieve.operators import typology as T
from paysieve.operators.windows import DAY, HOUR

query = Catalog()
W6H = 6 * HOUR


@query("t01_enumeration", with_views("evt", f"""
WITH c AS ({_distinct_sql('device_id', 'pan_id', W6H, 'cards')}),
m AS (SELECT event_id, avg(amount_c) OVER f AS mean_cents, avg(declined) OVER f AS decline_rate FROM evt WINDOW f AS {frame('device_id', W6H)})
SELECT event_id, cards, round(mean_cents, 5) AS mean_cents, round(decline_rate, 6) AS decline_rate,
  coalesce(cards >= 3 AND mean_cents <= 20000 AND decline_rate >= 0.3, false) AS enumeration FROM c JOIN m USING (event_id)"""))
def _(spark, d):
    out = T.enumeration(evt(spark, d), card="pan_id", window=W6H, min_decline=0.3)
    return out.select("event_id", "cards", r6("mean_cents", 5), r6("decline_rate"), "enumeration")


@query("t02_bin_attack", with_views("evt", f"""
SELECT issuer_id, us // {HOUR} AS slot, count(DISTINCT payee_id) AS merchants, count(*) AS events FROM evt GROUP BY 1, 2 HAVING count(DISTINCT payee_id) >= 3"""))
def _(spark, d):
    return T.bin_concentration(evt(spark, d), "issuer_id", "payee_id")


@query("t02b_approval_after_declines", with_views("evt", """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY issuer_id ORDER BY us, event_id) AS rk FROM evt),
a AS (SELECT event_id, rk - coalesce(lag(rk) OVER (PARTITION BY issuer_id ORDER BY us, event_id), 0) - 1 AS declines_before FROM r WHERE declined = 0)
SELECT event_id, declines_before FROM a WHERE declines_before >= 3"""))
def _(spark, d):
    return T.approval_after_declines(evt(spark, d), "issuer_id").select("event_id", "declines_before")


@query("t03_escalating_payments", with_views("evt", f"""
WITH l AS (SELECT user_id, payee_id, us, event_id, amount_c, CASE WHEN amount_c > lag(amount_c) OVER w THEN 1 ELSE 0 END AS rise FROM evt
  WINDOW w AS (PARTITION BY user_id, payee_id ORDER BY us, event_id)),
i AS (SELECT *, sum(1 - rise) OVER (PARTITION BY user_id, payee_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS isl,
  min(us) OVER (PARTITION BY user_id, payee_id) AS f FROM l)
SELECT user_id, payee_id, CAST(sum(rise) AS BIGINT) AS rises, min(us) AS run_start_us, CAST(sum(amount_c) AS BIGINT) AS run_cents FROM i
GROUP BY user_id, payee_id, isl, f HAVING sum(rise) >= 2 AND min(us) - f <= {10 * DAY}"""))
def _(spark, d):
    return T.escalating_payments(evt(spark, d), "user_id", "payee_id", new_within=10 * DAY)


@query("t04_collect_abuse", with_views("evt", """
SELECT user_id, count(*) AS events, round(avg(CASE WHEN mcc = 'signup' THEN 1 ELSE 0 END), 6) AS collect_share,
  round(avg(CASE WHEN payee_name_match = false THEN 1 ELSE 0 END), 6) AS mismatch_share FROM evt GROUP BY 1
HAVING count(*) >= 5 AND avg(CASE WHEN mcc = 'signup' THEN 1 ELSE 0 END) >= 0.2 AND avg(CASE WHEN payee_name_match = false THEN 1 ELSE 0 END) >= 0.01"""))
def _(spark, d):
    out = T.collect_abuse(evt(spark, d), "user_id", F.col("mcc") == "signup", F.col("payee_name_match"), min_mismatch=0.01)
    return out.select("user_id", "events", r6("collect_share"), r6("mismatch_share"))


@query("t05_shared_device_ring", with_views("evt", f"""
WITH g AS (SELECT device_id, user_id, us, amount_c, us - lag(us) OVER (PARTITION BY device_id ORDER BY us, event_id) AS gap FROM evt),
s AS (SELECT device_id, count(DISTINCT user_id) AS payers, max(gap) / CAST(1000000 AS DOUBLE) AS dormant_s,
  regr_slope(CAST(amount_c AS DOUBLE), us / CAST(86400000000 AS DOUBLE)) AS ramp FROM g GROUP BY 1)
SELECT device_id, payers, round(dormant_s, 6) AS dormant_s, round(ramp, 3) AS ramp FROM s WHERE payers >= 3 AND dormant_s >= 3600 AND ramp > 0"""))
def _(spark, d):
    out = T.shared_device_ring(evt(spark, d), payer="user_id")
    return out.select("device_id", "payers", r6("dormant_s"), F.round("ramp", 3).alias("ramp"))


@query("t06_mandate_breaches", with_views("evt", """
WITH c AS (SELECT event_id, CASE WHEN coalesce(amount > mandate_amount_max, false) OR coalesce(us > mandate_expiry_us, false)
    OR coalesce(allowed_payee <> payee_id, false) THEN 1 ELSE 0 END AS mandate_scope_breach,
  CASE WHEN cart_hash_at_intent <> cart_hash_at_settle THEN 1 ELSE 0 END AS cart_hash_mismatch,
  CASE WHEN agent_attestation_valid = false THEN 1 ELSE 0 END AS attestation_invalid,
  CASE WHEN mandate_nonce IS NOT NULL AND row_number() OVER (PARTITION BY mandate_nonce ORDER BY us, event_id) > 1 THEN 1 ELSE 0 END AS nonce_reused,
  CASE WHEN allowed_payee <> payee_id THEN 1 ELSE 0 END AS payee_redirected FROM evt)
SELECT *, mandate_scope_breach + cart_hash_mismatch + attestation_invalid + nonce_reused + payee_redirected AS broken FROM c
WHERE mandate_scope_breach + cart_hash_mismatch + attestation_invalid + nonce_reused + payee_redirected > 0"""))
def _(spark, d):
    df = P.agentic(P.prepare(canonical(spark, d)))
    return T.mandate_breaches(df, F.element_at("mandate_merchant_allowlist", 1), F.col("payee_entity_id").cast("string"))


@query("t07_threshold_hugging", with_views("evt", """
SELECT rail_no, count(*) FILTER (WHERE score >= 0.7 - 0.05 AND score < 0.7) AS below, count(*) FILTER (WHERE score >= 0.7 AND score < 0.7 + 0.05) AS above,
  round(count(*) FILTER (WHERE score >= 0.7 - 0.05 AND score < 0.7) / CAST(nullif(count(*) FILTER (WHERE score >= 0.7 AND score < 0.7 + 0.05), 0) AS DOUBLE), 6) AS ratio
FROM evt GROUP BY 1"""))
def _(spark, d):
    return T.threshold_hugging(evt(spark, d), 0.7, 0.05, by=["rail_no"]).select("rail_no", "below", "above", r6("ratio"))


@query("t08_mule_pass_through", with_views("acct_edges", f"""
WITH f AS (SELECT a.event_id, a.dst, a.us, count(DISTINCT b.src) AS fan_in FROM acct_edges a JOIN acct_edges b
    ON a.dst = b.dst AND b.us >= a.us - {DAY} AND b.us < a.us GROUP BY ALL HAVING count(DISTINCT b.src) >= 3)
SELECT f.event_id, fan_in, count(*) AS onward, CAST(sum(o.amount_c) AS BIGINT) AS onward_cents FROM f JOIN acct_edges o
  ON o.src = f.dst AND o.us > f.us AND o.us <= f.us + {W6H} GROUP BY 1, 2"""))
def pass_through(spark, d):
    return T.pass_through(acct_edges(spark, d))


@query("t09_authentication_gap", with_views("evt", """
SELECT payer_country, count(*) AS gap_events, round(avg(declined), 6) AS decline_share FROM evt
WHERE cross_border AND payer_country < 4 AND coalesce(mcc <> 'click', true) GROUP BY 1"""))
def _(spark, d):
    out = T.authentication_gap(evt(spark, d), "payer_country", F.col("payer_country") < 4, F.col("mcc") == "click")
    return out.select("payer_country", "gap_events", r6("decline_share"))
