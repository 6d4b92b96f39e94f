"""Queries over the point-in-time features."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from paysieve.catalog import views as V
from paysieve.catalog.base import Catalog, frame, r6
from paysieve.catalog.views import canonical, evt, with_views
from paysieve.functions import numeric as N
from paysieve.operators import external as X
from paysieve.operators import features as P
from paysieve.operators import windows as W
from paysieve.operators.windows import DAY, HOUR, MINUTE

query = Catalog()
CLOCK = "(us // 3600000000) % 24 + ((us // 60000000) % 60) / 60.0"
BESSEL = ("list_sum(list_transform(range(0, 25), lambda m: pow({k} / 2, 2 * m) / "
          "pow(CAST(factorial(CAST(m AS INT)) AS DOUBLE), 2)))")


def context(spark, d):
    events = evt(spark, d)
    return P.FeatureContext(
        circadian=V.dimension(events, V.CIRCADIAN_SQL), coordinates=V.dimension(events, V.PLACES_SQL),
        control=V.dimension(events, V.CONTROL_SQL), first_seen=V.dimension(events, V.FIRST_SEEN_SQL),
    )


def frame_in(spark, d):
    return P.prepare(canonical(spark, d))


@query("f00_feature_context", with_views("evt", """
WITH m AS (SELECT payee_id AS entity_id, min(us) AS created_us, 0 AS r FROM evt GROUP BY 1),
t AS (SELECT device_id + 20 AS entity_id, min(us) + 5 AS created_us, 1 AS r FROM evt GROUP BY 1),
a AS (SELECT user_id AS entity_id, min(us) + 9 AS created_us, 2 AS r FROM evt GROUP BY 1)
SELECT entity_id, created_us AS first_us FROM (
  SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY r, created_us) AS n
  FROM (SELECT * FROM m UNION ALL SELECT * FROM t UNION ALL SELECT * FROM a)) WHERE n = 1"""))
def _(spark, d):
    e = evt(spark, d)
    merchants = e.groupBy(F.col("payee_id").alias("entity_id")).agg(
        F.min("us").alias("created_us"), F.max("payee_lat").alias("lat"), F.max("payee_lon").alias("lon"),
        F.lit(0.5).alias("control_strength"))
    terminals = e.groupBy((F.col("device_id") + 20).alias("entity_id")).agg((F.min("us") + 5).alias("created_us"))
    accounts = e.groupBy(F.col("user_id").alias("entity_id")).agg((F.min("us") + 9).alias("created_us"))
    holders = V.dimension(e, V.CIRCADIAN_SQL)
    return P.feature_context(merchants, terminals, accounts, holders).first_seen


@query("f01_amount_z", with_views("evt", f"""
SELECT event_id, round(CASE WHEN sd > 1e-4 THEN (amount_c - m) / sd ELSE 0 END, 5) AS z FROM (
  SELECT event_id, amount_c, avg(amount_c) OVER f AS m, stddev_samp(amount_c) OVER f AS sd FROM evt
  WINDOW f AS {frame('user_id', 7 * DAY)})"""))
def _(spark, d):
    out = P.amount_z_vs_history(frame_in(spark, d))
    return out.select("event_id", F.round("amount_z_vs_entity_history", 5).alias("z"))


@query("f02_circadian_loglik", with_views("evt", f"""
WITH c AS ({V.CIRCADIAN_SQL.format(src='evt')})
SELECT event_id, round(kappa * cos(2 * pi() * ({CLOCK}) / 24 - mu) - ln(2 * pi() * {BESSEL.format(k='kappa')}), 6)
  AS circadian_loglik FROM evt JOIN c ON user_id = entity_id"""))
def _(spark, d):
    return P.circadian(frame_in(spark, d), context(spark, d)).select("event_id", r6("circadian_loglik"))


@query("f03_mcc_novelty", with_views("evt", """
SELECT event_id, CASE WHEN row_number() OVER (PARTITION BY user_id, mcc ORDER BY us, event_id) = 1 THEN 1 ELSE 0 END
  AS novelty FROM evt"""))
def _(spark, d):
    return W.first_occurrence(evt(spark, d), "user_id", "mcc", "us", "event_id", "novelty").select("event_id", "novelty")


_KM = ("2 * {r} * asin(sqrt(least(greatest(pow(sin((radians(lat) - radians(plat)) / 2), 2) + cos(radians(plat)) * "
       "cos(radians(lat)) * pow(sin((radians(lon) - radians(plon)) / 2), 2), 0), 1)))")


@query("f04_impossible_travel", with_views("evt", f"""
WITH e AS (SELECT event_id, us, user_id, CASE WHEN payee_id < 38 THEN payee_lat ELSE 0 END AS lat,
    CASE WHEN payee_id < 38 THEN payee_lon ELSE 0 END AS lon FROM evt),
l AS (SELECT *, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon, lag(us) OVER w AS pus FROM e
    WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id))
SELECT event_id, round(CASE WHEN us - pus > 0 THEN {_KM.format(r=6371.0088)} / ((us - pus) / CAST(3600000000 AS DOUBLE)) ELSE 0 END, 4)
  AS kmh FROM l"""))
def _(spark, d):
    out = P.impossible_travel(frame_in(spark, d), context(spark, d))
    return out.select("event_id", F.round("impossible_travel_kmh", 4).alias("kmh"))


@query("f04b_travel_floor", with_views("evt", f"""
WITH l AS (SELECT event_id, us, payee_lat AS lat, payee_lon AS lon, lag(payee_lat) OVER w AS plat,
    lag(payee_lon) OVER w AS plon, lag(us) OVER w AS pus FROM evt
    WINDOW w AS (PARTITION BY pan_id ORDER BY us, event_id))
SELECT event_id, round(CASE WHEN pus IS NULL THEN 0 ELSE {_KM.format(r=6371.0)} /
  greatest((us - pus) / CAST(3600000000 AS DOUBLE), 60000000.0 / 3600000000.0) END, 4) AS kmh FROM l"""))
def _(spark, d):
    out = X.travel_with_floor(evt(spark, d), "pan_id", "payee_lat", "payee_lon", "us", name="kmh")
    return out.select("event_id", F.round("kmh", 4).alias("kmh"))


@query("f05_first_time_payee", with_views("evt", """
SELECT event_id, CASE WHEN row_number() OVER (PARTITION BY user_id, payee_id ORDER BY us, event_id) = 1 THEN 1 ELSE 0 END
  AS first_time_payee FROM evt"""))
def _(spark, d):
    return W.first_occurrence(evt(spark, d), "user_id", "payee_id", "us", "event_id", "first_time_payee").select(
        "event_id", "first_time_payee")


@query("f06_payee_age_hours", with_views("evt", f"""
WITH c AS ({V.FIRST_SEEN_SQL.format(src='evt')})
SELECT event_id, round(coalesce(greatest((us - coalesce(CASE WHEN mcc = 'click' THEN us - 7200000000 END, first_us))
  / CAST(3600000000 AS DOUBLE), 0), 0), 6) AS payee_age_hours FROM evt LEFT JOIN c ON payee_id = entity_id"""))
def _(spark, d):
    df = frame_in(spark, d).withColumn(
        "beneficiary_first_seen_ts", F.when(F.col("mcc") == "click", F.timestamp_micros(F.col("_us") - 2 * HOUR)))
    return P.payee_age(df, context(spark, d)).select("event_id", r6("payee_age_hours"))


@query("f07_device_terminal_age", with_views("evt", f"""
WITH c AS ({V.FIRST_SEEN_SQL.format(src='evt')})
SELECT event_id,
  round(CASE WHEN device_id % 8 <> 0 THEN greatest((us - (1701388800000000 + (device_id * 37 % 60) * 86400000000))
    / CAST(3600000000 AS DOUBLE), 0) ELSE 0 END, 6) AS device_age_hours,
  round(coalesce(greatest((us - first_us) / CAST(3600000000 AS DOUBLE), 0), 0) / 24, 6) AS terminal_age_days
FROM evt LEFT JOIN c ON payee_id = entity_id"""))
def _(spark, d):
    out = P.terminal_age(P.device_age(frame_in(spark, d)), context(spark, d), "merchant_id")
    return out.select("event_id", r6("device_age_hours"), r6("terminal_age_days"))


@query("f08_flags", with_views("evt", """
SELECT event_id, CAST(cross_border AS INT) AS cross_border, CASE WHEN event_id % 4 = 0 THEN 1 ELSE 0 END
  AS sca_exempt_flag FROM evt"""))
def _(spark, d):
    return P.flags(canonical(spark, d)).select("event_id", "cross_border", "sca_exempt_flag")


_TAIL = "ascii(right(coalesce(CAST(pan_id AS VARCHAR), '0'), 1)) % 10"
_SHARES = " + ".join(
    f"(CASE WHEN c{i} > 0 THEN -(CAST(c{i} AS DOUBLE) / t) * ln(CAST(c{i} AS DOUBLE) / t) ELSE 0 END)" for i in range(10))


@query("f09_bin_entropy", with_views("evt", f"""
WITH c AS (SELECT event_id, {", ".join(f"count(*) FILTER (WHERE {_TAIL} = {i}) OVER f AS c{i}" for i in range(10))},
  CAST(count(*) OVER f AS DOUBLE) AS t FROM evt WINDOW f AS {frame('device_id', 10 * MINUTE)})
SELECT event_id, round(CASE WHEN t > 0 THEN ({_SHARES}) / ln(10) ELSE 0 END, 6) AS bin_seq_entropy FROM c"""))
def _(spark, d):
    return P.bin_sequence_entropy(frame_in(spark, d)).select("event_id", r6("bin_seq_entropy"))


_DIGIT = "CASE WHEN amount_c > 0 THEN CAST(left(CAST(amount_c AS VARCHAR), 1) AS INT) ELSE 1 END"
_DEV = " + ".join(f"abs(CASE WHEN t > 0 THEN c{i} / t ELSE 0 END - log10(1 + 1.0 / {i}))" for i in range(1, 10))


@query("f10_merchant_benford", with_views("evt", f"""
WITH c AS (SELECT event_id, {", ".join(f"count(*) FILTER (WHERE {_DIGIT} = {i}) OVER f AS c{i}" for i in range(1, 10))},
  CAST(count(*) OVER f AS DOUBLE) AS t FROM evt WINDOW f AS {frame('payee_id', DAY)})
SELECT event_id, round(({_DEV}) / 9, 6) AS merchant_benford_dev_24h FROM c"""))
def _(spark, d):
    return P.merchant_benford(frame_in(spark, d)).select("event_id", r6("merchant_benford_dev_24h"))


@query("f10b_benford_digit_sum", with_views("evt", f"""
WITH c AS (SELECT event_id, {", ".join(f"count(*) FILTER (WHERE {_DIGIT} = {i}) OVER f AS c{i}" for i in range(1, 10))},
  CAST(count(*) OVER f AS DOUBLE) AS t FROM evt WINDOW f AS {frame('payee_id', DAY)})
SELECT event_id, round({_DEV}, 6) AS dev FROM c"""))
def _(spark, d):
    return X.benford_digit_sum(evt(spark, d), "payee_id", "us", "amount_c", name="dev").select("event_id", r6("dev"))


@query("f11_control_strength", with_views("evt", f"""
WITH c AS ({V.CONTROL_SQL.format(src='evt')})
SELECT event_id, round(coalesce(control_strength, 0.5), 6) AS merchant_control_strength
FROM evt LEFT JOIN c ON payee_id = entity_id"""))
def _(spark, d):
    return P.control_strength(frame_in(spark, d), context(spark, d)).select("event_id", r6("merchant_control_strength"))


def _distinct_sql(key, other, width, name):
    return f"""SELECT event_id, CAST(coalesce(sum(is_new) OVER {frame(key, width)}, 0) AS BIGINT) AS {name}
FROM (SELECT event_id, us, {key}, CASE WHEN p IS NULL OR us - p >= {width} THEN 1 ELSE 0 END AS is_new
  FROM (SELECT *, lag(us) OVER (PARTITION BY {key}, {other} ORDER BY us, event_id) AS p FROM evt))"""


@query("f12_distinct_pan_per_device", with_views("evt", _distinct_sql("device_id", "pan_id", 10 * MINUTE, "pans")))
def _(spark, d):
    return W.pit_distinct_approx(evt(spark, d), ["device_id"], "us", "pan_id", 10 * MINUTE, "event_id", "pans").select(
        "event_id", "pans")


@query("f13_fan_in_out_bank_degree", with_views("evt", f"""
WITH a AS ({_distinct_sql('payee_id', 'user_id', DAY, 'fanin')}), b AS ({_distinct_sql('user_id', 'payee_id', DAY, 'fanout')}),
c AS ({_distinct_sql('payee_id', 'issuer_id', 7 * DAY, 'bank_degree')})
SELECT event_id, fanin, fanout, bank_degree FROM a JOIN b USING (event_id) JOIN c USING (event_id)"""))
def _(spark, d):
    out = W.distinct_approx_block(evt(spark, d), ["payee_id"], "us",
                                  {"fanin": ("user_id", DAY), "bank_degree": ("issuer_id", 7 * DAY)}, "event_id")
    out = W.pit_distinct_approx(out, ["user_id"], "us", "payee_id", DAY, "event_id", "fanout")
    return out.select("event_id", "fanin", "fanout", "bank_degree")


@query("f13b_fan_counts", with_views("evt", f"""
SELECT event_id, count(amount_c) OVER {frame('payee_id', DAY)} AS fanin, count(amount_c) OVER {frame('pan_id', DAY)} AS fanout
FROM evt"""))
def _(spark, d):
    out = W.pit_count(evt(spark, d), ["payee_id"], "us", DAY, F.col("amount_c"), "fanin")
    return W.pit_count(out, ["pan_id"], "us", DAY, F.col("amount_c"), "fanout").select("event_id", "fanin", "fanout")


@query("f15_mandate_scope_breach", with_views("evt", """
SELECT event_id, CASE WHEN coalesce(amount > mandate_amount_max, false) OR coalesce(us > mandate_expiry_us, false)
  OR coalesce(allowed_payee <> payee_id, false) THEN 1 ELSE 0 END AS breach FROM evt"""))
def _(spark, d):
    out = P.agentic(frame_in(spark, d))
    return out.select("event_id", F.col("mandate_scope_breach").alias("breach"))


_AGENTIC = {
    "f16_cart_hash_mismatch": ("cart_hash_mismatch", "CASE WHEN cart_hash_at_intent <> cart_hash_at_settle THEN 1 ELSE 0 END"),
    "f17_attestation_invalid": ("attestation_invalid", "CASE WHEN agent_attestation_valid = false THEN 1 ELSE 0 END"),
    "f18_nonce_reused": ("nonce_reused", "CASE WHEN mandate_nonce IS NOT NULL AND row_number() OVER "
                         "(PARTITION BY mandate_nonce ORDER BY us, event_id) > 1 THEN 1 ELSE 0 END"),
    "f19_settle_delta": ("settle_vs_intent_amount_delta", "round(CASE WHEN mandate_amount_max > 0 THEN "
                         "(amount - mandate_amount_max) / mandate_amount_max ELSE 0 END, 6)"),
}
for _name, (_feature, _sql) in _AGENTIC.items():
    @query(_name, with_views("evt", f"SELECT event_id, {_sql} AS {_feature} FROM evt"))
    def _(spark, d, feature=_feature):
        value = r6(feature) if feature.startswith("settle") else F.col(feature)
        return P.agentic(frame_in(spark, d)).select("event_id", value)


@query("f20_tri_state", with_views("evt", """
SELECT event_id, coalesce(CAST(payee_name_match AS INT), -1) AS name_match,
  coalesce(CAST(agent_attestation_valid AS INT), -1) AS attested FROM evt"""))
def _(spark, d):
    return evt(spark, d).select("event_id", P.tri_state(F.col("payee_name_match")).alias("name_match"),
                                P.tri_state(F.col("agent_attestation_valid")).alias("attested"))


@query("f21_enum_codes", with_views("evt", """
SELECT event_id, CASE mcc WHEN 'click' THEN 2 WHEN 'purchase' THEN 1 WHEN 'view' THEN 0 ELSE -1 END AS eci_semantic_code,
  CASE mcc WHEN 'signup' THEN 1 ELSE 0 END AS upi_txn_type_code, -1 AS threeds_flow_code, -1 AS pos_entry_mode_code FROM evt"""))
def _(spark, d):
    return P.rail_codes(canonical(spark, d)).select(
        "event_id", "eci_semantic_code", "upi_txn_type_code", "threeds_flow_code", "pos_entry_mode_code")


def unrounded(sql):
    """The text without its round(value, digits) calls; round(value) stays."""
    begin = 0
    while (begin := sql.find("round(", begin)) >= 0:
        depth, at, comma = 1, begin + 6, -1
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[at], 0)
            comma = at if sql[at] == "," and depth == 1 else comma
            at += 1
        if comma < 0:
            begin += 6
        else:
            sql = sql[:begin] + "(" + sql[begin + 6: comma] + ")" + sql[at:]
    return sql


def _joined_sql(parts, names, digits, extra=""):
    """Columns of other queries' SQL side by side, as the single-precision features they become."""
    tables = " JOIN ".join(f"({unrounded(q)}) t{i} USING (event_id)" if i else f"({unrounded(q)}) t0" for i, q in enumerate(parts))
    value = "round(CAST(CAST({} AS FLOAT) AS DOUBLE), " + str(digits) + ") AS {}"
    return f"SELECT event_id, {', '.join(value.format(e, n) for n, e in names.items())}{extra} FROM {tables}"


def _velocity_sql(keys, windows, absent=(), null_declines=False):
    """Body of the block for all keys; with absent outcomes declines and empty frames stay null."""
    columns = []
    for name, col in keys.items():
        for label, width in windows.items():
            f, fill = frame(col, width), (lambda e: e) if null_declines else (lambda e: f"coalesce({e}, 0)")
            columns += [f"CAST(count(amount_c) OVER {f} AS DOUBLE) AS cnt_{name}_{label}",
                        f"coalesce(CAST(sum(amount_c) OVER {f} AS DOUBLE), 0) / 100 AS sum_{name}_{label}",
                        ("CAST(NULL AS DOUBLE)" if null_declines else fill(f"avg(declined) OVER {f}")) + f" AS declrate_{name}_{label}",
                        fill(f"stddev_samp(amount_c) OVER {f} / 100") + f" AS amtstd_{name}_{label}"]
    columns += [f"CAST(NULL AS DOUBLE) AS {a}_{k}_{w}" for k in absent for w in windows for a in W.VELOCITY_AGGREGATIONS]
    return with_views("evt", f"SELECT event_id, {', '.join(columns)} FROM evt")


_KEYS = {"pan_token": "pan_id", "device_id": "device_id", "ip": "ip_id", "merchant_id": "payee_id", "payee_entity_id": "payee_id", "agent_id": "agent_id"}
_BLOCK = [f"{a}_{k}_{w}" for k in _KEYS for w in W.VELOCITY_WINDOWS for a in W.VELOCITY_AGGREGATIONS]
_AGES = with_views("evt", f"""
WITH c AS ({V.FIRST_SEEN_SQL.format(src='evt')})
SELECT event_id, coalesce(greatest((us - p.first_us) / CAST(3600000000 AS DOUBLE), 0), 0) AS payee_age,
  coalesce(greatest((us - t.first_us) / CAST(3600000000 AS DOUBLE), 0), 0) / 24 AS terminal_age
FROM evt LEFT JOIN c p ON payee_id = p.entity_id LEFT JOIN c t ON user_id = t.entity_id""")
_SQL = query.oracle
_WHOLE = {
    **{n: n for n in _BLOCK}, "amount_z_vs_entity_history": "z", "circadian_loglik": "circadian_loglik", "mcc_novelty_for_entity": "novelty",
    "impossible_travel_kmh": "kmh", "first_time_payee": "first_time_payee", "payee_age_hours": "payee_age", "device_age_hours": "device_age_hours",
    "cross_border": "cross_border", "sca_exempt_flag": "sca_exempt_flag", "bin_seq_entropy": "bin_seq_entropy",
    "merchant_benford_dev_24h": "merchant_benford_dev_24h", "merchant_control_strength": "merchant_control_strength", "terminal_age_days": "terminal_age",
    "distinct_pan_per_device_10m": "pans", "fanin_payee_24h": "fanin", "fanout_payer_24h": "fanout", "payee_bank_degree": "bank_degree",
    "payer_pagerank": "0", "payee_pagerank": "0", "component_size": "1", "mandate_scope_breach": "breach", "cart_hash_mismatch": "cart_hash_mismatch",
    "attestation_invalid": "attestation_invalid", "nonce_reused": "nonce_reused", "settle_vs_intent_amount_delta": "settle_vs_intent_amount_delta",
    "human_present_flag_num": "-1", "eci_semantic_code": "eci_semantic_code", "threeds_flow_code": "threeds_flow_code",
    "pos_entry_mode_code": "pos_entry_mode_code", "payee_name_match_num": "name_match", "upi_txn_type_code": "upi_txn_type_code",
}
_PARTS = ("f01_amount_z", "f02_circadian_loglik", "f03_mcc_novelty", "f04_impossible_travel", "f05_first_time_payee", "f07_device_terminal_age", "f08_flags",
          "f09_bin_entropy", "f10_merchant_benford", "f11_control_strength", "f12_distinct_pan_per_device", "f13_fan_in_out_bank_degree",
          "f15_mandate_scope_breach", "f16_cart_hash_mismatch", "f17_attestation_invalid", "f18_nonce_reused", "f19_settle_delta", "f20_tri_state", "f21_enum_codes")


@query("f22_compute_features", _joined_sql([_velocity_sql(_KEYS, W.VELOCITY_WINDOWS), _AGES, *(_SQL[n] for n in _PARTS)], _WHOLE, 3))
def _(spark, d):
    out = P.compute_features(canonical(spark, d), context(spark, d))
    return out.select("event_id", *[F.round(F.col(c).cast("double"), 3).alias(c) for c in out.columns if c != "event_id"])


_CARD = with_views("evt", f"""
WITH g AS (SELECT event_id, us, payee_id * 1.0::DOUBLE AS lat, payee_id * 2.0::DOUBLE AS lon, pan_id FROM evt),
l AS (SELECT *, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon, lag(us) OVER w AS pus FROM g WINDOW w AS (PARTITION BY pan_id ORDER BY us, event_id)),
h AS (SELECT event_id, (us // 3600000000) % 24 AS hr FROM evt)
SELECT event_id, CASE WHEN pus IS NULL THEN 0 ELSE {_KM.format(r=6371.0)} / greatest((l.us - pus) / CAST(3600000000 AS DOUBLE), 60000000.0 / 3600000000.0) END AS kmh,
  CASE WHEN row_number() OVER (PARTITION BY evt.pan_id, payee_id ORDER BY evt.us, event_id) = 1 THEN 1 ELSE 0 END AS first_time_payee,
  (evt.us - min(evt.us) OVER (PARTITION BY evt.pan_id, payee_id)) / CAST(3600000000 AS DOUBLE) AS payee_age_hours,
  CASE WHEN row_number() OVER (PARTITION BY evt.pan_id, mcc ORDER BY evt.us, event_id) = 1 THEN 1 ELSE 0 END AS novelty,
  ln((1 + count(*) OVER (PARTITION BY evt.pan_id, hr ORDER BY evt.us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    / (24.0::DOUBLE + count(*) OVER o)) AS circadian,
  CASE WHEN count(*) OVER o >= 2 AND stddev_pop(amount_c) OVER o > 1e-7 THEN (amount_c - avg(amount_c) OVER o) / stddev_pop(amount_c) OVER o ELSE 0 END AS z
FROM l JOIN evt USING (event_id) JOIN h USING (event_id)
WINDOW o AS (PARTITION BY evt.pan_id ORDER BY evt.us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
_OUTSIDE = {
    **{n: n for n in _BLOCK}, "impossible_travel_kmh": "kmh", "first_time_payee": "first_time_payee", "payee_age_hours": "payee_age_hours",
    "mcc_novelty_for_entity": "novelty", "circadian_loglik": "circadian", "amount_z_vs_entity_history": "z", "merchant_benford_dev_24h": "dev",
    "fanin_payee_24h": "fanin", "fanout_payer_24h": "fanout",
}


@query("f23_compute_features_external", _joined_sql([
    _velocity_sql({k: _KEYS[k] for k in X.SUPPORTED_KEYS}, W.VELOCITY_WINDOWS, [k for k in _KEYS if k not in X.SUPPORTED_KEYS], True),
    _CARD, _SQL["f10b_benford_digit_sum"], _SQL["f13b_fan_counts"]], _OUTSIDE, 2))
def _(spark, d):
    df = canonical(spark, d).withColumns({"payer_lat": F.col("payee_entity_id") * 1.0, "payer_lon": F.col("payee_entity_id") * 2.0})
    out = X.compute_features_external(df, True)
    return out.select("event_id", *[F.round(F.col(c).cast("double"), 2).alias(c) for c in out.columns if c != "event_id"])
