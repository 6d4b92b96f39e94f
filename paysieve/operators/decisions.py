"""From scores to bands, reasons, alerts and round records."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Ladder bounds, actions and reason texts.
APPROVE_MAX, STEP_UP_MAX, HOLD_MAX, HOLD_MINUTES = 0.30, 0.70, 0.90, 15
BAND_ACTIONS = {
    "APPROVE": "Frictionless approval",
    "STEP_UP": "EMV 3DS 2.x challenge / biometric / push confirmation",
    "HOLD": f"{HOLD_MINUTES}-minute settlement delay + dynamic risk warning",
    "DECLINE_REVIEW": "Decline + SAR / AML analyst queue",
}
REASONS = {
    "distinct_pan_per_device_10m": ("R014", "Unusual velocity on this device"),
    "declrate_ip_1h": ("R031", "Elevated decline rate on originating network"),
    "merchant_control_strength": ("R022", "Merchant risk profile above threshold"),
    "cart_hash_mismatch": ("R047", "Cart contents changed after user approval"),
    "mandate_scope_breach": ("R048", "Payment outside the authorised mandate scope"),
    "attestation_invalid": ("R049", "Agent attestation could not be verified"),
    "nonce_reused": ("R050", "Mandate credential presented more than once"),
    "first_time_payee": ("R011", "First payment to this beneficiary"),
    "payee_age_hours": ("R012", "Beneficiary account recently created"),
    "impossible_travel_kmh": ("R018", "Location change faster than physically possible"),
    "fanin_payee_24h": ("R033", "Many payers converging on one beneficiary"),
    "amount_z_vs_entity_history": ("R007", "Amount far outside this customer's normal range"),
}
MORE_REASONS = {
    "eci_semantic_code": ("R052", "Authentication outcome weaker than usual for this customer"),
    "threeds_flow_code": ("R053", "Payment did not complete a strong authentication challenge"),
    "pos_entry_mode_code": ("R054", "Entry mode unusual for this acceptance channel"),
    "device_age_hours": ("R055", "Device first seen very recently"),
    "circadian_loglik": ("R056", "Transaction time unusual for this customer"),
    "bin_seq_entropy": ("R057", "Card numbers seen on this device span an improbable range"),
    "cross_border": ("R058", "Payment crosses a border"),
    "sca_exempt_flag": ("R059", "Authentication exemption claimed"),
    "mcc_novelty_for_entity": ("R060", "First purchase in this merchant category"),
    "merchant_benford_dev_24h": ("R061", "Merchant amount distribution deviates from expectation"),
    "terminal_age_days": ("R062", "Terminal recently commissioned"),
    "payee_bank_degree": ("R063", "Beneficiary bank serves an unusual number of payers"),
    "fanout_payer_24h": ("R064", "Payer sending to many beneficiaries"),
    "component_size": ("R065", "Entity sits in an unusually large linked cluster"),
    "payer_pagerank": ("R066", "Payer central to a linked entity cluster"),
    "payee_pagerank": ("R067", "Beneficiary central to a linked entity cluster"),
    "settle_vs_intent_amount_delta": ("R068", "Settled amount differs from the authorised ceiling"),
    "human_present_flag_num": ("R069", "No human present at authorisation"),
    "payee_name_match_num": ("R070", "Beneficiary name did not match the account record"),
    "upi_txn_type_code": ("R071", "Collect request rather than a push payment"),
}
VELOCITY_CODE = "R080"
VELOCITY_KIND_TEXT = {"cnt": "Transaction count", "sum": "Transaction value", "declrate": "Decline rate",
                      "amtstd": "Amount variability"}
VELOCITY_KEY_TEXT = {"pan_token": "on this card", "device_id": "on this device", "ip": "on this network",
                     "merchant_id": "at this merchant", "payee_entity_id": "to this beneficiary",
                     "agent_id": "for this agent"}
GENERIC_REASON = ("R000", "Model score driven by an unmapped feature")
# End of fixed values.
TOP_REASONS = 3
ALERT_ROWS = 200
IMPORTANCE_ROWS = 15


def _dictionary(table: Mapping[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for item in table.items() for x in item])


def ladder_band(score: Column) -> Column:
    return (F.when(score < APPROVE_MAX, "APPROVE").when(score < STEP_UP_MAX, "STEP_UP")
            .when(score < HOLD_MAX, "HOLD").otherwise("DECLINE_REVIEW"))


def band_action(band: Column) -> Column:
    return F.element_at(_dictionary(BAND_ACTIONS), band)


def reason_code(feature: Column) -> Column:
    known = {**REASONS, **MORE_REASONS}
    code = F.element_at(_dictionary({k: v[0] for k, v in known.items()}), feature)
    velocity = F.when(_velocity_text(feature).isNotNull(), F.lit(VELOCITY_CODE))
    return F.coalesce(code, velocity, F.lit(GENERIC_REASON[0]))


def reason_label(feature: Column) -> Column:
    known = {**REASONS, **MORE_REASONS}
    label = F.element_at(_dictionary({k: v[1] for k, v in known.items()}), feature)
    return F.coalesce(label, _velocity_text(feature), F.lit(GENERIC_REASON[1]))


def _velocity_text(feature: Column) -> Column:
    """'<aggregate> <key phrase> over the last <window>'; null unless the name is a velocity one."""
    kind = F.regexp_extract(feature, "^([^_]+)_(.+)_([^_]+)$", 1)
    key = F.regexp_extract(feature, "^([^_]+)_(.+)_([^_]+)$", 2)
    window = F.regexp_extract(feature, "^([^_]+)_(.+)_([^_]+)$", 3)
    return F.concat(F.element_at(_dictionary(VELOCITY_KIND_TEXT), kind), F.lit(" "),
                    F.element_at(_dictionary(VELOCITY_KEY_TEXT), key), F.lit(" over the last "), window)


def _top(values: Mapping[str, Column], k: int, only_fired: bool = False) -> Column:
    """The k entries of largest magnitude, inside the row: no explode, no shuffle."""
    entries = F.array(*[
        F.struct((-F.abs(v)).cast("double").alias("order"), F.lit(i).alias("place"), F.lit(n).alias("feature"),
                 v.cast("double").alias("value"))
        for i, (n, v) in enumerate(values.items())
    ])
    if only_fired:
        entries = F.filter(entries, lambda e: e["value"] != 0)
    return F.slice(F.array_sort(entries), 1, k)


def top_reasons(values: Mapping[str, Column], k: int = TOP_REASONS, only_fired: bool = False) -> Column:
    """Array of (rank, feature, code, label, value), largest magnitude first."""
    return F.transform(_top(values, k, only_fired), lambda e, i: F.struct(
        (i + 1).alias("rank"), e["feature"].alias("feature"), reason_code(e["feature"]).alias("code"),
        reason_label(e["feature"]).alias("label"), e["value"].alias("value")))


def reason_codes(df: DataFrame, contributions: Mapping[str, Column], k: int = TOP_REASONS, key="event_id"):
    """One row per event and reason, from per-feature contributions."""
    return df.select(key, F.inline(top_reasons(contributions, k)))


def fired_reasons(df: DataFrame, features: Sequence[str], k: int = TOP_REASONS, key="event_id"):
    """Mapped features that are not zero on the event, by magnitude."""
    mapped = {n: F.col(n) for n in REASONS if n in features}
    return df.select(key, F.inline(top_reasons(mapped, k, only_fired=True)))


def invariants() -> Column:
    """Four mandate checks from the agentic features."""
    return F.struct(
        (F.col("cart_hash_mismatch") == 0).alias("cart_hash_match"),
        (F.col("mandate_scope_breach") == 0).alias("mandate_in_scope"),
        (F.col("nonce_reused") == 1).alias("nonce_reused"),
        (F.col("attestation_invalid") == 0).alias("attestation_valid"))


def alerts(df: DataFrame, rows: int = ALERT_ROWS, score="score", tie="event_id",
           contributions: Mapping[str, Column] | None = None) -> DataFrame:
    """The highest scores with band, action, reasons and mandate checks. The reason columns are
    computed after the limit, on those rows only.
    """
    top = df.orderBy(F.col(score).desc(), F.col(tie)).limit(rows)
    out = top.withColumn("band", ladder_band(F.col(score)))
    out = out.withColumn("action", band_action(F.col("band")))
    if contributions:
        out = out.withColumn("reasons", top_reasons(contributions))
    if "cart_hash_mismatch" in df.columns:
        out = out.withColumn("invariants", invariants())
    return out


def feature_importance(df: DataFrame, contributions: Mapping[str, Column], k: int = IMPORTANCE_ROWS) -> DataFrame:
    """Mean absolute contribution per feature, largest first."""
    means = df.agg(*[F.avg(F.abs(v)).alias(n) for n, v in contributions.items()])
    return means.select(F.inline(F.array(*[
        F.struct(F.lit(n).alias("feature"), F.col(n).alias("importance")) for n in contributions
    ]))).orderBy(F.col("importance").desc(), "feature").limit(k)


# How a round ended, and the quality above which a result is suspect.
ROUND_STATUSES = ("COMPLETED", "FIDELITY_REJECTED", "NO_VALID_PROPOSALS", "MODEL_REGRESSION_KEPT_PREVIOUS")
SUSPICIOUS_AVERAGE_PRECISION = 0.95
# End of fixed values.


def round_record(
    df: DataFrame, round_no: int, threshold: float, status: str = "COMPLETED", label="is_fraud", score="score",
    cents="amount_c", vector="vector_id", campaign: str | None = None, blind: DataFrame | None = None,
    proposals: DataFrame | None = None, gate=None,
) -> DataFrame:
    """One row for the round table: ranking, error rates, cost and recall per vector.

    With a campaign column, its campaigns' rows and evasion; with a blind cohort, the same two figures for it; with checked
    proposals, how many are valid and the reasons of the others; with a gate, its verdict and composite. A round whose model
    did worse than the one before keeps that one, which ``model_retained`` tells.
    """
    from paysieve.operators import metrics as M

    if status not in ROUND_STATUSES:
        raise ValueError(f"unknown status {status}")
    parts = [
        M.ranking_summary(df, label, score), M.flag_rates(df, threshold, label, score),
        M.expected_cost(df, threshold, label, score, cents),
        M.recall_by(df.filter(F.col(vector).isNotNull()), vector, threshold, label, score).agg(
            F.map_from_entries(F.collect_list(F.struct(F.col(vector).cast("string"), F.col("recall"))))
            .alias("per_vector_recall")),  # at most one entry per registered vector
    ]
    if campaign:
        parts.append(M.recall_by(df.filter(F.col(campaign).isNotNull()), campaign, threshold, label, score).agg(
            F.sort_array(F.collect_list(F.struct(F.col(campaign).cast("string").alias("campaign_id"), F.col("rows").alias("n_events"), "evasion"))).alias("campaigns")))  # one entry per campaign of the round
    if blind is not None:
        parts += [M.average_precision(blind, label, score).withColumnRenamed("average_precision", "average_precision_blind"),
                  M.flag_rates(blind, threshold, label, score).select(F.col("evasion").alias("evasion_blind"))]
    if proposals is not None:
        bad = proposals.filter("reason <> 'ok'").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
        parts += [proposals.agg(F.count(F.lit(1)).alias("proposals_total"), F.count_if(F.col("reason") == "ok").alias("proposals_valid")),
                  bad.agg(F.map_from_entries(F.collect_list(F.struct("reason", "n"))).alias("proposals_rejected"))]  # one entry per reason
    row = parts[0].withColumn("round", F.lit(round_no))
    for part in parts[1:]:
        row = row.join(part.withColumn("round", F.lit(round_no)), "round")
    more = {"status": F.lit(status), "threshold": F.lit(threshold), "model_retained": F.lit(status != ROUND_STATUSES[3]),
            "suspicious": F.coalesce(F.col("average_precision") > SUSPICIOUS_AVERAGE_PRECISION, F.lit(False))}
    if gate is not None:
        more |= {"gate_passed": F.lit(gate.passed), "composite": F.lit(float(gate.composite)), "shadow": F.lit(gate.shadow), "shadow_failed": F.lit(gate.shadow_failed)}
    return row.withColumns(more)


def recall_matrix(rounds: DataFrame, recall="per_vector_recall", round_col="round") -> DataFrame:
    """Vectors by rounds; rounds without any recall are left out."""
    scored = rounds.filter(F.size(recall) > 0).select(
        F.concat(F.lit("R"), (F.col(round_col) + 1).cast("string")).alias("_r"), F.explode(recall).alias("vector_id", "recall"))
    return scored.groupBy("vector_id").pivot("_r").agg(F.first("recall"))


def scope_collapse(per_scope: DataFrame, margin: float = 0.20) -> DataFrame:
    """Network minus issuer quality, and whether the gap exceeds the margin."""
    pick = {s: F.max(F.when(F.col("scope") == s, F.col("average_precision"))) for s in ("NETWORK", "ISSUER")}
    gap = pick["NETWORK"] - pick["ISSUER"]
    return per_scope.agg(gap.alias("gap"), (gap > margin).alias("collapsed"))
