"""Known attack vectors, their coverage by features and recall, and parameter constraints."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paysieve import schema as S
from paysieve.operators.features import FEATURE_NAMES
from paysieve.operators.metrics import RECALL_BAR

EXPECTED_VECTORS = 32
# Rules of the registry and of the claims made beside it.
MIN_SIGNALS = 3
MAX_MECHANISM_CHARS = 200
STATUSES = ("documented", "emerging", "speculative")
DIFFICULTIES = ("low", "medium", "high")
PROVENANCES = ("independent", "vendor", "vendor_commissioned")
BANNED_VERBS = ("use", "run", "send", "exploit", "bypass", "install", "execute", "deploy", "obtain", "steal", "attack", "inject", "forge", "spoof",
                "generate", "create", "build", "harvest", "probe", "target", "evade", "defeat", "clone", "scrape")
CLAIM_COLUMNS = ("key", "value", "scope", "provenance", "attribution", "approved_text", "suffix")
INJECTOR_MODULES, INJECTOR_CLASSES = 8, 12
INTEGER_PARAMETERS = ("n_merchants", "bin_stride", "bin_prefix_count", "pans_per_bin", "victim_count", "ring_size", "device_share_factor", "thin_file_days",
                      "hidden_item_count", "spoofed_operator_count", "fan_in_degree", "hop_count")
LADDER_STEPS = (3, 8)
CONTROLLABLE_KINDS = ("cnt_", "sum_", "declrate_", "amtstd_")
CONTROLLABLE = ("amount_z_vs_entity_history", "cross_border", "sca_exempt_flag")
# End of fixed values.
CLAIM_SCHEMA = ", ".join(f"{c} string" for c in CLAIM_COLUMNS)


class Vector(NamedTuple):
    vector_id: str
    name: str
    rails: tuple[str, ...]
    tier: int
    status: str
    has_generator: bool
    expected_features: tuple[str, ...]
    held_out: bool


class Bound(NamedTuple):
    vector_id: str
    parameter: str
    lowest: float
    highest: float
    required: bool


# The attack vectors and the bounds of their parameters.
VECTORS = (
    Vector("V01", "PAN/CVV enumeration", ("CARD_CNP",), 1, "documented", True, ("distinct_pan_per_device_10m", "declrate_ip_1h", "bin_seq_entropy"), False),
    Vector("V02", "BIN attack", ("CARD_CNP",), 1, "documented", True, ("bin_seq_entropy", "declrate_merchant_id_1h", "cnt_ip_10min"), False),
    Vector("V03", "3DS2 frictionless-flow abuse", ("CARD_CNP",), 2, "emerging", False, ("threeds_flow_code", "eci_semantic_code", "cnt_device_id_24h"), False),
    Vector("V04", "Token provisioning fraud", ("CARD_CNP", "CARD_CP"), 2, "documented", False, ("device_age_hours", "impossible_travel_kmh", "amount_z_vs_entity_history"), False),
    Vector("V05", "Authorised push payment scam", ("UPI", "SEPA_INST", "ACH"), 1, "documented", True, ("first_time_payee", "payee_age_hours", "amount_z_vs_entity_history"), False),
    Vector("V06", "UPI collect-request and mandate abuse", ("UPI",), 1, "documented", True, ("upi_txn_type_code", "payee_name_match_num", "first_time_payee"), False),
    Vector("V07", "Synthetic identity at scale", ("CARD_CNP", "UPI", "SEPA_INST", "ACH"), 2, "documented", True, ("payer_pagerank", "component_size", "device_age_hours"), True),
    Vector("V08", "Deepfake video KYC bypass", ("CARD_CNP", "UPI"), 3, "documented", False, ("device_age_hours", "payer_pagerank", "component_size"), False),
    Vector("V09", "Voice-cloned call-centre takeover", ("CARD_CNP", "UPI"), 3, "documented", False, ("device_age_hours", "impossible_travel_kmh", "first_time_payee"), False),
    Vector("V10", "Document forgery at onboarding", ("CARD_CNP", "ACH"), 3, "documented", False, ("payer_pagerank", "component_size", "device_age_hours"), False),
    Vector("V11", "LLM-personalised romance and investment fraud", ("UPI", "SEPA_INST", "CARD_CNP"), 2, "documented", False, ("first_time_payee", "amount_z_vs_entity_history", "mcc_novelty_for_entity"), False),
    Vector("V12", "Business email compromise", ("ACH", "SEPA_INST"), 2, "documented", False, ("first_time_payee", "payee_age_hours", "amount_z_vs_entity_history"), False),
    Vector("V13", "Refund and chargeback abuse", ("CARD_CNP",), 3, "documented", False, ("cnt_pan_token_7d", "amount_z_vs_entity_history", "merchant_control_strength"), False),
    Vector("V14", "Invoice and vendor fraud", ("ACH", "SEPA_INST"), 3, "documented", False, ("first_time_payee", "payee_age_hours", "fanin_payee_24h"), False),
    Vector("V15", "Transaction laundering", ("CARD_CNP", "CARD_CP"), 3, "emerging", False, ("merchant_control_strength", "mcc_novelty_for_entity", "merchant_benford_dev_24h"), False),
    Vector("V16", "Fake merchant onboarding", ("CARD_CNP", "CARD_CP"), 3, "documented", False, ("merchant_control_strength", "payee_age_hours", "payee_bank_degree"), False),
    Vector("V17", "Collusive merchants and bust-out", ("CARD_CNP", "CARD_CP"), 3, "emerging", False, ("component_size", "payer_pagerank", "payee_pagerank"), False),
    Vector("V18", "Delegated agent credential abuse", ("AGENTIC",), 1, "speculative", True, ("mandate_scope_breach", "settle_vs_intent_amount_delta", "human_present_flag_num"), False),
    Vector("V19", "Prompt injection against agent checkout", ("AGENTIC",), 1, "emerging", True, ("cart_hash_mismatch", "settle_vs_intent_amount_delta", "human_present_flag_num"), False),
    Vector("V20", "Agent impersonation", ("AGENTIC",), 1, "emerging", True, ("attestation_invalid", "human_present_flag_num", "cnt_agent_id_1h"), False),
    Vector("V21", "Mandate replay and forgery", ("AGENTIC",), 1, "speculative", True, ("nonce_reused", "settle_vs_intent_amount_delta", "mandate_scope_breach"), False),
    Vector("V22", "Adversarial evasion of the fraud scorer", ("CARD_CNP", "UPI", "AGENTIC"), 2, "documented", True, ("amount_z_vs_entity_history", "declrate_ip_1h", "cnt_device_id_10min"), False),
    Vector("V23", "Training data poisoning", ("CARD_CNP", "UPI"), 3, "speculative", False, ("component_size", "payer_pagerank", "amount_z_vs_entity_history"), False),
    Vector("V24", "Model extraction via decline feedback", ("CARD_CNP",), 3, "speculative", False, ("cnt_pan_token_1h", "amount_z_vs_entity_history", "declrate_ip_1h"), False),
    Vector("V25", "Account takeover via GenAI phishing", ("CARD_CNP", "UPI", "SEPA_INST", "ACH"), 2, "documented", False, ("device_age_hours", "impossible_travel_kmh", "first_time_payee"), False),
    Vector("V26", "First-party and bust-out lending fraud", ("ACH",), 3, "documented", False, ("component_size", "payer_pagerank", "amount_z_vs_entity_history"), False),
    Vector("V27", "QR-code swap fraud", ("UPI", "CARD_CP"), 2, "documented", False, ("payee_name_match_num", "first_time_payee", "upi_txn_type_code"), False),
    Vector("V28", "Mule-network orchestration", ("UPI", "SEPA_INST", "ACH"), 1, "documented", True, ("fanin_payee_24h", "fanout_payer_24h", "payee_bank_degree", "component_size"), False),
    Vector("V29", "NFC relay and malicious mobile applications", ("CARD_CP",), 3, "documented", False, ("impossible_travel_kmh", "device_age_hours", "pos_entry_mode_code"), False),
    Vector("V30", "Deepfake-augmented executive wire fraud", ("ACH", "SEPA_INST"), 3, "documented", False, ("first_time_payee", "amount_z_vs_entity_history", "payee_age_hours"), False),
    Vector("V31", "Cross-border SCA-gap exploitation", ("CARD_CNP",), 2, "documented", True, ("cross_border", "sca_exempt_flag", "threeds_flow_code"), False),
    Vector("V32", "Adaptive concept-drift evasion", ("CARD_CNP", "UPI"), 3, "speculative", False, ("declrate_ip_1h", "amount_z_vs_entity_history", "mcc_novelty_for_entity"), False),
)
PARAMETER_BOUNDS = (
    Bound("V01", "probes_per_min", 0.5, 240, True),
    Bound("V01", "n_merchants", 1, 400, True),
    Bound("V01", "amount_band", 0, 0, True),
    Bound("V01", "bin_stride", 1, 64, False),
    Bound("V01", "dwell_s", 0, 3600, False),
    Bound("V02", "bin_prefix_count", 1, 8, True),
    Bound("V02", "pans_per_bin", 10, 5000, True),
    Bound("V02", "validation_amount", 0.5, 3, False),
    Bound("V05", "victim_count", 5, 200, True),
    Bound("V05", "grooming_days", 0, 30, False),
    Bound("V05", "first_payment_ratio", 0.1, 1, True),
    Bound("V05", "escalation_factor", 1, 3, False),
    Bound("V06", "collect_rate_per_hour", 1, 120, True),
    Bound("V06", "approval_rate", 0, 0.3, True),
    Bound("V06", "unknown_vpa_frac", 0, 1, False),
    Bound("V07", "ring_size", 5, 200, True),
    Bound("V07", "device_share_factor", 1, 20, True),
    Bound("V07", "ramp_slope", 0.1, 5, True),
    Bound("V07", "thin_file_days", 7, 365, False),
    Bound("V18", "overspend_ratio", 1, 5, True),
    Bound("V18", "off_allowlist_rate", 0, 1, True),
    Bound("V18", "expiry_margin_s", 0, 86400, False),
    Bound("V19", "cart_delta_pct", 0.01, 0.5, True),
    Bound("V19", "payee_sub_rate", 0, 1, True),
    Bound("V19", "hidden_item_count", 1, 5, False),
    Bound("V20", "attestation_invalid_frac", 0, 1, True),
    Bound("V20", "spoofed_operator_count", 1, 20, False),
    Bound("V21", "nonce_reuse_rate", 0, 1, True),
    Bound("V21", "replay_delay_s", 1, 86400, True),
    Bound("V22", "target_feature", 0, 0, True),
    Bound("V22", "perturbation_budget", 0, 1, True),
    Bound("V22", "threshold_margin", 0, 0.2, False),
    Bound("V28", "fan_in_degree", 3, 40, True),
    Bound("V28", "hop_count", 1, 5, True),
    Bound("V28", "dwell_minutes", 1, 240, True),
    Bound("V28", "amount_ladder", 0, 0, False),
    Bound("V31", "non_eea_routing_share", 0, 1, True),
    Bound("V31", "amount_band", 0, 0, True),
)
VECTOR_RAIL = {"V01": "CARD_CNP", "V02": "CARD_CNP", "V05": "UPI", "V06": "UPI", "V07": "CARD_CNP", "V18": "AGENTIC",
               "V19": "AGENTIC", "V20": "AGENTIC", "V21": "AGENTIC", "V22": "CARD_CNP", "V28": "SEPA_INST",
               "V31": "CARD_CNP"}
ACCOUNT_COUNT = 50_000
# Parameters that are not a single number; their form is checked apart from the bounds.
NOT_NUMERIC = ("amount_band", "target_feature", "amount_ladder")
# End of fixed values.


def vectors(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(v.vector_id, v.name, list(v.rails), v.tier, v.status, v.has_generator, list(v.expected_features), v.held_out) for v in VECTORS],
        "vector_id string, name string, rails array<string>, tier int, status string, has_generator boolean, "
        "expected_features array<string>, blind_holdout boolean")


def banned_verbs(text: Column) -> Column:
    """The banned verbs among the words of a text, sorted; words are split at white space and lose marks at their ends."""
    words = F.transform(F.split(F.lower(text), r"\s+"), lambda w: F.btrim(w, F.lit(".,;:()")))
    return F.array_sort(F.array_intersect(F.array(*[F.lit(v) for v in BANNED_VERBS]), words))


def registry_problems(table: DataFrame, expected: int = EXPECTED_VECTORS) -> DataFrame:
    """(rule, vector_id) for each broken rule. Empty when the registry is sound.

    Of the whole table: its size, unique ids, one held out. Of each row, where the columns exist: a value in every one,
    known status and difficulty, enough signals, a mechanism of a bounded length without a banned verb, a countermeasure.
    """
    whole = table.agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("vector_id").alias("ids"),
        F.count_if("blind_holdout").alias("held"))
    out = whole.select(F.inline(F.array_compact(F.array(*[
        F.when(bad, F.struct(F.lit(rule).alias("rule"), F.lit(None).cast("string").alias("vector_id")))
        for rule, bad in (("size", F.col("n") != expected), ("duplicate_id", F.col("ids") != F.col("n")),
                          ("one_holdout", F.col("held") != 1))]))))
    c = F.col
    needed = [n for n in ("name", "rails", "tier", "mechanism", "genai_delta", "observable_signals", "status", "sources", "sim_difficulty", "expected_features", "blind_holdout") if n in table.columns]
    missing = F.lit(False)
    for n in needed:
        missing = missing | c(n).isNull()
    checks = {"missing_value": missing, "status": ~c("status").isin(*STATUSES)}
    optional = {
        "observable_signals": {"signals": F.size("observable_signals") < MIN_SIGNALS},
        "mechanism": {"mechanism_length": F.length("mechanism") > MAX_MECHANISM_CHARS, "banned_verb": F.size(banned_verbs(c("mechanism"))) > 0},
        "sim_difficulty": {"difficulty": ~c("sim_difficulty").isin(*DIFFICULTIES)},
        "countermeasure": {"countermeasure": c("countermeasure").isNull() | (c("countermeasure") == "")},
    }
    for column, more in optional.items():
        if column in table.columns:
            checks |= more
    broken = F.array_compact(F.array(*[F.when(bad, F.lit(rule)) for rule, bad in checks.items()]))
    return out.unionByName(table.select(F.explode(broken).alias("rule"), "vector_id"))


def claims(spark: SparkSession, rows) -> DataFrame:
    """The claims table from rows of its seven values."""
    return spark.createDataFrame([tuple(r) for r in rows], CLAIM_SCHEMA)


def claim_problems(table: DataFrame) -> DataFrame:
    """(rule, key) for each broken rule: a value in every column, known provenance, no key twice, at least one claim."""
    c, missing = F.col, F.lit(False)
    for n in CLAIM_COLUMNS:
        missing = missing | c(n).isNull()
    each = F.array_compact(F.array(F.when(missing, F.lit("missing_value")), F.when(~c("provenance").isin(*PROVENANCES), F.lit("provenance"))))
    twice = table.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.lit("duplicate_key").alias("rule"), "key")
    none = table.agg(F.count(F.lit(1)).alias("n")).filter("n = 0").select(F.lit("no_claims").alias("rule"), F.lit(None).cast("string").alias("key"))
    return table.select(F.explode(each).alias("rule"), "key").unionByName(twice).unionByName(none)


def coverage(table: DataFrame, recall: DataFrame, bar: float = RECALL_BAR, features=FEATURE_NAMES) -> DataFrame:
    """Registry rows with recall (only where a generator exists) and the two coverage flags."""
    known = F.array(*[F.lit(n) for n in features])
    joined = table.join(recall.select("vector_id", F.col("recall").alias("_r")), "vector_id", "left")
    shown = F.when(F.col("has_generator"), F.col("_r"))
    return joined.select(
        *table.columns, shown.alias("recall"),
        (F.size(F.array_except("expected_features", known)) == 0).alias("has_expected_features"),
        F.coalesce(shown >= bar, F.lit(False)).alias("detected"))


def coverage_totals(covered: DataFrame, expected: int = EXPECTED_VECTORS, bar: float = RECALL_BAR) -> DataFrame:
    """One row over the coverage rows: vectors, generators and their share of the expected ones, vectors by status, features, detections."""
    with_generator = F.count_if("has_generator")
    return covered.agg(
        F.count(F.lit(1)).alias("total_vectors"), with_generator.alias("with_generator"), (with_generator / expected).alias("coverage"),
        *[F.count_if(F.col("status") == s).alias(s) for s in STATUSES], F.count_if("has_expected_features").alias("with_features"), F.count_if("detected").alias("detected")
    ).withColumns({"injector_modules": F.lit(INJECTOR_MODULES), "injector_classes": F.lit(INJECTOR_CLASSES), "recall_bar": F.lit(float(bar))})


def survivors(recall: DataFrame, bar: float = RECALL_BAR) -> DataFrame:
    return recall.filter(F.col("recall") < bar)


def coverage_in_view(table: DataFrame, rails=(), statuses=(), generator_only=False) -> DataFrame:
    """Rows passing the filters, and the share of them with a generator."""
    shown = table
    if rails:
        shown = shown.filter(F.arrays_overlap("rails", F.array(*[F.lit(r) for r in rails])))
    if statuses:
        shown = shown.filter(F.col("status").isin(*statuses))
    if generator_only:
        shown = shown.filter("has_generator")
    simulated = F.count_if("has_generator")
    return shown.agg(F.count(F.lit(1)).alias("rows"), simulated.alias("simulated"),
                     F.coalesce(F.try_divide(simulated, F.count(F.lit(1))), F.lit(0.0)).alias("share"))


def check_parameters(proposals: DataFrame, accounts: int = ACCOUNT_COUNT) -> DataFrame:
    """Adds ``reason`` to (vector_id, params map<string,double>, band_low, band_high): the first
    broken constraint, or 'ok'. The bounds are a literal inside the row expression: no join.

    Parameters that are no number come in ``texts`` (map<string,string>) and ``lists`` (map<string,array<double>>), where
    the table has these columns: a target feature must be one that an attacker can move, a ladder has a bounded number of steps.
    """
    by_vector: dict[str, list] = {}
    for b in PARAMETER_BOUNDS:
        by_vector.setdefault(b.vector_id, []).append((b.parameter, float(b.lowest), float(b.highest), b.required, b.parameter in INTEGER_PARAMETERS))
    bounds = F.create_map(*[x for v, items in by_vector.items() for x in (F.lit(v), F.array(*[
        F.struct(F.lit(n).alias("name"), F.lit(lo).alias("low"), F.lit(hi).alias("high"), F.lit(req).alias("need"), F.lit(whole).alias("whole"))
        for n, lo, hi, req, whole in items]))])
    limit = F.element_at(
        F.create_map(*[F.lit(x) for v, r in VECTOR_RAIL.items() for x in (v, S.RAIL_LIMITS[r])]), F.col("vector_id"))
    mine = F.element_at(bounds, F.col("vector_id"))
    params = F.col("params")
    text = F.col("texts")["target_feature"] if "texts" in proposals.columns else F.lit(None).cast("string")
    ladder = F.col("lists")["amount_ladder"] if "lists" in proposals.columns else F.lit(None).cast("array<double>")
    numeric = lambda b: ~b["name"].isin(*NOT_NUMERIC)
    has = lambda name, need=False: F.exists(mine, lambda b: (b["name"] == name) & (b["need"] if need else F.lit(True)))
    missing = F.exists(mine, lambda b: numeric(b) & b["need"] & params[b["name"]].isNull())
    outside = F.exists(mine, lambda b: numeric(b) & params[b["name"]].isNotNull() & (
        (params[b["name"]] < b["low"]) | (params[b["name"]] > b["high"])))
    fraction = F.exists(mine, lambda b: b["whole"] & (params[b["name"]] != F.floor(params[b["name"]])))
    unknown = F.size(F.array_except(F.map_keys(params), F.transform(mine, lambda b: b["name"]))) > 0
    wrong_kind = F.exists(F.map_keys(params), lambda n: n.isin(*NOT_NUMERIC))
    band_needed = has("amount_band", True) & (F.col("band_low").isNull() | F.col("band_high").isNull())
    text_needed = has("target_feature", True) & text.isNull()
    feature = F.lit(False)
    for start in CONTROLLABLE_KINDS:
        feature = feature | text.startswith(start)
    movable = text.isin(*FEATURE_NAMES) & (feature | text.isin(*CONTROLLABLE))
    stray = (text.isNotNull() & ~has("target_feature")) | (ladder.isNotNull() & ~has("amount_ladder"))
    steps = ladder.isNotNull() & (~F.size(ladder).between(*LADDER_STEPS) | F.exists(ladder, lambda x: x.isNull()))
    no = lambda c: F.coalesce(c, F.lit(False))
    reason = (
        F.when(mine.isNull(), "unknown vector").when(no(missing | band_needed | text_needed), "schema: missing")
        .when(no(wrong_kind), "schema: not a number").when(no(fraction), "schema: not an integer")
        .when(no(outside), "schema: out of range").when(no(unknown | stray), "schema: unknown parameter")
        .when(no(~movable), "schema: not a controllable feature").when(no(steps), "schema: ladder steps")
        .when(no(F.col("band_high") > limit), "amount exceeds rail limit")
        .when(no(F.col("band_low") > F.col("band_high")), "amount band order")
        .when(no(params["expiry_margin_s"] < 0), "mandate cannot settle after expiry")
        .when(no(params["fan_in_degree"] > accounts), "fan-in degree exceeds accounts").otherwise("ok"))
    return proposals.withColumn("reason", reason)
