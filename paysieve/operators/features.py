"""The 151 point-in-time features of a payment event.

Each family adds columns to a frame that carries ``_us`` (event time in microseconds),
``_cents`` and ``_declined``; `prepare` adds those from canonical columns.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paysieve import schema as S
from paysieve.functions import numeric as N
from paysieve.operators.windows import (
    all_narrow,
    DAY, HOUR, MINUTE, SECOND, VELOCITY_AGGREGATIONS, VELOCITY_KEYS, VELOCITY_WINDOWS, Measure, trailing,
    velocity_block,
)
from paysieve.plans.scan import first_rows, previous_row
from paysieve.plans.skew import Layout, attach_group_stats, plan_layouts

VELOCITY_FEATURES = tuple(
    f"{a}_{k}_{w}" for k in VELOCITY_KEYS for w in VELOCITY_WINDOWS for a in VELOCITY_AGGREGATIONS
)
PERSONAL_FEATURES = ("amount_z_vs_entity_history", "circadian_loglik", "mcc_novelty_for_entity",
                     "impossible_travel_kmh")
STRUCTURAL_FEATURES = ("first_time_payee", "payee_age_hours", "device_age_hours", "cross_border", "sca_exempt_flag",
                       "bin_seq_entropy", "merchant_benford_dev_24h", "merchant_control_strength",
                       "terminal_age_days", "distinct_pan_per_device_10m")
GRAPH_FEATURES = ("fanin_payee_24h", "fanout_payer_24h", "payee_bank_degree", "payer_pagerank", "payee_pagerank",
                  "component_size")
AGENTIC_FEATURES = ("mandate_scope_breach", "cart_hash_mismatch", "attestation_invalid", "nonce_reused",
                    "settle_vs_intent_amount_delta", "human_present_flag_num")
RAIL_FEATURES = ("eci_semantic_code", "threeds_flow_code", "pos_entry_mode_code", "payee_name_match_num",
                 "upi_txn_type_code")
FEATURE_NAMES = (VELOCITY_FEATURES + PERSONAL_FEATURES + STRUCTURAL_FEATURES + GRAPH_FEATURES + AGENTIC_FEATURES
                 + RAIL_FEATURES)
MIN_STD = 1e-6
DEFAULT_MU, DEFAULT_KAPPA, DEFAULT_CONTROL = 0.0, 2.0, 0.5


@dataclass(frozen=True)
class FeatureContext:
    """Entity dimensions, each keyed by ``entity_id`` with one row per entity."""

    circadian: DataFrame | None = None  # mu, kappa
    coordinates: DataFrame | None = None  # lat, lon
    control: DataFrame | None = None  # control_strength
    first_seen: DataFrame | None = None  # first_us
    pagerank: DataFrame | None = None  # rank
    components: DataFrame | None = None  # component_size


def keep_first(dimension: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """One row per key: the value that comes first in ``order`` (min_by, so no window)."""
    return dimension.groupBy(key).agg(F.min_by(value, order).alias(value))


def feature_context(
    merchants: DataFrame, terminals: DataFrame, accounts: DataFrame, holders: DataFrame,
    pagerank: DataFrame | None = None, components: DataFrame | None = None,
) -> FeatureContext:
    """Dimensions from entity tables: (entity_id, created_us) and, where present, mu/kappa,
    lat/lon, control_strength. A duplicate id keeps merchants before terminals before accounts.
    """
    created = [
        part.select("entity_id", "created_us", F.lit(rank).alias("_rank"))
        for rank, part in enumerate((merchants, terminals, accounts))
    ]
    stacked = created[0].unionByName(created[1]).unionByName(created[2])
    first_seen = stacked.groupBy("entity_id").agg(
        F.min_by("created_us", F.struct("_rank", "created_us")).alias("first_us")
    )
    return FeatureContext(
        circadian=holders.select("entity_id", "mu", "kappa"),
        coordinates=merchants.select("entity_id", "lat", "lon"),
        control=merchants.select("entity_id", "control_strength"),
        first_seen=first_seen, pagerank=pagerank, components=components,
    )


def lookup(
    df: DataFrame, dimension: DataFrame | None, key: str, values: Mapping[str, tuple[str, float | None]],
    layout: Layout | None = None,
) -> DataFrame:
    """Left join ``values`` = {new name: (dimension column, default)}; missing entities get the
    default. Spark broadcasts the dimension when it is small; rows of hot keys are salted when
    a layout says there are any.
    """
    if dimension is None or key not in df.columns:
        return df.select("*", *[F.lit(default).cast("double").alias(n) for n, (_, default) in values.items()])
    side = dimension.select(
        F.col("entity_id").alias(key), *[F.col(c).alias(n) for n, (c, _) in values.items()]
    )
    joined = attach_group_stats(df, [key], side, layout) if layout else df.join(side, key, "left")
    filled = [
        F.coalesce(n, F.lit(default)).alias(n) if default is not None else F.col(n)
        for n, (_, default) in values.items()
    ]
    return joined.select(*df.columns, *filled)


def prepare(df: DataFrame) -> DataFrame:
    declined = (F.coalesce(_col(df, "response_code", "string"), F.lit("00")) != "00").cast("int")
    return df.select(
        "*", F.unix_micros("event_ts").alias("_us"), N.minor_units(F.col("amount")).alias("_cents"),
        declined.alias("_declined"),
    )


def _col(df: DataFrame, name: str, kind: str) -> Column:
    """An optional block that is absent reads as null."""
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


# --- single features -------------------------------------------------------------------

def amount_z(cents: Column, mean: Column, std: Column, scale: int = 100) -> Column:
    """(amount - mean) / std; 0 where the history has no usable spread."""
    return F.when(std > MIN_STD, (cents / F.lit(float(scale)) - mean) / std).otherwise(0.0)


def amount_z_vs_history(df, key="payer_entity_id", window=7 * DAY, layout=None, narrow=None):
    m = [Measure("_m", "a", window, "mean", 100), Measure("_sd", "a", window, "std", 100)]
    out = trailing(df, [key], "_us", {"a": F.col("_cents")}, m, layout=layout, narrow=narrow)
    return out.withColumn(
        "amount_z_vs_entity_history", amount_z(F.col("_cents"), F.col("_m"), F.col("_sd"))
    ).drop("_m", "_sd")


def circadian(df, context: FeatureContext, key="payer_entity_id", layout=None):
    hour = F.hour("event_ts") + F.minute("event_ts") / 60.0
    joined = lookup(df, context.circadian, key,
                    {"_mu": ("mu", DEFAULT_MU), "_kappa": ("kappa", DEFAULT_KAPPA)}, layout)
    return joined.withColumn(
        "circadian_loglik", N.von_mises_loglik(hour, F.col("_mu"), F.col("_kappa"))
    ).drop("_mu", "_kappa")


def impossible_travel(df, context: FeatureContext, payer="payer_entity_id", payee="payee_entity_id",
                      tie="event_id", layout=None, payee_layout=None):
    """km/h from the payer's previous event; unknown places are at (0, 0), no elapsed time is 0."""
    here = lookup(df, context.coordinates, payee, {"_lat": ("lat", 0.0), "_lon": ("lon", 0.0)}, payee_layout)
    moved = previous_row(here, [payer], "_us", tie,
                         {"_plat": F.col("_lat"), "_plon": F.col("_lon"), "_pus": F.col("_us")}, layout=layout)
    hours = (F.col("_us") - F.col("_pus")) / F.lit(float(HOUR))
    km = N.haversine_km(F.col("_plat"), F.col("_plon"), F.col("_lat"), F.col("_lon"), N.EARTH_RADIUS_KM)
    return moved.withColumn(
        "impossible_travel_kmh", F.when(hours > 0, km / hours).otherwise(0.0)
    ).drop("_lat", "_lon", "_plat", "_plon", "_pus")


def hours_since(us: Column, then: Column) -> Column:
    """Hours from ``then`` to the event, never negative; 0 where unknown."""
    return F.coalesce(F.greatest((us - then) / F.lit(float(HOUR)), F.lit(0.0)), F.lit(0.0))


def payee_age(df, context: FeatureContext, key="payee_entity_id", layout=None):
    explicit = F.unix_micros(_col(df, "beneficiary_first_seen_ts", "timestamp"))
    joined = lookup(df, context.first_seen, key, {"_born": ("first_us", None)}, layout)
    return joined.withColumn(
        "payee_age_hours", hours_since(F.col("_us"), F.coalesce(explicit, F.col("_born")))
    ).drop("_born")


def device_age(df):
    return df.withColumn(
        "device_age_hours",
        hours_since(F.col("_us"), F.unix_micros(_col(df, "device_first_seen_ts", "timestamp"))),
    )


def terminal_age(df, context: FeatureContext, key="terminal_id", layout=None):
    joined = lookup(df, context.first_seen, key, {"_since": ("first_us", None)}, layout)
    return joined.withColumn("terminal_age_days", hours_since(F.col("_us"), F.col("_since")) / 24.0).drop("_since")


def flags(df):
    return df.withColumns({
        "cross_border": F.coalesce(F.col("cross_border").cast("int"), F.lit(0)),
        "sca_exempt_flag": _col(df, "sca_exempt_reason", "string").isNotNull().cast("int"),
    })


def bin_sequence_entropy(df, key="device_id", token="pan_token", window=10 * MINUTE, layout=None):
    if key not in df.columns:
        return df.withColumn("bin_seq_entropy", F.lit(0.0))
    code = N.pan_tail_code(_col(df, token, "string"))
    values = {f"t{c}": F.when(code == c, F.lit(1)) for c in range(N.PAN_TAIL_CODES)}
    names = [f"_t{c}" for c in range(N.PAN_TAIL_CODES)]
    out = trailing(df, [key], "_us", values, [Measure(f"_{v}", v, window, "count") for v in values], layout=layout)
    return out.withColumn(
        "bin_seq_entropy", N.share_entropy([F.col(n) for n in names], N.PAN_TAIL_CODES)
    ).drop(*names)


def merchant_benford(df, key="merchant_id", window=DAY, layout=None):
    if key not in df.columns:
        return df.withColumn("merchant_benford_dev_24h", F.lit(0.0))
    digit = N.first_digit(F.col("_cents"))
    values = {f"d{c}": F.when(digit == c, F.lit(1)) for c in range(1, 10)}
    out = trailing(df, [key], "_us", values, [Measure(f"_{v}", v, window, "count") for v in values], layout=layout)
    names = [f"_d{c}" for c in range(1, 10)]
    return out.withColumn(
        "merchant_benford_dev_24h", N.benford_deviation([F.col(n) for n in names])
    ).drop(*names)


def control_strength(df, context: FeatureContext, key="payee_entity_id", layout=None):
    return lookup(df, context.control, key,
                  {"merchant_control_strength": ("control_strength", DEFAULT_CONTROL)}, layout)


def graph_lookups(df, context: FeatureContext, payer="payer_entity_id", payee="payee_entity_id",
                  payer_layout=None, payee_layout=None):
    out = lookup(df, context.pagerank, payer, {"payer_pagerank": ("rank", 0.0)}, payer_layout)
    out = lookup(out, context.pagerank, payee, {"payee_pagerank": ("rank", 0.0)}, payee_layout)
    return lookup(out, context.components, payer, {"component_size": ("component_size", 1.0)}, payer_layout)


def scope_breach(amount: Column, ceiling: Column, at: Column, expiry: Column, allowlist: Column, payee: Column):
    """1 when over the ceiling, after expiry, or paid to someone off a non-empty allowlist."""
    off_list = (F.size(allowlist) > 0) & ~F.coalesce(F.array_contains(allowlist, payee), F.lit(False))
    hit = F.coalesce(amount > ceiling, F.lit(False)) | F.coalesce(at > expiry, F.lit(False)) | F.coalesce(
        off_list, F.lit(False))
    return hit.cast("int")


def cart_mismatch(intent: Column, settle: Column) -> Column:
    return F.coalesce(intent != settle, F.lit(False)).cast("int")


def exactly_false(flag: Column) -> Column:
    return flag.eqNullSafe(F.lit(False)).cast("int")


def overshoot(amount: Column, ceiling: Column) -> Column:
    return F.when(ceiling > 0, (amount - ceiling) / ceiling).otherwise(0.0)


def tri_state(flag: Column) -> Column:
    return F.coalesce(flag.cast("int"), F.lit(-1))


def enum_code(value: Column, codes: Mapping[str, int]) -> Column:
    out = F.lit(-1)
    for label, code in codes.items():
        out = F.when(value == label, F.lit(code)).otherwise(out)
    return out


def agentic(df, layout=None):
    amount, ceiling = F.col("amount").cast("double"), _col(df, "mandate_amount_max", "double").cast("double")
    nonce = "mandate_nonce"
    if nonce in df.columns:
        marked = first_rows(df, [nonce], "_us", "event_id", "_f", layout)
        out = marked.withColumn(
            "nonce_reused", (F.col(nonce).isNotNull() & (F.col("_f") == 0)).cast("int")).drop("_f")
    else:
        out = df.withColumn("nonce_reused", F.lit(0))
    return out.withColumns({
        "mandate_scope_breach": scope_breach(
            amount, ceiling, F.col("event_ts"), _col(df, "mandate_expiry_ts", "timestamp"),
            _col(df, "mandate_merchant_allowlist", "array<string>"), F.col("payee_entity_id").cast("string")),
        "cart_hash_mismatch": cart_mismatch(
            _col(df, "cart_hash_at_intent", "string"), _col(df, "cart_hash_at_settle", "string")),
        "attestation_invalid": exactly_false(_col(df, "agent_attestation_valid", "boolean")),
        "settle_vs_intent_amount_delta": overshoot(amount, ceiling),
        "human_present_flag_num": tri_state(_col(df, "human_present_flag", "boolean")),
    })


def rail_codes(df):
    return df.withColumns({
        "eci_semantic_code": enum_code(_col(df, "eci_semantic", "string"), S.ECI_CODES),
        "threeds_flow_code": enum_code(_col(df, "threeds_flow", "string"), S.THREEDS_CODES),
        "pos_entry_mode_code": enum_code(_col(df, "pos_entry_mode", "string"), S.POS_ENTRY_CODES),
        "payee_name_match_num": tri_state(_col(df, "payee_name_match", "boolean")),
        "upi_txn_type_code": enum_code(_col(df, "upi_txn_type", "string"), S.UPI_TYPE_CODES),
    })


# --- the whole matrix ------------------------------------------------------------------

_INPUTS = (
    "event_id", "event_ts", "amount", "response_code", "payer_entity_id", "payee_entity_id", "mcc", "cross_border",
    "pan_token", "device_id", "ip", "merchant_id", "agent_id", "issuer_id", "terminal_id",
    "beneficiary_first_seen_ts", "device_first_seen_ts", "sca_exempt_reason", "mandate_amount_max",
    "mandate_expiry_ts", "mandate_merchant_allowlist", "cart_hash_at_intent", "cart_hash_at_settle",
    "agent_attestation_valid", "mandate_nonce", "human_present_flag", "eci_semantic", "threeds_flow",
    "pos_entry_mode", "payee_name_match", "upi_txn_type",
)


def compute_features(
    df: DataFrame, context: FeatureContext | None = None, windows: Mapping[str, int] = VELOCITY_WINDOWS,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """(event_id, carried columns, all features as float with null filled by 0).

    Group sizes of all keys are measured in one pass over the input, so each scan reuses them. One
    exchange per scanned key: the pairs, then payer, payee, merchant and device; velocity keys share one.
    """
    context = context or FeatureContext()
    present = [c for c in dict.fromkeys([*_INPUTS, *carry]) if c in df.columns]
    base = prepare(df.select(*present))
    at = F.col("_us")

    sets = [*((k,) for k in dict.fromkeys(("payer_entity_id", "payee_entity_id", "mandate_nonce", "terminal_id", *VELOCITY_KEYS))),
            ("payer_entity_id", "payee_entity_id"), ("payer_entity_id", "mcc"), ("payee_entity_id", "issuer_id"), ("device_id", "pan_token")]
    layouts = plan_layouts(base, {"+".join(k): k for k in sets}, at)

    narrow = all_narrow(base, [F.col("_cents")])

    def measured(*keys):
        return layouts.get("+".join(keys))

    payer, payee = measured("payer_entity_id"), measured("payee_entity_id")
    pair, device, merchant = measured("payer_entity_id", "payee_entity_id"), measured("device_id"), measured("merchant_id")

    def lagged(frame, keys, name, layout):
        return previous_row(frame, keys, "_us", "event_id", {name: at}, layout=layout)

    def fresh(name, width):
        return (F.col(name).isNull() | (at - F.col(name) >= width)).cast("int")

    def together(frame, key, layout):
        """Rows of a key side by side, so that all scans by it and by pairs with it need no further exchange."""
        return frame.repartition(key) if key in frame.columns and layout is not None and layout.hot is None else frame

    # by payer
    out = lagged(together(base, "payer_entity_id", payer), ["payer_entity_id", "payee_entity_id"], "_p1", pair)
    out = out.withColumns({"first_time_payee": F.col("_p1").isNull().cast("int"), "_new_pair": fresh("_p1", DAY)})
    if "mcc" in out.columns:
        out = first_rows(out, ["payer_entity_id", "mcc"], "_us", "event_id", "mcc_novelty_for_entity",
                         measured("payer_entity_id", "mcc"))
    else:
        out = out.withColumn("mcc_novelty_for_entity", F.lit(0))
    out = trailing(out, ["payer_entity_id"], "_us", {"pair": F.col("_new_pair")},
                   [Measure("fanout_payer_24h", "pair", DAY, "sum")], layout=payer)
    out = amount_z_vs_history(out, layout=payer, narrow=narrow)
    out = circadian(out, context, layout=payer)
    out = impossible_travel(out, context, layout=payer, payee_layout=payee)

    # by payee
    out = together(out, "payee_entity_id", payee)
    payee_sums = [Measure("fanin_payee_24h", "pair", DAY, "sum")]
    payee_values = {"pair": F.col("_new_pair")}
    if "issuer_id" in out.columns:
        out = lagged(out, ["payee_entity_id", "issuer_id"], "_p2", measured("payee_entity_id", "issuer_id"))
        out = out.withColumn("_new_issuer", fresh("_p2", 7 * DAY))
        payee_sums.append(Measure("payee_bank_degree", "issuer", 7 * DAY, "sum"))
        payee_values["issuer"] = F.col("_new_issuer")
    else:
        out = out.withColumn("payee_bank_degree", F.lit(0))
    out = trailing(out, ["payee_entity_id"], "_us", payee_values, payee_sums, layout=payee)

    # by device
    if "device_id" in out.columns and "pan_token" in out.columns:
        out = lagged(together(out, "device_id", device), ["device_id", "pan_token"], "_p3", measured("device_id", "pan_token"))
        out = out.withColumn("_new_pan", fresh("_p3", 10 * MINUTE))
        out = trailing(out, ["device_id"], "_us", {"pan": F.col("_new_pan")},
                       [Measure("distinct_pan_per_device_10m", "pan", 10 * MINUTE, "sum")], layout=device)
    else:
        out = out.withColumn("distinct_pan_per_device_10m", F.lit(0))
    out = bin_sequence_entropy(out, layout=device)
    out = merchant_benford(out, layout=merchant)
    out = payee_age(out, context, layout=payee)
    out = terminal_age(device_age(out), context, layout=measured("terminal_id"))
    out = control_strength(out, context, layout=payee)
    out = graph_lookups(out, context, payer_layout=payer, payee_layout=payee)
    out = rail_codes(agentic(flags(out), measured("mandate_nonce")))
    names = [f"{a}_{k}_{w}" for k in VELOCITY_KEYS for w in windows for a in VELOCITY_AGGREGATIONS] + list(FEATURE_NAMES[len(VELOCITY_FEATURES):])
    own = [n for n in names if n in out.columns]
    kept = [c for c in carry if c in out.columns and c not in names and c != "event_id"]
    rest = out.select("event_id", *kept, *[F.col(n).cast("float").alias(n) for n in own])
    joined = velocity_block(
        base, "event_id", "_us", F.col("_cents"), F.col("_declined"), {k: k for k in VELOCITY_KEYS}, windows,
        layouts=layouts, narrow=narrow, beside=rest,
    )
    return joined.select(
        "event_id", *kept, *[F.coalesce(F.col(n).cast("float"), F.lit(0.0).cast("float")).alias(n) for n in names]
    )
