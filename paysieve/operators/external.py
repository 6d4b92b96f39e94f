"""Features an outside card corpus supports: it has card and merchant keys, places and times,
but no device, network, agent or authorisation outcome. Those columns are null, never 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paysieve.functions import numeric as N
from paysieve.operators import windows as W
from paysieve.operators.windows import DAY, HOUR, MINUTE, VELOCITY_KEYS, VELOCITY_WINDOWS, Measure
from paysieve.plans.scan import first_rows, previous_row
from paysieve.plans.skew import plan_layouts

SUPPORTED_KEYS = ("pan_token", "merchant_id", "payee_entity_id")
DERIVED_FEATURES = ("impossible_travel_kmh", "first_time_payee", "payee_age_hours", "mcc_novelty_for_entity",
                    "circadian_loglik", "amount_z_vs_entity_history", "merchant_benford_dev_24h",
                    "fanin_payee_24h", "fanout_payer_24h")


def travel_with_floor(df, key="pan_token", lat="payer_lat", lon="payer_lon", at="_us", tie="event_id", layout=None,
                      name="impossible_travel_kmh"):
    """km/h between a card's consecutive places; elapsed time counts as at least one minute."""
    moved = previous_row(df, [key], at, tie, {"_plat": F.col(lat), "_plon": F.col(lon), "_pus": F.col(at)},
                         layout=layout)
    hours = F.greatest((F.col(at) - F.col("_pus")) / F.lit(float(HOUR)), F.lit(MINUTE / HOUR))
    km = N.haversine_km(F.col("_plat"), F.col("_plon"), F.col(lat), F.col(lon), N.CORPUS_EARTH_RADIUS_KM)
    speed = F.when(F.col("_pus").isNull(), 0.0).otherwise(km / hours)
    return moved.withColumn(name, speed).drop("_plat", "_plon", "_pus")


def benford_digit_sum(df, key="merchant_id", at="_us", cents="_cents", window=DAY, layout=None,
                      name="merchant_benford_dev_24h"):
    """Sum over digits of |share in the frame - Benford|; an empty frame has all shares 0."""
    digit = N.first_digit(F.col(cents))
    values = {f"d{c}": (digit == c).cast("int") for c in range(1, 10)}
    out = W.trailing(df, [key], at, values, [Measure(f"_{v}", v, window, "mean") for v in values], layout=layout)
    gaps = [F.abs(F.coalesce(F.col(f"_d{c}"), F.lit(0.0)) - N.BENFORD[c - 1]) for c in range(1, 10)]
    return out.withColumn(name, sum(gaps[1:], gaps[0])).drop(*[f"_{v}" for v in values])


def compute_features_external(df: DataFrame, include_absent: bool = True, windows=VELOCITY_WINDOWS,
                              carry: tuple[str, ...] = ()) -> DataFrame:
    """(event_id, carried columns, 69 supported features, 60 absent ones as null)."""
    base = df.withColumns({"_us": F.unix_micros("event_ts"), "_cents": N.minor_units(F.col("amount"))})
    at = F.col("_us")
    pair = ["pan_token", "payee_entity_id"]
    plans = plan_layouts(base, {**{k: [k] for k in SUPPORTED_KEYS}, "pair": pair, "card_mcc": ["pan_token", "mcc"]}, at)
    card = plans["pan_token"]
    out = travel_with_floor(base, layout=card)
    out = first_rows(out, pair, "_us", "event_id", "first_time_payee", plans["pair"])
    out = W.age_since_first(out, *pair, "_us", "payee_age_hours", plans["pair"])
    out = first_rows(out, ["pan_token", "mcc"], "_us", "event_id", "mcc_novelty_for_entity", plans["card_mcc"])
    out = W.expanding_hour_loglik(out, "pan_token", "_us", "event_id", F.hour("event_ts"), "circadian_loglik", card)
    out = W.expanding_zscore(out, "pan_token", "_us", "event_id", F.col("_cents"), "amount_z_vs_entity_history", layout=card)
    out = benford_digit_sum(out, layout=plans["merchant_id"])
    out = W.pit_count(out, ["payee_entity_id"], "_us", DAY, F.col("_cents"), "fanin_payee_24h", layout=plans["payee_entity_id"])
    out = W.pit_count(out, ["pan_token"], "_us", DAY, F.col("_cents"), "fanout_payer_24h", layout=card)
    block = [f"{a}_{k}_{w}" for k in SUPPORTED_KEYS for w in windows for a in W.VELOCITY_AGGREGATIONS]
    names = block + list(DERIVED_FEATURES)
    kept = [c for c in carry if c != "event_id"]
    rest = out.select("event_id", *kept, *[F.col(n).cast("float").alias(n) for n in DERIVED_FEATURES])
    joined = W.velocity_block(base, "event_id", "_us", F.col("_cents"), F.lit(None),
                              {k: k for k in SUPPORTED_KEYS}, windows, fill=None, layouts=plans,
                              narrow=W.all_narrow(base, [F.col("_cents")]), beside=rest)
    absent = [
        F.lit(None).cast("float").alias(f"{a}_{k}_{w}")
        for k in VELOCITY_KEYS if k not in SUPPORTED_KEYS for w in windows for a in W.VELOCITY_AGGREGATIONS
    ]
    return joined.select("event_id", *kept, *[F.col(n).cast("float").alias(n) for n in names], *(absent if include_absent else []))
