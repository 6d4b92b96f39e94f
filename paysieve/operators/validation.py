"""Row rules of the canonical event, quarantine, type coercion and column guards."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paysieve import schema as S

MAX_REPORTED = 10
MIN_LEGITIMATE_ROWS = 200
UUID = "^[0-9a-fA-F]{8}-?([0-9a-fA-F]{4}-?){3}[0-9a-fA-F]{12}$"
HEX64 = "^[0-9a-f]{64}$"
# Field formats of the canonical event.
PATTERNS = {
    "event_id": UUID, "mandate_id": UUID, "uetr": UUID, "campaign_id": UUID, "intent_mandate_id": UUID,
    "cart_mandate_id": UUID, "payment_mandate_id": UUID,
    "payer_entity_id": r"^(CH|AC)_\d{6}$", "payee_entity_id": r"^(MR|AC)_\d{5,6}$",
    "payer_name_hash": HEX64, "user_agent_hash": HEX64, "cart_hash_at_intent": HEX64, "cart_hash_at_settle": HEX64,
    "bin": r"^\d{8}$", "issuer_id": r"^ISS_\d{3}$", "acquirer_id": r"^ACQ_\d{3}$", "merchant_id": r"^MR_\d{5}$",
    "mcc": r"^\d{4}$", "processing_code": r"^\d{6}$", "threeds_version": r"^2\.[12]\.\d$",
    "device_fingerprint_id": "^fp_[0-9a-f]{16}$", "browser_screen_res": r"^\d{3,4}x\d{3,4}$",
    "device_id": "^DV_[A-Z0-9_]{4,12}$", "ip_asn": r"^AS\d{3,6}$", "vpa_payer": "^[a-z0-9._-]+@[a-z]+$",
    "vpa_payee": "^[a-z0-9._-]+@[a-z]+$", "device_binding_id": "^DB_[0-9a-f]{12}$", "agent_id": r"^AG_\d{5}$",
    "mandate_nonce": "^n_[0-9a-f]{10}$", "payee_at_intent": r"^MR_\d{5}$", "payee_at_settle": r"^MR_\d{5}$",
    "vector_id": r"^V\d{2}$", "pan_token": "^tok_",
}
CHOICES = {
    "rail": S.RAILS, "payer_kyc_level": ("FULL", "MIN", "NONE"), "payer_balance_band": ("LOW", "MID", "HIGH"),
    "threeds_flow": ("frictionless", "challenge", "none"), "eci_semantic": tuple(S.ECI_CODES),
    "card_network": ("VISA", "MASTERCARD"),
    "sca_exempt_reason": ("low_value", "tra", "trusted_beneficiary", "recurring", "corporate"),
    "device_os": ("ANDROID", "IOS", "WINDOWS", "MACOS", "LINUX"), "upi_txn_type": ("push", "collect"),
    "protocol": ("AP2", "ACP", "x402", "TAP"), "pos_entry_mode": S.POS_ENTRY_MODES, "mti": S.MTI_CODES,
    "response_code": tuple(S.RESPONSE_CODES), "avs_result": S.AVS_RESULTS, "cvv_result": S.CVV_RESULTS,
}
EXACT_LENGTH = {"currency": 3, "payer_country": 2, "payee_country": 2, "merchant_country": 2, "ip_country": 2}
MAX_LENGTH = {"pan_token": 24, "terminal_id": 12, "remittance_ref": 140, "agent_operator": 64}
UPPERCASE = ("currency", "payer_country", "payee_country")
POSITIVE = ("amount", "amount_inr", "mandate_amount_max")
DIGITS = {"amount": (14, 2), "amount_inr": (14, 2)}
# End of fixed values.


def too_many_digits(value: Column, digits: int, places: int) -> Column:
    """More decimal places than allowed, or more digits in all."""
    x = value.cast("decimal(38,10)")
    return (x != F.round(x, places)) | (F.abs(x) >= F.lit(10 ** (digits - places)))


def rules(columns: Iterable[str], allow: Iterable[str] = ()) -> list[tuple[str, Column]]:
    """(code, violated) for every rule whose columns are present.

    A value in a column that the canonical event does not have is a violation, but for the columns allowed beside it.
    """
    have, known = set(columns), {*S.CES_SCHEMA.fieldNames(), *allow}
    c = F.col
    out: list[tuple[str, Column]] = [
        (f"{n}:missing", c(n).isNull() if n in have else F.lit(True)) for n in S.REQUIRED_COLUMNS
    ]
    out += [(f"{n}:format", ~c(n).cast("string").rlike(p)) for n, p in PATTERNS.items() if n in have]
    out += [(f"{n}:choice", ~c(n).isin(*v)) for n, v in CHOICES.items() if n in have]
    out += [(f"{n}:length", F.length(n) != k) for n, k in EXACT_LENGTH.items() if n in have]
    out += [(f"{n}:length", F.length(n) > k) for n, k in MAX_LENGTH.items() if n in have]
    out += [(f"{n}:case", c(n) != F.upper(c(n))) for n in UPPERCASE if n in have]
    out += [(f"{n}:positive", c(n) <= 0) for n in POSITIVE if n in have]
    out += [(f"{n}:digits", too_many_digits(c(n), *d)) for n, d in DIGITS.items() if n in have]
    out += [(f"{n}:unknown", c(f"`{n}`").isNotNull()) for n in columns if n not in known]

    def cross(code, needed, violated):
        if set(needed) <= have:
            out.append((code, violated()))

    cross("browser_tz_offset:range", ["browser_tz_offset"], lambda: ~c("browser_tz_offset").between(-720, 840))
    cross("cross_border:countries", ["cross_border", "payer_country", "payee_country"],
          lambda: c("cross_border") != (c("payer_country") != c("payee_country")))
    network = ["eci", "card_network"]

    def semantic():
        pairs = F.create_map(*[F.lit(x) for (n, e), v in S.ECI_SEMANTICS.items() for x in (f"{n}|{e}", v)])
        return F.element_at(pairs, F.concat_ws("|", "card_network", "eci"))

    both = c("eci").isNotNull() & c("card_network").isNotNull()
    cross("eci:network", network, lambda: both & semantic().isNull())
    cross("eci_semantic:eci", [*network, "eci_semantic"], lambda: both & (c("eci_semantic") != semantic()))
    cross("payment_mandate_id:ap2", ["protocol", "payment_mandate_id"],
          lambda: (c("protocol") == "AP2") & c("payment_mandate_id").isNull())
    cross("human_present_flag:mandate", ["payment_mandate_id", "human_present_flag"],
          lambda: c("payment_mandate_id").isNotNull() & c("human_present_flag").isNull())
    cross("vector_id:fraud", ["is_fraud", "vector_id"], lambda: c("is_fraud").cast("boolean") & c("vector_id").isNull())
    return out


def with_violations(df: DataFrame, skip: Sequence[str] = (), allow: Sequence[str] = ()) -> DataFrame:
    """Adds ``violations``: the codes of the broken rules, in rule order. No shuffle."""
    codes = [F.when(bad, F.lit(code)) for code, bad in rules(df.columns, allow) if code not in skip]
    return df.withColumn("violations", F.array_compact(F.array(*codes)))


def validate(df: DataFrame, strict: bool = True, skip: Sequence[str] = (), allow: Sequence[str] = ()) -> DataFrame:
    """Lenient keeps the valid rows; strict raises with a count and at most ten bad rows."""
    checked = with_violations(df, skip, allow)
    if strict:
        bad = checked.filter(F.size("violations") > 0)
        head = bad.select(*[x for x in ("event_id",) if x in df.columns], "violations").take(MAX_REPORTED)
        if head:
            listing = "\n".join(str(r.asDict()) for r in head)
            raise ValueError(f"{bad.count()} invalid rows\n{listing}")
        return df
    return checked.filter(F.size("violations") == 0).drop("violations")


def quarantine(df: DataFrame, skip: Sequence[str] = (), allow: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows with their reasons)."""
    checked = with_violations(df, skip, allow)
    return (checked.filter(F.size("violations") == 0).drop("violations"), checked.filter(F.size("violations") > 0))


def coerce_types(df: DataFrame) -> DataFrame:
    """Cast time and numeric columns, failures to null; booleans cast; lineage defaults to []."""
    changes = {}
    for name in S.DATETIME_COLUMNS:
        if name in df.columns:
            changes[name] = F.try_to_timestamp(F.col(name).cast("string"))
    for name in S.NUMERIC_COLUMNS:
        if name in df.columns:
            changes[name] = F.col(name).cast("string").try_cast("double")
    for name in ("cross_border", "is_fraud"):
        if name in df.columns:
            changes[name] = F.coalesce(F.col(name).try_cast("boolean"), F.lit(False))
    lineage = F.col("mutation_lineage") if "mutation_lineage" in df.columns else F.lit(None).cast("array<string>")
    changes["mutation_lineage"] = F.coalesce(lineage, F.array().cast("array<string>"))
    return df.withColumns(changes)


class LeakageError(ValueError):
    """A label or raw identifier among features; ``columns`` names them."""

    def __init__(self, columns: list[str]):
        super().__init__(f"label or raw identifier in feature set: {columns}")
        self.columns = columns


def assert_no_leakage(df: DataFrame) -> list[str]:
    """Feature columns; raises when a label or raw identifier is among them."""
    leaked = sorted(set(df.columns) & (S.LABEL_COLUMNS | S.IDENTIFIER_COLUMNS))
    if leaked:
        raise LeakageError(leaked)
    return df.columns


# Columns a party may not see, and the column that selects its rows.
SCOPE_KEYS = {"ISSUER": "issuer_id", "ACQUIRER": "acquirer_id", "NETWORK": None}
SCOPE_MASKS = {
    "ISSUER": ("merchant_control_strength", "merchant_benford_dev_24h", "fanin_payee_24h", "payee_bank_degree",
               "terminal_age_days"),
    "ACQUIRER": ("amount_z_vs_entity_history", "circadian_loglik", "mcc_novelty_for_entity",
                 "impossible_travel_kmh", "payer_kyc_level", "payer_balance_band"),
    "NETWORK": ("payer_kyc_level", "payer_balance_band", "payer_name_hash"),
}
DEFAULT_PARTIES = {"ISSUER": "ISS_007", "ACQUIRER": "ACQ_014", "NETWORK": ""}
# End of fixed values.


def party_view(df: DataFrame, scope: str, party=None) -> DataFrame:
    """Rows the party handles, with the columns outside its view set to null."""
    key = SCOPE_KEYS[scope]
    rows = df if key is None else df.filter(F.col(key) == F.lit(DEFAULT_PARTIES[scope] if party is None else party))
    hidden = [n for n in SCOPE_MASKS[scope] if n in df.columns]
    return rows.withColumns({n: F.lit(None).cast(df.schema[n].dataType) for n in hidden})


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key values that occur more than once, with their count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")


def shared_keys(parts: Mapping[str, DataFrame], key: str) -> DataFrame:
    """Key values present in more than one part, with the sorted part names."""
    tagged = [p.select(F.col(key)).distinct().withColumn("part", F.lit(n)) for n, p in parts.items()]
    return (
        reduce(DataFrame.unionByName, tagged).groupBy(key)
        .agg(F.array_sort(F.collect_set("part")).alias("parts")).filter(F.size("parts") > 1)
    )


def assert_unique(df: DataFrame, keys: Sequence[str]) -> None:
    sample = duplicates(df, keys).take(MAX_REPORTED)
    if sample:
        raise ValueError(f"duplicate {list(keys)}: {[r.asDict() for r in sample]}")


def assert_disjoint(parts: Mapping[str, DataFrame], key: str) -> None:
    for name, part in parts.items():
        if key == "event_id":
            assert_unique(part, [key])
    sample = shared_keys(parts, key).take(MAX_REPORTED)
    if sample:
        raise ValueError(f"{key} shared between parts: {[r.asDict() for r in sample]}")


def rate_of(currency: Column, rates: Mapping[str, float]) -> Column:
    """Exact decimal rate; an unknown currency has rate 1."""
    table = F.create_map(*[x for k, v in rates.items() for x in (F.lit(k), F.lit(str(v)).cast("decimal(12,6)"))])
    return F.coalesce(F.element_at(table, currency), F.lit("1").cast("decimal(12,6)"))


def to_base_currency(df: DataFrame, amount="amount", currency="currency", rates=S.FX_RATES, name="amount_inr"):
    """amount x rate in decimals, rounded half up to two places."""
    exact = F.col(amount).cast("decimal(18,2)") * rate_of(F.col(currency), rates)
    return df.withColumn(name, F.round(exact, 2).cast("decimal(20,2)"))


def legitimate_view(df: DataFrame, min_rows: int = MIN_LEGITIMATE_ROWS) -> DataFrame:
    """Rows that are not fraud, or all rows when fewer than ``min_rows`` remain."""
    if "is_fraud" not in df.columns:
        return df
    legitimate = df.filter(~F.col("is_fraud").cast("boolean"))
    return legitimate if len(legitimate.select("is_fraud").take(min_rows)) >= min_rows else df


def field_map(df: DataFrame, standard: str) -> DataFrame:
    """The columns the standard names, under its names."""
    names = S.FIELD_MAPS[standard]
    return df.select(*[F.col(c).alias(n) for c, n in names.items() if c in df.columns])


def retry_class(df: DataFrame, code: str = "response_code") -> DataFrame:
    """Adds ``meaning`` and ``retry`` (soft, hard, or null) of the response code."""
    meaning = F.create_map(*[F.lit(x) for k, (m, _) in S.RESPONSE_CODES.items() for x in (k, m)])
    retry = F.create_map(*[F.lit(x) for k, (_, r) in S.RESPONSE_CODES.items() if r for x in (k, r)])
    return df.withColumns({"meaning": F.element_at(meaning, F.col(code)), "retry": F.element_at(retry, F.col(code))})


def null_profile(batch: DataFrame, reference: DataFrame, columns: Sequence[str], min_variety: int = 2) -> DataFrame:
    """(column, batch_filled, batch_distinct, ref_distinct, status): a column the reference
    varies (more than ``min_variety`` values) but the batch leaves empty or pins to one value.

    Both tables are turned into (column, value) rows counted with map-side combine, so no
    distinct set has to fit one task.
    """
    def profile(df, side):
        pairs = df.select(F.explode(F.array(*[
            F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns
        ])).alias("p")).select("p.*")
        per_value = pairs.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
        return per_value.groupBy("column").agg(
            F.coalesce(F.sum(F.when(F.col("value").isNotNull(), F.col("n"))), F.lit(0)).alias(f"{side}_filled"),
            F.count("value").alias(f"{side}_distinct"))

    joined = profile(reference, "ref").join(profile(batch, "batch"), "column", "left")
    status = (
        F.when(F.col("ref_distinct") <= min_variety, "not_comparable")
        .when(F.coalesce("batch_filled", F.lit(0)) == 0, "absent")
        .when(F.col("batch_distinct") == 1, "pinned").otherwise("ok"))
    return joined.select("column", F.coalesce("batch_filled", F.lit(0)).alias("batch_filled"),
                         F.coalesce("batch_distinct", F.lit(0)).alias("batch_distinct"), "ref_distinct",
                         status.alias("status"))
