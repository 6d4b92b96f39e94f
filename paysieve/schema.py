"""The canonical payment event: columns, types, label and identifier sets, code tables."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _B, _I, _TS = T.StringType(), T.BooleanType(), T.IntegerType(), T.TimestampType()
_D, _A = T.DecimalType(14, 2), T.ArrayType(T.StringType())

# Names and types of the canonical columns, by block.
_BLOCKS: dict[str, list[tuple[str, T.DataType]]] = {
    "core": [
        ("event_id", _S), ("event_ts", _TS), ("rail", _S), ("amount", _D), ("currency", _S), ("amount_inr", _D),
        ("payer_entity_id", _S), ("payee_entity_id", _S), ("payer_country", _S), ("payee_country", _S),
        ("cross_border", _B), ("payer_name_hash", _S), ("payer_kyc_level", _S), ("payer_balance_band", _S),
    ],
    "card": [
        ("pan_token", _S), ("bin", _S), ("issuer_id", _S), ("acquirer_id", _S), ("merchant_id", _S), ("mcc", _S),
        ("pos_entry_mode", _S), ("processing_code", _S), ("mti", _S), ("response_code", _S), ("avs_result", _S),
        ("cvv_result", _S), ("terminal_id", _S), ("merchant_country", _S),
    ],
    "three_ds": [
        ("threeds_version", _S), ("threeds_flow", _S), ("eci", _S), ("eci_semantic", _S), ("card_network", _S),
        ("cavv_present", _B), ("threeds_method_completed", _B), ("device_fingerprint_id", _S),
        ("browser_screen_res", _S), ("browser_tz_offset", _I), ("browser_lang", _S), ("sca_exempt_reason", _S),
    ],
    "device": [
        ("device_id", _S), ("device_os", _S), ("device_first_seen_ts", _TS), ("ip", _S), ("ip_asn", _S),
        ("ip_country", _S), ("ip_proxy_flag", _B), ("user_agent_hash", _S),
    ],
    "upi": [
        ("vpa_payer", _S), ("vpa_payee", _S), ("upi_txn_type", _S), ("mandate_id", _S), ("payee_name_match", _B),
        ("beneficiary_first_seen_ts", _TS), ("device_binding_id", _S),
    ],
    "transfer": [
        ("uetr", _S), ("debtor_agent_bic", _S), ("creditor_agent_bic", _S), ("settlement_ts", _TS),
        ("remittance_ref", _S), ("return_code", _S),
    ],
    "agentic": [
        ("agent_id", _S), ("agent_operator", _S), ("protocol", _S), ("agent_attestation_valid", _B),
        ("intent_mandate_id", _S), ("cart_mandate_id", _S), ("payment_mandate_id", _S), ("human_present_flag", _B),
        ("mandate_amount_max", _D), ("mandate_merchant_allowlist", _A), ("mandate_expiry_ts", _TS),
        ("mandate_signature_valid", _B), ("mandate_nonce", _S), ("cart_hash_at_intent", _S),
        ("cart_hash_at_settle", _S), ("payee_at_intent", _S), ("payee_at_settle", _S),
    ],
    "label": [
        ("is_fraud", _B), ("vector_id", _S), ("campaign_id", _S), ("red_team_round", _I),
        ("mutation_lineage", _A), ("label_available_ts", _TS),
    ],
}

# End of fixed values.
CES_SCHEMA = T.StructType([T.StructField(n, t) for block in _BLOCKS.values() for n, t in block])
LABEL_COLUMNS = frozenset(n for n, _ in _BLOCKS["label"])
# Required columns, identifiers, and columns by kind.
REQUIRED_COLUMNS = ("event_id", "event_ts", "rail", "amount", "currency", "amount_inr", "payer_entity_id",
                    "payee_entity_id", "payer_country", "payee_country", "cross_border", "is_fraud")
IDENTIFIER_COLUMNS = frozenset((
    "event_id", "payer_entity_id", "payee_entity_id", "pan_token", "device_id", "ip", "merchant_id", "vpa_payer", "vpa_payee",
    "agent_id", "terminal_id", "device_fingerprint_id", "user_agent_hash", "uetr", "payer_name_hash", "intent_mandate_id",
    "cart_mandate_id", "payment_mandate_id", "mandate_id",
))
DATETIME_COLUMNS = ("event_ts", "device_first_seen_ts", "beneficiary_first_seen_ts", "settlement_ts",
                    "mandate_expiry_ts", "label_available_ts")
NUMERIC_COLUMNS = ("amount", "amount_inr", "mandate_amount_max", "browser_tz_offset")
# End of fixed values.

# Published code lists and rates.
RAILS = ("CARD_CNP", "CARD_CP", "UPI", "SEPA_INST", "ACH", "AGENTIC")
FX_RATES = {"INR": 1.0, "USD": 83.14, "EUR": 90.42, "GBP": 105.71, "SGD": 61.83, "AED": 22.63}
RAIL_LIMITS = {"CARD_CNP": 500_000.0, "CARD_CP": 500_000.0, "UPI": 100_000.0, "SEPA_INST": 1_000_000.0,
               "ACH": 1_000_000.0, "AGENTIC": 500_000.0}
AVS_RESULTS = ("Y", "A", "Z", "N", "U", "S", "G")
CVV_RESULTS = ("M", "N", "P", "U", "S")
ECI_SEMANTICS = {
    ("VISA", "05"): "authenticated", ("VISA", "06"): "attempted", ("VISA", "07"): "not_authenticated",
    ("MASTERCARD", "02"): "authenticated", ("MASTERCARD", "01"): "attempted",
    ("MASTERCARD", "00"): "not_authenticated",
}
RESPONSE_CODES = {
    "00": ("Approved", None), "05": ("Do not honor", "soft"), "14": ("Invalid card number", "hard"),
    "51": ("Insufficient funds", "soft"), "54": ("Expired card", "hard"),
    "57": ("Transaction not permitted", "hard"), "59": ("Suspected fraud", "hard"),
    "61": ("Exceeds withdrawal limit", "soft"), "65": ("Exceeds activity count limit", "soft"),
    "82": ("CVV failure", "hard"), "91": ("Issuer unavailable", "soft"),
}
POS_ENTRY_MODES = ("812", "051", "071", "901")
MTI_CODES = ("0100", "0110", "0120", "0200", "0210", "0400", "0420")
FIELD_MAPS = {
    "iso8583": {
        "pan_token": "DE2", "processing_code": "DE3", "amount": "DE4", "mcc": "DE18", "pos_entry_mode": "DE22",
        "acquirer_id": "DE32", "response_code": "DE39", "terminal_id": "DE41", "merchant_id": "DE42",
        "merchant_country": "DE43",
    },
    "upi": {
        "vpa_payer": "Payer/@addr", "vpa_payee": "Payee/@addr", "amount": "Payer/Amount/@value",
        "upi_txn_type": "Txn/@type", "mandate_id": "Mandate/@umn",
        "payee_name_match": "Payee/@name verification result", "device_binding_id": "DeviceTag/@id",
        "response_code": "Resp/@respCode",
    },
    "pacs008": {
        "uetr": "GrpHdr/MsgId + PmtId/UETR", "amount": "CdtTrfTxInf/IntrBkSttlmAmt",
        "currency": "CdtTrfTxInf/IntrBkSttlmAmt@Ccy", "settlement_ts": "GrpHdr/IntrBkSttlmDt",
        "debtor_agent_bic": "DbtrAgt/FinInstnId/BICFI", "creditor_agent_bic": "CdtrAgt/FinInstnId/BICFI",
        "payer_entity_id": "Dbtr/Id/OrgId/Othr/Id", "payee_entity_id": "Cdtr/Id/OrgId/Othr/Id",
        "remittance_ref": "RmtInf/Ustrd", "return_code": "pacs.004 TxInfAndSts/StsRsnInf/Rsn/Cd",
    },
    "ap2": {
        "intent_mandate_id": "Intent Mandate (mandate 1): what the user authorised in principle",
        "cart_mandate_id": "Cart Mandate (mandate 2): the specific basket the user approved",
        "payment_mandate_id": "Payment Mandate (mandate 3): the credential presented to the issuer",
        "cart_hash_at_intent": "digest bound into the Cart Mandate at signing time",
        "cart_hash_at_settle": "digest of the basket actually presented at settlement",
        "human_present_flag": "human-present signal the issuer risk engine ingests",
        "mandate_amount_max": "spend ceiling carried on the Intent Mandate",
        "mandate_merchant_allowlist": "merchant scope carried on the Intent Mandate",
        "mandate_nonce": "replay-protection nonce on the Payment Mandate",
        "agent_attestation_valid": "agent attestation result (Visa TAP / Web Bot Auth shape)",
    },
}
ECI_CODES = {"authenticated": 2, "attempted": 1, "not_authenticated": 0}
THREEDS_CODES = {"none": 0, "challenge": 1, "frictionless": 2}
POS_ENTRY_CODES = {"812": 0, "051": 1, "071": 2, "901": 3}
UPI_TYPE_CODES = {"push": 0, "collect": 1}
# End of fixed values.
