"""The driver's tables seen as payment events, once as Spark frames and once as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_EVT = """
SELECT event_id, {ts} AS event_ts, {us} AS us, k, user_id, value AS amount, event_type AS mcc,
  CAST(round(value*100) AS BIGINT) AS amount_c,
  user_id % 7 AS payer_country,
  (event_id*7919) % 40 AS payee_id,
  ((event_id*7919) % 40) % 7 AS payee_country,
  (user_id % 7) <> (((event_id*7919) % 40) % 7) AS cross_border,
  CASE WHEN k % 6 IN (0,1) THEN user_id END AS pan_id,
  k % 25 AS device_id,
  user_id % 50 AS ip_id,
  user_id % 10 AS issuer_id,
  ((event_id*7919) % 40) % 5 AS acquirer_id,
  k % 6 AS rail_no,
  CASE WHEN event_type='error' THEN '05' ELSE '00' END AS response_code,
  CASE WHEN event_type='error' THEN 1 ELSE 0 END AS declined,
  CASE WHEN k + (event_id*7919) % 40 > 115 THEN 1 ELSE 0 END AS is_fraud,
  CAST(70*k + 3*((event_id*104729) % 1000) AS DOUBLE)/CAST(10000 AS DOUBLE) AS score,
  user_id % 10 = 0 AS in_blind_cohort,
  user_id % 5 AS vector_no,
  user_id % 12 AS campaign_no,
  CAST(-60 + 3*((event_id*7919) % 40) AS DOUBLE) AS payee_lat,
  CAST(-170 + 8*((event_id*7919) % 40) AS DOUBLE) AS payee_lon,
  CASE WHEN k%6=5 THEN k % 25 END AS agent_id,
  CASE WHEN k%6=5 THEN CASE WHEN event_id%5=0 THEN value*CAST(0.8 AS DOUBLE) ELSE value*CAST(1.25 AS DOUBLE) END END AS mandate_amount_max,
  CASE WHEN k%6=5 THEN CASE WHEN event_id%17=0 THEN {us} - 3600000000 ELSE {us} + 86400000000 END END AS mandate_expiry_us,
  CASE WHEN k%6=5 THEN {sha_a} END AS cart_hash_at_intent,
  CASE WHEN k%6=5 THEN {sha_b} END AS cart_hash_at_settle,
  CASE WHEN k%6=5 THEN event_id % 211 END AS mandate_nonce,
  CASE WHEN k%6=5 THEN event_id % 11 <> 0 END AS agent_attestation_valid,
  CASE WHEN k%6=5 THEN CASE WHEN event_id%13=0 THEN 999 ELSE (event_id*7919)%40 END END AS allowed_payee,
  CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_id % 9 <> 0 END AS payee_name_match
FROM {source}
"""

_EVT_DUCK = _EVT.format(
    ts="ts",
    us="epoch_us(ts)",
    sha_a="sha256(CAST(event_id AS VARCHAR))",
    sha_b="sha256(CAST(event_id + CASE WHEN event_id%7=0 THEN 1 ELSE 0 END AS VARCHAR))",
    source="(SELECT event_id, ts, user_id, event_type, value, "
    "CAST(json_extract_string(props,'$.k') AS INT) AS k FROM events)",
)
_ACCT = """
SELECT event_id, us, user_id AS src, CAST((k*3 + event_id % 5) % 150 AS BIGINT) AS dst,
  amount, amount_c, rail_no AS currency_no, is_fraud AS is_laundering
FROM {evt}
"""

VIEWS = {
    "evt": _EVT_DUCK,
    "ord": """
SELECT o_orderkey AS event_id, epoch_us(CAST(o_orderdate AS TIMESTAMP)) AS us, o_custkey AS payer_id,
  o_orderkey % 100 AS payee_id, o_totalprice AS amount, CAST(round(o_totalprice*100) AS BIGINT) AS amount_c,
  o_orderpriority AS mcc, n_name AS country, c_mktsegment AS segment,
  CASE WHEN o_orderstatus='F' THEN 1 ELSE 0 END AS declined
FROM orders JOIN customer ON o_custkey=c_custkey JOIN nation ON c_nationkey=n_nationkey""",
    "pay_edges": """
SELECT concat('C', o_custkey) AS src_id, concat('S', l_suppkey) AS dst_id, 'pays' AS edge_type,
  min(epoch_us(CAST(l_shipdate AS TIMESTAMP))) AS first_us, max(epoch_us(CAST(l_shipdate AS TIMESTAMP))) AS last_us,
  count(*) AS weight
FROM orders JOIN lineitem ON o_orderkey=l_orderkey GROUP BY o_custkey, l_suppkey""",
    "acct_edges": _ACCT.format(evt="evt"),
}
_NEEDS = {"acct_edges": ["evt"]}


def with_views(names: str | list[str], body: str, recursive: bool = False) -> str:
    """SQL text with the named views as leading CTEs."""
    wanted: list[str] = []
    for name in [names] if isinstance(names, str) else names:
        for n in [*_NEEDS.get(name, []), name]:
            if n not in wanted:
                wanted.append(n)
    body = body.strip()
    if body.upper().startswith("WITH "):
        body = ", " + body[5:]
    ctes = ", ".join(f"{n} AS MATERIALIZED ({VIEWS[n].strip()})" for n in wanted)
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes}\n{body}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def evt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_evt(table(spark, sf_dir, "events"))


def as_evt(events: DataFrame) -> DataFrame:
    """Works for a batch or a streaming ``events`` frame."""
    base = events.selectExpr(
        "event_id", "CAST(ts AS TIMESTAMP) AS ts", "user_id", "event_type", "value",
        "CAST(get_json_object(props, '$.k') AS INT) AS k",
    )
    return base.selectExpr(*_select_list(
        ts="ts",
        us="unix_micros(ts)",
        sha_a="sha2(CAST(event_id AS STRING), 256)",
        sha_b="sha2(CAST(event_id + CASE WHEN event_id%7=0 THEN 1 ELSE 0 END AS STRING), 256)",
    ))


def _select_list(**spots: str) -> list[str]:
    text = _EVT.format(source="", **spots).strip()
    text = text[len("SELECT"): text.rindex("FROM")]
    items, depth, start = [], 0, 0
    for i, ch in enumerate(text):
        depth += (ch == "(") - (ch == ")")
        if ch == "," and depth == 0:
            items.append(text[start:i].strip())
            start = i + 1
    return [*items, text[start:].strip()]


def ord_(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer, nation = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    return (
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .selectExpr(
            "o_orderkey AS event_id", "unix_micros(CAST(o_orderdate AS TIMESTAMP)) AS us", "o_custkey AS payer_id",
            "o_orderkey % 100 AS payee_id", "o_totalprice AS amount",
            "CAST(round(o_totalprice*100) AS BIGINT) AS amount_c", "o_orderpriority AS mcc",
            "n_name AS country", "c_mktsegment AS segment",
            "CASE WHEN o_orderstatus='F' THEN 1 ELSE 0 END AS declined",
        )
    )


def pay_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, lineitem = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    shipped = F.expr("unix_micros(CAST(l_shipdate AS TIMESTAMP))")
    return (
        orders.join(lineitem, F.col("o_orderkey") == F.col("l_orderkey"))
        .groupBy("o_custkey", "l_suppkey")
        .agg(F.min(shipped).alias("first_us"), F.max(shipped).alias("last_us"), F.count(F.lit(1)).alias("weight"))
        .selectExpr(
            "concat('C', o_custkey) AS src_id", "concat('S', l_suppkey) AS dst_id", "'pays' AS edge_type",
            "first_us", "last_us", "weight",
        )
    )


def acct_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evt(spark, sf_dir).selectExpr(
        "event_id", "us", "user_id AS src", "CAST((k*3 + event_id % 5) % 150 AS BIGINT) AS dst",
        "amount", "amount_c", "rail_no AS currency_no", "is_fraud AS is_laundering",
    )


def canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """evt under the canonical column names (ids stay numeric)."""
    return as_canonical(evt(spark, sf_dir))


def as_canonical(events: DataFrame) -> DataFrame:
    seen = "timestamp_micros({first} + ({id} * 37 % 60) * 86400000000)"
    first = 1_701_388_800_000_000  # 2023-12-01
    return events.selectExpr(
        "event_id", "event_ts", "us", "amount", "amount_c", "response_code", "mcc", "cross_border", "is_fraud", "score", "k",
        "rail_no", "vector_no", "campaign_no", "in_blind_cohort", "acquirer_id",
        "user_id AS payer_entity_id", "payee_id AS payee_entity_id", "pan_id AS pan_token", "device_id",
        "ip_id AS ip", "payee_id AS merchant_id", "agent_id", "issuer_id", "user_id AS terminal_id",
        "element_at(array('CARD_CNP','CARD_CP','UPI','SEPA_INST','ACH','AGENTIC'), CAST(rail_no + 1 AS INT)) AS rail",
        "mandate_amount_max", "timestamp_micros(mandate_expiry_us) AS mandate_expiry_ts",
        "CASE WHEN allowed_payee IS NOT NULL THEN array(CAST(allowed_payee AS STRING)) END AS mandate_merchant_allowlist",
        "cart_hash_at_intent", "cart_hash_at_settle", "agent_attestation_valid", "mandate_nonce", "payee_name_match",
        f"CASE WHEN device_id % 8 <> 0 THEN {seen.format(first=first, id='device_id')} END AS device_first_seen_ts",
        "CASE WHEN event_id % 4 = 0 THEN 'tra' END AS sca_exempt_reason",
        "CASE mcc WHEN 'click' THEN 'authenticated' WHEN 'view' THEN 'not_authenticated' "
        "WHEN 'purchase' THEN 'attempted' END AS eci_semantic",
        "CASE WHEN mcc = 'signup' THEN 'collect' ELSE 'push' END AS upi_txn_type",
    )


FIRST_SEEN_SQL = ("SELECT DISTINCT payee_id AS entity_id, 1701388800000000 + (payee_id * 37 % 60) * 86400000000 "
                  "AS first_us FROM {src} WHERE payee_id % 8 <> 0")
CIRCADIAN_SQL = ("SELECT DISTINCT user_id AS entity_id, CAST(user_id % 24 AS DOUBLE) * 2 * pi() / 24 AS mu, "
                 "CAST(1 + user_id % 4 AS DOUBLE) AS kappa FROM {src}")
CONTROL_SQL = ("SELECT DISTINCT payee_id AS entity_id, CAST((payee_id * 13) % 100 AS DOUBLE) / 100 AS control_strength "
               "FROM {src} WHERE payee_id < 36")
PLACES_SQL = "SELECT DISTINCT payee_id AS entity_id, payee_lat AS lat, payee_lon AS lon FROM {src} WHERE payee_id < 38"


def dimension(events: DataFrame, sql: str) -> DataFrame:
    return events.sparkSession.sql(sql.replace("{src}", "{events}"), events=events)
