"""Queries over sources, sinks, tables and scalar helpers."""

from __future__ import annotations

from pyspark.sql import functions as F

from paysieve.catalog import views as V
from paysieve.catalog.base import Catalog, r6
from paysieve.catalog.views import acct_edges, canonical, evt, with_views
from paysieve.functions import numeric as N
from paysieve.operators import metrics as M
from paysieve.plans.durable import scratch_path
from paysieve.sources import artefacts as A
from paysieve.sources import corpora as C
from paysieve.sources import tables as T

query = Catalog()
_CATEGORY = "element_at(array('travel','home','misc_net','kids_pets','nowhere'), CAST(event_id % 5 + 1 AS INT))"


def card_rows(spark, d):
    """evt in the card corpus' columns, everything text as in a CSV."""
    return evt(spark, d).selectExpr(
        "date_format(event_ts, 'yyyy-MM-dd HH:mm:ss') AS trans_date_trans_time", "CAST(user_id AS STRING) AS cc_num",
        "concat('shop', payee_id) AS merchant", f"{_CATEGORY} AS category", "CAST(amount AS STRING) AS amt",
        "CAST(payee_lat AS STRING) AS lat", "CAST(payee_lon AS STRING) AS long", "CAST(payee_lat AS STRING) AS merch_lat",
        "CAST(payee_lon AS STRING) AS merch_long", "CAST(k AS STRING) AS city_pop", "CAST(event_id AS STRING) AS trans_num",
        "CASE WHEN event_id % 3 <> 0 THEN CAST(is_fraud AS STRING) END AS is_fraud")


_CANON_SQL = """
SELECT CAST(event_id AS VARCHAR) AS event_id, us // 1000000 AS sec, 'shop' || CAST(payee_id AS VARCHAR) AS merchant_id, round(amount, 2) AS amount,
  ([4722, 5200, 5399, 5995, 5999])[CAST(event_id % 5 + 1 AS INT)] AS mcc, 'CARD_CNP' AS rail,
  CASE WHEN event_id % 3 <> 0 THEN is_fraud ELSE 0 END AS is_fraud, CAST(NULL AS VARCHAR) AS response_code FROM evt"""


def _canon(df):
    return df.select("event_id", F.unix_seconds("event_ts").alias("sec"), "merchant_id", F.round("amount", 2).alias("amount"), "mcc",
                     "rail", "is_fraud", "response_code")


@query("s01_read_card_csv", with_views("evt", _CANON_SQL))
def _(spark, d):
    path = scratch_path(spark, "card_csv")
    card_rows(spark, d).write.option("header", True).csv(path)
    return _canon(C.read_card_csv(spark, path))


@query("s02_to_canonical", with_views("evt", _CANON_SQL))
def _(spark, d):
    return _canon(C.to_canonical(card_rows(spark, d)))


def pca_rows(spark, d):
    """evt as an anonymised table: elapsed seconds, 28 components, amount, class."""
    parts = [f"CAST(((event_id * {2 * i + 1}) % 1000) / 250.0 - 2 + is_fraud * {2.5 if i == 1 else 0.0} AS DOUBLE) AS V{i}" for i in range(1, 29)]
    return evt(spark, d).selectExpr("CAST(us / 1000000 - 1704067200 AS DOUBLE) AS Time", *parts, "amount AS Amount", "is_fraud AS Class")


@query("s03_read_pca_csv", with_views("evt", "SELECT count(*) AS rows, CAST(sum(is_fraud) AS BIGINT) AS positives, 31 AS columns FROM evt"))
def _(spark, d):
    path = scratch_path(spark, "pca_csv")
    pca_rows(spark, d).write.option("header", True).csv(path)
    out = C.read_pca_csv(spark, path)
    return out.agg(F.count("V28").alias("rows"), F.sum("Class").alias("positives"), F.lit(len(out.columns)).alias("columns"))


@query("s04_read_account_csv", with_views("acct_edges", """
SELECT count(*) AS rows, count(DISTINCT dst) AS receivers, CAST(sum(amount_c) AS BIGINT) AS cents, CAST(sum(is_laundering) AS BIGINT) AS laundering FROM acct_edges"""))
def _(spark, d):
    path = scratch_path(spark, "account_csv")
    rows = acct_edges(spark, d).selectExpr(
        "date_format(timestamp_micros(us), 'yyyy/MM/dd HH:mm') AS a", "'1' AS b", "CAST(src AS STRING) AS c", "'2' AS d",
        "CAST(dst AS STRING) AS e", "CAST(amount AS STRING) AS f", "'Euro' AS g", "CAST(amount AS STRING) AS h", "'Euro' AS i",
        "'Wire' AS j", "CAST(is_laundering AS STRING) AS k")
    header = ",".join(c for c, _, _ in C.ACCOUNT_COLUMNS)
    lines = rows.select(F.concat_ws(",", *rows.columns).alias("value"))
    # Every part file starts with the header, as a folder of CSV extracts has it.
    lines.mapInArrow(lambda it, h=header: _with_header(it, h), "value string").write.text(path)
    out = C.read_account_graph_csv(spark, path)
    return out.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("dst").alias("receivers"),
                   F.sum(F.round(F.col("amount") * 100).cast("bigint")).alias("cents"), F.sum("is_laundering").alias("laundering"))


def _with_header(batches, header):
    import pyarrow as pa

    first = True
    for batch in batches:
        if first:
            yield pa.RecordBatch.from_arrays([pa.array([header], batch.schema.field(0).type)], schema=batch.schema)
            first = False
        yield batch


@query("s05_parquet_roundtrip", with_views("evt", "SELECT event_id, amount_c FROM evt WHERE rail_no = 2"))
def _(spark, d):
    path = scratch_path(spark, "events")
    T.write_parquet(canonical(spark, d).select("event_id", "amount_c", "rail"), path)
    return T.read_parquet(spark, path).filter("rail = 'UPI'").select("event_id", "amount_c")


@query("s06_jsonl_append", with_views("evt", """
SELECT CAST(user_id AS BIGINT) AS user_id, CAST(rail_no AS BIGINT) AS rail_no, count(*) AS n FROM evt GROUP BY 1, 2"""))
def _(spark, d):
    path, e = scratch_path(spark, "lines"), evt(spark, d).select("user_id", "rail_no", "event_id")
    A.reset_jsonl(e.filter("rail_no = 5"), path)
    A.reset_jsonl(e.filter("rail_no = 0"), path)
    for rail in range(1, 6):
        A.append_jsonl(e.filter(F.col("rail_no") == rail), path)
    return A.read_jsonl(spark, path).groupBy("user_id", "rail_no").agg(F.count(F.lit(1)).alias("n"))


@query("s07_s09_tables", with_views("pay_edges", "SELECT src_id, dst_id, weight FROM pay_edges"))
def _(spark, d):
    location = scratch_path(spark, "warehouse")
    database = "run_" + location.rsplit("-", 1)[1]
    T.create_tables(spark, database, location)
    T.create_tables(spark, database, location)  # a second call changes nothing
    rows = V.pay_edges(spark, d).selectExpr("src_id", "dst_id", "edge_type", "timestamp_micros(first_us) AS first_seen_ts",
                                            "timestamp_micros(last_us) AS last_seen_ts", "weight")
    T.write_table(rows.filter("weight = 1"), f"{database}.edges")
    T.write_table(rows.filter("weight = 1"), f"{database}.edges", "replace")
    T.write_table(rows.filter("weight > 1"), f"{database}.edges")
    return spark.table(f"{database}.edges").select("src_id", "dst_id", "weight")


@query("s08_query", with_views("evt", "SELECT rail_no, count(*) AS n, CAST(sum(amount_c) AS BIGINT) AS cents FROM evt WHERE amount >= 100 AND mcc = 'click' GROUP BY 1"))
def _(spark, d):
    return T.query(spark, "SELECT rail_no, count(*) AS n, sum(amount_c) AS cents FROM {events} WHERE amount >= :low AND mcc = :kind GROUP BY 1",
                   {"low": 100, "kind": "click"}, events=evt(spark, d))


@query("s11_entity_dimension", with_views("evt", """
SELECT DISTINCT 'u' || CAST(user_id AS VARCHAR) AS entity_id, 'cardholder' AS entity_type, 'IN' AS home_country, user_id % 10 = 0 AS in_blind_cohort,
  CAST(issuer_id AS VARCHAR) AS issuer FROM evt
UNION ALL SELECT DISTINCT 'd' || CAST(device_id AS VARCHAR), 'device', 'GB', false, NULL FROM evt
UNION ALL SELECT DISTINCT 'm' || CAST(payee_id AS VARCHAR), 'merchant', 'IN', false, NULL FROM evt
UNION ALL SELECT DISTINCT 'i' || CAST(ip_id AS VARCHAR), 'ip', 'IN', false, NULL FROM evt
UNION ALL SELECT DISTINCT 'a' || CAST(agent_id AS VARCHAR), 'agent', 'IN', false, NULL FROM evt WHERE agent_id IS NOT NULL
UNION ALL SELECT DISTINCT 'c' || CAST(pan_id AS VARCHAR), 'card', 'IN', false, CAST(issuer_id AS VARCHAR) FROM evt WHERE pan_id IS NOT NULL"""))
def _(spark, d):
    e = evt(spark, d)
    holders = e.selectExpr("concat('u', user_id) AS entity_id", "in_blind_cohort", "issuer_id").distinct()
    devices = e.selectExpr("concat('d', device_id) AS entity_id", "'GB' AS home_country").distinct()
    others = {kind: e.filter(F.col(c).isNotNull()).selectExpr(f"concat('{kind[0]}', {c}) AS entity_id").distinct()
              for kind, c in (("merchant", "payee_id"), ("ip", "ip_id"), ("agent", "agent_id"))}
    cards = e.filter("pan_id IS NOT NULL").selectExpr("concat('c', pan_id) AS entity_id", "issuer_id").distinct()
    out = T.entity_dimension({"cardholder": holders, "device": devices, "card": cards, **others})
    return out.select("entity_id", "entity_type", "home_country", "in_blind_cohort",
                      F.get_json_object("attributes", "$.issuer_id").alias("issuer"))


@query("s12_run_readback", with_views("evt", """
SELECT CAST(vector_no AS INT) AS round, 'COMPLETED' AS status, round(avg(CASE WHEN score >= 0.7 THEN 1 ELSE 0 END) FILTER (WHERE is_fraud = 0), 6) AS fpr_legit,
  CAST(NULL AS DOUBLE) AS pr_auc FROM evt GROUP BY 1"""))
def _(spark, d):
    path = scratch_path(spark, "rounds")
    flagged = (F.col("score") >= 0.7).cast("int")
    A.append_jsonl(evt(spark, d).groupBy(F.col("vector_no").alias("round")).agg(
        F.lit("COMPLETED").alias("status"), F.avg(F.when(F.col("is_fraud") == 0, flagged)).alias("fpr_legit"),
        F.lit("x").alias("not_reported")), path)
    return A.read_rounds(spark, path).select("round", "status", r6("fpr_legit"), "pr_auc")


@query("d01_cart_digest", with_views("evt", """
SELECT event_id, sha256('{"payee":' || CAST(payee_id AS VARCHAR) || ',"total":' || CAST(amount_c AS VARCHAR) || '}') AS digest FROM evt"""))
def _(spark, d):
    e = evt(spark, d)
    return e.select("event_id", N.cart_digest(F.col("payee_id").alias("payee"), F.col("amount_c").alias("total")).alias("digest"))


@query("d02_luhn", with_views("evt", """
WITH x AS (SELECT event_id, CAST(400000000000000 + event_id * 7919 AS VARCHAR) AS t FROM evt),
g AS (SELECT event_id, list_sum(list_transform(range(1, 16), lambda i: CASE WHEN (15 - i) % 2 = 1 THEN
  (CASE WHEN CAST(substr(t, CAST(i AS INT), 1) AS INT) * 2 > 9 THEN CAST(substr(t, CAST(i AS INT), 1) AS INT) * 2 - 9 ELSE CAST(substr(t, CAST(i AS INT), 1) AS INT) * 2 END)
  ELSE CAST(substr(t, CAST(i AS INT), 1) AS INT) END)) AS s FROM x)
SELECT event_id, s % 10 = 0 AS valid FROM g"""))
def _(spark, d):
    digits = (F.lit(400000000000000) + F.col("event_id") * 7919).cast("string")
    return evt(spark, d).select("event_id", N.luhn_check(digits).alias("valid"))
