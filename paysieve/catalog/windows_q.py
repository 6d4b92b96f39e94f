"""Queries over the point-in-time windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from paysieve.catalog.base import Catalog, frame, r6
from paysieve.catalog.views import evt, ord_, with_views
from paysieve.operators import windows as w
from paysieve.operators.windows import DAY, HOUR, Measure

query = Catalog()
_r, _frame = r6, frame


@query("w01_pit_count_24h", with_views("evt", f"""
SELECT event_id, count(amount_c) OVER {_frame('user_id', DAY)} AS cnt FROM evt"""))
def _(spark, d):
    return w.pit_count(evt(spark, d), ["user_id"], "us", DAY, F.col("amount_c")).select("event_id", "cnt")


@query("w02_pit_sum_1h_7d", with_views("evt", f"""
SELECT event_id, coalesce(CAST(sum(amount_c) OVER {_frame('payee_id', HOUR)} AS BIGINT), 0) AS sum_1h,
  coalesce(CAST(sum(amount_c) OVER {_frame('payee_id', 7 * DAY)} AS BIGINT), 0) AS sum_7d FROM evt"""))
def _(spark, d):
    m = [Measure("sum_1h", "a", HOUR, "sum"), Measure("sum_7d", "a", 7 * DAY, "sum")]
    return w.trailing(evt(spark, d), ["payee_id"], "us", {"a": F.col("amount_c")}, m).select(
        "event_id", "sum_1h", "sum_7d")


@query("w03_pit_mean_null_key", with_views("evt", f"""
SELECT event_id, round(avg(amount_c) OVER {_frame('pan_id', DAY)} / 100, 6) AS mean FROM evt"""))
def _(spark, d):
    return w.pit_mean(evt(spark, d), ["pan_id"], "us", DAY, F.col("amount_c"), scale=100).select(
        "event_id", _r("mean"))


@query("w04_pit_std_ties", with_views("ord", f"""
SELECT event_id, count(amount_c) OVER {_frame('payer_id', 90 * DAY)} AS cnt,
  round(stddev_samp(amount_c) OVER {_frame('payer_id', 365 * DAY)} / 100, 4) AS std FROM ord"""))
def _(spark, d):
    m = [Measure("cnt", "a", 90 * DAY, "count"), Measure("std", "a", 365 * DAY, "std", 100)]
    out = w.trailing(ord_(spark, d), ["payer_id"], "us", {"a": F.col("amount_c")}, m, method="running")
    return out.select("event_id", "cnt", F.round("std", 4).alias("std"))


@query("w05_category_counts", with_views("evt", f"""
SELECT event_id, {", ".join(f"count(*) FILTER (WHERE rail_no = {c}) OVER f AS c{c}" for c in range(6))}
FROM evt WINDOW f AS {_frame('device_id', DAY)}"""))
def _(spark, d):
    out = w.pit_category_counts(evt(spark, d), ["device_id"], "us", DAY, F.col("rail_no"), 6)
    return out.select("event_id", *[f"c{i}" for i in range(6)])


_NEW = """SELECT event_id, us, {key}, CASE WHEN p IS NULL OR us - p >= {w} THEN 1 ELSE 0 END AS is_new
FROM (SELECT *, lag(us) OVER (PARTITION BY {key}, {other} ORDER BY us, event_id) AS p FROM evt)"""


@query("w06_distinct_approx", with_views("evt", f"""
WITH n AS ({_NEW.format(key='payee_id', other='user_id', w=DAY)})
SELECT event_id, CAST(coalesce(sum(is_new) OVER {_frame('payee_id', DAY)}, 0) AS BIGINT) AS payers FROM n"""))
def _(spark, d):
    return w.pit_distinct_approx(evt(spark, d), ["payee_id"], "us", "user_id", DAY, "event_id", "payers").select(
        "event_id", "payers")


@query("w07_distinct_exact", with_views("evt", f"""
SELECT event_id, CAST(count(DISTINCT coalesce(pan_id, -1)) OVER {_frame('device_id', HOUR * 6)} AS BIGINT) AS pans
FROM evt"""))
def _(spark, d):
    return w.pit_distinct_exact(evt(spark, d), ["device_id"], "us", "pan_id", 6 * HOUR, "event_id", "pans").select(
        "event_id", "pans")


BLOCK_KEYS = {"pan_token": "pan_id", "device_id": "device_id", "ip": "ip_id", "merchant_id": "payee_id",
              "payee_entity_id": "payee_id", "agent_id": "agent_id"}
BLOCK_WINDOWS = w.VELOCITY_WINDOWS


def _block_sql(keys, windows):
    cols = []
    for name, col in keys.items():
        for label, width in windows.items():
            f = _frame(col, width)
            cols += [
                f"CAST(count(amount_c) OVER {f} AS DOUBLE) AS cnt_{name}_{label}",
                f"round(coalesce(CAST(sum(amount_c) OVER {f} AS DOUBLE), 0) / 100, 4) AS sum_{name}_{label}",
                f"round(coalesce(avg(declined) OVER {f}, 0), 6) AS declrate_{name}_{label}",
                f"round(coalesce(stddev_samp(amount_c) OVER {f}, 0) / 100, 4) AS amtstd_{name}_{label}",
            ]
    return f"SELECT event_id, {', '.join(cols)} FROM evt"


@query("w08_velocity_block", with_views("evt", _block_sql(BLOCK_KEYS, BLOCK_WINDOWS)))
def velocity(spark, d):
    out = w.velocity_block(evt(spark, d), "event_id", "us", F.col("amount_c"), F.col("declined"),
                           BLOCK_KEYS, BLOCK_WINDOWS)
    digits = {"cnt": 0, "sum": 4, "declrate": 6, "amtstd": 4}
    return out.select("event_id", *[
        F.round(c, digits[c.split("_")[0]]).alias(c) for c in out.columns if c != "event_id"])


@query("w09_first_occurrence", with_views("evt", """
SELECT event_id, CASE WHEN row_number() OVER (PARTITION BY user_id, payee_id ORDER BY us, event_id) = 1
  THEN 1 ELSE 0 END AS first FROM evt"""))
def _(spark, d):
    return w.first_occurrence(evt(spark, d), "user_id", "payee_id", "us", "event_id").select("event_id", "first")


@query("w10_age_since_first", with_views("evt", """
SELECT event_id, round((us - min(us) OVER (PARTITION BY user_id, payee_id)) / CAST(3600000000 AS DOUBLE), 6)
  AS age_hours FROM evt"""))
def _(spark, d):
    return w.age_since_first(evt(spark, d), "user_id", "payee_id", "us").select("event_id", _r("age_hours"))


@query("w11_nonce_reused", with_views("evt", """
SELECT event_id, CASE WHEN mandate_nonce IS NOT NULL AND
  row_number() OVER (PARTITION BY mandate_nonce ORDER BY us, event_id) > 1 THEN 1 ELSE 0 END AS reused FROM evt"""))
def _(spark, d):
    return w.reused(evt(spark, d), "mandate_nonce", "us", "event_id").select("event_id", "reused")


@query("w12_expanding_zscore", with_views("evt", """
SELECT event_id, round(CASE WHEN n >= 2 AND sd > 1e-7 THEN (amount_c - m) / sd ELSE 0 END, 5) AS z FROM (
  SELECT event_id, amount_c, count(*) OVER f AS n, avg(amount_c) OVER f AS m, stddev_pop(amount_c) OVER f AS sd
  FROM evt WINDOW f AS (PARTITION BY user_id ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
"""))
def _(spark, d):
    return w.expanding_zscore(evt(spark, d), "user_id", "us", "event_id", F.col("amount_c")).select(
        "event_id", F.round("z", 5).alias("z"))


@query("w13_expanding_hour_loglik", with_views("evt", """
SELECT event_id, round(ln((1.0 + CAST(h AS DOUBLE)) / (24.0 + CAST(n AS DOUBLE))), 6) AS loglik FROM (
  SELECT event_id,
    count(*) OVER (PARTITION BY user_id, (us // 3600000000) % 24 ORDER BY us, event_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS h,
    count(*) OVER (PARTITION BY user_id ORDER BY us, event_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS n FROM evt)"""))
def _(spark, d):
    return w.expanding_hour_loglik(evt(spark, d), "user_id", "us", "event_id", F.hour("event_ts")).select(
        "event_id", _r("loglik"))


@query("w14_inter_event_time", with_views("evt", """
SELECT event_id, round((us - lag(us) OVER (PARTITION BY pan_id ORDER BY us, event_id)) / CAST(1000000 AS DOUBLE), 6)
  AS gap_s FROM evt WHERE pan_id IS NOT NULL"""))
def _(spark, d):
    return w.inter_event_time(evt(spark, d), "pan_id", "us", "event_id").select("event_id", _r("gap_s"))


AUTOCORR_SQL = """
g AS (SELECT {key} AS key, us, event_id, ln(gap) AS x FROM (
    SELECT *, (us - lag(us) OVER (PARTITION BY {key} ORDER BY us, event_id)) / CAST(1000000 AS DOUBLE) AS gap
    FROM {src} WHERE {key} IS NOT NULL) WHERE gap > 0),
p AS (SELECT key, x, lead(x) OVER (PARTITION BY key ORDER BY us, event_id) AS y FROM g),
a AS (SELECT key, count(*) AS gaps, stddev_pop(x) AS sd, corr(x, y) AS corr FROM p GROUP BY key
    HAVING count(*) >= 5 AND stddev_pop(x) > 0)
"""


@query("w15_lag1_autocorr", with_views("evt", f"""
WITH {AUTOCORR_SQL.format(key='user_id', src='evt')}
SELECT key AS user_id, gaps, round(corr, 6) AS corr FROM a WHERE NOT isnan(corr)"""))
def _(spark, d):
    return w.lag1_autocorr(evt(spark, d), "user_id", "us", "event_id").select("user_id", "gaps", _r("corr"))


@query("w15b_weighted_autocorr", with_views("evt", f"""
WITH {AUTOCORR_SQL.format(key='user_id', src='evt')}
SELECT round(sum(corr * (gaps - 1)) / sum(gaps - 1), 6) AS autocorr, count(*) AS keys FROM a WHERE NOT isnan(corr)"""))
def _(spark, d):
    return w.weighted_autocorr(evt(spark, d), "user_id", "us", "event_id").select(_r("autocorr"), "keys")


@query("w16_burstiness", with_views("evt", """
WITH g AS (SELECT campaign_no, (us - lag(us) OVER (PARTITION BY campaign_no ORDER BY us, event_id)) / CAST(1000000 AS DOUBLE)
    AS gap FROM evt WHERE is_fraud = 1),
a AS (SELECT campaign_no, count(*) AS gaps, avg(gap) AS m, stddev_pop(gap) AS s FROM g WHERE gap IS NOT NULL
    GROUP BY campaign_no HAVING count(*) >= 5)
SELECT campaign_no, gaps, round((s - m) / (s + m), 6) AS burstiness FROM a"""))
def _(spark, d):
    return w.burstiness(evt(spark, d).filter("is_fraud = 1"), "campaign_no", "us", "event_id").select(
        "campaign_no", "gaps", _r("burstiness"))
