"""Queries that run the streaming operators over the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from paysieve.catalog.base import Catalog, frame, r6
from paysieve.catalog.views import CONTROL_SQL, as_evt, dimension, evt, with_views
from paysieve.operators import decisions as D
from paysieve.operators.features import hours_since
from paysieve.operators.windows import DAY, HOUR
from paysieve.plans.durable import scratch_path
from paysieve.sources.artefacts import append_jsonl
from paysieve.streaming import joins as J
from paysieve.streaming import runner as R
from paysieve.streaming import stateful as S
from paysieve.streaming import velocity as V

query = Catalog()


def stream(spark, d):
    return as_evt(R.stream_parquet(spark, d, "events.parquet"))


_DAILY = f"""SELECT user_id, us - us % {DAY} AS start_us, count(*) AS cnt, CAST(sum(amount_c) AS BIGINT) AS cents,
  CAST(sum(declined) AS BIGINT) AS declines FROM evt GROUP BY 1, 2"""


@query("r01_velocity_stream", with_views("evt", _DAILY))
def _(spark, d):
    out = V.window_velocity(stream(spark, d), ["user_id"], "event_ts", F.col("amount_c"), F.col("declined"), "1 day")
    return R.land_updates(out, ["user_id", "start_us"])


@query("r01c_sliding_stream", with_views("evt", f"""SELECT user_id, s AS start_us, count(*) AS cnt, CAST(sum(amount_c) AS BIGINT) AS cents, CAST(sum(declined) AS BIGINT) AS declines
FROM (SELECT *, unnest([us - us % {6 * HOUR} - i * {6 * HOUR} FOR i IN range(4)]) AS s FROM evt) GROUP BY 1, 2"""))
def _(spark, d):
    out = V.window_velocity(stream(spark, d), ["user_id"], "event_ts", F.col("amount_c"), F.col("declined"), "1 day", "6 hours")
    return R.land_updates(out, ["user_id", "start_us"])


@query("r01b_velocity_batch_twin", with_views("evt", _DAILY))
def _(spark, d):
    return V.window_velocity(evt(spark, d), ["user_id"], "event_ts", F.col("amount_c"), F.col("declined"), "1 day")


@query("r02_trailing_stream", with_views("evt", f"""
SELECT CAST(user_id AS VARCHAR) AS key, event_id, count(*) OVER {frame('user_id', HOUR)} AS cnt_1h, count(*) OVER {frame('user_id', DAY)} AS cnt_24h,
  coalesce(CAST(sum(amount_c) OVER {frame('user_id', HOUR)} AS BIGINT), 0) AS sum_1h,
  coalesce(CAST(sum(amount_c) OVER {frame('user_id', DAY)} AS BIGINT), 0) AS sum_24h FROM evt"""))
def _(spark, d):
    return R.land(S.trailing_stream(stream(spark, d), "user_id", {"1h": HOUR, "24h": DAY}))


@query("r02b_measures_stream", with_views("evt", f"""
WITH p AS (SELECT *, lag(us) OVER (PARTITION BY user_id, payee_id ORDER BY us, event_id) AS before FROM evt),
n AS (SELECT *, CASE WHEN before IS NULL OR us - before >= {DAY} THEN 1 ELSE 0 END AS fresh FROM p)
SELECT CAST(user_id AS VARCHAR) AS key, event_id, count(*) OVER {frame('user_id', DAY)} AS cnt, coalesce(CAST(sum(amount_c) OVER {frame('user_id', DAY)} AS BIGINT), 0) AS cents,
  round(stddev_samp(amount_c / 100.0E0) OVER {frame('user_id', DAY)}, 4) AS std, coalesce(CAST(sum(fresh) OVER {frame('user_id', DAY)} AS BIGINT), 0) AS "distinct",
  CAST(CASE WHEN before IS NULL THEN 1 ELSE 0 END AS INT) AS first, {", ".join(f"count(CASE WHEN k % 3 = {i} THEN 1 END) OVER {frame('user_id', DAY)} AS c{i}" for i in range(3))} FROM n"""))
def _(spark, d):
    events = stream(spark, d).withColumn("category", F.col("k") % 3)
    return R.land(S.measures_stream(events, "user_id", DAY, "payee_id", "category", 3)).withColumn("std", F.round("std", 4))


@query("r03_distinct_counter_stream", with_views("evt", f"""
WITH g AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY device_id ORDER BY us, event_id) < {2 * HOUR} THEN 0 ELSE 1 END AS s FROM evt),
n AS (SELECT *, sum(s) OVER (PARTITION BY device_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS session FROM g)
SELECT CAST(device_id AS VARCHAR) AS key, min(us) AS start_us, count(DISTINCT pan_id) AS "exact", true AS close FROM n GROUP BY device_id, session"""))
def _(spark, d):
    """Counters kept alive for two hours by every add, beside their exact twins: equal starts, estimates within 3 % or one."""
    found = R.land_updates(S.living_counter(stream(spark, d), "device_id", "pan_id", 2 * HOUR), ["key", "start_us"])
    exact = V.distinct_counter_exact(evt(spark, d), "device_id", "pan_id", "us", "event_id", 2 * HOUR).select(
        F.col("device_id").cast("string").alias("key"), "start_us", F.col("distinct").alias("exact"))
    near = F.abs(F.col("distinct") - F.col("exact")) <= F.greatest(F.lit(1.0), 0.03 * F.col("exact"))
    return found.join(exact, ["key", "start_us"], "left").select("key", "start_us", "exact", F.coalesce(near, F.lit(False)).alias("close"))


@query("r03c_session_counter")
def _(spark, d):
    return R.land(V.distinct_counter(stream(spark, d), "device_id", "pan_id", "event_ts", "2 hours"), "complete")


@query("r03b_distinct_counter_exact", with_views("evt", f"""
WITH g AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY user_id ORDER BY us, event_id) < {DAY} THEN 0 ELSE 1 END AS s FROM evt),
n AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS session FROM g)
SELECT user_id, min(us) AS start_us, count(DISTINCT pan_id) AS "distinct" FROM n GROUP BY user_id, session"""))
def _(spark, d):
    return V.distinct_counter_exact(evt(spark, d), "user_id", "pan_id", "us", "event_id")


@query("r04_hll_rollup", with_views("evt", """
SELECT device_id, (us // 86400000000) * 86400000000 AS period_us, count(DISTINCT user_id) AS "exact", true AS close FROM evt GROUP BY ALL"""))
def _(spark, d):
    sketches = R.land_updates(V.hourly_sketches(stream(spark, d), ["device_id"], "user_id", "event_ts"), ["device_id", "hour"])
    found = V.roll_up(sketches, ["device_id"])
    exact = evt(spark, d).groupBy("device_id", (F.floor(F.col("us") / 86_400_000_000) * 86_400_000_000).alias("period_us")).agg(
        F.count_distinct("user_id").alias("exact"))
    near = F.abs(F.col("distinct") - F.col("exact")) <= F.greatest(F.lit(1.0), 0.03 * F.col("exact"))
    return found.join(exact, ["device_id", "period_us"], "left").select("device_id", "period_us", "exact", F.coalesce(near, F.lit(False)).alias("close"))


@query("r05_nonce_replay", with_views("evt", """
SELECT CAST(mandate_nonce AS VARCHAR) AS nonce, event_id, f AS first_event_id FROM (
  SELECT mandate_nonce, event_id, first_value(event_id) OVER w AS f, row_number() OVER w AS rn FROM evt WHERE mandate_nonce IS NOT NULL
  WINDOW w AS (PARTITION BY mandate_nonce ORDER BY us, event_id)) WHERE rn > 1"""))
def _(spark, d):
    return R.land(S.nonce_replays(stream(spark, d)))


@query("r06_streaming_score", with_views("evt", f"""
WITH c AS ({CONTROL_SQL.format(src='evt')})
SELECT event_id, round(0.5 * score + 0.5 * coalesce(control_strength, 0.5), 6) AS fused,
  CASE WHEN 0.5 * score + 0.5 * coalesce(control_strength, 0.5) < 0.3 THEN 'APPROVE' WHEN 0.5 * score + 0.5 * coalesce(control_strength, 0.5) < 0.7 THEN 'STEP_UP'
    WHEN 0.5 * score + 0.5 * coalesce(control_strength, 0.5) < 0.9 THEN 'HOLD' ELSE 'DECLINE_REVIEW' END AS band
FROM evt LEFT JOIN c ON payee_id = entity_id"""))
def _(spark, d):
    strength = dimension(evt(spark, d), CONTROL_SQL).withColumnRenamed("entity_id", "payee_id")
    scored = J.score_stream(stream(spark, d), strength, "payee_id", lambda f: f.fillna(0.5, ["control_strength"]),
                            lambda f: f.withColumn("fused", 0.5 * F.col("score") + 0.5 * F.col("control_strength")))
    path = scratch_path(spark, "scores")
    J.write_scores(scored.select("event_id", "fused"), path, scratch_path(spark, "progress"),
                   lambda b: b.withColumn("band", D.ladder_band(F.col("fused")))).awaitTermination()
    return spark.read.parquet(path).select("event_id", r6("fused"), "band")


@query("r07_label_arrivals", with_views("evt", f"""
SELECT event_id, is_fraud FROM evt WHERE (event_id % 40) <= 30"""))
def _(spark, d):
    events = stream(spark, d).select("event_id", "event_ts")
    labels = stream(spark, d).select("event_id", "is_fraud", (F.col("event_ts") + F.make_interval(days=F.col("event_id") % 40)).alias("label_ts"))
    return R.land(J.label_arrivals(events, labels)).select("event_id", "is_fraud")


@query("r08_log_replay", with_views("evt", "SELECT event_id, amount_c FROM evt"))
def _(spark, d):
    path, e = scratch_path(spark, "log"), evt(spark, d).select("event_id", "event_ts", "amount_c")
    append_jsonl(e, path)
    append_jsonl(e.filter("event_id % 5 = 0"), path)  # a second delivery of some events
    log = R.stream_jsonl(spark, path, "event_id long, event_ts timestamp, amount_c long")
    return R.land(J.drop_late(log, "event_ts", ["event_id"], "40 days")).select("event_id", "amount_c")
