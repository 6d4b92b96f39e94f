"""Windowed velocity, distinct counters and mergeable sketches; each runs on a stream or a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paysieve.plans.scan import previous_row, running_totals

COUNTER_TTL = "24 hours"
COUNTER_TTL_US = 86_400_000_000


def _watermarked(df: DataFrame, at: str, lateness: str) -> DataFrame:
    return df.withWatermark(at, lateness) if df.isStreaming else df


def window_velocity(df: DataFrame, keys: Sequence[str], at: str, cents: Column, declined: Column, width: str,
                    slide: str | None = None, lateness: str = "10 minutes") -> DataFrame:
    """(keys, start, cnt, cents, declines) per tumbling or sliding window; partial aggregation
    before the shuffle keeps a hot key to one row per task and window.
    """
    span = F.window(at, width, slide) if slide else F.window(at, width)
    return _watermarked(df, at, lateness).groupBy(*keys, span.alias("w")).agg(
        F.count(F.lit(1)).alias("cnt"), F.sum(cents).alias("cents"), F.sum(declined.cast("bigint")).alias("declines")
    ).select(*keys, F.unix_micros("w.start").alias("start_us"), "cnt", "cents", "declines")


def distinct_counter(df: DataFrame, key: str, other: str, at: str, ttl: str = COUNTER_TTL,
                     lateness: str = "10 minutes") -> DataFrame:
    """(key, start_us, distinct): values counted while the counter stays alive; every event renews
    its time to live, so a counter is a session. The count is a sketch estimate.
    """
    return _watermarked(df, at, lateness).groupBy(key, F.session_window(at, ttl).alias("s")).agg(
        F.hll_sketch_estimate(F.hll_sketch_agg(F.col(other).cast("string"), 14)).alias("distinct")
    ).select(key, F.unix_micros("s.start").alias("start_us"), "distinct")


def distinct_counter_exact(df: DataFrame, key: str, other: str, at: str, tie: str, ttl_us: int = COUNTER_TTL_US) -> DataFrame:
    """The exact twin on a table: sessions by gap, then distinct values per session, counted in
    two map-side combined steps.
    """
    seen = previous_row(df.select(key, other, at, tie), [key], at, tie, {"_p": F.col(at)})
    starts = F.coalesce((F.col(at) - F.col("_p") >= ttl_us).cast("int"), F.lit(1))
    marked = running_totals(seen.withColumn("_s", starts), [key], at, {"_n": F.col("_s").cast("bigint")}, tie=tie)
    session = (F.col("_n") + F.col("_s")).alias("session")
    values = marked.groupBy(key, session, other).agg(F.min(at).alias("_f"))
    return values.groupBy(key, "session").agg(F.min("_f").alias("start_us"), F.count(other).alias("distinct")).drop("session")


def hourly_sketches(df: DataFrame, keys: Sequence[str], other: str, at: str, lateness: str = "10 minutes") -> DataFrame:
    """One mergeable distinct sketch per key and hour."""
    return _watermarked(df, at, lateness).groupBy(*keys, F.window(at, "1 hour").alias("w")).agg(
        F.hll_sketch_agg(F.col(other).cast("string"), 14).alias("sketch")
    ).select(*keys, F.col("w.start").alias("hour"), "sketch")


def roll_up(sketches: DataFrame, keys: Sequence[str], to: str = "day") -> DataFrame:
    """Distinct estimate per key and coarser period by merging hourly sketches."""
    return sketches.groupBy(*keys, F.date_trunc(to, "hour").alias("period")).agg(
        F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct")
    ).select(*keys, F.unix_micros("period").alias("period_us"), "distinct")
