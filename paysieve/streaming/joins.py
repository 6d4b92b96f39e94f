"""Labels that arrive later, scores on the fly, and replay of an event log."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def label_arrivals(events: DataFrame, labels: DataFrame, key="event_id", at="event_ts", label_at="label_ts",
                   embargo="30 days", lateness="1 hour") -> DataFrame:
    """Events joined to their label when it arrives within the embargo after the event.

    Both watermarks and the time bound let Spark drop state once a label can no longer match.
    """
    left = events.withWatermark(at, lateness)
    right = labels.withColumnRenamed(key, "_label_key").withWatermark(label_at, lateness)
    within = (F.col(label_at) >= F.col(at)) & (F.col(label_at) <= F.col(at) + F.expr(f"INTERVAL {embargo}"))
    return left.join(right, (F.col(key) == F.col("_label_key")) & within).drop("_label_key")


def score_stream(events: DataFrame, dimension: DataFrame, key: str, features: Callable[[DataFrame], DataFrame],
                 scorer: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Stream-static join for entity attributes, then row-wise features and the model."""
    return scorer(features(events.join(dimension, key, "left")))


def write_scores(scored: DataFrame, path: str, checkpoint: str, band: Callable[[DataFrame], DataFrame] = lambda d: d):
    """Micro-batches to one folder per batch; a repeated batch replaces its own folder."""
    def save(batch: DataFrame, number: int) -> None:
        band(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return scored.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(save).start()


def drop_late(events: DataFrame, at: str, keys: list[str], lateness: str) -> DataFrame:
    """Replay with repeated deliveries removed and rows behind the watermark dropped."""
    return events.withWatermark(at, lateness).dropDuplicatesWithinWatermark(keys)
