"""Reading tables as streams and landing results where every executor can write."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paysieve.plans.durable import scratch_path

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Keyed state beyond executor memory, and what custom state processors require."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def stream_parquet(spark: SparkSession, folder: str, name: str, files_per_trigger: int | None = None) -> DataFrame:
    """Files of a folder matching ``name`` as a stream, with the schema of what is there."""
    schema = spark.read.option("pathGlobFilter", name).parquet(folder).schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", name)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def stream_jsonl(spark: SparkSession, folder: str, schema: str, files_per_trigger: int | None = None) -> DataFrame:
    """An event log of JSON lines as a stream."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.json(folder)


def land(stream: DataFrame, mode: str = "append", path: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Run to the end of what is available and read the result back.

    Append goes to the transactional file sink. Complete mode rewrites the result per batch.
    """
    spark = stream.sparkSession
    path = path or scratch_path(spark, "landed")
    checkpoint = checkpoint or scratch_path(spark, "progress")
    writer = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    schema = stream.schema
    if mode == "append":
        query = writer.outputMode("append").format("parquet").option("path", path).start()
    else:
        query = writer.outputMode(mode).foreachBatch(
            lambda batch, _: batch.write.mode("overwrite").parquet(path)).start()
    query.awaitTermination()
    return spark.read.schema(schema).parquet(path)


BATCH = "_batch"


def write_batch(batch: DataFrame, batch_id: int, path: str) -> None:
    """The rows that a batch changed, in a folder of its own: a batch that is delivered again replaces itself."""
    batch.write.mode("overwrite").parquet(f"{path}/{BATCH}={batch_id}")


def latest(spark: SparkSession, path: str, keys: Sequence[str], schema) -> DataFrame:
    """The last state of every key over all batches written so far."""
    from pyspark.sql.types import LongType, StructType

    rows = spark.read.schema(StructType([*schema.fields, *StructType().add(BATCH, LongType()).fields])).parquet(path)
    values = [c for c in schema.fieldNames() if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), BATCH).alias("_v"))
    return last.select(*[F.col("_v").getField(c).alias(c) if c in values else F.col(c) for c in schema.fieldNames()])


def land_updates(stream: DataFrame, keys: Sequence[str], path: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Run to the end of what is available in update mode, and read the last state of every key back.

    What a batch writes follows the keys it changed, not the size of the result.
    """
    spark = stream.sparkSession
    path = path or scratch_path(spark, "landed")
    checkpoint = checkpoint or scratch_path(spark, "progress")
    writer = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("update")
    writer.foreachBatch(lambda batch, batch_id: write_batch(batch, batch_id, path)).start().awaitTermination()
    return latest(spark, path, keys, stream.schema)
