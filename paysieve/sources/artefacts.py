"""Run artefacts as JSON lines: append, reset, read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROUND_COLUMNS = {"round": "int", "status": "string", "evasion_active": "double", "evasion_blind": "double",
                 "pr_auc": "double", "pr_auc_blind": "double", "fpr_legit": "double", "fidelity_composite": "double",
                 "cost_per_100k": "double", "threshold": "double", "latency_p99_ms": "double"}


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def reset_jsonl(df: DataFrame, path: str) -> None:
    """Replace whatever the path holds by the rows of df."""
    df.write.mode("overwrite").json(path)


def read_jsonl(spark: SparkSession, path: str, schema=None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.json(path)


def read_rounds(spark: SparkSession, path: str) -> DataFrame:
    """Round records cut to the reported columns; a field a record lacks is null."""
    schema = ", ".join(f"`{n}` {t}" for n, t in ROUND_COLUMNS.items())
    return read_jsonl(spark, path, schema)


def read_optional(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """An artefact a run may not have written: empty when it is not there."""
    from pyspark.errors import AnalysisException

    try:
        return read_jsonl(spark, path, schema)
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return spark.createDataFrame([], schema)


def manifest_hash(*fields: Column) -> Column:
    """Short identity of a configuration: SHA-256 of its JSON in the given field order."""
    return F.sha2(F.to_json(F.struct(*fields)), 256)
