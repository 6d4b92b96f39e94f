"""A corpus pipeline of five stages, each over all that its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet in the shared folder and gives
it, read again, to the next. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paysieve.llm import decontaminate, line_dedup, mixing, near_dedup, quality_rules
from paysieve.plans.durable import scratch_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current policy accepts."""
    return quality_rules.keep(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that other documents keep; n_chars follows the text."""
    return line_dedup.cleaned(docs, length="n_chars")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of the least id, of each group of near-duplicates."""
    return near_dedup.keep_first(docs)


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark, and without documents that are mostly such; n_chars follows."""
    out = decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    return mixing.mix(docs)


STAGES = [("quality rules", quality), ("line dedup", lines), ("near dedup", near), ("decontamination", benchmarks), ("mixing", mixed)]

#: SQL cannot draw the signatures of the near-duplicate stage; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        path = scratch_path(spark, "stage")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
