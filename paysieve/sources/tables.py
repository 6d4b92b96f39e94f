"""Parquet files, catalog tables and ad-hoc SQL."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

# The four tables of a run, and the attributes kept as JSON.
TABLES = {
    "entities": "entity_id STRING, entity_type STRING, created_ts TIMESTAMP, home_country STRING, "
                "in_blind_cohort BOOLEAN, attributes STRING",
    "edges": "src_id STRING, dst_id STRING, edge_type STRING, first_seen_ts TIMESTAMP, last_seen_ts TIMESTAMP, weight BIGINT",
    "campaigns": "campaign_id STRING, vector_id STRING, round INT, params STRING, agent_rationale STRING, n_events BIGINT, "
                 "evasion_rate DOUBLE, fidelity_passed BOOLEAN, in_training_pool BOOLEAN",
    "round_metrics": "run_id STRING, round INT, status STRING, pr_auc DOUBLE, pr_auc_blind DOUBLE, fpr_legit DOUBLE, "
                     "evasion_active DOUBLE, evasion_blind DOUBLE, fidelity_composite DOUBLE, cost_per_100k DOUBLE, "
                     "coverage_pct DOUBLE, threshold DOUBLE, latency_p99_ms DOUBLE",
}
ATTRIBUTES = ("mcc", "control_strength", "acquirer_id", "issuer_id", "card_network", "kyc_level", "balance_band",
              "device_os", "ip_asn", "proxy_flag", "bank_bic", "agent_operator", "protocol")
DEFAULT_COUNTRY, DEFAULT_CREATED = "IN", "2026-01-01 00:00:00"
# End of fixed values.


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = ("rail",), mode="overwrite") -> None:
    keys = [k for k in partition_by if k in df.columns]
    df.write.mode(mode).partitionBy(*keys).parquet(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def create_tables(spark: SparkSession, database: str, location: str) -> list[str]:
    """The four run tables, if not there yet, under a shared folder."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    for name, columns in TABLES.items():
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({columns}) USING parquet LOCATION '{location}/{name}'")
    return [f"{database}.{n}" for n in TABLES]


def query(spark: SparkSession, text: str, params: Mapping | None = None, **views: DataFrame) -> DataFrame:
    """Parameterised SQL; frames passed by name are referred to as {name}."""
    return spark.sql(text, args=dict(params or {}), **views)


def write_table(df: DataFrame, table: str, mode: str = "append") -> int:
    """Insert by column name, replacing the content on demand; returns the rows written."""
    if mode not in ("append", "replace"):
        raise ValueError(f"unknown mode {mode}")
    target = df.sparkSession.table(table).schema
    aligned = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in target.fields])
    seen = Observation()
    aligned.observe(seen, F.count(F.lit(1)).alias("rows")).write.insertInto(table, overwrite=mode == "replace")
    return seen.get["rows"]


def entity_dimension(kinds: Mapping[str, DataFrame], attributes: Sequence[str] = ATTRIBUTES) -> DataFrame:
    """One row per entity of every kind: id, type, creation, country, cohort flag, other
    attributes as JSON with sorted keys; what a kind lacks gets its default.
    """
    parts = []
    for kind, df in kinds.items():
        have = sorted(c for c in attributes if c in df.columns)
        packed = F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in have])) if have else F.lit("{}")
        pick = lambda name, default: F.col(name) if name in df.columns else default
        parts.append(df.select(
            F.col("entity_id").cast("string").alias("entity_id"), F.lit(kind).alias("entity_type"),
            pick("created_ts", F.lit(DEFAULT_CREATED).cast("timestamp")).alias("created_ts"),
            pick("home_country", F.lit(DEFAULT_COUNTRY)).alias("home_country"),
            pick("in_blind_cohort", F.lit(False)).alias("in_blind_cohort"), packed.alias("attributes")))
    return reduce(DataFrame.unionByName, parts)
