"""Temporal splits, entity splits, hash-ordered sampling and prevalence control.

Cuts are found as order statistics over counts and applied as literal filters, so the rows
themselves are never sorted or moved to make a split.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paysieve.operators.windows import DAY
from paysieve.plans.scan import order_statistic, order_statistics, rank_in_group, running_totals, up_to

BURST_ROWS = 14
SCALE_DOWN_ROUNDS = 2
PREVALENCE_HARD_CAP = 0.01
# Highest fraud share per rail and the rails that share one budget.
RAIL_CAPS = {"CARD_CNP": 0.01, "CARD_CP": 0.01, "UPI": 0.01, "SEPA_INST": 0.01, "ACH": 0.01, "AGENTIC": 0.02}
BUDGET_GROUPS = {"SEPA_INST": ("SEPA_INST", "ACH"), "ACH": ("SEPA_INST", "ACH"),
                 "CARD_CNP": ("CARD_CNP", "CARD_CP"), "CARD_CP": ("CARD_CNP", "CARD_CP")}
# End of fixed values.


def hash_order(key: str) -> Column:
    """The default random order: a fixed hash of the key."""
    return F.xxhash64(key)


def positional_cut(df: DataFrame, at: str, tie: str, fraction: float) -> tuple[DataFrame, DataFrame]:
    """(first ``int(n * fraction)`` rows in (at, tie) order, the rest)."""
    edge = order_statistic(df, at, tie, lambda rows: int(rows * fraction))
    return df.filter(up_to(at, tie, edge)), df.filter(~up_to(at, tie, edge))


def smallest(df: DataFrame, order: str, tie: str, rows: int) -> DataFrame:
    """The ``rows`` first rows in (order, tie) order."""
    if rows <= 0:
        return df.filter(F.lit(False))
    edge = order_statistic(df, order, tie, rows)
    return df if edge is None else df.filter(up_to(order, tie, edge))


def label_embargo(df: DataFrame, cutoff_us: int, column: str = "label_available_us") -> DataFrame:
    """Rows whose label is known by the cutoff; unknown dates drop, a missing column passes."""
    return df if column not in df.columns else df.filter(F.col(column) <= F.lit(cutoff_us))


def label_available(at: Column, embargo_days: int) -> Column:
    return at + F.lit(embargo_days * DAY)


def temporal_split(
    df: DataFrame, start_us: int, train_end_day: int, embargo_days: int, *, at="us", tie="event_id",
    label_column="label_available_us", boundary_day: int | None = None, validation_fraction: float = 0.2,
) -> dict[str, DataFrame]:
    """train / validation / test. The test set starts at the boundary day; the others are
    rows before it whose label was available at the training cutoff, the last fifth by time
    being validation.
    """
    boundary = start_us + (train_end_day if boundary_day is None else boundary_day) * DAY
    cutoff = start_us + train_end_day * DAY
    known = df if label_column in df.columns else df.withColumn(label_column, label_available(F.col(at), embargo_days))
    window = label_embargo(known.filter(F.col(at) < boundary), cutoff, label_column)
    train, validation = positional_cut(window, at, tie, 1 - validation_fraction)
    return {"train": train.select(*df.columns), "validation": validation.select(*df.columns),
            "test": df.filter(F.col(at) >= boundary)}


def three_way_partition(train: DataFrame, later: DataFrame, at: str, tie: str, fraction: float = 0.6) -> DataFrame:
    """Rows tagged ``part``: calib (first 60 % of train), floor (the rest), blind (later)."""
    calib, floor = positional_cut(train, at, tie, fraction)
    tagged = [p.withColumn("part", F.lit(n)) for n, p in (("calib", calib), ("floor", floor), ("blind", later))]
    return tagged[0].unionByName(tagged[1]).unionByName(tagged[2])


def partition_report(tagged: DataFrame, at: str) -> DataFrame:
    fraud = F.col("is_fraud").cast("int")
    return tagged.groupBy("part").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(fraud).cast("bigint").alias("frauds"), F.avg(fraud).alias("prevalence"),
        F.min(at).alias("first_us"), F.max(at).alias("last_us"))


def mark_last_fraction(entities: DataFrame, key: str, fraction: float, name="in_cohort") -> DataFrame:
    """True for the last ``fraction`` of entities in key order."""
    first = entities.count() - int(entities.count() * fraction)
    edge = order_statistic(entities, key, key, first)
    return entities.withColumn(name, ~up_to(key, key, edge))


def blind_cohort(holders: DataFrame, key: str, flag: str, bindings: Mapping[str, Sequence[str]]) -> DataFrame:
    """(kind, id): cohort holders plus every bound device or address nobody else uses.

    ``bindings`` maps a kind to the holder columns that carry its ids.
    """
    out = holders.filter(flag).select(F.lit("holder").alias("kind"), F.col(key).cast("string").alias("id")).distinct()
    for kind, columns in bindings.items():
        ids = holders.select(flag, F.explode(F.array(*[F.col(c).cast("string") for c in columns])).alias("id"))
        ids = ids.filter("id IS NOT NULL")
        own = ids.groupBy("id").agg(F.min(F.col(flag)).alias("_only"))
        out = out.unionByName(own.filter("_only").select(F.lit(kind).alias("kind"), "id"))
    return out


def route_holdout(df: DataFrame, vectors: Sequence, column="vector_id") -> tuple[DataFrame, DataFrame]:
    """(rows for the pool, rows of held-out vectors)."""
    held = F.coalesce(F.col(column).isin(list(vectors)), F.lit(False))
    return df.filter(~held), df.filter(held)


def entity_split(df: DataFrame, key: str, fraction: float, bucket: Column | None = None, buckets: int = 1000):
    """Disjoint parts by whole entity: (left, right)."""
    number = F.pmod(F.xxhash64(key), F.lit(buckets)) if bucket is None else bucket
    left = number < int(round(buckets * fraction))
    return df.filter(left), df.filter(~left)


def take_entities(df: DataFrame, key: str, target_rows: int, order: Column | None = None) -> DataFrame:
    """Whole entities in hash order until the row budget is met; the crossing one is kept."""
    sizes = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).withColumn(
        "_o", hash_order(key) if order is None else order)
    chosen = running_totals(sizes, [], "_o", {"_before": F.col("_n")}, tie=key).filter(F.col("_before") < target_rows)
    return df.join(chosen.select(key), key, "left_semi")


def evaluation_window(df: DataFrame, boundary_us: int, at="us") -> DataFrame:
    return df.filter((F.col(at) >= boundary_us) & ~F.col("is_fraud").cast("boolean"))


def prevalence(df: DataFrame, by: str = "rail") -> DataFrame:
    """Fraud share per value of ``by`` and, as the null row, overall."""
    return df.rollup(by).agg(F.avg(F.col("is_fraud").cast("int")).alias("prevalence"), F.count(F.lit(1)).alias("rows"))


def enforce_caps(
    df: DataFrame, caps: Mapping[str, float] = RAIL_CAPS, hard_cap: float = PREVALENCE_HARD_CAP, *,
    rail="rail", order="_order", tie="event_id", strict: bool = True,
) -> DataFrame:
    """Drop fraud rows, first in hash order, on rails above their cap, then on the whole.

    At most two rounds; strict raises if the whole is still above, lenient returns what two rounds leave. (A round keeps the
    hard cap's share of the rows before it, so that the share of those after it may lie just above.) Only counts and one cut point per
    rail reach the driver (rails are a fixed code list).
    """
    work = df if order in df.columns else df.withColumn(order, hash_order(tie))
    fraud = F.col("is_fraud").cast("boolean")
    for _ in range(SCALE_DOWN_ROUNDS):
        counts = {
            r[rail]: (r["n"], r["f"]) for r in
            work.groupBy(rail).agg(F.count(F.lit(1)).alias("n"), F.sum(fraud.cast("int")).alias("f")).collect()
        }
        limits = {k: caps.get(k, hard_cap) for k in counts}
        over = [k for k, (n, f) in counts.items() if n and f / n > limits[k]]
        rows, frauds = sum(n for n, _ in counts.values()), sum(f for _, f in counts.values())
        if not over and (not rows or frauds / rows <= hard_cap):
            break
        keep = F.lit(True)
        drops = {k: int(round(f * (1 - limits[k] / (f / n)))) for k, (n, f) in counts.items() if k in over}
        edges = order_statistics(work.filter(fraud & F.col(rail).isin(over)), rail, order, tie, drops) if over else {}
        for name, edge in edges.items():
            keep = keep & ~(fraud & (F.col(rail) == F.lit(name)) & up_to(order, tie, edge))
        rows, frauds = rows - sum(drops.values()), frauds - sum(drops.values())
        work = work.filter(keep)
        if rows and frauds / rows > hard_cap:
            edge = order_statistic(work.filter(fraud), order, tie, frauds - int(rows * hard_cap))
            work = work.filter(~(fraud & up_to(order, tie, edge)))
    if strict and (work.agg(F.avg(fraud.cast("int"))).first()[0] or 0.0) > hard_cap:
        raise ValueError("prevalence remains above the hard cap after scale-down")
    return work.select(*df.columns)


def campaign_budget(df: DataFrame, rail_name: str, rate: float, share: float, rail="rail") -> DataFrame:
    """One row: max(int(rows of the rail's budget group x rate x share), 1)."""
    group = BUDGET_GROUPS.get(rail_name, (rail_name,))
    volume = F.count(F.when(F.col(rail).isin(*group), 1))
    return df.agg(volume.alias("volume"),
                  F.greatest(F.floor(volume * F.lit(rate) * F.lit(share)), F.lit(1)).cast("bigint").alias("budget"))


def subsample_bursts(df: DataFrame, budget: int, at="us", tie="event_id", block=BURST_ROWS,
                     block_order=None) -> DataFrame:
    """Whole blocks of consecutive events in hash order of the block, then the first rows by
    time. ``block_order`` maps a block-number column to its order; default a hash.
    """
    rows = df.count()
    if rows <= budget:
        return df
    block_order = block_order or F.xxhash64
    blocks = math.ceil(rows / block)
    keep = max(math.ceil(budget / block), 1)
    numbers = df.sparkSession.range(blocks).withColumn("_o", block_order(F.col("id")))
    edge = order_statistic(numbers, "_o", "id", min(keep, blocks))
    ranked = rank_in_group(df, [], at, tie, "_rank").withColumn("id", F.floor((F.col("_rank") - 1) / block))
    chosen = ranked.withColumn("_o", block_order(F.col("id"))).filter(up_to("_o", "id", edge))
    return smallest(chosen.select(*df.columns), at, tie, budget)


def downsample_negatives(df: DataFrame, ratio: float, order="_order", tie="event_id") -> DataFrame:
    """All positives and ``round(positives x ratio)`` negatives, first in hash order."""
    work = df if order in df.columns else df.withColumn(order, hash_order(tie))
    positive = F.col("is_fraud").cast("boolean")
    wanted = int(round(work.filter(positive).count() * ratio))
    negatives = smallest(work.filter(~positive), order, tie, wanted)
    return work.filter(positive).unionByName(negatives).select(*df.columns)


def round_slice(at: Column, start_us: int, days: int, rounds: int) -> Column:
    """Index of the equal slice of the span the event falls in; null outside."""
    width = days * DAY // rounds
    index = F.floor((at - F.lit(start_us)) / F.lit(width)).cast("int")
    return F.when((index >= 0) & (index < rounds), index)


def balanced_sample(left: DataFrame, right: DataFrame, rows: int, order: str, tie: str):
    """Equal-sized parts of two tables, first in hash order."""
    size = min(rows, left.count(), right.count())
    return smallest(left, order, tie, size), smallest(right, order, tie, size)


def extend_pool(pool: DataFrame, events: DataFrame, campaigns: DataFrame, k: int, key="campaign_id",
                caps=RAIL_CAPS, hard_cap=PREVALENCE_HARD_CAP, **kw) -> DataFrame:
    """Pool plus the events of the k campaigns that evade most, capped again."""
    best = campaigns.orderBy(F.col("evasion").desc(), F.col(key)).limit(k).select(key)
    added = events.join(F.broadcast(best), key, "left_semi")  # k keys
    return enforce_caps(pool.unionByName(added, allowMissingColumns=True), caps, hard_cap, **kw)
