"""Ordered scans (running totals, previous row, rank) that also hold for hot groups.

A hot group is cut into consecutive slices of its order column. Each slice is scanned by one
task; slice totals are carried forward over a table with one row per (group, slice).
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paysieve.plans.durable import durable
from paysieve.plans.skew import CHUNK, Layout, join_on_keys, plan_layout, with_chunks

_WHOLE = ("byte", "short", "integer", "long")


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    at: str,
    sums: Mapping[str, Column],
    *,
    tie: str | None = None,
    layout: Layout | None = None,
) -> DataFrame:
    """Per row, each sum over the rows of its group that come strictly before it.

    Without ``tie`` rows with an equal ``at`` do not see each other; with ``tie`` they are
    ordered by it. Empty sums are 0.
    """
    layout = layout or plan_layout(df, keys, F.col(at))
    placed = with_chunks(df, keys, F.col(at), layout)
    base = Window.partitionBy(*keys, CHUNK)
    zero = F.lit(0)
    if tie is not None:
        frame = base.orderBy(at, tie).rowsBetween(Window.unboundedPreceding, -1)
        before = {n: F.coalesce(F.sum(e).over(frame), zero) for n, e in sums.items()}
    elif df.schema[at].dataType.typeName() in _WHOLE:
        frame = base.orderBy(at).rangeBetween(Window.unboundedPreceding, -1)
        before = {n: F.coalesce(F.sum(e).over(frame), zero) for n, e in sums.items()}
    else:  # a range offset is a distance, so leave out equal values by subtraction
        upto = base.orderBy(at).rangeBetween(Window.unboundedPreceding, Window.currentRow)
        peers = base.orderBy(at).rangeBetween(Window.currentRow, Window.currentRow)
        before = {
            n: F.coalesce(F.sum(e).over(upto), zero) - F.coalesce(F.sum(e).over(peers), zero) for n, e in sums.items()
        }
    scanned = placed.select("*", *[e.alias(n) for n, e in before.items()])
    if not layout.spread:
        return scanned.drop(CHUNK)
    totals = placed.filter(F.col(CHUNK) > 0).groupBy(*keys, CHUNK).agg(
        *[F.sum(e).alias(n) for n, e in sums.items()]
    )
    before = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(*keys, CHUNK, *[F.sum(n).over(before).alias(f"_c_{n}") for n in sums])
    joined = join_on_keys(scanned, carry, [*keys, CHUNK])
    kept = [c for c in scanned.columns if c not in sums and c != CHUNK]
    return joined.select(
        *kept, *[(F.col(n) + F.coalesce(f"_c_{n}", F.lit(0))).alias(n) for n in sums]
    )


def running_stats(
    df: DataFrame, keys: Sequence[str], at: str, columns: Sequence[str], *, layout: Layout | None = None,
) -> DataFrame:
    """Adds ``_n_c, _mean_c, _max_c, _m2_c`` per column: count, mean, maximum and sum of squared deviations over the
    group's rows with a strictly smaller ``at``; null (count 0) where there is none.

    A maximum cannot be taken back by subtraction, so slices of hot groups carry maxima of all slices before them beside
    sums; the sums are of values less the column's mean, which keeps deviations exact where values are far from 0.
    """
    layout = layout or plan_layout(df, keys, F.col(at))
    placed = with_chunks(df, keys, F.col(at), layout)
    if df.schema[at].dataType.typeName() not in _WHOLE:
        raise ValueError(f"{at} must be a whole number")
    frame = Window.partitionBy(*keys, CHUNK).orderBy(at).rangeBetween(Window.unboundedPreceding, -1)

    if not layout.spread:
        over = {n: e for c in columns for n, e in {
            f"_n_{c}": F.count(c).over(frame), f"_mean_{c}": F.avg(c).over(frame), f"_max_{c}": F.max(c).over(frame),
            f"_m2_{c}": F.var_pop(c).over(frame) * F.count(c).over(frame)}.items()}
        return placed.select("*", *[e.alias(n) for n, e in over.items()]).drop(CHUNK)

    middle = df.agg(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in columns]).first()
    inside = placed.select("*", *[
        x for c in columns for x in (
            F.count(c).over(frame).alias(f"_n_{c}"), F.max(c).over(frame).alias(f"_max_{c}"),
            F.sum(F.col(c) - middle[c]).over(frame).alias(f"_s_{c}"), F.sum(F.pow(F.col(c) - middle[c], 2)).over(frame).alias(f"_q_{c}"))])
    totals = placed.filter(F.col(CHUNK) > 0).groupBy(*keys, CHUNK).agg(*[
        x for c in columns for x in (
            F.count(c).alias(f"_n_{c}"), F.max(c).alias(f"_max_{c}"), F.sum(F.col(c) - middle[c]).alias(f"_s_{c}"),
            F.sum(F.pow(F.col(c) - middle[c], 2)).alias(f"_q_{c}"))])
    earlier = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(*keys, CHUNK, *[
        (F.max if p == "max" else F.sum)(f"_{p}_{c}").over(earlier).alias(f"_c_{p}_{c}") for c in columns for p in ("n", "max", "s", "q")])
    joined = join_on_keys(inside, carry, [*keys, CHUNK])
    zero = F.lit(0.0)

    def final(c):
        n = F.col(f"_n_{c}") + F.coalesce(f"_c_n_{c}", F.lit(0))
        s, q = (F.coalesce(f"_{p}_{c}", zero) + F.coalesce(f"_c_{p}_{c}", zero) for p in "sq")
        return [n.alias(f"_n_{c}"), F.when(n > 0, middle[c] + s / n).alias(f"_mean_{c}"), F.greatest(f"_max_{c}", f"_c_max_{c}").alias(f"_max_{c}"),
                F.when(n > 0, F.greatest(q - s * s / n, zero)).alias(f"_m2_{c}")]

    return joined.select(*df.columns, *[x for c in columns for x in final(c)])


def rank_in_group(
    df: DataFrame,
    keys: Sequence[str],
    at: str,
    tie: str,
    name: str = "rank",
    layout: Layout | None = None,
) -> DataFrame:
    """1-based position by (at, tie) inside each group; no keys ranks the whole table."""
    ranked = running_totals(
        df, keys, at, {name: F.lit(1).cast("bigint")}, tie=tie, layout=layout
    )
    return ranked.withColumn(name, F.col(name) + 1)


def previous_row(
    df: DataFrame,
    keys: Sequence[str],
    at: str,
    tie: str,
    columns: Mapping[str, Column],
    *,
    descending: bool = False,
    layout: Layout | None = None,
) -> DataFrame:
    """Values of the preceding row (or the following one) of the group; null on the first."""
    layout = layout or plan_layout(df, keys, F.col(at))
    placed = with_chunks(df, keys, F.col(at), layout).withColumn(
        "_here", F.struct(*[e.alias(n) for n, e in columns.items()])
    )
    order = [F.col(at).desc(), F.col(tie).desc()] if descending else [F.col(at), F.col(tie)]
    frame = Window.partitionBy(*keys, CHUNK).orderBy(*order)
    moved = placed.withColumn("_prev", F.lag("_here").over(frame))
    if layout.spread:
        pick = F.min_by if descending else F.max_by
        last = placed.filter(F.col(CHUNK) > 0).groupBy(*keys, CHUNK).agg(
            pick("_here", F.struct(at, tie)).alias("_edge")
        )
        chunk_order = F.col(CHUNK).desc() if descending else F.col(CHUNK)
        carry = last.select(
            *keys, CHUNK, F.lag("_edge").over(Window.partitionBy(*keys).orderBy(chunk_order)).alias("_carry")
        )
        moved = join_on_keys(moved, carry, [*keys, CHUNK]).withColumn(
            "_prev", F.coalesce("_prev", "_carry")
        )
    return moved.select(
        *df.columns, *[F.col("_prev").getField(n).alias(n) for n in columns]
    )


def order_statistic(df: DataFrame, at: str, tie: str, position: int | Callable[[int], int]) -> tuple | None:
    """(at, tie) of the row at 1-based ``position`` in (at, tie) order; None when out of range.

    Works on counts per distinct value, so wide rows never move and no task sees the table. The position may be a
    function of the number of rows, which the counts tell without another scan.
    """
    if not callable(position) and position < 1:
        return None
    counts = df.groupBy(at).agg(F.count(F.lit(1)).alias("_n"))
    if callable(position):
        counts = durable(counts)
        position = position(counts.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0])
        if position < 1:
            return None
    edge = (
        running_totals(counts, [], at, {"_before": F.col("_n")})
        .filter((F.col("_before") < position) & (F.col("_before") + F.col("_n") >= position))
        .select(at, "_before", "_n")
        .first()
    )
    if edge is None:
        return None
    tied = df.filter(F.col(at) == F.lit(edge[at]))
    if edge["_n"] == 1:
        return edge[at], tied.select(tie).first()[tie]
    inner = rank_in_group(tied.select(tie), [], tie, tie, "_r").filter(
        F.col("_r") == position - edge["_before"]
    )
    return edge[at], inner.first()[tie]


def order_statistics(df: DataFrame, key: str, at: str, tie: str, positions: Mapping) -> dict:
    """{key value: (at, tie) of its row at the given 1-based position}, for a short list of
    key values, in one pass over the (key, at, tie) columns.
    """
    wanted = {k: p for k, p in positions.items() if p >= 1}
    if not wanted:
        return {}
    table = F.create_map(*[F.lit(x) for item in wanted.items() for x in item])
    ranked = rank_in_group(df.select(key, at, tie), [key], at, tie, "_rank")
    found = ranked.filter(F.col("_rank") == F.element_at(table, F.col(key))).collect()  # one row per key value
    return {r[key]: (r[at], r[tie]) for r in found}


def up_to(at: str, tie: str, edge: tuple | None) -> Column:
    """Filter: rows at or before an order statistic. Two literals, so it reaches the scan."""
    if edge is None:
        return F.lit(False)
    return (F.col(at) < F.lit(edge[0])) | ((F.col(at) == F.lit(edge[0])) & (F.col(tie) <= F.lit(edge[1])))


def first_rows(
    df: DataFrame,
    keys: Sequence[str],
    at: str,
    tie: str,
    name: str = "is_first",
    layout: Layout | None = None,
) -> DataFrame:
    """1 on the earliest row of each group by (at, tie), else 0."""
    seen = previous_row(df, keys, at, tie, {"_seen": F.lit(1)}, layout=layout)
    return seen.withColumn(name, F.col("_seen").isNull().cast("int")).drop("_seen")
