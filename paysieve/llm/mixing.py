"""Mixing sources to target weights, with exact budgets in words.

Every document gets a hash-random key. The keys of a source are uniform, so equal ranges of the key hold equal shares of
it: a source is cut into ranges of about RANGE_ROWS rows, each range is sorted by one task, and prefix sums of sizes are
carried from range to range over a table with one row per range. A source whose target exceeds its size is repeated for
whole epochs first; the rest of its budget is cut out of the sorted order to the word, the last document in part.

Targets share all words by weight; a target stops at MOST times its source's size and the excess is shared again among the
others by weight, which is solved in one step: with sources sorted by MOST * size / weight, those that stop are a prefix.
That table has a row per source, a number fixed by the corpus's make-up; documents only join it.

Texts are read once: ids, sources, sizes and keys are written to the shared folder, and all else works on these small rows.

A hot source only has more ranges. Null texts have no words; documents without words take nothing. Null sources are one
source, the last by order. Repeated rows are documents of their own. An id or a source of any name or type will do; other
columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paysieve.plans.durable import scratch_path

WEIGHTS = (1, 2, 3)
MOST = 3
RANGE_ROWS = 4_000
SEED = "mix-1"
WORD = r"[^\x20\x09-\x0D]+"
KEY_BITS = 60


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def random_key(key: Column, seed: str = SEED) -> Column:
    """The first 60 bits of a digest of the id: the same in every run, on every engine."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit("")))), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, n_docs, target) from (source, source_size, n_docs): one row per source in, one out."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    one = F.lit(1)
    placed = sizes.withColumn("weight", F.element_at(cycle, (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")))
    cap = F.col("source_size") * F.lit(float(most))
    by_ratio = Window.orderBy(cap / F.col("weight"), F.col("source").asc_nulls_last())
    rest = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    all_rows = Window.partitionBy(one)
    levels = (placed.withColumn("cap", cap)
              .withColumn("level", (F.sum("source_size").over(all_rows) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest)))
    # the first source, by ratio, that its share does not fill; all before it stop at their cap
    free = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), F.col("level").alias("level")))).over(all_rows)
    target = F.least(F.col("cap"), free["level"] * F.col("weight"))
    return levels.select("source", "source_size", "n_docs", F.coalesce(target, F.lit(0.0)).alias("target"))


def mix(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source", weights: tuple[int, ...] = WEIGHTS,
        most: int = MOST, seed: str = SEED, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Per input row: id, source, size, source_size, target of its source, `taken` words, and `epochs`, whole repeats."""
    rows = docs.select(F.col(key).alias("id"), F.col(source).cast("string").alias("source"), word_count(F.col(text).cast("string")).alias("size"))
    rows, path = rows.withColumn("k", random_key(F.col("id"), seed)), scratch_path(docs.sparkSession, "sizes")
    rows.write.parquet(path)
    rows = docs.sparkSession.read.schema(rows.schema).parquet(path)
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    targets = source_targets(sizes, weights, most).withColumnRenamed("source", "s")
    out = rows.join(targets, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    ranges = F.ceil(F.col("n_docs") / range_rows)
    out = out.withColumn("range", F.floor(F.col("k") / F.lit(float(1 << KEY_BITS)) * ranges).cast("long"))

    offsets = out.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    earlier = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    offsets = offsets.select(F.col("source").alias("s"), F.col("range").alias("r"), F.coalesce(F.sum("range_size").over(earlier), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("source", "range").orderBy("k", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = out.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = placed.join(offsets, F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("r")))
    budget = F.floor("target").cast("long")
    whole = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    rest = budget - whole * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("offset") - F.col("before")))
    return placed.select(F.col("id").alias(key), F.col("source").alias(source), "size", "source_size", "target",
                         (whole * F.col("size") + part).cast("long").alias("taken"), whole.alias("epochs"))
