"""Line dedup over levelled sorted runs of line hashes, in DataFrame operations only.

Documents come in batches, from the largest ids down. A batch gives one row per line key: in how many of its documents the
key occurs and the largest of their ids. The runs already written are merge-anti-joined: keys that no run holds are new,
and the batch's largest id is their keeper; keys that a run holds already have a keeper with a larger id, and only add to
the count. The batch's rows become a new sorted run of level 0; FANOUT runs of one level are compacted into one of the
next, so a key is rewritten a number of times that is logarithmic in the batches. At the end a last compaction gives, for
every key, count and keeper, and keys of enough documents take their lines from all documents but the keeper.

Runs are tables bucketed and sorted by key, in the shared folder, so the joins between a batch and the runs shuffle only
the batch. A very common line is one row per document after the distinct lines of each document, and one per task after
partial counts. Documents themselves are shuffled once, by id, to meet the positions of their dropped lines.

Null and empty texts are one empty line. Rows that share an id are one document when documents are counted; a row without
an id counts as the one document of the smallest id. Lines of equal rows get equal results. Ids are whole numbers. Only id
and text are read; the other columns travel packed in one struct, so their names cannot clash, and come back unchanged.
Runs are managed tables and dropped as soon as the dropped keys are written.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paysieve.plans.durable import scratch_path

SHORTEST = 40  # code points of a key that counts
COPIES = 5  # documents that must hold it
BATCHES = 4
FANOUT = 2
WHITE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_ID = -(1 << 63)


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(WHITE)), UPPER, LOWER)


def _hash(key: Column) -> Column:
    return F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("second"), key).alias("h2"))


class Runs:
    """Sorted runs of (h1, h2, n, keeper) by level."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT):
        self.spark, self.fanout, self.levels = spark, fanout, {}
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def _write(self, rows: DataFrame) -> str:
        name = f"run_{uuid.uuid4().hex}"
        rows.repartition(self.buckets, "h1").write.bucketBy(self.buckets, "h1").sortBy("h1", "h2").saveAsTable(name)
        return name

    def _place(self, name: str, level: int) -> None:
        held = self.levels.setdefault(level, [])
        held.append(name)
        if len(held) == self.fanout:
            self.levels[level] = []
            self._place(self._write(self.merged(held)), level + 1)
            self._drop(held)

    def _drop(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name} PURGE")

    def close(self) -> None:
        self._drop(self.names())
        self.levels = {}

    def names(self) -> list[str]:
        return [n for held in self.levels.values() for n in held]

    def merged(self, names: list[str]) -> DataFrame:
        rows = self.spark.table(names[0])
        for name in names[1:]:
            rows = rows.unionByName(self.spark.table(name))
        return rows.groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.max("keeper").alias("keeper"))

    def add(self, batch: DataFrame) -> None:
        """batch: (h1, h2, n, last), of ids below all that came before."""
        fresh, known = batch, self.names()
        for name in known:
            fresh = fresh.join(self.spark.table(name).select("h1", "h2"), ["h1", "h2"], "left_anti")
        rows = fresh.select("h1", "h2", "n", F.col("last").alias("keeper"))
        if known:
            held = self.merged(known).select("h1", "h2")
            rows = rows.unionByName(batch.join(held, ["h1", "h2"], "left_semi").select("h1", "h2", "n", F.lit(None).cast("long").alias("keeper")))
        self._place(self._write(rows), 0)

    def result(self, copies: int) -> DataFrame:
        """(h1, h2, keeper) of the keys that enough documents hold."""
        return self.merged(self.names()).filter(F.col("n") >= copies).select("h1", "h2", "keeper")


def _cuts(docs: DataFrame, batches: int) -> list:
    """Ids that bound the batches; one number each goes to the driver."""
    shares = [i / batches for i in range(1, batches)]
    found = docs.agg(F.percentile_approx("rank_id", shares, 1000).alias("q")).first()["q"] if shares else []
    return sorted(set(found or []), reverse=True)


def dropped_keys(docs: DataFrame, text: str = "text", key: str = "doc_id", shortest: int = SHORTEST, copies: int = COPIES,
                 batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """(rank_id, gone): the keys that a document loses, for the documents that lose any. Ids are whole numbers."""
    spark = docs.sparkSession
    lines = F.split(F.coalesce(F.col(text).cast("string"), F.lit("")), "\n", -1)
    keys = F.filter(F.transform(lines, line_key), lambda k: F.length(k) >= shortest)
    per_doc = docs.select(_rank(key).alias("rank_id"), F.explode(F.array_distinct(F.transform(keys, _hash))).alias("k"))
    path = scratch_path(spark, "keys")
    per_doc.select("rank_id", "k.h1", "k.h2").write.parquet(path)
    per_doc = spark.read.parquet(path)

    runs, upper, path = Runs(spark, fanout), None, scratch_path(spark, "gone")
    try:
        for cut in [*_cuts(per_doc, batches), None]:
            part = per_doc
            if upper is not None:
                part = part.filter(F.col("rank_id") < upper)
            if cut is not None:
                part = part.filter(F.col("rank_id") >= cut)
            once = part.groupBy("h1", "h2", "rank_id").agg(F.lit(1).alias("one"))
            runs.add(once.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("rank_id").alias("last")))
            upper = cut

        hits = per_doc.join(runs.result(copies), ["h1", "h2"]).filter("rank_id <> keeper")
        hits = hits.groupBy("rank_id").agg(F.collect_set(F.struct("h1", "h2")).alias("gone"))  # at most the distinct lines of one document
        hits.write.parquet(path)
    finally:
        runs.close()
    return spark.read.schema(hits.schema).parquet(path)


def _rank(key: str) -> Column:
    return F.coalesce(F.col(key).cast("long"), F.lit(LEAST_ID))


def _judged(docs: DataFrame, text: str, key: str, **options) -> DataFrame:
    """(row, lines, kept, gone): the input row as a struct, arrays of lines, and null in gone where nothing goes."""
    hits = dropped_keys(docs, text, key, **options)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), _rank(key).alias("id"), F.split(F.coalesce(F.col(text).cast("string"), F.lit("")), "\n", -1).alias("lines"))
    rows = rows.join(hits.hint("merge"), F.col("id") == F.col("rank_id"), "left")  # the same plan at every size
    keyed = F.transform("lines", lambda x: F.struct(x.alias("line"), line_key(x).alias("k")))
    stays = F.filter(keyed, lambda x: (F.length(x["k"]) < options.get("shortest", SHORTEST)) | ~F.array_contains("gone", _hash(x["k"])))
    return rows.withColumn("kept", F.when(F.col("gone").isNull(), F.col("lines")).otherwise(F.transform(stays, lambda x: x["line"])))


def dedup(docs: DataFrame, text: str = "text", key: str = "doc_id", **options) -> DataFrame:
    """Per input row: id, n_lines, n_dropped and `kept`, the lines left joined by line feeds."""
    rows = _judged(docs.select(key, text), text, key, **options)
    return rows.select(F.col("row").getField(key).alias(key), F.size("lines").cast("long").alias("n_lines"),
                       (F.size("lines") - F.size("kept")).cast("long").alias("n_dropped"), F.array_join("kept", "\n").alias("kept"))


def cleaned(docs: DataFrame, text: str = "text", key: str = "doc_id", length: str | None = None, **options) -> DataFrame:
    """The input with the lines left as its text, and the code points of a changed text in the column `length`, if any."""
    rows = _judged(docs, text, key, **options)
    changed = F.col("gone").isNotNull()
    old = {c: F.col("row").getField(c) for c in docs.columns}
    new = F.array_join("kept", "\n")
    own = {text: F.when(changed, new).otherwise(old[text])}
    if length:
        own[length] = F.when(changed, F.length(new)).otherwise(old[length]).cast(docs.schema[length].dataType)
    return rows.select(*[own.get(c, old[c]).alias(c) for c in docs.columns])
