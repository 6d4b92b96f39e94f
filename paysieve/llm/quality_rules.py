"""Quality rules as a ledger: each rule is evaluated once into one bit of a mask beside its measurements; policies and
ablations are integer operations on the mask, so a new policy never reads a text again.

Rows are kept whole and in place: evaluation is one narrow pass without a shuffle, whatever the skew of sources.
Null and empty texts have no words, fail `few_words` and are rejected by every policy that contains it. Repeated rows
are evaluated alike. Columns of the input are left out of the ledger except the id; where rows are kept whole, the
measurements travel in one struct column whose name the input does not hold, so names cannot clash.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paysieve.llm import buffers as B

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct_words", "n_upper", "n_short_words")

#: Every rule by name, as a condition over the measurements that is true where the rule fails. The position is the bit.
RULES = (
    ("few_words", "n_words < 50"),
    ("repeated_trigrams", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "n_words > 0 AND 10 * n_symbols > 3 * n_words"),
    ("word_length", "n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 25 * n_words)"),
    ("duplicate_lines", "n_lines > 4 AND 2 * n_dup_lines > n_lines"),
    ("vocabulary", "n_words >= 50 AND n_distinct_words < 2 + n_words DIV 200"),
    ("shouting", "word_chars > 0 AND 2 * n_upper > word_chars"),
)
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}

#: Policies by version: a text is rejected if any of the named rules failed.
POLICIES = {
    "v1": ("few_words", "repeated_trigrams"),
    "v2": ("few_words", "repeated_trigrams", "symbols", "word_length", "duplicate_lines", "vocabulary", "shouting"),
}
CURRENT = "v2"
SYMBOLS = np.array([x in b"#*$%&|<>" for x in range(256)])


def _measured(batches, text: str = "text"):
    """Slices of the input with one array for each of MEASURES."""
    hasher = B.SpanHash(1)
    for batch in B.slices(batches, text):
        data, offsets = B.utf8(batch.column(batch.schema.get_field_index(text)))
        rows = batch.num_rows
        starts, ends = B.runs(B.NOT_WHITE[data], offsets)
        n_words = np.diff(np.searchsorted(starts, offsets))
        points = B.code_points(data)
        row_of = np.repeat(np.arange(rows), n_words)
        chars = points[ends] - points[starts]
        words = hasher.of_bytes(data, starts, ends)

        # words inside three-word windows that occur twice or more in the row
        grams = B.gram_hash(words, 3)
        where = np.flatnonzero(row_of[: len(grams)] == row_of[len(row_of) - len(grams):])
        twice = where[repeated(row_of[where], grams[where])]
        covered = np.zeros(len(words), bool)
        for j in range(3):
            covered[twice + j] = True

        # lines: split at line feeds, with the rest after the last one
        feeds = np.flatnonzero(data == 10)
        line_of = np.sort(np.concatenate([np.arange(rows), np.searchsorted(offsets, feeds, "right") - 1]), kind="stable")
        line_starts = np.sort(np.concatenate([offsets[:-1], feeds + 1]), kind="stable")
        last = np.append(line_of[1:] != line_of[:-1], True)
        line_ends = np.where(last, offsets[line_of + 1], np.append(line_starts[1:], 0) - 1)
        worded = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
        lines, of = hasher.of_bytes(data, line_starts, line_ends)[worded], line_of[worded]

        yield batch, (n_words, total(chars, row_of, rows), total(SYMBOLS[data], None, rows, offsets),
                      np.bincount(of, minlength=rows) - distinct(of, lines, rows), total(covered, row_of, rows),
                      np.bincount(line_of, minlength=rows), distinct(row_of, words, rows),
                      total((data >= 0x41) & (data <= 0x5A), None, rows, offsets), total(chars <= 2, row_of, rows))


def total(values, row_of, rows, offsets=None):
    """Sum of values by row, given the row of each or the offsets of rows."""
    if offsets is None:
        return np.bincount(row_of, weights=values, minlength=rows).astype(np.int64)
    sums = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def order_of(rows, values):
    return np.lexsort((values, rows))


def repeated(rows, values):
    """Where a (row, value) pair occurs more than once."""
    if len(values) < 2:
        return np.zeros(len(values), bool)
    order = order_of(rows, values)
    r, v = rows[order], values[order]
    same = (r[1:] == r[:-1]) & (v[1:] == v[:-1])
    out = np.zeros(len(values), bool)
    out[order] = np.append(same, False) | np.insert(same, 0, False)
    return out


def distinct(rows, values, n):
    """Number of distinct values in each row."""
    if not len(values):
        return np.zeros(n, np.int64)
    order = order_of(rows, values)
    r, v = rows[order], values[order]
    new = np.insert((r[1:] != r[:-1]) | (v[1:] != v[:-1]), 0, True)
    return np.bincount(r[new], minlength=n)


def _free_name(columns: list[str], name: str = "measured") -> str:
    """The name, made longer until no column has it."""
    taken = {c.lower() for c in columns}
    while name in taken:
        name += "_"
    return name


def _with_measures(docs: DataFrame, text: str) -> tuple[DataFrame, str]:
    """The rows with all measurements in one struct column, and that column's name."""
    name = _free_name(docs.columns)

    def run(batches):
        for batch, values in _measured(batches, text):
            packed = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in values], names=list(MEASURES))
            yield pa.RecordBatch.from_arrays([*batch.columns, packed], names=[*batch.schema.names, name])

    kind = T.StructType([T.StructField(m, T.LongType()) for m in MEASURES])
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, kind)])), name


def _mask(measured: str) -> Column:
    """All rules, each as one bit, over the measurements in a struct column."""
    mask = F.lit(0)
    for name, condition in RULES:
        fails = F.expr(re.sub(r"\b(" + "|".join(MEASURES) + r")\b", rf"`{measured}`.\1", condition))
        mask = mask + F.when(fails, F.lit(BIT[name])).otherwise(F.lit(0))
    return mask.cast("int")


def ledger(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per document: id, measurements, and `failed`, the mask of rules that fail."""
    out, measured = _with_measures(docs.select(F.col(key), F.col(text)), text)
    return out.select(F.col(key), f"`{measured}`.*", _mask(measured).alias("failed"))


def policy_mask(version: str) -> int:
    return sum(BIT[name] for name in POLICIES[version])


def passes(version: str = CURRENT) -> Column:
    """True where no rule of the policy failed."""
    return F.col("failed").bitwiseAND(F.lit(policy_mask(version))) == 0


def ablations(entries: DataFrame, version: str = CURRENT) -> DataFrame:
    """For every rule of a policy: failing rows, rows only this rule rejects, and rows kept without it.

    One aggregate over the masks; the texts are not read again.
    """
    mask, names = policy_mask(version), POLICIES[version]
    hit = F.col("failed").bitwiseAND(F.lit(mask))
    sums = entries.groupBy(hit.alias("hit")).agg(F.count("*").alias("n"))  # at most 2 ** rules rows
    rules = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(BIT[n]).alias("bit")) for n in names]))
    rows = sums.select("hit", "n", rules.alias("r")).select("hit", "n", "r.rule", "r.bit")

    def counted(where: Column) -> Column:
        return F.sum(F.when(where, F.col("n")).otherwise(0))

    hits, bit = F.col("hit"), F.col("bit")
    return rows.groupBy("rule").agg(counted(hits.bitwiseAND(bit) != 0).alias("failing"), counted(hits == bit).alias("only_this"),
                                    counted(hits.bitwiseAND(F.lit(mask) - bit) == 0).alias("kept_without"))


def keep(docs: DataFrame, text: str = "text", version: str = CURRENT) -> DataFrame:
    """The input rows that a policy accepts, with their own columns, measured in place without a join."""
    out, measured = _with_measures(docs, text)
    accepted = _mask(measured).bitwiseAND(F.lit(policy_mask(version))) == 0
    return out.filter(accepted).select(*[F.col(f"`{c}`") for c in docs.columns])
