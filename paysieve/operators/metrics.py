"""Evaluation of scores: ranking quality, calibration and cost.

All curve metrics first count labels per distinct score (map-side combine), then take running
totals over the distinct scores. Rows are never ranked one by one.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paysieve.plans.scan import order_statistic, running_totals, up_to

MIN_BIN_COUNT = 30
GRID = 1000  # thresholds are 1/1000 .. 999/1000
TOP_FRACTION_PER_MILLE = 1
MIN_PRECISION = 0.95
RECALL_BAR = 0.6
GRAPH_LIFT_BAR = 0.03
COST_PER = 100_000


@dataclass(frozen=True)
class CostMatrix:
    # Amounts of the cost model.
    chargeback_fee: float = 25.0
    merchant_margin: float = 0.22
    p_attrition: float = 0.32
    customer_ltv: float = 1800.0
    # End of fixed values.


def _by_score(df: DataFrame, keys: Sequence[str], label: str, score: str, rows: str | None = None) -> DataFrame:
    one = F.lit(1).cast("bigint") if rows is None else F.col(rows)
    return df.groupBy(*keys, (-F.col(score)).alias("_neg")).agg(
        F.sum(F.col(label).cast("bigint") * one).alias("_pos"), F.sum(one).alias("_n")
    )


def _curve(df: DataFrame, keys: Sequence[str], label: str, score: str, rows: str | None = None) -> DataFrame:
    """Per distinct score, highest first: counts at the score and counts above it."""
    return running_totals(
        _by_score(df, keys, label, score, rows), keys, "_neg", {"_pos_above": F.col("_pos"), "_n_above": F.col("_n")},
        tie="_neg",
    )


def _precision() -> Column:
    return (F.col("_pos_above") + F.col("_pos")) / (F.col("_n_above") + F.col("_n"))


def _ap() -> Column:
    return F.try_divide(F.sum(F.col("_pos") * _precision()), F.sum("_pos"))


def _auc() -> Column:
    negatives = F.col("_n") - F.col("_pos")
    ahead = (F.col("_pos_above") + F.col("_pos") / 2.0) * negatives
    return F.try_divide(F.sum(ahead), F.sum("_pos").cast("double") * F.sum(negatives).cast("double"))


def average_precision(df, label="is_fraud", score="score", keys: Sequence[str] = (), rows: str | None = None) -> DataFrame:
    """One row (per key): sum of recall step x precision over distinct scores, null without positives; a row may stand for several."""
    return _curve(df, list(keys), label, score, rows).groupBy(*keys).agg(_ap().alias("average_precision"))


def roc_auc(df, label="is_fraud", score="score", keys: Sequence[str] = ()) -> DataFrame:
    """Chance that a positive outranks a negative, ties counting half."""
    return _curve(df, list(keys), label, score).groupBy(*keys).agg(_auc().alias("roc_auc"))


def ranking_summary(df, label="is_fraud", score="score", keys: Sequence[str] = ()) -> DataFrame:
    """Average precision, ROC AUC and the best recall at 95 % precision from one scan."""
    recall = F.max(F.when(_precision() >= MIN_PRECISION, F.col("_pos_above") + F.col("_pos")))
    return _curve(df, list(keys), label, score).groupBy(*keys).agg(
        _ap().alias("average_precision"), _auc().alias("roc_auc"),
        F.coalesce(F.try_divide(recall, F.sum("_pos")), F.lit(0.0)).alias("recall_at_precision"))


def precision_at_k(df, label="is_fraud", score="score", tie="event_id", k: int | None = None) -> DataFrame:
    """Share of positives among the k highest scores; default the top per mille, at least one."""
    if k is None:
        k = max(df.count() * TOP_FRACTION_PER_MILLE // 1000, 1)
    ordered = df.withColumn("_neg", -F.col(score))
    edge = order_statistic(ordered, "_neg", tie, k)
    top = ordered if edge is None else ordered.filter(up_to("_neg", tie, edge))
    return top.agg(F.avg(F.col(label).cast("int")).alias("precision_at_k"), F.count(F.lit(1)).alias("k"))


def _flagged(score: str, threshold: float) -> Column:
    return F.col(score) >= F.lit(threshold)


def confusion(df, threshold: float, label="is_fraud", score="score") -> DataFrame:
    """TP, FP, FN, TN, precision, recall and FP per TP (infinite without a TP)."""
    positive, flagged = F.col(label).cast("int") == 1, _flagged(score, threshold)
    counts = df.agg(
        F.count_if(positive & flagged).alias("tp"), F.count_if(~positive & flagged).alias("fp"),
        F.count_if(positive & ~flagged).alias("fn"), F.count_if(~positive & ~flagged).alias("tn"))
    zero = F.lit(0.0)
    return counts.select(
        "*", F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fp")), zero).alias("precision"),
        F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fn")), zero).alias("recall"),
        F.coalesce(F.try_divide("fp", "tp"), F.lit(float("inf"))).alias("fp_tp_ratio"))


def flag_rates(df, threshold: float, label="is_fraud", score="score") -> DataFrame:
    """False-positive share of legitimate rows and missed share of fraud rows."""
    positive, flagged = F.col(label).cast("int") == 1, _flagged(score, threshold).cast("int")
    return df.agg(F.avg(F.when(~positive, flagged)).alias("fpr"), F.avg(F.when(positive, 1 - flagged)).alias("evasion"))


def recall_by(df, key: str, threshold: float, label="is_fraud", score="score") -> DataFrame:
    """Recall and evasion of each group of fraud rows (campaign, vector, ...)."""
    flagged = _flagged(score, threshold).cast("int")
    return df.filter(F.col(label).cast("int") == 1).groupBy(key).agg(
        F.count(F.lit(1)).alias("rows"), F.avg(flagged).alias("recall"), F.avg(1 - flagged).alias("evasion"))


def average_precision_by_vector(df, key: str, label="is_fraud", score="score") -> DataFrame:
    """Average precision of each vector's rows against all legitimate rows.

    The legitimate running count per score is computed once and joined by score, instead of
    pairing every vector with every legitimate row.
    """
    neg = (-F.col(score)).alias("_neg")
    positive = F.col(label).cast("int") == 1
    legit = running_totals(
        df.groupBy(neg).agg(F.sum(F.when(positive, 0).otherwise(1)).cast("bigint").alias("_l")), [], "_neg",
        {"_l_above": F.col("_l")}, tie="_neg")
    own = df.filter(positive & F.col(key).isNotNull()).groupBy(key, neg).agg(F.count(F.lit(1)).alias("_pos"))
    joined = running_totals(own.join(legit, "_neg"), [key], "_neg", {"_pos_above": F.col("_pos")}, tie="_neg")
    hits = F.col("_pos_above") + F.col("_pos")
    precision = hits / (hits + F.col("_l_above") + F.col("_l"))
    return joined.groupBy(key).agg((F.sum(F.col("_pos") * precision) / F.sum("_pos")).alias("average_precision"))


def reliability_curve(df, bins: int = 10, label="is_fraud", score="score", keys: Sequence[str] = ()) -> DataFrame:
    """Equal-width bins with mean prediction, observed rate and count; empty bins are absent."""
    number = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("int")
    return df.groupBy(*keys, number.alias("bin")).agg(
        F.avg(score).alias("mean_predicted"), F.avg(F.col(label).cast("int")).alias("observed_rate"),
        F.count(F.lit(1)).alias("n"))


def curve_error(curve: DataFrame, keys: Sequence[str] = (), min_count: int = MIN_BIN_COUNT) -> DataFrame:
    """Count-weighted error and the worst gap among bins with enough rows (null if none)."""
    gap = F.abs(F.col("mean_predicted") - F.col("observed_rate"))
    return curve.groupBy(*keys).agg(
        F.try_divide(F.sum(gap * F.col("n")), F.sum("n")).alias("ece"),
        F.max(F.when(F.col("n") >= min_count, gap)).alias("worst_bin"))


def brier_and_saturation(df, label="is_fraud", score="score", keys: Sequence[str] = ()) -> DataFrame:
    miss = F.col(score) - F.col(label).cast("int")
    pinned = ((F.col(score) <= 0) | (F.col(score) >= 1)).cast("int")
    return df.groupBy(*keys).agg(F.avg(miss * miss).alias("brier"), F.avg(pinned).alias("saturated"))


def calibration(df, bins: int = 10, label="is_fraud", score="score", keys: Sequence[str] = ()) -> DataFrame:
    """ece, worst_bin, brier and saturated share (per key) in one table."""
    by, rows = list(keys), df
    if not by:
        by, rows = ["_all"], df.withColumn("_all", F.lit(0))
    errors = curve_error(reliability_curve(rows, bins, label, score, by), by)
    return errors.join(brier_and_saturation(rows, label, score, by), by).drop("_all")


# --- cost ------------------------------------------------------------------------------

def _miss_cents(cents: Column, m: CostMatrix) -> Column:
    """Cost of missing a fraud, in 1/100 cents so that the margin share stays an integer."""
    return (cents + int(round(m.chargeback_fee * 100))) * 100


def _false_alarm_cents(cents: Column, m: CostMatrix) -> Column:
    return cents * int(round(m.merchant_margin * 100)) + int(round(m.p_attrition * m.customer_ltv * 10_000))


def _cost_columns(df, label, cents, m):
    positive = F.col(label).cast("int") == 1
    return (F.when(positive, _miss_cents(F.col(cents), m)).otherwise(0).alias("_miss"),
            F.when(positive, 0).otherwise(_false_alarm_cents(F.col(cents), m)).alias("_alarm"))


def expected_cost(df, threshold: float, label="is_fraud", score="score", cents="amount_c", matrix=CostMatrix()):
    """One row: cost at the threshold and per 100,000 events, in currency units."""
    miss, alarm = _cost_columns(df, label, cents, matrix)
    staged = df.select(F.col(score).alias("_s"), miss, alarm)
    total = F.sum(F.when(F.col("_s") >= threshold, F.col("_alarm")).otherwise(F.col("_miss"))) / 10_000
    return staged.agg(total.alias("cost"), (total / F.count(F.lit(1)) * COST_PER).alias("cost_per_100k"))


def cost_curve(df, label="is_fraud", score="score", cents="amount_c", matrix=CostMatrix()) -> DataFrame:
    """(threshold_no, cost, tp, fp, fn) for the 999 thresholds k/1000.

    Each score falls into the grid once; the curve is two running sums over 1,000 buckets.
    """
    miss, alarm = _cost_columns(df, label, cents, matrix)
    s = F.col(score)
    guess = F.floor(s * GRID)
    met = (
        F.when((guess + 1) / float(GRID) <= s, guess + 1).when(guess / float(GRID) > s, guess - 1).otherwise(guess)
    )
    level = F.greatest(F.least(met, F.lit(GRID - 1)), F.lit(0)).cast("bigint")  # thresholds reached
    per_level = df.select(level.alias("level"), miss, alarm, F.col(label).cast("bigint").alias("_y")).groupBy(
        "level").agg(F.sum("_miss").alias("_miss"), F.sum("_alarm").alias("_alarm"), F.sum("_y").alias("_p"),
                     F.count(F.lit(1)).alias("_n"))
    grid = df.sparkSession.range(GRID).withColumnRenamed("id", "level")
    full = grid.join(per_level, "level", "left").fillna(0)
    below = Window.partitionBy().orderBy("level").rowsBetween(Window.unboundedPreceding, -1)  # 1,000 rows
    above = Window.partitionBy().orderBy("level").rowsBetween(0, Window.unboundedFollowing)
    return full.select(
        F.col("level").alias("threshold_no"),
        ((F.coalesce(F.sum("_miss").over(below), F.lit(0)) + F.sum("_alarm").over(above)) / 10_000).alias("cost"),
        F.sum("_p").over(above).alias("tp"), F.sum(F.col("_n") - F.col("_p")).over(above).alias("fp"),
        F.coalesce(F.sum("_p").over(below), F.lit(0)).alias("fn"),
    ).filter("threshold_no > 0")


def optimal_threshold(df, **kw) -> DataFrame:
    """One row: the first threshold of least cost."""
    best = cost_curve(df, **kw).agg(F.min(F.struct("cost", "threshold_no")).alias("b"))
    return best.select((F.col("b.threshold_no") / float(GRID)).alias("threshold"), F.col("b.cost").alias("cost"))


def closed_form_threshold(amount: Column, m: CostMatrix = CostMatrix()) -> Column:
    false_alarm = amount * m.merchant_margin + m.p_attrition * m.customer_ltv
    return false_alarm / (false_alarm + amount + m.chargeback_fee)


def median_threshold(df, cents="amount_c", tie="event_id", matrix=CostMatrix()) -> DataFrame:
    """Closed form at the upper median amount (element n // 2 in order)."""
    edge = order_statistic(df, cents, tie, df.count() // 2 + 1)
    amount = F.lit(edge[0] if edge else 0) / 100.0
    return df.sparkSession.range(1).select(amount.alias("median_amount"),
                                           closed_form_threshold(amount, matrix).alias("threshold"))


# --- comparisons -----------------------------------------------------------------------

def _pair_of_scores(df, first, second, label):
    return df.select(label, F.explode(F.array(
        F.struct(F.lit("first").alias("which"), first.alias("s")), F.struct(F.lit("second").alias("which"), second.alias("s"))
    )).alias("p")).select(label, "p.which", "p.s")


def _two_aps(df, first, second, label):
    per = average_precision(_pair_of_scores(df, first, second, label), label, "s", ["which"])
    pick = [F.max(F.when(F.col("which") == w, F.col("average_precision"))).alias(w) for w in ("first", "second")]
    return per.agg(*pick)


def graph_channel_lift(df, score="score", graph="graph_score", label="is_fraud", bar=GRAPH_LIFT_BAR) -> DataFrame:
    """Gain in average precision from averaging in the graph channel; keep at ``bar`` or more."""
    both = _two_aps(df, F.col(score), (F.col(score) + F.col(graph)) / 2, label)
    lift = F.col("second") - F.col("first")
    return both.select(F.col("first").alias("base"), F.col("second").alias("fused"), lift.alias("lift"),
                       (lift >= bar).alias("keep"))


def candidate_is_kept(df, incumbent: str, candidate: str, label="is_fraud") -> DataFrame:
    both = _two_aps(df, F.col(incumbent), F.col(candidate), label)
    return both.select(F.col("first").alias("incumbent"), F.col("second").alias("candidate"),
                       (F.col("second") >= F.col("first")).alias("kept"))
