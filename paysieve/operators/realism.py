"""How closely a batch of events resembles a reference table: distributions, associations,
behaviour over time, graph motifs and record proximity.

Statistics are computed on all rows. A verdict is a set of rows (layer, metric, value, passed).
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paysieve.functions import numeric as N
from paysieve.operators import graph as G
from paysieve.operators import windows as W
from paysieve.operators.validation import legitimate_view
from paysieve.plans.durable import durable
from paysieve.plans.scan import previous_row, running_totals

# Acceptance limits.
KS_MAX, KS_PASS_FRACTION, KS_MIN_P, KS_REFERENCE_ROWS = 0.10, 0.90, 0.05, 500
BENFORD_CHI2_MAX, BENFORD_MAD_MAX, BENFORD_CHI2_ROWS = 15.507, 0.006, 5_000
PCD_MAX, CRAMERS_V_MAX = 0.15, 0.10
BEHAVIOURAL_MAX, STRUCTURAL_MULTIPLE, MIN_AUTOCORRELATION = 10.0, 2.0, 0.01
CATEGORICAL = ("rail", "mcc", "response_code", "pos_entry_mode", "threeds_flow", "currency")
BEHAVIOURAL_KEYS = ("device_id", "pan_token", "merchant_id")
SHARE_COLUMNS = ("rail", "response_code", "currency", "mcc")
MISSING = "__missing__"
# End of fixed values.


def numeric_view(df: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """The shared numeric columns; infinities become null."""
    c = F.col
    amount = c("amount").cast("double")
    columns = {
        "amount": amount, "log_amount": F.log10(F.greatest(amount, F.lit(0.01))),
        "hour_of_day": F.hour("event_ts").cast("double"), "day_of_week": F.weekday("event_ts").cast("double"),
        "cross_border_num": c("cross_border").cast("int").cast("double"),
    }
    code = c("response_code") if "response_code" in df.columns else F.lit(None)
    columns["is_decline"] = (F.coalesce(code, F.lit("00")) != "00").cast("int").cast("double")
    for name in ("amount_inr", "browser_tz_offset"):
        if name in df.columns:
            columns[name] = c(name).cast("double")
    finite = {n: F.when(F.abs(e) < float("inf"), e) for n, e in columns.items()}
    return df.select(*carry, *[e.alias(n) for n, e in finite.items()])


def _shared(batch: DataFrame, reference: DataFrame, columns: Sequence[str] | None) -> list[str]:
    return [c for c in (columns or batch.columns) if c in batch.columns and c in reference.columns]


def _stacked(df: DataFrame, columns: Sequence[str], side: int) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns])
    return df.select(F.inline(pairs)).filter("value IS NOT NULL AND NOT isnan(value)").withColumn("side", F.lit(side))


def ks_two_sample(batch: DataFrame, reference: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, statistic, p_value): largest distance of the two empirical distributions, and
    the p-value that distance would have at the reference size.

    All columns share one pass: counts per (column, value), then running counts per column.
    """
    names = _shared(batch, reference, columns)
    counts = _stacked(batch, names, 0).unionByName(_stacked(reference, names, 1)).groupBy("column", "value").agg(
        F.count_if(F.col("side") == 0).alias("a"), F.count_if(F.col("side") == 1).alias("b"))
    totals = counts.groupBy("column").agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))
    scanned = running_totals(counts, ["column"], "value", {"_a": F.col("a"), "_b": F.col("b")}, tie="value")
    joined = scanned.join(F.broadcast(totals), "column")  # one row per column name
    gap = F.abs((F.col("_a") + F.col("a")) / F.col("na") - (F.col("_b") + F.col("b")) / F.col("nb"))
    out = joined.filter("na >= 2 AND nb >= 2").groupBy("column").agg(F.max(gap).alias("statistic"))
    return out.withColumn("p_value", ks_reference_p(F.col("statistic")))


def ks_reference_p(statistic: Column, rows: int = KS_REFERENCE_ROWS) -> Column:
    return N.kolmogorov_sf(statistic * math.sqrt(rows / 2))


def _digit_counts(df: DataFrame, cents: str) -> DataFrame:
    digits = df.filter(F.col(cents) > 0).groupBy(N.first_digit(F.col(cents)).alias("digit")).agg(F.count(F.lit(1)).alias("n"))
    table = df.sparkSession.createDataFrame([(d + 1, b) for d, b in enumerate(N.BENFORD)], "digit int, expected double")
    return table.join(digits, "digit", "left").fillna(0, ["n"])


def benford(df: DataFrame, cents="amount_c", chi2_rows: int = BENFORD_CHI2_ROWS) -> DataFrame:
    """One row (chi2, mad), both from the digit counts of all rows.

    Chi-square grows with the row count, so its limit holds at one size: shares of all rows are
    read as if they came from ``chi2_rows`` rows (or from all, where there are fewer).
    """
    counts = _digit_counts(df, cents)
    share = F.try_divide(F.col("n"), F.sum("n").over(Window.partitionBy(F.lit(1))))  # nine rows
    gap = counts.select(share.alias("share"), "expected", "n")
    size = F.least(F.sum("n"), F.lit(chi2_rows))
    sums = gap.agg((size * F.sum(F.pow(F.col("share") - F.col("expected"), 2.0) / F.col("expected"))).alias("chi2"),
                   F.avg(F.abs(F.col("share") - F.col("expected"))).alias("mad"))
    infinite = F.lit(float("inf"))
    return sums.select(F.coalesce("chi2", infinite).alias("chi2"), F.coalesce("mad", infinite).alias("mad"))


def verdict(df: DataFrame, layer: str, metrics: Mapping[str, str], passed: Column) -> DataFrame:
    """One-row table of metrics to (layer, metric, value, passed) rows."""
    return df.select(F.lit(layer).alias("layer"), passed.alias("passed"), F.inline(F.array(*[
        F.struct(F.lit(n).alias("metric"), F.expr(e).cast("double").alias("value")) for n, e in metrics.items()
    ]))).select("layer", "metric", "value", F.coalesce("passed", F.lit(False)).alias("passed"))


def marginal_layer(batch: DataFrame, reference: DataFrame, cents="amount_c") -> DataFrame:
    batch = legitimate_view(batch)
    ks = ks_two_sample(numeric_view(batch), numeric_view(reference))
    ok = (F.col("statistic") < KS_MAX) & (F.col("p_value") > KS_MIN_P)
    columns = len(_shared(numeric_view(batch), numeric_view(reference), None))
    summary = ks.agg((F.count_if(ok) / F.lit(columns)).alias("share"), F.max("statistic").alias("worst"), F.lit(1).alias("one"))
    both = summary.join(benford(batch, cents).withColumn("one", F.lit(1)), "one")
    passed = (F.col("share") >= KS_PASS_FRACTION) & (F.col("chi2") < BENFORD_CHI2_MAX) & (F.col("mad") <= BENFORD_MAD_MAX)
    return verdict(both, "marginal", {"ks_column_pass_frac": "share", "ks_worst_statistic": "worst",
                                      "benford_chi2": "chi2", "benford_mad": "mad"}, passed)


def pcd(batch: DataFrame, reference: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row: root mean squared difference of the two correlation matrices off the diagonal.
    Every pair's correlation comes from one aggregate over both tables.
    """
    names = _shared(batch, reference, columns)
    pairs = list(itertools.combinations(names, 2))
    both = batch.select(*names).withColumn("_side", F.lit("a")).unionByName(reference.select(*names).withColumn("_side", F.lit("b")))
    per_side = both.groupBy("_side").agg(*[F.corr(x, y).alias(f"_r{i}") for i, (x, y) in enumerate(pairs)])
    side = lambda s, i: F.max(F.when(F.col("_side") == s, F.nanvl(F.col(f"_r{i}"), F.lit(None))))
    diffs = per_side.agg(*[(side("a", i) - side("b", i)).alias(f"_d{i}") for i in range(len(pairs))])
    squares = [F.pow(F.coalesce(F.nanvl(F.col(f"_d{i}"), F.lit(0.0)), F.lit(0.0)), 2.0) for i in range(len(pairs))]
    return diffs.select(F.sqrt(sum(squares[1:], squares[0]) / len(pairs)).alias("pcd") if pairs else F.lit(0.0).alias("pcd"))


def _pair_cells(df: DataFrame, pairs: Sequence[tuple[str, str]], side: str) -> DataFrame:
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(MISSING))
    cells = F.array(*[F.struct(F.lit(f"{x}|{y}").alias("pair"), text(x).alias("x"), text(y).alias("y")) for x, y in pairs])
    return df.select(F.lit(side).alias("side"), F.inline(cells)).groupBy("side", "pair", "x", "y").agg(
        F.count(F.lit(1)).alias("n"))


def cramers_v_pairs(df: DataFrame, pairs: Sequence[tuple[str, str]], side="all") -> DataFrame:
    """(side, pair, v) without continuity correction; 0 when a column has one value."""
    return _cramers(_pair_cells(df, pairs, side))


def _cramers(cells: DataFrame) -> DataFrame:
    by = ["side", "pair"]
    rows = cells.groupBy(*by, "x").agg(F.sum("n").alias("r"))
    cols = cells.groupBy(*by, "y").agg(F.sum("n").alias("c"))
    size = cells.groupBy(*by).agg(F.sum("n").alias("total")).join(
        rows.groupBy(*by).agg(F.count(F.lit(1)).alias("nr")), by).join(cols.groupBy(*by).agg(F.count(F.lit(1)).alias("nc")), by)
    n = F.col("n").cast("double")
    phi2 = cells.join(rows, [*by, "x"]).join(cols, [*by, "y"]).groupBy(*by).agg((F.sum(n * n / (F.col("r") * F.col("c").cast("double"))) - 1).alias("phi2"))
    least = F.least("nr", "nc") - 1
    v = F.when(least > 0, F.sqrt(F.greatest(F.col("phi2"), F.lit(0.0)) / least)).otherwise(0.0)
    return phi2.join(size, by).select(*by, v.alias("v"))


def cramers_v(df: DataFrame, x: str, y: str) -> DataFrame:
    return cramers_v_pairs(df, [(x, y)]).select("v")


def cramers_v_delta(batch: DataFrame, reference: DataFrame, columns: Sequence[str] = CATEGORICAL) -> DataFrame:
    """(pair, batch_v, reference_v, delta) for every pair of shared categorical columns."""
    pairs = list(itertools.combinations(_shared(batch, reference, columns), 2))
    vs = _cramers(_pair_cells(batch, pairs, "batch").unionByName(_pair_cells(reference, pairs, "reference")))
    side = lambda s: F.max(F.when(F.col("side") == s, F.col("v")))
    return vs.groupBy("pair").agg(side("batch").alias("batch_v"), side("reference").alias("reference_v")).withColumn(
        "delta", F.abs(F.col("batch_v") - F.col("reference_v")))


def joint_layer(batch: DataFrame, reference: DataFrame, columns: Sequence[str] = CATEGORICAL) -> DataFrame:
    batch = legitimate_view(batch)
    delta = cramers_v_delta(batch, reference, columns).agg(F.coalesce(F.max("delta"), F.lit(0.0)).alias("dv"), F.lit(1).alias("one"))
    both = pcd(numeric_view(batch), numeric_view(reference)).withColumn("one", F.lit(1)).join(delta, "one")
    return verdict(both, "joint", {"pcd": "pcd", "cramers_v_max_delta": "dv"},
                   (F.col("pcd") < PCD_MAX) & (F.col("dv") < CRAMERS_V_MAX))


# --- behaviour over time ----------------------------------------------------------------

def gap_deviation(df: DataFrame, key: str, at: str, tie: str) -> DataFrame:
    return W.inter_event_time(df, key, at, tie).agg(F.stddev_samp("gap_s").alias("sd"))


def velocity_ratios(batch: DataFrame, reference: DataFrame, keys=BEHAVIOURAL_KEYS, at="us", tie="event_id") -> DataFrame:
    """(key, status, ratio): the larger over the smaller spread of gaps between events.

    ``not_comparable``: the reference has no such column. ``structural``: no spread to compare.
    """
    ceiling = BEHAVIOURAL_MAX * STRUCTURAL_MULTIPLE
    parts = []
    for key in keys:
        if key not in reference.columns:
            parts.append(batch.sparkSession.range(1).select(
                F.lit(key).alias("key"), F.lit("not_comparable").alias("status"), F.lit(None).cast("double").alias("ratio")))
            continue
        a = gap_deviation(batch, key, at, tie).select(F.col("sd").alias("a"), F.lit(1).alias("one")) if key in batch.columns else (
            batch.sparkSession.range(1).select(F.lit(None).cast("double").alias("a"), F.lit(1).alias("one")))
        b = gap_deviation(reference, key, at, tie).select(F.col("sd").alias("b"), F.lit(1).alias("one"))
        usable = F.coalesce((F.col("a") > 0) & (F.col("b") > 0), F.lit(False))
        parts.append(a.join(b, "one").select(
            F.lit(key).alias("key"), F.when(usable, "ok").otherwise("structural").alias("status"),
            F.when(usable, F.greatest(F.col("a") / F.col("b"), F.col("b") / F.col("a"))).otherwise(ceiling).alias("ratio")))
    return reduce(DataFrame.unionByName, parts)


def _ratio(real: Column, synthetic: Column) -> Column:
    real1, synth1 = F.greatest(real, F.lit(1.0)), F.greatest(synthetic, F.lit(1.0))
    return F.when((real <= 0) & (synthetic <= 0), 1.0).when(real >= synthetic, real1 / synth1).otherwise(synth1 / real1)


def motif_ratio(batch: DataFrame, reference: DataFrame, src="payer_entity_id", dst="payee_entity_id") -> DataFrame:
    """One row: counts of triangles and two-stars on both sides and the worse ratio. Payer and
    payee ids share one id space only if the caller makes them so.
    """
    def motifs(df, side):
        pairs = df.select(F.col(src).cast("string").alias("s"), F.col(dst).cast("string").alias("t")).filter(
            "s IS NOT NULL AND t IS NOT NULL").distinct()
        t = G.triangles(pairs, "s", "t").select(F.col("triangles").cast("double").alias(f"t_{side}"), F.lit(1).alias("one"))
        s = G.two_stars(pairs, "s", "t").select(F.col("two_stars").alias(f"s_{side}"), F.lit(1).alias("one"))
        return t.join(s, "one")

    both = motifs(reference, "real").join(motifs(batch, "synth"), "one").drop("one")
    return both.withColumn("ratio", F.greatest(_ratio(F.col("t_real"), F.col("t_synth")), _ratio(F.col("s_real"), F.col("s_synth"))))


def autocorrelation_ratio(batch: DataFrame, reference: DataFrame, key="pan_token", at="us", tie="event_id") -> DataFrame:
    """One row: weighted lag-1 autocorrelation of both sides and their ratio; a batch at or below
    0.01 has none and gets the ceiling.
    """
    a = W.weighted_autocorr(batch, key, at, tie).select(F.col("autocorr").alias("synthetic"), F.lit(1).alias("one"))
    b = W.weighted_autocorr(reference, key, at, tie).select(F.col("autocorr").alias("real"), F.lit(1).alias("one"))
    real, synth = F.col("real"), F.col("synthetic")
    ratio = F.when(synth < MIN_AUTOCORRELATION, BEHAVIOURAL_MAX * STRUCTURAL_MULTIPLE).otherwise(
        F.greatest(real / synth, synth / F.greatest(real, F.lit(MIN_AUTOCORRELATION))))
    return a.join(b, "one").drop("one").withColumn("ratio", ratio)


def behavioural_layer(batch: DataFrame, reference: DataFrame, keys=BEHAVIOURAL_KEYS, autocorr_key="pan_token",
                      src="payer_entity_id", dst="payee_entity_id", at="us", tie="event_id") -> DataFrame:
    """Geometric mean of the ratios; a structural failure lifts it to at least the ceiling."""
    ceiling = BEHAVIOURAL_MAX * STRUCTURAL_MULTIPLE
    ratios = velocity_ratios(batch, reference, keys, at, tie).select(
        F.concat(F.lit("velocity_"), "key").alias("metric"), "ratio", (F.col("status") == "structural").alias("broken"))
    motif = motif_ratio(batch, reference, src, dst).select(F.lit("graph_motif").alias("metric"), "ratio", F.lit(False).alias("broken"))
    auto = autocorrelation_ratio(batch, reference, autocorr_key, at, tie).select(
        F.lit("iet_autocorr").alias("metric"), "ratio", (F.col("ratio") >= ceiling).alias("broken"))
    parts = ratios.unionByName(motif).unionByName(auto).filter("ratio IS NOT NULL")
    summary = parts.agg(F.exp(F.avg(F.log("ratio"))).alias("mean"), F.max("broken").alias("broken"),
                        F.map_from_entries(F.collect_list(F.struct("metric", "ratio"))).alias("m"))  # five entries at most
    composite = F.when(F.col("broken"), F.greatest(F.col("mean"), F.lit(ceiling))).otherwise(F.col("mean"))
    return summary.withColumn("m", F.map_concat("m", F.create_map(F.lit("composite"), composite))).select(
        F.lit("behavioral").alias("layer"), F.explode("m").alias("metric", "value"), (composite < BEHAVIOURAL_MAX).alias("passed"))


# --- record proximity -------------------------------------------------------------------

def _standardised(batch: DataFrame, reference: DataFrame, columns: Sequence[str], fit: DataFrame):
    """Both tables with columns scaled by the mean and population deviation of ``fit``."""
    stats = fit.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    def scale(df):
        return df.select("_id", *[((F.coalesce(F.col(c), F.lit(0.0)) - F.lit(stats[f"m_{c}"])) / F.lit(stats[f"s_{c}"] or 1.0)).alias(c)
                                  for c in columns])
    return scale(batch), scale(reference)


def proximity_view(df: DataFrame, tie="event_id", at="us") -> DataFrame:
    """Row id, numeric view and the event time in seconds."""
    view = numeric_view(df, [tie, at])
    return view.withColumn("event_epoch", F.col(at) / F.lit(float(W.SECOND))).drop(at).withColumnRenamed(tie, "_id").fillna(0.0)


def closest_record(batch: DataFrame, reference: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row: the least distance from any batch row to any reference row, in the space
    standardised on the reference. Exact, over all rows, without comparing all pairs.

    An equality join answers the failing case, distance 0. Otherwise the nearest neighbour in
    time gives an upper bound; any closer pair must lie within that bound in every column, so
    rows meet only in grid cells of that width.
    """
    spark = batch.sparkSession
    names = [c for c in _shared(batch, reference, columns) if c != "_id"]
    left, right = _standardised(batch, reference, names, reference)
    hit = left.select(*names).join(right.select(*names).distinct(), names, "left_semi").limit(1).count()
    if hit:
        return spark.range(1).select(F.lit(0.0).alias("min_distance"))
    axis = "event_epoch" if "event_epoch" in names else names[0]
    tagged = left.withColumn("_side", F.lit(0)).unionByName(right.withColumn("_side", F.lit(1)))
    tagged = tagged.withColumn("_tie", F.struct("_id", "_side"))
    before = previous_row(tagged, [], axis, "_tie", {"_p": F.struct("_side", *names)})
    gap = F.sqrt(sum([F.pow(F.col(c) - F.col(f"_p.{c}"), 2.0) for c in names[1:]], F.pow(F.col(names[0]) - F.col(f"_p.{names[0]}"), 2.0)))
    bound = before.filter(F.col("_p._side") != F.col("_side")).agg(F.min(gap)).first()[0]
    if bound is None:
        return spark.range(1).select(F.lit(None).cast("double").alias("min_distance"))
    gap, ahead, bound = _apart(left, right, axis, names, bound)
    # Where one table ends before the other begins, all pairs are at least the gap apart: closing
    # it leaves a narrow band at the edge, and less room in every other column.
    slack = max(bound - gap, bound * 1e-9)
    rest = max((bound * bound - gap * gap) ** 0.5, bound * 1e-9)
    place = lambda c, shift=0.0: F.floor((F.col(c) - F.lit(shift)) / F.lit(slack if c == axis else rest)).cast("bigint")
    # Exact cells, with neighbours on one side of the join only; other columns filter.
    second = next((c for c in names if c not in (axis, "amount")), axis)
    near = F.array(F.lit(-1), F.lit(0), F.lit(1))
    shift = gap if ahead else -gap
    a = left.select("*", F.explode(near).alias("_o1")).select("*", F.explode(near).alias("_o2"))
    a = a.withColumns({"_c1": place(axis, shift) + F.col("_o1"), "_c2": place(second, shift if second == axis else 0.0) + F.col("_o2")})
    b = right.select(place(axis).alias("_c1"), place(second).alias("_c2"), *[F.col(c).alias(f"r_{c}") for c in names])
    square = sum([F.pow(F.col(c) - F.col(f"r_{c}"), 2.0) for c in names[1:]], F.pow(F.col(names[0]) - F.col(f"r_{names[0]}"), 2.0))
    best = a.join(b, ["_c1", "_c2"]).agg(F.min(square).alias("q"))
    return best.select(F.least(F.sqrt("q"), F.lit(bound)).alias("min_distance"))


EDGE_ROWS = 1000


def _apart(left: DataFrame, right: DataFrame, axis: str, names: Sequence[str], bound: float) -> tuple[float, bool, float]:
    """(gap between the tables along the axis, whether left lies above, a tighter bound).

    With a gap the bound also comes from the EDGE_ROWS rows of each table nearest to the other.
    """
    ends = [t.agg(F.min(axis).alias("low"), F.max(axis).alias("high")).first() for t in (left, right)]
    ahead = ends[0]["low"] > ends[1]["high"]
    gap = ends[0]["low"] - ends[1]["high"] if ahead else ends[1]["low"] - ends[0]["high"]
    if gap <= 0:
        return 0.0, False, bound
    orders = (F.col(axis).asc(), F.col(axis).desc()) if ahead else (F.col(axis).desc(), F.col(axis).asc())
    a, b = (t.select(*names).orderBy(o).limit(EDGE_ROWS).toPandas().to_numpy("float64") for t, o in zip((left, right), orders))
    squares = ((row - b) ** 2 for row in a)
    return gap, ahead, min(bound, min(float(s.sum(axis=1).min()) for s in squares) ** 0.5)


# --- descriptive comparisons -------------------------------------------------------------

def share_difference(batch: DataFrame, reference: DataFrame, columns: Sequence[str] = SHARE_COLUMNS) -> DataFrame:
    """(column, max_abs_difference) of value shares; values only the batch has do not count."""
    names = _shared(batch, reference, columns)
    counts = _value_counts(batch, names, "a").join(_value_counts(reference, names, "b"), ["column", "value"], "full_outer").fillna(0)
    totals = counts.groupBy("column").agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"))
    gap = F.abs(F.col("a") / F.col("ta") - F.col("b") / F.col("tb"))
    return counts.filter("b > 0").join(totals, "column").groupBy("column").agg(F.max(gap).alias("max_abs_difference"))


def _value_counts(df: DataFrame, names: Sequence[str], alias: str) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c).cast("string"), F.lit(MISSING)).alias("value")) for c in names])
    return df.select(F.inline(pairs)).groupBy("column", "value").agg(F.count(F.lit(1)).alias(alias))


def top_shares(df: DataFrame, column: str, k: int = 4) -> DataFrame:
    counts = df.groupBy(F.coalesce(F.col(column).cast("string"), F.lit(MISSING)).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    total = df.count()
    return counts.orderBy(F.col("n").desc(), "value").limit(k).select("value", (F.col("n") / F.lit(total)).alias("share"))


def decline_rate_by_rail(df: DataFrame, rail="rail", code="response_code") -> DataFrame:
    declined = (F.coalesce(F.col(code), F.lit("00")) != "00").cast("int")
    return df.groupBy(rail).agg(F.avg(declined).alias("decline_rate"))


def histogram(df: DataFrame, name: str, value: Column, bins: int, low: float, high: float) -> DataFrame:
    """(measure, bin, density): values outside the range do not count; the top edge is inside."""
    width = (high - low) / bins
    number = F.when(F.col("_v") == high, bins - 1).otherwise(F.floor((F.col("_v") - low) / width)).cast("int")
    counts = df.select(value.cast("double").alias("_v")).filter(F.col("_v").between(low, high)).groupBy(number.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("t"), F.lit(name).alias("measure"))
    return counts.withColumn("measure", F.lit(name)).join(total, "measure").select(
        "measure", "bin", (F.col("n") / F.col("t") / F.lit(width)).alias("density"))


def distribution_histograms(df: DataFrame, bins=40, hour_bins=24, degree_bins=30, payer="payer_entity_id",
                            payee="payee_entity_id", at="us", tie="event_id") -> DataFrame:
    log10 = lambda c, floor: F.log10(F.greatest(c.cast("double"), F.lit(floor)))
    gaps = W.inter_event_time(df, payer, at, tie).filter("gap_s IS NOT NULL")
    degree = df.filter(F.col(payee).isNotNull()).groupBy(payee).agg(F.count(F.lit(1)).alias("d"))
    parts = [
        histogram(df, "amount", log10(F.col("amount"), 0.01), bins, -1.0, 5.0),
        histogram(df, "hour_of_day", F.hour("event_ts"), hour_bins, 0.0, 24.0),
        histogram(gaps, "interarrival", log10(F.col("gap_s"), 1.0), bins, 0.0, 6.0),
        histogram(degree, "merchant_degree", log10(F.col("d"), 1.0), degree_bins, 0.0, 5.0),
    ]
    return reduce(DataFrame.unionByName, parts)


def realism_checks(df: DataFrame, payer="payer_entity_id", at="us", tie="event_id", night=(1, 2, 3, 4)) -> DataFrame:
    """One row: night and peak hour shares, approval rate, kurtosis of gaps, shares of the two
    soft decline codes among declines, fraud share.
    """
    hours = df.groupBy(F.hour("event_ts").alias("h")).agg(F.count(F.lit(1)).alias("n")).agg(
        (F.sum(F.when(F.col("h").isin(*night), F.col("n"))) / len(night) / F.sum("n")).alias("night_share"),
        (F.max("n") / F.sum("n")).alias("peak_share"), F.lit(1).alias("one"))
    code = F.coalesce(F.col("response_code"), F.lit("00"))
    rates = df.agg(
        F.avg((code == "00").cast("int")).alias("approval_rate"),
        F.coalesce(F.try_divide(F.count_if(code == "05"), F.count_if(code != "00")), F.lit(0.0)).alias("share_05"),
        F.coalesce(F.try_divide(F.count_if(code == "51"), F.count_if(code != "00")), F.lit(0.0)).alias("share_51"),
        F.avg(F.col("is_fraud").cast("int")).alias("prevalence"), F.lit(1).alias("one"))
    gaps = W.inter_event_time(df, payer, at, tie).agg((F.kurtosis("gap_s") + 3).alias("gap_kurtosis"), F.lit(1).alias("one"))
    return hours.join(rates, "one").join(gaps, "one").drop("one")
