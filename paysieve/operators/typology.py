"""Detectors for known patterns of payment fraud, each a query over the event table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paysieve.operators.windows import DAY, HOUR, MINUTE, Measure, distinct_approx_block, pit_distinct_exact, trailing
from paysieve.plans.scan import previous_row, rank_in_group, running_totals
from paysieve.plans.skew import plan_layout


def enumeration(
    df: DataFrame, device="device_id", card="pan_token", at="us", tie="event_id", cents="amount_c", declined="declined",
    code="response_code", window=10 * MINUTE, min_cards=3, max_mean_cents=20_000, min_decline=0.5,
) -> DataFrame:
    """Per event: cards, mean amount, decline rate and share of 'invalid card' (14) seen on the
    device in the window, and whether the pattern of card testing fires.
    """
    out = distinct_approx_block(df, [device], at, {"cards": (card, window)}, tie)
    values = {"amount": F.col(cents), "declined": F.col(declined), "invalid": (F.col(code) == "14").cast("int")}
    out = trailing(out, [device], at, values, [
        Measure("mean_cents", "amount", window, "mean"), Measure("decline_rate", "declined", window, "mean"),
        Measure("invalid_share", "invalid", window, "mean")])
    fired = (F.col("cards") >= min_cards) & (F.col("mean_cents") <= max_mean_cents) & (F.col("decline_rate") >= min_decline)
    return out.withColumn("enumeration", F.coalesce(fired, F.lit(False)))


def bin_concentration(df: DataFrame, bin_col="bin", merchant="merchant_id", at="us", width=HOUR, min_merchants=3):
    """(bin, slot, merchants, events): issuer ranges touching many merchants in one time slot."""
    slot = F.floor(F.col(at) / width)
    pairs = df.groupBy(bin_col, slot.alias("slot"), merchant).agg(F.count(F.lit(1)).alias("n"))
    return pairs.groupBy(bin_col, "slot").agg(
        F.count(merchant).alias("merchants"), F.sum("n").alias("events")).filter(F.col("merchants") >= min_merchants)


def approval_after_declines(df: DataFrame, bin_col="bin", at="us", tie="event_id", declined="declined", min_run=3):
    """Approvals that directly follow at least ``min_run`` declines on the same issuer range.

    The run is the distance in rank between consecutive approvals.
    """
    ranked = rank_in_group(df, [bin_col], at, tie, "_rank")
    approvals = previous_row(ranked.filter(F.col(declined) == 0), [bin_col], at, tie, {"_last": F.col("_rank")})
    run = F.col("_rank") - F.coalesce("_last", F.lit(0)) - 1
    return approvals.withColumn("declines_before", run).drop("_rank", "_last").filter(F.col("declines_before") >= min_run)


def escalating_payments(df: DataFrame, payer="payer_entity_id", payee="payee_entity_id", at="us", tie="event_id",
                        cents="amount_c", min_rises=2, new_within=30 * DAY) -> DataFrame:
    """(payer, payee, rises, run_start_us, run_cents): runs of rising amounts to one payee that
    begin within ``new_within`` of the first payment to it.
    """
    pair = [payer, payee]
    rows = df.select(*pair, at, tie, cents)
    layout = plan_layout(rows, pair, F.col(at))  # serves both scans
    seen = previous_row(rows, pair, at, tie, {"_p": F.col(cents)}, layout=layout)
    rising = F.coalesce((F.col(cents) > F.col("_p")).cast("int"), F.lit(0))
    breaks = running_totals(seen.withColumn("_rise", rising), pair, at, {"_b": F.lit(1) - F.col("_rise")}, tie=tie, layout=layout)
    island = F.col("_b") + F.lit(1) - F.col("_rise")  # counts this row's own break
    runs = breaks.groupBy(*pair, island.alias("_island")).agg(
        F.sum("_rise").alias("rises"), F.min(at).alias("run_start_us"), F.sum(cents).alias("run_cents"))
    first = df.groupBy(*pair).agg(F.min(at).alias("_first"))
    kept = runs.filter(F.col("rises") >= min_rises).join(first, pair)
    return kept.filter(F.col("run_start_us") - F.col("_first") <= new_within).drop("_island", "_first")


def collect_abuse(df: DataFrame, by: str, collect: Column, name_match: Column, min_events=5, min_share=0.2,
                  min_mismatch=0.1) -> DataFrame:
    """(by, events, collect_share, mismatch_share) where both shares reach their bars."""
    out = df.groupBy(by).agg(
        F.count(F.lit(1)).alias("events"), F.avg(collect.cast("int")).alias("collect_share"),
        F.avg(F.coalesce((~name_match).cast("int"), F.lit(0))).alias("mismatch_share"))
    return out.filter((F.col("events") >= min_events) & (F.col("collect_share") >= min_share) & (F.col("mismatch_share") >= min_mismatch))


def shared_device_ring(df: DataFrame, device="device_id", payer="payer_entity_id", at="us", tie="event_id",
                       cents="amount_c", min_payers=3, min_dormant=HOUR) -> DataFrame:
    """(device, payers, dormant_s, ramp): devices many payers share that lie dormant and then ramp
    up; ``ramp`` is the slope of amount (cents) over time (days).
    """
    gaps = previous_row(df.filter(F.col(device).isNotNull()), [device], at, tie, {"_p": F.col(at)})
    days = (F.col(at) / F.lit(float(DAY)))
    shape = gaps.groupBy(device).agg(
        (F.max(F.col(at) - F.col("_p")) / 1e6).alias("dormant_s"), F.regr_slope(F.col(cents).cast("double"), days).alias("ramp"))
    payers = df.groupBy(device, payer).agg(F.lit(1).alias("_one")).groupBy(device).agg(F.count(payer).alias("payers"))
    joined = payers.join(shape, device)
    return joined.filter((F.col("payers") >= min_payers) & (F.col("dormant_s") * 1e6 >= min_dormant) & (F.col("ramp") > 0))


def mandate_breaches(df: DataFrame, payee_at_intent: Column, payee_at_settle: Column, tie="event_id") -> DataFrame:
    """One row per event with any broken mandate check, from the agentic features."""
    redirected = F.coalesce(payee_at_intent != payee_at_settle, F.lit(False)).cast("int")
    checks = ["mandate_scope_breach", "cart_hash_mismatch", "attestation_invalid", "nonce_reused", "payee_redirected"]
    out = df.withColumn("payee_redirected", redirected)
    broken = sum([F.col(c) for c in checks[1:]], F.col(checks[0]))
    return out.withColumn("broken", broken).filter("broken > 0").select(tie, *checks, "broken")


def threshold_hugging(df: DataFrame, threshold: float, margin: float, score="score", by: Sequence[str] = ()) -> DataFrame:
    """Scores just below the threshold against those just above it."""
    s = F.col(score)
    below = F.count_if((s >= threshold - margin) & (s < threshold))
    above = F.count_if((s >= threshold) & (s < threshold + margin))
    return df.groupBy(*by).agg(below.alias("below"), above.alias("above"),
                               F.try_divide(below.cast("double"), above.cast("double")).alias("ratio"))


def pass_through(
    edges: DataFrame, src="src", dst="dst", at="us", tie="event_id", cents="amount_c", dwell=6 * HOUR, fan_window=DAY,
    min_fan_in=3,
) -> DataFrame:
    """Incoming payments whose receiver had at least ``min_fan_in`` distinct payers in the window
    before and pays onward within ``dwell``: (id, fan_in, onward, onward_cents).

    Onward payments in (t, t + dwell] are the difference of two running totals of the
    receiver's outgoing payments, so incoming and outgoing rows are never paired.
    """
    fan = pit_distinct_exact(edges, [dst], at, src, fan_window, tie, "fan_in").filter(F.col("fan_in") >= min_fan_in)
    one, none = F.lit(1).cast("bigint"), F.lit(None)
    outgoing = edges.select(F.col(src).alias("acct"), F.col(at).alias("when"), F.lit(0).alias("sign"),
                            one.alias("n"), F.col(cents).alias("c"), none.cast("bigint").alias("id"), none.cast("bigint").alias("fan_in"))
    # Totals are strictly before, so + 1 microsecond makes a bound inclusive.
    marks = F.array(F.struct((F.col(at) + 1).alias("when"), F.lit(-1).alias("sign")),
                    F.struct((F.col(at) + F.lit(dwell + 1)).alias("when"), F.lit(1).alias("sign")))
    probes = fan.select(F.col(dst).alias("acct"), F.col(tie).alias("id"), "fan_in", F.inline(marks)).select(
        "acct", "when", "sign", F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("c"), "id", "fan_in")
    scanned = running_totals(outgoing.unionByName(probes), ["acct"], "when", {"before": F.col("n"), "before_c": F.col("c")})
    out = scanned.filter("sign <> 0").groupBy("id").agg(
        F.max("fan_in").alias("fan_in"), F.sum(F.col("sign") * F.col("before")).alias("onward"),
        F.sum(F.col("sign") * F.col("before_c")).alias("onward_cents"))
    return out.filter("onward > 0").withColumnRenamed("id", tie)


def authentication_gap(df: DataFrame, by: str, requires_auth: Column, authenticated: Column, cross_border="cross_border",
                       declined="declined") -> DataFrame:
    """(by, gap_events, decline_share) of cross-border payments that should have been
    authenticated and were not.
    """
    gap = F.col(cross_border) & requires_auth & ~F.coalesce(authenticated, F.lit(False))
    return df.filter(gap).groupBy(by).agg(F.count(F.lit(1)).alias("gap_events"), F.avg(declined).alias("decline_share"))
