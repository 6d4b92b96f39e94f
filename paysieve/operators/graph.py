"""Entity and account graphs as edge tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from paysieve.operators.validation import rate_of
from paysieve.plans.durable import durable, scratch_path, stored
from paysieve.plans.scan import running_stats, running_totals
from paysieve.plans.skew import MAX_HOT_GROUPS, Layout, attach_group_stats, layout_of_sizes, plan_layout, rows_per_task

# Who is linked to whom, and currency rates of the account corpus.
GRAPH_COLUMNS = ("fanin_payee_24h", "fanout_payer_24h", "payee_bank_degree", "payer_pagerank", "payee_pagerank", "component_size",
                 "cnt_payee_entity_id_24h", "sum_payee_entity_id_24h", "amtstd_payee_entity_id_24h", "declrate_payee_entity_id_24h")
EDGE_TYPES = (("payer_entity_id", "payee_entity_id", "pays"), ("device_id", "payer_entity_id", "used_by"),
              ("ip", "device_id", "hosts"), ("agent_id", "payer_entity_id", "acts_for"))
CURRENCY_TO_USD = {
    "US Dollar": 1.0, "Euro": 1.09, "Yuan": 0.14, "Yen": 0.0067, "Swiss Franc": 1.12, "UK Pound": 1.27,
    "Canadian Dollar": 0.74, "Australian Dollar": 0.66, "Rupee": 0.012, "Ruble": 0.011, "Brazil Real": 0.20,
    "Mexican Peso": 0.058, "Saudi Riyal": 0.27, "Shekel": 0.27, "Bitcoin": 60000.0,
}
# End of fixed values.
ALPHA, MAX_ITERATIONS, TOLERANCE = 0.85, 40, 1e-6
MIN_POWERLAW_VERTICES = 20


def edge_table(events: DataFrame, at: str = "us", types=EDGE_TYPES) -> DataFrame:
    """(src_id, dst_id, edge_type, first_us, last_us, weight); rows missing an endpoint add no edge.

    One scan, one partially aggregated shuffle for all edge types.
    """
    usable = [t for t in types if t[0] in events.columns and t[1] in events.columns]
    links = F.array(*[
        F.struct(F.col(a).cast("string").alias("src_id"), F.col(b).cast("string").alias("dst_id"),
                 F.lit(kind).alias("edge_type")) for a, b, kind in usable])
    rows = events.select(F.col(at).alias("_us"), F.inline(links))
    return rows.filter("src_id IS NOT NULL AND dst_id IS NOT NULL").groupBy("src_id", "dst_id", "edge_type").agg(
        F.min("_us").alias("first_us"), F.max("_us").alias("last_us"), F.count(F.lit(1)).alias("weight"))


def merge_edges(old: DataFrame, new: DataFrame) -> DataFrame:
    """Fold new edges into the table."""
    return old.unionByName(new).groupBy("src_id", "dst_id", "edge_type").agg(
        F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"), F.sum("weight").alias("weight"))


def _vertices(edges: DataFrame, src: str, dst: str) -> DataFrame:
    return edges.select(F.explode(F.array(src, dst)).alias("id")).distinct()


def pagerank(
    edges: DataFrame, vertices: DataFrame | None = None, *, src="src_id", dst="dst_id", weight: str | None = "weight",
    alpha=ALPHA, max_iterations=MAX_ITERATIONS, tolerance=TOLERANCE, trace: list[float] | None = None,
) -> tuple[DataFrame, float]:
    """(id, rank) and the last total change; ``trace`` collects the change of every round.

    Weights are summed over edge types. Mass of vertices without out-edges is spread evenly; a
    round's own write observes how much there will be in the next one and how much ranks changed,
    so a round is one job: ranks meet the edges' sources (sources with very many edges are salted),
    flows are summed per target with map-side combine, and the new ranks go to the shared folder.
    """
    spark = edges.sparkSession
    weighed = edges.groupBy(F.col(src).alias("id"), F.col(dst).alias("to")).agg(
        (F.sum(weight) if weight else F.count(F.lit(1))).cast("double").alias("w"))
    weighed = durable(weighed)
    totals = weighed.groupBy("id").agg(F.sum("w").alias("out"))
    layout = plan_layout(weighed, ["id"])
    links = attach_group_stats(weighed, ["id"], totals, layout).select("id", "to", (F.col("w") / F.col("out")).alias("share"))
    links = durable(links.repartition("id") if layout.hot is None else links)
    nodes = _vertices(edges, src, dst) if vertices is None else vertices.select("id").union(
        _vertices(edges, src, dst)).distinct()
    nodes = durable(nodes.join(totals.select("id", F.lit(False).alias("dangling")), "id", "left").select("id", F.coalesce("dangling", F.lit(True)).alias("dangling")))
    counts = nodes.agg(F.count(F.lit(1)).alias("n"), F.count_if("dangling").alias("d")).first()
    n, loose = max(counts["n"], 1), counts["d"] / max(counts["n"], 1)
    ranks = nodes.withColumn("rank", F.lit(1.0 / n))
    change = float("inf")
    for _ in range(max_iterations):
        flow = attach_group_stats(links, ["id"], ranks.select("id", "rank"), layout).groupBy(F.col("to").alias("id")).agg(
            F.sum(F.col("rank") * F.col("share")).alias("inflow"))
        even = (alpha * loose + (1 - alpha)) / n
        fresh = F.lit(alpha) * F.coalesce("inflow", F.lit(0.0)) + F.lit(even)
        step = ranks.join(flow, "id", "left").select("id", "dangling", fresh.alias("rank"), F.abs(fresh - F.col("rank")).alias("moved"))
        seen, path = Observation(), scratch_path(spark, "ranks")
        step.observe(seen, F.sum("moved").alias("change"), F.sum(F.when(F.col("dangling"), F.col("rank")).otherwise(0.0)).alias("loose")).write.parquet(path)
        ranks = spark.read.schema(step.schema).parquet(path).select("id", "dangling", "rank")
        change, loose = seen.get["change"] or 0.0, seen.get["loose"] or 0.0
        if trace is not None:
            trace.append(change)
        if change < n * tolerance:
            break
    return ranks.select("id", "rank"), change


def connected_components(edges: DataFrame, *, src="src_id", dst="dst_id", max_iterations: int | None = None) -> DataFrame:
    """(id, component): the smallest vertex id reachable ignoring direction.

    Alternates two hooking steps, each a minimum per vertex (map-side combine) joined back to
    the edges, so no neighbour list is ever held by a task. Rounds grow with the logarithm of
    the graph; each is checkpointed. It goes on until every vertex points at a root; a limit of
    rounds raises when it runs out.
    """
    ends = stored(edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v"), F.col(src).alias("_s"), F.col(dst).alias("_d")), "ends")
    nodes = stored(_vertices(ends, "_s", "_d"), "vertices")
    pairs, rounds = stored(ends.select("u", "v").filter("u <> v").distinct(), "pairs"), 0
    while not _all_stars(pairs):
        if max_iterations is not None and rounds >= max_iterations:
            raise RuntimeError(f"components are not stable after {max_iterations} rounds")
        both = pairs.union(pairs.select("v", "u")).toDF("u", "v")
        large = _hook(both, F.col("v") > F.col("u"))
        down = stored(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "pairs")
        pairs = stored(_hook(down, F.lit(True), with_self=True).filter("u <> v").distinct(), "pairs")
        rounds += 1
    return nodes.join(pairs.select(F.col("u").alias("id"), F.col("v").alias("component")), "id", "left").select(
        "id", F.coalesce("component", "id").alias("component"))


def _all_stars(pairs: DataFrame) -> bool:
    """Whether every vertex has one smaller neighbour at most, which has none itself."""
    roles = pairs.select("u", F.lit(1).alias("below"), F.lit(0).alias("above")).union(pairs.select("v", F.lit(0), F.lit(1)))
    return roles.groupBy("u").agg(F.sum("below").alias("below"), F.max("above").alias("above")).filter(
        "below > 1 OR below = 1 AND above = 1").isEmpty()


def _hook(pairs: DataFrame, moves: Column, with_self: bool = False) -> DataFrame:
    """Point each neighbour v of u that moves (and u itself) at the least vertex around u.

    One aggregate tells that vertex and how many rows of u will meet it, so hot vertices need no count of their own.
    """
    found = stored(pairs.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"), F.count_if(moves).alias("_n")), "least")
    least = found.select("u", "m")
    out = attach_group_stats(pairs.filter(moves), ["u"], least, layout_of_sizes(found, ["u"])).select(F.col("v").alias("u"), F.col("m").alias("v"))
    if with_self:
        out = out.union(least)
    return out


def component_size(edges: DataFrame, **kw) -> DataFrame:
    """(id, component_size)."""
    parts = connected_components(edges, **kw)
    sizes = parts.groupBy("component").agg(F.count(F.lit(1)).alias("component_size"))
    return attach_group_stats(parts, ["component"], sizes).select("id", "component_size")


def undirected(edges: DataFrame, src="src_id", dst="dst_id") -> DataFrame:
    """Distinct (u, v) with u < v, self-loops left out."""
    return edges.select(F.least(src, dst).alias("u"), F.greatest(src, dst).alias("v")).filter("u <> v").distinct()


def _degrees(simple: DataFrame) -> DataFrame:
    return simple.select(F.explode(F.array("u", "v")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def triangles(edges: DataFrame, src="src_id", dst="dst_id") -> DataFrame:
    """One row: number of triangles of the undirected simple graph.

    Every edge points from the lower (degree, id) end to the higher, so a vertex keeps at most
    sqrt(2 x edges) neighbours whatever its degree. Per edge the two short lists are
    intersected; no pairs of neighbours are produced.
    """
    simple = durable(undirected(edges, src, dst))
    degree = _degrees(simple)
    # A hub's edges are salted in every join on an endpoint.
    ends = attach_group_stats(simple, ["u"], degree.select(F.col("id").alias("u"), F.col("degree").alias("du")))
    ends = attach_group_stats(ends, ["v"], degree.select(F.col("id").alias("v"), F.col("degree").alias("dv")))
    forward = F.struct("du", "u") < F.struct("dv", "v")
    oriented = ends.select(F.when(forward, F.col("u")).otherwise(F.col("v")).alias("a"),
                           F.when(forward, F.col("v")).otherwise(F.col("u")).alias("b"))
    lists = oriented.groupBy("a").agg(F.collect_list("b").alias("near"))
    both = oriented.join(lists, "a")
    both = attach_group_stats(both, ["b"], lists.select(F.col("a").alias("b"), F.col("near").alias("far"))).filter("far IS NOT NULL")
    return both.agg(F.coalesce(F.sum(F.size(F.array_intersect("near", "far"))), F.lit(0)).cast("bigint").alias("triangles"))


def two_stars(edges: DataFrame, src="src_id", dst="dst_id") -> DataFrame:
    """One row: sum over vertices of d (d - 1) / 2."""
    d = F.col("degree")
    stars = F.sum(d * (d - 1) / 2)
    return _degrees(undirected(edges, src, dst)).agg(F.coalesce(stars, F.lit(0.0)).alias("two_stars"))


def reciprocity(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """(low, high, is_reciprocated) per unordered pair: whether both directions exist.

    Both directions meet in one group of (low, high); the pair's directions are two flags.
    """
    low, high = F.least(src, dst), F.greatest(src, dst)
    return edges.groupBy(low.alias("low"), high.alias("high")).agg(
        ((F.max((F.col(src) <= F.col(dst)).cast("int")) == 1) & (F.max((F.col(src) >= F.col(dst)).cast("int")) == 1))
        .cast("int").alias("is_reciprocated"))


def _attach_ends(edges, src, dst):
    """Degrees and distinct neighbours of both endpoints, and reciprocity, on every edge row.

    The edges are read once for the counts of directed pairs; degrees, neighbours, reciprocity and the sizes of groups
    come from those.
    """
    counted = durable(edges.groupBy(F.col(src).alias("s"), F.col(dst).alias("t")).agg(F.count(F.lit(1)).alias("n")))
    limit = rows_per_task(edges.sparkSession)
    out_side = durable(counted.groupBy(F.col("s").alias(src)).agg(F.sum("n").alias("src_out_degree"), F.count(F.lit(1)).alias("src_unique_targets")))
    in_side = durable(counted.groupBy(F.col("t").alias(dst)).agg(F.sum("n").alias("dst_in_degree"), F.count(F.lit(1)).alias("dst_unique_sources")))
    layouts = []
    for side, key, degree in ((out_side, src, "src_out_degree"), (in_side, dst, "dst_in_degree")):
        size = side.agg(F.coalesce(F.sum(degree), F.lit(0)).alias("rows"), F.coalesce(F.max(degree), F.lit(0)).alias("largest")).first()
        hot = size["largest"] > max(limit, size["rows"] // MAX_HOT_GROUPS)
        layouts.append(plan_layout(edges, [key]) if hot else Layout(size["rows"], size["largest"], limit))
    of_src = out_side.join(in_side.select(F.col(dst).alias(src), F.col("dst_in_degree").alias("src_in_degree")), src, "left")
    of_dst = in_side.join(out_side.select(F.col(src).alias(dst), F.col("src_out_degree").alias("dst_out_degree")), dst, "left")
    rows = edges.withColumns({"low": F.least(src, dst), "high": F.greatest(src, dst)})
    pairs = counted.groupBy(F.least("s", "t").alias("low"), F.greatest("s", "t").alias("high")).agg(F.sum("n").alias("_n"))
    widest = pairs.agg(F.coalesce(F.max("_n"), F.lit(0)).alias("n"), F.coalesce(F.sum("_n"), F.lit(0)).alias("rows")).first()
    hot = widest["n"] > max(limit, widest["rows"] // MAX_HOT_GROUPS)
    layout = plan_layout(rows, ["low", "high"]) if hot else Layout(widest["rows"], widest["n"], limit)
    rows = attach_group_stats(rows, ["low", "high"], reciprocity(counted, "s", "t"), layout).drop("low", "high")
    rows = attach_group_stats(rows, [src], of_src, layouts[0])
    rows = attach_group_stats(rows, [dst], of_dst, layouts[1])
    return rows.fillna(0, ["src_in_degree", "dst_out_degree"])


def account_graph_features(edges: DataFrame, src="src", dst="dst", usd: Column | None = None) -> DataFrame:
    """The eleven edge features. Reciprocity tests the reversed pair against the pairs."""
    rows = _attach_ends(edges, src, dst)
    amount = F.col("amount") if usd is None else usd
    return rows.select(
        *edges.columns, "src_out_degree", "src_in_degree", "dst_out_degree", "dst_in_degree", "src_unique_targets",
        "dst_unique_sources", "is_reciprocated", (F.col(src) == F.col(dst)).cast("int").alias("is_self_loop"),
        (F.col("src_out_degree") / F.greatest(F.col("src_unique_targets"), F.lit(1))).alias("src_fanout_ratio"),
        (F.col("dst_in_degree") / F.greatest(F.col("dst_unique_sources"), F.lit(1))).alias("dst_fanin_ratio"),
        F.log1p(F.greatest(amount.cast("double"), F.lit(0.0))).alias("amount_usd_log"))


def usd_amount(amount: Column, currency: Column, rates: Mapping[str, float] = CURRENCY_TO_USD) -> Column:
    return F.coalesce(amount.cast("double"), F.lit(0.0)) * rate_of(currency, rates).cast("double")


def motif_census(edges: DataFrame, label="is_laundering", src="src", dst="dst") -> DataFrame:
    """One row per label: edges, distinct ends, mean and max degrees, reciprocated and self-loop
    shares; degrees are those of the whole graph. ``accounts`` counts all accounts.
    """
    rows = _attach_ends(edges, src, dst)
    per_label = rows.groupBy(label).agg(
        F.count(F.lit(1)).alias("edges"), F.avg("src_out_degree").alias("mean_src_out_degree"),
        F.avg("dst_in_degree").alias("mean_dst_in_degree"), F.max("src_out_degree").alias("max_src_out_degree"),
        F.max("dst_in_degree").alias("max_dst_in_degree"), F.avg("is_reciprocated").alias("reciprocated_share"),
        F.avg((F.col(src) == F.col(dst)).cast("int")).alias("self_loop_share"))
    ends = edges.select(label, F.explode(F.array(
        F.struct(F.lit("s").alias("side"), F.col(src).alias("id")), F.struct(F.lit("t").alias("side"), F.col(dst).alias("id"))
    )).alias("e")).select(label, "e.side", "e.id").distinct()
    distinct = ends.groupBy(label).agg(F.count_if(F.col("side") == "s").alias("unique_sources"),
                                       F.count_if(F.col("side") == "t").alias("unique_targets"))
    accounts = ends.select("id").distinct().count()
    return per_label.join(distinct, label).withColumn("accounts", F.lit(accounts))


def neighbour_aggregate(
    df: DataFrame, key: str, columns: Sequence[str], *, layout: Layout | None = None,
) -> DataFrame:
    """Mean, max and sample deviation of each column over all rows sharing the key (the row
    itself and later rows included); null deviation is 0.
    """
    stats = df.groupBy(key).agg(*[
        F.coalesce(fn(c).cast("double"), F.lit(0.0)).alias(f"nb{name}_{c}")
        for c in columns for name, fn in (("mean", F.avg), ("max", F.max), ("std", F.stddev_samp))])
    return attach_group_stats(df, [key], stats, layout)


def neighbour_aggregate_before(
    df: DataFrame, key: str, columns: Sequence[str], at: str = "us", *, layout: Layout | None = None,
) -> DataFrame:
    """The same point in time: over the rows of the key strictly earlier than the row; 0 where there is none.

    Deviations need two earlier values.
    """
    staged = df.withColumns({f"_d_{c}": F.col(c).cast("double") for c in columns})
    out = running_stats(staged, [key], at, [f"_d_{c}" for c in columns], layout=layout)
    made = []
    for c in columns:
        n, mean, top, m2 = (F.col(f"_{p}__d_{c}") for p in ("n", "mean", "max", "m2"))
        made += [F.coalesce(mean, F.lit(0.0)).alias(f"nbmean_{c}"), F.coalesce(top, F.lit(0.0)).alias(f"nbmax_{c}"),
                 F.when(n > 1, F.sqrt(m2 / (n - 1))).otherwise(0.0).alias(f"nbstd_{c}")]
    return out.select(*df.columns, *made)


def degree_powerlaw_alpha(df: DataFrame, key: str, candidates: Sequence[int] = (1,)) -> DataFrame:
    """One row (dmin, alpha, ks, tail): the tail exponent 1 + n / sum ln(d / dmin).

    With several candidate dmin the one with the least distance between the tail and its fit is
    taken. Works on the histogram of degrees; fewer than 20 vertices give alpha 0.
    """
    histogram = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("d")).groupBy("d").agg(
        F.count(F.lit(1)).alias("c"))
    vertices = histogram.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    tail = histogram.select("d", "c", F.explode(F.array(*[F.lit(int(x)) for x in candidates])).alias("dmin")).filter("d >= dmin")
    fit = tail.groupBy("dmin").agg(
        F.sum("c").alias("tail"), F.sum(F.col("c") * F.log(F.col("d") / F.col("dmin"))).alias("_l")
    ).select("dmin", "tail", (1 + F.try_divide(F.col("tail").cast("double"), F.col("_l"))).alias("alpha"))
    scanned = running_totals(tail, ["dmin"], "d", {"_below": F.col("c")}, tie="d").join(fit, "dmin")
    fitted = 1 - F.pow(F.col("d") / F.col("dmin"), 1 - F.col("alpha"))
    gap = F.greatest(F.abs(F.col("_below") / F.col("tail") - fitted), F.abs((F.col("_below") + F.col("c")) / F.col("tail") - fitted))
    per = scanned.groupBy("dmin").agg(F.max(gap).alias("ks"), F.first("alpha").alias("alpha"), F.first("tail").alias("tail"))
    best = per.agg(F.min_by(F.struct("dmin", "alpha", "ks", "tail"), F.struct("ks", "dmin")).alias("b")).select("b.*")
    return best if vertices >= MIN_POWERLAW_VERTICES else best.withColumn("alpha", F.lit(0.0))
