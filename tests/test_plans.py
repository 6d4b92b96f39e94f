import pytest
from pyspark.sql import functions as F

from paysieve.catalog import features_q as FQ
from paysieve.catalog.views import canonical
from paysieve.operators import external as X
from paysieve.operators import features as P
from paysieve.operators import graph as G
from paysieve.operators import realism as R
from paysieve.operators import splits as S
from paysieve.operators import windows as W
from paysieve.plans.scan import order_statistic, previous_row, rank_in_group
from paysieve.plans.skew import plan_layout, plan_layouts

SF_DIR = "/root/testdata/sf0.001"


def texts(spark, n=60):
    return spark.range(n).select(F.format_string("user-%05d", F.col("id") * 7).alias("uid"), (F.col("id") % 3).alias("g"), F.lit(5).alias("same"))


def test_text_order_columns_are_cut_into_slices(spark, small_tasks):
    df = texts(spark)
    layout = plan_layout(df, [], F.col("uid"))
    assert layout.spread and layout.skip >= len("user-00")
    ranks = {r.uid: r.rank for r in rank_in_group(df, [], "uid", "uid").collect()}
    assert [ranks[u] for u in sorted(ranks)] == list(range(1, 61))
    before = {r.uid: r.p for r in previous_row(df, ["g"], "uid", "uid", {"p": F.col("uid")}).collect()}
    by_group = {u: [v for v in sorted(ranks) if v < u and int(v[5:]) // 7 % 3 == int(u[5:]) // 7 % 3] for u in ranks}
    assert before == {u: (x[-1] if x else None) for u, x in by_group.items()}


def test_cohort_and_cuts_on_texts_and_ties(spark, small_tasks):
    df = texts(spark)
    marked = S.mark_last_fraction(df, "uid", 0.25)
    assert sorted(r.uid for r in marked.filter("in_cohort").collect()) == sorted(r.uid for r in df.collect())[45:]
    first, rest = S.positional_cut(df, "same", "uid", 0.5)  # every row has the same time
    assert first.count() == rest.count() == 30
    assert order_statistic(df, "same", "uid", 1)[1] == "user-00000"


def test_sets_of_keys_are_measured_in_one_job(spark):
    df = texts(spark)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("sets", "")
    found = plan_layouts(df, {"g": ["g"], "uid": ["uid"], "both": ["g", "same"], "absent": ["x"]}, F.col("uid"))
    jobs = len(tracker.getJobIdsForGroup("sets"))
    spark.sparkContext.setJobGroup("", "")
    assert {n: (x.rows, x.largest) for n, x in found.items()} == {"g": (60, 20), "uid": (60, 1), "both": (60, 20)} and jobs <= 3


@pytest.mark.parametrize("build", ["inside", "outside"])
def test_feature_matrices_measure_their_input_twice_at_most(spark, build):
    df, context = canonical(spark, SF_DIR), FQ.context(spark, SF_DIR)
    df = df.withColumns({"payer_lat": F.lit(0.0), "payer_lon": F.lit(0.0)})
    spark.sparkContext.setJobGroup(build, "")
    out = P.compute_features(df, context) if build == "inside" else X.compute_features_external(df)
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup(build)
    spark.sparkContext.setJobGroup("", "")
    assert len(out.columns) - 1 == (151 if build == "inside" else 129)
    assert len(jobs) <= 6, jobs  # two actions; adaptive execution runs each stage as a job of its own


def test_components_of_a_long_path(spark):
    path = spark.range(400).select(F.col("id").alias("src_id"), (F.col("id") + 1).alias("dst_id"))
    sizes = {r.component_size for r in G.component_size(path).collect()}
    assert sizes == {401}
    with pytest.raises(RuntimeError):
        G.connected_components(path, max_iterations=1)


def test_closest_record_with_text_ids_and_separate_periods(spark):
    def side(first, n):
        return spark.range(n).select(F.concat(F.lit("e"), F.col("id")).alias("_id"), (F.col("id") * 37 % 101 / 10.0).alias("amount"),
                                     (F.col("id") * 53 % 24).cast("double").alias("hour_of_day"), (F.col("id") * 1.5 + first).alias("event_epoch"))

    batch, reference = side(100_000.0, 400), side(0.0, 400)
    names = ["amount", "hour_of_day", "event_epoch"]
    got = R.closest_record(batch, reference).first()[0]
    a, b = (x.select(*names).toPandas() for x in (batch, reference))
    scale = b.std(ddof=0)
    near = min((((x - b) / scale) ** 2).sum(axis=1).min() ** 0.5 for _, x in a.iterrows())
    assert got == pytest.approx(near, rel=1e-9)


def test_large_bessel_arguments(spark):
    from paysieve.functions.numeric import bessel_i0

    row = spark.range(1).select(*[bessel_i0(F.lit(x)).alias(f"b{int(x)}") for x in (4.0, 14.0, 16.0, 40.0, 60.0)]).first()
    want = {"b4": 11.301921952136330, "b14": 129418.56270064855, "b16": 893446.2279201050, "b40": 1.4894774793419899e16, "b60": 5.894077055609803e24}
    assert all(row[k] == pytest.approx(v, rel=1e-6) for k, v in want.items())


def test_velocity_is_the_same_under_both_plans(spark):
    df = spark.range(300).select(F.col("id").alias("event_id"), (F.col("id") * 7_000_000).alias("us"), (F.col("id") % 7).alias("a"), (F.col("id") % 90).alias("c"))
    args = (df, "event_id", "us", F.col("c"), F.lit(0), {"a": "a"}, {"60s": W.MINUTE, "10min": 10 * W.MINUTE})
    sliding, running = (sorted(map(tuple, W.velocity_block(*args, method=m).collect())) for m in ("sliding", "running"))
    assert sliding == running


def test_slices_of_two_levels_keep_their_size(spark, monkeypatch):
    """Three quantiles at a time and seven rows a task: 400 rows of one key still lie in slices of about seven."""
    from paysieve.operators import windows as W
    from paysieve.plans import skew

    monkeypatch.setattr(skew, "MAX_CHUNKS", 3)
    monkeypatch.setattr(skew, "DEFAULT_ROWS_PER_TASK", 45)
    df = spark.range(400).select(F.col("id").alias("event_id"), (F.col("id") * 1_000_000).alias("us"), F.lit(1).alias("key"), (F.col("id") * 37 % 101).alias("x"))
    layout = skew.plan_layout(df, ["key"], F.col("us"))
    assert layout.spread and layout.salts == 9
    sizes = [r["count"] for r in skew.with_chunks(df, ["key"], F.col("us"), layout).groupBy(skew.CHUNK).count().collect()]
    assert sum(sizes) == 400 and len(sizes) == 9 and max(sizes) <= 50
    got = {r.event_id: r["sum"] for r in W.pit_sum(df, ["key"], "us", 30_000_000, F.col("x"), method="running", layout=layout).collect()}
    assert got == {i: sum(j * 37 % 101 for j in range(max(0, i - 30), i)) for i in range(400)}


def test_rounds_are_dealt_by_rows_not_by_files(spark):
    from paysieve.plans.skew import for_rounds

    one_file, many_files = spark.range(200_000).coalesce(1), spark.range(0, 200_000, 1, 300)
    assert [for_rounds(d, 200_000).rdd.getNumPartitions() for d in (one_file, many_files)] == [5, 5]
    assert for_rounds(one_file, 20_000_000).rdd.getNumPartitions() == 40
    assert for_rounds(one_file, 1_000).rdd.getNumPartitions() == 1


def test_components_measure_no_group_by_itself(spark, monkeypatch):
    """The least vertex and the size of a group come from one aggregate, hot vertices too; every table of a round is stored once."""
    from paysieve.operators import graph as G
    from paysieve.plans import skew

    edges = spark.range(40).selectExpr("concat('n', IF(id < 20, 0, id)) AS src_id", "concat('n', IF(id < 30, id + 1, id)) AS dst_id")
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for s, t in edges.collect():
        a, b = sorted((root(s), root(t)))
        parent[b] = a
    monkeypatch.setattr(skew, "plan_layout", lambda *a: pytest.fail("groups counted by themselves"))
    for limit in ("2000000", "3"):
        spark.conf.set("paysieve.rowsPerTask", limit)
        try:
            got = {r["id"]: r["component"] for r in G.connected_components(edges).collect()}
        finally:
            spark.conf.unset("paysieve.rowsPerTask")
        assert got == {x: root(x) for x in list(parent)}


def test_whole_matrix_is_never_broadcast(spark):
    """Both sides of the last join hold a row per event; a small file says little about them."""
    out = P.compute_features(canonical(spark, "/root/testdata/sf0.001"))
    assert "strategy=merge" in out._jdf.queryExecution().optimizedPlan().toString()


def test_wide_rows_take_no_exchange(spark):
    """The last join comes before an event's block is wide, and gives what a join with the whole block gives."""
    df = canonical(spark, "/root/testdata/sf0.001")
    plan = P.compute_features(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("side_by_side") < plan.index("strategy=merge")
    base = df.selectExpr("event_id", "unix_micros(event_ts) AS us", "amount_c", "payer_entity_id AS a", "payee_entity_id AS b", "event_ts")
    some = base.filter("event_id % 3 > 0").selectExpr("event_id", "event_ts", "IF(event_id % 2 = 0, a, NULL) AS more")
    block = lambda **kw: W.velocity_block(base, "event_id", "us", F.col("amount_c"), F.lit(None), {"a": "a", "b": "b"}, **kw)
    got, want = block(beside=some), block().join(some, "event_id")
    want = want.select(*[F.col(c).cast("float").alias(c) if t == "double" else c for c, t in want.dtypes])
    assert got.dtypes == want.dtypes and got.columns == want.columns and got.count() == some.count() and got.exceptAll(want).count() == 0
