"""Queries over the entity and account graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from paysieve.catalog import views as V
from paysieve.catalog.base import Catalog, r6
from paysieve.catalog.views import acct_edges, canonical, evt, pay_edges, with_views
from paysieve.operators import features as P
from paysieve.operators import graph as G

query = Catalog()

_EDGES = """
SELECT CAST(user_id AS VARCHAR) AS src_id, CAST(payee_id AS VARCHAR) AS dst_id, 'pays' AS edge_type, us FROM evt WHERE {w}
UNION ALL SELECT CAST(device_id AS VARCHAR), CAST(user_id AS VARCHAR), 'used_by', us FROM evt WHERE {w}
UNION ALL SELECT CAST(ip_id AS VARCHAR), CAST(device_id AS VARCHAR), 'hosts', us FROM evt WHERE {w}
UNION ALL SELECT CAST(agent_id AS VARCHAR), CAST(user_id AS VARCHAR), 'acts_for', us FROM evt WHERE agent_id IS NOT NULL AND {w}"""
_EDGE_SQL = ("SELECT src_id, dst_id, edge_type, min(us) AS first_us, max(us) AS last_us, count(*) AS weight FROM ("
             + _EDGES.format(w="true") + ") GROUP BY ALL")


@query("g01_edge_table", with_views("evt", _EDGE_SQL))
def _(spark, d):
    return G.edge_table(canonical(spark, d))


@query("g02_merge_edges", with_views("evt", _EDGE_SQL))
def _(spark, d):
    c = canonical(spark, d)
    return G.merge_edges(G.edge_table(c.filter("event_id % 3 = 0")), G.edge_table(c.filter("event_id % 3 <> 0")))


_EDGE_PAIRS = ("SELECT 'n' || CAST(user_id AS VARCHAR) AS src_id, 'n' || CAST((user_id + 50) % 150 AS VARCHAR) AS dst_id FROM evt")
ROUNDS = 10
_RANK = f"""
WITH e AS (SELECT src, dst, CAST(count(*) AS DOUBLE) AS w FROM acct_edges GROUP BY 1, 2),
o AS (SELECT src, sum(w) AS t FROM e GROUP BY 1), s AS (SELECT e.src, dst, w / t AS share FROM e JOIN o ON e.src = o.src),
n AS (SELECT DISTINCT id FROM (SELECT src AS id FROM e UNION ALL SELECT dst FROM e)), c AS (SELECT count(*) AS n FROM n),
r AS (SELECT 0 AS i, id, 1.0::DOUBLE / (SELECT n FROM c) AS p FROM n
  UNION ALL SELECT * FROM (WITH f AS (SELECT dst AS id, sum(p * share) AS q FROM r JOIN s ON r.id = s.src GROUP BY 1),
    d AS (SELECT coalesce(sum(p), 0) AS m FROM r WHERE id NOT IN (SELECT src FROM o))
    SELECT r.i + 1, r.id, 0.85 * (coalesce(q, 0) + (SELECT m FROM d) / (SELECT n FROM c)) + 0.15 / (SELECT n FROM c)
    FROM r LEFT JOIN f ON r.id = f.id WHERE r.i < {ROUNDS}))"""


@query("g03_pagerank", with_views("acct_edges", _RANK + f" SELECT id, round(p, 8) AS rank FROM r WHERE i = {ROUNDS}", recursive=True))
def pagerank(spark, d):
    ranks, _ = G.pagerank(acct_edges(spark, d), src="src", dst="dst", weight=None, max_iterations=ROUNDS, tolerance=0.0)
    return ranks.select("id", F.round("rank", 8).alias("rank"))


@query("g03b_pagerank_until_stable", with_views("acct_edges", _RANK.replace(f"r.i < {ROUNDS}", "r.i < 40") + """,
h AS (SELECT a.i, sum(abs(a.p - b.p)) AS change FROM r a JOIN r b ON a.id = b.id AND a.i = b.i + 1 GROUP BY 1),
z AS (SELECT min(i) AS i FROM h WHERE change < (SELECT n FROM c) * 1e-6)
SELECT id, round(p, 8) AS rank, r.i AS rounds FROM r JOIN z ON r.i = z.i""", recursive=True))
def _(spark, d):
    """Rounds until the total change is below the tolerance: both engines stop at the same one."""
    trace = []
    ranks, _ = G.pagerank(acct_edges(spark, d), src="src", dst="dst", weight=None, trace=trace)
    return ranks.select("id", F.round("rank", 8).alias("rank"), F.lit(len(trace)).alias("rounds"))


@query("g04_component_size", with_views("pay_edges", """
WITH e AS (SELECT src_id AS a, dst_id AS b FROM pay_edges UNION ALL SELECT dst_id, src_id FROM pay_edges),
r AS (SELECT DISTINCT a AS id, a AS root FROM e UNION SELECT e.b, r.root FROM r JOIN e ON r.id = e.a AND r.root < e.b),
m AS (SELECT id, min(root) AS root FROM r GROUP BY 1)
SELECT id, count(*) OVER (PARTITION BY root) AS component_size FROM m""", recursive=True))
def _(spark, d):
    return G.component_size(pay_edges(spark, d))


@query("g04b_event_components", with_views("evt", f"""
WITH e AS (SELECT src_id AS a, dst_id AS b FROM ({_EDGE_PAIRS}) UNION SELECT dst_id, src_id FROM ({_EDGE_PAIRS})),
r AS (SELECT DISTINCT a AS id, a AS root FROM e UNION SELECT e.b, r.root FROM r JOIN e ON r.id = e.a AND r.root < e.b),
m AS (SELECT id, min(root) AS root FROM r GROUP BY 1)
SELECT id, count(*) OVER (PARTITION BY root) AS component_size FROM m""", recursive=True))
def _(spark, d):
    pairs = evt(spark, d).selectExpr("concat('n', user_id) AS src_id", "concat('n', (user_id + 50) % 150) AS dst_id")
    return G.component_size(pairs)


_SIMPLE = "u AS (SELECT DISTINCT least({s}, {t}) AS a, greatest({s}, {t}) AS b FROM {e} WHERE {s} <> {t})"


@query("g05_triangles", with_views("acct_edges", f"""WITH {_SIMPLE.format(s='src', t='dst', e='acct_edges')}
SELECT count(*) AS triangles FROM u x JOIN u y ON x.b = y.a JOIN u z ON z.a = x.a AND z.b = y.b"""))
def _(spark, d):
    return G.triangles(acct_edges(spark, d), "src", "dst")


@query("g06_two_stars", with_views("pay_edges", f"""WITH {_SIMPLE.format(s='src_id', t='dst_id', e='pay_edges')},
g AS (SELECT id, count(*) AS n FROM (SELECT a AS id FROM u UNION ALL SELECT b FROM u) GROUP BY 1)
SELECT CAST(sum(n * (n - 1) / 2) AS DOUBLE) AS two_stars FROM g"""))
def _(spark, d):
    return G.two_stars(pay_edges(spark, d))


_NAMES = ["US Dollar", "Euro", "Yuan", "Rupee", "Bitcoin", "Nowhere"]
_NAME = "element_at(array({}), CAST(currency_no + 1 AS INT))".format(", ".join(f"'{n}'" for n in _NAMES))
_RATE = "([1.0, 1.09, 0.14, 0.012, 60000.0, 1.0])[currency_no + 1]"
_ENDS = """
o AS (SELECT src AS id, count(*) AS n, count(DISTINCT dst) AS u FROM acct_edges GROUP BY 1),
i AS (SELECT dst AS id, count(*) AS n, count(DISTINCT src) AS u FROM acct_edges GROUP BY 1),
p AS (SELECT DISTINCT src, dst FROM acct_edges)"""
_JOINED = """FROM acct_edges e JOIN o so ON so.id = e.src LEFT JOIN i si ON si.id = e.src JOIN i di ON di.id = e.dst
LEFT JOIN o d_o ON d_o.id = e.dst LEFT JOIN p ON p.src = e.dst AND p.dst = e.src"""


@query("g07_account_features", with_views("acct_edges", f"""WITH {_ENDS}
SELECT event_id, so.n AS src_out_degree, coalesce(si.n, 0) AS src_in_degree, coalesce(d_o.n, 0) AS dst_out_degree, di.n AS dst_in_degree,
  so.u AS src_unique_targets, di.u AS dst_unique_sources, CASE WHEN p.src IS NOT NULL THEN 1 ELSE 0 END AS is_reciprocated,
  CASE WHEN e.src = e.dst THEN 1 ELSE 0 END AS is_self_loop, round(so.n / CAST(so.u AS DOUBLE), 6) AS src_fanout_ratio,
  round(di.n / CAST(di.u AS DOUBLE), 6) AS dst_fanin_ratio, round(ln(1 + e.amount * {_RATE}), 6) AS amount_usd_log {_JOINED}"""))
def _(spark, d):
    usd = G.usd_amount(F.col("amount"), F.expr(_NAME))
    out = G.account_graph_features(acct_edges(spark, d), usd=usd)
    return out.select("event_id", "src_out_degree", "src_in_degree", "dst_out_degree", "dst_in_degree", "src_unique_targets",
                      "dst_unique_sources", "is_reciprocated", "is_self_loop", r6("src_fanout_ratio"), r6("dst_fanin_ratio"),
                      r6("amount_usd_log"))


@query("g08_motif_census", with_views("acct_edges", f"""WITH {_ENDS}
SELECT is_laundering, count(*) AS edges, count(DISTINCT e.src) AS unique_sources, count(DISTINCT e.dst) AS unique_targets,
  round(avg(so.n), 6) AS mean_src_out_degree, round(avg(di.n), 6) AS mean_dst_in_degree, max(so.n) AS max_src_out_degree,
  max(di.n) AS max_dst_in_degree, round(avg(CASE WHEN p.src IS NOT NULL THEN 1 ELSE 0 END), 6) AS reciprocated_share,
  round(avg(CASE WHEN e.src = e.dst THEN 1 ELSE 0 END), 6) AS self_loop_share,
  (SELECT count(*) FROM (SELECT src FROM acct_edges UNION SELECT dst FROM acct_edges)) AS accounts {_JOINED} GROUP BY 1"""))
def _(spark, d):
    out = G.motif_census(acct_edges(spark, d))
    digits = ["mean_src_out_degree", "mean_dst_in_degree", "reciprocated_share", "self_loop_share"]
    return out.select(*[c for c in out.columns if c not in digits], *[r6(c) for c in digits])


#: The ten graph columns over the event view, the same text for both engines; some are null.
_GRAPH_COLUMNS = dict(zip(G.GRAPH_COLUMNS, (
    "CASE WHEN k % 11 > 0 THEN CAST(k % 13 AS DOUBLE) END", "CAST(user_id % 17 AS DOUBLE)", "CAST(acquirer_id AS DOUBLE)", "score", "1 - score",
    "CAST(k % 9 + 1 AS DOUBLE)", "CAST(event_id % 23 AS DOUBLE)", "amount", "CASE WHEN user_id % 5 > 0 THEN amount / 4 END", "CASE WHEN declined = 1 THEN 1.0E0 ELSE 0.0E0 END")))
_GRAPH_VIEW = "SELECT event_id, us, payee_id, " + ", ".join(f"{e} AS {c}" for c, e in _GRAPH_COLUMNS.items()) + " FROM evt"


_OFF = "1.37E-8"  # means of short decimals end in exact halves of the last digit, which sums in another order may round otherwise


def _neighbours(frame):
    return ", ".join(f"round(coalesce({f}({c}) OVER w, 0) + {_OFF}, 6) AS nb{n}_{c}" for c in _GRAPH_COLUMNS
                     for n, f in (("mean", "avg"), ("max", "max"), ("std", "stddev_samp"))) + f" FROM g WINDOW w AS (PARTITION BY payee_id{frame})"


def _graph_rows(spark, d):
    return evt(spark, d).selectExpr("event_id", "us", "payee_id", *[f"{e} AS {c}" for c, e in _GRAPH_COLUMNS.items()])


def _rounded(df):
    return df.select("event_id", *[F.round(F.col(f"nb{n}_{c}") + float(_OFF), 6).alias(f"nb{n}_{c}") for c in _GRAPH_COLUMNS for n in ("mean", "max", "std")])


@query("g09_neighbour_aggregate", with_views("evt", f"WITH g AS ({_GRAPH_VIEW}) SELECT event_id, {_neighbours('')}"))
def _(spark, d):
    return _rounded(G.neighbour_aggregate(_graph_rows(spark, d), "payee_id", G.GRAPH_COLUMNS))


@query("g09b_neighbours_before", with_views("evt", f"""WITH g AS ({_GRAPH_VIEW})
SELECT event_id, {_neighbours(" ORDER BY us RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING")}"""))
def _(spark, d):
    return _rounded(G.neighbour_aggregate_before(_graph_rows(spark, d), "payee_id", G.GRAPH_COLUMNS))


@query("g10_powerlaw_alpha", with_views("ord", """
WITH g AS (SELECT payer_id, count(*) AS d FROM ord GROUP BY 1),
t AS (SELECT m AS dmin, d, count(*) AS c FROM g, (VALUES (3), (6), (9)) v(m) WHERE d >= m GROUP BY 1, 2),
f AS (SELECT dmin, CAST(sum(c) AS DOUBLE) AS n, 1 + sum(c) / sum(c * ln(d / CAST(dmin AS DOUBLE))) AS alpha FROM t GROUP BY 1),
k AS (SELECT t.dmin, alpha, n, d, c, sum(c) OVER (PARTITION BY t.dmin ORDER BY d) AS upto FROM t JOIN f USING (dmin)),
x AS (SELECT dmin, alpha, n, max(greatest(abs((upto - c) / n - (1 - pow(d / CAST(dmin AS DOUBLE), 1 - alpha))),
   abs(upto / n - (1 - pow(d / CAST(dmin AS DOUBLE), 1 - alpha))))) AS ks FROM k GROUP BY ALL)
SELECT dmin, round(alpha, 6) AS alpha, round(ks, 6) AS ks, CAST(n AS BIGINT) AS tail FROM x ORDER BY x.ks, dmin LIMIT 1"""))
def _(spark, d):
    return G.degree_powerlaw_alpha(V.ord_(spark, d), "payer_id", (3, 6, 9)).select("dmin", r6("alpha"), r6("ks"), "tail")


@query("f14_graph_lookups", with_views("acct_edges", _RANK + f"""
SELECT event_id, round(coalesce(a.p, 0), 8) AS payer_pagerank, round(coalesce(b.p, 0), 8) AS payee_pagerank, CASE WHEN user_id % 3 <> 0 THEN user_id % 7 + 2.0::DOUBLE ELSE 1.0::DOUBLE END AS component_size
FROM evt LEFT JOIN (SELECT * FROM r WHERE i = {ROUNDS}) a ON a.id = user_id LEFT JOIN (SELECT * FROM r WHERE i = {ROUNDS}) b ON b.id = payee_id + 120""",
    recursive=True))
def _(spark, d):
    ranks, _ = G.pagerank(acct_edges(spark, d), src="src", dst="dst", weight=None, max_iterations=ROUNDS, tolerance=0.0)
    parts = canonical(spark, d).filter("payer_entity_id % 3 <> 0").selectExpr(
        "payer_entity_id AS entity_id", "CAST(payer_entity_id % 7 + 2 AS DOUBLE) AS component_size").distinct()
    context = P.FeatureContext(pagerank=ranks.withColumnRenamed("id", "entity_id"), components=parts)
    df = canonical(spark, d).withColumn("payee_entity_id", F.col("payee_entity_id") + 120)
    return P.graph_lookups(df, context).select(
        "event_id", F.round("payer_pagerank", 8).alias("payer_pagerank"), F.round("payee_pagerank", 8).alias("payee_pagerank"),
        F.col("component_size"))
