"""Queries over the realism layers."""

from __future__ import annotations

from pyspark.sql import functions as F

from paysieve.catalog import views as V
from paysieve.catalog.base import Catalog, r6
from paysieve.catalog.splits_q import RAIL_SQL
from paysieve.catalog.views import acct_edges, canonical, evt, with_views
from paysieve.catalog.windows_q import AUTOCORR_SQL
from paysieve.operators import realism as L

query = Catalog()


def sides(spark, d):
    c = canonical(spark, d).withColumns({"amount_c": F.col("amount_c"), "currency": F.concat(F.lit("C"), (F.col("k") % 6).cast("string"))})
    return c.filter("payer_entity_id % 2 = 1"), c.filter("payer_entity_id % 2 = 0")


_NUM = """num AS (SELECT event_id, us, user_id, amount AS amount, log10(greatest(amount, 0.01)) AS log_amount, CAST((us // 3600000000) % 24 AS DOUBLE) AS hour_of_day,
  CAST((us // 86400000000 + 3) % 7 AS DOUBLE) AS day_of_week, CAST(CAST(cross_border AS INT) AS DOUBLE) AS cross_border_num,
  CAST(declined AS DOUBLE) AS is_decline, user_id % 2 AS side, is_fraud FROM evt)"""
_COLS = ["amount", "log_amount", "hour_of_day", "day_of_week", "cross_border_num", "is_decline"]


@query("l00_numeric_view", with_views("evt", f"""WITH {_NUM}
SELECT event_id, round(amount, 6) AS amount, round(log_amount, 6) AS log_amount, hour_of_day, day_of_week, cross_border_num, is_decline FROM num"""))
def _(spark, d):
    out = L.numeric_view(canonical(spark, d), ["event_id"])
    return out.select("event_id", r6("amount"), r6("log_amount"), *_COLS[2:])


_KS = f"""
un AS ({" UNION ALL ".join(f"SELECT '{c}' AS col, {c} AS v, side FROM num WHERE side = 0 OR is_fraud = 0 OR NOT only_legit" for c in _COLS)}),
cn AS (SELECT col, v, count(*) FILTER (WHERE side = 1) AS a, count(*) FILTER (WHERE side = 0) AS b FROM un GROUP BY 1, 2),
rn AS (SELECT col, sum(a) OVER w AS ca, sum(b) OVER w AS cb, sum(a) OVER (PARTITION BY col) AS na, sum(b) OVER (PARTITION BY col) AS nb
  FROM cn WINDOW w AS (PARTITION BY col ORDER BY v)),
ks AS (SELECT col, max(abs(CAST(ca AS DOUBLE) / na - CAST(cb AS DOUBLE) / nb)) AS d FROM rn GROUP BY 1),
kp AS (SELECT col, d, CASE WHEN d * sqrt(250) < 0.2 THEN 1.0 ELSE least(greatest(2 * list_sum(list_transform(range(1, 51),
  lambda k: (CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END) * exp(-2.0 * k * k * d * d * 250))), 0), 1) END AS p FROM ks)"""


def _num(only_legit):
    return _NUM.replace("user_id % 2 AS side", f"{str(only_legit).lower()} AS only_legit, user_id % 2 AS side")


@query("l01_ks_two_sample", with_views("evt", f"""WITH {_num(False)}, {_KS}
SELECT col AS "column", round(d, 6) AS statistic, round(p, 6) AS p_value FROM kp"""))
def ks(spark, d):
    batch, reference = sides(spark, d)
    out = L.ks_two_sample(L.numeric_view(batch), L.numeric_view(reference))
    return out.select("column", r6("statistic"), r6("p_value"))


@query("l02_ks_reference_p", with_views("evt", """
SELECT event_id, round(CASE WHEN score * sqrt(250) < 0.2 THEN 1.0 ELSE least(greatest(2 * list_sum(list_transform(range(1, 51),
  lambda k: (CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END) * exp(-2.0 * k * k * score * score * 250))), 0), 1) END, 6) AS p_value FROM evt"""))
def _(spark, d):
    return evt(spark, d).select("event_id", F.round(L.ks_reference_p(F.col("score")), 6).alias("p_value"))


_HASH = "(event_id * 7919) % 10007"


def _benford_sql(where):
    return f"""
dg AS (SELECT CAST(left(CAST(amount_c AS VARCHAR), 1) AS INT) AS digit FROM evt WHERE amount_c > 0 AND {where}),
ex AS (SELECT i AS digit, log10(1 + 1.0 / i) AS e FROM range(1, 10) r(i)),
ds AS (SELECT e, coalesce(n, 0) / CAST((SELECT count(*) FROM dg) AS DOUBLE) AS share FROM ex LEFT JOIN (SELECT digit, count(*) AS n FROM dg GROUP BY 1) USING (digit)),
bm AS (SELECT avg(abs(share - e)) AS mad FROM ds),
bc AS (SELECT least((SELECT count(*) FROM dg), 5000) * sum(pow(share - e, 2) / e) AS chi2 FROM ds)"""


@query("l03_benford", with_views("evt", f"WITH {_benford_sql('true')} SELECT round(chi2, 5) AS chi2, round(mad, 6) AS mad FROM bm, bc"))
def _(spark, d):
    out = L.benford(evt(spark, d))
    return out.select(r6("chi2", 5), r6("mad"))


@query("l04_marginal_layer", with_views("evt", f"""WITH {_num(True)}, {_KS}, {_benford_sql('user_id % 2 = 1 AND is_fraud = 0')},
s AS (SELECT count(*) FILTER (WHERE d < 0.1 AND p > 0.05) / 6.0 AS share, max(d) AS worst FROM kp),
v AS (SELECT *, share >= 0.9 AND chi2 < 15.507 AND mad <= 0.006 AS passed FROM s, bm, bc)
SELECT 'ks_column_pass_frac' AS metric, round(share, 5) AS value, passed FROM v UNION ALL SELECT 'ks_worst_statistic', round(worst, 5), passed FROM v
UNION ALL SELECT 'benford_chi2', round(chi2, 5), passed FROM v UNION ALL SELECT 'benford_mad', round(mad, 5), passed FROM v"""))
def _(spark, d):
    batch, reference = sides(spark, d)
    out = L.marginal_layer(batch, reference)
    return out.select("metric", r6("value", 5), "passed")


_PAIRS = [(x, y) for i, x in enumerate(_COLS) for y in _COLS[i + 1:]]
_PCD = f"""cr AS (SELECT side, {", ".join(f"corr({x}, {y}) AS r{i}" for i, (x, y) in enumerate(_PAIRS))} FROM num GROUP BY side),
pc AS (SELECT sqrt(({" + ".join(f"pow(coalesce(a.r{i} - b.r{i}, 0), 2)" for i in range(len(_PAIRS)))}) / {len(_PAIRS)}) AS pcd
  FROM cr a JOIN cr b ON a.side = 1 AND b.side = 0)"""


@query("l05_pcd", with_views("evt", f"WITH {_NUM}, {_PCD} SELECT round(pcd, 6) AS pcd FROM pc"))
def _(spark, d):
    batch, reference = sides(spark, d)
    return L.pcd(L.numeric_view(batch), L.numeric_view(reference)).select(r6("pcd"))


@query("l06_cramers_v", """
WITH c AS (SELECT quality AS x, toxic AS y, count(*) AS n FROM labels GROUP BY 1, 2),
r AS (SELECT x, sum(n) AS r FROM c GROUP BY 1), k AS (SELECT y, sum(n) AS k FROM c GROUP BY 1)
SELECT round(sqrt((sum(CAST(n AS DOUBLE) * n / (r * k)) - 1) / (least((SELECT count(*) FROM r), (SELECT count(*) FROM k)) - 1)), 6) AS v
FROM c JOIN r USING (x) JOIN k USING (y)""")
def _(spark, d):
    return L.cramers_v(V.table(spark, d, "labels"), "quality", "toxic").select(r6("v"))


_CATS = {"rail": RAIL_SQL, "mcc": "mcc", "response_code": "response_code", "currency": "'C' || CAST(k % 6 AS VARCHAR)"}
_CAT_PAIRS = [(x, y) for i, x in enumerate(_CATS) for y in list(_CATS)[i + 1:]]
_CV = f"""
ct AS ({" UNION ALL ".join(f"SELECT '{x}|{y}' AS pair, user_id % 2 AS side, CAST({_CATS[x]} AS VARCHAR) AS x, CAST({_CATS[y]} AS VARCHAR) AS y, is_fraud FROM evt" for x, y in _CAT_PAIRS)}),
ce AS (SELECT pair, side, x, y, count(*) AS n FROM ct WHERE side = 0 OR is_fraud = 0 OR NOT {{legit}} GROUP BY ALL),
cx AS (SELECT pair, side, x, sum(n) AS r FROM ce GROUP BY ALL), cy AS (SELECT pair, side, y, sum(n) AS k FROM ce GROUP BY ALL),
cv AS (SELECT pair, side, sqrt(greatest(sum(CAST(n AS DOUBLE) * n / (r * CAST(k AS DOUBLE))) - 1, 0) / (least(count(DISTINCT x), count(DISTINCT y)) - 1)) AS v
  FROM ce JOIN cx USING (pair, side, x) JOIN cy USING (pair, side, y) GROUP BY ALL)"""


@query("l07_cramers_v_delta", with_views("evt", f"""WITH {_CV.format(legit='false')}
SELECT a.pair, round(a.v, 6) AS batch_v, round(b.v, 6) AS reference_v, round(abs(a.v - b.v), 6) AS delta FROM cv a JOIN cv b
ON a.pair = b.pair AND a.side = 1 AND b.side = 0"""))
def _(spark, d):
    batch, reference = sides(spark, d)
    return L.cramers_v_delta(batch, reference).select("pair", r6("batch_v"), r6("reference_v"), r6("delta"))


@query("l07b_joint_layer", with_views("evt", f"""WITH {_NUM.replace('FROM evt)', 'FROM evt WHERE user_id % 2 = 0 OR is_fraud = 0)')}, {_PCD}, {_CV.format(legit='true')},
dv AS (SELECT max(abs(a.v - b.v)) AS dv FROM cv a JOIN cv b ON a.pair = b.pair AND a.side = 1 AND b.side = 0)
SELECT 'pcd' AS metric, round(pcd, 5) AS value, pcd < 0.15 AND dv < 0.1 AS passed FROM pc, dv
UNION ALL SELECT 'cramers_v_max_delta', round(dv, 5), pcd < 0.15 AND dv < 0.1 FROM pc, dv"""))
def _(spark, d):
    batch, reference = sides(spark, d)
    return L.joint_layer(batch, reference).select("metric", r6("value", 5), "passed")


def _sd(key, side):
    return f"""(SELECT stddev_samp(g) FROM (SELECT (us - lag(us) OVER (PARTITION BY {key} ORDER BY us, event_id)) / CAST(1000000 AS DOUBLE) AS g
  FROM evt WHERE {key} IS NOT NULL AND user_id % 2 = {side}))"""


_VEL = " UNION ALL ".join(
    f"SELECT '{n}' AS key, {_sd(c, 1)} AS a, {_sd(c, 0)} AS b" for n, c in
    (("device_id", "device_id"), ("pan_token", "pan_id"), ("merchant_id", "payee_id")))


@query("l08_velocity_ratios", with_views("evt", f"""WITH s AS ({_VEL})
SELECT key, 'ok' AS status, round(greatest(a / b, b / a), 6) AS ratio FROM s UNION ALL SELECT 'terminal', 'not_comparable', NULL"""))
def _(spark, d):
    batch, reference = sides(spark, d)
    return L.velocity_ratios(batch, reference, ("device_id", "pan_token", "merchant_id", "terminal")).select("key", "status", r6("ratio"))


_MOT = """
u{s} AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM acct_edges WHERE src <> dst AND event_id % 2 = {s}),
t{s} AS (SELECT CAST(count(*) AS DOUBLE) AS t FROM u{s} x JOIN u{s} y ON x.b = y.a JOIN u{s} z ON z.a = x.a AND z.b = y.b),
d{s} AS (SELECT CAST(sum(n * (n - 1) / 2) AS DOUBLE) AS s FROM (SELECT count(*) AS n FROM (SELECT a AS id FROM u{s} UNION ALL SELECT b FROM u{s}) GROUP BY id))"""


@query("l09_motif_ratio", with_views("acct_edges", f"""WITH {_MOT.format(s=0)}, {_MOT.format(s=1)}
SELECT t0.t AS t_real, d0.s AS s_real, t1.t AS t_synth, d1.s AS s_synth, round(greatest(greatest(t0.t, 1) / greatest(t1.t, 1), greatest(t1.t, 1) / greatest(t0.t, 1),
  d0.s / d1.s, d1.s / d0.s), 6) AS ratio FROM t0, d0, t1, d1"""))
def _(spark, d):
    a = acct_edges(spark, d)
    out = L.motif_ratio(a.filter("event_id % 2 = 1"), a.filter("event_id % 2 = 0"), "src", "dst")
    return out.select("t_real", "s_real", "t_synth", "s_synth", r6("ratio"))


def _auto(side):
    text = AUTOCORR_SQL.format(key="user_id", src=f"(SELECT * FROM evt WHERE user_id % 2 = {side})")
    for n in ("g AS", "p AS", "a AS", "FROM g", "FROM p"):
        text = text.replace(n, n.replace(n.split()[0], n.split()[0] + str(side), 1) if n.endswith("AS") else n + str(side))
    return text.strip(), f"(SELECT coalesce(sum(corr * (gaps - 1)) / sum(gaps - 1), 0) FROM a{side} WHERE NOT isnan(corr))"


@query("l10_autocorrelation_ratio", with_views("evt", f"""WITH {_auto(0)[0]}, {_auto(1)[0]},
x AS (SELECT {_auto(1)[1]} AS s, {_auto(0)[1]} AS r)
SELECT round(s, 6) AS synthetic, round(r, 6) AS real, round(CASE WHEN s < 0.01 THEN 20 ELSE greatest(r / s, s / greatest(r, 0.01)) END, 5) AS ratio FROM x"""))
def _(spark, d):
    batch, reference = sides(spark, d)
    out = L.autocorrelation_ratio(batch, reference, "payer_entity_id")
    return out.select(r6("synthetic"), r6("real"), r6("ratio", 5))


@query("l11_behavioural_layer", with_views("evt", f"""WITH s AS ({_VEL}), v AS (SELECT key, greatest(a / b, b / a) AS ratio FROM s),
{_auto(0)[0]}, {_auto(1)[0]}, x AS (SELECT {_auto(1)[1]} AS s, {_auto(0)[1]} AS r),
au AS (SELECT CASE WHEN s < 0.01 THEN 20 ELSE greatest(r / s, s / greatest(r, 0.01)) END AS ratio FROM x),
{_MOT.format(s=0).replace('src', 'p').replace('dst', 'q').replace('acct_edges', 'pq')}, {_MOT.format(s=1).replace('src', 'p').replace('dst', 'q').replace('acct_edges', 'pq')},
mo AS (SELECT greatest(greatest(t0.t, 1) / greatest(t1.t, 1), greatest(t1.t, 1) / greatest(t0.t, 1), d0.s / d1.s, d1.s / d0.s) AS ratio FROM t0, d0, t1, d1),
al AS (SELECT ratio FROM v UNION ALL SELECT ratio FROM au UNION ALL SELECT ratio FROM mo),
c AS (SELECT CASE WHEN (SELECT ratio FROM au) >= 20 THEN greatest(exp(avg(ln(ratio))), 20) ELSE exp(avg(ln(ratio))) END AS composite FROM al)
SELECT 'composite' AS metric, round(composite, 5) AS value, composite < 10 AS passed FROM c
UNION ALL SELECT 'graph_motif', round(ratio, 5), (SELECT composite < 10 FROM c) FROM mo
UNION ALL SELECT 'iet_autocorr', round(ratio, 5), (SELECT composite < 10 FROM c) FROM au
UNION ALL SELECT 'velocity_' || key, round(ratio, 5), (SELECT composite < 10 FROM c) FROM v""".replace(
    "WITH s AS", "WITH pq AS (SELECT CAST(user_id AS VARCHAR) AS p, 'M' || CAST(payee_id AS VARCHAR) AS q, user_id % 2 AS event_id FROM evt), s AS", 1)))
def _(spark, d):
    batch, reference = (x.withColumns({"p": F.col("payer_entity_id").cast("string"), "q": F.concat(F.lit("M"), "payee_entity_id")})
                        for x in sides(spark, d))
    out = L.behavioural_layer(batch, reference, autocorr_key="payer_entity_id", src="p", dst="q")
    return out.select("metric", r6("value", 5), "passed")


_PROX = ["amount", "log_amount", "hour_of_day", "day_of_week", "cross_border_num", "is_decline", "ep"]


@query("l14_closest_record", with_views("evt", f"""WITH {_NUM}, n2 AS (SELECT *, us / CAST(1000000 AS DOUBLE) AS ep FROM num),
st AS (SELECT {", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in _PROX)} FROM n2 WHERE side = 0),
z AS (SELECT side, {", ".join(f"({c} - m_{c}) / s_{c} AS {c}" for c in _PROX)} FROM n2, st)
SELECT round(sqrt(min({" + ".join(f"(a.{c} - b.{c}) * (a.{c} - b.{c})" for c in _PROX)})), 6) AS min_distance FROM z a JOIN z b ON a.side = 1 AND b.side = 0"""))
def _(spark, d):
    batch, reference = (L.proximity_view(x) for x in sides(spark, d))
    return L.closest_record(batch, reference).select(r6("min_distance"))


@query("l17_share_difference", with_views("evt", f"""
WITH c AS ({" UNION ALL ".join(f"SELECT '{n}' AS col, CAST({e} AS VARCHAR) AS v, user_id % 2 AS side FROM evt" for n, e in _CATS.items())}),
n AS (SELECT col, v, CAST(count(*) FILTER (WHERE side = 1) AS DOUBLE) AS a, CAST(count(*) FILTER (WHERE side = 0) AS DOUBLE) AS b FROM c GROUP BY 1, 2),
t AS (SELECT col, sum(a) AS ta, sum(b) AS tb FROM n GROUP BY 1)
SELECT col AS "column", round(max(abs(a / ta - b / tb)), 6) AS max_abs_difference FROM n JOIN t USING (col) WHERE b > 0 GROUP BY 1"""))
def _(spark, d):
    return L.share_difference(*sides(spark, d)).select("column", r6("max_abs_difference"))


@query("l17b_top_shares_decline", with_views("evt", f"""
SELECT 'top' AS kind, mcc AS value, round(count(*) / CAST((SELECT count(*) FROM evt) AS DOUBLE), 6) AS share FROM evt GROUP BY mcc ORDER BY count(*) DESC, mcc LIMIT 4
""".replace("\nSELECT 'top'", "\nWITH tp AS (SELECT 'top'").rstrip() + f""")
SELECT * FROM tp UNION ALL SELECT 'decline', {RAIL_SQL}, round(avg(declined), 6) FROM evt GROUP BY 2"""))
def _(spark, d):
    c = canonical(spark, d)
    top = L.top_shares(c, "mcc").select(F.lit("top").alias("kind"), "value", r6("share"))
    return top.unionByName(L.decline_rate_by_rail(c).select(F.lit("decline").alias("kind"), F.col("rail").alias("value"),
                                                            F.round("decline_rate", 6).alias("share")))


def _hist(name, value, bins, low, high, src):
    return f"""(WITH h AS (SELECT {value} AS v FROM {src}), k AS (SELECT CAST(least(floor((v - {low}) / (({high} - {low}) / {float(bins)})), {bins - 1}) AS INT) AS bin, count(*) AS n
  FROM h WHERE v BETWEEN {low} AND {high} GROUP BY 1) SELECT '{name}' AS measure, bin, round(n / CAST((SELECT sum(n) FROM k) AS DOUBLE) / (({high} - {low}) / {float(bins)}), 6) AS density FROM k)"""


@query("l19_histograms", with_views("evt", " UNION ALL ".join([
    _hist("amount", "log10(greatest(amount, 0.01))", 40, -1.0, 5.0, "evt"),
    _hist("hour_of_day", "CAST((us // 3600000000) % 24 AS DOUBLE)", 24, 0.0, 24.0, "evt"),
    _hist("interarrival", "log10(greatest(g, 1.0))", 40, 0.0, 6.0,
          "(SELECT (us - lag(us) OVER (PARTITION BY user_id ORDER BY us, event_id)) / CAST(1000000 AS DOUBLE) AS g FROM evt) WHERE g IS NOT NULL"),
    _hist("merchant_degree", "log10(greatest(CAST(d AS DOUBLE), 1.0))", 30, 0.0, 5.0, "(SELECT count(*) AS d FROM evt GROUP BY payee_id)"),
]))
)
def _(spark, d):
    return L.distribution_histograms(canonical(spark, d)).select("measure", "bin", r6("density"))


@query("l20_realism_checks", with_views("evt", """
WITH h AS (SELECT (us // 3600000000) % 24 AS h, count(*) AS n FROM evt GROUP BY 1),
g AS (SELECT (us - lag(us) OVER (PARTITION BY user_id ORDER BY us, event_id)) / CAST(1000000 AS DOUBLE) AS g FROM evt),
m AS (SELECT avg(g) AS m FROM g WHERE g IS NOT NULL)
SELECT round((SELECT sum(n) FILTER (WHERE h IN (1, 2, 3, 4)) / 4.0 / sum(n) FROM h), 6) AS night_share, round((SELECT max(n) / CAST(sum(n) AS DOUBLE) FROM h), 6) AS peak_share,
  round(avg(1 - declined), 6) AS approval_rate, CAST(1 AS DOUBLE) AS share_05, CAST(0 AS DOUBLE) AS share_51, round(avg(is_fraud), 6) AS prevalence,
  round((SELECT avg(pow(g - m, 4)) / pow(avg(pow(g - m, 2)), 2) FROM g, m WHERE g IS NOT NULL), 4) AS gap_kurtosis FROM evt"""))
def _(spark, d):
    out = L.realism_checks(canonical(spark, d))
    return out.select(r6("night_share"), r6("peak_share"), r6("approval_rate"), "share_05", "share_51", r6("prevalence"),
                      r6("gap_kurtosis", 4))
