"""The registered queries of this subpackage: one for each operator, over its whole table, and the pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paysieve.catalog.base import Catalog
from paysieve.llm import decontaminate, hard_negatives, html_text, line_dedup, mixing, near_dedup, packing, quality_rules, quality_votes, ranked_search, secret_scan, substring_dedup, token_counts

query = Catalog()
VOCABULARY = "piece_bpe_32k.model"
PACKED_WITH = "byte_bpe_50k.json"
TOKENIZERS = "/opt/tokenizers"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _digest(column: str):
    return F.sha2(F.col(column), 256).alias("kept_sha256")


_WORDS = r"regexp_extract_all(text, '[^\x20\x09-\x0D]+')"


@query("op1_substring_dedup", rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM d, unnest(generate_series(1, len(w) - 34)) AS t(i)),
many AS (SELECT h FROM win GROUP BY h HAVING count(*) > 1),
bad AS (SELECT DISTINCT doc_id, i + j AS p FROM win JOIN many USING (h), unnest(generate_series(0, 34)) AS t(j)),
gone AS (SELECT doc_id, list(p) AS g FROM bad GROUP BY 1),
k AS (SELECT d.doc_id, w, coalesce(g, []) AS g FROM d LEFT JOIN gone ON d.doc_id = gone.doc_id)
SELECT doc_id, coalesce(len(w), 0) AS n_words, CAST(len(g) AS BIGINT) AS n_removed, sha256(array_to_string(
  [w[i] FOR i IN generate_series(1, len(w)) IF NOT list_contains(g, i)], ' ')) AS kept_sha256 FROM k""")
def _(spark, d):
    return substring_dedup.dedup(_table(spark, d, "documents")).select("doc_id", "n_words", "n_removed", _digest("kept"))


@query("op2_near_dedup")
def _(spark, d):
    return near_dedup.classes(_table(spark, d, "documents"))


@query("op3_line_dedup", r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT doc_id, x, i, translate(trim(x, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
      FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d)),
c AS (SELECT k, max(doc_id) AS keeper FROM l WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT l.doc_id, x, i, (c.k IS NOT NULL AND l.doc_id <> keeper) AS gone FROM l LEFT JOIN c ON l.k = c.k)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(x, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM m GROUP BY doc_id""")
def _(spark, d):
    return line_dedup.dedup(_table(spark, d, "documents")).select("doc_id", "n_lines", "n_dropped", _digest("kept"))


@query("op4_token_counts")
def _(spark, d):
    return token_counts.count_tokens(_table(spark, d, "documents"), token_counts.vocabulary(f"{TOKENIZERS}/{VOCABULARY}"))


@query("op5_secret_scan")
def _(spark, d):
    return secret_scan.digest(secret_scan.find(_table(spark, d, "documents")))


@query("op6_html_text")
def _(spark, d):
    return html_text.extract(_table(spark, d, "pages"))


_NORMAL = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


@query("op7_decontaminate", rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_NORMAL} AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_NORMAL} AS w FROM benchmark),
q AS (SELECT DISTINCT item, least(len(w), 10) AS size, array_to_string(w[p:p + 9], ' ') AS h FROM i, unnest(generate_series(1, greatest(1, len(w) - 9))) AS t(p) WHERE len(w) > 0),
x AS (SELECT r, p, size, array_to_string(w[p:p + size - 1], ' ') AS h FROM d JOIN (SELECT DISTINCT size FROM q) ON len(w) >= size, unnest(generate_series(1, len(w) - size + 1)) AS t(p)),
f AS (SELECT r, p, size, item FROM x JOIN q USING (size, h)),
n AS (SELECT r, count(DISTINCT p + j) AS n_hit FROM f, unnest(generate_series(0, size - 1)) AS t(j) GROUP BY r),
m AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM f GROUP BY r)
SELECT doc_id, coalesce(len(w), 0) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  n_hit IS NOT NULL AS contaminated FROM d LEFT JOIN n USING (r) LEFT JOIN m USING (r)""")
def _(spark, d):
    found = decontaminate.scan(_table(spark, d, "documents"), _table(spark, d, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@query("op8_quality_votes")
def _(spark, d):
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    learnt = _table(spark, d, "labels").filter(~held_out)
    scores = quality_votes.score(_table(spark, d, "documents"), learnt)
    return scores.select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))


@query("op9_quality_rules", rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, coalesce({_WORDS}, []) AS w FROM documents),
x AS (SELECT r, p, array_to_string(w[p:p + 2], ' ') AS g FROM d, unnest(generate_series(1, len(w) - 2)) AS t(p)),
m AS (SELECT r, g FROM x GROUP BY ALL HAVING count(*) > 1),
n AS (SELECT r, count(DISTINCT p + j) AS n_repeat_words FROM x JOIN m USING (r, g), unnest(generate_series(0, 2)) AS t(j) GROUP BY r),
l AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
a AS (SELECT doc_id, len(w) AS n_words, CAST(coalesce(list_sum([length(x) FOR x IN w]), 0) AS BIGINT) AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
  coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, len(string_split(text, chr(10))) AS n_lines, len(list_distinct(w)) AS n_distinct_words,
  len(regexp_extract_all(text, '[A-Z]')) AS n_upper FROM d LEFT JOIN n USING (r) LEFT JOIN l USING (r)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM a)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed OR n_words > 0 AND 10 * n_symbols > 3 * n_words
  OR n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 25 * n_words) OR n_lines > 4 AND 2 * n_dup_lines > n_lines
  OR n_words >= 50 AND n_distinct_words < 2 + n_words // 200 OR word_chars > 0 AND 2 * n_upper > word_chars) AS kept FROM b""")
def _(spark, d):
    base = quality_rules.policy_mask("v1")
    entries = quality_rules.ledger(_table(spark, d, "documents"))
    return entries.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                          (F.col("failed").bitwiseAND(F.lit(base)) != 0).alias("base_failed"), quality_rules.passes().alias("kept"))


@query("rule_ablations")
def _(spark, d):
    """For every rule of the current policy: failing documents, those only it rejects, and those kept without it."""
    return quality_rules.ablations(quality_rules.ledger(_table(spark, d, "documents")))


@query("op10_mixing", r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
  CAST('0x' || substr(md5('mix-1:' || CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT) AS k FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY 1),
w AS (SELECT *, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS weight FROM s),
c AS (SELECT *, source_size * 3.0::DOUBLE AS cap FROM w),
v AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM c),
f AS (SELECT arg_min(level, cap / weight) AS level FROM v WHERE level * weight <= cap),
t AS (SELECT source, source_size, least(cap, f.level * weight) AS target, CAST(floor(least(cap, f.level * weight)) AS BIGINT) AS budget FROM v, f),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target, budget, CAST(coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(CASE WHEN source_size = 0 THEN 0 ELSE budget // source_size * size
  + greatest(0, least(size, budget % source_size - before)) END AS BIGINT) AS taken FROM p""")
def _(spark, d):
    return mixing.mix(_table(spark, d, "documents")).select("doc_id", "size", "source_size", "target", "taken")


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"


@query("op11_ranked_search", rf"""
WITH t AS (SELECT doc_id, {_TERMS} AS w FROM documents),
d AS (SELECT row_number() OVER () AS r, doc_id, w, len(w) AS n FROM t WHERE len(w) > 0),
c AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM d),
q AS (SELECT item_id, x, count(*) AS times FROM (SELECT item_id, unnest({_TERMS}) AS x FROM benchmark) GROUP BY ALL),
f AS (SELECT r, x, count(*) AS tf FROM (SELECT r, unnest(w) AS x FROM d) WHERE x IN (SELECT x FROM q) GROUP BY ALL),
v AS (SELECT x, CAST(floor(1000 * ln((2 * CAST(n_docs AS DOUBLE) + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM f, c GROUP BY x, n_docs),
s AS (SELECT item_id, doc_id, r, CAST(sum(times * weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM q JOIN f USING (x) JOIN v USING (x) JOIN d USING (r), c GROUP BY ALL HAVING score > 0)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM s QUALIFY rank <= 20""")
def _(spark, d):
    return ranked_search.search(ranked_search.index(_table(spark, d, "documents")), _table(spark, d, "benchmark"))


@query("op12_hard_negatives", """
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  [CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE) FOR x IN embedding] AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM r a JOIN r b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
w AS (SELECT p.anchor_id, positive_id, positive_score, s.id AS negative_id, s.score AS negative_score,
  row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.id) AS rank
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same AND 100 * s.score BETWEEN 80 * positive_score AND 100 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INT) AS rank, negative_id, positive_score, negative_score FROM w WHERE rank <= 5""")
def _(spark, d):
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = _table(spark, d, "embeddings").withColumn("label", moved)
    return hard_negatives.mine(rows, F.col("vec_id") % 100 == 0)


@query("op13_best_fit_packing")
def _(spark, d):
    pieces = packing.pack(_table(spark, d, "documents"), f"{TOKENIZERS}/{PACKED_WITH}")
    return pieces.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
