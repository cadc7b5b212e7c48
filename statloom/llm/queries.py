"""Registered queries of the corpus operators.  Each reads its whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import license_scan as licenses
from . import line_dedup as lines
from . import divergence, filter_audit, media, mixing, ngram_join, ordinal, packing, quality_rules, sharding, substring_dedup, token_rollup
from .common import scratch_root, table


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(table(spark, sf_dir, "documents")).drop("kept_text")


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(table(spark, sf_dir, "documents"), n=3, num=9, den=10)


def grades(labels: DataFrame) -> DataFrame:
    """0: poor; 1: good but toxic; 2: good."""
    return labels.select("doc_id", F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).otherwise(2).alias("grade")).where("quality is not null and toxic is not null")


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = ordinal.fit_grades(docs, grades(table(spark, sf_dir, "labels")), 3)
    return ordinal.grade_documents(docs, model, 2)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_rules.quality_rules(docs, quality_rules.fit_rules(docs, table(spark, sf_dir, "labels")))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents")).drop("detections")


def op8_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loads all documents, takes away those without a word, revises those with blanks at an end, and returns the totals."""
    docs = table(spark, sf_dir, "documents")
    rollup = token_rollup.Rollup(spark, f"{scratch_root(spark)}/rollup-{uuid.uuid4().hex}")
    load = token_rollup.inserts(docs)
    rollup.commit("load", load)
    rollup.commit("load", load)  # delivered twice, counted once
    rollup.compact()
    rollup.commit("retire", token_rollup.deletes(docs.where(r"coalesce(text, '') not rlike '[^ \\t\\n\\r\\x0B\\f]'")))
    ends = docs.where(r"text rlike '[^ \\t\\n\\r\\x0B\\f]' and text rlike '^[ \\t\\n]|[ \\t\\n]$'")
    rollup.commit("revise", token_rollup.revisions(ends, ends.withColumn("text", F.btrim("text", F.lit(" \t\n")))))
    return rollup.totals()


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_dedup(table(spark, sf_dir, "documents")).withColumn("kept_sha256", F.sha2("kept_text", 256)).drop("kept_text")


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op12_divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence_audit(table(spark, sf_dir, "documents"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    named = (op1_substring_dedup, op2_ngram_join, op3_quality_classifier, op4_quality_rules, op5_packing, op6_mixing, op7_license_scan, op8_token_rollup, op9_media_columns, op10_line_dedup, op11_sharding, op12_divergence_audit, op13_filter_audit, pipeline)
    return {f.__name__: f for f in named}


WORDS = r"regexp_extract_all(text, '[^\x20\x09-\x0D]+')"

OP1_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce({WORDS}, []::VARCHAR[]) AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 49, 0) + 1)) AS i FROM d),
x AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM p),
m AS (SELECT h, min(doc_id) AS least FROM x GROUP BY h HAVING min(doc_id) < max(doc_id)),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS j FROM x JOIN m USING (h) WHERE doc_id > least),
g AS (SELECT doc_id, list(j) AS gone FROM c GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda z: NOT list_contains(gone, z[2])), lambda z: z[1]) END, ' ')) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id)
"""

OP2_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, hash(t) AS t FROM (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END) AS t FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS shared FROM s a JOIN s b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT u, v FROM o JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * shared >= 90 * (x.n + y.n - shared)),
r AS (SELECT doc_id AS u, doc_id AS v FROM d UNION SELECT r.u, e.v FROM r JOIN e ON r.v = e.u)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT u AS doc_id, min(v) AS component_id FROM r GROUP BY u) c USING (doc_id)
"""

OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
o AS (SELECT r, lang, source, unnest(w) AS term FROM d),
x AS (SELECT r, lang, source, term, count(*) AS n FROM o GROUP BY ALL),
k AS (SELECT lang, term, sum(n) AS ln FROM x GROUP BY lang, term HAVING count(*) >= 30),
l AS (SELECT lang, count(*) AS v, sum(ln) AS lt FROM k GROUP BY lang),
c AS (SELECT x.lang, x.source, x.term, sum(n) AS n FROM x JOIN k USING (lang, term) GROUP BY ALL),
s AS (SELECT DISTINCT lang, source FROM d),
g AS (SELECT s.lang, s.source, coalesce(t.total, 0) AS total FROM s LEFT JOIN (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL) t ON t.lang = s.lang AND t.source = s.source),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (g.total + 5 * l.v) AS p, 1 + (1000000000::HUGEINT * (k.ln + 5)) // (l.lt + 5 * l.v) AS q
  FROM g JOIN k ON k.lang = g.lang JOIN l ON l.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
y AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value FROM s a JOIN s b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q),
z AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM y)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM z WHERE part = 'pair' OR rank <= 50
"""

OP13_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
e AS (SELECT t, min(doc_id) AS least FROM d GROUP BY t),
w AS (SELECT d.doc_id, part, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, least, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic FROM d JOIN e USING (t) LEFT JOIN l ON l.doc_id = d.doc_id),
b AS (SELECT part, good, toxic, (CASE WHEN len(w) < 100 THEN 1 ELSE 0 END) + (CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 2 ELSE 0 END)
  + (CASE WHEN 100 * len(regexp_extract_all(t, '[A-Z]')) > 10 * length(t) THEN 4 ELSE 0 END) + (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END)
  + (CASE WHEN doc_id > least THEN 16 ELSE 0 END) AS mask FROM w),
c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM b GROUP BY ALL),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS bit),
o AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM f a, f b, f c, f d, f e WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31),
s AS (SELECT filter_order, step, f.f, f.bit, (SELECT coalesce(sum(g.bit), 0) FROM f g WHERE instr(filter_order, g.f) < step) AS before FROM o, range(1, 6) r(step), f WHERE substr(filter_order, step, 1) = f.f),
m AS (SELECT part, filter_order, step, f, sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END) AS kept,
  sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN n ELSE 0 END) AS removed, sum(CASE WHEN mask & before > 0 AND mask & bit > 0 THEN n ELSE 0 END) AS redundant,
  sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN good ELSE 0 END) AS good_lost,
  sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN toxic ELSE 0 END) AS toxic_lost FROM c, s GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM m
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_substring_dedup": OP1_SQL, "op2_ngram_join": OP2_SQL, "op12_divergence_audit": OP12_SQL, "op13_filter_audit": OP13_SQL}
