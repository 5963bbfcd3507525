"""Registered queries of the text operators and, where SQL can state them, their checking SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from isohaline.llm import language, pieces, quality, secrets
from isohaline.llm.alignment import align, with_counts
from isohaline.llm.common import documents, fold
from isohaline.llm.fingerprint import fingerprints
from isohaline.llm.hardneg import hard_negatives
from isohaline.llm.licenses import find_licenses
from isohaline.llm.linededup import dedup_lines
from isohaline.llm.mixing import mix
from isohaline.llm.neardup import near_duplicates
from isohaline.llm.repetition import rate_repetition
from isohaline.llm.sharding import shard_documents


def op1_quality_classifier(spark, sf_dir):
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = quality.score_quality(docs, quality.fit(docs, quality.training_labels(labels)))
    return scored.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")


def op2_language_id(spark, sf_dir):
    docs = documents(spark, sf_dir)
    found = language.detect(docs, language.fit(language.training_rows(docs)))
    return found.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score")


def op3_repetition_rules(spark, sf_dir):
    return rate_repetition(documents(spark, sf_dir)).drop("spans")


def op4_near_dedup(spark, sf_dir):
    return near_duplicates(documents(spark, sf_dir), k=2)


def op5_license_scan(spark, sf_dir):
    return find_licenses(documents(spark, sf_dir))


def op6_fingerprints(spark, sf_dir):
    return fingerprints(documents(spark, sf_dir))


def op7_line_dedup(spark, sf_dir):
    cut = dedup_lines(documents(spark, sf_dir))
    return cut.select("doc_id", F.col("_n_lines").alias("n_lines"), F.size("_gone").alias("n_removed"), F.concat_ws(",", F.col("_gone").cast("array<string>")).alias("removed_lines"), "text")


def op8_mix_sources(spark, sf_dir):
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op9_secret_scan(spark, sf_dir):
    found = secrets.scan(documents(spark, sf_dir))
    return found.select(
        "doc_id", "n_assign", "n_access", "n_hex",
        F.sha2(secrets.joined(F.col("base")), 256).alias("base_sha256"), secrets.joined(F.col("found")).alias("spans"),
    )


def op10_sentencepiece(spark, sf_dir):
    return pieces.encode(documents(spark, sf_dir))


def op11_hard_negatives(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", label), F.col("vec_id") % 100 == 0)


def op12_alignment(spark, sf_dir):
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    counted = with_counts(align(documents(spark, sf_dir)).withColumn("groups_sha256", digest).drop("groups"))
    return counted.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op13_sharding(spark, sf_dir):
    placed = shard_documents(documents(spark, sf_dir))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "moved")


MIX_SQL = """
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS size,
         substr(md5(coalesce(text, '')), 1, 16) AS th, md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null:' || th)) AS k
  FROM documents),
per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rnk
  FROM sized GROUP BY source),
weighted AS (
  SELECT *, rnk % 3 + 1 AS w, 3 * source_size AS cap, CAST(sum(source_size) OVER () AS BIGINT) AS total FROM per),
filled AS (
  SELECT *, cap * sum(w) OVER (ORDER BY cap / w, rnk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
            < (total - coalesce(sum(cap) OVER (ORDER BY cap / w, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * w AS is_full
  FROM weighted),
targets AS (
  SELECT source, rnk, source_size, total,
         CASE WHEN is_full THEN CAST(cap AS DOUBLE)
              ELSE CAST((total - coalesce(sum(cap) FILTER (WHERE is_full) OVER (), 0)) * w AS DOUBLE)
                   / CAST(sum(w) FILTER (WHERE NOT is_full) OVER () AS DOUBLE) END AS target
  FROM filled),
numbered AS (SELECT *, row_number() OVER (PARTITION BY source, k, doc_id, size, th) AS nth FROM sized),
queued AS (
  SELECT s.doc_id, s.size, s.k, s.th, s.nth, t.rnk, t.source_size, t.target, t.total,
         CAST(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.k, s.doc_id NULLS FIRST, s.size, s.th, s.nth) AS BIGINT) AS cum
  FROM numbered s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
copies AS (
  SELECT *, CAST(e * source_size + cum AS DOUBLE) / target AS finish
  FROM queued CROSS JOIN (VALUES (0), (1), (2)) AS epochs(e) WHERE size > 0),
ordered AS (
  SELECT *, sum(size) OVER (ORDER BY finish, rnk, e, k, doc_id NULLS FIRST, size, th, nth) AS upto FROM copies),
used AS (SELECT k, rnk, size, doc_id, th, nth, count(*) AS n FROM ordered WHERE upto <= total GROUP BY ALL)
SELECT q.doc_id, q.size, q.source_size, q.target, CAST(coalesce(u.n, 0) * q.size AS BIGINT) AS taken
FROM queued q LEFT JOIN used u ON u.k = q.k AND u.rnk = q.rnk AND u.size = q.size AND u.th = q.th AND u.nth = q.nth
  AND u.doc_id IS NOT DISTINCT FROM q.doc_id
"""

LINES_SQL = """
WITH raw AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
lines AS (SELECT doc_id, unnest(range(len(ls))) AS i, unnest(ls) AS line FROM raw),
worded AS (SELECT *, len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) AS nw FROM lines),
seq AS (
  SELECT *, row_number() OVER d AS n, sum(nw) OVER d AS upto FROM worded WHERE nw > 0 WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
reaches AS (
  SELECT a.doc_id, a.n AS s, b.n AS e FROM seq a JOIN seq b
    ON a.doc_id = b.doc_id AND b.n BETWEEN a.n AND a.n + 49 AND b.upto - a.upto + a.nw >= 50),
parts AS (
  SELECT doc_id, s, min(e) AS e FROM reaches GROUP BY doc_id, s UNION SELECT doc_id, max(s) AS s, e FROM reaches GROUP BY doc_id, e),
runs AS (
  SELECT p.doc_id, p.s, p.e, string_agg(q.line, chr(10) ORDER BY q.n) AS run
  FROM parts p JOIN seq q ON q.doc_id = p.doc_id AND q.n BETWEEN p.s AND p.e GROUP BY 1, 2, 3),
copies AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY run ORDER BY doc_id, s) > 1),
gone AS (
  SELECT DISTINCT q.doc_id, q.i FROM copies c JOIN seq q ON q.doc_id = c.doc_id AND q.n BETWEEN c.s AND c.e),
cut AS (
  SELECT l.doc_id, CAST(count(g.i) AS INTEGER) AS n_removed, coalesce(string_agg(CAST(g.i AS VARCHAR), ',' ORDER BY l.i), '') AS removed_lines,
         coalesce(string_agg(l.line, chr(10) ORDER BY l.i) FILTER (WHERE g.i IS NULL), '') AS kept
  FROM lines l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.i = l.i GROUP BY l.doc_id)
SELECT r.doc_id, CAST(len(r.ls) AS INTEGER) AS n_lines, coalesce(c.n_removed, 0) AS n_removed, coalesce(c.removed_lines, '') AS removed_lines,
       CASE WHEN c.n_removed > 0 THEN c.kept ELSE r.text END AS text
FROM raw r LEFT JOIN cut c ON c.doc_id = r.doc_id
"""

NEAR_SQL = """
WITH RECURSIVE worded AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\\x20\\x09-\\x0D]+'), []) AS ws
  FROM documents),
sets AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) = 1 THEN [ws[1]]
    ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS s
  FROM worded),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS common FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT u, v FROM shared JOIN sizes x ON x.doc_id = u JOIN sizes y ON y.doc_id = v
  WHERE 100 * common >= 80 * (x.n + y.n - common)),
edges AS (SELECT u, v FROM links UNION SELECT v, u FROM links),
reach AS (SELECT u AS node, u AS seen FROM edges UNION SELECT r.node, e.v FROM reach r JOIN edges e ON e.u = r.seen)
SELECT w.doc_id, CAST(coalesce(s.n, 0) AS BIGINT) AS n_shingles,
       least(w.doc_id, coalesce(m.root, w.doc_id)) AS component_id, w.doc_id <= coalesce(m.root, w.doc_id) AS kept
FROM worded w LEFT JOIN sizes s USING (doc_id)
LEFT JOIN (SELECT node, min(seen) AS root FROM reach GROUP BY node) m ON m.node = w.doc_id
"""

NEGATIVES_SQL = """
WITH whole AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, r.vec_id AS id, a.label = r.label AS own,
         CAST(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * r.v[i])) AS BIGINT) AS score
  FROM whole a JOIN whole r ON a.vec_id % 100 = 0 AND r.vec_id <> a.vec_id),
positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE own
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
ranked AS (
  SELECT p.anchor_id, p.positive_id, s.id AS negative_id, p.positive_score, s.score AS negative_score,
         CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id) AS INTEGER) AS rank
  FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.own
   AND 100 * s.score BETWEEN 80 * p.positive_score AND 100 * p.positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 5
"""

QUERIES = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_language_id": op2_language_id,
    "op3_repetition_rules": op3_repetition_rules,
    "op4_near_dedup": op4_near_dedup,
    "op5_license_scan": op5_license_scan,
    "op6_fingerprints": op6_fingerprints,
    "op7_line_dedup": op7_line_dedup,
    "op8_mix_sources": op8_mix_sources,
    "op9_secret_scan": op9_secret_scan,
    "op10_sentencepiece": op10_sentencepiece,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_alignment": op12_alignment,
    "op13_sharding": op13_sharding,
}
ORACLES = {"op11_hard_negatives": NEGATIVES_SQL, "op4_near_dedup": NEAR_SQL, "op7_line_dedup": LINES_SQL, "op8_mix_sources": MIX_SQL}
