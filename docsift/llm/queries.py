"""The operators' queries over the shared tables, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from docsift.llm import (
    byte_bpe, embedding_dedup, fill_middle, filter_audit, jaccard_join, license_scan, line_dedup, packing, quality, ring_shards, source_mix, telephony, url_rules,
)
from docsift.llm.common import documents, stored


def op1_embedding_dedup(spark, sf_dir):
    return embedding_dedup.near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), threshold=0.93)


def op2_line_dedup(spark, sf_dir):
    found = line_dedup.dedup_lines(documents(spark, sf_dir).select("doc_id", "text"), min_chars=20, min_docs=3)
    return found.select("row.doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op3_packing(spark, sf_dir):
    return packing.pack_documents(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op4_license_scan(spark, sf_dir):
    found = license_scan.scan_licenses(documents(spark, sf_dir))
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    words, base, own = F.transform("phrases", lambda p: p["word"]), F.transform("phrases", lambda p: p["label"]), F.transform("matches", lambda m: m["label"])
    score = F.greatest(F.when(F.size("phrases") > 0, 1.0).otherwise(0.0), F.coalesce(F.array_max(F.transform("matches", lambda m: m["score"])), F.lit(0.0)))
    return found.select(
        "doc_id", "n_words", F.size("phrases").cast("long").alias("n_base"), F.array_min(words).alias("first_word"), F.array_max(words).alias("last_word"),
        joined(base).alias("base_labels"), joined(F.concat(base, own)).alias("labels"), score.alias("score"),
    )


def op5_url_rules(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("page_id"), F.expr("quality = 0 or toxic = 1").alias("bad"))
    found = url_rules.judge_urls(pages, pages.select("page_id", "url").join(labels, "page_id").select("url", "bad"))
    return found.select("page_id", "host", "path", "rule", "verdict")


def op6_ring_shards(spark, sf_dir):
    return ring_shards.shard_documents(documents(spark, sf_dir), shards=40)


def op7_byte_bpe(spark, sf_dir):
    return byte_bpe.round_trip(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_jaccard_join(spark, sf_dir):
    return jaccard_join.similar_groups(documents(spark, sf_dir), n=4, threshold=0.85)


def op9_telephony(spark, sf_dir):
    """The stored PCM comes with each row as its last column but the errors."""
    return telephony.measure_media(telephony.store_texts(documents(spark, sf_dir)))


def op10_quality(spark, sf_dir):
    docs = documents(spark, sf_dir)
    model = quality.train(docs, quality.grades(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    found = quality.score_documents(docs.select("doc_id", "text"), model)
    return found.select("row.doc_id", F.round("expected_grade", 9).alias("expected_grade"), F.round("tail_probability", 9).alias("tail_probability"), (F.col("tail_probability") >= 0.5).alias("kept"))


def op11_fill_middle(spark, sf_dir):
    found = fill_middle.restore_documents(fill_middle.form_documents(documents(spark, sf_dir), seed=42, rate=50, spm=80))
    digest = lambda c: F.sha2(c, 256).alias(f"{c}_sha256")
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest("output"), digest("restored"))


def op12_source_mix(spark, sf_dir):
    rows = stored(source_mix.sized(documents(spark, sf_dir)).select("doc_id", "source", "size"), "sized")
    return source_mix.mix_rows(rows).select("row.doc_id", "row.size", "source_size", "target", "taken")


def op13_filter_audit(spark, sf_dir):
    return filter_audit.audit_filters(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_embedding_dedup, op2_line_dedup, op3_packing, op4_license_scan, op5_url_rules, op6_ring_shards, op7_byte_bpe, op8_jaccard_join, op9_telephony, op10_quality,
        op11_fill_middle, op12_source_mix, op13_filter_audit,
    )
}

OP1_SQL = """
WITH RECURSIVE v AS (
  SELECT DISTINCT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
  ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
low AS (SELECT a, min(b) AS m FROM reach GROUP BY a),
n AS (SELECT a, count(DISTINCT b) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n.n, 0) AS n_links, least(vec_id, low.m) AS component_id, vec_id = least(vec_id, low.m) AS kept
FROM embeddings LEFT JOIN low ON low.a = vec_id LEFT JOIN n ON n.a = vec_id
"""

OP2_SQL = r"""
WITH parts AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), lines AS (
  SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM parts
), keyed AS (
  SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines
), repeated AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3
), judged AS (
  SELECT keyed.doc_id, line, i, repeated.k IS NOT NULL AND keeper <> keyed.doc_id AS gone
  FROM keyed LEFT JOIN repeated ON keyed.k = repeated.k
)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CAST(gone AS INT)) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

OP8_SQL = r"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), sets AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' ')) END) AS s FROM worded
), sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
shared AS (
  SELECT doc_id, s FROM sets WHERE s IN (SELECT s FROM sets GROUP BY s HAVING count(*) > 1)
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shared a JOIN shared b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)
), reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
low AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, m) AS component_id
FROM documents d LEFT JOIN sizes ON sizes.doc_id = d.doc_id LEFT JOIN low ON low.a = d.doc_id
"""

OP11_SQL = r"""
WITH h AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d,
    regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units FROM documents
), k AS (
  SELECT *, len(units) AS n, CAST('0x' || d[1:8] AS BIGINT) % (len(units) + 1) AS a, CAST('0x' || d[9:16] AS BIGINT) % (len(units) + 1) AS b,
    t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR CAST('0x' || d[17:24] AS BIGINT) % 100 >= 50 AS plain,
    CAST('0x' || d[25:32] AS BIGINT) % 100 < 80 AS spm FROM h
), p AS (
  SELECT *, array_to_string(units[1:least(a, b)], '') AS pre, array_to_string(units[least(a, b) + 1:greatest(a, b)], '') AS mid, array_to_string(units[greatest(a, b) + 1:], '') AS suf FROM k
)
SELECT doc_id, n, CASE WHEN plain THEN 'plain' WHEN spm THEN 'spm' ELSE 'psm' END AS form,
  CASE WHEN NOT plain THEN length(pre) END AS prefix_chars, CASE WHEN NOT plain THEN length(mid) END AS middle_chars,
  sha256(CASE WHEN plain THEN t WHEN spm THEN '<S>' || suf || '<P>' || pre || '<M>' || mid ELSE '<P>' || pre || '<S>' || suf || '<M>' || mid END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""

OP13_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first FROM documents
), marked AS (
  SELECT DISTINCT doc_id, bool_or(coalesce(quality = 1, false)) OVER (PARTITION BY doc_id) AS good, bool_or(coalesce(toxic = 1, false)) OVER (PARTITION BY doc_id) AS toxic
  FROM labels WHERE doc_id IS NOT NULL
), f AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    CASE WHEN len(w) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN coalesce(doc_id > first, false) THEN 16 ELSE 0 END AS failed
  FROM d LEFT JOIN marked USING (doc_id)
), c AS (SELECT part, failed, count(*) AS n, count(*) FILTER (good) AS n_good, count(*) FILTER (toxic) AS n_toxic FROM f GROUP BY 1, 2),
letters AS (SELECT chr(CAST(65 + i AS INT)) AS x, CAST(1 << i AS INT) AS b FROM range(5) r(i)),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order, [a.b, b.b, c.b, d.b, e.b] AS bs
  FROM letters a JOIN letters b ON a.x <> b.x JOIN letters c ON c.x NOT IN (a.x, b.x) JOIN letters d ON d.x NOT IN (a.x, b.x, c.x) JOIN letters e ON e.x NOT IN (a.x, b.x, c.x, d.x)
), steps AS (
  SELECT filter_order, step, bs[step] AS b, CAST(coalesce(list_sum(bs[1:step - 1]), 0) AS INT) AS applied FROM orders, (SELECT CAST(i AS INT) AS step FROM range(1, 6) r(i))
), told AS (
  SELECT part, filter_order, step, b,
    coalesce(sum(n) FILTER (failed & applied = 0 AND failed & b = 0), 0) AS kept, coalesce(sum(n) FILTER (failed & applied = 0 AND failed & b <> 0), 0) AS removed,
    coalesce(sum(n) FILTER (failed & applied <> 0 AND failed & b <> 0), 0) AS redundant, coalesce(sum(n) FILTER (failed = b), 0) AS unique_fails,
    coalesce(sum(n_good) FILTER (failed & applied = 0 AND failed & b <> 0), 0) AS good_lost, coalesce(sum(n_toxic) FILTER (failed & applied = 0 AND failed & b <> 0), 0) AS toxic_lost
  FROM c CROSS JOIN steps GROUP BY ALL
)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, b) AS BIGINT) AS shapley FROM told
"""

ORACLES = {"op1_embedding_dedup": OP1_SQL, "op2_line_dedup": OP2_SQL, "op8_jaccard_join": OP8_SQL, "op11_fill_middle": OP11_SQL, "op13_filter_audit": OP13_SQL}
