"""The thin op queries over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.llm import chunk_dedup, conversation_repair, dart_minhash, edit_embedding, filter_audit, grammar_store, license_rules, merkle, mixing, packing, quality, secret_parts, store, token_cache


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_repair_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grammar_store.token_shards_report(spark, _documents(spark, sf_dir))


def op2_merkle_fixity_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return merkle.audit(pages, merkle.damaged_replica(pages))


def op3_discriminant_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op4_edit_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_embedding.edit_fingerprints(_documents(spark, sf_dir))


def edit_embedding_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second half of op 4's method, banding and verification, over all documents: doc_id and class_id."""
    return edit_embedding.similar_classes(edit_embedding.text_fingerprints(_documents(spark, sf_dir)))


def op5_histogram_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(_documents(spark, sf_dir))


def op6_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_rules.license_scan(_documents(spark, sf_dir), with_spans=False)


def op7_curriculum_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.curriculum(mixing.mixture(_documents(spark, sf_dir)))
    return mixed.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken", "position")


def op8_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dart_minhash.near_duplicate_classes(_documents(spark, sf_dir))


def op9_token_count_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cache is a folder of the shared storage that lasts between runs, one for each place of documents."""
    return token_cache.count_tokens(_documents(spark, sf_dir), f"{store.shared_folder(spark)}/token-counts/{hashlib.sha256(sf_dir.encode()).hexdigest()[:16]}")


def op10_chunk_recipe_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_dedup.duplicate_groups(_documents(spark, sf_dir))


def op11_multipart_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_parts.spans_report(secret_parts.secret_scan(_documents(spark, sf_dir)))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conversation_repair.damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return conversation_repair.repaired(rows)


def op13_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.interaction_audit(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


OP10_SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_chars,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id IS NOT DISTINCT FROM first_value(doc_id) OVER w AND n_chars = first_value(n_chars) OVER w AS kept,
       text_sha256
FROM n WINDOW w AS (PARTITION BY text_sha256 ORDER BY n_chars DESC, doc_id NULLS LAST)
"""

#: Targets by trying every set of capped sources that is a run of the lowest cap-to-weight levels.
OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '') || chr(10) || coalesce(text, '')) AS k
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS p FROM d GROUP BY source),
w AS (
  SELECT *, CASE p % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight,
         CASE p % 3 WHEN 0 THEN 0.5::DOUBLE WHEN 1 THEN -0.5::DOUBLE ELSE 0.0::DOUBLE END AS tilt,
         2.0::DOUBLE * source_size AS cap FROM s),
l AS (
  SELECT *, cap / weight AS level,
         (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
           / sum(weight) OVER (ORDER BY cap / weight, p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS share FROM w),
c AS (SELECT share FROM l WHERE level > share ORDER BY level, p LIMIT 1),
t AS (SELECT source, source_size, tilt, coalesce(least(cap, (SELECT share FROM c) * weight), cap) AS target FROM l),
r AS (
  SELECT doc_id, size, source_size, tilt, target,
         sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
x AS (
  SELECT *, greatest(least(size, floor(target) - start), 0) AS first_take,
         greatest(least(size, floor(target) - start - source_size), 0) AS second_take FROM r)
SELECT doc_id, size, source_size, round(target, 6) AS target, CAST(first_take + second_take AS BIGINT) AS taken,
       CASE WHEN first_take > 0 THEN round(least(greatest(2 * start / target / (1 + tilt + sqrt(greatest((1 + tilt) * (1 + tilt) - 4 * tilt * start / target, 0))), 0), 1), 9) END AS position
FROM x
"""

#: The damage that the replica was given, found record by record; ranges are runs of 16 page ids.
OP2_SQL = r"""
WITH p AS (
  SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html,
         strlen(CAST(page_id AS VARCHAR)) + strlen(coalesce(url, '')) + strlen(coalesce(html, '')) + 2 AS n FROM pages),
l AS (
  SELECT page_id // 16 AS leaf, sum(n) AS n FROM p GROUP BY 1),
o AS (
  SELECT leaf, n, coalesce(sum(n) OVER (ORDER BY leaf ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS range_start FROM l)
SELECT page_id,
       CASE page_id % 211 WHEN 7 THEN 'missing' WHEN 11 THEN 'repeated' ELSE 'altered' END AS status,
       sha256(page_id || chr(10) || url || chr(10) || html) AS primary_sha256,
       CASE page_id % 211 WHEN 3 THEN sha256(page_id || chr(10) || url || chr(10) || '#' || substr(html, 2))
                          WHEN 5 THEN sha256(page_id || chr(10) || url || chr(10) || substr(html, 1, length(html) // 2))
                          WHEN 11 THEN sha256(page_id || chr(10) || url || chr(10) || html) END AS replica_sha256,
       CAST(1 AS BIGINT) AS primary_copies,
       CAST(CASE page_id % 211 WHEN 7 THEN 0 WHEN 11 THEN 2 ELSE 1 END AS BIGINT) AS replica_copies,
       CAST(range_start AS BIGINT) AS range_start, CAST(range_start + o.n AS BIGINT) AS range_end
FROM p JOIN o ON page_id // 16 = leaf
WHERE page_id % 211 IN (3, 5, 7, 11)
"""

#: The same edits row by row: one recursive walk over whole conversations that carries the repaired lines along.
OP12_SQL = r"""
WITH RECURSIVE k AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
h AS (
  SELECT conv_id, turn, role, text, xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(key, ''), lambda c: CAST(ascii(c) AS UBIGINT))),
           lambda crc, b: list_reduce(list_prepend(xor(crc, b), [0::UBIGINT, 1, 2, 3, 4, 5, 6, 7]), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::UBIGINT) ELSE x >> 1 END)), 4294967295::UBIGINT) % 20 AS kind FROM k),
d AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, copy
  FROM h, range(2) AS c(copy) WHERE kind <> 0 AND (copy = 0 OR kind = 3)),
p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS place, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM d),
q AS (
  SELECT *, role[:1] AS initial, lag(role[:1]) OVER (PARTITION BY conv_id ORDER BY place) AS before,
         CASE WHEN bare = '' THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) > 1 THEN 2 WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault FROM p),
counts AS (
  SELECT conv_id, CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
         count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (before || initial NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM q GROUP BY conv_id),
ins AS (
  SELECT * FROM (VALUES
    (0, 0, '', 0, []), (1, 1, '', 0, []), (2, 2, '', 0, []), (3, 3, '', 0, []), (0, 2, 'I', 5, ['user:']), (1, 2, 'I', 5, ['user:']), (2, 3, 'I', 5, ['assistant:']), (3, 2, 'I', 5, ['user:']),
    (0, 3, 'II', 10, ['user:', 'assistant:']), (1, 3, 'II', 10, ['user:', 'assistant:']), (2, 2, 'II', 10, ['assistant:', 'user:']), (3, 3, 'II', 10, ['user:', 'assistant:'])) AS t(a, b, added, price, said)),
walk(conv_id, place, state, best) AS (
  SELECT conv_id, 0, 0, {'cost': 0, 'audit': '', 'lines': []::VARCHAR[]} FROM counts
  UNION ALL
  SELECT conv_id, place, state, min(way) FROM (
    SELECT w.conv_id, q.place, e.state, {'cost': w.best.cost + i.price + e.price, 'audit': w.best.audit || i.added || e.letter, 'lines': w.best.lines || i.said || e.said} AS way
    FROM walk w JOIN q ON q.conv_id IS NOT DISTINCT FROM w.conv_id AND q.place = w.place + 1 JOIN ins i ON i.a = w.state, LATERAL (
      SELECT i.b AS state, 'D' AS letter, 2 AS price, []::VARCHAR[] AS said
      UNION ALL SELECT CASE q.initial WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END, 'K', CASE q.fault WHEN 3 THEN 5 ELSE 0 END, [q.role || ':' || q.text]
        WHERE q.fault IN (0, 3) AND (q.initial = 's' AND i.b = 0 OR q.initial = 'u' AND i.b <> 2 OR q.initial = 'a' AND i.b = 2)
      UNION ALL SELECT CASE i.b WHEN 2 THEN 3 ELSE 2 END, 'R', CASE q.fault WHEN 3 THEN 6 ELSE 1 END, [CASE i.b WHEN 2 THEN 'assistant:' ELSE 'user:' END || q.text] WHERE q.fault IN (0, 3)) AS e)
  GROUP BY conv_id, place, state),
ends AS (
  SELECT c.*, w.best.cost + CASE w.state WHEN 1 THEN 10 WHEN 2 THEN 5 ELSE 0 END AS cost, w.best.audit || CASE w.state WHEN 1 THEN 'II' WHEN 2 THEN 'I' ELSE '' END AS audit,
         w.best.lines || CASE w.state WHEN 1 THEN ['user:', 'assistant:'] WHEN 2 THEN ['assistant:'] ELSE [] END AS lines
  FROM walk w JOIN counts c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND c.n = w.place),
best AS (SELECT * FROM ends QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY cost, audit) = 1)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       CAST(coalesce(cost, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM o.conv_id
"""

#: Every order and step counted directly over the masks of all documents.
OP13_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         doc_id > min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS copied FROM documents),
d AS (
  SELECT part, doc_id, len(words) < 200 AS a, 100 * len(list_distinct(words)) < 50 * len(words) AS b,
         100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) AS c, regexp_matches(text, '[#$%&*|]') AS d, coalesce(copied, false) AS e FROM w),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
m AS (
  SELECT part, CASE WHEN a THEN 'A' ELSE '' END || CASE WHEN b THEN 'B' ELSE '' END || CASE WHEN c THEN 'C' ELSE '' END || CASE WHEN d THEN 'D' ELSE '' END || CASE WHEN e THEN 'E' ELSE '' END AS failed,
         count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
  FROM d LEFT JOIN l USING (doc_id) GROUP BY ALL),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (
  SELECT p.x || q.x || r.x || s.x || t.x AS filter_order FROM f p, f q, f r, f s, f t
  WHERE q.x <> p.x AND r.x NOT IN (p.x, q.x) AND s.x NOT IN (p.x, q.x, r.x) AND t.x NOT IN (p.x, q.x, r.x, s.x)),
st AS (SELECT filter_order, CAST(k AS INTEGER) AS step, filter_order[k] AS x, filter_order[:k - 1] AS earlier FROM o, range(1, 6) AS r(k)),
j AS (
  SELECT m.*, st.*, contains(failed, x) AS fails, regexp_matches(failed, '[' || CASE earlier WHEN '' THEN '-' ELSE earlier END || ']') AS gone FROM m, st),
g AS (
  SELECT part, filter_order, step, x, CAST(coalesce(sum(n) FILTER (NOT fails AND NOT gone), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (fails AND NOT gone), 0) AS BIGINT) AS removed,
         CAST(coalesce(sum(n) FILTER (fails AND gone), 0) AS BIGINT) AS redundant, CAST(coalesce(sum(n) FILTER (failed = x), 0) AS BIGINT) AS unique_fails,
         CAST(coalesce(sum(good) FILTER (fails AND NOT gone), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(toxic) FILTER (fails AND NOT gone), 0) AS BIGINT) AS toxic_lost
  FROM j GROUP BY part, filter_order, step, x)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley FROM g
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_repair_token_store": op1_repair_token_store,
    "op2_merkle_fixity_audit": op2_merkle_fixity_audit,
    "op3_discriminant_quality": op3_discriminant_quality,
    "op4_edit_embedding": op4_edit_embedding,
    "edit_embedding_classes": edit_embedding_classes,
    "op5_histogram_packing": op5_histogram_packing,
    "op6_license_rules": op6_license_rules,
    "op7_curriculum_mixing": op7_curriculum_mixing,
    "op8_dart_minhash": op8_dart_minhash,
    "op9_token_count_cache": op9_token_count_cache,
    "op10_chunk_recipe_dedup": op10_chunk_recipe_dedup,
    "op11_multipart_secrets": op11_multipart_secrets,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_filter_interactions": op13_filter_interactions,
}
SQL: dict[str, str] = {"op2_merkle_fixity_audit": OP2_SQL, "op7_curriculum_mixing": OP7_SQL, "op10_chunk_recipe_dedup": OP10_SQL, "op12_conversation_repair": OP12_SQL, "op13_filter_interactions": OP13_SQL}
