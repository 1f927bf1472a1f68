"""The queries of this subpackage, by name, and DuckDB SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, embedding_dedup, fingerprint_index, hard_negatives, jaccard_join, langid, mixing, packing, prefix_trie, quality, secrets, suffix_array, warc


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _remainder(id_: str, n: int):
    """Of the id as text; null ids count as empty text."""
    return F.crc32(F.coalesce(F.col(id_).cast("string"), F.lit("")).cast("binary")) % n


def best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir))


def embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.dedup(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return secrets.find(docs, secrets.fit(docs))


def base_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op3 finds by the base patterns alone, which SQL can express."""
    return secrets.find(_documents(spark, sf_dir), None).drop("spans")


def quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit(docs, labels, _remainder("i", 3) != 1)
    return quality.score(docs, model).withColumn("held_out", _remainder("doc_id", 3) == 1)


def curriculum_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_documents(spark, sf_dir))
    first = F.array_min(F.transform("takes", lambda t: t["position"]))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", first.alias("position")).orderBy(F.col("position").asc_nulls_last(), "doc_id")


def nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


def nearest_neighbours_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6 with its exact way alone, which SQL can express: every query against all rows, in blocks."""
    found = ann.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0, probes=None)
    return found.withColumn("score", F.round("score", 9))


def suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_array.dedup(_documents(spark, sf_dir))


def incremental_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_index.dedup(_documents(spark, sf_dir))


def ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(_documents(spark, sf_dir))


def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    model = langid.fit(docs, _remainder("doc_id", 4) != 2)
    found = langid.identify(docs, model, into="language")
    return found.select("doc_id", (_remainder("doc_id", 4) == 2).alias("held_out"), "language.lang_pred", "language.score", "language.margin", (~langid.is_clear("language", model)).alias("rejected"))


def hard_negative_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0, label=label)


def conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def content_addressed_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the archive, reads it back, and takes all columns from what was read."""
    archive = warc.write(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return archive.read(spark).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


MIXING_SQL = r"""
WITH base AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h FROM documents),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM base GROUP BY source),
classes AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS class FROM sources),
weighed AS (SELECT *, CASE class WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, source_size * 3 AS most FROM classes),
ranked AS (
  SELECT *, row_number() OVER o AS place,
    CAST(sum(source_size) OVER () AS BIGINT) - CAST(coalesce(sum(most) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS rest,
    sum(weight) OVER () - coalesce(sum(weight) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS weights
  FROM weighed WINDOW o AS (ORDER BY CAST(most AS DOUBLE) / weight, source NULLS LAST)),
level AS (SELECT place AS first_place, rest AS first_rest, weights AS first_weights FROM ranked
  WHERE CAST(rest AS DOUBLE) * weight <= CAST(most AS DOUBLE) * weights ORDER BY place LIMIT 1),
goals AS (SELECT source, source_size, class,
    CASE WHEN place < first_place THEN CAST(most AS DOUBLE) ELSE weight * CAST(first_rest AS DOUBLE) / first_weights END AS target FROM ranked, level),
placed AS (
  SELECT b.doc_id, b.size, g.source_size, g.target, g.class,
    CAST(sum(b.size) OVER (PARTITION BY b.source ORDER BY b.h, b.doc_id, b.size ROWS UNBOUNDED PRECEDING) AS BIGINT) - b.size AS begins,
    CASE WHEN g.source_size > 0 THEN CAST(floor(floor(g.target) / g.source_size) AS BIGINT) ELSE 0 END AS passes
  FROM base b JOIN goals g ON b.source IS NOT DISTINCT FROM g.source),
cut AS (SELECT *, least(size, greatest(0, CAST(floor(target) AS BIGINT) - passes * source_size - begins)) AS part FROM placed),
curve AS (SELECT *, CASE class WHEN 0 THEN 1.5::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS y0,
    CASE class WHEN 0 THEN 0.5::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 1.5::DOUBLE END AS y1, CAST(begins AS DOUBLE) / target AS share FROM cut)
SELECT doc_id, size, source_size, target, CAST(passes * size + part AS BIGINT) AS taken,
  CASE WHEN size > 0 AND (passes > 0 OR part > 0) THEN
    least(greatest(2 * share / (y0 + sqrt(greatest(y0 * y0 + 2 * (y1 - y0) * share, 0.0::DOUBLE))), 0.0::DOUBLE), 1.0::DOUBLE) END AS position
FROM curve
"""

VECTOR_GROUPS_SQL = """
WITH RECURSIVE d AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL AND label IS NOT NULL),
v AS (SELECT *, sqrt(list_dot_product(e, e)) AS n FROM d WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.98),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY 1), firsts AS (SELECT a, min(b) AS b FROM reach GROUP BY 1)
SELECT vec_id, CAST(coalesce(c.n, 0) AS BIGINT) AS n_links, least(vec_id, coalesce(f.b, vec_id)) AS component_id, vec_id <= coalesce(f.b, vec_id) AS kept
FROM embeddings LEFT JOIN counts c ON c.a = vec_id LEFT JOIN firsts f ON f.a = vec_id
"""

NEAREST_SQL = """
WITH d AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL AND vec_id IS NOT NULL),
v AS (SELECT *, sqrt(list_dot_product(e, e)) AS n FROM d WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e) / (q.n * c.n) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, round(score, 9) AS score FROM s QUALIFY rank <= 5
"""

WINDOWS_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
starts AS (SELECT doc_id, unnest(range(len(w) - 19)) AS i, w FROM w WHERE len(w) >= 20),
ranked AS (SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(w[i + 1 : i + 20], ' ') ORDER BY doc_id, i) > 1 AS again FROM starts),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i FROM w),
flagged AS (SELECT words.*, max(coalesce(again, false)::INT) OVER (PARTITION BY words.doc_id ORDER BY words.i ROWS 19 PRECEDING) AS gone FROM words LEFT JOIN ranked USING (doc_id, i)),
kept AS (SELECT doc_id, count(*) AS n_words, count_if(gone = 1) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (gone = 0) AS kept FROM flagged GROUP BY 1)
SELECT doc_id, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents LEFT JOIN kept USING (doc_id)
"""

SUBSTRINGS_SQL = r"""
WITH t AS (SELECT doc_id, row_number() OVER () AS k, encode(coalesce(text, '')) AS b FROM documents),
starts AS (SELECT k, unnest(list_transform(range(octet_length(b) - 199), lambda i: md5_number(b[i + 1 : i + 200]))) AS h, unnest(range(octet_length(b) - 199)) AS i FROM t WHERE octet_length(b) >= 200),
again AS (SELECT k, i FROM starts QUALIFY count(*) OVER (PARTITION BY h) > 1),
edges AS (SELECT k, i, coalesce(i - lag(i) OVER o > 200, true) AS opens FROM again WINDOW o AS (PARTITION BY k ORDER BY i)),
numbered AS (SELECT k, i, sum(opens::INT) OVER (PARTITION BY k ORDER BY i ROWS UNBOUNDED PRECEDING) AS span FROM edges),
spans AS (SELECT k, min(i) AS a, max(i) + 200 AS z FROM numbered GROUP BY k, span),
lists AS (SELECT k, list(a ORDER BY a) AS a, list(z ORDER BY a) AS z, sum(z - a) AS n FROM spans GROUP BY k)
SELECT doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, CAST(coalesce(len(a), 0) AS BIGINT) AS n_spans,
  sha256(unhex(CASE WHEN a IS NULL THEN hex(b) ELSE array_to_string(list_transform(range(len(a) + 1), lambda j: hex(b[CASE WHEN j = 0 THEN 1 ELSE z[j] + 1 END : CASE WHEN j = len(a) THEN octet_length(b) ELSE a[j + 1] END])), '') END)) AS kept_sha256
FROM t LEFT JOIN lists USING (k)
"""

BASE_SECRETS_SQL = r"""
WITH t AS (SELECT doc_id, row_number() OVER () AS k, coalesce(text, '') AS x FROM documents),
patterns(o, kind, pattern) AS (VALUES (0, 'assign', '((?i:password|passwd|secret|token|api_?key))["'']? *[:=] *["'']?([A-Za-z0-9+/_.=-]+)'), (1, 'access', 'AKIA[A-Z0-9]+'), (2, 'hex', '[0-9a-f]+')),
pieces AS (
  SELECT k, 0 AS o, 'assign' AS kind, string_split(regexp_replace(x, '((?i:password|passwd|secret|token|api_?key))["'']? *[:=] *["'']?([A-Za-z0-9+/_.=-]+)', chr(57344) || '\0' || chr(57345), 'g'), chr(57344)) AS s FROM t
  UNION ALL SELECT k, 1, 'access', string_split(regexp_replace(x, 'AKIA[A-Z0-9]+', chr(57344) || '\0' || chr(57345), 'g'), chr(57344)) FROM t
  UNION ALL SELECT k, 2, 'hex', string_split(regexp_replace(x, '[0-9a-f]{24,}', chr(57344) || '\0' || chr(57345), 'g'), chr(57344)) FROM t),
places AS (SELECT k, o, kind, s, unnest(range(2, len(s) + 1)) AS i FROM pieces WHERE len(s) > 1),
matches AS (SELECT k, o, kind, split_part(s[i], chr(57345), 1) AS v, CAST(list_sum(list_transform(s[1 : i - 1], lambda y: len(y))) AS BIGINT) - (i - 2) AS a FROM places),
kept AS (SELECT *, a + len(v) AS z FROM matches WHERE CASE kind WHEN 'assign' THEN len(regexp_extract(v, '["'']? *[:=] *["'']?([A-Za-z0-9+/_.=-]+)$', 1)) >= 6 WHEN 'access' THEN len(v) >= 20 ELSE true END),
counts AS (SELECT k, count_if(o = 0) AS n_assign, count_if(o = 1) AS n_access, count_if(o = 2) AS n_hex, string_agg(kind || ':' || a || ':' || z, ',' ORDER BY a, o) AS spans FROM kept GROUP BY k)
SELECT doc_id, CAST(coalesce(n_assign, 0) AS BIGINT) AS n_assign, CAST(coalesce(n_access, 0) AS BIGINT) AS n_access, CAST(coalesce(n_hex, 0) AS BIGINT) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256 FROM t LEFT JOIN counts USING (k)
"""

JACCARD_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(len(w) - 4), lambda i: array_to_string(w[i + 1 : i + 5], ' '))) WHEN len(w) > 0 THEN ['short ' || array_to_string(w, ' ')] ELSE [] END AS s FROM w),
items AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS common FROM items a JOIN items b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs WHERE 100 * common >= 80 * (na + nb - common)),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
firsts AS (SELECT a, min(b) AS b FROM reach GROUP BY 1)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, least(doc_id, coalesce(b, doc_id)) AS component_id FROM sets LEFT JOIN firsts ON a = doc_id
"""

WARC_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, CAST(octet_length(b) AS BIGINT) AS payload_bytes, sha256(b) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first, row_number() OVER (PARTITION BY payload_digest ORDER BY page_id) > 1 AND payload_bytes >= 100 AS again FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN first END AS refers_to FROM f
"""

HARD_NEGATIVES_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, CAST(list_dot_product(a.e, b.e) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE a.vec_id % 100 = 0),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5)
SELECT p.a AS anchor_id, p.b AS positive_id, CAST(row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b) AS INTEGER) AS rank, s.b AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.a = p.a AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score QUALIFY rank <= 10
"""

# DuckDB has no CRC-32: a turn of the register's low bit, 8 for each digit of the id.
TRIE_SQL = r"""
WITH c AS (SELECT conv_id, list({'r': coalesce(role, ''), 't': coalesce(text, '')} ORDER BY turn NULLS FIRST, sha256(len(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS own FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1),
h AS (SELECT conv_id, own, CAST(xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
    lambda a, x: list_reduce(list_prepend(xor(a, x), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda y, z: CASE WHEN y % 2 = 1 THEN xor(y // 2, 3988292384::BIGINT) ELSE y // 2 END)), 4294967295::BIGINT) % 4 AS BIGINT) AS h FROM c),
r AS (SELECT h.conv_id, list_concat(coalesce(b.own[1 : h.h], []), h.own[h.h + 1 :]) AS turns FROM h LEFT JOIN h b ON b.conv_id = h.conv_id - h.conv_id % 20),
p AS (SELECT conv_id, unnest(range(len(turns) + 1)) AS depth, turns FROM r),
k AS (SELECT conv_id, depth, md5(CAST(turns[1 : depth] AS VARCHAR)) || depth AS key, CASE WHEN depth > 0 THEN md5(CAST(turns[1 : depth - 1] AS VARCHAR)) || (depth - 1) END AS up, depth = len(turns) AS ends,
  CASE WHEN depth > 0 THEN len(regexp_extract_all(turns[depth].t, '[^ 	-
]+')) ELSE 0 END AS words FROM p),
n AS (SELECT key, any_value(up) AS up, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(words) AS saved, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM k GROUP BY key),
children AS (SELECT up AS key, count(*) AS n FROM n WHERE up IS NOT NULL GROUP BY 1),
all_ AS (SELECT n.*, coalesce(children.n, 0) AS n_children FROM n LEFT JOIN children USING (key)),
sums AS (SELECT k.key, count_if(a.n_children = 0) AS n_leaves, sum(a.saved) AS saved FROM all_ a JOIN k ON k.conv_id = a.conv_id AND k.depth <= a.depth GROUP BY 1)
SELECT a.conv_id, a.depth, u.conv_id AS parent_conv_id, a.n_convs, CAST(a.n_children AS BIGINT) AS n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, a.ends_sha256
FROM all_ a JOIN sums s USING (key) LEFT JOIN n u ON u.key = a.up
"""

QUERIES = {
    "op1_best_fit_packing": best_fit_packing,
    "op2_embedding_near_dedup": embedding_near_dedup,
    "op3_secret_scan": secret_scan,
    "op4_quality_classifier": quality_classifier,
    "op5_curriculum_mixing": curriculum_mixing,
    "op6_nearest_neighbours": nearest_neighbours,
    "op7_suffix_array_dedup": suffix_array_dedup,
    "op8_incremental_substring_dedup": incremental_substring_dedup,
    "op9_ngram_jaccard_join": ngram_jaccard_join,
    "op10_language_id": language_id,
    "op11_hard_negatives": hard_negative_mining,
    "op12_conversation_trie": conversation_trie,
    "op13_content_addressed_warc": content_addressed_warc,
    "secrets_by_base_patterns": base_secrets,
    "nearest_by_all_comparisons": nearest_neighbours_exact,
}

ORACLE_SQL = {
    "op2_embedding_near_dedup": VECTOR_GROUPS_SQL,
    "op8_incremental_substring_dedup": WINDOWS_SQL,
    "op9_ngram_jaccard_join": JACCARD_SQL,
    "op5_curriculum_mixing": MIXING_SQL,
    "op7_suffix_array_dedup": SUBSTRINGS_SQL,
    "op11_hard_negatives": HARD_NEGATIVES_SQL,
    "op12_conversation_trie": TRIE_SQL,
    "op13_content_addressed_warc": WARC_SQL,
    "secrets_by_base_patterns": BASE_SECRETS_SQL,
    "nearest_by_all_comparisons": NEAREST_SQL,
}
