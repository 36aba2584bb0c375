"""The registered query of each operator: thin, over the whole table, with the column names its contract fixes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrain.storage import Scratch


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexigrain.llm import mixing

    docs = _read(spark, sf_dir, "documents")
    text = F.col("text")
    out = mixing.plan(docs, Scratch(spark, "mix"), mixing.n_words(text), mixing.letter_weight(text))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexigrain.llm import substrings

    return substrings.dedup(_read(spark, sf_dir, "documents"), Scratch(spark, "substrings"))


def op3_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexigrain.llm import sharding

    out = sharding.shard(_read(spark, sf_dir, "documents"), Scratch(spark, "shard"))
    return out.withColumn("law", F.lit("rows")).withColumn("grown_shard", F.lit(None).cast("int"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexigrain.llm import decontaminate

    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontaminate.flag(docs, _read(spark, sf_dir, "benchmark"), Scratch(spark, "decontaminate"))
    ids = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), ids.alias("items_sha256"), "contaminated")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexigrain.llm import rules

    return rules.judge(_read(spark, sf_dir, "documents"), text=True).drop("failed_lines", "kept_text")


def op6_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexigrain.llm import chunks

    return chunks.dedup(_read(spark, sf_dir, "documents"), Scratch(spark, "chunks"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexigrain.llm import minhash

    out = minhash.components(_read(spark, sf_dir, "documents").select("doc_id", "text"), Scratch(spark, "near"), 3, 85, 100)
    return out.drop("text_hash")


def op8_sanitise(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexigrain.llm import pii

    return pii.report(_read(spark, sf_dir, "documents").select("doc_id", "text"), Scratch(spark, "pii"))


def op9_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexigrain.llm import classifier

    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    out = classifier.score(docs, _read(spark, sf_dir, "labels"), Scratch(spark, "classify"))
    return out.select("doc_id", classifier.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexigrain.llm import warc

    path = Scratch(spark, "warc").path
    warc.write(_read(spark, sf_dir, "pages"), path)
    return warc.read(spark, path, payload=False).drop("url", "payload")


QUERIES = {
    "op1_mix": op1_mix,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_shard": op3_shard,
    "op4_decontaminate": op4_decontaminate,
    "op5_quality_rules": op5_quality_rules,
    "op6_chunk_dedup": op6_chunk_dedup,
    "op7_near_dedup": op7_near_dedup,
    "op8_sanitise": op8_sanitise,
    "op9_classify": op9_classify,
    "op10_warc": op10_warc,
}

ORACLE_SQL = {
    "op7_near_dedup": r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
grams AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN w ELSE w[i:i + 2] END AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM docs WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY 1),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
both_ AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN both_ l ON l.a = r.b)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, component_id = d.doc_id AS kept
FROM docs d LEFT JOIN sizes USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1) USING (doc_id)""",
    "op10_warc": r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS payload_digest, max(page_id) OVER (PARTITION BY html) AS top FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND top IS NOT NULL AND page_id IS DISTINCT FROM top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM top THEN top END AS refers_to
FROM d""",
    "op1_mix": r"""
WITH docs AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    coalesce(greatest(0.25::DOUBLE, 1.0::DOUBLE - 4.0::DOUBLE * (length(text) - length(regexp_replace(text, '[#*$%&|<>!]', '', 'g')))
      / greatest(length(text), 1)), 1.0::DOUBLE) AS w,
    (('0x' || substr(md5('0|' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u
  FROM documents),
src AS (SELECT source, sum(size)::HUGEINT AS s FROM docs GROUP BY source),
ranked AS (
  SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INT]::HUGEINT AS weight,
    3 * sum(s) OVER () AS budget2
  FROM src),
ordered AS (
  SELECT *, row_number() OVER (ORDER BY 2 * s::DOUBLE / weight, source IS NULL, source) AS k FROM ranked),
remaining AS (
  SELECT *, budget2 - 2 * coalesce(sum(2 * s) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left2,
    sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS wleft
  FROM ordered),
capped AS (SELECT *, 4 * s * wleft <= left2 * weight AS cap FROM remaining),
edge AS (SELECT left2, wleft FROM capped WHERE NOT cap ORDER BY k LIMIT 1),
goal AS (
  SELECT source, s::BIGINT AS source_size,
    CASE WHEN cap THEN (2 * s)::DOUBLE ELSE weight::DOUBLE * (SELECT left2::DOUBLE FROM edge) / (SELECT (2 * wleft)::DOUBLE FROM edge) END AS target
  FROM capped),
run AS (
  SELECT d.doc_id, d.size, g.source_size, g.target,
    CASE WHEN g.source_size > 0 THEN floor(g.target / g.source_size) ELSE 0 END::BIGINT AS epochs,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY pow(d.u, 1.0::DOUBLE / d.w) DESC, d.doc_id, d.size ROWS UNBOUNDED PRECEDING)::BIGINT - d.size AS first
  FROM docs d JOIN goal g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
  (epochs * size + greatest(0, least(size, floor(target - epochs * source_size)::BIGINT - first)))::BIGINT AS taken
FROM run""",
    "op4_decontaminate": r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
wins AS (SELECT DISTINCT item_id, w[i:i + 9] AS words FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 8, 2))) AS i FROM items WHERE len(w) > 0)),
spots AS (SELECT r, n, len, w[i:i + len - 1] AS words, i
  FROM (SELECT r, w, l.len AS len, len(w) AS n, unnest(range(1, len(w) - l.len + 2)) AS i FROM docs, (SELECT DISTINCT len(words) AS len FROM wins) l)),
found AS (SELECT s.r, s.i, s.len, w.item_id FROM spots s JOIN wins w USING (words)),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + len)) AS p FROM found) GROUP BY r),
ids AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM found GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit USING (r) LEFT JOIN ids USING (r)""",
    "op5_quality_rules": r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
words AS (SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM docs),
grams AS (SELECT r, i, w[i:i + 7] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM words)),
twice AS (SELECT r, i FROM grams QUALIFY count(*) OVER (PARTITION BY r, g) >= 2),
repeats AS (SELECT r, count(DISTINCT p) AS n_repeat FROM (SELECT r, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY r),
lines AS (
  SELECT r, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS k FROM (SELECT r, string_split(text, chr(10)) AS l FROM docs)),
worded AS (
  SELECT *, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS w, row_number() OVER (PARTITION BY r, line ORDER BY k) > 1 AS dup
  FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
counted AS (
  SELECT *, len(w) AS n, length(array_to_string(w, '')) AS chars,
    length(line) - length(regexp_replace(line, '[#*$%&|<>]', '', 'g')) AS n_sym,
    length(line) - length(replace(line, '!', '')) AS n_bang,
    length(line) - length(regexp_replace(line, '[|>]', '', 'g')) AS n_bar
  FROM worded),
judged AS (
  SELECT *, 10 * n_sym > chars OR (n_bang >= 3 AND 4 * n_bang > n) OR (n_bar >= 3 AND 3 * n_bar > n)
    OR (n < 3 AND NOT regexp_matches(w[len(w)], '[.!?:;"'')\]…”’»。！？]$'))
    OR regexp_matches(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'all rights reserved|licensed under|released under the|terms of use|terms of service|privacy policy|cookie policy|enable javascript|lorem ipsum|click here|sign up for') AS fails
  FROM counted),
per_doc AS (SELECT r, count(*) FILTER (WHERE dup) AS n_dup, count(*) FILTER (WHERE fails) AS n_fail, coalesce(sum(n) FILTER (WHERE fails), 0) AS lost FROM judged GROUP BY r),
base AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    coalesce(n_dup, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat, 0)::BIGINT AS n_repeat_words,
    coalesce(n_fail, 0)::BIGINT AS n_lines_failed, coalesce(lost, 0)::BIGINT AS n_words_lost
  FROM docs JOIN words USING (r) LEFT JOIN per_doc USING (r) LEFT JOIN repeats USING (r))
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND 100 * n_words_lost <= 40 * n_words AS kept
FROM base""",
}
