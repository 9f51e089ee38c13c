"""The registered queries of this subpackage, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import exact_dedup, html_extraction, jaccard_join, mixing, quality_classifier, quality_rules, sentencepiece_codec, substring_dedup, suffix_dedup, token_counts


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = html_extraction.extract_main_text(_table(spark, sf_dir, "pages"))
    return texts.select(F.col("id").alias("page_id"), "url", "text", "n_chars")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.count_document_tokens(_table(spark, sf_dir, "documents"))
    return counts.select(F.col("id").alias("doc_id"), "n_tokens")


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_classifier.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    columns = ["p_quality", "p_toxic", "host_posterior", "path_posterior", "posterior"]
    return judged.select(F.col("id").alias("doc_id"), *(F.round(c, 9).alias(c) for c in columns), "kept")


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = sentencepiece_codec.encode(_table(spark, sf_dir, "documents"))
    return coded.select(F.col("id").alias("doc_id"), "n_tokens", "round_trip", "tokens")


def sp_joined_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The codec with every unit of the documents from the relational lattice."""
    coded = sentencepiece_codec.encode_joined(_table(spark, sf_dir, "documents"))
    return coded.select(F.col("id").alias("doc_id"), "n_tokens", "round_trip", "tokens")


def sp_viterbi_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best paths of the units of the benchmark's texts."""
    return sentencepiece_codec.viterbi_units(_table(spark, sf_dir, "benchmark"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.quality_rules(_table(spark, sf_dir, "documents"))
    return judged.select(
        F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed_words", "kept_sha256"
    )


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = substring_dedup.remove_repeated_spans(_table(spark, sf_dir, "documents"))
    return cleaned.select(F.col("id").alias("doc_id"), "n_sentences", "n_removed", "text", "kept_sha256")


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = suffix_dedup.remove_repeated_bytes(_table(spark, sf_dir, "documents"), length=200, keep_first=False)
    return cleaned.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, _ = mixing.mix_sources(_table(spark, sf_dir, "documents"))
    return documents.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_join.jaccard_components(_table(spark, sf_dir, "documents"), width=4, percent=85)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.exact_duplicates(_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256"))


_OP5_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT doc_id, unnest(x) AS word, generate_subscripts(x, 1) AS i
  FROM (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS x FROM d)
), t AS (
  SELECT doc_id, i, word || ' ' || lead(word) OVER p || ' ' || lead(word, 2) OVER p AS g
  FROM w WINDOW p AS (PARTITION BY doc_id ORDER BY i)
), r AS (SELECT doc_id, g FROM t WHERE g IS NOT NULL GROUP BY doc_id, g HAVING count(*) > 1),
c AS (
  SELECT doc_id, count(DISTINCT i + k) AS n
  FROM t JOIN r USING (doc_id, g), (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id
), wn AS (SELECT doc_id, count(*) AS n, sum(length(word)) AS chars FROM w GROUP BY doc_id),
l AS (
  SELECT doc_id, source, unnest(x) AS line, generate_subscripts(x, 1) AS i
  FROM (SELECT doc_id, source, string_split(text, chr(10)) AS x FROM d)
), lw AS (
  SELECT doc_id, source, line, i, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS x
  FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lw GROUP BY doc_id),
ln AS (
  SELECT doc_id, source, i, len(x) AS n,
         translate(array_to_string(x, ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS line
  FROM lw
), h AS (SELECT source, count(*) AS docs FROM d GROUP BY source),
f AS (
  SELECT source, line, count(DISTINCT doc_id) AS n FROM ln GROUP BY source, line
), hot AS (
  SELECT f.source, f.line FROM f JOIN h ON f.source IS NOT DISTINCT FROM h.source
  WHERE f.n > 20 AND 100 * f.n > 1 * h.docs
), gone AS (
  SELECT ln.doc_id, sum(ln.n) AS n FROM ln JOIN hot ON ln.source IS NOT DISTINCT FROM hot.source AND ln.line = hot.line
  GROUP BY ln.doc_id
), cut AS (
  SELECT ln.doc_id, ln.i FROM ln JOIN hot ON ln.source IS NOT DISTINCT FROM hot.source AND ln.line = hot.line
), clean AS (
  SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.i) AS text
  FROM l ANTI JOIN cut ON l.doc_id = cut.doc_id AND l.i = cut.i GROUP BY l.doc_id
), s AS (
  SELECT d.doc_id, coalesce(wn.n, 0) AS n_words, coalesce(wn.chars, 0) AS word_chars,
         length(d.text) - length(regexp_replace(d.text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         coalesce(dup.n, 0) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words, coalesce(gone.n, 0) AS n_removed_words,
         sha256(coalesce(clean.text, '')) AS kept_sha256
  FROM d LEFT JOIN wn USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN c USING (doc_id) LEFT JOIN gone USING (doc_id)
       LEFT JOIN clean USING (doc_id)
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
       CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * n_removed_words <= 50 * n_words AS kept,
       CAST(n_removed_words AS BIGINT) AS n_removed_words, kept_sha256
FROM s
"""

_OP10_SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
), k AS (
  SELECT text_sha256, count(*) AS group_size,
         first(doc_id ORDER BY points DESC, doc_id) AS keep_id
  FROM n GROUP BY text_sha256
)
SELECT n.doc_id, k.keep_id, CAST(k.group_size AS BIGINT) AS group_size,
       n.doc_id = k.keep_id AS kept, n.text_sha256
FROM n JOIN k USING (text_sha256)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_html_extraction": op1_html_extraction,
        "op2_token_counts": op2_token_counts,
        "op3_quality_classifier": op3_quality_classifier,
        "op4_sentencepiece": op4_sentencepiece,
        "op5_quality_rules": op5_quality_rules,
        "sp_joined_lattice": sp_joined_lattice,
        "sp_viterbi_lattice": sp_viterbi_lattice,
        "op6_substring_dedup": op6_substring_dedup,
        "op7_suffix_array_dedup": op7_suffix_array_dedup,
        "op8_source_mixing": op8_source_mixing,
        "op9_jaccard_join": op9_jaccard_join,
        "op10_exact_dedup": op10_exact_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_quality_rules": _OP5_SQL, "op10_exact_dedup": _OP10_SQL}
