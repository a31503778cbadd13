"""The registered queries of the training-data operators and, where SQL expresses them, their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, html_extract, language_id, license_scan, mixing, nearest, ngram_join, quality_rules, secret_scan, toxicity
from .common import small_batches, table


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    small_batches(spark)
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    r = bpe.round_trip(F.col("text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return d.select("doc_id", r.alias("r")).select("doc_id", "r.n_tokens", "r.ids_sha256", "r.decoded_sha256")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judged(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", *[F.col(f"_q.{c}").alias(c) for c in OP2_COLUMNS])


OP2_COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]

_STOPS = ", ".join(f"'{w}'" for w in sorted({w for ws in quality_rules.STOP_WORDS.values() for w in ws.split()}))

OP2_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents),
win AS (
  SELECT rid, i, array_to_string(list_slice(ws, i, i + 7), ' ') AS w
  FROM (SELECT rid, ws, unnest(generate_series(1, len(ws) - 7)) AS i FROM d)),
hit AS (
  SELECT rid, i, coalesce(lead(i) OVER (PARTITION BY rid ORDER BY i) - i, 8) AS gap
  FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, w) AS c FROM win) WHERE c > 1),
rep AS (SELECT rid, CAST(sum(least(gap, 8)) AS BIGINT) AS n FROM hit GROUP BY rid),
m AS (
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
         len(ls) AS n_lines,
         len(list_filter(ls, lambda x: regexp_matches(x, '^ *[-*•‣]'))) AS n_bullet,
         len(list_filter(ls, lambda x: regexp_matches(x, '(\.\.\.|…) *$'))) AS n_ellipsis,
         len(list_filter(ws, lambda x: lower(rtrim(x, ',.;:!?')) IN ({_STOPS}))) AS n_stop
  FROM d LEFT JOIN rep USING (rid)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed
  AND NOT (n_words >= 20 AND (word_chars / greatest(n_words, 1) < 2.0 OR word_chars / greatest(n_words, 1) > 10.0))
  AND NOT (n_words >= 20 AND n_symbols / greatest(n_words, 1) > 0.6)
  AND NOT (n_words >= 50 AND n_stop / greatest(n_words, 1) < 0.02)
  AND NOT (n_words >= 20 AND n_dup_lines / greatest(n_lines, 1) > 0.5)
  AND NOT (n_words >= 50 AND n_bullet / greatest(n_lines, 1) > 0.9)
  AND NOT (n_words >= 50 AND n_ellipsis / greatest(n_lines, 1) > 0.5) AS kept
FROM b"""


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest.neighbours(v, F.col("vec_id") % 100 == 0, k=10)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(toxicity.training_rows(d, table(spark, sf_dir, "labels")))
    r = toxicity.graded(F.col("text"), model)
    return d.select("doc_id", r.alias("r")).select("doc_id", F.col("r.severity").alias("score"), "r.severity", "r.grade", "r.toxic", "r.n_evidence")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "source", mixing.words(F.col("text")).alias("size"))
    return mixing.mixed(d).select("doc_id", "size", "source_size", "target", "taken", "source")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return secret_scan.findings(d, secret_scan.trained(spark))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    model = language_id.fit(language_id.training_rows(d.where(~held_out)))
    r = language_id.predicted(F.col("text"), model)
    return d.select("doc_id", held_out.alias("held_out"), r.alias("r")).select("doc_id", "held_out", F.col("r.lang").alias("lang_pred"), "r.score", "r.rejected")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return d.select("doc_id", license_scan.scanned(F.col("text")).alias("r")).select("doc_id", "r.*")


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    p = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return p.select("page_id", "url", html_extract.extracted(F.col("html")).alias("text")).withColumn("n_chars", F.length("text").cast("bigint"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.components(table(spark, sf_dir, "documents").select("doc_id", "text"), words=3, num=90, den=100)


QUERIES = {
    "op1_byte_bpe": op1_byte_bpe,
    "op4_toxicity": op4_toxicity,
    "op5_mixing": op5_mixing,
    "op7_language_id": op7_language_id,
    "op8_license_scan": op8_license_scan,
    "op9_html_extraction": op9_html_extraction,
    "op10_ngram_join": op10_ngram_join,
    "op3_nearest": op3_nearest,
    "op6_secret_scan": op6_secret_scan,
    "op2_quality_rules": op2_quality_rules,
}

ORACLE_SQL = {
    "op2_quality_rules": OP2_SQL,
}
