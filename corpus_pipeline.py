"""Corpus pipeline: language ID, near duplicates, secret scans, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a frame; run() writes each as Parquet in the shared folder and
rereads it as the next one's docs. All stages but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm import bpe, common, language_id, mixing, ngram_join, secret_scan
from weft.llm.common import small_batches, table, written


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised, `lang` set to it; rejected ones (null and letterless texts too) go. Without
    any labelled row nothing can be recognised, and all go."""
    small_batches(spark)
    model = language_id.fit(language_id.training_rows(docs))
    found = common.free(docs, "__weft_lang")
    rows = docs.withColumn(found, language_id.predicted(F.col("text"), model)).where(~F.col(found)["rejected"])
    return rows.withColumn("lang", F.col(found)["lang"]).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates, the one of the least doc_id (none last): five-word shingles,
    Jaccard similarity 0.8 or more. Texts without words stay, equal rows of them but once."""
    return ngram_join.deduplicated(docs, words=5, num=80, den=100)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, the secrets in their texts masked; null and empty texts stay as they are."""
    rows = secret_scan.redacted(docs, secret_scan.trained(spark))
    return rows.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it: not at all, once or twice. Documents are told apart by
    doc_id and text, so that missing or repeated ids get draws of their own; rows equal in both count as one, and
    texts without words go."""
    key, n, copy = (common.free(docs, f"__weft_{x}") for x in ("key", "n", "copy"))
    both = F.concat_ws(":", "doc_id", F.xxhash64("text"))
    one = docs.select(both.alias(key), "source", mixing.words(F.col("text")).alias("size")).dropDuplicates([key])
    times = mixing.mixed(one, key=key).select(key, mixing.copies(key=key).alias(n)).where(F.col(n) > 0)
    rows = docs.withColumn(key, both).join(times, key)
    return rows.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(n)))).select(*docs.columns)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, decoded again as a check; a null text has none."""
    small_batches(spark, 200)
    t = bpe.tokenised(F.col("text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return docs.select("doc_id", "lang", "source", t.alias("t")).select("doc_id", "lang", "source", "t.n_tokens", "t.decodes", F.col("t.ids").alias("token_ids"))


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("secret_scan", mask_secrets),
    ("mixing", mix_sources),
    ("byte_bpe", encode_tokens),
]

#: No SQL expresses a trained classifier or BPE; the stages are tested against brute force in tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        made = list(common.MADE)
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
        here = common.MADE[-1]
        common.removed(spark, [at for at in list(common.MADE) if at == last or (at not in made and at != here)])
        last = here
    return STAGES[-1][1](spark, docs, sf_dir)
