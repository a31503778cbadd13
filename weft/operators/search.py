"""Search over documents: postings, BM25 (Okapi), thresholds, tiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions.text import tokens

K1, B, EPSILON = 1.5, 0.75, 0.25


def postings(docs: DataFrame, key: str, text: Column) -> DataFrame:
    """(doc, term, tf, dl): term frequencies and document lengths, one pass and one aggregation."""
    d = docs.select(F.col(key).alias("doc"), tokens(text).alias("ts")).withColumn("dl", F.size("ts"))
    return d.select("doc", "dl", F.explode("ts").alias("term")).groupBy("doc", "term", "dl").agg(F.count("*").alias("tf"))


def bm25(docs: DataFrame, key: str, text: Column, query: list[str]) -> DataFrame:
    """(doc, score) of documents that hold any query term. A negative idf is EPSILON times the mean idf of all terms."""
    lengths = docs.select(F.col(key).alias("doc"), F.size(tokens(text)).alias("dl"))
    n, mean = lengths.agg(F.count("*"), F.avg("dl")).first()
    post = postings(docs, key, text)
    df = post.groupBy("term").agg(F.count("*").alias("df"))
    idf = df.withColumn("idf", F.log(F.lit(float(n)) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    floor = EPSILON * (idf.agg(F.avg("idf")).first()[0] or 0.0)
    idf = idf.where(F.col("term").isin(*query)).withColumn("idf", F.when(F.col("idf") < 0, floor).otherwise(F.col("idf")))
    hits = post.where(F.col("term").isin(*query)).join(idf, "term")
    weight = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(float(mean or 1))))
    return hits.groupBy("doc").agg(F.round(F.sum(weight), 6).alias("score"))


def best(scores: DataFrame, share: float, low_share: float, k: int) -> DataFrame:
    """Results above a share of the best score: all at 0.001 if the best is 0, shifted scores if it is negative."""
    bounds = scores.agg(F.max("score"), F.min("score")).first()
    top, least = bounds[0] or 0.0, bounds[1] or 0.0
    if top > 0:
        out = scores.where(F.col("score") >= max(0.001, share * top))
    elif top == 0:
        out = scores.withColumn("score", F.lit(0.001))
    else:
        out = scores.where(F.col("score") >= least + low_share * (top - least)).withColumn("score", F.col("score") - least + 0.001)
    return out.orderBy(F.col("score").desc(), "doc").limit(k)


def tiered(tiers: list[tuple[int, float, DataFrame]], k: int) -> DataFrame:
    """Union of (tier number, factor, (doc, score)), each document at its first tier, best k by score."""
    every = None
    for number, factor, rows in tiers:
        part = rows.select("doc", (F.col("score") * factor).alias("score"), F.lit(number).alias("tier"))
        every = part if every is None else every.unionByName(part)
    first = every.groupBy("doc").agg(F.min(F.struct("tier", "score")).alias("f")).select("doc", "f.tier", "f.score")
    return first.orderBy(F.col("score").desc(), "doc").limit(k)
