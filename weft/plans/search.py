"""Search queries: tokens, BM25 over documents and graph nodes, tiers, focus, discovery."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.functions.text import tokens
from weft.operators import graph, search
from weft.plans import star
from weft.registry import query
from weft.session import table

_TOKENS = r"list_filter(string_split_regex(lower(regexp_replace(coalesce({0}, ''), '([a-z])([A-Z])', '\1 \2', 'g')), '[\s_\-\.\/\\:;,\(\)\[\]{{}}]+'), lambda w: length(w) >= 2)"
TERMS = ["the", "license", "token"]


@query("tokenize", f"SELECT p_partkey AS id, array_to_string({_TOKENS.format('p_type')}, ' ') AS tokens FROM part")
def tokenize(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.array_join(tokens(F.col("p_type")), " ").alias("tokens"))


def _bm25(source: str, key: str, text: str, terms: list[str]) -> str:
    held = ", ".join(f"'{x}'" for x in terms)
    return f"""dt AS (SELECT {key} AS doc, {_TOKENS.format(text)} AS ts FROM {source}),
post AS (SELECT doc, term, len(any_value(ts)) AS dl, count(*) AS tf FROM (SELECT doc, ts, unnest(ts) AS term FROM dt) GROUP BY 1, 2),
st AS (SELECT count(*) AS n, avg(len(ts)) AS mean FROM dt),
idf AS (SELECT term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS idf FROM post, st GROUP BY term, n),
fl AS (SELECT 0.25 * avg(idf) AS floor FROM idf),
scores AS (SELECT doc, round(sum((CASE WHEN idf < 0 THEN floor ELSE idf END) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / mean))), 6) AS score
  FROM post JOIN idf USING (term), st, fl WHERE term IN ({held}) GROUP BY doc)"""


_NODES = "nodes2 AS (SELECT node_id, name || ' ' || node_type || ' ' || properties AS txt FROM nodes)"


def _docs_scores(spark, d, terms=TERMS):
    return search.bm25(table(spark, d, "documents"), "doc_id", F.col("text"), terms)


def _node_scores(spark, d, terms):
    n = star.nodes(spark, d)
    return search.bm25(n, "node_id", F.concat_ws(" ", "name", "node_type", "properties"), terms)


@query("bm25_scores", f"WITH {_bm25('documents', 'doc_id', 'text', TERMS)} SELECT doc AS doc_id, score FROM scores")
def bm25_scores(spark, d):
    return _docs_scores(spark, d).withColumnRenamed("doc", "doc_id")


def _top(share: float, k: int) -> str:
    return f"SELECT doc, score FROM scores WHERE score >= greatest(0.001, {share} * (SELECT max(score) FROM scores)) ORDER BY score DESC, doc LIMIT {k}"


@query("search_metadata", star.sql(f", {_NODES}, {_bm25('nodes2', 'node_id', 'txt', ['table', 'small', 'operation'])} {_top(0.1, 20)}"))
def search_metadata(spark, d):
    return search.best(_node_scores(spark, d, ["table", "small", "operation"]), 0.1, 0.3, 20)


@query("search_content", f"WITH {_bm25('documents', 'doc_id', 'text', TERMS)} {_top(0.05, 25)}")
def search_content(spark, d):
    return search.best(_docs_scores(spark, d), 0.05, 0.2, 25)


@query("search_focus", f"WITH {_bm25('documents', 'doc_id', 'text', ['license', 'version', 'public', 'general'])} {_top(0.05, 15)}")
def search_focus(spark, d):
    return search.best(_docs_scores(spark, d, ["license", "version", "public", "general"]), 0.05, 0.2, 15)


@query("discover_assets", star.sql(f", {_NODES}, {_bm25('nodes2', 'node_id', 'txt', ['small', 'operation', 'connection'])}, hits AS ({_top(0.05, 100)}) SELECT doc, score FROM hits JOIN nodes ON doc = node_id WHERE node_type = 'connection'"))
def discover_assets(spark, d):
    hits = search.best(_node_scores(spark, d, ["small", "operation", "connection"]), 0.05, 0.2, 100)
    kinds = graph.by_type(star.nodes(spark, d), "connection").select(F.col("node_id").alias("doc"))
    return hits.join(kinds, "doc", "left_semi")


@query("search_all", star.sql(f""", {_NODES}, {_bm25('nodes2', 'node_id', 'txt', ['table', 'small'])},
tiers AS (SELECT node_id AS doc, 1.0::DOUBLE AS score, 1 AS tier FROM nodes WHERE node_id = 'table:5' UNION ALL SELECT node_id, 0.9::DOUBLE, 2 FROM nodes WHERE lower(trim(name)) = (SELECT lower(min(n_name)) FROM nation)
UNION ALL SELECT doc, score * 0.8, 3 FROM ({_top(0.1, 20)})),
firsts AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY tier) AS r FROM tiers)
SELECT doc, tier, round(score, 6) AS score FROM firsts WHERE r = 1 ORDER BY score DESC, doc LIMIT 15"""))
def search_all(spark, d):
    n = star.nodes(spark, d)
    first = table(spark, d, "nation").agg(F.min("n_name")).first()[0] or ""
    one = lambda rows: rows.select(F.col("node_id").alias("doc"), F.lit(1.0).alias("score"))
    tiers = [(1, 1.0, one(graph.by_id(n, "table:5"))), (2, 0.9, one(graph.by_name(n, first))), (3, 0.8, search.best(_node_scores(spark, d, ["table", "small"]), 0.1, 0.3, 20))]
    return search.tiered(tiers, 15).withColumn("score", F.round("score", 6))
