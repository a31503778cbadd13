"""Queries on summary texts: quality scores, patterns, prompts, caches and reviews."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.functions import quality as q
from weft.functions import text as t
from weft.registry import query
from weft.session import table

# Summaries derived from suppliers: the longer the key's remainder, the more the text tells.
_PARTS = [
    "Extract customer order data from the ",
    " source and transform each transaction. ",
    "Load the sales fact into the warehouse; the process enables business reporting and analysis of revenue, cost and margin! ",
    "The SQL stored procedure reads the XML schema via JDBC connection metadata. ",
]
SUMMARY_SQL = f"""s AS (SELECT s_suppkey AS id, '{_PARTS[0]}' || n_name || '{_PARTS[1]}' || CASE WHEN s_suppkey % 3 > 0 THEN '{_PARTS[2]}' ELSE '' END || CASE WHEN s_suppkey % 4 = 0 THEN repeat('{_PARTS[3]}', 2) ELSE '' END
  || CASE WHEN s_suppkey % 7 = 0 THEN repeat(s_name || ' ', 160) ELSE '' END AS txt, s_acctbal > 0 AS src, s_suppkey % 2 = 0 AS dst, s_suppkey % 5 > 0 AS tr FROM supplier JOIN nation ON s_nationkey = n_nationkey)
UNION_DOCS"""


def _summaries(spark, d):
    s, n = table(spark, d, "supplier"), table(spark, d, "nation")
    k = F.col("s_suppkey")
    text = F.concat(
        F.lit(_PARTS[0]), "n_name", F.lit(_PARTS[1]), F.when(k % 3 > 0, _PARTS[2]).otherwise(""), F.when(k % 4 == 0, _PARTS[3] * 2).otherwise(""),
        F.when(k % 7 == 0, F.repeat(F.concat("s_name", F.lit(" ")), 160)).otherwise(""),
    )
    return s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(k.alias("id"), text.alias("txt"), (F.col("s_acctbal") > 0).alias("src"), (k % 2 == 0).alias("dst"), (k % 5 > 0).alias("tr"))


_WORDS = "list_filter(string_split_regex(txt, '\\s+'), lambda w: w <> '')"


def _held(terms: str) -> str:
    return "(" + " + ".join(f"CASE WHEN contains(lower(txt), '{x}') THEN 1 ELSE 0 END" for x in terms.split(",")) + ")"


_M = SUMMARY_SQL.replace("\nUNION_DOCS", "") + f""", m AS (SELECT *, len({_WORDS}) AS w, length(txt) AS c, len(list_filter({_WORDS}, lambda x: length(x) > 6)) AS lw, length(regexp_replace(txt, '[^.!?]', '', 'g')) AS st FROM s),
sc AS (SELECT *,
  CASE WHEN w BETWEEN 5 AND 150 AND c BETWEEN 25 AND 750 THEN 1.0::DOUBLE WHEN w < 5 OR c < 25 THEN least(w / 5.0::DOUBLE, c / 25.0::DOUBLE) ELSE least(150.0::DOUBLE / w, 750.0::DOUBLE / c) END AS length_score,
  greatest({", ".join(f"{_held(k)} / {len(k.split(','))}.0::DOUBLE" for k in q.DOMAINS.values())}) * 0.7::DOUBLE + {_held(q.VALUE)} / 15.0::DOUBLE * 0.3::DOUBLE AS business_score,
  {_held(q.JARGON)} / CAST(w AS DOUBLE) AS jr, w / CAST(st AS DOUBLE) AS ws, lw / CAST(w AS DOUBLE) AS lr,
  (CASE WHEN src AND {_held('source,from')} > 0 THEN 1 ELSE 0 END + CASE WHEN dst AND {_held('destination,to')} > 0 THEN 1 ELSE 0 END + CASE WHEN tr AND {_held('transform,convert,process,change')} > 0 THEN 1 ELSE 0 END + CASE WHEN {_held('purpose,business,enables,supports')} > 0 THEN 1 ELSE 0 END) / 4.0::DOUBLE AS completeness,
  ((CASE WHEN src THEN 1.0 ELSE 0.0 END) + (CASE WHEN dst THEN 1.0 ELSE 0.0 END) + (CASE WHEN tr THEN 1.0 ELSE 0.5 END) + 1.0)::DOUBLE / 4 AS richness,
  (1.0 + (CASE WHEN tr THEN 1.0 ELSE 0.5 END) + least(1.0, (CASE WHEN src THEN 1 ELSE 0 END + CASE WHEN dst THEN 1 ELSE 0 END) / 2.0))::DOUBLE / 3 AS source_confidence FROM m),
sd AS (SELECT *, CASE WHEN jr < 0.1 THEN 0.0::DOUBLE WHEN jr < 0.2 THEN 0.3::DOUBLE ELSE least(1.0::DOUBLE, jr * 2) END AS jargon_penalty,
  ((CASE WHEN ws <= 20 THEN 1.0::DOUBLE ELSE 20 / ws END) + (CASE WHEN lr <= 0.3 THEN 1.0::DOUBLE ELSE greatest(0.0::DOUBLE, (0.3::DOUBLE - lr) / 0.3::DOUBLE + 1.0) END)) / 2 AS readability FROM sc),
se AS (SELECT *, least(1.0::DOUBLE, greatest(0.0::DOUBLE, (length_score * 0.20::DOUBLE + business_score * 0.15::DOUBLE + (1 - jargon_penalty) * 0.10::DOUBLE + readability * 0.25::DOUBLE + completeness * 0.30::DOUBLE) * (0.8::DOUBLE + richness * 0.2::DOUBLE) * (0.9::DOUBLE + source_confidence * 0.1::DOUBLE))) AS confidence,
  length_score < 1 OR business_score < 0.3 AS critical FROM sd)"""


def _scored(spark, d):
    s = _summaries(spark, d)
    x = F.col("txt")
    src, dst, tr = F.col("src"), F.col("dst"), F.col("tr")
    s = s.withColumns(
        {
            "length_score": q.length_score(x), "business_score": q.business_score(x), "jargon_penalty": q.jargon_penalty(x), "readability": q.readability(x),
            "completeness": q.completeness(x, src, dst, tr), "richness": q.richness(src, dst, tr, F.lit(True)),
            "source_confidence": q.source_confidence(F.lit(True), tr, src.cast("int") + dst.cast("int")),
        }
    )
    s = s.withColumn("confidence", q.confidence(*[F.col(c) for c in ("length_score", "business_score", "jargon_penalty", "readability", "completeness", "richness", "source_confidence")]))
    return s.withColumn("critical", (F.col("length_score") < 1) | (F.col("business_score") < 0.3))


_SCORES = {"quality_length": ["length_score"], "quality_business": ["business_score"], "quality_jargon": ["jargon_penalty"], "quality_readability": ["readability"], "quality_completeness": ["completeness", "richness", "source_confidence"], "quality_confidence": ["confidence"]}
for _name, _columns in _SCORES.items():

    @query(_name, f"WITH {_M} SELECT id, {', '.join(f'round({c}, 6) AS {c}' for c in _columns)} FROM se")
    def _quality(spark, d, columns=_columns):
        return _scored(spark, d).select("id", *[F.round(c, 6).alias(c) for c in columns])


_FLAG = "CASE WHEN confidence >= 0.6 THEN CASE WHEN critical THEN 'warning' ELSE 'passed' END WHEN confidence >= 0.4 THEN 'warning' WHEN confidence >= 0.2 THEN 'needs_review' ELSE 'failed' END"


@query("quality_flag", f"WITH {_M} SELECT id, {_FLAG} AS flag, critical OR confidence < 0.4 AS requires_review FROM se")
def quality_flag(spark, d):
    s = _scored(spark, d)
    return s.select("id", q.flag(F.col("confidence"), F.col("critical")).alias("flag"), q.requires_review(F.col("confidence"), F.col("critical")).alias("requires_review"))


@query("quality_all", f"WITH {_M} SELECT {_FLAG} AS flag, count(*) AS n, round(avg(confidence), 6) AS mean_confidence, round(min(length_score), 6) AS least_length FROM se GROUP BY 1")
def quality_all(spark, d):
    s = _scored(spark, d)
    return s.groupBy(q.flag(F.col("confidence"), F.col("critical")).alias("flag")).agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("mean_confidence"), F.round(F.min("length_score"), 6).alias("least_length"))


@query("document_readability", "SELECT doc_id, CAST(w AS INTEGER) AS words, CAST(st AS INTEGER) AS sentences FROM (SELECT doc_id, len(list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')) AS w, length(regexp_replace(coalesce(text, ''), '[^.!?]', '', 'g')) AS st FROM documents)")
def document_readability(spark, d):
    x = F.coalesce("text", F.lit(""))
    w = F.size(F.filter(F.split(x, r"[\x20\x09-\x0D]+"), lambda v: v != ""))
    return table(spark, d, "documents").select("doc_id", w.alias("words"), F.length(F.regexp_replace(x, "[^.!?]", "")).alias("sentences"))


# Names of data patterns and the terms that show them.
PATTERNS = {"extraction": "extract|source|read", "loading": "load|insert|write", "transformation": "transform|convert|derive", "aggregation": "aggregate|sum|group", "lookup": "lookup|match", "validation": "validate|check|quality", "reporting": "report|dashboard", "sales": "sales|order|revenue", "customer": "customer|client"}


@query("pipeline_patterns", f"WITH {SUMMARY_SQL.replace(chr(10) + 'UNION_DOCS', '')} SELECT id, concat_ws(',', " + ", ".join(f"CASE WHEN regexp_matches(lower(txt), '{v}') THEN '{k}' END" for k, v in PATTERNS.items()) + ") AS patterns FROM s")
def pipeline_patterns(spark, d):
    return _summaries(spark, d).select("id", t.pattern_names(F.col("txt"), PATTERNS).alias("patterns"))


_SQLS = "(SELECT o_orderkey AS id, CASE o_orderkey % 8 WHEN 0 THEN 'SELECT a.x, b.y FROM a LEFT JOIN b ON a.id = b.id WHERE a.z > ?' WHEN 1 THEN ' insert into t (a) values (?, ?)' WHEN 2 THEN 'update dbo.t set a = 1' WHEN 3 THEN 'EXEC dbo.p' WHEN 4 THEN 'select sum(x) from t group by y order by y' WHEN 5 THEN 'drop table t' WHEN 6 THEN 'select * from t where id in (select id from u)' ELSE 'UPDATE_DATE + 1' END AS stmt FROM orders)"


def _statements(spark, d):
    k = F.col("o_orderkey") % 8
    texts = ["SELECT a.x, b.y FROM a LEFT JOIN b ON a.id = b.id WHERE a.z > ?", " insert into t (a) values (?, ?)", "update dbo.t set a = 1", "EXEC dbo.p", "select sum(x) from t group by y order by y", "drop table t", "select * from t where id in (select id from u)"]
    stmt = F.when(k == 0, texts[0])
    for i, x in enumerate(texts[1:], 1):
        stmt = stmt.when(k == i, x)
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), stmt.otherwise("UPDATE_DATE + 1").alias("stmt"))


@query("sql_type", f"SELECT id, CASE WHEN s LIKE 'SELECT%' THEN 'SELECT' WHEN s LIKE 'INSERT%' THEN 'INSERT' WHEN s LIKE 'UPDATE%' THEN 'UPDATE' WHEN s LIKE 'DELETE%' THEN 'DELETE' WHEN s LIKE 'EXEC%' THEN 'EXECUTE' WHEN s LIKE 'CREATE%' THEN 'CREATE' WHEN s LIKE 'DROP%' THEN 'DROP' ELSE 'UNKNOWN' END AS kind FROM (SELECT id, upper(trim(stmt)) AS s FROM {_SQLS})")
def sql_type(spark, d):
    return _statements(spark, d).select("id", t.sql_type(F.col("stmt")).alias("kind"))


@query("sql_or_expression", f"SELECT id, CASE WHEN regexp_matches(stmt, '(?i)^\\s*(select|insert|update|delete)\\b') THEN 'sql' ELSE 'expression' END AS kind FROM {_SQLS}")
def sql_or_expression(spark, d):
    return _statements(spark, d).select("id", t.sql_or_expression(F.col("stmt")).alias("kind"))


@query("mv_sql_operations", f"SELECT id, contains(upper(stmt), ' JOIN ') AS has_joins, len(string_split(upper(stmt), 'SELECT')) - 1 > 1 AS has_subqueries, CAST(length(stmt) - length(replace(stmt, '?', '')) AS INTEGER) AS parameter_count FROM {_SQLS}")
def mv_sql_operations(spark, d):
    s = _statements(spark, d)
    u = F.upper("stmt")
    return s.select("id", u.contains(" JOIN ").alias("has_joins"), (F.size(F.split(u, "SELECT")) - 1 > 1).alias("has_subqueries"), t.parameter_count(F.col("stmt")).alias("parameter_count"))


_FEATURES = {"joins": r"\bjoin\b", "aggregates": r"\b(sum|count|avg|min|max)\(", "grouping": r"\bgroup by\b", "filters": r"\bwhere\b", "sorting": r"\border by\b"}


@query("sql_feature_summary", f"SELECT id, concat_ws(', ', " + ", ".join(f"CASE WHEN regexp_matches(lower(stmt), '{v}') THEN '{k}' END" for k, v in _FEATURES.items()) + f") AS summary FROM {_SQLS}")
def sql_feature_summary(spark, d):
    low = F.lower("stmt")
    return _statements(spark, d).select("id", F.concat_ws(", ", *[F.when(low.rlike(v), F.lit(k)) for k, v in _FEATURES.items()]).alias("summary"))


@query("transform_summary", "SELECT o_orderstatus AS operation, string_agg(n || ' ' || p || CASE WHEN n > 1 THEN 's' ELSE '' END, ', ' ORDER BY p) AS summary FROM (SELECT o_orderstatus, lower(o_orderpriority) AS p, count(*) AS n FROM orders GROUP BY 1, 2) GROUP BY 1")
def transform_summary(spark, d):
    n = table(spark, d, "orders").groupBy("o_orderstatus", F.lower("o_orderpriority").alias("p")).agg(F.count("*").alias("n"))
    text = F.concat("n", F.lit(" "), "p", F.when(F.col("n") > 1, "s").otherwise(""))
    parts = F.array_sort(F.collect_list(F.struct("p", text.alias("x"))))
    return n.groupBy(F.col("o_orderstatus").alias("operation")).agg(F.array_join(F.transform(parts, lambda s: s["x"]), ", ").alias("summary"))


@query("prompt_render", "SELECT c_nationkey AS id, 'Operation ' || c_nationkey || ' reads ' || CASE WHEN len(l) <= 3 THEN array_to_string(l, ', ') ELSE array_to_string(l[1:3], ', ') || ' and ' || (len(l) - 3) || ' others' END || '.' AS prompt FROM (SELECT c_nationkey, list(DISTINCT c_mktsegment ORDER BY c_mktsegment) AS l FROM customer GROUP BY 1)")
def prompt_render(spark, d):
    g = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("id")).agg(F.array_sort(F.collect_set("c_mktsegment")).alias("l"))
    few = F.array_join("l", ", ")
    many = F.concat(F.array_join(F.slice("l", 1, 3), ", "), F.lit(" and "), F.size("l") - 3, F.lit(" others"))
    return g.select("id", F.concat(F.lit("Operation "), "id", F.lit(" reads "), F.when(F.size("l") <= 3, few).otherwise(many), F.lit(".")).alias("prompt"))


_CODE = "(SELECT p_partkey AS id, 'Public Sub Main ' || CASE WHEN p_size % 2 = 0 THEN 'For Each x In y: Try: ' ELSE '' END || CASE WHEN p_size % 3 = 0 THEN 'SqlConnection ' ELSE '' END || CASE WHEN p_size % 5 = 0 THEN 'HttpClient File.Open ' ELSE '' END || p_name AS code FROM part)"
_MARKS = [("For Each", 1), ("Try", 1), ("SqlConnection", 5), ("HttpClient", 5), ("File.", 3)]


@query("script_complexity", "SELECT id, sc AS score, CASE WHEN sc <= 3 THEN 'simple' WHEN sc <= 10 THEN 'moderate' ELSE 'complex' END AS level FROM (SELECT id, CAST(" + " + ".join(f"CASE WHEN contains(code, '{k}') THEN {v} ELSE 0 END" for k, v in _MARKS) + f" AS INTEGER) AS sc FROM {_CODE})")
def script_complexity(spark, d):
    p, s = table(spark, d, "part"), F.col("p_size")
    code = F.concat(F.lit("Public Sub Main "), F.when(s % 2 == 0, "For Each x In y: Try: ").otherwise(""), F.when(s % 3 == 0, "SqlConnection ").otherwise(""), F.when(s % 5 == 0, "HttpClient File.Open ").otherwise(""), "p_name")
    score = F.lit(0)
    for mark, points in _MARKS:
        score = score + F.when(code.contains(mark), points).otherwise(0)
    return p.select(F.col("p_partkey").alias("id"), score.alias("score")).withColumn("level", F.when(F.col("score") <= 3, "simple").when(F.col("score") <= 10, "moderate").otherwise("complex"))


@query("review_stats", "SELECT count(*) AS reviews, count(*) FILTER (WHERE quality = 1) / CAST(count(*) AS DOUBLE) AS approval_rate, avg(toxic) AS mean_rating FROM labels")
def review_stats(spark, d):
    return table(spark, d, "labels").agg(F.count("*").alias("reviews"), (F.count_if(F.col("quality") == 1) / F.count("*")).alias("approval_rate"), F.avg("toxic").alias("mean_rating"))


@query("content_hash", "SELECT p_partkey AS id, sha256(p_partkey || '||' || p_type || '||' || p_name) AS hash FROM part")
def content_hash(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), t.content_hash(F.col("p_partkey").cast("string"), F.col("p_type"), F.col("p_name")).alias("hash"))


@query("cache_misses", "SELECT p_partkey AS id FROM part WHERE p_partkey % 4 > 0 OR p_size > 25")
def cache_misses(spark, d):
    p = table(spark, d, "part")
    now = p.select(F.col("p_partkey").alias("id"), t.content_hash("p_name", F.col("p_size").cast("string")).alias("hash"))
    cache = p.where("p_partkey % 4 = 0").select(F.col("p_partkey").alias("id"), t.content_hash("p_name", F.when(F.col("p_size") <= 25, F.col("p_size")).otherwise(-1).cast("string")).alias("hash"))
    return now.join(cache, ["id", "hash"], "left_anti").select("id")


@query("traceability_audit", "SELECT s_suppkey AS id, s_name <> '' AS has_name, s_nationkey IS NOT NULL AS has_parent, s_acctbal > 0 AS has_confidence, s_name <> '' AND s_nationkey IS NOT NULL AND s_acctbal > 0 AS valid FROM supplier")
def traceability_audit(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_name") != "").alias("has_name"), F.col("s_nationkey").isNotNull().alias("has_parent"), (F.col("s_acctbal") > 0).alias("has_confidence"))
    return s.withColumn("valid", F.col("has_name") & F.col("has_parent") & F.col("has_confidence"))
