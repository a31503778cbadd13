"""Queries on type mapping and on connection, naming and classification functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.functions import text as t
from weft.functions import types as ty
from weft.registry import query
from weft.session import table

_KINDS = ["i4", "DT_I8", "wstr", "str", "dbTimeStamp", "numeric", "decimal", "bool", "geo"]
_NATIVE = "CASE p_partkey % 9 " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(_KINDS)) + " END"
_CANON = "CASE p_partkey % 9 " + " ".join(f"WHEN {i} THEN '{ty.SSIS.get(k.lower().removeprefix('dt_'), 'unknown')}'" for i, k in enumerate(_KINDS)) + " END"
_CATEGORY = "CASE " + " ".join(f"WHEN c IN ({', '.join(repr(x) for x in v.split())}) THEN '{k}'" for k, v in ty.CATEGORIES.items()) + " ELSE 'special' END"


def _native(spark, d):
    k = F.col("p_partkey") % 9
    kind = F.element_at(F.array(*[F.lit(x) for x in _KINDS]), (k + 1).cast("int"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_size", kind.alias("native"))


@query("type_category", f"SELECT id, native, c AS canonical, {_CATEGORY} AS category, c NOT IN ('text', 'ntext', 'image', 'xml', 'json') AS indexable FROM (SELECT p_partkey AS id, {_NATIVE} AS native, {_CANON} AS c FROM part)")
def type_category(spark, d):
    n = _native(spark, d).withColumn("canonical", ty.canonical(F.col("native")))
    return n.select("id", "native", "canonical", ty.category(F.col("canonical")).alias("category"), ty.indexable(F.col("canonical")).alias("indexable"))


_TARGET_ROWS = ", ".join(f"('{c}', '{p}', '{x}')" for c, ts in ty.TARGETS.items() for p, x in zip(ty.PLATFORMS, ts.split("|")))
_TARGET_TABLE = f"(VALUES {_TARGET_ROWS}) AS tt(canonical, platform, template)"


@query("type_targets", f"SELECT id, p.platform, coalesce(replace(replace(replace(template, '{{length}}', CAST(p_size AS VARCHAR)), '{{precision}}', '18'), '{{scale}}', '0'), 'unknown') AS target FROM (SELECT p_partkey AS id, p_size, {_CANON} AS c FROM part) CROSS JOIN (SELECT unnest([{', '.join(repr(x) for x in ty.PLATFORMS)}]) AS platform) p LEFT JOIN {_TARGET_TABLE} ON c = tt.canonical AND p.platform = tt.platform")
def type_targets(spark, d):
    n = _native(spark, d).withColumn("canonical", ty.canonical(F.col("native"))).withColumn("platform", F.explode(F.array(*[F.lit(p) for p in ty.PLATFORMS])))
    found = n.join(ty.target_table(spark), ["canonical", "platform"], "left")
    return found.select("id", "platform", F.coalesce(ty.filled(F.col("template"), F.col("p_size"), F.lit(18), F.lit(0)), F.lit("unknown")).alias("target"))


_LENGTH = "p_size * 200"


@query("type_enrichment", f"""SELECT id, native, c AS canonical, {_CATEGORY} AS category, c NOT IN ('image', 'xml', 'json') AS sortable,
  CASE WHEN c = 'unknown' THEN 0.3 WHEN NOT m THEN 0.5 WHEN n > 8000 THEN 0.8 ELSE 1.0 END::DOUBLE AS confidence,
  array_to_string(list_concat(CASE WHEN m THEN [] ELSE [{', '.join(repr(f'No mapping defined for {p}') for p in ty.DEFAULT_PLATFORMS)}] END,
    CASE WHEN c = 'unknown' THEN ['Unknown SSIS type: ' || native] ELSE [] END, CASE WHEN n > 8000 THEN ['Large column length may require special handling'] ELSE [] END), '; ') AS issues
FROM (SELECT *, c IN ({', '.join(repr(x) for x in ty.TARGETS)}) AS m FROM (SELECT p_partkey AS id, {_NATIVE} AS native, {_CANON} AS c, {_LENGTH} AS n FROM part))""")
def type_enrichment(spark, d):
    n = _native(spark, d).withColumn("canonical", ty.canonical(F.col("native"))).withColumn("n", F.expr(_LENGTH))
    kind, length = F.col("canonical"), F.col("n")
    return n.select(
        "id", "native", "canonical", ty.category(kind).alias("category"), ty.sortable(kind).alias("sortable"), ty.confidence(kind, length).alias("confidence"),
        F.array_join(ty.issues(F.col("native"), kind, length), "; ").alias("issues"),
    )


@query("type_rule_sheet", f"SELECT * FROM {_TARGET_TABLE}")
def type_rule_sheet(spark, d):
    return ty.target_table(spark)


@query("type_supported", f"SELECT id, c AS canonical, c IN ({', '.join(repr(x) for x in ty.TARGETS)}) AS supported FROM (SELECT p_partkey AS id, {_CANON} AS c FROM part)")
def type_supported(spark, d):
    n = _native(spark, d).select("id", ty.canonical(F.col("native")).alias("canonical"))
    return n.withColumn("supported", F.col("canonical").isin(*ty.TARGETS))


_RISK = "CASE WHEN a = b THEN 'none' " + " ".join(f"WHEN a || '>' || b IN ({', '.join(repr(x) for x in v.split())}) THEN '{k}'" for k, v in ty.RISKS.items()) + " ELSE 'unsafe' END"


@query("conversion_risk_hist", f"SELECT a AS source, b AS target, {_RISK} AS risk, count(*) AS n FROM (SELECT {_CANON} AS a, CASE p_size % 3 WHEN 0 THEN 'integer' WHEN 1 THEN 'varchar' ELSE 'date' END AS b FROM part) GROUP BY 1, 2, 3")
def conversion_risk_hist(spark, d):
    n = _native(spark, d)
    b = F.when(F.col("p_size") % 3 == 0, "integer").when(F.col("p_size") % 3 == 1, "varchar").otherwise("date")
    n = n.select(ty.canonical(F.col("native")).alias("source"), b.alias("target"))
    return n.groupBy("source", "target", ty.risk(F.col("source"), F.col("target")).alias("risk")).agg(F.count("*").alias("n"))


_CONN = "'Data Source=srv' || s_nationkey || ';Initial Catalog=db_' || s_suppkey || ';Provider=' || CASE WHEN s_suppkey % 3 = 0 THEN 'SQLNCLI11' WHEN s_suppkey % 3 = 1 THEN 'Npgsql' ELSE 'OraOLEDB' END || ';Integrated Security=SSPI;'"


def _connections(spark, d):
    k = F.col("s_suppkey")
    provider = F.when(k % 3 == 0, "SQLNCLI11").when(k % 3 == 1, "Npgsql").otherwise("OraOLEDB")
    text = F.concat(F.lit("Data Source=srv"), "s_nationkey", F.lit(";Initial Catalog=db_"), k, F.lit(";Provider="), provider, F.lit(";Integrated Security=SSPI;"))
    return table(spark, d, "supplier").select(k.alias("id"), text.alias("conn"))


@query("connstr_parse", f"SELECT id, regexp_extract(conn, 'Data Source=([^;]*)', 1) AS server, regexp_extract(conn, 'Initial Catalog=([^;]*)', 1) AS catalog, regexp_extract(conn, 'Provider=([^;]*)', 1) AS provider FROM (SELECT s_suppkey AS id, {_CONN} AS conn FROM supplier)")
def connstr_parse(spark, d):
    pick = lambda k: F.regexp_extract("conn", f"{k}=([^;]*)", 1)
    return _connections(spark, d).select("id", pick("Data Source").alias("server"), pick("Initial Catalog").alias("catalog"), pick("Provider").alias("provider"))


@query("connstr_map", f"SELECT id, lower(regexp_extract(p, '^([^=]*)=', 1)) AS key, regexp_extract(p, '=(.*)$', 1) AS value FROM (SELECT s_suppkey AS id, unnest(list_filter(string_split({_CONN}, ';'), lambda x: x <> '')) AS p FROM supplier)")
def connstr_map(spark, d):
    return _connections(spark, d).select("id", F.explode(t.connection_map(F.col("conn"))).alias("key", "value"))


@query("connection_details", f"SELECT id, regexp_extract(conn, 'Data Source=([^;]*)', 1) || '.' || regexp_extract(conn, 'Initial Catalog=([^;]*)', 1) AS location, CASE WHEN id % 3 = 0 THEN 'sql_server' WHEN id % 3 = 1 THEN 'postgresql' ELSE 'oracle' END AS platform FROM (SELECT s_suppkey AS id, {_CONN} AS conn FROM supplier)")
def connection_details(spark, d):
    m = t.connection_map(F.col("conn"))
    c = _connections(spark, d).withColumn("m", m)
    return c.select("id", F.concat_ws(".", F.col("m")["data source"], F.col("m")["initial catalog"]).alias("location"), t.platform(F.col("m")["provider"], F.lit(""), F.lit("")).alias("platform"))


_TASKS = ["SSIS.Pipeline.3", "Microsoft.Pipeline", "STOCK:FOREACHLOOP", "Microsoft.ExecuteSQLTask", "Microsoft.ScriptTask", "Other"]


@query("op_subtype", "SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 0 THEN 'DATA_FLOW' WHEN 1 THEN 'DATA_FLOW' WHEN 2 THEN 'CONTROL_FLOW' WHEN 4 THEN 'SCRIPT' ELSE 'EXECUTE' END AS subtype FROM orders")
def op_subtype(spark, d):
    kind = F.element_at(F.array(*[F.lit(x) for x in _TASKS]), (F.col("o_orderkey") % 6 + 1).cast("int"))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), t.task_subtype(kind).alias("subtype"))


@query("infa_subtype", "SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 1 THEN 'CONTROL_FLOW' WHEN 2 THEN 'EXECUTE' ELSE 'DATA_FLOW' END AS subtype FROM orders")
def infa_subtype(spark, d):
    kind = F.element_at(F.array(*[F.lit(x) for x in ("Expression", "Command", "Email", "Unknown")]), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), t.transformation_subtype(kind).alias("subtype"))


@query("name_conventions", "SELECT p_partkey AS id, lower(regexp_replace(regexp_replace(p_name, '([a-z0-9])([A-Z])', '\\1_\\2', 'g'), '[\\s\\-]+', '_', 'g')) AS snake FROM part")
def name_conventions(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), t.snake(F.col("p_name")).alias("snake"))


@query("json_properties", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_properties(spark, d):
    return table(spark, d, "events").select("event_id", F.variant_get(F.parse_json("props"), "$.k", "bigint").alias("k"))
