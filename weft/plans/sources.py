"""Queries over the sample project files, SQL semantics, generated code, summaries and incremental counts."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import functions as F

from weft.functions import codegen, summarize
from weft.functions.sql_semantics import semantics
from weft.operators import graph
from weft.plans import star
from weft.registry import query
from weft.session import table
from weft.sources import informatica, kvfiles, ssis
from weft.streaming.incremental import windowed_counts

SAMPLES = f"file://{Path(ssis.__file__).parent / 'samples'}"

STATEMENTS = [
    "SELECT customer_id, first_name FROM customer",
    "SELECT a.x AS y FROM dbo.A a LEFT JOIN [dbo].[B] b ON a.id = b.id WHERE a.z > 1",
    "SELECT a.x FROM A a WHERE a.z > 1 ORDER BY a.x",
    "select ol.price from cust_order co left join order_line ol on ol.order_id=co.order_id",
    "SELECT o.a FROM dbo.Orders o, dbo.Order_Details os WHERE o.a = os.a",
    "select * from a CROSS JOIN b",
    "select h.id, max(case when s=1 then d end) as 'D1' from [dbo].[order_history] as h group by id",
]


@query("ssis_scan")
def ssis_scan(spark, d):
    return ssis.elements(spark, SAMPLES).select("package_id", "kind", "id", "parent_id", "name", "native_type", "body")


def _kind(name, kind):
    @query(name)
    def scan(spark, d):
        return ssis.elements(spark, SAMPLES).where(F.col("kind") == kind).select("id", "parent_id", "name", "native_type", "body")


for _name, _k in (("ssis_ops", "operation"), ("ssis_connections", "connection"), ("ssis_params", "parameter"), ("ssis_vars", "variable"), ("precedes", "precedence"), ("ssis_components", "component"), ("mv_business_rules", "condition"), ("scan_errors", "error"), ("script_extract", "script")):
    _kind(_name, _k)


@query("scan_files")
def scan_files(spark, d):
    return ssis.files(spark, SAMPLES, "*.dtsx").select(F.substring_index("path", "/", -1).alias("file"), "length")


@query("ssis_io_edges")
def ssis_io_edges(spark, d):
    return ssis.io_edges(ssis.elements(spark, SAMPLES))


@query("ssis_nodes")
def ssis_nodes(spark, d):
    return ssis.nodes(ssis.elements(spark, SAMPLES))


@query("column_lineage")
def column_lineage(spark, d):
    return ssis.column_lineage(ssis.elements(spark, SAMPLES))


@query("infa_scan")
def infa_scan(spark, d):
    return informatica.elements(spark, SAMPLES).select("kind", "id", "parent_id", "name", "native_type", "body")


@query("infa_assets")
def infa_assets(spark, d):
    return informatica.elements(spark, SAMPLES).where("kind = 'field'").select("parent_id", "name", "native_type", "seq")


@query("infa_connectors")
def infa_connectors(spark, d):
    return informatica.column_lineage(informatica.elements(spark, SAMPLES))


@query("workflow_links")
def workflow_links(spark, d):
    return informatica.edges(informatica.elements(spark, SAMPLES)).where("relation IN ('precedes', 'executes')")


@query("session_executes")
def session_executes(spark, d):
    return informatica.edges(informatica.elements(spark, SAMPLES)).where("relation = 'executes'")


@query("conmgr_scan", "SELECT * FROM (VALUES ('connection:Staging', 'Staging', 'OLEDB', 'Data Source=stg01;Initial Catalog=stage;Provider=SQLNCLI11;')) AS t(id, name, native_type, body)")
def conmgr_scan(spark, d):
    e = ssis.elements(spark, SAMPLES)
    return e.where(F.col("file").endswith(".conmgr")).select("id", "name", "native_type", "body")


@query("params_scan", "SELECT * FROM (VALUES ('parameter:Region', 'Region', 'EU')) AS t(id, name, value)")
def params_scan(spark, d):
    e = ssis.elements(spark, SAMPLES)
    return e.where(F.col("file").endswith(".params")).select("id", "name", F.col("body").alias("value"))


@query("exec_sql_lineage", "SELECT * FROM (VALUES ('pipeline:LoadOrders:operation:Truncate', 'table:stg.orders', 'writes_to')) AS t(src, dst, relation)")
def exec_sql_lineage(spark, d):
    e = ssis.elements(spark, SAMPLES).where("kind = 'operation' AND body IS NOT NULL")
    return ssis.sql_edges(e.select(F.col("id").alias("parent_id"), "body"))


@query("infa_generic")
def infa_generic(spark, d):
    known = ["Source Definition", "Target Definition", "Source Qualifier", "Expression", "Filter", "Aggregator", "Sorter", "Joiner", "Lookup Procedure", "Router", "Union", "Sequence", "Update Strategy", "Normalizer", "Rank"]
    return informatica.elements(spark, SAMPLES).where(F.col("kind").isin("instance", "transformation") & ~F.col("native_type").isin(*known)).select("id", "name", "native_type")


@query("infa_pairing")
def infa_pairing(spark, d):
    """Each session's mapping file: the first file, by path, that defines the mapping."""
    e = informatica.elements(spark, SAMPLES)
    home = e.where("kind = 'mapping'").groupBy("name").agg(F.min(F.substring_index("file", "/", -1)).alias("mapping_file"))
    return e.where("kind = 'session'").select(F.col("name").alias("session"), F.col("body").alias("name")).join(home, "name", "left").select("session", F.col("name").alias("mapping"), "mapping_file")


@query("par_scan", "SELECT * FROM (VALUES ('SOURCE_DB', 'ora1'), ('DATE', '2024-01-01')) AS t(key, value)")
def par_scan(spark, d):
    return kvfiles.parameters(spark, SAMPLES).select("key", "value")


@query("infa_connections", "SELECT * FROM (VALUES ('default', 'server', 'fallback'), ('ORA_SRC', 'server', 'ora1'), ('ORA_SRC', 'port', '1521'), ('DWH', 'server', 'dwh01')) AS t(name, key, value)")
def infa_connections(spark, d):
    return kvfiles.connections(spark, SAMPLES).select("name", "key", "value")


def _semantics(spark):
    return [(i, semantics(spark, s)) for i, s in enumerate(STATEMENTS)]


@query("sql_tables", "SELECT * FROM (VALUES (0, 'customer', ''), (1, 'dbo.A', 'a'), (1, 'dbo.B', 'b'), (2, 'A', 'a'), (3, 'cust_order', 'co'), (3, 'order_line', 'ol'), (4, 'dbo.Orders', 'o'), (4, 'dbo.Order_Details', 'os'), (5, 'a', ''), (5, 'b', ''), (6, 'dbo.order_history', 'h')) AS t(statement, table_name, alias)")
def sql_tables(spark, d):
    return spark.createDataFrame([(i, t, a or "") for i, s in _semantics(spark) for t, a in s.tables], "statement int, table_name string, alias string")


@query("sql_joins")
def sql_joins(spark, d):
    return spark.createDataFrame([(i, *j) for i, s in _semantics(spark) for j in s.joins], "statement int, kind string, left_table string, right_table string, condition string")


@query("join_edges")
def join_edges(spark, d):
    return sql_joins(spark, d).select(F.concat(F.lit("table:"), "left_table").alias("src"), F.concat(F.lit("table:"), "right_table").alias("dst"), F.lit("joins_with").alias("relation"))


@query("sql_columns")
def sql_columns(spark, d):
    return spark.createDataFrame([(i, e, a or "", s.where or "") for i, s in _semantics(spark) for e, a in s.columns], "statement int, expression string, alias string, where_clause string")


@query("generated_code")
def generated_code(spark, d):
    return spark.createDataFrame([(i, p, codegen.generate(s, p)) for i, s in _semantics(spark) for p in codegen.PLATFORMS], "statement int, platform string, code string")


@query("enrich_nodes")
def enrich_nodes(spark, d):
    e = star.edges(spark, d)
    pick = lambda r: graph.joined_sorted(F.when(F.col("relation") == r, F.col("dst")))
    io = e.groupBy(F.col("src").alias("node_id")).agg(pick("reads_from").alias("sources"), pick("writes_to").alias("destinations"))
    return summarize.enrich(graph.by_type(star.nodes(spark, d), "operation").select("node_id", "name").join(io, "node_id")).select("node_id", "summary")


@query("enrich_edges")
def enrich_edges(spark, d):
    e = star.edges(spark, d).where("relation IN ('reads_from', 'writes_to')")
    return e.select("src", "dst", F.concat("src", F.lit(" "), F.replace("relation", F.lit("_"), F.lit(" ")), F.lit(" "), "dst").alias("summary"))


@query("metadata_docs")
def metadata_docs(spark, d):
    return star.nodes(spark, d).select("node_id", F.concat_ws(" ", "name", "node_type").alias("doc"))


@query("content_docs")
def content_docs(spark, d):
    return star.nodes(spark, d).select("node_id", F.concat_ws(" ", "node_type", "node_id", "name", "properties").alias("doc"))


@query("mv_manifest")
def mv_manifest(spark, d):
    views = ["mv_lineage", "mv_dependencies", "mv_shared_resources", "mv_summary_stats", "mv_complexity", "mv_sql_operations"]
    from weft.registry import QUERIES

    out = None
    for v in views:
        row = QUERIES[v](spark, d).agg(F.lit(v).alias("view_name"), F.count("*").alias("record_count"), F.lit("1.0").alias("version"))
        out = row if out is None else out.unionByName(row)
    return out


@query("event_windows", "SELECT epoch_us(time_bucket(INTERVAL '1 hour', ts)) // 1000000 AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def event_windows(spark, d):
    return windowed_counts(table(spark, d, "events")).select(F.unix_timestamp("w.start").alias("start"), "event_type", "n")
