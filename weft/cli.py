"""Command line: ingest, analyze, dump, index and full over a project folder."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.operators import analysis, graph, search
from weft.session import session
from weft.sources import informatica, ssis


def project(spark, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of all packages and workflows below a path."""
    e, i = ssis.elements(spark, path), informatica.elements(spark, path)
    named = i.where("kind IN ('workflow', 'task', 'mapping', 'instance', 'source', 'target', 'session')")
    nodes = ssis.nodes(e).unionByName(named.select(F.col("id").alias("node_id"), F.when(F.col("kind").isin("source", "target"), "data_asset").when(F.col("kind") == "workflow", "pipeline").otherwise("operation").alias("node_type"), "name").distinct())
    return nodes, ssis.io_edges(e).unionByName(informatica.edges(i))


def usage(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(package_id, operation_id, resource_id, relation), through nested containers."""
    starts = graph.by_type(nodes, "pipeline").select(F.col("node_id").alias("root"))
    inside = graph.reach(edges.where("relation = 'contains'").select("src", "dst"), starts)
    used = edges.where(F.col("relation").isin("reads_from", "writes_to", "uses_connection"))
    return inside.join(used, inside["node"] == used["src"]).select(F.col("root").alias("package_id"), F.col("src").alias("operation_id"), F.col("dst").alias("resource_id"), "relation").distinct()


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="weft")
    p.add_argument("command", choices=["ingest", "analyze", "dump", "index", "full"])
    p.add_argument("--path", required=True)
    p.add_argument("--out", required=True)
    p.add_argument("--query", default="")
    a = p.parse_args(argv)
    spark = session("weft-cli")
    nodes, edges = project(spark, a.path)
    if a.command in ("ingest", "full"):
        nodes.write.mode("overwrite").parquet(f"{a.out}/nodes")
        edges.write.mode("overwrite").parquet(f"{a.out}/edges")
    if a.command in ("analyze", "full"):
        u = usage(nodes, edges)
        analysis.shared_tables(u).write.mode("overwrite").parquet(f"{a.out}/shared_tables")
        analysis.dependency_edges(u).write.mode("overwrite").parquet(f"{a.out}/package_edges")
    if a.command in ("dump", "full"):
        nodes.write.mode("overwrite").json(f"{a.out}/nodes_json")
        edges.write.mode("overwrite").json(f"{a.out}/links_json")
    if a.command in ("index", "full"):
        search.postings(nodes, "node_id", F.concat_ws(" ", "name", "node_type")).write.mode("overwrite").parquet(f"{a.out}/postings")
    if a.query:
        search.best(search.bm25(nodes, "node_id", F.concat_ws(" ", "name", "node_type"), a.query.lower().split()), 0.1, 0.3, 20).show(truncate=False)


if __name__ == "__main__":
    main()
