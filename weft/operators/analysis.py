"""Cross-package analysis: what packages share, who depends on whom, and how risky that is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.operators.graph import joined_sorted
from weft.session import pieces, unique


def shared_tables(usage: DataFrame) -> DataFrame:
    """Tables that more than one package reads or writes; an integration point is both written and read."""
    io = usage.where(F.col("relation").isin("reads_from", "writes_to")).select("resource_id", "package_id", "relation")
    does = lambda r: F.max(F.col("relation") == r)
    one = io.repartition(pieces(usage), "resource_id").groupBy("resource_id", "package_id").agg(does("reads_from").alias("reads"), does("writes_to").alias("writes"))
    name, writer = F.when(F.col("reads"), F.col("package_id")), F.when(F.col("writes"), F.col("package_id"))
    out = one.groupBy(F.col("resource_id").alias("table_id")).agg(
        joined_sorted(name).alias("readers"),
        joined_sorted(writer).alias("writers"),
        joined_sorted(F.col("package_id")).alias("packages"),
        F.count("package_id").alias("package_count"),
        F.count(name).alias("reader_count"),
        F.count(writer).alias("writer_count"),
    )
    out = out.where("package_count > 1").withColumn("is_integration_point", (F.col("reader_count") > 0) & (F.col("writer_count") > 0))
    return out.drop("reader_count", "writer_count")


def shared_resources(usage: DataFrame, relation: str, many: int = 3) -> DataFrame:
    """Connections or parameters that more than one package uses, with a risk of HIGH beyond `many` packages."""
    out = usage.where(F.col("relation") == relation).groupBy("resource_id").agg(joined_sorted(F.col("package_id")).alias("packages"), F.count_distinct("package_id").alias("package_count"))
    return out.where("package_count > 1").withColumn("risk_level", F.when(F.col("package_count") > many, "HIGH").otherwise("MEDIUM"))


def data_dependencies(usage: DataFrame) -> DataFrame:
    """(writer, reader, table_id): packages that read what another writes, own tables left out."""
    n = pieces(usage)
    w = unique(usage.where("relation = 'writes_to'").select(F.col("package_id").alias("writer"), "resource_id"), n, "resource_id")
    r = unique(usage.where("relation = 'reads_from'").select(F.col("package_id").alias("reader"), "resource_id"), n, "resource_id")
    return w.join(r, "resource_id").where("writer <> reader").select("writer", "reader", F.col("resource_id").alias("table_id"))


def package_resources(usage: DataFrame) -> DataFrame:
    """Which package uses which resource, dealt out by resource."""
    return unique(usage.select("package_id", "resource_id"), pieces(usage), "resource_id")


def sharing_pairs(usage: DataFrame) -> DataFrame:
    """Unordered package pairs that share a resource, in canonical order, with the number of shared resources."""
    used = package_resources(usage)
    other = used.select(F.col("package_id").alias("package_2"), "resource_id")
    pairs = used.withColumnRenamed("package_id", "package_1").join(other, "resource_id").where("package_1 < package_2")
    return pairs.groupBy("package_1", "package_2").agg(F.count("*").alias("shared_count"))


def dependency_edges(usage: DataFrame) -> DataFrame:
    """Graph edges between packages: reader depends_on writer, and shares_resource both canonical ways once."""
    depends = data_dependencies(usage).groupBy("reader", "writer").agg(F.count("*").alias("weight")).select(
        F.col("reader").alias("src"), F.col("writer").alias("dst"), F.lit("depends_on").alias("relation"), "weight"
    )
    shares = sharing_pairs(usage).select(F.col("package_1").alias("src"), F.col("package_2").alias("dst"), F.lit("shares_resource").alias("relation"), F.col("shared_count").alias("weight"))
    return depends.unionByName(shares)


def contention(usage: DataFrame) -> DataFrame:
    """Connections of more than three packages and integration-point tables of more than two."""
    c = shared_resources(usage, "uses_connection").where("package_count > 3").select("resource_id", F.lit("connection").alias("kind"), "package_count")
    t = shared_tables(usage).where("package_count > 2 AND is_integration_point").select(F.col("table_id").alias("resource_id"), F.lit("table").alias("kind"), "package_count")
    return c.unionByName(t)


def package_properties(packages: DataFrame, usage: DataFrame) -> DataFrame:
    """Per package: upstream and downstream packages and shared resources."""
    d = data_dependencies(usage)
    up = d.groupBy(F.col("reader").alias("package_id")).agg(joined_sorted(F.col("writer")).alias("upstream"), F.count_distinct("writer").alias("upstream_count"))
    down = d.groupBy(F.col("writer").alias("package_id")).agg(joined_sorted(F.col("reader")).alias("downstream"), F.count_distinct("reader").alias("downstream_count"))
    used = package_resources(usage)
    many = used.groupBy("resource_id").agg(F.count("*").alias("n")).where("n > 1")
    shared = used.join(many, "resource_id", "left_semi").groupBy("package_id").agg(F.count("*").alias("shared_count"))
    out = packages.select(F.col("node_id").alias("package_id")).join(up, "package_id", "left").join(down, "package_id", "left").join(shared, "package_id", "left")
    return out.na.fill("", ["upstream", "downstream"]).na.fill(0, ["upstream_count", "downstream_count", "shared_count"])


def complexity(packages: int, operations: int, dependencies: int) -> float:
    """Operations for each package plus half a point for each dependency, to two places, halves to even."""
    return round(operations / packages + 0.5 * dependencies, 2) if packages else 0.0
