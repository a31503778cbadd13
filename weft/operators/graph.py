"""Operators on the metadata graph (nodes, edges as DataFrames): upserts, hops, levels, reach, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.session import cut, pieces, unique


def last_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by order: an upsert in which whole rows are replaced. The limit of one row for each
    key is taken on the map side as well, so that a hot key does not meet in one task."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order]))
    return rows.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def by_id(nodes: DataFrame, node_id: str) -> DataFrame:
    return nodes.where(F.col("node_id") == node_id)


def by_type(nodes: DataFrame, *types: str) -> DataFrame:
    return nodes.where(F.col("node_type").isin(*types))


def by_name(nodes: DataFrame, name: str) -> DataFrame:
    """Case-insensitive match of the trimmed name."""
    return nodes.where(F.lower(F.trim("name")) == name.strip().lower())


def orphans(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges of which an end is no node; they are set aside, never an error."""
    known = nodes.select("node_id")
    src = edges.join(known, edges["src"] == known["node_id"], "left_anti")
    dst = edges.join(known, edges["dst"] == known["node_id"], "left_anti")
    return src.unionByName(dst).distinct()


def package_operations(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(package_id, operation_id) by one containment hop."""
    ops = by_type(nodes, "operation").select(F.col("node_id").alias("operation_id"))
    held = edges.where("relation = 'contains'").select(F.col("src").alias("package_id"), F.col("dst").alias("operation_id"))
    return held.join(ops, "operation_id").select("package_id", "operation_id")


def operation_usage(edges: DataFrame, *relations: str) -> DataFrame:
    """(operation_id, resource_id, relation) of the edges with these relations."""
    return edges.where(F.col("relation").isin(*relations)).select(F.col("src").alias("operation_id"), F.col("dst").alias("resource_id"), "relation").distinct()


def package_usage(nodes: DataFrame, edges: DataFrame, *relations: str) -> DataFrame:
    return package_operations(nodes, edges).join(operation_usage(edges, *relations), "operation_id").select("package_id", "resource_id", "relation").distinct()


def reach(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(root, node, depth): all nodes reachable from starts (root) along edges (src, dst), at their least depth.

    A breadth-first loop of joins until nothing new is reached; each round keeps only what is new, so cycles end it.
    """
    edges = cut(edges.select("src", "dst").distinct())
    seen = front = cut(starts.select("root", F.col("root").alias("node"), F.lit(0).alias("depth")).distinct())
    depth = 0
    while not front.isEmpty():
        depth += 1
        step = front.join(edges, front["node"] == edges["src"]).select("root", F.col("dst").alias("node")).distinct()
        front = cut(step.join(seen, ["root", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        seen = seen.unionByName(front)
    return seen.where("depth > 0")


def levels(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, level): layers by Kahn's peeling of edges (src after dst), until nothing is free any more; nodes of
    cycles, and what comes after them, share one last level. A node's level is the number of rounds it outlasts."""
    edges = cut(edges.select("src", "dst").distinct())
    left = cut(nodes.select("node").distinct())
    n, rounds = left.count(), [left]
    while n:
        blocked = edges.join(left.withColumnRenamed("node", "dst"), "dst", "left_semi").select(F.col("src").alias("node")).distinct()
        left = cut(left.join(blocked, "node", "left_semi"))
        before, n = n, left.count()
        if n == before:
            break
        rounds.append(left)
    every = rounds[0]
    for r in rounds[1:]:
        every = every.unionByName(r)
    return every.groupBy("node").agg((F.count("*") - 1).cast("int").alias("level"))


def degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    out = edges.groupBy(F.col("src").alias("node_id")).agg(F.count("*").alias("out_degree"))
    into = edges.groupBy(F.col("dst").alias("node_id")).agg(F.count("*").alias("in_degree"))
    zero = {"out_degree": 0, "in_degree": 0}
    return nodes.select("node_id").join(out, "node_id", "left").join(into, "node_id", "left").na.fill(zero)


def pagerank(edges: DataFrame, rounds: int = 10, damping: float = 0.85, parts: int | None = None) -> DataFrame:
    """(node, rank) after a fixed number of rounds; ranks of dangling nodes are spread evenly. parts: partitions for the
    edges, else they are counted."""
    links = cut(unique(edges.select("src", "dst"), parts or pieces(edges)))
    nodes = links.select(F.col("src").alias("node")).unionByName(links.select(F.col("dst").alias("node")))
    nodes = cut(unique(nodes, pieces(links)))
    n = nodes.count()
    out = links.groupBy("src").agg(F.count("*").alias("fan"))
    shares = cut(links.join(out, "src"))
    ranks = nodes.withColumn("rank", F.lit(1.0 / max(n, 1)))
    for _ in range(rounds):
        ranks = cut(ranks)
        sent = shares.join(ranks, shares["src"] == ranks["node"]).groupBy("dst").agg(F.sum(F.col("rank") / F.col("fan")).alias("got"))
        loose = ranks.join(out, ranks["node"] == out["src"], "left_anti").agg(F.sum("rank")).first()[0] or 0.0
        ranks = nodes.join(sent, nodes["node"] == sent["dst"], "left").select(
            "node", (F.lit((1 - damping) / max(n, 1) + damping * loose / max(n, 1)) + damping * F.coalesce("got", F.lit(0.0))).alias("rank")
        )
    return ranks


def components(edges: DataFrame, parts: int | None = None) -> DataFrame:
    """(node, component): the least node of each weakly connected component, by label propagation with shortcuts until
    no label changes. parts: partitions for the edges, else they are counted."""
    ends = F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"))))
    both = cut(unique(edges.select(ends.alias("e")).select("e.src", "e.dst"), parts or pieces(edges)))
    labels = cut(both.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("m")).select("node", F.least("node", "m").alias("component")))
    while True:
        near = both.join(labels, both["dst"] == labels["node"]).groupBy("src").agg(F.min("component").alias("m"))
        lower = labels.join(near, labels["node"] == near["src"]).select("node", F.least("component", "m").alias("component"), F.col("component").alias("was"))
        jump = cut(lower.alias("a").join(lower.alias("b"), F.col("a.component") == F.col("b.node")).select("a.node", F.col("b.component").alias("component"), F.col("a.was").alias("was")))
        labels = jump.select("node", "component")
        if jump.where("component <> was").isEmpty():
            return labels


def joined_sorted(values: Column) -> Column:
    """Distinct values of a group, sorted and comma-joined."""
    return F.array_join(F.array_sort(F.collect_set(values)), ",")
