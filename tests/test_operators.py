"""Behaviour that the oracle tables do not show: cycles, disposition, metamorphic checks, sources, semantics."""

import random

import pytest
from pyspark.sql import functions as F

from weft import registry
from weft.functions import codegen
from weft.functions.sql_semantics import semantics
from weft.operators import dataflow as op
from weft.operators import graph
from weft.plans import star
from weft.plans.sources import SAMPLES
from weft.sources import informatica, ssis


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_levels_put_cycles_into_one_last_level(spark):
    e = spark.createDataFrame([("b", "a"), ("c", "b"), ("x", "y"), ("y", "x")], "src string, dst string")
    n = spark.createDataFrame([(k,) for k in "abcxyz"], "node string")
    assert rows(graph.levels(e, n)) == [("a", 0), ("b", 1), ("c", 2), ("x", 3), ("y", 3), ("z", 0)]


def test_levels_respect_every_edge(spark):
    pairs = [(i, j) for i in range(12) for j in range(i) if (i * 7 + j) % 5 == 0]
    e = spark.createDataFrame([(str(i), str(j)) for i, j in pairs], "src string, dst string")
    n = spark.createDataFrame([(str(i),) for i in range(12)], "node string")
    level = dict(rows(graph.levels(e, n)))
    assert len(level) == 12 and all(level[str(i)] > level[str(j)] for i, j in pairs)


def test_reach_ends_on_cycles(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "src string, dst string")
    s = spark.createDataFrame([("a",)], "root string")
    assert rows(graph.reach(e, s)) == [("a", "b", 1), ("a", "c", 2)]


def test_pagerank_sums_to_one(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("a", "d")], "src string, dst string")
    ranks = dict(rows(graph.pagerank(e, rounds=15)))
    assert abs(sum(ranks.values()) - 1) < 1e-9 and ranks["b"] == pytest.approx(ranks["d"])


def test_lookup_outputs_make_up_the_input(spark):
    df = spark.createDataFrame([(1,), (2,), (3,), (None,)], "k int")
    ref = spark.createDataFrame([(1, "b"), (1, "a"), (2, "c")], "k int, v string")
    assert rows(op.lookup(df, ref, ["k"], ["v"], "match")) == [(1, "a"), (2, "c")]
    assert op.lookup(df, ref, ["k"], [], "nomatch").count() == 2
    assert op.lookup(df, ref, ["k"], ["v"]).count() == 4


def test_router_sends_to_all_groups_and_split_to_the_first(spark):
    df = spark.createDataFrame([(1,), (5,), (None,)], "v int")
    groups = {"small": F.col("v") < 6, "one": F.col("v") == 1}
    assert rows(op.route(df, groups).na.fill(0)) == [(0, "default"), (1, "one"), (1, "small"), (5, "small")]
    assert [r[1] for r in rows(op.conditional_split(df, groups).na.fill(0))] == ["default", "small", "small"]


def test_merge_join_matches_nulls(spark):
    a = spark.createDataFrame([(None,), (1,)], "x int")
    b = spark.createDataFrame([(None,), (2,)], "y int")
    assert op.merge_join(a, b, [("x", "y")]).count() == 1


def test_scd_keeps_one_current_row_for_each_key(spark):
    dim = spark.createDataFrame([(1, "a", "x", "2020", None), (2, "b", "y", "2020", None), (2, "b", "w", "2019", "2020")], "k int, c string, h string, valid_from string, valid_to string")
    new = spark.createDataFrame([(1, "a2", "x"), (2, "b2", "z"), (3, "n", "n")], "k int, c string, h string")
    out = op.scd(dim, new, "k", ["c"], ["h"], F.lit("2024"))
    assert rows(out.where("valid_to IS NULL").select("k", "c", "h", "valid_from")) == [(1, "a2", "x", "2020"), (2, "b2", "z", "2024"), (3, "n", "n", "2024")]
    assert out.where("k = 2").count() == 3


def test_numbers_are_dense(spark):
    out = op.numbered(spark.range(1000).repartition(7).select("id"), ["id"], start=10, step=2)
    assert [r[1] for r in rows(out)] == list(range(10, 2010, 2))
    assert op.numbered(spark.range(0), ["id"]).count() == 0


def test_packages_are_walked_to_nested_tasks(spark):
    e = ssis.elements(spark, SAMPLES)
    edges = rows(ssis.io_edges(e))
    copy = "pipeline:LoadOrders:operation:Box\\Copy"
    assert (copy, "table:dbo.orders", "reads_from") in edges and (copy, "table:dbo.customers", "reads_from") in edges
    assert (copy, "table:stg.orders", "writes_to") in edges and (copy, "connection:Warehouse", "uses_connection") in edges
    assert ("pipeline:LoadOrders:operation:Truncate", "table:stg.orders", "writes_to") in edges
    assert e.where("kind = 'error'").count() == 1


def test_workflows(spark):
    e = informatica.elements(spark, SAMPLES)
    found = rows(informatica.edges(e))
    assert ("session:s_orders", "mapping:m_orders", "executes") in found
    assert ("mapping:m_orders:instance:F_ORDERS", "mapping:m_orders:instance:FIL_BIG", "derived_from") in found


def test_semantics_and_generated_code(spark):
    s = semantics(spark, "SELECT a.x AS y FROM dbo.A a LEFT JOIN [dbo].[B] b ON a.id = b.id -- note\n WHERE a.z > ?")
    assert s.tables == [("dbo.A", "a"), ("dbo.B", "b")] and s.joins[0][:3] == ("LEFT JOIN", "a", "b") and "a.z" in s.where
    assert '"left"' in codegen.generate(s, "spark") and "ref('b')" in codegen.generate(s, "dbt")
    assert semantics(spark, "not sql at all (") is None
    with pytest.raises(ValueError):
        codegen.generate(s, "snowflake")


SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("how", ["left", "inner"])
def test_merge_join_of_all_customers_against_brute_force(spark, how):
    keys = lambda name, k, n, m: [(r[0], r[1] if r[1] % m else None) for r in spark.read.parquet(f"{SF}/{name}.parquet").select(k, n).collect()]
    suppliers, customers = keys("supplier", "s_suppkey", "s_nationkey", 5), keys("customer", "c_custkey", "c_nationkey", 7)
    want = [(s, c) for s, a in suppliers for c, b in customers if a == b]
    if how == "left":
        want += [(s, None) for s, a in suppliers if a not in {b for _, b in customers}]
    order = lambda r: (r[0], r[1] is not None, r[1] or 0)
    got = [tuple(r) for r in registry.QUERIES[f"merge_join_{how}"](spark, SF).collect()]
    assert sorted(got, key=order) == sorted(want, key=order)


@pytest.mark.parametrize("how", ["inner", "left", "right", "full_outer"])
def test_merge_join_by_blocks_against_brute_force(spark, how):
    r = random.Random(3)
    side = lambda n, low: [(r.choice([None, *range(low, low + 5)]), r.choice([None, "x", "y"]), i) for i in range(n)]
    left, right = side(90, 0), side(70, 2)
    a = spark.createDataFrame(left, "k int, m string, v int").repartition(3)
    b = spark.createDataFrame(right, "k int, n string, v int").repartition(2)
    want = [x + y for x in left for y in right if x[:2] == y[:2]]
    if how in ("left", "full_outer"):
        want += [x + (None,) * 3 for x in left if x[:2] not in {y[:2] for y in right}]
    if how in ("right", "full_outer"):
        want += [(None,) * 3 + y for y in right if y[:2] not in {x[:2] for x in left}]
    for most in (1, 4, 4096):
        out = op.merge_join(a, b, [("k", "k"), ("m", "n")], how, most)
        assert out.columns == ["k", "m", "v", "k", "n", "v"]
        assert sorted(map(str, (tuple(x) for x in out.collect()))) == sorted(map(str, want))


def test_merge_join_of_one_key_is_shared_by_tasks(spark):
    a = spark.range(1000).select(F.lit(None).cast("int").alias("x"), "id")
    b = spark.range(1000).select(F.lit(None).cast("int").alias("y"), F.col("id").alias("other"))
    sizes = [r["count"] for r in op.merge_join(a, b, [("x", "y")], "left", 50).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 1_000_000 and len(sizes) > 100 and max(sizes) < 40_000
    none = op.merge_join(a.limit(0), b, [("x", "y")])
    assert none.count() == 0


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def alike(a, b):
    x, y = a.strip(" ").lower(), b.strip(" ").lower()
    return round(1 - edits(x, y) / max(len(x), len(y), 1), 6)


@pytest.mark.parametrize("least", [0.3, 0.6, 0.7, 0.85, 1.0])
def test_similar_pairs_miss_nothing(spark, least):
    r = random.Random(7)
    words = ["", " ", "a", "B", "ab", "éa"] + ["".join(r.choice("abC ") for _ in range(r.randrange(1, 14))) for _ in range(150)]
    other = ["", "b", "aé"] + ["".join(r.choice("abc ") for _ in range(r.randrange(1, 14))) for _ in range(150)]
    frame = lambda v: spark.createDataFrame([(x,) for x in [*v, None]], "v string")
    got = {(x["a"], x["b"]): x["similarity"] for x in op.similar_pairs(frame(words), frame(other), least).collect()}
    assert got == {(a, b): alike(a, b) for a in words for b in other if alike(a, b) >= least}


def test_fuzzy_lookup_of_all_parts_against_brute_force(spark):
    names = [x[0] for x in spark.read.parquet(f"{SF}/part.parquet").select("p_name").collect()]
    got = registry.QUERIES["fuzzy_lookup"](spark, SF).collect()
    best = {}
    for n in {n.replace("a", "e") for n in names}:
        hits = sorted((-alike(n, v), v) for v in set(names) if alike(n, v) >= 0.7)
        best[n] = (hits[0][1], -hits[0][0]) if hits else (None, None)
    assert len(got) == len(names) and all((x["match_value"], x["similarity"]) == best[x["p_name"]] for x in got)
    assert best["smell geer"][0] == "small gear"


def test_fuzzy_grouping_joins_names_with_their_edited_copies(spark):
    got = {x["value"]: x["canonical"] for x in registry.QUERIES["fuzzy_grouping"](spark, SF).collect()}
    root = {v: v for v in got}
    for _ in got:
        root = {a: min(root[b] for b in got if alike(a, b) >= 0.6) for a in got}
    assert got == root and got["NATION_0"] == got["NETION_0"] and len(got) == 50


def test_whole_graph_has_the_edges_of_all_lines(spark):
    from collections import defaultdict

    read = lambda name, *columns: [tuple(r) for r in spark.read.parquet(f"{SF}/{name}.parquet").select(*columns).collect()]
    nation = dict(read("nation", "n_nationkey", "n_name"))
    supplier = {k: (f"pipeline:{nation[n]}", f"pipeline:{nation[n]}:operation:{s}") for k, s, n in read("supplier", "s_suppkey", "s_name", "s_nationkey")}
    priority, brand = dict(read("orders", "o_orderkey", "o_orderpriority")), dict(read("part", "p_partkey", "p_brand"))
    want, packages = {(p, o, "contains") for p, o in supplier.values()}, defaultdict(set)
    for order, part, supp, flag in read("lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_returnflag"):
        package, operation = supplier[supp]
        want |= {(operation, f"table:{part}", "writes_to" if flag == "A" else "reads_from"), (operation, f"connection:{priority[order]}", "uses_connection"), (operation, f"parameter:{brand[part]}", "uses_parameter")}
        packages[f"table:{part}"].add(package)
    got = [tuple(r) for r in star.edges(spark, SF).select("src", "dst", "relation").collect()]
    assert len(got) == len(want) and set(got) == want
    shared = {r["table_id"]: r["package_count"] for r in registry.QUERIES["shared_tables"](spark, SF).collect()}
    assert shared == {t: len(p) for t, p in packages.items() if len(p) > 1}


def test_levels_of_cycles_and_long_chains(spark):
    chain = [(f"n{i + 1:03}", f"n{i:03}") for i in range(30)] + [("x", "y"), ("y", "x"), ("z", "x")]
    edges = spark.createDataFrame(chain, "src string, dst string")
    nodes = spark.createDataFrame([(n,) for n in sorted({n for e in chain for n in e})], "node string")
    got = {r["node"]: r["level"] for r in graph.levels(edges, nodes).collect()}
    assert all(got[f"n{i:03}"] == i for i in range(31))
    assert got["x"] == got["y"] == got["z"] == 31


def test_reach_has_no_depth_limit_and_ends_on_cycles(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(26)] + [(26, 0)], "src int, dst int")
    got = {r["node"]: r["depth"] for r in graph.reach(edges, spark.createDataFrame([(0,)], "root int")).collect()}
    assert got == {i: i for i in range(1, 27)}


def test_lines_lie_in_as_many_partitions_as_their_number_asks_for(spark, monkeypatch):
    from weft import session

    assert session.pieces(spark.range(100), 10) == 11 and session.pieces(spark.range(0)) == spark.sparkContext.defaultParallelism
    monkeypatch.setattr(star, "pieces", lambda df: 40)
    for rows in (star.edges(spark, SF), star.usage(spark, SF)):
        io = rows.where(F.col("relation").isin("reads_from", "writes_to"))
        sizes = [r["count"] for r in io.groupBy(F.spark_partition_id().alias("p")).count().collect()]
        assert len(sizes) == 40 and max(sizes) < 2 * sum(sizes) / 40


def test_usage_has_a_row_once_when_suppliers_share_a_name(spark, tmp_path):
    for name in ("nation", "part", "orders"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    s, li = spark.read.parquet(f"{SF}/supplier.parquet"), spark.read.parquet(f"{SF}/lineitem.parquet")
    n = s.count()
    twice = s.unionByName(s.withColumn("s_suppkey", F.col("s_suppkey") + n))
    twice.write.parquet(f"{tmp_path}/supplier.parquet")
    li.withColumn("l_suppkey", F.col("l_suppkey") + F.when(F.col("l_orderkey") % 2 == 0, n).otherwise(0)).write.parquet(f"{tmp_path}/lineitem.parquet")
    from weft.plans.analysis import _usage

    want = rows(_usage(spark, SF).select("package_id", "resource_id", "relation"))
    got = rows(_usage(spark, str(tmp_path)).select("package_id", "resource_id", "relation"))
    assert len(set(got)) == len(got) and got == want
    edges = lambda d: rows(star.edges(spark, str(d)).where("relation <> 'contains'"))
    assert edges(tmp_path) == edges(SF)
