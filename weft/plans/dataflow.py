"""Queries that run the dataflow components on the provided tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.operators import dataflow as op
from weft.operators import graph
from weft.registry import query
from weft.session import table

DAY = "strftime(o_orderdate, '%Y-%m-%d')"


def _t(spark, d, *names):
    out = [table(spark, d, n) for n in names]
    return out[0] if len(out) == 1 else out


@query("conditional_split", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_mktsegment = 'BUILDING' THEN 'building' WHEN c_acctbal > 5000 THEN 'rich' ELSE 'default' END AS output FROM customer")
def conditional_split(spark, d):
    c = F.col("c_acctbal")
    return op.conditional_split(_t(spark, d, "customer"), {"debt": c < 0, "building": F.col("c_mktsegment") == "BUILDING", "rich": c > 5000}).select("c_custkey", "output")


@query("router", """
SELECT c_custkey, 'debt' AS route FROM customer WHERE c_acctbal < 0 UNION ALL SELECT c_custkey, 'building' FROM customer WHERE c_mktsegment = 'BUILDING'
UNION ALL SELECT c_custkey, 'rich' FROM customer WHERE c_acctbal > 5000
UNION ALL SELECT c_custkey, 'default' FROM customer WHERE NOT (c_acctbal < 0 OR c_mktsegment = 'BUILDING' OR c_acctbal > 5000)""")
def router(spark, d):
    c = F.col("c_acctbal")
    return op.route(_t(spark, d, "customer"), {"debt": c < 0, "building": F.col("c_mktsegment") == "BUILDING", "rich": c > 5000}).select("c_custkey", "route")


@query("infa_filter", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_discount > 0.05 AND l_returnflag <> 'N'")
def infa_filter(spark, d):
    return _t(spark, d, "lineitem").where("l_discount > 0.05 AND l_returnflag <> 'N'").select("l_orderkey", "l_linenumber")


@query("derived_column", "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net, upper(l_linestatus) || '-' || l_returnflag AS status FROM lineitem")
def derived_column(spark, d):
    return _t(spark, d, "lineitem").withColumns({"net": F.expr("l_extendedprice * (1 - l_discount)"), "status": F.expr("upper(l_linestatus) || '-' || l_returnflag")}).select("l_orderkey", "l_linenumber", "net", "status")


@query("infa_expression", "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 25 THEN 'bulk' ELSE 'single' END AS size_class, coalesce(p_brand, 'NONE') AS brand FROM lineitem LEFT JOIN (SELECT p_partkey, p_brand FROM part WHERE p_size > 10) ON l_partkey = p_partkey")
def infa_expression(spark, d):
    li, part = _t(spark, d, "lineitem", "part")
    ref = part.where("p_size > 10").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    out = op.lookup(li, ref, ["l_partkey"], ["p_brand"])
    return out.select("l_orderkey", "l_linenumber", F.when(F.col("l_quantity") > 25, "bulk").otherwise("single").alias("size_class"), F.coalesce("p_brand", F.lit("NONE")).alias("brand"))


@query("data_conversion", "SELECT event_id, TRY_CAST(event_type AS INTEGER) AS as_int, CAST(value AS INTEGER) AS value_int FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN CAST(user_id AS VARCHAR) ELSE event_type END AS event_type, trunc(value) AS value FROM events)")
def data_conversion(spark, d):
    e = _t(spark, d, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, F.col("user_id").cast("string")).otherwise(F.col("event_type")).alias("as_int"), F.col("value").cast("int").alias("value_int"))
    return op.converted(e, "as_int", "int")


@query("error_redirect", "SELECT event_id, raw, TRY_CAST(raw AS INTEGER) AS raw_converted, raw IS NOT NULL AND TRY_CAST(raw AS INTEGER) IS NULL AS error FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN CAST(user_id AS VARCHAR) WHEN event_id % 3 = 1 THEN event_type END AS raw FROM events)")
def error_redirect(spark, d):
    e = _t(spark, d, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, F.col("user_id").cast("string")).when(F.col("event_id") % 3 == 1, F.col("event_type")).alias("raw"))
    return op.converted(e, "raw", "int", "redirect")


@query("sequence_generator", "SELECT c_custkey, 100 + 5 * ((row_number() OVER (ORDER BY c_custkey) - 1) % 50) AS nextval FROM customer")
def sequence_generator(spark, d):
    return op.numbered(_t(spark, d, "customer").select("c_custkey"), ["c_custkey"], start=100, step=5, most=349, cycle=True)


@query("row_count", "SELECT 'orders' AS table_name, count(*) AS row_count FROM orders")
def row_count(spark, d):
    return _t(spark, d, "orders").agg(F.lit("orders").alias("table_name"), F.count("*").alias("row_count"))


for _kind, _how, _spark in (("inner", "JOIN", "inner"), ("left", "LEFT JOIN", "left"), ("right", "RIGHT JOIN", "right"), ("full", "FULL JOIN", "full_outer")):

    @query(f"join_{_kind}", f"SELECT c_custkey, o_orderkey FROM (SELECT * FROM customer WHERE c_acctbal > 0) {_how} (SELECT * FROM orders WHERE o_totalprice > 100000) ON c_custkey = o_custkey")
    def _join(spark, d, how=_spark):
        c, o = _t(spark, d, "customer", "orders")
        return c.where("c_acctbal > 0").join(o.where("o_totalprice > 100000"), F.col("c_custkey") == F.col("o_custkey"), how).select("c_custkey", "o_orderkey")


@query("join_cross", "SELECT r_name, n_name FROM region CROSS JOIN nation")
def join_cross(spark, d):
    r, n = _t(spark, d, "region", "nation")
    return r.crossJoin(n).select("r_name", "n_name")


@query("implicit_join", "SELECT o_orderkey, c_name FROM orders, customer WHERE o_custkey = c_custkey AND o_orderstatus = 'F'")
def implicit_join(spark, d):
    for n in ("orders", "customer"):
        _t(spark, d, n).createOrReplaceTempView(f"weft_{n}")
    return spark.sql("SELECT o_orderkey, c_name FROM weft_orders, weft_customer WHERE o_custkey = c_custkey AND o_orderstatus = 'F'")


_REF = "(SELECT c_custkey AS o_custkey, c_name, c_mktsegment FROM customer WHERE c_custkey % 2 = 0)"


def _orders_ref(spark, d):
    o, c = _t(spark, d, "orders", "customer")
    return o.select("o_orderkey", "o_custkey"), c.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_mktsegment")


@query("lookup_left", f"SELECT o_orderkey, o_custkey, c_name, c_mktsegment FROM orders LEFT JOIN {_REF} USING (o_custkey)")
def lookup_left(spark, d):
    o, ref = _orders_ref(spark, d)
    return op.lookup(o, ref, ["o_custkey"], ["c_name", "c_mktsegment"])


@query("lookup_match", f"SELECT o_orderkey, o_custkey, c_name, c_mktsegment FROM orders JOIN {_REF} USING (o_custkey)")
def lookup_match(spark, d):
    o, ref = _orders_ref(spark, d)
    return op.lookup(o, ref, ["o_custkey"], ["c_name", "c_mktsegment"], "match")


@query("lookup_nomatch", f"SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM {_REF})")
def lookup_nomatch(spark, d):
    o, ref = _orders_ref(spark, d)
    return op.lookup(o, ref, ["o_custkey"], [], "nomatch")


@query("infa_lookup", "SELECT l_orderkey, l_linenumber, first_part FROM lineitem LEFT JOIN (SELECT p_size AS l_linenumber, min(p_name) AS first_part FROM part GROUP BY 1) USING (l_linenumber)")
def infa_lookup(spark, d):
    li, part = _t(spark, d, "lineitem", "part")
    ref = part.select(F.col("p_size").alias("l_linenumber"), F.col("p_name").alias("first_part"))
    return op.lookup(li.select("l_orderkey", "l_linenumber"), ref, ["l_linenumber"], ["first_part"])


for _kind, _how in (("normal", "JOIN"), ("master_outer", "LEFT JOIN"), ("detail_outer", "RIGHT JOIN"), ("full_outer", "FULL JOIN")):

    @query(f"joiner_{_kind.removesuffix('_outer') if _kind == 'full_outer' else _kind}", f"SELECT o_orderkey, c_custkey FROM (SELECT * FROM orders WHERE o_orderstatus = 'O') {_how} (SELECT * FROM customer WHERE c_mktsegment = 'BUILDING') ON o_custkey = c_custkey")
    def _joiner(spark, d, kind=_kind):
        o, c = _t(spark, d, "orders", "customer")
        return op.joiner(o.where("o_orderstatus = 'O'"), c.where("c_mktsegment = 'BUILDING'"), F.col("o_custkey") == F.col("c_custkey"), kind).select("o_orderkey", "c_custkey")


for _how, _sql in (("left", "LEFT JOIN"), ("inner", "JOIN")):

    @query(f"merge_join_{_how}", f"SELECT s_suppkey, c_custkey FROM (SELECT s_suppkey, CASE WHEN s_nationkey % 5 > 0 THEN s_nationkey END AS a FROM supplier) {_sql} (SELECT c_custkey, CASE WHEN c_nationkey % 7 > 0 THEN c_nationkey END AS b FROM customer) ON a IS NOT DISTINCT FROM b")
    def _merge_join(spark, d, how=_how):
        s, c = _t(spark, d, "supplier", "customer")
        left = s.select("s_suppkey", F.when(F.col("s_nationkey") % 5 > 0, F.col("s_nationkey")).alias("a"))
        right = c.select("c_custkey", F.when(F.col("c_nationkey") % 7 > 0, F.col("c_nationkey")).alias("b"))
        return op.merge_join(left, right, [("a", "b")], how).select("s_suppkey", "c_custkey")


@query("infa_aggregator", "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, sum(l_extendedprice * (1 - l_discount)) AS revenue, avg(l_discount) AS avg_disc, count(*) AS n FROM lineitem GROUP BY 1, 2")
def infa_aggregator(spark, d):
    return _t(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.sum("l_quantity").alias("sum_qty"), F.sum(F.expr("l_extendedprice * (1 - l_discount)")).alias("revenue"), F.avg("l_discount").alias("avg_disc"), F.count("*").alias("n")
    )


@query("ssis_aggregate", "SELECT c_nationkey, count(c_acctbal) AS n, count(*) AS n_all, count(DISTINCT c_mktsegment) AS n_distinct, sum(c_acctbal) AS total, avg(c_acctbal) AS average, min(c_acctbal) AS least, max(c_acctbal) AS most FROM customer GROUP BY 1")
def ssis_aggregate(spark, d):
    a = "c_acctbal"
    return _t(spark, d, "customer").groupBy("c_nationkey").agg(
        F.count(a).alias("n"), F.count("*").alias("n_all"), F.count_distinct("c_mktsegment").alias("n_distinct"), F.sum(a).alias("total"), F.avg(a).alias("average"), F.min(a).alias("least"), F.max(a).alias("most")
    )


@query("pivot_max_case", "SELECT user_id, max(CASE WHEN event_type = 'click' THEN value END) AS click, max(CASE WHEN event_type = 'purchase' THEN value END) AS purchase, max(CASE WHEN event_type = 'view' THEN value END) AS view FROM events GROUP BY 1")
def pivot_max_case(spark, d):
    return _t(spark, d, "events").groupBy("user_id").pivot("event_type", ["click", "purchase", "view"]).agg(F.max("value"))


@query("distinct_vals", "SELECT DISTINCT o_orderpriority, o_orderstatus FROM orders")
def distinct_vals(spark, d):
    return _t(spark, d, "orders").select("o_orderpriority", "o_orderstatus").distinct()


@query("scalar_max", "SELECT max(o_totalprice) AS max_price FROM orders")
def scalar_max(spark, d):
    return _t(spark, d, "orders").agg(F.max("o_totalprice").alias("max_price"))


for _top in (True, False):

    @query(f"rank_{'top' if _top else 'bottom'}", f"SELECT p_partkey, p_brand, CAST(r AS INTEGER) AS rank_index FROM (SELECT p_partkey, p_brand, rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice {'DESC' if _top else 'ASC'}) AS r FROM part) WHERE r <= 3")
    def _rank(spark, d, top=_top):
        return op.ranked(_t(spark, d, "part"), "p_retailprice", ["p_brand"], 3, top).select("p_partkey", "p_brand", "rank_index")


@query("sorter", "SELECT c_custkey, row_number() OVER (ORDER BY lower(c_mktsegment), c_acctbal DESC, c_custkey) AS nextval FROM customer")
def sorter(spark, d):
    c = _t(spark, d, "customer").select("c_custkey", F.lower("c_mktsegment").alias("s"), (-F.col("c_acctbal")).alias("b"))
    return op.numbered(c, ["s", "b", "c_custkey"]).select("c_custkey", "nextval")


@query("sorter_distinct", "SELECT DISTINCT lower(c_mktsegment) AS segment, c_nationkey FROM customer ORDER BY 1, 2")
def sorter_distinct(spark, d):
    return _t(spark, d, "customer").select(F.lower("c_mktsegment").alias("segment"), "c_nationkey").distinct().orderBy("segment", "c_nationkey")


@query("ssis_sort_dedupe", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k FROM orders) WHERE k = 1")
def ssis_sort_dedupe(spark, d):
    o = _t(spark, d, "orders").groupBy("o_custkey").agg(F.min(F.struct("o_orderdate", "o_orderkey")).alias("f"))
    return o.select("o_custkey", "f.o_orderkey")


@query("union_all", "SELECT c_nationkey AS nation, 'customer' AS kind FROM customer UNION ALL SELECT s_nationkey, 'supplier' FROM supplier")
def union_all(spark, d):
    c, s = _t(spark, d, "customer", "supplier")
    return c.select(F.col("c_nationkey").alias("nation"), F.lit("customer").alias("kind")).unionByName(s.select(F.lit("supplier").alias("kind"), F.col("s_nationkey").alias("nation")), allowMissingColumns=True)


@query("union_distinct", "SELECT c_nationkey AS nation FROM customer UNION SELECT s_nationkey FROM supplier")
def union_distinct(spark, d):
    return union_all(spark, d).select("nation").distinct()


@query("multicast", "SELECT 'by_flag' AS branch, l_returnflag AS label, count(*) AS n FROM lineitem GROUP BY 2 UNION ALL SELECT 'by_status', l_linestatus, count(*) FROM lineitem GROUP BY 2")
def multicast(spark, d):
    li = _t(spark, d, "lineitem")
    branch = lambda name, c: li.groupBy(F.lit(name).alias("branch"), F.col(c).alias("label")).agg(F.count("*").alias("n"))
    return branch("by_flag", "l_returnflag").unionByName(branch("by_status", "l_linestatus"))


@query("normalizer", "SELECT l_orderkey, l_linenumber, 1 AS gcid, l_quantity AS value FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 2, l_discount FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 3, l_tax FROM lineitem")
def normalizer(spark, d):
    return op.normalized(_t(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_quantity", "l_discount", "l_tax"])


_INCOMING = """
incoming AS (SELECT c_custkey, c_acctbal * 1.5 AS c_acctbal, c_mktsegment FROM customer WHERE c_custkey % 10 = 0
             UNION ALL SELECT c_custkey + 1000000, c_acctbal, 'NEW' FROM customer WHERE c_custkey % 50 = 1)"""


def _incoming(spark, d):
    c = _t(spark, d, "customer")
    old = c.where("c_custkey % 10 = 0").select("c_custkey", (F.col("c_acctbal") * 1.5).alias("c_acctbal"), "c_mktsegment")
    return c, old.unionByName(c.where("c_custkey % 50 = 1").select((F.col("c_custkey") + 1000000).alias("c_custkey"), "c_acctbal", F.lit("NEW").alias("c_mktsegment")))


@query("update_strategy", f"""WITH {_INCOMING}, tagged AS (SELECT *, CASE WHEN c_custkey > 1000000 THEN 0 WHEN c_custkey % 30 = 0 THEN 2 WHEN c_custkey % 70 = 0 THEN 3 ELSE 1 END AS s FROM incoming)
SELECT coalesce(c.c_custkey, t.c_custkey) AS c_custkey, CASE WHEN t.s IN (0, 1) THEN t.c_acctbal ELSE c.c_acctbal END AS c_acctbal
FROM customer c FULL JOIN (SELECT * FROM tagged WHERE s <> 3) t ON c.c_custkey = t.c_custkey WHERE t.s IS DISTINCT FROM 2 AND (c.c_custkey IS NOT NULL OR t.s = 0)""")
def update_strategy(spark, d):
    c, new = _incoming(spark, d)
    k = F.col("c_custkey")
    tag = F.when(k > 1000000, 0).when(k % 30 == 0, 2).when(k % 70 == 0, 3).otherwise(1)
    return op.update_strategy(c, new.withColumn("strategy", tag), "c_custkey", ["c_acctbal"])


@query("oledb_command_update", f"WITH {_INCOMING} SELECT c.c_custkey, coalesce(i.c_acctbal, c.c_acctbal) AS c_acctbal FROM customer c LEFT JOIN incoming i ON c.c_custkey = i.c_custkey")
def oledb_command_update(spark, d):
    c, new = _incoming(spark, d)
    return c.select("c_custkey", F.col("c_acctbal").alias("old")).join(new.select("c_custkey", "c_acctbal"), "c_custkey", "left").select("c_custkey", F.coalesce("c_acctbal", "old").alias("c_acctbal"))


def _dimension(spark, d):
    c, new = _incoming(spark, d)
    dim = c.select("c_custkey", "c_acctbal", "c_mktsegment", F.lit("2020-01-01").alias("valid_from"), F.lit(None).cast("string").alias("valid_to"))
    return dim, new.withColumn("c_mktsegment", F.when(F.col("c_custkey") % 20 == 0, "MOVED").otherwise(F.col("c_mktsegment")))


_NEW = f"{_INCOMING}, new AS (SELECT c_custkey, c_acctbal, CASE WHEN c_custkey % 20 = 0 THEN 'MOVED' ELSE c_mktsegment END AS c_mktsegment FROM incoming)"


@query("scd_type1", f"WITH {_NEW} SELECT coalesce(c.c_custkey, n.c_custkey) AS c_custkey, coalesce(n.c_acctbal, c.c_acctbal) AS c_acctbal, coalesce(n.c_mktsegment, c.c_mktsegment) AS c_mktsegment FROM customer c FULL JOIN new n ON c.c_custkey = n.c_custkey")
def scd_type1(spark, d):
    dim, new = _dimension(spark, d)
    return op.scd(dim, new, "c_custkey", ["c_acctbal", "c_mktsegment"], [], F.lit("2024-01-01")).select("c_custkey", "c_acctbal", "c_mktsegment")


@query("scd_type2", f"""WITH {_NEW}, j AS (SELECT c.c_custkey AS k, n.c_custkey AS nk, c.c_acctbal AS a, n.c_acctbal AS na, c.c_mktsegment AS m, n.c_mktsegment AS nm FROM customer c FULL JOIN new n ON c.c_custkey = n.c_custkey)
SELECT k AS c_custkey, CASE WHEN nk IS NOT NULL AND m = nm THEN na ELSE a END AS c_acctbal, m AS c_mktsegment, '2020-01-01' AS valid_from, CASE WHEN nk IS NOT NULL AND m <> nm THEN '2024-01-01' END AS valid_to FROM j WHERE k IS NOT NULL
UNION ALL SELECT nk, na, nm, '2024-01-01', NULL FROM j WHERE nk IS NOT NULL AND (k IS NULL OR m <> nm)""")
def scd_type2(spark, d):
    dim, new = _dimension(spark, d)
    return op.scd(dim, new, "c_custkey", ["c_acctbal"], ["c_mktsegment"], F.lit("2024-01-01"))


@query("fact_key_resolution", "SELECT l_orderkey, l_linenumber, o_custkey AS customer_key, p_partkey AS part_key, s_suppkey AS supplier_key, n_nationkey AS nation_key FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN part ON l_partkey = p_partkey LEFT JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN nation ON s_nationkey = n_nationkey")
def fact_key_resolution(spark, d):
    li, o, p, s, n = _t(spark, d, "lineitem", "orders", "part", "supplier", "nation")
    out = li.join(o, F.col("l_orderkey") == F.col("o_orderkey"), "left").join(p, F.col("l_partkey") == F.col("p_partkey"), "left")
    out = out.join(s, F.col("l_suppkey") == F.col("s_suppkey"), "left").join(n, F.col("s_nationkey") == F.col("n_nationkey"), "left")
    return out.select("l_orderkey", "l_linenumber", F.col("o_custkey").alias("customer_key"), F.col("p_partkey").alias("part_key"), F.col("s_suppkey").alias("supplier_key"), F.col("n_nationkey").alias("nation_key"))


@query("smart_date_key", "SELECT o_orderkey, CAST(year(o_orderdate) * 10000 + month(o_orderdate) * 100 + day(o_orderdate) AS INTEGER) AS date_key FROM orders")
def smart_date_key(spark, d):
    return _t(spark, d, "orders").select("o_orderkey", F.expr("year(o_orderdate) * 10000 + month(o_orderdate) * 100 + day(o_orderdate)").alias("date_key"))


@query("incremental_window", "SELECT event_id, user_id FROM events, (SELECT min(ts) + (max(ts) - min(ts)) / 4 AS a, min(ts) + (max(ts) - min(ts)) / 2 AS b FROM events) WHERE ts >= a AND ts < b")
def incremental_window(spark, d):
    e = _t(spark, d, "events")
    lo, hi = e.agg(F.min(F.unix_micros(F.col("ts").cast("timestamp"))), F.max(F.unix_micros(F.col("ts").cast("timestamp")))).first()
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    return e.where((at >= lo + (hi - lo) // 4) & (at < lo + (hi - lo) // 2)).select("event_id", "user_id")


@query("source_qualifier", "SELECT n_name, sum(o_totalprice) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def source_qualifier(spark, d):
    for n in ("orders", "customer", "nation"):
        _t(spark, d, n).createOrReplaceTempView(f"weft_{n}")
    return spark.sql("SELECT n_name, sum(o_totalprice) AS total FROM weft_orders JOIN weft_customer ON o_custkey = c_custkey JOIN weft_nation ON c_nationkey = n_nationkey GROUP BY n_name")


@query("src_param_query", "SELECT o_orderkey FROM orders WHERE o_totalprice > 150000 AND o_orderstatus = 'O'")
def src_param_query(spark, d):
    _t(spark, d, "orders").createOrReplaceTempView("weft_orders")
    return spark.sql("SELECT o_orderkey FROM weft_orders WHERE o_totalprice > ? AND o_orderstatus = ?", args=[150000, "O"])


@query("fuzzy_lookup", """
WITH ref AS (SELECT DISTINCT p_name AS v FROM part),
src AS (SELECT p_partkey, replace(p_name, 'a', 'e') AS p_name FROM part),
p AS (SELECT p_name, v, round(1 - levenshtein(lower(trim(p_name)), lower(trim(v))) / CAST(greatest(length(trim(p_name)), length(trim(v)), 1) AS DOUBLE), 6) AS s FROM (SELECT DISTINCT p_name FROM src) CROSS JOIN ref),
k AS (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY s DESC, v) AS r FROM p WHERE s >= 0.7)
SELECT src.p_partkey, src.p_name, k.v AS match_value, k.s AS similarity FROM src LEFT JOIN k ON src.p_name = k.p_name AND r = 1""")
def fuzzy_lookup(spark, d):
    p = _t(spark, d, "part")
    src = p.select("p_partkey", F.expr("replace(p_name, 'a', 'e')").alias("p_name"))
    return op.fuzzy_lookup(src, p, "p_name", "p_name")


@query("fuzzy_grouping", """
WITH RECURSIVE v AS (SELECT DISTINCT n_name AS v FROM nation UNION SELECT DISTINCT replace(n_name, 'A', 'E') FROM nation),
e AS (SELECT a.v AS a, b.v AS b FROM v a CROSS JOIN v b WHERE 1 - levenshtein(lower(a.v), lower(b.v)) / CAST(greatest(length(a.v), length(b.v)) AS DOUBLE) >= 0.6),
w(v, c) AS (SELECT v, v FROM v UNION SELECT e.b, w.c FROM w JOIN e ON e.a = w.v AND e.b > w.c)
SELECT v AS value, min(c) AS canonical FROM w GROUP BY 1""")
def fuzzy_grouping(spark, d):
    n = _t(spark, d, "nation")
    v = n.select(F.col("n_name").alias("v")).unionByName(n.select(F.expr("replace(n_name, 'A', 'E')").alias("v")))
    edges = op.similar_pairs(v, v, 0.6).select(F.col("a").alias("src"), F.col("b").alias("dst"))
    return graph.components(edges).select(F.col("node").alias("value"), F.col("component").alias("canonical"))
