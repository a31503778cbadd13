"""Executable semantics of the dataflow components that projects are made of, as DataFrame transformations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.session import cut

JOINS = {"normal": "inner", "master_outer": "left", "detail_outer": "right", "full_outer": "full_outer"}


def conditional_split(df: DataFrame, conditions: dict[str, Column], default: str = "default") -> DataFrame:
    """df with `output`: the first condition, in order, that holds (null does not); else the default."""
    out = None
    for name, when in conditions.items():
        out = F.when(when, name) if out is None else out.when(when, name)
    return df.withColumn("output", F.lit(default) if out is None else out.otherwise(default))


def route(df: DataFrame, groups: dict[str, Column], default: str = "default") -> DataFrame:
    """A row for each group whose condition holds, several if several do, with `route`; the default if none does."""
    hits = F.array_compact(F.array(*[F.when(c, name) for name, c in groups.items()]))
    return df.withColumn("route", F.explode(F.when(F.size(hits) > 0, hits).otherwise(F.array(F.lit(default)))))


def lookup(df: DataFrame, reference: DataFrame, keys: list[str], columns: list[str], how: str = "left") -> DataFrame:
    """Equi-join to one reference row for each key, the least of duplicates: left (no match gives nulls), match or
    nomatch. The reference side is broadcast only where the planner's size estimate allows."""
    if how == "nomatch":
        return df.join(reference.select(*keys).distinct(), keys, "left_anti")
    least = F.min(F.struct(*columns)).alias("_r")
    one = reference.groupBy(*keys).agg(least).select(*keys, "_r.*")
    return df.join(one, keys, "left" if how == "left" else "inner")


def joiner(detail: DataFrame, master: DataFrame, on: Column, kind: str = "normal") -> DataFrame:
    """Normal join; master outer keeps all detail rows, detail outer all master rows, full outer both."""
    return detail.join(master, on, JOINS[kind])


def blocks(df: DataFrame, keys: list[str], most: int) -> DataFrame:
    """df's rows as c0 ..., with their keys as k0 ... and the number `at` of a block: one of at most so many rows, all of
    one key."""
    k = [f"k{i}" for i in range(len(keys))]
    rows = df.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keys)], *[F.col(c).alias(f"c{i}") for i, c in enumerate(df.columns)], F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("id"))
    near = Window.partitionBy("part", *k).orderBy("id")
    rows = rows.withColumn("place", F.row_number().over(near))
    first = F.when((F.col("place") - 1) % most == 0, F.col("id"))
    return rows.withColumn("at", F.max(first).over(near.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("part", "id", "place")


def merge_join(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]], how: str = "inner", most: int = 4096) -> DataFrame:
    """Join of inputs in which null keys are equal.

    A merge join by key gives all pairs of rows of a key to one task. Here each side's rows of a key are numbered by
    blocks of at most `most`, and the pairs of blocks of a key are what is dealt out and merged, so that few keys with
    many rows keep all tasks busy and a row meets `most` others at a time.
    """
    k = [f"k{i}" for i in range(len(pairs))]
    a, b = cut(blocks(left, [x for x, _ in pairs], most)), cut(blocks(right, [y for _, y in pairs], most))
    x, y = a.select(*k, F.col("at").alias("l")).distinct().alias("x"), b.select(*k, F.col("at").alias("r")).distinct().alias("y")
    on = F.lit(True)
    for c in k:
        on = on & F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}"))
    cells = cut(x.join(y, on, how).select("l", "r"))  # an outer join's blocks without a partner stay, with a null
    n = max(left.sparkSession.sparkContext.defaultParallelism, min(cells.count(), 200))  # up to 200 are written without a buffer

    def met(rows, df, side):
        own = cells.where(F.col(side).isNotNull()).withColumnsRenamed({"l": f"{side}_l", "r": f"{side}_r"})
        named = [F.col(f"c{i}").alias(f"{side}{i}") for i in range(len(df.columns))]
        return rows.join(own, rows["at"] == own[f"{side}_{side}"]).select(f"{side}_l", f"{side}_r", *named).repartition(n, f"{side}_l", f"{side}_r")

    p, q = met(a, left, "l"), met(b, right, "r")
    out = p.join(q.hint("merge"), (F.col("l_l") == F.col("r_l")) & (F.col("l_r") == F.col("r_r")), how)
    return out.select(*[F.col(f"{side}{i}").alias(c) for side, df in (("l", left), ("r", right)) for i, c in enumerate(df.columns)])


def ranked(df: DataFrame, by: str, groups: list[str], n: int, top: bool = True) -> DataFrame:
    """Rows within the n best ranks of each group, with `rank_index` (ties share a rank)."""
    order = F.col(by).desc() if top else F.col(by).asc()
    return df.withColumn("rank_index", F.rank().over(Window.partitionBy(*groups).orderBy(order))).where(F.col("rank_index") <= n)


def numbered(df: DataFrame, order: list[str], start: int = 1, step: int = 1, most: int | None = None, cycle: bool = False) -> DataFrame:
    """df with `nextval`: start, start + step ... in order; with cycle it starts again after `most`.

    Numbers are dense over all rows without one task for all: rows are sorted by range, partitions are counted, and
    each partition numbers its own rows from its offset.
    """
    part = df.orderBy(*order).withColumn("_part", F.spark_partition_id()).persist()
    counts = {r["_part"]: r["count"] for r in part.groupBy("_part").count().collect()}
    before, offsets = 0, []
    for p in sorted(counts):
        offsets += [F.lit(p), F.lit(before)]
        before += counts[p]
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    at = (F.element_at(F.create_map(*offsets), F.col("_part")) + own).cast("bigint") if offsets else F.lit(0).cast("bigint")
    if cycle and most is not None:
        at = F.pmod(at, F.lit((most - start) // step + 1))
    return part.withColumn("nextval", (F.lit(start) + at * step).cast("bigint")).drop("_part")


def normalized(df: DataFrame, keep: list[str], occurs: list[str], value: str = "value") -> DataFrame:
    """One row for each occurring column, with its number `gcid` (from 1)."""
    items = F.array(*[F.struct(F.lit(i).alias("gcid"), F.col(c).alias(value)) for i, c in enumerate(occurs, 1)])
    return df.select(*keep, F.explode(items).alias("_o")).select(*keep, "_o.gcid", f"_o.{value}")


def converted(df: DataFrame, column: str, to: str, disposition: str = "ignore") -> DataFrame:
    """Data conversion with its error output: ignore (null), fail (an error ends the job) or redirect (`error` marks rows
    that did not convert)."""
    if disposition == "fail":
        return df.withColumn(column, F.col(column).cast(to))
    out = df.withColumn("_to", F.col(column).try_cast(to))
    if disposition == "redirect":
        out = out.withColumn("error", F.col("_to").isNull() & F.col(column).isNotNull())
    return out.drop(column).withColumnRenamed("_to", column) if disposition == "ignore" else out.withColumnRenamed("_to", f"{column}_converted")


def update_strategy(target: DataFrame, tagged: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The target after rows tagged 0 insert, 1 update, 2 delete or 3 reject (`strategy`) have been applied."""
    t = target.select(key, *columns, F.lit(True).alias("_old"))
    s = tagged.where("strategy <> 3").select(F.col(key).alias("_k"), *[F.col(c).alias(f"_{c}") for c in columns], "strategy")
    both = t.join(s, t[key] == s["_k"], "full_outer")
    alive = (F.col("_old").isNotNull() & F.coalesce(F.col("strategy") != 2, F.lit(True))) | (F.col("_old").isNull() & (F.col("strategy") == 0))
    new = F.col("strategy").isin(0, 1)
    return both.where(alive).select(F.coalesce(key, "_k").alias(key), *[F.when(F.coalesce(new, F.lit(False)), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in columns])


def scd(dimension: DataFrame, incoming: DataFrame, key: str, changing: list[str], historical: list[str], start: Column) -> DataFrame:
    """Slowly changing dimension: changing attributes are overwritten, a change of historical ones ends the current row
    and starts a new one. dimension has key, attributes, valid_from, valid_to; current rows have no valid_to."""
    attributes = changing + historical
    now = dimension.where("valid_to IS NULL")
    past = dimension.where("valid_to IS NOT NULL")
    new = incoming.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_{c}") for c in attributes])
    both = now.join(new, now[key] == new["_k"], "full_outer")
    differs = F.lit(False)
    for c in historical:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"_{c}"))
    matched = F.col(key).isNotNull() & F.col("_k").isNotNull()
    kind = F.when(F.col(key).isNull(), "insert").when(~matched, "keep").when(differs, "expire").otherwise("update")
    both = both.withColumn("_kind", kind)
    take_new = lambda c: F.when(F.col("_kind") == "update", F.col(f"_{c}")).otherwise(F.col(c)).alias(c)
    old = both.where("_kind <> 'insert'").select(
        key, *[take_new(c) for c in changing], *historical, "valid_from", F.when(F.col("_kind") == "expire", start).alias("valid_to")
    )
    fresh = both.where("_kind IN ('insert', 'expire')").select(
        F.col("_k").alias(key), *[F.col(f"_{c}").alias(c) for c in attributes], start.alias("valid_from"), F.lit(None).cast(dimension.schema["valid_to"].dataType).alias("valid_to")
    )
    return past.select(key, *attributes, "valid_from", "valid_to").unionByName(old).unionByName(fresh)


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length, of lower-cased trimmed strings."""
    x, y = F.lower(F.trim(a)), F.lower(F.trim(b))
    return 1 - F.levenshtein(x, y) / F.greatest(F.length(x), F.length(y), F.lit(1))


def similar_pairs(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """(a, b, similarity) of the distinct values in left's only column and right's only column that are at least this
    similar (0 < least <= 1), exactly; null is similar to nothing.

    Within t edits, one of t + 1 consecutive pieces of the longer string stands unchanged in the shorter one, at most t
    places away. The longer string of a pair gives its length and the similarity the greatest t, so pairs that share
    (length, number of the piece, piece) are all that need comparing.
    """
    far = f"CAST(floor(n * {1 - least + 1e-6!r} + 1e-9) AS INT)"  # with room for rounding; candidates are compared below

    def values(df: DataFrame) -> DataFrame:
        v = df.select(F.col(df.columns[0]).alias("v")).where("v IS NOT NULL").distinct()
        return v.withColumn("x", F.lower(F.trim("v"))).withColumn("own", F.length("x"))

    def pieces(df: DataFrame) -> DataFrame:
        cut = df.withColumn("n", F.col("own")).withColumn("t", F.expr(far)).withColumn("i", F.explode(F.expr("sequence(0, t)")))
        cut = cut.withColumn("at", F.expr("CAST(i * n DIV (t + 1) AS INT)")).withColumn("end", F.expr("CAST((i + 1) * n DIV (t + 1) AS INT)"))
        return cut.select("v", "n", "i", F.expr("substring(x, at + 1, end - at)").alias("piece"))

    def places(df: DataFrame) -> DataFrame:
        longest = f"CAST(floor(own / {least - 1e-6!r}) AS INT) + 1"
        cut = df.withColumn("n", F.explode(F.expr(f"sequence(own, {longest})"))).withColumn("t", F.expr(far)).where("n - own <= t")
        cut = cut.withColumn("i", F.explode(F.expr("sequence(0, t)")))
        cut = cut.withColumn("at", F.expr("CAST(i * n DIV (t + 1) AS INT)")).withColumn("size", F.expr("CAST((i + 1) * n DIV (t + 1) AS INT) - at"))
        cut = cut.withColumn("from", F.greatest(F.expr("at - t"), F.lit(0))).withColumn("to", F.least(F.expr("at + t"), F.expr("own - size"))).where("`from` <= `to`")
        found = F.expr("array_distinct(transform(sequence(`from`, `to`), p -> substring(x, p + 1, size)))")
        return cut.select("v", "n", "i", F.explode(found).alias("piece"))

    a, b = values(left), values(right)
    on = ["n", "i", "piece"]
    longer = pieces(a).withColumnRenamed("v", "a").join(places(b).withColumnRenamed("v", "b"), on).select("a", "b")
    shorter = places(a).withColumnRenamed("v", "a").join(pieces(b).withColumnRenamed("v", "b"), on).select("a", "b")
    pairs = longer.unionByName(shorter).distinct()
    return pairs.withColumn("similarity", F.round(similarity(F.col("a"), F.col("b")), 6)).where(F.col("similarity") >= least)


def fuzzy_lookup(df: DataFrame, reference: DataFrame, column: str, ref_column: str, least: float = 0.7) -> DataFrame:
    """Best match of at least this similarity among all reference values; ties to the smaller value."""
    pairs = similar_pairs(df.select(column), reference.select(ref_column), least)
    best = pairs.groupBy("a").agg(F.min(F.struct((-F.col("similarity")).alias("s"), F.col("b").alias("_v"))).alias("b"))
    return df.join(best.withColumnRenamed("a", "_a"), F.col(column) == F.col("_a"), "left").select(*df.columns, F.col("b._v").alias("match_value"), (-F.col("b.s")).alias("similarity"))
