"""Approximate nearest neighbours: multiprobe p-stable hashing with exact reranking.

Each of TABLES tables hashes a vector by HASHES p-stable functions floor((a x + b) / w), a Gaussian (for Euclidean
distance). A query visits, beside its own bucket, buckets perturbed by -1 or +1 in some functions. A perturbation's
score is the sum of the squared distances from the query's projections to the boundaries it crosses; by ascending
score is by descending estimated chance of success. The order of perturbation sets by expected score is laid out
once (over ranks of boundary distances), the query's own distances then give each probe's score, and the PROBES best
probes over all tables together are visited. Candidates of all tables are merged and ranked by exact distance in
double precision; ties go to the smaller id.

Rows are dealt to blocks by a hash of their id, each block holding its own tables, and a stated query set meets
every block (queries by QUERY_BLOCK at a time), so that no bucket, however hot, is larger than a block, and nothing
but each block's best k of a query is shuffled. Blocks are bounded by BLOCK rows. The width w follows from a
bounded sample (SAMPLE rows), every row is indexed. Where a query finds fewer than k candidates in a block it takes
the whole block, so that each query gets k neighbours where there are as many.

Defined results: null, zero and non-finite vectors, and vectors with null components or another dimension than the
most frequent one of the sample, take no part, as queries or as candidates; equal vectors are separate rows; an
empty table gives no rows; other columns of the input are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import importable

TABLES = 12
HASHES = 8
WIDTH = 1.5  # of the typical distance to a near neighbour
PROBES = 2000
BLOCK = 8192
QUERY_BLOCK = 8192
SAMPLE = 2000


@dataclass
class Hashing:
    a: np.ndarray  # (TABLES * HASHES, dim)
    b: np.ndarray
    tables: int
    hashes: int
    key: np.ndarray  # odd multipliers, one for each function
    sets: np.ndarray  # (sets, 2 * hashes) 0/1 over ranks of boundary distances
    probes: int


def perturbations(hashes: int, most: int, size: int = 4) -> np.ndarray:
    """Perturbation sets over the 2 * hashes boundary distances in ascending rank, by expected score.

    Rank j (from 1) and 2 * hashes + 1 - j are the two sides of one function, so a set never holds both. The expected
    squared distances are those of sorted uniform distances.
    """
    m = hashes
    expected = [j * (j + 1) / (4 * (m + 1) * (m + 2)) for j in range(1, m + 1)]
    expected += [1 - (2 * m + 1 - j) / (m + 1) + (2 * m + 1 - j) * (2 * m + 2 - j) / (4 * (m + 1) * (m + 2)) for j in range(m + 1, 2 * m + 1)]
    sets = [()]
    for k in range(1, size + 1):
        sets += [c for c in combinations(range(2 * m), k) if all(2 * m - 1 - j not in c for j in c)]
    sets.sort(key=lambda c: (sum(expected[j] for j in c), c))
    out = np.zeros((min(most, len(sets)), 2 * m), dtype=np.float32)
    for i, c in enumerate(sets[:most]):
        out[i, list(c)] = 1
    return out


def hashing(dim: int, near: float, seed: int = 3, tables: int = TABLES, hashes: int = HASHES, width: float = WIDTH, probes: int = PROBES) -> Hashing:
    rng = np.random.default_rng(seed)
    w = max(near, 1e-12) * width
    n = tables * hashes
    return Hashing(rng.normal(size=(n, dim)) / w, rng.random(n), tables, hashes, rng.integers(1, 2**62, n, dtype=np.int64) * 2 + 1, perturbations(hashes, max(1, 2 * probes // tables)), probes)


def search(h: Hashing, x: np.ndarray, ids: np.ndarray, q: np.ndarray, q_ids: np.ndarray, k: int) -> list[tuple[int, int, float]]:
    """(query, neighbour, distance) of each query's k best candidates in the block x."""
    t, m = h.tables, h.hashes
    keys = h.key.reshape(t, m)
    base = np.floor(x @ h.a.T + h.b).astype(np.int64).reshape(-1, t, m)
    buckets = [(base[:, i] * keys[i]).sum(axis=1) for i in range(t)]
    orders = [np.argsort(b, kind="stable") for b in buckets]
    ordered = [b[o] for b, o in zip(buckets, orders)]
    out = []
    for lo in range(0, len(q), 256):
        qs = q[lo : lo + 256]
        p = (qs @ h.a.T + h.b).reshape(-1, t, m)
        f = np.floor(p)
        down = p - f
        sides = np.concatenate([down, 1 - down], axis=2)  # -1 first, then +1
        rank = np.argsort(sides, axis=2)
        squares = np.take_along_axis(sides, rank, axis=2) ** 2
        scores = np.einsum("qtr,sr->qts", squares, h.sets)
        step = np.concatenate([-keys, keys], axis=1)  # change of the bucket key for each side
        steps = np.take_along_axis(np.broadcast_to(step, (len(qs), t, 2 * m)), rank, axis=2)
        own = (f.astype(np.int64) * keys).sum(axis=2)
        flat = scores.reshape(len(qs), -1)
        best = np.argpartition(flat, min(h.probes, flat.shape[1]) - 1, axis=1)[:, : h.probes]
        on = h.sets.astype(bool)
        for i in range(len(qs)):
            table, which = np.divmod(best[i], len(h.sets))
            found = np.zeros(len(x), dtype=bool)
            for j in range(t):
                s = which[table == j]
                if len(s):
                    probe = np.array([own[i, j]]) + (on[s] * steps[i, j]).sum(axis=1)
                    left = np.searchsorted(ordered[j], probe, "left")
                    right = np.searchsorted(ordered[j], probe, "right")
                    for a, b in zip(left[right > left], right[right > left]):
                        found[orders[j][a:b]] = True
            found &= ids != q_ids[lo + i]
            at = np.flatnonzero(found)
            if len(at) < k:
                at = np.flatnonzero(ids != q_ids[lo + i])
            d = np.sqrt(((x[at] - qs[i]) ** 2).sum(axis=1))
            for j in np.lexsort((ids[at], d))[:k]:
                out.append((int(q_ids[lo + i]), int(ids[at[j]]), float(d[j])))
    return out


def valid(vector: Column) -> Column:
    """Whether a vector (array of float or double) takes part, apart from its dimension."""
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~bad & F.exists(vector, lambda v: v != 0), F.lit(False))


def near_distance(sample: np.ndarray, k: int) -> float:
    """The median distance of a sample's rows to their k-th neighbours inside the sample."""
    if len(sample) < 2:
        return 1.0
    some = sample[:200]
    d = np.sqrt(np.maximum((some**2).sum(1)[:, None] + (sample**2).sum(1) - 2 * some @ sample.T, 0))
    return float(np.median(np.sort(d, axis=1)[:, min(k, len(sample) - 1)])) or 1.0


def neighbours(vectors: DataFrame, is_query: Column, k: int = 10, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest found for each row that is_query marks."""
    spark = vectors.sparkSession
    importable(spark)
    rows = vectors.where(F.col(key).isNotNull() & valid(F.col(vector))).select(
        F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks")
    )
    total = rows.count()
    draw = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1_000_000))
    sample = rows.where(draw < int(1_000_000 * min(1.0, SAMPLE / max(total, 1))) + 1).select("v", "id").limit(2 * SAMPLE).collect()
    empty = "query_id bigint, rank int, vec_id bigint, score double"
    if not sample:
        return spark.createDataFrame([], empty)
    dims = [len(r["v"]) for r in sample]
    dim = max(set(dims), key=lambda d: (dims.count(d), d))
    plan = hashing(dim, near_distance(np.array([r["v"] for r in sorted(sample, key=lambda r: r["id"]) if len(r["v"]) == dim]), k))
    rows = rows.where(F.size("v") == dim)
    blocks = max(1, -(-total // BLOCK))
    asking = rows.where("asks")
    query_blocks = max(1, -(-asking.count() // QUERY_BLOCK))
    base = rows.select("id", "v", F.pmod(F.xxhash64("id", F.lit(2)), F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("part"))
    queries = asking.select("id", "v", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.pmod(F.xxhash64("id", F.lit(3)), F.lit(query_blocks)).cast("int").alias("part"))

    def block(x: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(q):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})
        found = search(plan, np.stack(x["v"].to_list()), x["id"].to_numpy(), np.stack(q["v"].to_list()), q["id"].to_numpy(), k)
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"])

    best = base.groupBy("block", "part").cogroup(queries.groupBy("block", "part")).applyInPandas(block, "query_id bigint, vec_id bigint, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
