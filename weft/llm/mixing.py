"""Mixing sources to target weights: Sainte-Laguë apportionment of equal-token blocks.

Each source's documents are dealt to shards by a seeded hash and laid end to end inside a shard in seeded order;
the line of words is cut into equal blocks. Seats (blocks) go to sources by the highest quotients of their targets
(v / 1, v / 3, v / 5 ...), and a source's seats to its shards in the same way by the shards' words, which gives an
integer quota for each shard. A quota of q among n blocks takes every block q div n times and q mod n further
blocks, chosen by a seeded permutation of block numbers. What the mix takes of a document is what the chosen
blocks cover of it, repeats counted.

Only sizes move: the text is read once to count words, and windows, quotas and joins work on (key, source, size).
Shards are bounded: a source has more shards the more words it has (a hot source is split), SHARD_WORDS words each,
and there are SHARDS shards at most beside one for each source, so that the table of quotas on the driver is
bounded by SHARDS plus the number of sources.

Defined results: null texts have size 0; null sources form a source of their own, last in order; documents of size
0 and sources without words take nothing; repeated rows are separate documents; an empty table gives no rows.
Reruns agree, as every order and choice is a function of seed, doc_id and size.
"""

from __future__ import annotations

import heapq
import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, local_rows, written

PATTERN = (3, 1, 2)
SHARE = Fraction(3, 2)
CAP = 2
BLOCK_WORDS = 256
SHARD_WORDS = 1 << 20
SHARDS = 20_000
SEED = 5


def words(text: Column) -> Column:
    """Words of a text, JVM-side."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sizes: list[int], weights: list[int], share: Fraction = SHARE, cap: int = CAP) -> list[float]:
    """Targets by weight of share times all words; what exceeds cap times a source's size is shared out again."""
    left, free, out = share * sum(sizes), set(range(len(sizes))), [Fraction(0)] * len(sizes)
    while free:
        unit = left / sum(weights[i] for i in free)
        over = [i for i in free if unit * weights[i] > cap * sizes[i]]
        if not over:
            for i in free:
                out[i] = unit * weights[i]
            break
        for i in over:
            out[i] = Fraction(cap * sizes[i])
            left -= out[i]
            free.discard(i)
    return [float(x) for x in out]


def apportioned(votes: list[float], seats: int, most: list[int]) -> list[int]:
    """Sainte-Laguë: seats by highest quotients votes / (2 s + 1), no party above its limit; ties to the first.

    Starts from rounded proportional seats, which the divisor method allows, and mends by single quotients.
    """
    total = math.fsum(votes)
    seats = min(seats, sum(m for v, m in zip(votes, most) if v > 0))
    if total <= 0 or seats <= 0:
        return [0] * len(votes)
    out = [min(m, int(v * seats / total + 0.5)) for v, m in zip(votes, most)]
    left = seats - sum(out)
    if left > 0:
        heap = [(-v / (2 * s + 1), i) for i, (v, s) in enumerate(zip(votes, out)) if v > 0 and s < most[i]]
        heapq.heapify(heap)
        while left and heap:
            _, i = heapq.heappop(heap)
            out[i] += 1
            left -= 1
            if out[i] < most[i]:
                heapq.heappush(heap, (-votes[i] / (2 * out[i] + 1), i))
    elif left < 0:
        heap = [(v / (2 * s - 1), -i) for i, (v, s) in enumerate(zip(votes, out)) if s > 0]
        heapq.heapify(heap)
        while left and heap:
            _, i = heapq.heappop(heap)
            i = -i
            out[i] -= 1
            left += 1
            if out[i] > 0:
                heapq.heappush(heap, (votes[i] / (2 * out[i] - 1), -i))
    return out


def _step(n: int, seed: int) -> int:
    """A stride that visits all of n blocks, near the golden section of n."""
    a = max(1, int(n * 0.6180339887) + seed % 7)
    while math.gcd(a, n) != 1:
        a += 1
    return a % n or 1


def mixed(sized: DataFrame, key: str = "doc_id", pattern: tuple[int, ...] = PATTERN, share: Fraction = SHARE, cap: int = CAP, seed: int = SEED) -> DataFrame:
    """sized (key, source, size) -> (key, source, size, source_size, target, taken)."""
    spark = sized.sparkSession
    sized = written(sized.select(F.col(key).alias("k"), F.col("source").cast("string").alias("source"), F.col("size").cast("bigint").alias("size")), "sizes")
    sources = sorted(((r["source"], r["words"]) for r in sized.groupBy("source").agg(F.sum("size").alias("words")).collect()), key=lambda x: (x[0] is None, x[0] or ""))
    sizes = [n for _, n in sources]
    total = sum(sizes)
    goals = targets(sizes, [pattern[i % len(pattern)] for i in range(len(sources))], share, cap)
    shard_words = max(SHARD_WORDS, -(-total // SHARDS))
    per_source = local_rows(
        spark,
        [(i, s, n, t, max(1, -(-n // shard_words))) for i, ((s, n), t) in enumerate(zip(sources, goals))],
        "no int, source_ string, source_size bigint, target double, shards int",
    )
    draw = F.xxhash64(F.col("k").cast("string"), F.lit(seed))
    placed = sized.join(per_source, F.col("source").eqNullSafe(F.col("source_"))).select(
        "k", "source", "size", "source_size", "target", "no", F.pmod(F.xxhash64(draw, F.lit(1)), F.col("shards")).cast("int").alias("shard"), draw.alias("draw")
    )
    lines = sorted((r["no"], r["shard"], r["line"]) for r in placed.groupBy("no", "shard").agg(F.sum("size").alias("line")).collect())

    own: dict[int, list[tuple[int, int, int]]] = {}
    for no, shard, line in lines:
        own.setdefault(no, []).append((shard, line, max(1, round(line / BLOCK_WORDS)) if line else 0))
    most = [cap * sum(n for *_, n in own.get(i, [])) for i in range(len(sources))]
    seats = apportioned(goals, round(math.fsum(goals) / BLOCK_WORDS), most)
    quotas = []
    for no, parts in own.items():
        each = apportioned([float(line) for _, line, _ in parts], seats[no], [cap * n for *_, n in parts])
        quotas += [(no, shard, line, n, q // n if n else 0, q % n if n else 0, _step(n, seed + shard) if n else 1, (seed * 7919 + shard * 104_729) % n if n else 0) for (shard, line, n), q in zip(parts, each)]
    quota = local_rows(spark, quotas, "no int, shard int, line bigint, blocks bigint, every bigint, further bigint, stride bigint, shift bigint")

    at = Window.partitionBy("no", "shard").orderBy("draw", "k", "size").rowsBetween(Window.unboundedPreceding, -1)
    run = placed.withColumn("start", F.coalesce(F.sum("size").over(at), F.lit(0))).join(quota, ["no", "shard"])
    start, end, line, blocks = F.col("start"), F.col("start") + F.col("size"), F.col("line"), F.col("blocks")

    def block_of(word: Column) -> Column:
        return F.ceil((word + 1) * blocks / line).cast("bigint") - 1

    def edge(j: Column) -> Column:
        return F.floor(j * line / blocks).cast("bigint")

    def covered(acc: Column, j: Column) -> Column:
        times = F.col("every") + F.when(F.pmod(j * F.col("stride") + F.col("shift"), blocks) < F.col("further"), 1).otherwise(0)
        inside = F.least(end, edge(j + 1)) - F.greatest(start, edge(j))
        return acc + F.greatest(inside, F.lit(0)) * times

    first, last = F.greatest(block_of(start) - 1, F.lit(0)), F.least(block_of(end - 1) + 1, blocks - 1)
    taken = F.when(F.col("size") == 0, F.lit(0)).otherwise(F.aggregate(F.sequence(first, last), F.lit(0).cast("bigint"), covered))
    return run.select(F.col("k").alias(key), "source", "size", "source_size", "target", taken.cast("bigint").alias("taken"))


def copies(seed: int = SEED, key: str = "doc_id") -> Column:
    """Whole copies of a document for its `taken` of `size` words: rounded up or down by a seeded draw on the key, so
    that the copies of a source add up to its taken words on average; 2 at most where taken is 2 times size at most."""
    draw = F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(seed), F.lit(2)), F.lit(1_000_000)) / 1_000_000
    return F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + draw)).otherwise(0).cast("int")
