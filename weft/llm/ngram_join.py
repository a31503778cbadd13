"""N-gram Jaccard self-join by PartEnum signatures, exact, with connected components of the links.

A document's set holds its distinct n-word shingles (64-bit hashes of lower-cased words). Two sets of sizes a and b
link if den * intersection >= num * union, that is, if their symmetric difference is at most
K = (den - num) * (a + b) / (den + num).

1. Copies collapse: rows with equal sets form a class, represented by one row; from here on classes count.
2. PartEnum. Sizes fall into bands; a set signs in its own band and in each further band that holds a size it may
   link with, so every linked pair signs together in the larger one's band. There K is at most k; the feature domain
   is dealt by hash to N1 groups of `partitions` partitions (3 by default), and each group signs with every subset of its partitions
   but SPARED. A group in which a pair differs by SPARED features at most gives it an equal signature. Of N1 =
   floor(k / (SPARED + 1)) + 1 + E groups, at least E + 1 are such groups for a linked pair.
3. Buckets of up to FULL classes are compared pair by pair, which is linear. A larger bucket is weak: its signature
   holds features that many texts share, or none. A class with at most E groups in weak buckets needs none of them,
   since one of its E + 1 groups with any partner lies in a small bucket. Only classes with more (members of large
   groups of near copies, texts made of shared passages) meet in weak buckets, and there each is compared with the
   bucket's leader alone, the member with the most company over all its buckets.
4. Whatever a weak bucket still holds in more than one component is settled by rare features. Classes near the same
   pivot (a leader) can link only if they share enough of their differences from it, others only if they share
   enough features; of those that occur in two components, rarest first, each class lists so many that linked ones
   share a listed one. Classes that share one are again compared with a leader first; features that a merged
   component has to itself fall out; the pairs left over are compared one by one. Large groups of copies merge by
   their leaders, so that pairs are left only between different texts that rare features suggest.
5. Every comparison first bounds the difference from below by sketches (parities of hashed features, folded to equal
   length: each differing bit needs a differing feature); only pairs that pass ship whole sets, for the exact count.
6. Components of the links, by alternating large and small stars.

Rows are numbered once in a written table, so that a missing or repeated key changes nothing; a component has the
name of its least key (rows without a key come last).

Defined results: null, empty or wordless texts have empty sets, link with nothing and are components of their own;
texts with fewer words than n have one shingle, the whole sequence; repeated rows are copies; rows without a key are
linked like others, and a component of such rows alone has a null name; other columns of the input are not read; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, free, small_batches, written

PARTITIONS = 3
SPARED = 1
BAND = 1.3
FULL = 8
NEAR = 3  # times the threshold's difference within which a leader serves as a pivot
LISTED = 8  # pairs for each listed feature up to which no further leaders are asked

GROUP_MASK = (1 << 18) - 1

_RNG = np.random.default_rng(0x5EED)
_BYTE = _RNG.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 2**64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_ORDER = _RNG.integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _times(k: int, i: int) -> np.uint64:
    return np.uint64(k * int(_ORDER[i]) & 2**64 - 1)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = max(n, 1 << 16, 2 * len(_POWERS[0]))
        for k, base in enumerate((_BASE, _BASE_INV)):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            _POWERS[k] = np.multiply.accumulate(p)
    return _POWERS[0], _POWERS[1]


def word_hashes(text: str | None) -> np.ndarray:
    b = _LOWER[np.frombuffer((text or "").encode("utf-8", "replace"), dtype=np.uint8)]
    if not len(b):
        return np.empty(0, dtype=np.uint64)
    blank = np.concatenate([[True], _BLANK[b], [True]])
    turn = np.flatnonzero(blank[1:] != blank[:-1])
    start, end = turn[::2], turn[1::2]
    up, down = _powers(len(b) + 1)
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(_BYTE[b] * up[: len(b)], dtype=np.uint64)])
    return _mix((sums[end] - sums[start]) * down[start])


def shingles(text: str | None, n: int = 3) -> np.ndarray:
    """Sorted distinct hashes of a text's n-word shingles."""
    h = word_hashes(text)
    if not len(h):
        return h
    m = min(n, len(h))
    x = np.zeros(len(h) - m + 1, dtype=np.uint64)
    for i in range(m):
        x += h[i : len(h) - m + 1 + i] * _ORDER[i]
    return np.unique(_mix(x + np.uint64(m)))


class Bands:
    """Bands of sizes, the groups of each, and how many of these a linked pair can do without."""

    def __init__(self, num: int, den: int, partitions: int = PARTITIONS):
        self.num, self.den, self.partitions = num, den, partitions
        self.highs = [1]
        self.subsets = list(combinations(range(partitions), partitions - SPARED))

    def band(self, size: int) -> int:
        while self.highs[-1] < size:
            low = self.highs[-1] + 1
            self.highs.append(max(low, int(low * BAND)))
        return int(np.searchsorted(self.highs, size))

    def of(self, size: int) -> range:
        """Bands in which a set of this size signs."""
        return range(self.band(size), self.band(size * self.den // self.num) + 1)

    def groups(self, band: int) -> tuple[int, int]:
        """(groups, E); no groups where only equal sets could link."""
        k = (self.den - self.num) * 2 * self.highs[band] // (self.den + self.num)
        if not k:
            return 0, 0
        need = k // (SPARED + 1) + 1
        spare = -(-need * (self.den - self.num) * 5 // (4 * self.den))
        return need + spare, spare


def signatures(s: np.ndarray, bands: Bands) -> np.ndarray:
    """Signatures (int64) of a set: hash, group number (18 bits) and band (4 bits)."""
    out = []
    weight, base = _mix(s + _ORDER[8]), _mix(s ^ _ORDER[9])
    for band in bands.of(len(s)):
        groups, _ = bands.groups(band)
        if not groups:
            continue
        sums = np.zeros(groups * bands.partitions, dtype=np.uint64)
        np.add.at(sums, (base % np.uint64(groups * bands.partitions)).astype(np.int64), weight)
        sums = _mix(sums.reshape(groups, bands.partitions) + _ORDER[10])
        number = np.arange(groups, dtype=np.uint64)
        tag = number * _ORDER[11] + np.full(groups, _times(band, 12))
        low = (number & np.uint64(GROUP_MASK)) << np.uint64(4) | np.uint64(band & 15)
        for k, subset in enumerate(bands.subsets):
            x = tag + np.full(groups, _times(k, 13))
            for i in subset:
                x = x + sums[:, i] * _ORDER[16 + i]
            out.append(_mix(x) & ~np.uint64(GROUP_MASK << 4 | 15) | low)
    return np.concatenate(out).view(np.int64) if out else np.empty(0, dtype=np.int64)


def digest(s: np.ndarray, i: int) -> int:
    """A 64-bit digest of a set."""
    return int(_mix(s + _ORDER[i]).sum(dtype=np.uint64).view(np.int64))


def sketch(s: np.ndarray) -> bytes:
    """Parities of the features' hashes modulo a power of two, at least 64 and the set's size."""
    bits = max(64, 1 << (len(s) - 1).bit_length()) if len(s) else 64
    at = (_mix(s + _ORDER[7]) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def least_difference(a: bytes, b: bytes) -> int:
    """A lower bound of the symmetric difference of two sets, from their sketches."""
    n, x, y = min(len(a), len(b)), int.from_bytes(a, "little"), int.from_bytes(b, "little")
    for wide in (len(a), len(b)):
        while wide > n:
            wide //= 2
            if len(a) > n:
                x = (x >> 8 * wide) ^ (x & (1 << 8 * wide) - 1)
            else:
                y = (y >> 8 * wide) ^ (y & (1 << 8 * wide) - 1)
    return (x ^ y).bit_count()


def _profiles(words: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for row, key, text in zip(b["row"], b["k"], b["t"]):
                s = shingles(text, words)
                rows.append((row, key, len(s), digest(s, 14), digest(s, 15), sketch(s)))
            frame = pd.DataFrame(rows, columns=["row", "k", "n", "d1", "d2", "sk"])
            yield frame.astype({"row": "int64", "k": "Int64", "n": "int64", "d1": "int64", "d2": "int64"})

    return run


def _signed(words: int, num: int, den: int, partitions: int, slice_: int, slices: int):
    """Signatures of one slice of all signatures, by bits of their hash."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bands = Bands(num, den, partitions)
        for b in batches:
            sets = [shingles(t, words) for t in b["t"]]
            sigs = [signatures(x, bands) if len(x) else x.view(np.int64) for x in sets]
            sigs = [x[(x >> 22 & 1023) % slices == slice_] for x in sigs] if slices > 1 else sigs
            if sigs:
                digests = np.array([digest(x, 14) for x in sets], dtype=np.int64)
                yield pd.DataFrame({"d1": np.repeat(digests, [len(x) for x in sigs]), "sig": np.concatenate(sigs)})

    return run


def _needy(num: int, den: int):
    """Keeps (v, band) of classes with more groups in weak buckets than a linked pair can do without."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bands = Bands(num, den)
        for b in batches:
            keep = []
            for n, low, weak in zip(b["n"], b["band"], b["weak"]):
                band = next(x for x in bands.of(n) if x & 15 == low)
                groups, spare = bands.groups(band)
                keep.append(weak > spare or groups > GROUP_MASK)
            yield b.loc[np.array(keep, dtype=bool), ["v", "band"]]

    return run


def _sets(words: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"v": b["row"], "s": [shingles(t, words).tobytes() for t in b["t"]]})

    return run


def _features(words: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sets = [shingles(t, words).view(np.int64) for t in b["t"]]
            yield pd.DataFrame({"v": b["row"], "n": [len(s) for s in sets], "es": sets})

    return run


def _differences(num: int, den: int):
    """Each set's differences from its pivot; sets beyond NEAR times the threshold's difference have no pivot."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for x, p, sx, sp in zip(b["v"], b["p"], b["s"], b["sp"]):
                u, v = np.frombuffer(sx, dtype=np.uint64), np.frombuffer(sp, dtype=np.uint64)
                es = np.setxor1d(u, v, assume_unique=True)
                most = (den - num) * (len(u) + len(v))
                if (den + num) * len(es) <= NEAR * most:
                    rows.append((x, p, len(v), (den + num) * len(es) - (den - num) * len(u), (den + num) * len(es) > most, es.view(np.int64)))
            yield pd.DataFrame(rows, columns=["v", "p", "np", "s", "far", "es"])

    return run


def _close(num: int, den: int, times: int = 1):
    """Whether two sketches (with sizes) may be of sets that differ by the threshold's difference, so many times."""

    @F.pandas_udf("boolean")
    def run(sx: pd.Series, sy: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        most = times * (den - num) * (a + b) // (den + num)
        return pd.Series([least_difference(p, q) <= k for p, q, k in zip(sx, sy, most)], dtype=bool)

    return run


def _linked(num: int, den: int):
    @F.pandas_udf("boolean")
    def run(sx: pd.Series, sy: pd.Series) -> pd.Series:
        out = []
        for p, q in zip(sx, sy):
            u, v = np.frombuffer(p, dtype=np.uint64), np.frombuffer(q, dtype=np.uint64)
            both = len(np.intersect1d(u, v, assume_unique=True))
            out.append(den * both >= num * (len(u) + len(v) - both))
        return pd.Series(out, dtype=bool)

    return run


def linked_components(edges: DataFrame) -> DataFrame:
    """edges (u, v bigint) -> (v, component): large and small stars by turns, until no smaller end has one itself."""
    now = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while not now.join(now.select(F.col("u").alias("v")), "v", "left_semi").isEmpty() or not now.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # every edge now points to a smaller end; small star: all smaller neighbours, and the node, to the smallest
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        step = large.join(small, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        after = written(step, "edges")
        dropped(now)
        now = after
    return now.select(F.col("u").alias("v"), F.col("v").alias("component"))


def _relinked(label: DataFrame, found: DataFrame) -> DataFrame:
    """The components after further links."""
    if found.isEmpty():
        return label
    after = linked_components(label.select(F.col("v").alias("u"), F.col("component").alias("v")).unionByName(found))
    dropped(label)
    return after


class _Join:
    """The join of the classes of rows (row, t): comparisons and the steps of the docstring."""

    def __init__(self, rows: DataFrame, classes: DataFrame, words: int, num: int, den: int, partitions: int):
        self.rows, self.classes, self.words, self.num, self.den, self.partitions = rows, classes, words, num, den, partitions
        # signatures grow with 1 - num / den; a slice holds about as many as a similarity of 0.9 asks for
        self.slices = max(1, -(-10 * (den - num) // den))
        self.pairs_compared = 0
        self.scratch: list[DataFrame] = []

    def texts(self, wanted: DataFrame) -> DataFrame:
        """The rows of some classes. Their numbers are written first: the planner then knows whether they are few
        enough to be sent to the texts, and shuffles texts only if they aren't."""
        self.scratch.append(written(wanted.select(F.col("v").alias("row")), "wanted"))
        return self.rows.join(self.scratch[-1], "row", "left_semi")

    def sketched(self, pairs: DataFrame, x: str, y: str) -> DataFrame:
        """pairs (a written table) with the sizes a, b and the sketches sx, sy of x and y. As with texts, the numbers of
        these classes are written first, then their sketches, so that the others are not shuffled for either side."""
        ends = written(pairs.select(F.col(x).alias("v")).unionByName(pairs.select(F.col(y).alias("v"))).distinct(), "ends")
        self.scratch.append(written(self.classes.join(ends, "v", "left_semi"), "sketches"))
        dropped(ends)
        own = self.scratch[-1]
        side = lambda v, n, s: own.select(F.col("v").alias(v), F.col("n").alias(n), F.col("sk").alias(s))
        return pairs.join(side(x, "a", "sx"), x).join(side(y, "b", "sy"), y)

    def compared(self, pairs: DataFrame) -> DataFrame:
        """The links (u, v) among pairs (x, y); exact."""
        num, den = self.num, self.den
        both = self.sketched(pairs, "x", "y")
        fits = num * F.greatest("a", "b") <= den * F.least("a", "b")
        near = written(both.where(fits).where(_close(num, den)("sx", "sy", "a", "b")).select("x", "y"), "near")
        wanted = near.select(F.col("x").alias("v")).unionByName(near.select(F.col("y").alias("v"))).distinct()
        sets = written(self.texts(wanted).mapInPandas(_sets(self.words), "v bigint, s binary"), "sets")
        whole = near.join(sets.select(F.col("v").alias("x"), F.col("s").alias("sx")), "x").join(sets.select(F.col("v").alias("y"), F.col("s").alias("sy")), "y")
        edges = written(whole.where(_linked(num, den)("sx", "sy")).select(F.col("x").alias("u"), F.col("y").alias("v")), "links")
        dropped(near, sets)
        return edges

    def _met(self, i: int) -> DataFrame:
        """(d1, sig) of the signatures of a slice that several classes share; a class goes by its digest here, so that
        every row can sign where it lies, and copies fall together. Signatures are made twice, not stored: first to see
        which are shared, then for the classes that share them."""
        signed = self.rows.mapInPandas(_signed(self.words, self.num, self.den, self.partitions, i, self.slices), "d1 bigint, sig bigint")
        ends = signed.groupBy("sig").agg(F.min("d1").alias("low"), F.max("d1").alias("high"))
        shared = written(ends.where("low < high").select("sig"), "shared")
        met = written(signed.join(shared, "sig").select("sig", "d1"), "met")
        dropped(shared)
        return met

    def components(self) -> DataFrame:
        """(v, component) of the classes that are linked to others."""
        slices = [self._met(i) for i in range(self.slices)]
        met = slices[0]
        for other in slices[1:]:
            met = met.unionByName(other)
        met = met.distinct().join(self.classes.select("d1", "v"), "d1").select("v", "sig")
        met = written(met.join(met.groupBy("sig").agg(F.count("*").alias("c")), "sig"), "met")
        dropped(*slices)
        each = met.where(F.col("c") <= FULL).groupBy("sig").agg(F.collect_list("v").alias("vs"))
        pair = "flatten(transform(vs, (a, i) -> transform(slice(vs, i + 2, size(vs)), b -> struct(greatest(a, b) AS x, least(a, b) AS y))))"
        pairs = each.select(F.explode(F.expr(pair)).alias("p")).select("p.x", "p.y").where("x <> y")
        weak = met.where(F.col("c") > FULL).select("v", "sig", F.col("sig").bitwiseAND(15).alias("band"), F.shiftright("sig", 4).bitwiseAND(GROUP_MASK).alias("g"))
        groups = weak.groupBy("v", "band").agg(F.count_distinct("g").alias("weak")).join(self.classes.select("v", "n"), "v")
        needy = groups.mapInPandas(_needy(self.num, self.den), "v bigint, band bigint")
        rest = written(weak.join(needy, ["v", "band"]).select("v", "sig"), "rest")
        company = rest.groupBy("v").agg(F.count("*").alias("company"))
        stars = written(_stars(rest.join(company, "v"), "sig").unionByName(pairs).distinct(), "pairs")
        dropped(met)
        edges = self.compared(stars)
        dropped(stars)
        label = linked_components(edges)
        dropped(edges)
        label = self._settled(rest, label)
        dropped(rest, *self.scratch)
        return label

    def _settled(self, rest: DataFrame, label: DataFrame) -> DataFrame:
        """label after the links between classes that share a weak bucket but no component yet (step 4)."""
        open_ = _labelled(rest, label).groupBy("sig").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("sig")
        several = rest.join(open_, "sig", "left_semi").select("v").distinct()
        features = written(self.texts(several).mapInPandas(_features(self.words), "v bigint, n bigint, es array<bigint>"), "features")
        pivoted = before = None
        last = False
        while not last:
            lists = self._listed_features(features, label, pivoted)
            listed = written(lists if pivoted is None else lists.unionByName(self._listed_differences(pivoted, label)), "listed")
            total = _pairs_of(listed).first()
            last = total["pairs"] <= LISTED * total["k"] or (before is not None and total["pairs"] > before / 2)
            pairs = _apart(listed) if last else _stars(_company(listed, listed).withColumn("key", F.xxhash64("p", "e")), "key", "c")
            if pivoted is not None:
                before = total["pairs"]
                pairs = pairs.unionByName(self._sure(pivoted))
            pairs = written(pairs.distinct(), "pairs")
            self.pairs_compared += pairs.count()
            found = self.compared(pairs)
            label = _relinked(label, found)
            if not last and pivoted is None:
                pivoted = self._pivoted(rest, listed, label)
            if not last:  # a class without a listed feature shares too few, and merging components leaves it no more
                able = written(features.join(listed.where("p = -1").select("v").distinct(), "v", "left_semi"), "features")
                dropped(features)
                features = able
            dropped(listed, pairs, found)
        dropped(features)
        return label

    def _pivoted(self, rest: DataFrame, listed: DataFrame, label: DataFrame) -> DataFrame:
        """(v, p, np, s, far, es): for each class near a leader, the pivot p of that leader's component, the class's
        differences es from p, s = (den + num) |es| - (den - num) n, and whether p is not linked to it. A component's
        pivot has the most company in weak buckets; of several leaders that of the largest component counts."""
        num, den = self.num, self.den
        hub = _labelled(rest.groupBy("v").agg(F.count("*").alias("company")), label).groupBy("c").agg(
            F.count("*").alias("size"), F.max(F.struct("company", (-F.col("v")).alias("w"))).alias("l")
        )
        star = _stars(_company(listed, listed), "e")
        led = star.select(F.col("x").alias("v"), F.col("y").alias("w")).unionByName(star.select(F.col("y").alias("v"), F.col("x").alias("w")))
        led = written(led.unionByName(listed.select("v", F.col("v").alias("w"))).distinct(), "led")
        near = self.sketched(led, "v", "w").where(_close(num, den, NEAR)("sx", "sy", "a", "b")).select(F.col("v").alias("own"), F.col("w").alias("v"))
        pivot = _labelled(near, label).join(hub, "c").groupBy("own").agg(F.max(F.struct("size", F.col("l.w").alias("w"))).alias("l")).select(F.col("own").alias("v"), (-F.col("l.w")).alias("p"))
        pivot = written(pivot, "pivot")
        wanted = pivot.select("v").unionByName(pivot.select(F.col("p").alias("v"))).distinct()
        sets = written(self.texts(wanted).mapInPandas(_sets(self.words), "v bigint, s binary"), "sets")
        both = pivot.join(sets, "v").join(sets.select(F.col("v").alias("p"), F.col("s").alias("sp")), "p")
        out = written(both.mapInPandas(_differences(num, den), "v bigint, p bigint, np bigint, s bigint, far boolean, es array<bigint>"), "pivoted")
        dropped(led, pivot, sets)
        return out

    def _sure(self, pivoted: DataFrame) -> DataFrame:
        """Pairs (x, y) of each class far from its pivot and the class whose closeness to the pivot leaves most room."""
        best = pivoted.groupBy("p").agg(F.min(F.struct("s", "v")).alias("b"))
        room = pivoted.where("far").join(best, "p").where(F.col("s") + F.col("b.s") <= 0)
        return room.select(F.greatest("v", "b.v").alias("x"), F.least("v", "b.v").alias("y"))

    def _listed_features(self, features: DataFrame, label: DataFrame, pivoted: DataFrame | None) -> DataFrame:
        """Listed features for pairs of different pivots (q; without a pivot a number of the class's own); p is -1.
        Components and pivots are joined to classes, of which features has a row each, not to every feature."""
        named = _labelled(features, label)
        own = -F.col("v") - 1
        named = named.withColumn("q", own) if pivoted is None else named.join(pivoted.select("v", F.col("p").alias("q")), "v", "left").withColumn("q", F.coalesce("q", own))
        often = named.select("c", "q", F.explode("es").alias("e")).groupBy("e").agg(F.count("*").alias("often"), *[g(c).alias(g.__name__ + c) for g in (F.min, F.max) for c in ("c", "q")])
        kept = features.select("v", "n", F.explode("es").alias("e")).join(often.where("minc < maxc AND minq < maxq").select("e", "often"), "e")
        mine = Window.partitionBy("v")
        kept = kept.withColumn("rank", F.row_number().over(mine.orderBy("often", "e"))).withColumn("own", F.count("*").over(mine))
        kept = kept.where(F.col("rank") <= F.col("own") - F.ceil(F.col("n") * self.num / F.lit(self.den)) + 1)
        return kept.select("v", "e").join(named.select("v", "c", "q"), "v").select(F.lit(-1).cast("bigint").alias("p"), "e", "v", "c", F.lit(True).alias("far"), F.lit(True).alias("short"), "q")

    def _listed_differences(self, pivoted: DataFrame, label: DataFrame) -> DataFrame:
        """Listed differences from the pivot for pairs of the same pivot p, of which one at least is far from it. Two
        such sets link only if they share (sx + sy) / 2 (den + num) differences; a far one has s > (den - num) np."""
        least = pivoted.groupBy("p").agg(F.min("s").alias("least"))
        rows = _labelled(pivoted.join(least, "p"), label).select("v", "p", "np", "s", "far", "least", "c", F.explode("es").alias("e"))
        often = rows.groupBy("p", "e").agg(F.count("*").alias("often"), F.min("c").alias("low"), F.max("c").alias("high"), F.max("far").alias("any"))
        kept = rows.join(often.where("low < high AND any").select("p", "e", "often"), ["p", "e"])
        mine = Window.partitionBy("v")
        kept = kept.withColumn("rank", F.row_number().over(mine.orderBy("often", "e"))).withColumn("own", F.count("*").over(mine))
        least_shared = lambda s: F.greatest(F.lit(1), F.ceil((F.col("s") + s) / F.lit(2 * (self.den + self.num))))
        short = F.col("rank") <= F.col("own") - least_shared((self.den - self.num) * F.col("np")) + 1
        long = F.col("rank") <= F.col("own") - least_shared(F.col("least")) + 1
        return kept.withColumn("short", short).where(F.col("short") | (F.col("far") & long)).select("p", "e", "v", "c", "far", "short", F.col("p").alias("q"))


def _stars(members: DataFrame, key: str, apart: str | None = None) -> DataFrame:
    """Pairs (x, y) of each member (key, v, company) and its key's leader, of different components where given."""
    order = F.struct("company", (-F.col("v")).alias("v"), *([F.col(apart)] if apart else []))
    leader = members.groupBy(key).agg(F.max(order).alias("l")).select(key, (-F.col("l.v")).alias("w"), *([F.col(f"l.{apart}").alias("cw")] if apart else []))
    both = members.join(leader, key).where("v <> w")
    both = both.where(f"{apart} <> cw") if apart else both
    return both.select(F.greatest("v", "w").alias("x"), F.least("v", "w").alias("y"))


def _company(members: DataFrame, of: DataFrame) -> DataFrame:
    """members with the number of rows that of has for v."""
    return members.join(of.groupBy("v").agg(F.count("*").alias("company")), "v")


def _pairs_of(listed: DataFrame) -> DataFrame:
    """(k, pairs): listed rows, and a bound of the pairs that share a key (p, e) but neither component nor pivot."""
    count = lambda what: listed.groupBy("p", "e", what).agg(F.count("*").alias("k")).groupBy("p", "e").agg(F.sum("k").alias("k"), F.sum(F.col("k") * F.col("k")).alias(f"own_{what}"))
    both = count("c").join(count("q").drop("k"), ["p", "e"])
    own = F.when(F.col("p") < 0, F.greatest("own_c", "own_q")).otherwise(F.col("own_c"))
    return both.agg(F.coalesce(F.sum("k"), F.lit(0)).alias("k"), F.coalesce(F.sum((F.col("k") * F.col("k") - own) / 2), F.lit(0.0)).alias("pairs"))


def _apart(listed: DataFrame) -> DataFrame:
    """The pairs (x, y) that share a key but no component and are not settled by their pivot."""
    other = listed.select("p", "e", F.col("v").alias("y"), F.col("c").alias("cy"), F.col("far").alias("fy"), F.col("short").alias("sy"), F.col("q").alias("qy"))
    once = F.col("v") > F.col("y")
    meets = F.when(F.col("p") < 0, once & (F.col("q") != F.col("qy"))).otherwise(F.col("fy") & F.when(F.col("far"), once & F.col("short") & F.col("sy")).otherwise(True))
    pairs = listed.join(other, ["p", "e"]).where(F.col("c") != F.col("cy")).where(meets)
    return pairs.select(F.greatest("v", "y").alias("x"), F.least("v", "y").alias("y"))


def _labelled(rows: DataFrame, label: DataFrame) -> DataFrame:
    """rows with the component c of v (itself where nothing is linked to it)."""
    return rows.join(label, "v", "left").withColumn("c", F.coalesce("component", "v")).drop("component")


def numbered(docs: DataFrame, row: str) -> DataFrame:
    """docs as a written table whose rows have numbers that stay."""
    return written(docs.withColumn(row, F.monotonically_increasing_id()), "rows")


def row_components(rows: DataFrame, row: str, key: str, text: str, words: int, num: int, den: int, partitions: int = PARTITIONS) -> DataFrame:
    """(row, k, n, first, name) for each row of a written table with stable row numbers: the least row of its
    component by (key, row), nulls last, and that row's key."""
    small_batches(rows.sparkSession, 256)
    rows = rows.select(F.col(row).alias("row"), F.col(key).cast("bigint").alias("k"), F.col(text).cast("string").alias("t"))
    profiles = written(rows.mapInPandas(_profiles(words), "row bigint, k bigint, n bigint, d1 bigint, d2 bigint, sk binary"), "profiles")
    order = F.struct(F.col("k").isNull().alias("none"), "k", "row")
    same = written(profiles.where("n > 0").groupBy("d1", "d2").agg(F.min(order).alias("least")).select("d1", "d2", F.col("least.row").alias("v"), "least"), "classes")
    classes = written(profiles.select(F.col("row").alias("v"), "n", "sk").join(same.select("v", "d1"), "v"), "sketches")
    label = _Join(rows.select("row", "t"), classes, words, num, den, partitions).components()
    member = _labelled(same, label)
    least = member.groupBy("c").agg(F.min("least").alias("first"))
    named = member.join(least, "c").select("d1", "d2", "first", F.lit(True).alias("set"))
    out = profiles.select("row", "k", "n", "d1", "d2").join(named, ["d1", "d2"], "left")
    some = F.col("set").isNotNull() & (F.col("n") > 0)
    out = out.select("row", "k", "n", F.when(some, F.col("first.row")).otherwise(F.col("row")).alias("first"), F.when(some, F.col("first.k")).otherwise(F.col("k")).alias("name"))
    out = written(out, "components")
    dropped(profiles, same, classes, label)
    return out


def components(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3, num: int = 90, den: int = 100, partitions: int = PARTITIONS) -> DataFrame:
    """(key, n_shingles, component_id) for each row of docs."""
    rows = numbered(docs.select(F.col(key).alias("k"), F.col(text).alias("t")), "row")
    out = row_components(rows, "row", "k", "t", words, num, den, partitions)
    dropped(rows)
    return out.select(F.col("k").alias(key), F.col("n").alias("n_shingles"), F.col("name").alias("component_id"))


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs with the first row of each component alone, of the least key; rows without a shingle stay, copies of
    them (equal in key and text) but once."""
    row = free(docs, "__weft_row")
    rows = numbered(docs, row)
    found = row_components(rows, row, key, text, words, num, den)
    blank = rows.join(found.where("n = 0").select(F.col("row").alias(row)), row, "left_semi")
    blank = blank.groupBy(key, text).agg(F.min(row).alias(row)).select(row)
    stay = found.where("n > 0 AND row = first").select(F.col("row").alias(row)).unionByName(blank)
    return rows.join(stay, row, "left_semi").select(*docs.columns)
