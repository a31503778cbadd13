"""The operators over whole tables: joins, neighbours, mixing, pipeline; against brute force."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from weft.llm import mixing, nearest, ngram_join

SF = "/root/testdata/sf0.001"


def brute(rows, n=3, num=90, den=100):
    sets = {}
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        sets[d] = frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by = defaultdict(list)
    for d in sorted(sets):
        common = Counter(x for e in sets[d] for x in by[e])
        for e in sets[d]:
            by[e].append(d)
        for x, i in common.items():
            if den * i >= num * (len(sets[d]) + len(sets[x]) - i):
                a, b = find(d), find(x)
                root[max(a, b)] = min(a, b)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def near_copies(seed):
    r = random.Random(seed)
    words, rows, k = [f"w{i}" for i in range(2000)], [], 0
    for _ in range(8):
        base = [r.choice(words) for _ in range(r.choice([9, 12, 25, 60, 120]))]
        for _ in range(r.choice([1, 4, 40, 90])):
            x = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 3, 4, 5])):
                i = r.randrange(len(x))
                if r.random() < 0.4 and len(x) > 3:
                    del x[i]
                elif r.random() < 0.5:
                    x.insert(i, r.choice(words[:20]))
                else:
                    x[i] = r.choice(words[:4] if r.random() < 0.5 else words)
            rows.append((k, " ".join(x)))
            k += 1
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_ngram_join_is_exact(spark, seed):
    rows = near_copies(seed)
    out = ngram_join.components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r[0]: (r[1], r[2]) for r in out.collect()} == brute(rows)


def test_ngram_join_with_other_parameters_and_odd_rows(spark):
    rows = near_copies(3) + [(9001, None), (9002, ""), (9003, "A b"), (9004, "a  B"), (9005, "a")]
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, n int".replace("int", "string"))
    out = ngram_join.components(df, words=5, num=80, den=100, partitions=2)
    assert {r[0]: (r[1], r[2]) for r in out.collect()} == brute(rows, 5, 80)
    twice = df.where("doc_id > 9000").unionByName(df.where("doc_id > 9000"))
    assert ngram_join.components(twice).count() == 10
    assert ngram_join.components(df.where("false")).count() == 0


def test_nearest_recall_and_distances(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 24)).astype(np.float32)
    x[7] = x[3]
    rows = [(i, [float(v) for v in x[i]], "t") for i in range(len(x))] + [(5000, None, "t"), (5001, [0.0] * 24, "t"), (5002, [float("nan")] * 24, "t"), (5100, [1.0, None] + [0.0] * 22, "t")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, id string")
    out = nearest.neighbours(df, F.col("vec_id") % 50 == 0).collect()
    got = defaultdict(list)
    for r in out:
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    hits = 0
    for q in range(0, 1500, 50):
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        d[q] = np.inf
        true = set(np.lexsort((np.arange(len(x)), d))[:10])
        ranks = sorted(got[q])
        assert [r for r, *_ in ranks] == list(range(1, 11))
        assert all(math.isclose(s, d[v], rel_tol=1e-12) for _, v, s in ranks) and [s for *_, s in ranks] == sorted(s for *_, s in ranks)
        hits += len(true & {v for _, v, _ in ranks})
    assert hits >= 0.9 * 10 * 30 and 5000 not in got and 5100 not in got


def test_nearest_with_few_or_no_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (100, [1.0, 0.0])], "vec_id long, embedding array<double>")
    out = sorted((r["query_id"], r["rank"], r["vec_id"]) for r in nearest.neighbours(df, F.col("vec_id") % 100 == 0).collect())
    assert out == [(0, 1, 100), (0, 2, 1), (100, 1, 0), (100, 2, 1)]
    assert nearest.neighbours(df.where("false"), F.lit(True)).count() == 0


def test_apportionment_is_highest_quotients():
    r = random.Random(2)
    for _ in range(200):
        votes = [r.randrange(0, 500) / 7 for _ in range(r.randrange(1, 8))]
        most = [r.randrange(0, 30) for _ in votes]
        seats, want = r.randrange(0, 60), [0] * len(votes)
        for _ in range(seats):
            best = [(votes[i] / (2 * want[i] + 1), -i) for i in range(len(votes)) if votes[i] > 0 and want[i] < most[i]]
            if not best:
                break
            want[-max(best)[1]] += 1
        got = mixing.apportioned(votes, seats, most)
        assert sum(got) == sum(want) and all(g <= m for g, m in zip(got, most))
        quotient = lambda s: sorted(round(v / (2 * k + 1), 9) for v, n in zip(votes, s) for k in range(n))
        assert quotient(got) == quotient(want)


def test_targets_stop_at_twice_the_size():
    assert mixing.targets([100, 100], [3, 1]) == [200.0, 100.0]
    assert mixing.targets([0, 0], [3, 1]) == [0.0, 0.0]
    t = mixing.targets([10, 50, 400], [3, 1, 2])
    assert t[0] == 20 and abs(sum(t) - 690) < 1e-9 and t[1] == 100


def test_mix_keeps_its_promises(spark):
    rows = [(i, f"s{i % 5}" if i % 7 else None, (i * 37) % 900) for i in range(3000)] + [(1, "s1", 50), (1, "s1", 50), (9999, "empty", 0)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long")
    out = mixing.mixed(df).collect()
    assert len(out) == len(rows) and all(0 <= r["taken"] <= 2 * r["size"] for r in out)
    by = defaultdict(lambda: [0, 0.0])
    for r in out:
        by[r["source"]][0] += r["taken"]
        by[r["source"]][1] = r["target"]
    assert all(abs(a - t) <= max(600, 0.02 * t) for a, t in by.values())
    again = mixing.mixed(df.repartition(3)).collect()
    assert sorted(map(tuple, ((r["doc_id"], r["size"], r["taken"]) for r in out))) == sorted((r["doc_id"], r["size"], r["taken"]) for r in again)
    assert mixing.mixed(df.where("false")).count() == 0


def test_small_sources_beside_a_very_large_one(spark):
    big = spark.range(500).select(F.col("id").alias("doc_id"), F.lit("big").alias("source"), F.lit(5_000_000).cast("long").alias("size"))
    small = spark.createDataFrame([(1000 + i, s, 100) for s, n in (("small", 10), ("small2", 15)) for i in range(n)], "doc_id long, source string, size long")
    out = mixing.mixed(big.unionByName(small)).groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target")).collect()
    got = {r["source"]: (r["taken"], r["target"]) for r in out}
    assert got["small"][1] == 2000 and got["small2"][1] == 3000
    assert all(abs(taken - target) <= max(mixing.BLOCK_WORDS, 1e-3 * target) for taken, target in got.values())


def test_pipeline_stages(spark):
    import corpus_pipeline as p

    docs = p.table(spark, SF, "documents")
    columns = docs.columns
    for name, stage in p.STAGES:
        before = docs
        docs = p.written(stage(spark, docs, SF), f"test-{name}")
        if name != "byte_bpe":
            assert docs.columns == columns
        if name == "near_duplicates":
            groups = brute([(r["doc_id"], r["text"]) for r in before.collect()], 5, 80)
            assert {r["doc_id"] for r in docs.collect()} == {c for _, c in groups.values()}
        if name == "language_id":
            assert docs.count() >= 0.98 * before.count()
        if name == "mixing":
            assert max(r["count"] for r in docs.groupBy("doc_id").count().collect()) <= 2
    assert docs.where("NOT decodes").count() == 0 and docs.count() > 0


def test_near_duplicates_with_repeated_and_missing_ids(spark):
    import corpus_pipeline as p

    line = lambda name, n=30: " ".join(f"{name}{i}" for i in range(n))
    near = lambda name: line(name) + " end"
    rows = [(1, line("a")), (2, line("a")), (2, line("b")), (2, line("b")), (3, line("c")), (3, line("d", 60)), (4, near("c"))]
    rows += [(None, near("d")), (None, line("e")), (None, near("e")), (5, ""), (5, "")]
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, source string")
    got = [(r["doc_id"], r["text"]) for r in p.drop_near_duplicates(spark, df, SF).select("doc_id", "text").collect()]
    fixed = [(1, line("a")), (2, line("b")), (3, line("c")), (3, line("d", 60)), (5, ""), (None, near("d"))]
    rest = Counter(got) - Counter(fixed)
    assert not Counter(fixed) - Counter(got)
    assert len(rest) == 1 and set(rest) < {(None, line("e")), (None, near("e"))} and sum(rest.values()) == 1


@pytest.mark.parametrize("full", [2, 8])
def test_ngram_join_in_weak_buckets_is_exact(spark, monkeypatch, full):
    monkeypatch.setattr(ngram_join, "FULL", full)
    monkeypatch.setattr(ngram_join, "LISTED", 0)
    rows = near_copies(6) + near_copies(7)
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    out = ngram_join.components(spark.createDataFrame(rows, "doc_id long, text string"), words=4, num=80)
    assert {r[0]: (r[1], r[2]) for r in out.collect()} == brute(rows, 4, 80)


def test_ngram_join_compares_few_pairs_of_a_large_group(spark, monkeypatch):
    """3 m near copies of a text and m of an edited one: the pairs compared grow as the group, not as its square."""
    r, counts = random.Random(11), {}
    words = [f"w{i}" for i in range(400)]
    base = [r.choice(words) for _ in range(200)]
    edited = base[:90] + [f"p{i}" for i in range(16)] + base[106:]
    compared = ngram_join._Join.compared
    for m in (40, 160):
        rows = []
        for k in range(4 * m):
            x = list(edited if k % 4 == 0 else base)
            for _ in range(r.randrange(4)):
                x[r.randrange(len(x))] = f"e{r.randrange(10**6)}"
            rows.append((k, " ".join(x)))
        counts[m] = 0

        def counted(self, pairs, m=m):
            counts[m] += pairs.count()
            return compared(self, pairs)

        monkeypatch.setattr(ngram_join._Join, "compared", counted)
        out = ngram_join.components(spark.createDataFrame(rows, "doc_id long, text string"), words=5, num=80)
        assert {x[0]: (x[1], x[2]) for x in out.collect()} == brute(rows, 5, 80)
    assert counts[160] <= 8 * counts[40]


def test_ngram_join_labels_classes_not_their_features(spark, monkeypatch):
    """Each round joins components to a row for each class, and sketches only for the classes that it compares."""
    monkeypatch.setattr(ngram_join, "FULL", 2)
    monkeypatch.setattr(ngram_join, "LISTED", 0)
    rows = [(i, t) for i, (_, t) in enumerate(near_copies(6))]
    labelled, close, joined, sides = ngram_join._labelled, ngram_join._Join.sketched, [], []

    def counted(some, label):
        if "n" in some.columns:
            joined.append(some.count())
        return labelled(some, label)

    def watched(self, pairs, x, y):
        out = close(self, pairs, x, y)
        sides.append((self.scratch[-1].count(), pairs.select(F.explode(F.array(x, y))).distinct().count()))
        return out

    monkeypatch.setattr(ngram_join, "_labelled", counted)
    monkeypatch.setattr(ngram_join._Join, "sketched", watched)
    out = ngram_join.components(spark.createDataFrame(rows, "doc_id long, text string"), words=4, num=80)
    assert {r[0]: (r[1], r[2]) for r in out.collect()} == brute(rows, 4, 80)
    assert len(joined) > 1 and all(0 < n <= len(rows) for n in joined)
    assert sides and all(a == b for a, b in sides)


def test_ngram_join_with_clashing_names_and_missing_keys(spark):
    line = " ".join(f"a{i}" for i in range(40))
    rows = [(3, line, 1, 2), (1, line + " z", 1, 2), (None, line, 1, 2), (None, "only one", 1, 2), (7, None, 1, 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, k int, row int")
    out = sorted(((r["doc_id"], r["component_id"]) for r in ngram_join.components(df, words=5, num=80).collect()), key=str)
    assert out == sorted([(3, 1), (1, 1), (None, 1), (None, None), (7, 7)], key=str)


def test_mixing_ignores_clashing_names_and_spans_blocks(spark):
    rows = [(1, "a", 100_000, 9, 9), (2, "a", 0, 9, 9), (3, "a", 7, 9, 9), (3, "a", 7, 9, 9), (4, None, 500, 9, 9)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long, target long, shard long")
    out = mixing.mixed(df).collect()
    assert len(out) == 5 and all(0 <= r["taken"] <= 2 * r["size"] for r in out)
    by = {r["source"]: (sum(x["taken"] for x in out if x["source"] == r["source"]), r["target"]) for r in out}
    assert all(abs(t - goal) <= mixing.BLOCK_WORDS for t, goal in by.values())


def test_pipeline_stages_on_odd_rows(spark):
    import corpus_pipeline as p

    prose = "the members of the committee have written to the people of the city about this and that " * 3
    secret = "db_password = \"k3jH8sPq0ZxW7vNd5TbYr2Lm\" and then some more words of the letter"
    rows = [(1, prose, "en", "a", 1), (1, prose, "en", "a", 1), (2, None, "en", "a", 0), (3, "", "en", None, 0), (None, prose + secret, "en", "b", 5), (None, " ".join(f"x{i}" for i in range(90)), None, "b", 5)]
    rows += [(10, "word " * 60_000, "en", "c", 1)]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, __weft_row string")
    for name, stage in p.STAGES:
        out = stage(spark, df, SF)
        got = out.collect()
        if name != "byte_bpe":
            assert out.columns == df.columns and all(r["__weft_row"] == "extra" for r in got)
        if name == "near_duplicates":
            assert Counter(r["doc_id"] for r in got) == Counter([1, 2, 3, None, None, 10])
        if name == "secret_scan":
            assert len(got) == len(rows) and not any("k3jH8sPq" in (r["text"] or "") for r in got)
            assert sum("[SECRET]" in (r["text"] or "") for r in got) == 1
        if name == "mixing":
            taken = Counter((r["doc_id"], r["text"]) for r in got)
            assert all(n <= 4 for n in taken.values()) and not any(k[1] in (None, "") for k in taken)
        if name == "byte_bpe":
            assert len(got) == len(rows) and all(r["decodes"] for r in got)
        stage(spark, df.where("false"), SF).collect()
