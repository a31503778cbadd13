"""Toxicity: cumulative-link ordinal regression on sparse text features.

Severity has GRADES ordered grades. P(grade > j | x) = sigmoid(w x - theta_j) with one weight vector w for all
thresholds theta_1 < theta_2 < ..., so that evidence moves a text along one scale; the expected severity is the sum
of these probabilities over j. Features are sparse: for each word or word beginning (PREFIXES characters, which meets
inflected forms) of the learned vocabulary, the logarithm of one plus its count, and the same of the number of words that
hold any and of their rate (in hundredths). All features are evidence for severity, so weights are kept at 0 or more.

Labels say toxic or not; grades above 0 are set from the number of such words in a toxic text (terciles of
the training sample), which is what severity means here: the labels hold no
severity of their own, so the grades above 0 order toxic texts by the amount of evidence that the features count too. The vocabulary holds the words whose share among toxic
texts exceeds that among others by most (a smoothed log odds of MIN_ODDS at least, in MIN_SHARE of the toxic texts at least).
Training takes a bounded sample (SAMPLE_ROWS rows of each label, texts of up to TRAIN_CHARS characters) to the
driver; prediction reads whole texts. The flag's threshold is the middle between both labels' expected severities on
rows left out of training, at the least error.

Defined results: null texts, and texts without words, have the severity of a text without evidence and are never
flagged; without labelled rows of both kinds nothing is flagged; repeated rows get equal results; other columns,
whatever their names, are carried along (the result is one struct column).
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import local_rows

GRADES = 4
SAMPLE_ROWS = 2500
TRAIN_CHARS = 30_000
MIN_SHARE = 0.01
MIN_RATIO = 30.0
PREFIXES = (4, 5, 6, 7)
MEMO = 200_000
MIN_ODDS = 2.5
VOCABULARY = 1024
STEPS = 400

_BREAK = str.maketrans({c: " " for c in "\t\n\x0b\x0c\r.,;:!?\"'()[]{}<>#*$%&|/\\+=-_`~^@"})


def words(text: str | None) -> list[str]:
    return (text or "").lower().translate(_BREAK).split()


def features(word: str) -> list[str]:
    return [word, *(f"{word[:k]}*" for k in PREFIXES if len(word) > k)]


def _ratio(a: int, n1: int, b: int, n0: int) -> float:
    """Likelihood ratio of a among n1 and b among n0 against equal shares."""
    p = (a + b) / (n1 + n0)
    return 2 * sum(k * math.log(k / (n * p)) for k, n in ((a, n1), (b, n0), (n1 - a, n1 * (1 - p) / p), (n0 - b, n0 * (1 - p) / p)) if k > 0)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Model:
    vocabulary: dict[str, int]
    weights: np.ndarray  # one for each feature, the last two for number and rate
    thresholds: np.ndarray
    cut: float

    def __post_init__(self):
        self.memo: dict[str, tuple[int, ...]] = {}

    def numbers(self, word: str) -> tuple[int, ...]:
        if len(self.memo) >= MEMO:
            self.memo.clear()
        get = self.vocabulary.get
        known = self.memo[word] = tuple(i for f in features(word) if (i := get(f)) is not None)
        return known

    def hits(self, ws: list[str]) -> tuple[Counter, int]:
        """Counts by feature, and how many words hold any."""
        known, numbers = self.memo.get, self.numbers
        held = [x for w in ws if (x := numbers(w) if (y := known(w)) is None else y)]
        return Counter(i for x in held for i in x), len(held)

    def evidence(self, text: str | None) -> tuple[float, int]:
        ws = words(text)
        hits, n = self.hits(ws)
        if not n:
            return 0.0, 0
        z = sum(self.weights[i] * math.log1p(c) for i, c in hits.items())
        return float(z + self.weights[-2] * math.log1p(n) + self.weights[-1] * math.log1p(100 * n / len(ws))), n

    def predict(self, text: str | None) -> tuple[float, int, bool, int]:
        """Expected severity, most likely grade, flag, evidence words."""
        z, n = self.evidence(text)
        above = _sigmoid(z - self.thresholds)
        p = np.append(1.0, above) - np.append(above, 0.0)
        severity = float(above.sum())
        return severity, int(p.argmax()), bool(n > 0 and severity >= self.cut), n


def _fit_ordinal(x: np.ndarray, y: np.ndarray, l2: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Maximum likelihood of the cumulative-link model by Adam on all rows; thresholds kept in order by steps > 0."""
    n, m = x.shape
    k = GRADES - 1
    w, first, gaps = np.zeros(m), np.array([0.5]), np.zeros(k - 1)
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in (w, first, gaps)]
    share = np.bincount(y, minlength=GRADES) / n
    weight = (1 / np.maximum(share, 1e-3))[y]
    weight /= weight.mean()
    rows = np.arange(n)
    for t in range(1, STEPS + 1):
        theta = np.concatenate([first, first + np.cumsum(np.exp(gaps))])
        z = x @ w
        s = _sigmoid(z[:, None] - theta)
        up = np.hstack([np.ones((n, 1)), s])
        low = np.hstack([s, np.zeros((n, 1))])
        p = np.maximum(up[rows, y] - low[rows, y], 1e-9)
        d = np.hstack([np.zeros((n, 1)), s * (1 - s), np.zeros((n, 1))])
        dz = -(d[rows, y] - d[rows, y + 1]) / p * weight / n
        dtheta = np.zeros(k)
        for j in range(k):
            g = d[:, j + 1] / p * weight / n
            dtheta[j] = (g * (y == j + 1)).sum() - (g * (y == j)).sum()
        dfirst = np.array([dtheta.sum()])
        dgaps = np.array([dtheta[j + 1 :].sum() for j in range(k - 1)]) * np.exp(gaps)
        for q, g, (m1, m2) in zip((w, first, gaps), (x.T @ dz + l2 * w, dfirst, dgaps), state):
            m1 *= 0.9
            m1 += 0.1 * g
            m2 *= 0.999
            m2 += 0.001 * g * g
            q -= 0.05 * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-8)
        np.maximum(w, 0, out=w)
    return w, np.concatenate([first, first + np.cumsum(np.exp(gaps))])


def fit(rows: list[tuple[int, str]]) -> Model:
    """rows: (toxic 0 or 1, text)."""
    nothing = Model({}, np.zeros(2), np.arange(1.0, GRADES), float("inf"))
    docs = [(y, words(t)) for y, t in rows]
    held = [d for i, d in enumerate(docs) if i % 5 == 2]
    train = [d for i, d in enumerate(docs) if i % 5 != 2]
    n1 = sum(y for y, _ in train)
    n0 = len(train) - n1
    if not n0 or not n1:
        return nothing
    df = [Counter(), Counter()]
    for y, ws in train:
        df[y].update({f for w in set(ws) for f in features(w)})
    odds = {w: math.log((c + 0.5) / (n1 + 1)) - math.log((df[0][w] + 0.5) / (n0 + 1)) for w, c in df[1].items() if c >= max(4, MIN_SHARE * n1)}  # others are too rare to learn from
    top = sorted((w for w, o in odds.items() if o >= MIN_ODDS and _ratio(df[1][w], n1, df[0][w], n0) >= MIN_RATIO), key=lambda w: (-odds[w] * df[1][w], w))[:VOCABULARY]
    if not top:
        return nothing
    vocabulary = {w: i for i, w in enumerate(top)}
    x = np.zeros((len(train), len(top) + 2))
    found = np.zeros(len(train))
    sparse = Model(vocabulary, np.zeros(1), np.zeros(1), 0.0)
    for r, (_, ws) in enumerate(train):
        hits, n = sparse.hits(ws)
        for i, c in hits.items():
            x[r, i] = math.log1p(c)
        found[r] = n
        x[r, -2], x[r, -1] = math.log1p(n), math.log1p(100 * n / max(1, len(ws)))
    y1 = np.array([y for y, _ in train])
    cuts = np.quantile(found[y1 == 1], [i / (GRADES - 1) for i in range(1, GRADES - 1)])
    grades = np.where(y1 == 1, 1 + np.searchsorted(cuts, found, side="right"), 0)
    w, theta = _fit_ordinal(x, grades)
    model = Model(vocabulary, w, theta, 0.5)
    kept = sorted((model.predict(" ".join(ws))[0], y) for y, ws in held)
    if kept:
        bad = sum(1 for _, y in kept if y == 0)
        best, at, edge = bad, 0, None
        for i, (s, y) in enumerate(kept):  # flag all from i + 1 on
            bad += 1 if y else -1
            if bad < best:
                best, at, edge = bad, i + 1, i
        if edge is not None and at < len(kept):
            model.cut = (kept[edge][0] + kept[at][0]) / 2
    return model


def training_rows(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> list[tuple[int, str]]:
    """The bounded sample: labelled keys chosen by hash, as many of each label as SAMPLE_ROWS says, then their texts.
    Only keys and labels are shuffled; the chosen keys are few, and the planner sees that."""
    marked = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(label).cast("int").alias("y"))
    marked = marked.groupBy("k").agg(F.max("y").alias("y"))
    counts = {r["y"]: r["count"] for r in marked.groupBy("y").count().collect()}
    draw = F.pmod(F.xxhash64(F.col("k").cast("string"), F.lit(23)), F.lit(1_000_000))
    share = F.lit(0)
    for y, n in counts.items():
        share = F.when(F.col("y") == y, int(1_000_000 * min(1.0, SAMPLE_ROWS / n)) + 1).otherwise(share)
    keys = marked.where(draw < share).select(F.col("k").cast("string").alias("k"), "y", draw.alias("d")).limit(4 * SAMPLE_ROWS).collect()
    chosen = local_rows(documents.sparkSession, [tuple(r) for r in keys], "k string, y int, d bigint")
    texts = documents.where(F.col(text).isNotNull() & (F.length(text) <= TRAIN_CHARS)).select(F.col(key).cast("string").alias("k"), F.col(text).alias("t"))
    picked = texts.join(chosen, "k").limit(4 * SAMPLE_ROWS).select("y", "t", "d", "k").collect()
    return [(r["y"], r["t"]) for r in sorted(picked, key=lambda r: (r["d"], r["k"], r["t"]))]


def graded(text: Column, model: Model) -> Column:
    """Struct column (severity double, grade int, toxic boolean, n_evidence bigint) for a text column."""

    @F.pandas_udf("severity double, grade int, toxic boolean, n_evidence bigint")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([model.predict(t) for t in texts], columns=["severity", "grade", "toxic", "n_evidence"])

    return run(text)
