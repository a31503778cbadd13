"""Language identification: averaged hashed subword embeddings under a linear softmax, trained by SGD in numpy.

A text is lower-cased, every run of non-letters (ASCII) becomes one space, and byte n-grams of 2 to 4 bytes, the
spaces as word ends among them, are hashed into a table of embeddings. Their average goes through a linear layer.
Training takes a bounded sample of labelled rows (SAMPLE_PER_LANGUAGE rows of each language, at most
SAMPLE_ROWS altogether, texts of up to TRAIN_CHARS characters) to the driver; prediction reads whole texts. As the
layer is linear, embeddings times layer are folded into one score table, which is all that executors receive.

Rejection is calibrated on rows left out of training: a temperature fits the probabilities there, and the
rejection threshold is set so that FALSE_REJECTS of their correctly recognised rows fall below it (0.5 at most).

Defined results: null texts and texts without a letter are `und` with score 0 and rejected; without any labelled
row every text is `und`; ties go to the smaller language code; repeated rows get equal results; other columns,
whatever their names, are carried along (the result is one struct column).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import local_rows

BUCKETS = 1 << 15
DIM = 16
SAMPLE_PER_LANGUAGE = 1200
SAMPLE_ROWS = 12_000
TRAIN_CHARS = 20_000
SNIPPET = 96
STEPS = 500
BATCH = 128
FALSE_REJECTS = 0.0005
UNKNOWN = "und"

_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[[b for b in range(128) if not chr(b).isalpha()]] = 32
_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F], dtype=np.uint32)


def grams(text: str) -> np.ndarray:
    """Hashed n-grams of the whole text, orders 2 to 4, in one array (empty for a text without letters)."""
    b = _CLASS[np.frombuffer(f" {text.lower()} ".encode("utf-8", "replace"), dtype=np.uint8)]
    space = b == 32
    b = b[np.append(~(space[:-1] & space[1:]), True)].astype(np.uint32)
    if len(b) < 3:
        return np.empty(0, dtype=np.int32)
    out = []
    h = b[:-1] * _MULTIPLIERS[0] ^ b[1:] * _MULTIPLIERS[1]
    for n in (2, 3, 4):
        if n > 2:
            if len(b) < n:
                break
            h = h[: len(b) - n + 1] ^ b[n - 1 :] * _MULTIPLIERS[n - 1]
        x = (h ^ np.uint32(n * 0x5BD1E995 & 0xFFFFFFFF)) * np.uint32(0x2545F491)
        out.append((x >> np.uint32(17)).astype(np.int32))
    return np.concatenate(out)


@dataclass
class Model:
    languages: list[str]
    scores: np.ndarray  # (BUCKETS, languages)
    bias: np.ndarray
    temperature: float
    threshold: float

    def probabilities(self, text: str | None) -> np.ndarray | None:
        """Calibrated probabilities of the languages; None for a null text or one without a letter."""
        if text is None or not self.languages or not any(map(str.isalpha, text)):
            return None
        g = grams(text)
        z = (self.scores.take(g, axis=0).mean(axis=0) if len(g) else 0) + self.bias
        e = np.exp((z - z.max()) / self.temperature)
        return e / e.sum()

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        p = self.probabilities(text)
        if p is None:
            return UNKNOWN, 0.0, True
        k = int(p.argmax())
        return self.languages[k], float(p[k]), bool(p[k] < self.threshold)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(rows: list[tuple[str, str]], seed: int = 7) -> Model:
    """rows: (language, text). SGD on random snippets of n-grams, with every ninth row kept for calibration."""
    languages = sorted({lang for lang, _ in rows})
    k = len(languages)
    if not k:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0), 1.0, 0.0)
    number = {x: i for i, x in enumerate(languages)}
    held = [r for i, r in enumerate(rows) if i % 9 == 4]
    train = [(number[lang], g) for i, (lang, t) in enumerate(rows) if i % 9 != 4 and len(g := grams(t)) >= 8]
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    layer = rng.normal(0, 0.3, (DIM, k)).astype(np.float32)
    bias = np.zeros(k, np.float32)
    by = [[g for y, g in train if y == i] for i in range(k)]
    present = [i for i in range(k) if by[i]]
    for step in range(STEPS if len(present) > 1 else 0):
        rate = 1.0 - step / STEPS
        y = rng.choice(present, BATCH)
        ids = np.stack([(g := by[i][rng.integers(len(by[i]))])[rng.integers(0, len(g), SNIPPET)] for i in y])
        x = emb[ids].mean(axis=1)
        d = _softmax(x @ layer + bias)
        d[np.arange(BATCH), y] -= 1
        d /= BATCH
        dx = d @ layer.T
        layer -= 4.0 * rate * (x.T @ d)
        bias -= 0.2 * rate * d.sum(axis=0)
        np.add.at(emb, ids, (-40.0 * rate / SNIPPET) * dx[:, None, :])
    table = (emb @ layer).astype(np.float32)
    model = Model(languages, table, bias.astype(np.float64), 1.0, 0.0)
    raw = [(number[lang], (table.take(g, axis=0).mean(axis=0) + bias).astype(np.float64)) for lang, t in held if len(g := grams(t))]
    if raw:
        y, z = np.array([a for a, _ in raw]), np.stack([b for _, b in raw])
        losses = {t: -np.log(_softmax(z / t)[np.arange(len(y)), y] + 1e-12).mean() for t in np.geomspace(0.05, 5, 40)}
        model.temperature = float(min(losses, key=losses.get))
        p = _softmax(z / model.temperature)
        right = np.sort(p.max(axis=1)[p.argmax(axis=1) == y])
        if len(right):
            model.threshold = float(min(0.5, right[int(len(right) * FALSE_REJECTS)] * 0.9))
    return model


def training_rows(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> list[tuple[str, str]]:
    """The bounded sample: rows chosen by a hash of their key, as many of each language as the parameters say."""
    rows = labelled.select(F.col(key).cast("string").alias("k"), F.col(lang).alias("l"), F.col(text).alias("t"))
    rows = rows.where(F.col("l").isNotNull() & F.col("t").isNotNull() & (F.length("t") <= TRAIN_CHARS))
    counts = {r["l"]: r["count"] for r in rows.groupBy("l").count().collect()}
    if not counts:
        return []
    each = min(SAMPLE_PER_LANGUAGE, max(1, SAMPLE_ROWS // len(counts)))
    draw = F.pmod(F.xxhash64(F.coalesce("k", F.lit("")), F.lit(11)), F.lit(1_000_000))
    share = local_rows(rows.sparkSession, [(a, int(1_000_000 * min(1.0, each / n)) + 1) for a, n in counts.items()], "l string, share bigint")
    picked = rows.join(share, "l").where(draw < F.col("share")).select("l", "t", draw.alias("d"), "k").limit(2 * SAMPLE_ROWS).collect()
    return [(r["l"], r["t"]) for r in sorted(picked, key=lambda r: (r["d"], r["k"] or "", r["t"]))]


def predicted(text: Column, model: Model) -> Column:
    """Struct column (lang string, score double, rejected boolean) for a text column."""

    @F.pandas_udf("lang string, score double, rejected boolean")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([model.predict(t) for t in texts], columns=["lang", "score", "rejected"])

    return run(text)
