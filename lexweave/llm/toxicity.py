"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a whole text are the distinct hashes of its words, of their stems (first STEM letters), of neighbouring
words and of words with one between them. Up to SHARDS tasks learn from about SHARD_ROWS labelled rows each, with a rate per
coordinate and L1 sparsity; the mean of their weights (some thousands) is the model that scoring broadcasts.

At most MAX_ROWS labelled rows are learnt from (about; chosen by a hash of doc_id), and tasks get their features only, so
training is bounded in rows, and in bytes by the distinct features of that many texts.
Edge cases: null and empty texts have no feature and get the score of the bias. Rows of labels that repeat a doc_id count
once (the largest label); null labels don't count. Without any labelled row all scores are 0.5. Equal texts get equal
scores. Very long texts take memory in proportion to one text. An empty table gives an empty result. Other columns, whatever
their names, are left out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave import ship
from lexweave.llm.quality import held_out, labelled

FOLDS, FOLD = 4, 2
CUT = 0.3
SHARD_ROWS, SHARDS, EPOCHS = 3_000, 8, 3
MAX_ROWS = SHARD_ROWS * SHARDS
BITS, STEM = 22, 4
ALPHA, BETA, L1, L2 = 1.0, 1.0, 4.0, 0.01
_EDGES = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_KNOWN: dict[str, tuple[int, int]] = {}


def _codes(word: str) -> tuple[int, int]:
    w = word.strip(_EDGES).lower()
    return zlib.crc32(w.encode("utf-8", "surrogatepass")), zlib.crc32(b"\0" + w[:STEM].encode("utf-8", "surrogatepass"))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return (x ^ (x >> np.uint64(29))) >> np.uint64(64 - BITS)


def features(text: str | None) -> np.ndarray:
    words = (text or "").split()
    if not words:
        return np.zeros(0, np.int64)
    known = _KNOWN
    if len(known) > 400_000:
        known.clear()
    for w in set(words):
        if w not in known:
            known[w] = _codes(w)
    both = np.array([known[w] for w in words], np.uint64)
    w, s = both[:, 0] + np.uint64(1), both[:, 1] + np.uint64(1)
    a, b, c = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
    return np.unique(_mix(np.concatenate([w * a, s * b, w[:-1] * b + w[1:] * c, w[:-2] * c + w[2:] * a]))).astype(np.int64)


def train(rows: list[np.ndarray], y: np.ndarray, epochs: int = EPOCHS) -> dict[int, float]:
    """Non-zero weights after some passes over rows of features, -1 being the bias."""
    z, n, bias, bias_n = np.zeros(1 << BITS), np.zeros(1 << BITS), 0.0, 0.0

    def weights(zi, ni):
        return np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2))

    for _ in range(epochs):
        for x, t in zip(rows, y):
            zi, ni = z[x], n[x]
            w = weights(zi, ni)
            p = 1 / (1 + np.exp(-np.clip(w.sum() + bias, -30, 30)))
            g = p - t
            step = (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA
            z[x], n[x] = zi + g - step * w, ni + g * g
            bias_n += g * g
            bias -= ALPHA / (BETA + np.sqrt(bias_n)) * g
    w = weights(z, n)
    at = np.flatnonzero(w)
    return {-1: bias} | dict(zip(at.tolist(), w[at].tolist()))


def learnt(part: pd.DataFrame) -> dict[int, float]:
    """Weights of one shard's rows (doc_id, features, y)."""
    part = part.sort_values(["doc_id", "features"])  # an order that is the same in every run, then shuffled
    part = part.iloc[np.random.default_rng(29).permutation(len(part))]
    return train([np.frombuffer(x, np.int32) for x in part["features"]], part["y"].to_numpy(float))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> tuple[np.ndarray, np.ndarray, float]:
    """Indexes and weights of the features that count, and the bias."""
    own = labelled(labels, "toxic", FOLDS, FOLD)
    n = own.count()
    if n > max_rows:  # a bounded sample; the rest of the bound is left for chance
        own = own.where(F.pmod(F.xxhash64(F.lit(17), "doc_id"), F.lit(1 << 30)) < int((1 << 30) * 0.95 * max_rows / n))
    shards = min(SHARDS, max(1, -(-n // SHARD_ROWS)))
    rows = docs.select("doc_id", "text").join(F.broadcast(own), "doc_id").withColumn("shard", F.pmod(F.xxhash64(F.lit(23), "doc_id"), F.lit(shards)))

    @F.pandas_udf("binary")
    def made_of(s: pd.Series) -> pd.Series:
        return pd.Series([features(t).astype(np.int32).tobytes() for t in s], dtype=object)

    rows = rows.select("doc_id", "y", "shard", made_of("text").alias("features"))

    def learn(part: pd.DataFrame) -> pd.DataFrame:
        w = learnt(part)
        return pd.DataFrame({"at": list(w.keys()), "w": list(w.values())})

    made = rows.groupBy("shard").applyInPandas(learn, "at long, w double")
    made = made.groupBy("at").agg((F.sum("w") / shards).alias("w")).orderBy("at").toPandas()  # bounded as the rows are
    bias = float(made["w"][made["at"] == -1].sum())
    made = made[made["at"] >= 0]
    return made["at"].to_numpy(np.int64), made["w"].to_numpy(np.float32), bias


def score_texts(texts: pd.Series, dense: np.ndarray, bias: float) -> np.ndarray:
    raw = np.array([dense[features(t)].sum(dtype=np.float64) for t in texts]) + bias
    return 1 / (1 + np.exp(-np.clip(raw, -30, 30)))


def scored(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float]) -> Column:
    at, weights, bias = model
    shared = docs.sparkSession.sparkContext.broadcast((at, weights))

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        at, weights = shared.value
        dense = np.zeros(1 << BITS, np.float32)
        dense[at] = weights
        for s in batches:
            yield pd.Series(score_texts(s, dense, bias), dtype=float)

    return run(F.col("text"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs (doc_id, text)."""
    ship(docs.sparkSession)
    model = fit(docs, labels)
    out = docs.select("doc_id", F.coalesce(held_out(F.col("doc_id"), FOLDS, FOLD), F.lit(False)).alias("held_out"), scored(docs, model).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= CUT).cast("int"))
