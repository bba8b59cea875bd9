"""Quality classifier: random Fourier features of document statistics, ridge regression, isotonic calibration.

A document becomes a fixed row of statistics of its whole text. Cosines of seeded random projections of the standardised
statistics approximate a Gaussian kernel. Every partition sums its share of the normal equations, a few tasks add those
sums up, and the driver solves one system of RANK unknowns. Scores are calibrated by isotonic regression on counts in
score bins, of labelled rows that the system left out (one in CALIBRATE; all of them where there are none). Everything that
reaches the driver has a size fixed by the parameters; all labelled rows are used.

Edge cases: null and empty texts have the statistics of an empty text and get a score like others. Rows of labels that
repeat a doc_id count once (the largest label); null labels don't count. Without any labelled row all scores are 0.5.
Equal texts get equal scores. Very long texts take memory in proportion to one text. An empty table gives an empty result. Other
columns stay as they are in keep_good(), whatever their names, and are left out of classify().
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave import ship
from lexweave.llm.common import saved, small_or_not

RANK, GAMMA, RIDGE, BINS, SEED = 192, 0.01, 1.0, 512, 3
FOLDS, FOLD, CALIBRATE = 5, 0, 5
CUT = 0.3
_CLASS = np.full(256, 6, np.uint8)  # other: bytes of characters beyond ASCII
for _k, _s in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\x0b\x0c\n", b".,;:?'\"-", b"!#$%&*+/<=>@[\\]^_`{|}~()")):
    _CLASS[list(_s)] = _k
NAMES = ("length", "lower", "upper", "digit", "space", "plain", "symbol", "beyond", "words", "mean", "spread", "variety", "window", "stutter", "shout", "marked", "lone", "lines", "repeats", "longest")


def statistics(text: str | None) -> list[float]:
    """The row of NAMES for a text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = (text or "").split()
    if not words:
        return [0.0] * len(NAMES)
    n, m = len(raw), len(words)
    share = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=7) / n
    size = np.fromiter(map(len, words), np.int64, m)
    stutter = sum(map(str.__eq__, words, words[1:])) / m
    lines = text.split("\n")
    at = range(0, m, 100)
    window = sum(len(set(words[i : i + 100])) for i in at) / m
    return [
        np.log1p(n), *share[:4], *share[4:], np.log1p(m), size.mean(), size.std(), len(set(words)) / m**0.8, window, stutter,
        sum(map(str.isupper, words)) / m, sum(not (w[-1].isalnum() or w[-1] in ".,;:?!'\"-)") or w[-2:] == "!!" for w in words) / m, sum(not w.isalnum() and len(w) == 1 for w in words) / m,
        np.log1p(len(lines)), 1 - len(set(lines)) / len(lines), np.log1p(size.max()),
    ]


def _rows(text: pd.Series) -> np.ndarray:
    return np.array([statistics(t) for t in text], np.float64).reshape(-1, len(NAMES))


def stats(text: Column) -> Column:
    @F.pandas_udf("array<double>")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series(list(_rows(s)), dtype=object)

    return run(text)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    steps: np.ndarray
    values: np.ndarray

    def features(self, rows: np.ndarray) -> np.ndarray:
        rng = np.random.default_rng(SEED)
        turn, shift = rng.standard_normal((len(NAMES), RANK)) * np.sqrt(2 * GAMMA), rng.uniform(0, 2 * np.pi, RANK)
        z = np.clip((rows - self.mean) / self.scale, -8, 8)
        return np.hstack([np.cos(z @ turn + shift) * np.sqrt(2 / RANK), np.ones((len(rows), 1))])

    def raw(self, rows: np.ndarray) -> np.ndarray:
        out = np.empty(len(rows))
        for i in range(0, len(rows), 1024):
            out[i : i + 1024] = (self.features(rows[i : i + 1024]) * self.weights).sum(axis=1)  # not BLAS: equal rows, equal sums
        return out

    def score(self, rows: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(rows), self.steps, self.values), 0, 1)


def isotonic(y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The nondecreasing sequence nearest to y under weights w (pool adjacent violators)."""
    blocks: list[list[float]] = []
    for v, n in zip(y, w):
        blocks.append([v, n, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, n2, k2 = blocks.pop()
            v1, n1, k1 = blocks.pop()
            blocks.append([(v1 * n1 + v2 * n2) / (n1 + n2), n1 + n2, k1 + k2])
    return np.concatenate([np.full(k, v) for v, _, k in blocks]) if blocks else np.zeros(0)


def _summed(rows: DataFrame, model: Model, parts: int = 16) -> np.ndarray:
    """The normal equations of rows (stats, y): partition sums, added up in a few tasks and then here."""
    width = RANK + 1

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((width, width + 1))
        for b in batches:
            x = np.stack(b["stats"].to_numpy()) if len(b) else np.zeros((0, len(NAMES)))
            z = model.features(x)
            total += z.T @ np.hstack([z, b["y"].to_numpy(np.float64)[:, None]])
        yield pd.DataFrame({"sums": [total.tobytes()]})

    def more(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(width * (width + 1))
        for b in batches:
            for s in b["sums"]:
                total += np.frombuffer(s)
        yield pd.DataFrame({"sums": [total.tobytes()]})

    sums = rows.mapInPandas(add, "sums binary").repartition(parts).mapInPandas(more, "sums binary")
    return sum((np.frombuffer(r.sums) for r in sums.toLocalIterator()), np.zeros(width * (width + 1))).reshape(width, width + 1)


def fit(rows: DataFrame) -> Model:
    """rows: (stats, y, later) with y 0 or 1; those with later only calibrate."""
    d = len(NAMES)
    cols = [F.element_at("stats", i + 1) for i in range(d)]
    moments = rows.agg(*[F.avg(c) for c in cols], *[F.stddev_pop(c) for c in cols], F.count(F.lit(1))).first()
    mean, scale = np.array([x or 0.0 for x in moments[:d]]), np.array([x or 1.0 for x in moments[d : 2 * d]])
    model = Model(mean, np.where(scale > 1e-9, scale, 1.0), np.zeros(RANK + 1), np.array([0.0]), np.array([0.5]))
    if not moments[2 * d]:
        return model
    early, later = rows.where("not later"), rows.where("later")
    early, later = early if early.take(1) else rows, later if later.take(1) else rows
    a = _summed(early, model)
    ridge = RIDGE * np.eye(RANK + 1)
    ridge[-1, -1] = 1e-9
    model.weights = np.linalg.solve(a[:, :-1] + ridge, a[:, -1])

    def binned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hist = np.zeros((BINS, 2))
        for b in batches:
            if len(b):
                at = np.clip((model.raw(np.stack(b["stats"].to_numpy())) + 0.5) * BINS / 2, 0, BINS - 1).astype(int)
                np.add.at(hist, (at, b["y"].to_numpy(int)), 1)
        yield pd.DataFrame({"bin": np.arange(BINS), "no": hist[:, 0], "yes": hist[:, 1]})[hist.sum(axis=1) > 0]

    bins = later.mapInPandas(binned, "bin int, no double, yes double").groupBy("bin").agg(F.sum("no").alias("no"), F.sum("yes").alias("yes")).orderBy("bin").toPandas()
    n = (bins["no"] + bins["yes"]).to_numpy()
    model.steps = (bins["bin"].to_numpy() + 0.5) * 2 / BINS - 0.5
    model.values = isotonic(bins["yes"].to_numpy() / n, n)
    return model


def held_out(doc_id: Column, folds: int = FOLDS, fold: int = FOLD) -> Column:
    return F.crc32(doc_id.cast("string")) % folds == fold


def labelled(labels: DataFrame, column: str, folds: int, fold: int) -> DataFrame:
    """(doc_id, y), each id once, of the rows to learn from."""
    own = labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull()).where(~held_out(F.col("doc_id"), folds, fold))
    return own.groupBy("doc_id").agg(F.max((F.col(column) > 0).cast("int")).alias("y"))


def training_rows(documents: DataFrame, labels: DataFrame, rows: Column) -> DataFrame:
    """stats, y, later of the labelled ones of documents (doc_id, ...); rows: their statistics, taken of those only."""
    later = F.pmod(F.xxhash64(F.lit(13), "doc_id"), F.lit(CALIBRATE)) == 0
    own = small_or_not(labelled(labels, "quality", FOLDS, FOLD), 1_000_000)
    return documents.join(own, "doc_id").select(rows.alias("stats"), "y", later.alias("later"))


def scored(stats_col: Column, model: Model) -> Column:
    shared = model

    @F.pandas_udf("double")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series(shared.score(np.stack(s.to_numpy())) if len(s) else [], dtype=float)

    return run(stats_col)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs (doc_id, text). Texts are read once."""
    ship(docs.sparkSession)
    own = saved(docs.select("doc_id", stats(F.col("text")).alias("stats")), "quality-stats")
    model = fit(saved(training_rows(own, labels, F.col("stats")), "quality-rows"))
    out = own.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), scored(F.col("stats"), model).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those whose score is below CUT; the model is fitted on the labelled ones among docs.

    Statistics are taken of the labelled texts first, then of all; neither is kept, and no text is shuffled while a million labels
    or fewer are there.
    """
    ship(docs.sparkSession)
    model = fit(saved(training_rows(docs.select("doc_id", "text"), labels, stats(F.col("text"))), "quality-rows"))

    @F.pandas_udf("double")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series(model.score(_rows(s)), dtype=float)

    return docs.where(run(F.col("text")) >= CUT)
