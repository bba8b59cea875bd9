import zlib

import numpy as np
import pytest

from lexweave.llm import quality, toxicity

from .helpers import clashing, none, odd

SF = "/root/testdata/sf0.01"
LABELS = "doc_id long, quality int, toxic int"
KINDS = [(quality, "quality", 5, 0), (toxicity, "toxic", 4, 2)]


@pytest.mark.parametrize("module, column, folds, fold", KINDS)
def test_held_out_accuracy(spark, module, column, folds, fold):
    try:
        docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    except Exception:
        pytest.skip("no test data")
    rows = module.classify(docs, labels).collect()
    assert len(rows) == docs.count()
    want = {r.doc_id: r[column] for r in labels.collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == fold) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    pairs = [(r.score, want[r.doc_id]) for r in rows if r.held_out and want.get(r.doc_id) is not None]
    yes, no = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in yes for b in no])
    print(column, "held-out AUC", auc, len(yes), len(no))
    assert auc >= 0.85


@pytest.mark.parametrize("module, column, folds, fold", KINDS)
def test_odd_rows_and_no_labels(spark, module, column, folds, fold):
    docs = clashing(odd(spark), "score", "stats", "y", "shard")
    empty = spark.createDataFrame([], LABELS)
    rows = module.classify(docs, empty).collect()
    assert len(rows) == docs.count() and {round(r.score, 6) for r in rows} == {0.5}
    some = spark.createDataFrame([(4, 1, 0), (7, 0, 1), (7, 0, 1), (9, None, None), (None, 1, 1), (10, 1, 0), (8, 1, 1), (11, 0, 0)], LABELS)
    rows = module.classify(docs, some).collect()
    by_text: dict = {}
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in rows:
        assert 0 <= r.score <= 1 and by_text.setdefault(texts[r.doc_id], r.score) == r.score
    assert module.classify(none(spark), some).count() == 0


@pytest.mark.parametrize("module, column, folds, fold", KINDS)
def test_held_out_labels_have_no_part(spark, module, column, folds, fold):
    docs = spark.createDataFrame([(i, f"good clean words number {i}" if i % 2 else f"BAD!! $$ x x x {i}") for i in range(200)], "doc_id long, text string")
    out = lambda i: zlib.crc32(str(i).encode()) % folds == fold
    score = []
    for flip in (0, 1):
        labels = spark.createDataFrame([(i, (i % 2) ^ (flip and out(i)), (i % 2) ^ (flip and out(i))) for i in range(200)], LABELS)
        score.append(sorted((r.doc_id, r.score) for r in module.classify(docs, labels).collect()))
    assert score[0] == score[1]


@pytest.fixture
def learnable(spark):
    rng = np.random.default_rng(6)
    texts = [" ".join(rng.choice(["good", "fine", "prose", "of", "the", "day"] if i % 3 else ["Bad", "x", "$$", "!!", "spam", "the"], int(rng.integers(3, 60)))) for i in range(400)]
    labels = [(i, int(i % 3 > 0), int(i % 3 == 0)) for i in range(0, 400, 2)]
    return texts, labels, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5), spark.createDataFrame(labels, LABELS)


def test_quality_against_brute_force(spark, learnable):
    """The same features, one dense ridge system and one isotonic fit in numpy."""
    texts, labels, docs, table = learnable
    later = {r.doc_id for r in docs.where("pmod(xxhash64(13, doc_id), 5) = 0").collect()}
    x = np.array([quality.statistics(t) for t in texts])
    train = [(i, y) for i, y, _ in labels if zlib.crc32(str(i).encode()) % 5 != 0]
    own = x[[i for i, _ in train]]
    scale = own.std(axis=0)
    model = quality.Model(own.mean(axis=0), np.where(scale > 1e-9, scale, 1.0), np.zeros(quality.RANK + 1), np.zeros(1), np.zeros(1))
    early, late = [t for t in train if t[0] not in later], [t for t in train if t[0] in later]
    z, y = model.features(x[[i for i, _ in early]]), np.array([y for _, y in early], float)
    ridge = quality.RIDGE * np.eye(quality.RANK + 1)
    ridge[-1, -1] = 1e-9
    model.weights = np.linalg.solve(z.T @ z + ridge, z.T @ y)
    at = np.clip((model.raw(x[[i for i, _ in late]]) + 0.5) * quality.BINS / 2, 0, quality.BINS - 1).astype(int)
    bins = sorted(set(at))
    n = np.array([(at == b).sum() for b in bins])
    yes = np.array([sum(y for a, (_, y) in zip(at, late) if a == b) for b in bins])
    model.steps, model.values = (np.array(bins) + 0.5) * 2 / quality.BINS - 0.5, quality.isotonic(yes / n, n)
    want = model.score(x)
    got = {r.doc_id: r.score for r in quality.classify(docs, table).collect()}
    assert max(abs(got[i] - want[i]) for i in range(len(texts))) < 1e-5


def test_toxicity_against_brute_force(spark, learnable):
    """FTRL by its definition, a dict entry for each feature."""
    texts, labels, docs, table = learnable
    train = sorted((i, y) for i, _, y in labels if zlib.crc32(str(i).encode()) % 4 != 2)
    train = [train[i] for i in np.random.default_rng(29).permutation(len(train))]
    z, n, bias, bias_n = {}, {}, 0.0, 0.0

    def weight(f):
        zi, ni = z.get(f, 0.0), n.get(f, 0.0)
        return 0.0 if abs(zi) <= toxicity.L1 else -(zi - np.sign(zi) * toxicity.L1) / ((toxicity.BETA + ni**0.5) / toxicity.ALPHA + toxicity.L2)

    for _ in range(toxicity.EPOCHS):
        for i, y in train:
            own = toxicity.features(texts[i]).tolist()
            w = {f: weight(f) for f in own}
            g = 1 / (1 + np.exp(-(sum(w.values()) + bias))) - y
            for f in own:
                step = ((n.get(f, 0.0) + g * g) ** 0.5 - n.get(f, 0.0) ** 0.5) / toxicity.ALPHA
                z[f], n[f] = z.get(f, 0.0) + g - step * w[f], n.get(f, 0.0) + g * g
            bias_n += g * g
            bias -= toxicity.ALPHA / (toxicity.BETA + bias_n**0.5) * g
    want = [1 / (1 + np.exp(-(sum(weight(f) for f in toxicity.features(t).tolist()) + bias))) for t in texts]
    got = {r.doc_id: r.score for r in toxicity.classify(docs, table).collect()}
    assert max(abs(got[i] - want[i]) for i in range(len(texts))) < 1e-5


def test_isotonic():
    assert quality.isotonic(np.array([1.0, 0.0, 2.0, 1.0]), np.ones(4)).tolist() == [0.5, 0.5, 1.5, 1.5]
