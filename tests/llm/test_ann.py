import numpy as np

from lexweave.llm import ann

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, every, k):
    usable = {}
    for i, v, _ in rows:
        if i is None or v is None or not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        usable[i] = [float(np.float32(x)) for x in v]
    out = {}
    for q in (i for i in usable if i % every == 0):
        scores = []
        for i, v in usable.items():
            if i != q and len(v) == len(usable[q]):
                s = 0.0
                for a, b in zip(usable[q], v):
                    s += a * b
                scores.append((-s, i))
        out[q] = [(i, -s) for s, i in sorted(scores)[:k]]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def test_recall_and_exact_scores(spark, monkeypatch):
    rng = np.random.default_rng(0)
    v = rng.standard_normal((1500, 64)) * rng.lognormal(size=(1500, 1))
    rows = [(i, v[i].tolist(), 0) for i in range(1500)]
    want, got = brute(rows, 20, 20), found(ann.nearest(spark.createDataFrame(rows, SCHEMA)))
    assert got.keys() == want.keys()
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.98 * 20 * len(want)
    exact = {(q, i): s for q, x in brute(rows, 20, 1500).items() for i, s in x}
    assert all(s == exact[q, i] for q, x in got.items() for i, s in x)


def test_odd_vectors_ties_and_few_candidates(spark):
    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (3, None, 1), (4, [], 1), (5, [0.0, 0.0], 1), (6, [float("nan"), 1.0], 1), (7, [None, 1.0], 1), (8, [float("inf"), 1.0], 1), (20, [2.0, 1.0], None), (20, [2.0, 1.0], 3), (None, [1.0, 1.0], 1), (40, [1.0, 2.0, 3.0], 1)]
    got = found(ann.nearest(spark.createDataFrame(rows, SCHEMA)))
    assert got == {k: v for k, v in brute(rows, 20, 20).items() if v}


def test_hot_vector_and_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(ann, "QUERY_BLOCK", 8)
    monkeypatch.setattr(ann, "CANDIDATE_BLOCK", 64)
    rng = np.random.default_rng(2)
    same = rng.standard_normal(16).tolist()
    rows = [(i, same if i % 3 == 0 else rng.standard_normal(16).tolist(), 0) for i in range(600)]
    want, got = brute(rows, 20, 20), found(ann.nearest(spark.createDataFrame(rows, SCHEMA)))
    assert sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want) >= 0.95 * sum(map(len, want.values()))


def test_empty(spark):
    assert ann.nearest(spark.createDataFrame([], SCHEMA)).count() == 0


def test_cells_and_recall_on_clusters(spark, monkeypatch):
    monkeypatch.setattr(ann, "CELL", 100)
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((12, 32))
    v = np.concatenate([centres[rng.integers(0, 12, 1500)] + 0.05 * rng.standard_normal((1500, 32)), rng.standard_normal((900, 32))])
    rows = [(i, x.tolist(), 0) for i, x in enumerate(v)]
    want, got = brute(rows, 20, 20), found(ann.nearest(spark.createDataFrame(rows, SCHEMA)))
    assert sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want) >= 0.97 * 20 * len(want)


def test_estimates_hold_their_bounds():
    rng = np.random.default_rng(4)
    v, q = rng.standard_normal((400, 100)), rng.standard_normal((30, 100))
    at, turn = np.zeros((1, 100)), ann.rotation(100, 5)
    made = ann.encoded(v, at, turn)
    assert made["code"].dtype == np.uint8 and made["code"].shape == (400, 16)
    near, wide = ann.estimates(q @ turn.T, at[0], made["code"].view(np.uint64), made["length"], made["fit"])
    assert (np.abs(near - q @ v.T) <= wide).mean() > 0.95


def test_one_id_with_two_vectors_and_clashing_columns(spark):
    from .helpers import clashing

    rows = [(20, [1.0, 0.0], 0), (20, [0.0, 1.0], 0), (20, [0.0, 1.0], 0), (1, [2.0, 0.5], 0)]
    got = ann.nearest(clashing(spark.createDataFrame(rows, SCHEMA), "id", "mark", "dim", "v", "cell", "score", "rank")).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == [(20, 1, 1, 0.5), (20, 1, 1, 2.0), (20, 2, 20, 0.0), (20, 2, 20, 0.0)]
