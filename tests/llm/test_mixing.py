import re

import numpy as np

from lexweave.llm import mixing

from .helpers import clashing, none, odd, odd_rows


def brute_targets(sizes: dict) -> dict:
    """Shares by weight; what exceeds three times a source goes to the others, until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(names)}
    full, total = {}, sum(sizes.values())
    while True:
        rest = [s for s in names if s not in full]
        left = total - sum(full.values())
        share = {s: left * weight[s] / sum(weight[x] for x in rest) for s in rest}
        over = {s: 3 * sizes[s] for s in rest if share[s] > 3 * sizes[s]}
        if not over:
            return full | share
        full |= over


def check(rows, docs):
    sizes: dict = {}
    for d in docs:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", d[1] or ""))
        sizes[d[3]] = sizes.get(d[3], 0) + n
    targets, taken = brute_targets(sizes), dict.fromkeys(sizes, 0)
    assert len(rows) == len(docs)
    for r in rows:
        assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
        assert r.source_size == sizes[r.source] and abs(r.target - targets[r.source]) < 1e-6 * max(1, r.target)
        assert 0 <= r.taken <= 3 * r.size and (not r.size or r.taken % r.size == 0)
        taken[r.source] += r.taken
    return targets, taken


def test_odd_rows(spark):
    rows = mixing.mix(mixing.sized(clashing(odd(spark), "taken", "target", "copies"))).collect()
    check(rows, odd_rows())


def test_sums_come_near_targets_and_reruns_agree(spark):
    rng = np.random.default_rng(0)
    docs = [(i, " ".join(["w"] * int(rng.integers(1, 90))), "en", ["a", "b", "c", None, "d"][int(rng.choice(5, p=[0.4, 0.3, 0.1, 0.1, 0.1]))], 0) for i in range(3000)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    rows = mixing.mix(mixing.sized(df)).collect()
    targets, taken = check(rows, docs)
    assert all(abs(targets[s] - taken[s]) <= 1 for s in targets)
    again = mixing.mix(mixing.sized(df.repartition(7))).collect()
    assert {(r.doc_id, r.taken) for r in rows} == {(r.doc_id, r.taken) for r in again}


def test_subset_sum_against_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(40):
        sizes, counts = np.unique(rng.integers(1, 30, 4)), None
        counts = rng.integers(0, 4, len(sizes))
        budget = int(rng.integers(0, 120))
        reached = {0}
        for s, c in zip(sizes, counts):
            reached = {x + k * int(s) for x in reached for k in range(int(c) + 1)}
        take = mixing.subset_sum(sizes, counts, budget)
        assert (take <= counts).all() and int((take * sizes).sum()) == max(x for x in reached if x <= budget)


def test_fit_large_budget_is_met_exactly():
    sizes, counts = np.arange(1, 400), np.full(399, 1000)
    take = mixing.fit(sizes, counts, 12_345_678)
    assert int((take * sizes).sum()) == 12_345_678 and (take <= counts).all() and (take >= 0).all()


def test_empty_table_and_mixture(spark):
    assert mixing.mix(mixing.sized(none(spark))).count() == 0
    made = mixing.mixture(odd(spark))
    assert made.columns == odd(spark).columns


def test_mixture_gives_clashing_columns_back(spark):
    docs = clashing(odd(spark), "size", "target", "taken", "copies", "_key", "_rank", "_first", "rank", "document")
    made = mixing.mixture(docs)
    assert made.columns == docs.columns
    rows = made.collect()
    assert rows and all(r[c] == "x" for r in rows for c in docs.columns[5:])
    counts: dict = {}
    for r in rows:
        counts[r.doc_id, r.text] = counts.get((r.doc_id, r.text), 0) + 1
    want: dict = {}
    for r in mixing.mix(mixing.sized(odd(spark))).collect():
        want[r.doc_id, r.text] = want.get((r.doc_id, r.text), 0) + r.copies
    assert counts == {k: n for k, n in want.items() if n}


def test_targets_of_many_sources(spark):
    sizes = {f"s{i:04d}": (i * 7919) % 1000 for i in range(300)} | {None: 77}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long").repartition(7)
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    want = brute_targets(sizes)
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 for s in want)


def test_mixture_equals_the_mix_where_ids_repeat(spark):
    """Rows that repeat an id on both sides of a cut, null ids, and texts of one length only."""
    rng = np.random.default_rng(4)
    rows = [(None if i % 17 == 0 else int(rng.integers(0, 60)), " ".join(["w"] * int(rng.integers(1, 4))), "en", "abc"[i % 3] if i % 5 else None, i % 2) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    made = mixing.mixture(df).groupBy("doc_id", "source", "text").count().collect()
    want = mixing.mix(mixing.sized(df)).where("copies > 0").groupBy("doc_id", "source", "text").agg({"copies": "sum"}).collect()
    assert {tuple(r)[:3]: r["count"] for r in made} == {tuple(r)[:3]: r["sum(copies)"] for r in want}
    assert "Exchange hashpartitioning(document" not in mixing.mixture(df)._jdf.queryExecution().toString()
