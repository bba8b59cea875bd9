import random
import re

import numpy as np
import pytest

from lexweave.llm import neardup

from .helpers import clashing, none, odd, words


def shingle_set(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows, threshold=85):
    """doc_id: (n_shingles, component_id)."""
    sets = {i: shingle_set(t) for i, t in rows if i is not None}
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= threshold * (len(sets[a]) + len(sets[b]) - both):
                    x, y = root(a), root(b)
                    up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


def corpus(seed=0, groups=25):
    rng, rows = random.Random(seed), []
    shared = words(60, 99)  # a passage that many documents hold
    for g in range(groups):
        n = rng.choice([1, 3, 5, 8, 20, 54, 60, 120, 400])
        base = words(n, 1000 + g).split()
        if g % 4 == 0:
            base = base[: n // 2] + shared.split() + base[n // 2 :]
        for _ in range(rng.randint(1, 6)):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 6])):
                w[rng.randrange(len(w))] = words(1, rng.randrange(10**6))
            rows.append((len(rows) * 3 + 1, (" " if rng.random() < 0.5 else "\n ").join(x.upper() if rng.random() < 0.3 else x for x in w)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("block", [50_000, 600])
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    rows = corpus(block)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_hot_group_of_copies(spark):
    base = words(80, 7)
    rows = [(i, base if i % 2 else base + f" tail{i}") for i in range(600)] + [(1000 + i, words(30, 10_000 + i)) for i in range(50)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_odd_rows(spark):
    docs = clashing(odd(spark), "n", "id", "mark", "kept", "component_id")
    rows = neardup.near_duplicates(docs).collect()
    assert len(rows) == docs.count()
    by = {r.doc_id: r for r in rows}
    assert by[1].n_shingles == by[2].n_shingles == by[3].n_shingles == 0 and by[1].kept and by[2].component_id == 2
    assert by[5].component_id == 4 and not by[6].kept and by[8].component_id == 7 and by[11].component_id == 9
    assert by[None].component_id is None and by[None].kept


def test_empty_table_and_chains(spark):
    assert neardup.near_duplicates(none(spark)).count() == 0
    n = 200
    links = spark.createDataFrame([(i, i + 1) for i in range(n)], "u long, v long")
    assert {tuple(r) for r in neardup.components(links).collect()} == {(i, 0) for i in range(1, n + 1)}


def test_hash_tells_shingles_apart():
    a, b = neardup.shingles("a b c d e f"), neardup.shingles("a b c d f e")
    assert len(a) == 2 and not np.array_equal(a, b) and np.array_equal(neardup.shingles("A  b\nC d e f"), a)


def test_groups_of_many_blocks_with_members_apart(spark, monkeypatch):
    """Chains and outsiders within one group: no link may be lost when only some of its blocks meet."""
    monkeypatch.setattr(neardup, "BLOCK", 300)
    rng, base, rows = random.Random(5), words(60, 70).split(), []
    for i in range(160):
        w = list(base)
        for j in range(rng.choice([0, 1, 1, 2, 2, 3, 9])):
            w[(7 * i + 13 * j) % 60] = words(1, i * 31 + j)
        rows.append((i + 1, " ".join(w)))
    for threshold in (85, 80):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), threshold).collect()}
        assert got == brute(rows, threshold)


def test_bounds():
    assert neardup.sure(85) == 54 and neardup.needed(85) == 36 and neardup.needed(80) < 36
    from math import comb

    assert sum(comb(64, m) * 0.85**m * 0.15 ** (64 - m) for m in range(neardup.needed(85))) <= neardup.LOSS


def test_a_repeated_id_keeps_its_other_text(spark):
    copy, other = words(30, 1), words(30, 2)
    docs = clashing(spark.createDataFrame([(5, copy), (6, copy + " x"), (6, other), (8, None)], "doc_id long, text string"), "_id", "_key", "row", "n")
    kept = neardup.drop_near_copies(docs)
    assert kept.columns == docs.columns and sorted((r.doc_id, r.text or "") for r in kept.collect()) == [(5, copy), (6, other), (8, "")]
    found = {(r.doc_id, r.n_shingles): (r.component_id, r.kept) for r in neardup.near_duplicates(docs).collect()}
    assert found == {(5, 26): (5, True), (6, 27): (5, False), (6, 26): (6, True), (8, 0): (8, True)}
