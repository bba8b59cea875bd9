"""Near-duplicates by bottom-k sketches, exact in the end.

One hash function gives every document its set of 64-bit hashes of distinct 5-word shingles; the k smallest are its
sketch. Documents with equal sets form a class; one of each class goes on. Inverted lists of retained values (those
that two classes or more hold) generate overlaps: as linked pairs share at least `need` sketch values, a class is put only
into the lists of its rarest values up to that many less one, so passages that many documents share make no candidates.
Lists that have the same smallest member form a group. Within blocks of bounded size, size ratio, count of common sketch values
and the union sketch's estimate filter pairs, and exact Jaccard on the full sets confirms them. Each task returns links that
span what it found connected, never all pairs. Components come from alternating star contractions.

A group of more than one block first links within blocks, then one member of each component found so far meets the others.
After that the members outside the group's largest component meet all of it, so a group of copies of any size takes work in
proportion to it, and no pair is left out but those that are connected already.

For sets of at most sure() shingles the filters lose no link. For larger ones a pair at the threshold is lost if fewer than
needed() of its union's 64 smallest hashes are common: a chance of at most LOSS for such a pair, and less above the threshold.

Edge cases: a text without words has n_shingles 0 and is linked with nothing; one of 1 to 4 words is a single shingle.
A null doc_id is linked with nothing: component null, kept. Rows that repeat a doc_id and text are one document; rows of one
doc_id with different texts are different ones (component_id is still the smallest doc_id reached). Very long texts only
count by their sets; a block holds one at least. Ties need no order, as all links count. An empty table gives an empty result.
Other columns stay as they are in drop_near_copies(), whatever their names, and are left out of near_duplicates().
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import cache
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave import ship
from lexweave.llm.common import looked_up, release, saved, slices, small_or_not

K = 64
THRESHOLD = 85
"""Links have 100 * intersection >= THRESHOLD * union, unless told otherwise."""
LOSS = 1e-8
BLOCK = 50_000
"""Shingles a block holds, about: what a task compares with another such block at once."""
WIDTH = 5
_UPPER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LETTER = np.random.default_rng(1234).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))


_TABLES: dict[int, np.ndarray] = {}


def _powers(base: np.uint64, n: int) -> np.ndarray:
    """base to the powers 0 to n at least."""
    if len(held := _TABLES.get(int(base), ())) <= n:
        held = np.full(max(n + 1, 1 << 16), base, np.uint64)
        held[0] = 1
        held = _TABLES[int(base)] = np.multiply.accumulate(held)
    return held


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of the text's word shingles (of all its words, if fewer than width)."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass").translate(_UPPER), np.uint8)
    if not len(raw):
        return np.zeros(0, np.uint64)
    gap = np.concatenate(([True], _SPACE[raw], [True]))
    edge = np.flatnonzero(gap[1:] != gap[:-1])
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.zeros(0, np.uint64)
    total = np.concatenate(([np.uint64(0)], np.cumsum(_LETTER[raw] * _powers(_BASE, len(raw) - 1)[: len(raw)])))
    words = _mix((total[end] - total[start]) * _powers(_BACK, int(start[-1]))[start] + (end - start).astype(np.uint64))
    n = min(width, len(words))
    out = np.zeros(len(words) - n + 1, np.uint64)
    for j in range(n):
        out = out * _BASE + words[j : len(words) - n + 1 + j]
    return np.unique(_mix(out + np.uint64(n)))


def need(n: np.ndarray, threshold: int) -> np.ndarray:
    """Sketch values that a set of n shares with any that it is linked with."""
    return np.where(n <= sure(threshold), -(-n * threshold // 100), needed(threshold))


def _mark(s: np.ndarray) -> str:
    return "%016x%016x%x" % (int(_mix(s).sum()), int((_mix(s ^ _BASE) * _BASE).sum()), len(s))


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, n, mark (equal for equal sets), sketch."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for b in batches for part in slices(b, "text", 2 << 20)):
            sets = [shingles(t) for t in b.column("text").to_pylist()]
            mark = [_mark(s) for s in sets]
            kept = [s[:K].view(np.int64) for s in sets]
            made = [b.column("doc_id").cast(pa.int64()), b.column("text_key"), pa.array([len(s) for s in sets], pa.int64()), pa.array(mark, pa.string()), pa.array(kept, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(made, ["doc_id", "text_key", "n", "mark", "sketch"])
        release()

    return docs.select("doc_id", "text", text_key(F.col("text")).alias("text_key")).mapInArrow(sketch, "doc_id long, text_key long, n long, mark string, sketch array<long>")


def text_key(text: Column) -> Column:
    """Tells the texts of one doc_id apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


@cache
def sure(threshold: int) -> int:
    """Up to so many shingles, all that a set can be linked with has its whole set in its sketch."""
    return K * threshold // 100


@cache
def needed(threshold: int) -> int:
    """Common values among the K smallest of a union that a pair at the threshold falls short of with a chance of LOSS at most."""
    p, total = threshold / 100, 0.0
    for m in range(K + 1):
        total += comb(K, m) * p**m * (1 - p) ** (K - m)
        if total > LOSS:
            return m
    return K


class _Links:
    def __init__(self, ids: np.ndarray):
        self.up = {int(i): int(i) for i in ids}

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)


def _compare(ids: list[np.ndarray], sets: list[list[np.ndarray]], links: _Links, threshold: int) -> None:
    """Links members of two blocks, or of one (one list of each)."""
    same = len(sets) == 1
    left, right = sets[0], sets[-1]
    every = np.unique(np.concatenate(left if same else left + right))
    mark, place, size, sketch = np.zeros(len(every) + 1, bool), [np.searchsorted(every, s) for s in right], np.array([len(s) for s in right]), np.full((len(right), K), len(every))
    for row, p in zip(sketch, place):
        row[: min(K, len(p))] = p[:K]
    counts = np.minimum(K, size)
    for i, a in enumerate(left):
        n = len(a)
        roots = np.array([links.root(int(x)) for x in ids[-1]]) if i % 64 == 0 or n > 2000 else roots
        mine = links.root(int(ids[0][i]))
        fits = (100 * np.minimum(n, size) >= threshold * np.maximum(n, size)) & (roots != mine)
        if same:
            fits[: i + 1] = False
        some = np.flatnonzero(fits)
        if not len(some):
            continue
        own = np.searchsorted(every, a)
        mark[own] = True
        mark[own[min(K, n) :]] = False
        shared = mark[sketch[some]]
        enough = shared.sum(axis=1) >= np.maximum(need(np.array(n), threshold), need(size[some], threshold))
        some, shared = some[enough], shared[enough]
        if len(some):
            # the c-th common value has rank r + s - c in the union's order, r and s being its ranks in the two sketches
            rank = np.searchsorted(own[:K], sketch[some]) + np.arange(K) - (np.cumsum(shared, axis=1) - 1)
            common = shared.sum(axis=1)
            union = np.minimum(K, min(K, n) + counts[some] - common)
            some = some[(shared & (rank < union[:, None])).sum(axis=1) >= needed(threshold) / K * union]
        mark[own] = True
        for j in some:
            if links.root(int(ids[-1][j])) == links.root(int(ids[0][i])):
                continue
            both = int(np.count_nonzero(mark[place[j]]))
            if 100 * both >= threshold * (n + size[j] - both):
                links.join(int(ids[0][i]), int(ids[-1][j]))
        mark[own] = False


def _links(rows: pd.DataFrame, threshold: int) -> pd.DataFrame:
    """Links of what stands in rows (lead, a, b, side, id, component, shingles): within side 0 where there is no other, else between both sides."""
    found = []
    for _, part in rows.groupby(["lead", "a", "b"], sort=False):
        sides = [x.drop_duplicates("id").sort_values("id") for _, x in part.groupby("side")]
        if len(sides) == 1 and part["side"].iloc[0] == 1:
            continue
        ids = [x["id"].to_numpy() for x in sides]
        links = _Links(np.concatenate(ids))
        for _, same in part.groupby("component")["id"]:
            for i in same.iloc[1:]:
                links.join(int(i), int(same.iloc[0]))
        before = {i: links.root(i) for i in links.up}
        _compare(ids, [[np.frombuffer(s, np.uint64) for s in x["shingles"]] for x in sides], links, threshold)
        found += [(i, r) for i in links.up if (r := links.root(i)) != before[i]]
    release()
    return pd.DataFrame(found, columns=["u", "v"], dtype=np.int64)


def components(links: DataFrame) -> DataFrame:
    """links (u, v) as (id, component): the smallest id that each linked id reaches. Alternates large and small stars until nothing changes."""
    edges = saved(links.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    state = None
    while True:  # each round but the last brings ids nearer to their smallest
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        edges = saved(small, "stars")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
        state = now


def candidates(classes: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """classes (id, n, sketch): (lead, id) of those that share a list of rare retained values with others, by the list's smallest member."""
    kept = F.when(F.col("n") <= sure(threshold), F.ceil(F.col("n") * threshold / 100)).otherwise(needed(threshold)).cast("int")
    held = classes.select("id", kept.alias("need"), F.explode("sketch").alias("value"))
    lists = saved(held.groupBy("value").agg(F.count(F.lit(1)).alias("m"), F.min("id").alias("lead")).where("m > 1"), "near-lists")
    shared = looked_up(held, lists, "value", "m", classes.agg(F.sum(F.size("sketch"))).first()[0] or 0)
    # the rarest values first, up to those that a link must leave over
    by_doc = shared.groupBy("id").agg(F.first("need").alias("need"), F.array_sort(F.collect_list(F.struct("m", "value", "lead"))).alias("lists")).where(F.size("lists") >= F.col("need"))
    rare = by_doc.select("id", F.explode(F.slice("lists", F.lit(1), F.size("lists") - F.col("need") + 1)).alias("at"))
    return rare.select(F.col("at.lead").alias("lead"), "id").distinct()


def shingled(docs: DataFrame, classes: DataFrame, ids: DataFrame) -> DataFrame:
    """id, shingles of the classes in ids."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for b in batches for part in slices(b, "text", 2 << 20)):
            made = [shingles(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array([_mark(s) for s in made], pa.string()), pa.array([s.tobytes() for s in made], pa.binary())], ["doc_id", "mark", "shingles"])
        release()

    wanted = saved(classes.join(small_or_not(ids.select("id").distinct(), 1_000_000), "id", "left_semi").select("id", "doc_id", "mark"), "near-wanted")
    texts = docs.select("doc_id", "text").join(small_or_not(wanted.select("doc_id").distinct(), 1_000_000), "doc_id", "left_semi")
    return texts.mapInArrow(sets, "doc_id long, mark string, shingles binary").join(wanted, ["doc_id", "mark"]).select("id", "shingles")


def link(docs: DataFrame, classes: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Links (u, v) that span the components of classes (id, doc_id, mark, n, sketch)."""
    spark = docs.sparkSession
    pairs = saved(candidates(classes, threshold).join(classes.select("id", "n"), "id"), "near-pairs")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def blocked(rows: DataFrame) -> DataFrame:
        """rows (lead, id, n) of leads with two or more, with block and blocks."""
        leads = saved(rows.groupBy("lead").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("total")).where("m > 1"), "near-leads")
        out = looked_up(rows, leads, "lead", "m", rows.count()).withColumn("blocks", F.ceil(F.col("total") / BLOCK).cast("int"))
        return out.withColumn("block", F.expr("cast(pmod(xxhash64(id), blocks) as int)")).drop("m", "total")

    def compared(rows: DataFrame) -> DataFrame:
        """rows: (lead, a, b, side, id, component, n). Pairs of blocks with members in plenty are tasks of their own, others share one."""
        rows = saved(rows, "near-blocks")
        total = rows.agg(F.sum("n")).first()[0] or 0
        by = rows.groupBy("lead", "a", "b").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("m"))
        bins = max(1, parts, -(-total // BLOCK))
        bin_ = F.when(F.col("total") > BLOCK // 2, F.xxhash64("lead", "a", "b")).otherwise(F.pmod(F.xxhash64("lead", "a", "b"), F.lit(bins)))
        dealt = rows.join(by.withColumn("bin", bin_).drop("total", "m"), ["lead", "a", "b"])
        grouped = dealt.drop("n").join(shingled(docs, classes, rows), "id").groupBy("bin")
        return saved(grouped.applyInPandas(lambda g: _links(g, threshold), "u long, v long"), "near-links")

    rows = saved(blocked(pairs), "near-groups")
    itself = lambda df: df.select("lead", F.col("block").alias("a"), F.col("block").alias("b"), F.lit(0).alias("side"), "id", F.col("id").alias("component"), "n")
    links = compared(itself(rows))
    large = rows.where("blocks > 1")
    if not large.take(1):
        return links

    def named() -> DataFrame:
        return large.join(components(links), "id", "left").withColumn("component", F.coalesce("component", "id"))

    # one member of each component of a group meets the others
    chosen = named().groupBy("lead", "component").agg(F.min_by(F.struct("id", "n"), "id").alias("_c")).select("lead", "_c.id", "_c.n")
    first = saved(blocked(chosen), "near-chosen").withColumn("other", F.expr("explode(sequence(0, blocks - 1))"))
    side = F.when(F.col("block") == F.col("other"), 0).otherwise((F.col("block") > F.col("other")).cast("int"))
    first = first.select("lead", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), side.alias("side"), "id", F.col("id").alias("component"), "n")
    links = links.unionByName(compared(first))
    # members outside the group's largest component meet all
    now = saved(named(), "near-named")
    main = now.groupBy("lead", "component").agg(F.count(F.lit(1)).alias("m")).groupBy("lead").agg(F.max_by("component", F.struct("m", "component")).alias("main"), F.sum("m").alias("m"))
    now = saved(looked_up(now, saved(main, "near-main"), "lead", "m", now.count()).drop("m"), "near-named")
    rest = now.where("component != main")
    if not rest.take(1):
        return links
    shares = rest.groupBy("lead").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("shares"), F.count(F.lit(1)).alias("m"))
    shares = saved(shares, "near-shares")
    left = looked_up(rest, shares, "lead", "m", now.count()).withColumn("a", F.expr("cast(pmod(xxhash64(id), shares) as int)")).withColumn("b", F.expr("explode(sequence(0, blocks - 1))"))
    right = looked_up(now, shares, "lead", "m", now.count()).withColumn("a", F.expr("explode(sequence(0, shares - 1))")).withColumn("b", F.col("block"))
    cols = ["lead", "a", "b", "side", "id", "component", "n"]
    return links.unionByName(compared(left.withColumn("side", F.lit(0)).select(cols).unionByName(right.withColumn("side", F.lit(1)).select(cols))))


def judged(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, text_key, n_shingles, component_id, kept of every row of docs (doc_id, text)."""
    ship(docs.sparkSession)
    own = saved(sketches(docs), "sketches")
    real = own.where("n > 0 and doc_id is not null")
    shared = real.groupBy("doc_id").agg(F.min("mark").alias("_a"), F.max("mark").alias("_b")).where("_a != _b").select("doc_id", F.lit(True).alias("_many"))
    classes = real.groupBy("mark").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.count(F.lit(1)).alias("m"))
    # a class goes by its smallest doc_id, or, where texts share that, by a number of its own
    named = F.when(F.col("_many"), F.lit(-(1 << 62)) - F.shiftrightunsigned(F.xxhash64("mark"), 2)).otherwise(F.col("doc_id"))
    classes = saved(classes.join(small_or_not(saved(shared, "near-shared"), 1_000_000), "doc_id", "left").withColumn("id", named).drop("_many"), "classes")
    of = components(link(docs, classes, threshold))
    every = classes.select("id", "doc_id", "mark", "m").join(of, "id", "left").withColumn("component", F.coalesce("component", "id"))
    every = saved(every, "near-components")
    least = every.groupBy("component").agg(F.min("doc_id").alias("_of"), F.count(F.lit(1)).alias("_m"))
    every = looked_up(every, saved(least, "near-least"), "component", "_m", every.count()).select("mark", "_of", "m")
    single = own.where("n = 0 or doc_id is null").select("doc_id", "text_key", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    rest = looked_up(real, every, "mark", "m", own.count()).select("doc_id", "text_key", F.col("n").alias("n_shingles"), F.col("_of").alias("component_id"))
    return rest.unionByName(single).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def near_duplicates(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of docs (doc_id, text)."""
    return judged(docs, threshold).drop("text_key")


def drop_near_copies(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """docs without those of which another in the same component stays."""
    gone = saved(judged(docs, threshold).where("not kept").select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).distinct(), "near-copies")
    at = "at_" + uuid.uuid4().hex  # a name that the caller's columns don't have
    marked = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.struct(F.col("doc_id").alias("id"), text_key(F.col("text")).alias("key")).alias(at))
    return marked.join(small_or_not(gone, 1_000_000), (F.col(f"{at}.id") == F.col("_id")) & (F.col(f"{at}.key") == F.col("_key")), "left_anti").select("row.*")
