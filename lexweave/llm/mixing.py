"""Mixing sources to target weights by subset-sum budget fitting.

Each source's target is water-filled from its weight. Whole epochs of the source are taken first. For the remaining
budget, documents are counted by exact length; every length gives the same share of its documents, rounded down, then
lengths in descending remainder fill up what is left to a small residue, and a bounded-knapsack dynamic program over the
counts not yet used hits that residue exactly wherever whole documents can. Which documents of a length are
taken is decided by a seeded hash of their id: ranks within (source, length) come from counts in hash buckets,
so no task sorts a whole group.

Edge cases: a null text has size 0 and is never repeated or taken (taken 0); a null source is a source of its own, ordered
last. Rows that repeat an id are ranked next to each other. A source without words has target 0. An empty table gives no
rows. Very long texts only count by their size. Columns named like new ones are replaced in mix(); mixture() gives the caller's
columns back as they are, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lexweave import ship
from lexweave.llm.common import WORD, saved, small_or_not

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
RESIDUE = 1 << 16
"""Words (or twice the longest document, if more) from which on the dynamic program takes over."""
SALTS = 1024


def size_of(text: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def sized(docs: DataFrame) -> DataFrame:
    return docs.withColumn("size", size_of("text"))


def numbered(rows: DataFrame, name: str, *order: Column) -> DataFrame:
    """rows with their place in the order, from 0, without sorting all of them in one task."""
    parts = saved(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ordered")
    counts = sorted((r._part, r.n) for r in parts.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect())  # a row a partition
    before = rows.sparkSession.createDataFrame([(p, sum(n for q, n in counts if q < p)) for p, _ in counts], "_part int, _before long")
    place = F.row_number().over(W.partitionBy("_part").orderBy(*order)) - 1
    return parts.withColumn("_place", place).join(F.broadcast(before), "_part").withColumn(name, F.col("_place") + F.col("_before")).drop("_part", "_place", "_before")


def targets(sources: DataFrame, weights: Sequence[int] = WEIGHTS, epochs: int = MAX_EPOCHS) -> DataFrame:
    """sources: (source, source_size), each once. Adds target: min(epochs * size, level * weight), the level being such that targets add up to all sizes.

    The level rises in rounds: what full sources can't take goes to the weight of the open ones, until no more become full.
    """
    own = numbered(sources, "_at", F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod("_at", F.lit(len(weights))) + 1).cast("int")).cast("double")
    own = saved(own.withColumns({"_w": weight, "_room": (epochs * F.col("source_size")).cast("double")}).drop("_at"), "sources")
    total, level, full = own.agg(F.sum("source_size")).first()[0] or 0, 0.0, -1
    while True:
        shut = F.col("_room") <= level * F.col("_w")
        n, room, open_weight = own.agg(F.count_if(shut), F.coalesce(F.sum(F.when(shut, F.col("_room"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~shut, F.col("_w"))), F.lit(0.0))).first()
        if n == full or not open_weight:
            break
        full, level = n, (total - room) / open_weight
    return own.withColumn("target", F.least("_room", level * F.col("_w"))).drop("_w", "_room")


def subset_sum(sizes: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many of each size to take, at most counts: the largest sum up to budget. Bounded knapsack over a bit set."""
    taken, reached, origin, mask = np.zeros(len(sizes), np.int64), 1, {}, (1 << (budget + 1)) - 1
    for i in np.argsort(-sizes, kind="stable"):
        size, left, part = int(sizes[i]), int(min(counts[i], budget // max(1, int(sizes[i])))), 1
        while size and left and not reached >> budget & 1:
            k = min(part, left)
            new = (reached << (k * size)) & mask & ~reached
            if new:
                bits = np.unpackbits(np.frombuffer(new.to_bytes(budget // 8 + 1, "little"), np.uint8), bitorder="little")
                for s in np.flatnonzero(bits):
                    origin[int(s)] = (i, k)
                reached |= new
            left, part = left - k, part * 2
    at = reached.bit_length() - 1
    while at:
        i, k = origin[at]
        taken[i] += k
        at -= k * int(sizes[i])
    return taken


def fit(sizes: np.ndarray, counts: np.ndarray, budget: int, residue: int = RESIDUE) -> np.ndarray:
    """How many documents of each size to take so that their sizes add up to budget, or come as near below as can be found."""
    total = int((sizes * counts).sum())
    if budget >= total:
        return counts.copy()
    share = counts * (budget / total)
    take = np.floor(share).astype(np.int64)
    left, residue = budget - int((sizes * take).sum()), max(residue, 2 * int(sizes.max()))
    while left < 0:  # of rounding in floats only
        i = int(np.argmax(take * sizes))
        take[i], left = take[i] - 1, left + int(sizes[i])
    for i in np.lexsort((sizes, take - share)):
        if left > residue and take[i] < counts[i] and sizes[i] <= left:
            take[i], left = take[i] + 1, left - int(sizes[i])
    if left > residue:  # few lengths: what floors left out is less than one document of each, so this is rare
        for i in np.argsort(-sizes):
            k = int(min(counts[i] - take[i], max(0, left - residue) // max(1, int(sizes[i]))))
            take[i], left = take[i] + k, left - k * int(sizes[i])
    return take + subset_sum(sizes, counts - take, left)


def _fit_source(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("size")
    size, target = int(rows["source_size"].iloc[0]), float(rows["target"].iloc[0])
    base = min(int(target // size), MAX_EPOCHS) if size else 0
    sizes, counts = rows["size"].to_numpy(np.int64), rows["n"].to_numpy(np.int64)
    extra = fit(sizes, counts, round(target - base * size)) if size and base < MAX_EPOCHS else np.zeros(len(rows), np.int64)
    return rows.assign(base=np.where(sizes > 0, base, 0), extra=extra)[["key", "size", "n", "source_size", "target", "base", "extra"]]


def plan(docs: DataFrame) -> DataFrame:
    """docs: (source, size). For each source and size: key, n, source_size, target, base (copies of each), extra (documents with one more)."""
    lengths = docs.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
    goal = targets(lengths.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")))
    key = F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))
    rows = lengths.withColumn("key", key).join(goal.withColumn("key", key).drop("source"), "key").select("key", "size", "n", "source_size", "target")
    return rows.groupBy("key").applyInPandas(_fit_source, "key string, size long, n long, source_size long, target double, base int, extra long")


NEW = ("source_size", "target", "copies", "taken")


def _key() -> Column:
    return F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))


def _placed(own: DataFrame, made: DataFrame) -> DataFrame:
    """own (key, size, id, o, ...) with the plan's columns and place: a row's rank within its key and size, by o and id, from 1.

    Ranks within a 1024th of a key and size come from a window, what comes before it from counts.
    """
    own = own.withColumn("salt", F.shiftrightunsigned("o", 54).cast("int"))
    counted = own.groupBy("key", "size", "salt").agg(F.count(F.lit(1)).alias("m"))
    before = F.sum("m").over(W.partitionBy("key", "size").orderBy("salt").rowsBetween(W.unboundedPreceding, -1))
    first = counted.join(made, ["key", "size"]).withColumn("first", F.coalesce(before, F.lit(0))).drop("m", "n")
    ranked = own.withColumn("rank", F.row_number().over(W.partitionBy("key", "size", "salt").orderBy("o", "id")))
    return ranked.join(first, ["key", "size", "salt"]).withColumn("place", F.col("first") + F.col("rank")).drop("salt", "rank", "first")


def mix(docs: DataFrame, seed: int = 11) -> DataFrame:
    """docs (with size, from sized()) with source_size, target, copies and taken."""
    ship(docs.sparkSession)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in NEW])
    own = docs.select(row.alias("row"), F.col("doc_id").alias("id"), _key().alias("key"), "size", F.xxhash64(F.lit(seed), "doc_id").alias("o"))
    own = _placed(own, saved(plan(docs.select("source", "size")), "mix-plan"))
    copies = F.col("base") + F.when(F.col("place") <= F.col("extra"), 1).otherwise(0)
    return own.withColumn("copies", copies).withColumn("taken", F.col("size") * F.col("copies")).select("row.*", *NEW)


def mixture(docs: DataFrame, seed: int = 11) -> DataFrame:
    """The mix itself: docs repeated as often as it takes them, documents of no words left out.

    Texts aren't shuffled: ranks are found on ids and sizes, and what a row is compared with is the last id that gets one more copy, which
    is a row for each source and length. Where rows that repeat an id stand on both sides of that, their ranks decide.
    """
    spark = docs.sparkSession
    ship(spark)
    slim = saved(docs.select("doc_id", "source", size_of("text").alias("size")), "mix-sizes")
    made = saved(plan(slim), "mix-plan")
    placed = _placed(slim.select(F.col("doc_id").alias("id"), _key().alias("key"), "size", F.xxhash64(F.lit(seed), "doc_id").alias("o")), made)
    ends = saved(placed.where("place in (extra, extra + 1)").select("key", "size", "id", "o", (F.col("place") > F.col("extra")).alias("next")), "mix-ends")
    last = ends.where("not next").select("key", "size", F.col("id").alias("last_id"), F.col("o").alias("last_o"))
    after = ends.where("next").select("key", "size", F.col("id").alias("next_id"), F.col("o").alias("next_o"))
    cut = made.join(last, ["key", "size"], "left").join(after, ["key", "size"], "left")
    split = F.coalesce((F.col("extra") > 0) & F.col("last_id").eqNullSafe(F.col("next_id")) & (F.col("last_o") == F.col("next_o")), F.lit(False))
    cut = saved(cut.select("key", "size", "base", "extra", "last_id", "last_o", split.alias("split")), "mix-cuts")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    own = docs.select(row.alias("document"), F.col("doc_id").alias("id"), _key().alias("key"), size_of("text").alias("size"), F.xxhash64(F.lit(seed), "doc_id").alias("o"))
    met = own.join(small_or_not(cut.where("not split"), 500_000), ["key", "size"])
    unsigned = lambda c: F.col(c).bitwiseXOR(F.lit(-(1 << 63)))  # noqa: E731  the order that _placed() has
    more = (unsigned("o") < unsigned("last_o")) | ((F.col("o") == F.col("last_o")) & F.coalesce(F.col("id") <= F.col("last_id"), F.col("id").isNull()))
    copies = F.col("base") + F.when((F.col("extra") > 0) & more, 1).otherwise(0)
    out = met.select("document", copies.alias("copies"))
    if cut.where("split").take(1):
        some = _placed(own.join(small_or_not(cut.where("split").select("key", "size"), 500_000), ["key", "size"], "left_semi"), made)
        out = out.unionByName(some.select("document", (F.col("base") + F.when(F.col("place") <= F.col("extra"), 1).otherwise(0)).alias("copies")))
    return out.where("copies > 0").withColumn("_", F.explode(F.sequence(F.lit(1), "copies"))).select("document.*")
