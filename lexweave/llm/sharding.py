"""Sharding by histogram sort.

Rows are ordered by a pair of 64-bit keys (a hash of the text, then one of the id), so that equal texts are neighbours.
Counting passes find the exact bytes in intervals of the key space; intervals that are too large, or that hold a shard's
boundary and exceed the tolerance, are probed with finer boundaries in the next pass. The intervals that come out are
dealt to shards in order and rows are exchanged once, by interval; a row's slot is its interval's offset plus its rank.

Law: bytes (shards differ by the tolerance, or by one document where that is larger). Edge cases: a null text has size 1,
a null id is hashed as such. Rows equal in id and text share an interval and get neighbouring slots in any order. An empty
table gives no rows. A group of copies, however large, is split by id. Columns named like new ones are replaced. Nothing
but interval counts reaches the driver: some thousands, and beyond a thousand times SORTED rows some for each SORTED of them.
Very long texts only count by their size and hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

STEPS = (12, 20, 28, 36, 44, 52, 60, 64)
"""Key bits that the counting passes tell apart: of the first key, then of the second."""
PROBES, SORTED = 64, 1 << 18
"""Intervals a shard has at least, and rows that one interval, and so one sort task, has about at most."""
TOLERANCE = 0.001
KEYS = ("_h", "_g")


def _prefix(depth: int) -> tuple[Column, Column]:
    h, g = map(F.col, KEYS)
    second, bits = divmod(depth, len(STEPS))
    top = lambda x: F.shiftrightunsigned(x, 64 - STEPS[bits]) if STEPS[bits] < 64 else x
    return (h, top(g)) if second else (top(h), F.lit(0).cast("long"))


def _start(depth: int, p1: int, p2: int) -> tuple[int, int]:
    """The first key of an interval, in unsigned order."""
    unsigned = lambda x: x & 0xFFFFFFFFFFFFFFFF
    second, bits = divmod(depth, len(STEPS))
    shift = 64 - STEPS[bits]
    return (unsigned(p1), unsigned(p2) << shift) if second else (unsigned(p1) << shift, 0)


def intervals(rows: DataFrame, shards: int, tolerance: float = TOLERANCE) -> list[dict]:
    """rows: (_h, _g, size). Intervals in key order: depth, p1, p2 (its prefix), n (rows), size."""
    spark = rows.sparkSession
    done: list[dict] = []
    probed: list[dict] = []
    depth, last = 0, 2 * len(STEPS) - 1
    while depth == 0 or probed:
        p1, p2 = _prefix(depth)
        part = rows
        if depth:
            o1, o2 = _prefix(depth - 1)
            wanted = spark.createDataFrame([(x["p1"], x["p2"]) for x in probed], "_o1 long, _o2 long")
            part = rows.withColumns({"_o1": o1, "_o2": o2}).join(F.broadcast(wanted), ["_o1", "_o2"], "left_semi")
        found = part.groupBy(p1.alias("p1"), p2.alias("p2")).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size")).collect()
        every = sorted(done + [{"depth": depth, "at": _start(depth, r.p1, r.p2), **r.asDict()} for r in found], key=lambda x: x["at"])
        total, n = (sum(x[k] for x in every) for k in ("size", "n"))
        before, largest, fine = 0, total / max(shards * PROBES, n / SORTED), tolerance * total / shards
        probed, done = [], []
        for x in every:
            cut = before * shards // total != (before + x["size"]) * shards // total
            before += x["size"]
            more = x["depth"] == depth < last and x["n"] > 1 and (x["size"] > largest or x["n"] > SORTED or (cut and x["size"] > fine))
            (probed if more else done).append(x)
        depth += 1
    return done


def keyed(docs: DataFrame, seed: int = 7) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.withColumns({"size": F.octet_length(text).cast("long") + 1, "_h": F.xxhash64(F.lit(seed), text), "_g": F.xxhash64(F.lit(seed), "doc_id")})


def deal(rows: DataFrame, shards: int = 16, tolerance: float = TOLERANCE) -> DataFrame:
    """keyed() rows with law, shard and slot. The rows are read once for each counting pass, then once more."""
    spark = rows.sparkSession
    cells = intervals(rows.select(*KEYS, "size"), shards, tolerance)
    total, before, first, known = sum(x["size"] for x in cells), 0, {}, {}
    for i, x in enumerate(cells):
        k = min(shards - 1, int((before + x["size"] / 2) * shards // total))
        before += x["size"]
        known.setdefault(x["depth"], []).append((x["p1"], x["p2"], i, k, first.get(k, 0)))
        first[k] = first.get(k, 0) + x["n"]
    out, cell = rows, F.lit(None).cast("struct<cell:int,shard:int,first:bigint>")
    for depth in sorted(known):
        p1, p2 = _prefix(depth)
        part = spark.createDataFrame(known[depth], "_p1 long, _p2 long, cell int, shard int, first long")
        part = part.select("_p1", "_p2", F.struct("cell", "shard", "first").alias(f"_cell{depth}"))
        out = out.withColumns({"_p1": p1, "_p2": p2}).join(F.broadcast(part), ["_p1", "_p2"], "left").drop("_p1", "_p2")
        cell = F.coalesce(cell, F.col(f"_cell{depth}"))
    out = out.withColumn("_cell", cell).drop(*[f"_cell{d}" for d in known])
    rank = F.row_number().over(W.partitionBy("_cell.cell").orderBy(*[F.col(k).bitwiseXOR(F.lit(-(1 << 63))) for k in KEYS], "doc_id"))  # as unsigned numbers
    out = out.withColumns({"law": F.lit("bytes"), "shard": F.col("_cell.shard"), "slot": F.col("_cell.first") + rank - 1, "grown_shard": F.lit(None).cast("int")})
    return out.drop("_cell", *KEYS)


def shard(docs: DataFrame, shards: int = 16, tolerance: float = TOLERANCE) -> DataFrame:
    """docs with size, law, shard, slot and grown_shard (null: this law doesn't keep rows in place as shards are added)."""
    return deal(keyed(docs), shards, tolerance)
