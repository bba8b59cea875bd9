"""Nearest neighbours by inner product over randomly rotated one-bit codes in an inverted index.

Cells come from k-means over a bounded sample (SAMPLE vectors at most); every row is put into the cell of its nearest
centroid. What a vector is off its centroid is rotated by one seeded orthogonal matrix and kept as a packed sign bit per
dimension with two correction scalars: its length, and the inner product of its unit vector with its code. A query is cut
into PLANES bit planes, so counts of common bits give its inner product with a code, and the scalars turn that into an
estimate with an error bound.

A query looks into its FIRST most promising cells, which gives a k-th best score to beat, and then into every other cell
whose bound (centroid, radius, and the spread of a random direction) reaches that score: queries with near neighbours see
few cells, queries without see many. Within a cell, candidates whose upper bound reaches the score to beat are
reranked by their exact inner product. Cells meet their queries in blocks of bounded size on both sides.

Recall is measured against brute force in the tests and in the README; it isn't 1 by construction, as bounds hold with
ERROR standard errors. Of equal vectors only the k + 1 of the smallest ids are candidates, as no other can be among the k
nearest; all rows are queries if the query condition holds.

Edge cases: vectors that are null, empty, zero or hold null or non-finite components take no part. Vectors meet those of
their own length only. Rows that repeat a vec_id with an equal vector are one row; with another vector they are rows of
their own, each query giving its own k rows. All candidates are returned if there are fewer than k; a query without
candidates has no row. Exact inner products are summed over dimensions in order, in double precision, so equal vectors
tie exactly; ties go to the smaller vec_id. An empty table gives an empty result; other columns, whatever their names,
are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lexweave import ship
from lexweave.llm.common import saved

CELL, MOST_CELLS, SAMPLE = 1024, 4096, 32_768
"""Rows a cell is to have (on average), cells at most, vectors that centroids are fitted on at most."""
QUERY_BLOCK, CANDIDATE_BLOCK = 16_384, 16_384
FIRST = 4
"""Cells that every query looks into."""
PLANES = 6
ERROR, SPREAD = 2.2, 3.75
"""Standard errors of the bounds of codes, and of those of cells."""


def rotation(dim: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def usable(v: Column) -> Column:
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(v) > 0) & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def centroids(v: np.ndarray, cells: int, seed: int, rounds: int = 6) -> np.ndarray:
    """k-means by Lloyd's rounds; a cell that runs empty keeps its place."""
    at = v[np.random.default_rng(seed).choice(len(v), cells, replace=False)].copy()
    for _ in range(rounds):
        near = nearest_cell(v, at)
        n = np.bincount(near, minlength=cells)
        sums = np.zeros_like(at)
        np.add.at(sums, near, v)
        at[n > 0] = sums[n > 0] / n[n > 0, None]
    return at


def nearest_cell(v: np.ndarray, at: np.ndarray) -> np.ndarray:
    half = (at * at).sum(axis=1) / 2
    return np.concatenate([np.argmax(v[i : i + 2048] @ at.T - half, axis=1) for i in range(0, len(v), 2048)]) if len(v) else np.zeros(0, np.int64)


def encoded(v: np.ndarray, at: np.ndarray, turn: np.ndarray) -> dict[str, np.ndarray]:
    """cell, code (packed into 64-bit words), length and fit of vectors."""
    cell = nearest_cell(v, at)
    off = (v - at[cell]) @ turn.T
    scale = np.maximum(np.abs(off).max(axis=1, keepdims=True), np.finfo(float).tiny)  # so that lengths of huge or tiny vectors stay finite
    length = np.linalg.norm(off / scale, axis=1)
    unit = off / scale / np.maximum(length, 1e-300)[:, None]
    dim = v.shape[1]
    bits = np.zeros((len(v), -(-dim // 64) * 64), bool)
    bits[:, :dim] = unit > 0
    fit = np.abs(unit).sum(axis=1) / np.sqrt(dim)
    return {"cell": cell, "code": np.packbits(bits, axis=1, bitorder="little"), "length": length * scale[:, 0], "fit": np.where(fit > 0, fit, 1.0)}


def planes(q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bit planes (queries, PLANES, words) of rotated queries, their lowest component and the step."""
    low = q.min(axis=1)
    step = np.maximum((q.max(axis=1) - low) / ((1 << PLANES) - 1), np.finfo(float).tiny)
    level = np.rint((q - low[:, None]) / step[:, None]).astype(np.uint8)
    bits = np.zeros((len(q), PLANES, -(-q.shape[1] // 64) * 64), bool)
    bits[:, :, : q.shape[1]] = (level[:, None, :] >> np.arange(PLANES, dtype=np.uint8)[None, :, None]) & 1
    return np.packbits(bits, axis=2, bitorder="little").view(np.uint64), low, step


def estimates(q: np.ndarray, center: np.ndarray, codes: np.ndarray, length: np.ndarray, fit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products of rotated queries with coded vectors of a cell, and their error bounds."""
    dim = q.shape[1]
    parts, low, step = planes(q)
    common = np.zeros((len(q), len(codes)), np.float32)
    for p in range(PLANES):
        for w in range(codes.shape[1]):
            common += np.bitwise_count(codes[None, :, w] & parts[:, p, w][:, None]) * np.float32(1 << p)
    ones = np.bitwise_count(codes).sum(axis=1)
    inner = (2 * (low[:, None] * ones + step[:, None] * common) - q.sum(axis=1)[:, None]) / np.sqrt(dim)
    spread = ERROR * np.sqrt(np.maximum(0, 1 - fit**2) / max(1, dim - 1))
    rounding = ERROR * step / np.sqrt(12)
    by = length / fit
    wide = (np.linalg.norm(q, axis=1)[:, None] * (spread + 1e-9) + rounding[:, None]) * by
    return (q @ center)[:, None] + inner * by, wide


def rows_of(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, mark, dim, v) of each usable vector, once; mark tells a row's vector apart."""
    own = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where("id is not null").where(usable(F.col("v")))
    v = F.transform("v", lambda x: x + 0.0)  # -0.0 and 0.0 are one
    own = own.select("id", F.concat(F.hex(F.xxhash64(F.lit(1), v)), F.hex(F.xxhash64(F.lit(2), v))).alias("mark"), F.size("v").alias("dim"), "v")
    return own.groupBy("id", "mark").agg(F.first("dim").alias("dim"), F.first("v").alias("v"))


def fitted(rows: DataFrame, seed: int) -> dict[int, np.ndarray]:
    """Centroids by dimension; dimensions with few vectors have one cell around the origin."""
    out = {}
    for r in rows.groupBy("dim").count().where(F.col("count") > CELL).collect():  # one at most for every CELL rows
        share = F.pmod(F.xxhash64(F.lit(seed), "id", "mark"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, 0.95 * SAMPLE / r["count"]))
        sample = rows.where((F.col("dim") == r["dim"]) & share).select("id", "mark", "v").orderBy("id", "mark").toPandas()
        v = np.stack(sample["v"].to_numpy()) if len(sample) else np.zeros((0, r["dim"]))
        cells = min(MOST_CELLS, -(-r["count"] // CELL), len(v) // 4)
        if cells > 1:
            out[r["dim"]] = centroids(v, cells, seed)
    return out


def _best(score_to_beat: np.ndarray, q: np.ndarray, q_id, q_mark, found: pd.DataFrame, center: np.ndarray, turn: np.ndarray, k: int) -> pd.DataFrame:
    """The k best candidates of a block for each of its queries that reach its score to beat."""
    dim = q.shape[1]
    c = np.frombuffer(b"".join(found["vector"]), np.float64).reshape(-1, dim)
    codes = np.frombuffer(b"".join(found["code"]), np.uint64).reshape(len(found), -1)
    c_id, c_mark, length, fit = (found[x].to_numpy(object if x == "mark" else None) for x in ("id", "mark", "length", "fit"))
    at: list[list] = [[], [], [], []]
    turned, center = q @ turn.T, turn @ center
    batch = max(1, (1 << 18) // len(found))
    for i in range(0, len(q), batch):
        near, wide = estimates(turned[i : i + batch], center, codes, length, fit)
        for j in range(len(near)):
            n, beat = i + j, score_to_beat[i + j]
            low = near[j] - wide[j]
            own = np.flatnonzero(c_id == q_id[n])
            own = own[c_mark[own] == q_mark[n]]
            low[own] = -np.inf
            if len(low) > k:
                beat = max(beat, np.partition(low, -k)[-k])
            up = near[j] + wide[j]
            fits = up >= beat
            fits[own] = False
            keep = np.flatnonzero(fits)
            if not len(keep):
                continue
            about = c[keep] @ q[n]
            least = max(np.partition(about, -k)[-k] if len(keep) > k else -np.inf, score_to_beat[n])
            keep = keep[about >= least - 1e-9 * (np.abs(least) if np.isfinite(least) else 0) - 1e-12 * np.abs(about).max()]
            score = np.add.accumulate(c[keep] * q[n], axis=1)[:, -1]  # one after the other, not pairwise
            top = np.lexsort((c_id[keep], -score))[:k]
            for x, y in zip(at, (np.full(len(top), q_id[n]), np.full(len(top), q_mark[n], object), c_id[keep][top], score[top])):
                x.append(y)
    cols = [np.concatenate(x) if x else np.zeros(0, object) for x in at]
    return pd.DataFrame({n: pd.Series(x, dtype=x.dtype) for n, x in zip(("query_id", "mark", "vec_id", "score"), cols)})


def search(vectors: DataFrame, queries: Column, k: int = 20, seed: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The rows for which queries (over id) holds are searched for among all others: query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    ship(spark)
    rows = saved(rows_of(vectors, id_col, vector_col), "vectors")
    known = spark.sparkContext.broadcast(fitted(rows, seed))  # MOST_CELLS * dim numbers at most for a dimension
    origin = lambda at, dim: at[dim] if dim in at else np.zeros((1, dim))

    def coded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        turned: dict[int, np.ndarray] = {}
        for b in batches:
            for dim, part in b.groupby("dim"):
                if dim not in turned:
                    turned[dim] = rotation(dim, seed)
                v = np.stack(part["v"].to_numpy()).astype(np.float64)
                made = encoded(v, origin(known.value, dim), turned[dim])
                yield pd.DataFrame({"id": part["id"].to_numpy(), "mark": pd.Series(list(part["mark"]), dtype=object), "dim": dim, "cell": made["cell"], "code": [x.tobytes() for x in made["code"]], "length": made["length"], "fit": made["fit"], "vector": [x.tobytes() for x in v]})

    first_of_equal = F.row_number().over(W.partitionBy("dim", "mark").orderBy("id"))  # limited before the shuffle, so a hot vector stays small
    candidates = rows.withColumn("_n", first_of_equal).where(F.col("_n") <= k + 1).drop("_n")
    indexed = saved(candidates.mapInPandas(coded, "id long, mark string, dim int, cell int, code binary, length double, fit double, vector binary"), "codes")
    cells = {(r.dim, r.cell): (r.n, r.most) for r in indexed.groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("n"), F.max("length").alias("most")).collect()}
    sizes = spark.sparkContext.broadcast(cells)

    def probes(first: bool):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            most = {}
            for b in batches:
                for dim, part in b.groupby("dim"):
                    at = origin(known.value, dim)
                    if dim not in most:
                        own = [sizes.value.get((dim, i), (0, -1.0)) for i in range(len(at))]
                        most[dim] = np.array([m for _, m in own]), np.array([-(-n // CANDIDATE_BLOCK) for n, _ in own])
                    radius, blocks = most[dim]
                    for i in range(0, len(part), 512):
                        some = part.iloc[i : i + 512]
                        q = np.stack(some["v"].to_numpy()).astype(np.float64)
                        size = np.linalg.norm(q, axis=1)[:, None]
                        bound = np.where(radius >= 0, q @ at.T + size * radius * min(1.0, SPREAD / np.sqrt(dim)), -np.inf)
                        best = np.argsort(-bound, axis=1, kind="stable")[:, :FIRST]
                        look = np.zeros(bound.shape, bool)
                        np.put_along_axis(look, best, True, axis=1)
                        if not first:
                            look = ~look & (bound >= some["beat"].to_numpy(float)[:, None])
                        row, cell = np.nonzero(look & (radius >= 0))
                        n = blocks[cell]
                        row, cell = np.repeat(row, n), np.repeat(cell, n)
                        part_no = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                        packed = [x.tobytes() for x in q]
                        yield pd.DataFrame({"id": some["id"].to_numpy()[row], "mark": pd.Series(some["mark"].to_numpy(object)[row], dtype=object), "dim": dim, "cell": cell, "part": part_no, "beat": some["beat"].to_numpy(float)[row], "vector": [packed[r] for r in row]})

        return run

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "mark": [], "vec_id": [], "score": []})
        dim, cell = int(left["dim"].iloc[0]), int(left["cell"].iloc[0])
        q = np.frombuffer(b"".join(left["vector"]), np.float64).reshape(-1, dim)
        return _best(left["beat"].to_numpy(float), q, left["id"].to_numpy(), left["mark"].to_numpy(object), right, origin(known.value, dim)[cell], rotation(dim, seed), k)

    def looked(asked: DataFrame, first: bool) -> DataFrame:
        keys = ["dim", "cell", "part", "block"]
        made = saved(asked.mapInPandas(probes(first), "id long, mark string, dim int, cell int, part int, beat double, vector binary"), "probes")
        blocks = made.where("part = 0").groupBy("dim", "cell").agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).cast("int").alias("blocks"))  # a row a cell
        left = made.join(F.broadcast(blocks), ["dim", "cell"]).withColumn("block", F.expr("cast(pmod(xxhash64(3, id, mark), blocks) as int)")).drop("blocks")
        sizes_of = F.broadcast(spark.createDataFrame([(d, c, -(-n // CANDIDATE_BLOCK)) for (d, c), (n, _) in cells.items()], "dim int, cell int, parts int"))
        right = indexed.join(sizes_of, ["dim", "cell"]).withColumn("part", F.expr("cast(pmod(xxhash64(4, id, mark), parts) as int)")).drop("parts")
        right = right.join(F.broadcast(blocks), ["dim", "cell"]).withColumn("block", F.expr("explode(sequence(0, blocks - 1))")).drop("blocks")
        some = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(meet, "query_id long, mark string, vec_id long, score double")
        best = F.row_number().over(W.partitionBy("query_id", "mark").orderBy(F.desc("score"), "vec_id"))
        return saved(some.withColumn("rank", best).where(F.col("rank") <= k), "found")

    asked = rows.where(queries).withColumn("beat", F.lit(float("-inf")))
    near = looked(asked, True)
    beat = near.where(F.col("rank") == k).select(F.col("query_id").alias("id"), "mark", F.col("score").alias("_beat"))
    again = rows.where(queries).join(beat, ["id", "mark"], "left").withColumn("beat", F.coalesce("_beat", F.lit(float("-inf")))).drop("_beat")
    every = near.drop("rank").unionByName(looked(again, False).drop("rank"))
    rank = F.row_number().over(W.partitionBy("query_id", "mark").orderBy(F.desc("score"), "vec_id"))
    return every.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def nearest(vectors: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """Searches for the rows whose vec_id is divisible by every, among all rows."""
    return search(vectors, F.col("id") % every == 0, k)
