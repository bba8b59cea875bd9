"""Retrieval: TF-IDF, vectors, rank fusion. The index is three tables, built once for a batch of queries."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import IntegerType, StructField, StructType

from lexweave.functions.text import tokens
from lexweave.sources.bundle import saved

QUERY_BLOCK, VECTOR_BLOCK, CANDIDATES = 1000, 2000, 1_000_000
FREQUENT = 200_000
"""Terms whose idf every task knows, at most."""
ASKED, CELLS, BLOCK_CELLS = 200_000, 4_000_000, 2_000_000
"""Most words of questions, and words times questions, that meet texts as matrices; cells of a block (postings times questions)."""


@dataclass
class Index:
    """postings (id, terms: a text's distinct terms in order, counts: of each), idf (term, df, idf), norm (id, norm)."""

    postings: DataFrame
    idf: DataFrame
    norm: DataFrame

    @property
    def tf(self) -> DataFrame:
        return _tf(self.postings)


def _tf(postings: DataFrame) -> DataFrame:
    """id, term, tf."""
    return postings.select("id", F.explode(F.arrays_zip("terms", "counts")).alias("x")).select("id", F.col("x.terms").alias("term"), F.col("x.counts").alias("tf"))


def _postings(texts: DataFrame) -> DataFrame:
    """Terms are counted within a text's row; only texts that share an id meet in a shuffle."""
    kind = texts.schema["id"].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, of = b.column("words").flatten(), pc.list_parent_indices(b.column("words")).to_numpy(zero_copy_only=False)
            code = words.dictionary_encode().indices.to_numpy(zero_copy_only=False)
            new = np.ones(len(code), bool)
            new[1:] = (code[1:] != code[:-1]) | (of[1:] != of[:-1])
            first = np.flatnonzero(new)
            yield _lists(b.column("id"), of[first], {"terms": words.take(pa.array(first)), "counts": pa.array(np.diff(first, append=len(code)), pa.int64())})

    own = texts.select("id", F.sort_array(tokens(F.col("text"))).alias("words"))
    made = saved(own.mapInArrow(count, f"id {kind}, terms array<string>, counts array<bigint>"), "postings")
    if not made.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").take(1):
        return made
    met = _tf(made).groupBy("id", "term").agg(F.sum("tf").alias("tf")).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("term", "tf"))).alias("x"))
    return saved(met.select("id", F.col("x.term").alias("terms"), F.col("x.tf").alias("counts")), "postings")


def _lists(ids: pa.Array, of: np.ndarray, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    """ids and lists of columns, whose values belong to the ids at the places `of` (in order); ids without any are left out."""
    size = np.bincount(of, minlength=len(ids)) if len(of) else np.zeros(len(ids), int)
    offsets = pa.array(np.concatenate([[0], np.cumsum(size[size > 0])]), pa.int32())
    return pa.RecordBatch.from_arrays([ids.filter(pa.array(size > 0)), *(pa.ListArray.from_arrays(offsets, c) for c in columns.values())], ["id", *columns])


def _places(b: pa.RecordBatch, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Of all postings of a batch: the place of their text, the place of their term in words (-1: not there), count, term."""
    lists = b.column("terms")
    terms = lists.flatten()
    at = pc.fill_null(pc.index_in(terms, value_set=pa.array(words, terms.type)), -1).to_numpy(zero_copy_only=False)
    return pc.list_parent_indices(lists).to_numpy(zero_copy_only=False), at, b.column("counts").flatten().to_numpy(zero_copy_only=False), terms


def build(texts: DataFrame) -> Index:
    """texts: (id, text). Postings and idf are kept in the shared folder."""
    postings = _postings(texts)
    n, total = postings.agg(F.count("id"), F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()
    df = postings.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = saved(df.withColumn("idf", F.log(1 + F.lit(max(n, 1)) / (1 + F.col("df")))), "idf")
    return Index(postings, idf, _norms(postings, idf, total))


def _norms(postings: DataFrame, idf: DataFrame, total: int) -> DataFrame:
    """id, norm. A term with that share of all postings is one of FREQUENT at most: each task knows them; only the other terms' postings, a few of all, are shuffled."""
    kind, many = postings.schema["id"].dataType.simpleString(), F.col("df") * FREQUENT >= total
    often = idf.where(many).select("term", "idf").toPandas()
    words, weight = list(often["term"]), np.append(often["idf"].to_numpy(float), 0.0)

    def squares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of, at, counts, _ = _places(b, words)
            s = np.bincount(of, (counts * weight[at]) ** 2, b.num_rows) if len(of) else np.zeros(b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(s, pa.float64())], ["id", "s"])

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of, at, counts, terms = _places(b, words)
            left = pa.array(np.flatnonzero(at < 0))
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(of).take(left)), terms.take(left), pa.array(counts, pa.int64()).take(left)], ["id", "term", "tf"])

    seldom = postings.mapInArrow(others, f"id {kind}, term string, tf bigint").join(idf.where(~many).select("term", "idf"), "term")
    more = seldom.groupBy("id").agg(F.sum(F.pow(F.col("tf") * F.col("idf"), 2)).alias("s"))
    return postings.mapInArrow(squares, f"id {kind}, s double").unionByName(more).groupBy("id").agg(F.sqrt(F.sum("s")).alias("norm"))


def scores(index: Index, queries: DataFrame) -> DataFrame:
    """queries: (query_id, text). query_id, id, score of all texts that share a term: sum of tf * idf^2 over distinct query terms, by the text's norm."""
    return _scores(index, queries, None)


def best(index: Index, queries: DataFrame, k: int) -> DataFrame:
    """top() of scores(); where the questions are few, only the k best of each block of texts leave it."""
    return top(_scores(index, queries, k), k)


def _scores(index: Index, queries: DataFrame, k: int | None) -> DataFrame:
    """scores(), or with k at least what top() of k needs of them."""
    terms = queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times"))
    asked = terms.limit(ASKED + 1).collect()
    ids = list(dict.fromkeys(r.query_id for r in asked))
    words = sorted({r.term for r in asked})
    if len(asked) <= ASKED and len(ids) * len(words) <= CELLS:
        return _few(index, queries, k, asked, ids, words)
    met = index.tf.join(terms.join(index.idf, "term"), "term").groupBy("query_id", "id").agg(F.sum(F.col("tf") * F.col("times") * F.col("idf") * F.col("idf")).alias("dot"))
    return met.join(index.norm, "id").select("query_id", "id", F.round(F.col("dot") / F.when(F.col("norm") > 0, F.col("norm")).otherwise(1.0), 9).alias("score"))


def _few(index: Index, queries: DataFrame, k: int | None, asked: list, ids: list, words: list[str]) -> DataFrame:
    """_scores() of a bounded number of questions: a text's matched terms come together in one row, and blocks of texts meet all questions as matrices."""
    spark = queries.sparkSession
    wanted = spark.createDataFrame([(w,) for w in words], "term string")
    idf = {r.term: r.idf for r in index.idf.join(F.broadcast(wanted), "term").select("term", "idf").collect()}
    words = [w for w in words if w in idf]
    row, column = {w: i for i, w in enumerate(words)}, {q: i for i, q in enumerate(ids)}
    cells = [(row[r.term], column[r.query_id], r.times * idf[r.term] ** 2) for r in asked if r.term in row]
    kind = index.postings.schema["id"].dataType.simpleString()

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of, at, counts, _ = _places(b, words)
            hit = at >= 0
            yield _lists(b.column("id"), of[hit], {"at": pa.array(at[hit], pa.int32()), "counts": pa.array(counts[hit], pa.int64())})

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = np.zeros((len(words), len(ids)))
        for i, j, w in cells:
            weight[i, j] = w
        most = max(1, BLOCK_CELLS // max(1, len(ids)))
        for whole in batches:
            whole = whole.take(pc.sort_indices(whole.column("id")))  # so that ties go to smaller ids
            for lo in range(0, whole.num_rows, most):
                b = whole.slice(lo, most)
                lists, norm = b.column("at"), b.column("norm").to_numpy(zero_copy_only=False)
                at, counts = (b.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("at", "counts"))
                ends = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))
                starts, score, i = np.concatenate([[0], ends[:-1]]), np.empty((len(ids), len(ends))), 0
                while i < len(ends):
                    j = max(i + 1, int(np.searchsorted(ends, starts[i] + most, "right")))  # one text may have more postings, up to all words asked for
                    a, z = starts[i], ends[j - 1]
                    score[:, i:j] = np.add.reduceat(counts[a:z, None] * weight[at[a:z]], starts[i:j] - a, axis=0).T
                    i = j
                yield told(b.column("id"), score, np.where(norm > 0, norm, 1.0))

    def told(own: pa.Array, score: np.ndarray, norm: np.ndarray) -> pa.RecordBatch:
        shares = score > 0
        score = np.floor(score / norm * 1e9 + 0.5) / 1e9
        if k is None:
            q, d = np.nonzero(shares)
        else:
            order = np.argsort(-score, axis=1, kind="stable")[:, :k]
            q, d = np.repeat(np.arange(len(ids)), order.shape[1]), order.ravel()
            q, d = q[score[q, d] > 0], d[score[q, d] > 0]
        return pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), own.take(pa.array(d)), pa.array(score[q, d])], ["_q", "id", "score"])

    matched = index.postings.mapInArrow(match, f"id {kind}, at array<int>, counts array<bigint>")
    met = matched.join(index.norm, "id").mapInArrow(meet, f"_q int, id {kind}, score double")
    names = spark.createDataFrame([(i, q) for i, q in enumerate(ids)], StructType([StructField("_q", IntegerType()), StructField("query_id", queries.schema["query_id"].dataType)]))
    return met.join(F.broadcast(names), "_q").select("query_id", "id", "score")


def top(scored: DataFrame, k: int, score: str = "score") -> DataFrame:
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc(score), "id"))
    return scored.where(F.col(score) > 0).withColumn("rank", rank).where(F.col("rank") <= k)


def relevance(scored: DataFrame) -> DataFrame:
    """query_id, id, relevance: score by the query's best, 1 at most."""
    best = F.max("score").over(W.partitionBy("query_id"))
    return scored.select("query_id", "id", F.least(F.lit(1.0), F.col("score") / F.when(best > 0, best).otherwise(1.0)).alias("relevance"))


def cosine(a: Column, b: Column) -> Column:
    """0 if either has no length; the dot product ends with the shorter vector."""
    n = F.least(F.size(a), F.size(b))
    cut = lambda v: F.slice(v.cast("array<double>"), F.lit(1), n)
    dot = F.aggregate(F.zip_with(cut(a), cut(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    length = lambda v: F.sqrt(F.aggregate(v.cast("array<double>"), F.lit(0.0), lambda s, x: s + x * x))
    return F.when((length(a) > 0) & (length(b) > 0), dot / (length(a) * length(b))).otherwise(0.0)


def vector_top(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The k vectors (id, vector) of the highest cosine() above 0 for each query (query_id, vector), with score and rank.

    Queries and vectors meet in blocks, each pair of which gives its k best; vectors that hold a null or NaN have no score.
    """
    shards, blocks = -(-max(1, vectors.count()) // VECTOR_BLOCK), -(-max(1, queries.count()) // QUERY_BLOCK)
    dealt = lambda name, n: F.pmod(F.xxhash64(F.lit(n), name), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    doubles = F.col("vector").cast("array<double>").alias("v")
    some = F.coalesce(~F.exists("vector", lambda x: x.isNull()), F.lit(False))
    c = vectors.where(some).select("id", doubles, dealt("id", shards).alias("shard")).withColumn("block", every(blocks))
    q = queries.where(some).select("query_id", doubles, dealt("query_id", blocks).alias("block")).withColumn("shard", every(shards))

    def units(rows: pd.Series, dim: int) -> np.ndarray:
        v = np.zeros((len(rows), dim))
        for i, x in enumerate(rows):
            v[i, : len(x)] = x
        length = np.sqrt((v * v).sum(axis=1, keepdims=True))
        return v / np.where(length > 0, length, 1.0)

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = [left["query_id"].iloc[:0]], [right["id"].iloc[:0]], [np.zeros(0)]
        if len(left) and len(right):
            dim = max(left["v"].map(len).max(), right["v"].map(len).max())
            near = np.round(units(left["v"], dim) @ units(right["v"], dim).T, 9)
            ids = right["id"].to_numpy()
            for query, row in zip(left["query_id"], near):
                best = np.flatnonzero(row > 0)
                if len(best) > k:
                    best = best[row[best] >= np.partition(row[best], -k)[-k]]
                best = best[np.lexsort((ids[best], -row[best]))][:k]
                out[0].append(pd.Series([query] * len(best), dtype=left["query_id"].dtype))
                out[1].append(pd.Series(ids[best]))
                out[2].append(row[best])
        return pd.DataFrame({"query_id": pd.concat(out[0], ignore_index=True), "id": pd.concat(out[1], ignore_index=True), "score": np.concatenate(out[2])})

    types = {n: df.schema[n].dataType.simpleString() for df, n in ((queries, "query_id"), (vectors, "id"))}
    met = q.groupBy("block", "shard").cogroup(c.groupBy("block", "shard")).applyInPandas(meet, f"query_id {types['query_id']}, id {types['id']}, score double")
    return top(met, k)


def fused(*ranked: DataFrame, k: int = 60) -> DataFrame:
    """Rank lists (query_id, id, rank, source) as query_id, id, score (sum of 1 / (k + rank)), sources."""
    every = ranked[0]
    for r in ranked[1:]:
        every = every.unionByName(r)
    return every.groupBy("query_id", "id").agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 9).alias("score"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))


def reranked(candidates: DataFrame, texts: DataFrame, queries: DataFrame, score: Column, k: int) -> DataFrame:
    """candidates (query_id, id) that have a text, by score: an expression over query and text, such as a pandas UDF."""
    few = saved(candidates.select("query_id", "id"), "candidates")
    few = F.broadcast(few) if few.limit(CANDIDATES + 1).count() <= CANDIDATES else few  # texts then stay where they are
    own = few.join(texts.select("id", "text"), "id").join(queries.select("query_id", F.col("text").alias("query")), "query_id")
    return top(own.withColumn("score", score), k)


def search(texts: DataFrame, queries: DataFrame, k: int, where: Column | str | None = None) -> DataFrame:
    """The k best of the texts (id, text and what the filter needs) that the filter lets through; terms are weighed over all texts."""
    index = build(texts.select("id", "text"))
    if where is None:
        return best(index, queries, k)
    return best(replace(index, norm=index.norm.join(texts.where(where).select("id"), "id", "left_semi")), queries, k)


Seeder = Callable[[DataFrame, int], DataFrame]
"""Gives (query_id, id, rank) of the k best nodes for queries (query_id, text)."""


def lexical_seeder(index: Index) -> Seeder:
    return lambda queries, k: best(index, queries, k).select("query_id", "id", "rank")


def hybrid_seeder(index: Index, vectors: DataFrame, embed: Callable[[Column], Column]) -> Seeder:
    """Words and vectors (id, vector), three times k of each, fused by rank. embed must be what made the vectors."""

    def run(queries: DataFrame, k: int) -> DataFrame:
        sparse = best(index, queries, 3 * k)
        dense = vector_top(vectors, queries.select("query_id", embed(F.col("text")).alias("vector")), 3 * k)
        both = fused(*(r.select("query_id", "id", "rank", F.lit(n).alias("source")) for r, n in ((dense, "dense"), (sparse, "sparse"))))
        return top(both, k).select("query_id", "id", "rank")

    return run


def rerank_seeder(seeder: Seeder, texts: DataFrame, score: Column, wider: int = 4) -> Seeder:
    """The best by score (over query and text) of `wider` times k seeds; seeds without a text are dropped."""
    return lambda queries, k: reranked(seeder(queries, k * wider).select("query_id", "id"), texts, queries, score, k).select("query_id", "id", "rank")


MODES = ("lexical", "hybrid", "hybrid-rerank")


def seeder_of(mode: str, texts: DataFrame, vectors: DataFrame | None = None, embed: Callable[[Column], Column] | None = None, score: Column | None = None) -> Seeder:
    """A seeder by the name of its mode. texts and vectors: (id, text), (id, vector)."""
    if mode not in MODES:
        raise ValueError(f"mode {mode!r} is none of {', '.join(MODES)}")
    index = build(texts)
    if mode == "lexical":
        return lexical_seeder(index)
    if vectors is None or not vectors.take(1):
        raise ValueError(f"{mode} needs vectors; embed first")
    hybrid = hybrid_seeder(index, vectors, embed)
    return hybrid if mode == "hybrid" else rerank_seeder(hybrid, texts, score)
