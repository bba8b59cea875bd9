"""Lookups in batches: nodes, sections, neighbours, vectors, versions, and what a tenant or a date lets through."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lexweave.operators import graph


def get_nodes(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """ids (node_id) with the columns of nodes, and found."""
    return ids.select("node_id").distinct().join(nodes.withColumn("found", F.lit(True)), "node_id", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def get_sections(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """For each id (node_id as anchor_id), the nodes of its document and section path; only itself where it has no path."""
    at = nodes.join(ids.select("node_id").distinct(), "node_id", "left_semi").select(F.col("node_id").alias("anchor_id"), "doc_id", "section_path")
    lone = F.coalesce("section_path", F.lit("")) == ""
    whole = at.where(~lone).join(nodes.select("doc_id", "section_path", "node_id", "seq"), ["doc_id", "section_path"])
    alone = at.where(lone).join(nodes.select(F.col("node_id").alias("anchor_id"), "seq"), "anchor_id").withColumn("node_id", F.col("anchor_id"))
    cols = ["anchor_id", "node_id", "doc_id", "seq"]
    return whole.select(cols).unionByName(alone.select(cols))


def neighbors(edges: DataFrame, ids: DataFrame, types: tuple[str, ...] | None = None, direction: str = "both") -> DataFrame:
    """node_id, neighbor_id, type, direction (out, in) of the edges of ids."""
    own = edges if types is None else edges.where(F.col("type").isin(*types))
    end = lambda at, to, name: F.struct(F.col(at).alias("node_id"), F.col(to).alias("neighbor_id"), "type", F.lit(name).alias("direction"))
    ends = {"out": [end("src", "dst", "out")], "in": [end("dst", "src", "in")]}
    ends["both"] = ends["out"] + ends["in"]
    # edges are passed over once, whatever they are derived from
    every = own.select(F.explode(F.array(*ends[direction])).alias("e")).select("e.*")
    return every.join(ids.select("node_id"), "node_id", "left_semi")


def vector_models(vectors: DataFrame) -> DataFrame:
    """model_id, vectors, computed_at: the models that have vectors, the latest first."""
    return vectors.groupBy("model_id").agg(F.count(F.lit(1)).alias("vectors"), F.max("computed_at").alias("computed_at")).orderBy(F.desc("computed_at"), "model_id")


def has_vectors(vectors: DataFrame) -> bool:
    return bool(vectors.take(1))


def embedded_ids(vectors: DataFrame, model_id: str) -> DataFrame:
    return vectors.where(F.col("model_id") == model_id).select("node_id").distinct()


def as_of(rows: DataFrame, at: Column, since: str = "valid_from", until: str = "valid_to") -> DataFrame:
    """Rows in force at a time: from since on (open if null), before until (open if null)."""
    return rows.where((F.col(since).isNull() | (F.col(since) <= at)) & (F.col(until).isNull() | (F.col(until) > at)))


def timeline(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> DataFrame:
    """ids (node_id) as query_id, node_id, hops, dated, place: what supersedes or amends a node, directly or not, in order of date."""
    walk = graph.steps(edges.where(F.col("type").isin("supersedes", "amends")), "closure")
    reached, _ = graph.closure(ids.select(F.col("node_id").alias("query_id"), "node_id"), walk, nodes)
    own = reached.select("query_id", "node_id", "hops").join(nodes.select("node_id", "dated"), "node_id")
    return own.withColumn("place", F.row_number().over(W.partitionBy("query_id").orderBy(F.col("dated").asc_nulls_first(), "hops", "node_id")))


def current_versions(chains: DataFrame) -> DataFrame:
    """timeline() rows as query_id, current_id: the last dated one of each chain, in whatever order versions came in."""
    return chains.groupBy("query_id").agg(F.max_by("node_id", F.struct(F.coalesce("dated", F.lit("")), "hops", "node_id")).alias("current_id"))


def same_entities(rows: DataFrame, *keys: Column) -> DataFrame:
    """rows (id) that share a normalised strong key, as src, dst, type, confidence: each with the smallest id of its key, so a common key makes no pairs."""
    every = None
    for n, key in enumerate(keys):
        flat = F.lower(F.regexp_replace(key, r"(?U)[^\p{L}\p{N}]+", ""))
        own = rows.select("id", F.lit(n).alias("n"), flat.alias("key")).where("key != ''")
        every = own if every is None else every.unionByName(own)
    least = every.groupBy("n", "key").agg(F.min("id").alias("dst"), F.count_distinct("id").alias("m")).where("m > 1")
    met = every.join(least, ["n", "key"]).where("id != dst")
    return met.select(F.col("id").alias("src"), "dst", F.lit("possibly_same_as").alias("type"), F.lit(0.6).alias("confidence")).distinct()


def verified_pairs(pairs: DataFrame, verdict: Column, least: float = 0.5) -> DataFrame:
    """Candidate pairs (src, dst, text of both) whose verdict, an expression or UDF, reaches least; it becomes their confidence."""
    return pairs.withColumn("confidence", verdict).where(F.col("confidence") >= least)
