"""python -m lexweave ingest|query|embed|extract: the engine from the command line, over bundles of Parquet tables."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.functions.text import rendered
from lexweave.operators import analytics, conflict, edges, embed, extract, graph, lexicon, retrieval
from lexweave.plans import ask
from lexweave.sources import bundle, ingest


def opened(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return bundle.read(spark, path, *ingest.TABLES)


def vectors_of(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(f"{path}/vectors")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None


def shown(nodes: DataFrame, documents: DataFrame) -> DataFrame:
    """nodes with the text that they stand for in a context."""
    own = nodes.join(documents.select("doc_id", "status"), "doc_id", "left")
    return own.withColumn("text", rendered(F.coalesce("status", F.lit("current")), F.col("section_path"), F.col("normalized"), F.col("raw")))


def claims(nodes: DataFrame) -> DataFrame:
    heads = edges.headings(nodes).select(F.col("heading_id").alias("section_id"), F.col("number").alias("section")).dropDuplicates(["section_id"])
    return conflict.claims(nodes.join(heads, "section_id", "left"))


def ask_bundle(spark: SparkSession, path: str, text: str, k: int, tokens: int, least: float, with_glosses: bool, with_vectors: bool, with_rerank: bool) -> dict:
    tables = opened(spark, path)
    nodes = bundle.saved(shown(tables["nodes"], tables["documents"]), "nodes")
    texts = nodes.select(F.col("node_id").alias("id"), "text")
    index = retrieval.build(texts)
    seeder = retrieval.lexical_seeder(index)
    vectors = vectors_of(spark, path) if with_vectors else None
    if vectors is not None:
        seeder = retrieval.hybrid_seeder(index, vectors.where(F.col("model_id") == embed.HASH_MODEL).select(F.col("node_id").alias("id"), "vector"), embed.hash_vector)
    if with_rerank:
        seeder = retrieval.rerank_seeder(seeder, texts, analytics.overlap(F.col("query"), F.col("text")))
    questions = spark.createDataFrame([("q", text)], "query_id string, text string")
    glosses = lexicon.glossary(tables["terms"]) if with_glosses else None
    made = ask.run(nodes, tables["edges"], questions, k, graph.BUDGET | {"max_tokens": tokens}, index, seeder, least, glosses, bundle.saved(conflict.mutual(claims(nodes)), "conflicts"))
    return made.first().asDict()


def embed_bundle(spark: SparkSession, path: str, batch: int) -> dict:
    tables, old = opened(spark, path), vectors_of(spark, path)
    made = bundle.saved(embed.embed(embed.pending(tables["nodes"], tables["documents"], old, embed.HASH_MODEL), embed.hash_embedder, embed.HASH_MODEL, batch), "vectors")
    made.where("failure is null").drop("failure").withColumn("computed_at", F.current_timestamp()).write.mode("append").parquet(f"{path}/vectors")
    return embed.summary(made, tables["nodes"], tables["documents"]).first().asDict()


def extract_bundle(spark: SparkSession, path: str, model: extract.Model | None, model_id: str) -> dict:
    """Without a model, what a pass would cost. With one, its edges replace those of the bundle that it changed."""
    tables = opened(spark, path)
    nodes = bundle.saved(tables["nodes"], "nodes")
    if model is None:
        gate, clashes = extract.plan(nodes.join(claims(nodes).select("node_id", "section").dropDuplicates(["node_id"]), "node_id", "left"))
        return gate.first().asDict() | {"conflicts": clashes.count()}
    before = bundle.saved(tables["edges"], "edges")
    made = extract.run(nodes, before, model, model_id)
    new = made["edges"].withColumns({"source": F.lit(4), "class": F.lit("closure")}).select(before.columns)
    after = bundle.saved(made["reconciled"].select(before.columns).unionByName(new), "edges")
    bundle.write({"edges": after}, path)
    return extract.summary(made, before).first().asDict()


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    top = argparse.ArgumentParser(prog="lexweave", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)
    add = commands.add_parser("ingest", help="files of a folder to a bundle")
    add.add_argument("folder")
    add.add_argument("-o", "--out", required=True)
    add = commands.add_parser("query", help="what a question needs, and whether it is complete")
    add.add_argument("bundle")
    add.add_argument("question")
    add.add_argument("-k", type=int, default=8)
    add.add_argument("--max-tokens", type=int, default=graph.BUDGET["max_tokens"])
    add.add_argument("--min-confidence", type=float, default=0.0)
    for flag in ("--glosses", "--use-vectors", "--rerank"):
        add.add_argument(flag, action="store_true")
    add = commands.add_parser("embed", help="vectors for the nodes that lack one")
    add.add_argument("bundle")
    add.add_argument("--max-batch", type=int, default=32)
    add = commands.add_parser("extract", help="what a model pass would cost (models are passed to extract_bundle() in code)")
    add.add_argument("bundle")
    a = top.parse_args(args)
    spark = spark or SparkSession.builder.appName("lexweave").getOrCreate()
    if a.command == "ingest":
        made = ingest.ingest(spark, a.folder, a.out)
        out = {r.key: r.value for r in made["manifest"].collect()}
    elif a.command == "query":
        out = ask_bundle(spark, a.bundle, a.question, a.k, a.max_tokens, a.min_confidence, a.glosses, a.use_vectors, a.rerank)
    elif a.command == "embed":
        out = embed_bundle(spark, a.bundle, a.max_batch)
    else:
        out = extract_bundle(spark, a.bundle, None, "")
    print(json.dumps(out, ensure_ascii=False, indent=1, default=str))
    return 0


if __name__ == "__main__":
    sys.exit(main())
