"""From files to a bundle: parse, gate, normalise, define, link. Only joins and windows by document follow the parse."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave import ship
from lexweave.operators import edges, lexicon, parse
from lexweave.sources import bundle

TABLES = ("documents", "blobs", "nodes", "terms", "edges")


def files(spark: SparkSession, path: str, pattern: str = "*.{txt,md}") -> DataFrame:
    return with_ids(spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path).select("path", "content"))


def with_ids(raw: DataFrame) -> DataFrame:
    """raw (path, content) with doc_id, the start of the content's hash; of equal contents the smallest path stays."""
    own = raw.withColumn("doc_id", F.substring(F.sha2("content", 256), 1, 16))
    return own.groupBy("doc_id").agg(F.min("path").alias("path"), F.min_by("content", "path").alias("content"))


def tables(raw: DataFrame) -> dict[str, DataFrame]:
    """raw: with_ids(). Documents below the gate have a row in documents and blobs only."""
    ship(raw.sparkSession)
    parsed = bundle.saved(parse.units(raw), "units")
    docs = bundle.saved(raw.select("doc_id", "path").join(parse.documents(parsed), "doc_id"), "documents")
    good = parsed.join(docs.where("review_state != 'pending'").select("doc_id"), "doc_id", "left_semi")
    nodes = bundle.saved(edges.siblings(edges.sectioned(parse.nodes(good))), "nodes")
    terms = bundle.saved(lexicon.terms(nodes), "terms")
    made = edges.all_edges(nodes, lexicon.mentions(nodes, terms))
    return {"documents": docs, "blobs": raw.select("doc_id", "content"), "nodes": nodes, "terms": terms, "edges": made}


def ingest(spark: SparkSession, path: str, out: str) -> dict[str, DataFrame]:
    """Reads the files under path, writes a bundle to out and returns its tables and the manifest."""
    bundle.write(tables(files(spark, path)), out)
    made = bundle.read(spark, out, *TABLES)
    bundle.write({"manifest": bundle.manifest(*(made[n] for n in ("documents", "nodes", "terms", "edges")))}, out)
    return bundle.read(spark, out, *TABLES, "manifest")


def summary(made: dict[str, DataFrame], warnings: DataFrame | None = None) -> DataFrame:
    """One row: documents, pending, nodes, terms, edges, closure_edges, warnings."""
    one = made["documents"].agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.col("review_state") == "pending").alias("pending"))
    for name in ("nodes", "terms"):
        one = one.crossJoin(F.broadcast(made[name].agg(F.count(F.lit(1)).alias(name))))  # a row each
    one = one.crossJoin(F.broadcast(made["edges"].agg(F.count(F.lit(1)).alias("edges"), F.count_if(F.col("class") == "closure").alias("closure_edges"))))
    return one.crossJoin(F.broadcast(warnings.agg(F.count(F.lit(1)).alias("warnings")))) if warnings is not None else one.withColumn("warnings", F.lit(0).cast("long"))
