"""The embedding pass: vectors for nodes that lack one of a model, document by document, with failures as rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.functions.text import body
from lexweave.operators.lookup import embedded_ids

HASH_MODEL, HASH_DIM = "sha256-bytes", 8


def hash_vector(text: Column, dim: int = HASH_DIM) -> Column:
    """A deterministic stand-in for a model: the first bytes of the text's SHA-256, scaled to -1 to 1."""
    digest = F.sha2(text, 256)
    return F.array(*[F.conv(F.substring(digest, 2 * i + 1, 2), 16, 10).cast("double") / 127.5 - 1.0 for i in range(dim)])


def hash_embedder(texts: list[str], doc: str) -> list[list[float]]:
    from hashlib import sha256

    return [[b / 127.5 - 1.0 for b in sha256(t.encode()).digest()[:HASH_DIM]] for t in texts]


def pending(nodes: DataFrame, documents: DataFrame, vectors: DataFrame | None, model_id: str) -> DataFrame:
    """doc_id, node_id, seq, text of nodes of accepted documents that have no vector of the model yet."""
    own = nodes.join(documents.where("review_state != 'pending'").select("doc_id"), "doc_id", "left_semi")
    own = own if vectors is None else own.join(embedded_ids(vectors, model_id), "node_id", "left_anti")
    return own.select("doc_id", "node_id", "seq", body(F.col("normalized"), F.col("raw")).alias("text"))


def embed(todo: DataFrame, embedder: Callable[[list[str], str], list[list[float]]], model_id: str, max_batch: int | None = None) -> DataFrame:
    """todo: pending(). node_id, doc_id, model_id, dim, vector, failure of every node.

    The embedder gets texts of one document at a time, at most max_batch of them (all without it). After a batch that fails, or gives
    another number of vectors, the rest of its document is left for the next run; the reason stands in the document's rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        doc, part, at, failure, began = None, [], 0, None, False

        def ended() -> list[tuple]:
            """The rows of the nodes at hand, asked for as one batch."""
            nonlocal part, at, failure
            if part and failure is None:
                try:
                    made = embedder([text for _, text in part], doc)
                    if len(made) != len(part):
                        failure = f"{len(made)} vectors for {len(part)} nodes at {at}"
                except (MemoryError, RuntimeError, ValueError) as e:
                    failure = f"{type(e).__name__}: {e} at {at}"
            vectors = made if part and failure is None else [None] * len(part)
            out = [(n, doc, model_id, None if v is None else len(v), v, failure if v is None else None) for (n, _), v in zip(part, vectors)]
            part, at = [], at + len(part)
            return out

        told = lambda out: pd.DataFrame(out, columns=["node_id", "doc_id", "model_id", "dim", "vector", "failure"]).astype({"dim": "Int32", "failure": object})
        for b in batches:
            out = []
            for own, node, text in zip(b["doc_id"], b["node_id"], b["text"]):
                if not began or own != doc:
                    out += ended()
                    doc, at, failure, began = own, 0, None, True
                part.append((node, text))
                if len(part) == max_batch:
                    out += ended()
            yield told(out)
        yield told(ended())

    # rows of a document follow each other, so a worker holds one batch, not whole documents
    whole = todo.select("doc_id", "seq", "node_id", "text").repartition("doc_id").sortWithinPartitions("doc_id", "seq", "node_id", "text")
    return whole.mapInPandas(run, "node_id string, doc_id string, model_id string, dim int, vector array<double>, failure string")


def summary(made: DataFrame, nodes: DataFrame, documents: DataFrame) -> DataFrame:
    """One row: documents_embedded (all of what they lacked), nodes_embedded, nodes_skipped (had a vector), documents_failed, documents_pending."""
    by = made.groupBy("doc_id").agg(F.count_if(F.col("failure").isNull()).alias("ok"), F.count_if(F.col("failure").isNotNull()).alias("bad"))
    out = by.agg(F.count_if(F.col("bad") == 0).alias("documents_embedded"), F.coalesce(F.sum("ok"), F.lit(0)).alias("nodes_embedded"), F.count_if(F.col("bad") > 0).alias("documents_failed"), F.coalesce(F.sum(F.col("ok") + F.col("bad")), F.lit(0)).alias("_seen"))
    waiting = documents.agg(F.count_if(F.col("review_state") == "pending").alias("documents_pending"))
    there = nodes.join(documents.where("review_state != 'pending'").select("doc_id"), "doc_id", "left_semi").agg(F.count(F.lit(1)).alias("_all"))
    one = out.crossJoin(F.broadcast(waiting)).crossJoin(F.broadcast(there))  # a row each
    return one.withColumn("nodes_skipped", F.col("_all") - F.col("_seen")).drop("_all", "_seen")
