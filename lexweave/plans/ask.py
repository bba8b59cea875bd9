"""The read path for a batch of questions: seeds, closure, context, assembly, soundness, conflicts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.operators import graph, lexicon, retrieval
from lexweave.sources.bundle import saved


def run(
    nodes: DataFrame,
    edges: DataFrame,
    questions: DataFrame,
    k: int = 8,
    budget: dict = graph.BUDGET,
    index: retrieval.Index | None = None,
    seeder: retrieval.Seeder | None = None,
    min_confidence: float = 0.0,
    glosses: DataFrame | None = None,
    conflicts: DataFrame | None = None,
    visible: DataFrame | None = None,
) -> DataFrame:
    """nodes (node_id, doc_id, seq, text), edges from all_edges(), questions (query_id, text).

    One row per question: context, n_nodes, n_seeds, n_closure, n_context, n_skipped (closure steps not taken), violations (of the
    cited seeds), n_conflicts (pairs of conflicts (a_id, b_id) that touch the context), sound. glosses (surface, gloss) are
    spliced into the context; visible (query_id, doc_id) limits what a question may see, at every step.
    """
    index = index or retrieval.build(nodes.select(F.col("node_id").alias("id"), "text"))
    scored = saved(retrieval.scores(index, questions), "scores")
    seeds = seeder(questions, k) if seeder else retrieval.top(scored, k)
    seeds = seeds.select("query_id", F.col("id").alias("node_id"))
    if visible is not None:
        allowed = visible.select("query_id", "doc_id").distinct()
        seeds = seeds.join(nodes.select("node_id", "doc_id"), "node_id").join(allowed, ["query_id", "doc_id"], "left_semi").select("query_id", "node_id")
    seeds = saved(seeds, "seeds")
    walk = graph.steps(edges, "closure")
    reached, skipped = graph.closure(seeds, walk, nodes, min_confidence, visible=visible)
    relevance = retrieval.relevance(scored).withColumnRenamed("id", "node_id")
    around = graph.context(reached.select("query_id", "node_id"), graph.steps(edges, "context"), nodes, edges, relevance, budget, visible)
    around = saved(around.select("query_id", "node_id"), "context")
    shown = reached.select("query_id", "node_id", F.when(F.col("hops") == 0, "seed").otherwise("closure").alias("origin")).unionByName(around.withColumn("origin", F.lit("context")))
    shown = saved(shown, "shown")
    counts = shown.groupBy("query_id").agg(*[F.count_if(F.col("origin") == o).alias(f"n_{o}s" if o == "seed" else f"n_{o}") for o in ("seed", "closure", "context")])
    checked = walk.where(F.col("confidence") >= min_confidence)
    bad = graph.violations(seeds, checked, shown, nodes).groupBy("query_id").agg(F.count(F.lit(1)).alias("violations"))
    lost = skipped.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_skipped"))
    if glosses is None:
        text = graph.assembled(shown, nodes)
    else:
        own = shown.select("query_id", "node_id").distinct().join(nodes.select("node_id", "doc_id", "seq", "text"), "node_id").select("query_id", "doc_id", "seq", "text")
        text = graph.joined(lexicon.spliced(own, glosses))
    out = questions.select("query_id").join(text, "query_id", "left").join(counts, "query_id", "left").join(lost, "query_id", "left").join(bad, "query_id", "left")
    if conflicts is not None:
        ends = conflicts.select(F.struct("a_id", "b_id").alias("pair"), F.explode(F.array("a_id", "b_id")).alias("node_id"))
        found = shown.select("query_id", "node_id").join(ends, "node_id").groupBy("query_id").agg(F.count_distinct("pair").alias("n_conflicts"))
        out = out.join(found, "query_id", "left")
    else:
        out = out.withColumn("n_conflicts", F.lit(0).cast("long"))
    zero = ("n_nodes", "n_seeds", "n_closure", "n_context", "n_skipped", "violations", "n_conflicts")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in zero}).withColumn("sound", F.col("violations") == 0)
