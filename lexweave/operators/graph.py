"""Traversal: policy, closure to a fixed point, budgeted context, assembly, soundness. Queries are a batch keyed by query_id."""

from __future__ import annotations

from heapq import heapify, heappop, heappush
from itertools import count

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lexweave.functions.text import keys, token_estimate
from lexweave.sources.bundle import saved

# Results depend on exactly these numbers.

#: type: direction, prior, most hops from the seed (null: any)
POLICY = {
    "exception_of": ("reverse", 1.0, None), "supersedes": ("reverse", 1.0, None), "amends": ("reverse", 1.0, None), "conditioned_on": ("forward", 1.0, None), "defines": ("forward", 0.9, 2),
    "elaborates": ("forward", 0.5, 2), "exemplifies": ("forward", 0.3, 1), "supports": ("forward", 0.3, 1), "contradicts": ("both", 0.6, 1), "cites": ("forward", 0.4, 1),
    "part_of": ("forward", 0.4, 1), "similar_to": ("none", 0.0, 0), "possibly_same_as": ("both", 0.2, 1),
}
BUDGET = {"max_tokens": 8000, "cross_doc_penalty": 0.4, "hop_decay": 0.7, "min_edge_confidence": 0.5, "saturation_window": 5}

# End of the fixed values.


def policy_of(type_: Column, class_: Column, overrides: dict | None = None) -> Column:
    """struct(direction, prior, max_hops); unknown types fall back to their class's default."""
    as_struct = lambda d, p, h: F.struct(F.lit(d).alias("direction"), F.lit(p).alias("prior"), F.lit(h).cast("int").alias("max_hops"))
    out = F.when(class_ == "closure", as_struct("reverse", 1.0, None)).otherwise(as_struct("forward", 0.4, 1))
    for name, rule in (POLICY | (overrides or {})).items():
        out = F.when(type_ == name, as_struct(*rule)).otherwise(out)
    return out


def steps(edges: DataFrame, class_: str, overrides: dict | None = None) -> DataFrame:
    """edges turned the way that a query walks: from_id, to_id, edge_id, type, confidence, prior, max_hops, cross_doc."""
    own = edges.where(F.col("class") == class_).withColumn("p", policy_of(F.col("type"), F.col("class"), overrides))
    cross = F.col("cross_doc") if "cross_doc" in edges.columns else F.lit(False)
    turn = lambda n, a, b, ways: F.when(F.col("p.direction").isin(*ways), F.struct(F.col(a).alias("from_id"), F.col(b).alias("to_id"), F.lit(n).alias("turn")))
    turns = F.array_compact(F.array(turn(0, "dst", "src", ("reverse", "both")), turn(1, "src", "dst", ("forward", "both"))))
    # edges are passed over once, whatever they are derived from
    own = own.select("edge_id", "type", "confidence", "p", cross.alias("cross_doc"), F.explode_outer(turns).alias("t")).where("t is not null")
    return own.select("t.from_id", "t.to_id", "t.turn", "edge_id", "type", "confidence", F.col("p.prior").alias("prior"), F.col("p.max_hops").alias("max_hops"), "cross_doc")


def closure(seeds: DataFrame, walk: DataFrame, nodes: DataFrame, min_confidence: float = 0.0, most: int | None = None, visible: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """seeds (query_id, node_id) to their fixed point over walk (steps of class closure).

    Returns arrivals (query_id, node_id, hops, via) and skipped (query_id, edge_id, to_id, reason). Steps are matched with nodes
    once; each round joins the newest arrivals with the steps and leaves out what was reached before; rounds end when nothing is
    new. If they end after most rounds instead, the steps that were left to take are in skipped. visible: (query_id, doc_id)
    that a query may see; within each round, steps to nodes of other documents are not taken, and are in skipped.
    """
    there = nodes.select(F.col("node_id").alias("to_id"), (F.col("doc_id") if "doc_id" in nodes.columns else F.lit(None).cast("string")).alias("to_doc"), F.lit(True).alias("there")).dropDuplicates(["to_id"])
    walk = saved(walk.join(there, "to_id", "left"), "steps")
    front = saved(seeds.select("query_id", "node_id").distinct().withColumns({"hops": F.lit(0), "via": F.lit(None).cast("string")}), "front")
    seen, skipped = front, None
    for hop in count(1):
        met = front.select("query_id", F.col("node_id").alias("from_id")).join(walk, "from_id")
        if visible is not None:
            met = met.join(visible.select("query_id", F.col("doc_id").alias("to_doc"), F.lit(True).alias("seen")).distinct(), ["query_id", "to_doc"], "left")
        weak, capped = F.col("confidence") < min_confidence, F.coalesce(F.col("max_hops") < hop, F.lit(False))
        reason = F.when(weak, "below minimum confidence").when(capped, F.concat("type", F.lit(" is capped at "), "max_hops", F.lit(" hops"))).when(F.col("there").isNull(), "node not in graph")
        reason = reason.when(F.col("seen").isNull(), "document not visible") if visible is not None else reason
        met = saved(met.withColumn("reason", reason).select("query_id", "to_id", "edge_id", "turn", "reason"), "met")
        lost = met.where("reason is not null").select("query_id", "edge_id", "to_id", "reason")
        skipped = lost if skipped is None else skipped.unionByName(lost)
        new = met.where("reason is null").join(seen.select("query_id", F.col("node_id").alias("to_id")), ["query_id", "to_id"], "left_anti")
        if most is not None and hop > most:
            skipped = skipped.unionByName(new.select("query_id", "edge_id", "to_id", F.lit(f"beyond {most} rounds").alias("reason")))
            break
        new = new.groupBy("query_id", F.col("to_id").alias("node_id")).agg(F.min_by("edge_id", F.struct("turn", "edge_id")).alias("via"))
        front = saved(new.select("query_id", "node_id", F.lit(hop).alias("hops"), "via"), "front")
        if not front.take(1):
            break
        seen = seen.unionByName(front)
    return seen, skipped


def degrees(edges: DataFrame) -> DataFrame:
    """node_id, degree: edges out and in; a loop counts twice."""
    return edges.select(F.explode(F.array("src", "dst")).alias("node_id")).groupBy("node_id").agg(F.count(F.lit(1)).alias("degree"))


def frontier_score(prior, relevance, hops, degree, cross_doc, confidence, budget: dict = BUDGET) -> Column:
    return prior * relevance * F.pow(F.lit(budget["hop_decay"]), hops) / F.log(F.lit(2) + degree) * F.when(cross_doc, budget["cross_doc_penalty"]).otherwise(1.0) * confidence


def context(included: DataFrame, walk: DataFrame, nodes: DataFrame, edges: DataFrame, relevance: DataFrame, budget: dict = BUDGET, visible: DataFrame | None = None, told: bool = True) -> DataFrame:
    """The context neighbours of included (query_id, node_id), best first, up to the budget or saturation.

    nodes: (node_id, text); relevance: (query_id, node_id, relevance), 0 elsewhere. Returns query_id, node_id, rank, hops, score,
    cost, total, new_keys and stopped_because. If no step may be taken beyond the first hop, windows give the order; types
    of more hops make what comes next depend on what came before, so then each query's neighbourhood is walked by itself.
    visible: (query_id, doc_id) that a query may see; other documents' nodes (nodes need doc_id then) are no neighbours.
    told: is new_keys wanted? Else keys are compared only if some query takes enough nodes to be saturated, and new_keys may be null.
    """
    texts = saved(nodes.select("node_id", "text", token_estimate(F.col("text")).alias("cost")).dropDuplicates(["node_id"]).join(degrees(edges), "node_id", "left"), "context-texts")
    usable = walk.where(F.col("confidence") >= budget["min_edge_confidence"])
    deepest = usable.agg(F.max("max_hops")).first()[0] or 1
    from_ = included.select("query_id", F.col("node_id").alias("from_id")).distinct()
    known, steps_ = included.select("query_id", "node_id").distinct(), None
    for hop in range(1, deepest + 1):
        met = from_.join(usable.where(F.coalesce(F.col("max_hops") >= hop, F.lit(True))), "from_id").withColumnRenamed("to_id", "node_id")
        met = met.join(known, ["query_id", "node_id"], "left_anti").join(texts.drop("text"), "node_id").join(relevance, ["query_id", "node_id"], "left")
        if visible is not None:
            met = met.join(nodes.select("node_id", "doc_id").dropDuplicates(["node_id"]), "node_id").join(visible.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_semi").drop("doc_id")
        score = frontier_score(F.col("prior"), F.coalesce("relevance", F.lit(0.0)), F.lit(hop), F.coalesce("degree", F.lit(0)), F.col("cross_doc"), F.col("confidence"), budget)
        met = met.withColumn("score", F.round(score, 12)).groupBy("query_id", "from_id", "node_id").agg(F.max("score").alias("score"), F.first("cost").alias("cost"))
        met = saved(met.withColumn("hops", F.lit(hop)), "context-steps")
        if not met.take(1):
            break
        steps_ = met if steps_ is None else steps_.unionByName(met)
        from_ = met.select("query_id", F.col("node_id").alias("from_id")).distinct()
    if steps_ is None:
        steps_ = met
    base = included.join(texts, "node_id").groupBy("query_id").agg(F.sum("cost").alias("base"))
    if deepest > 1:
        return _walked(steps_, included, texts, base, budget)
    best = steps_.groupBy("query_id", "node_id").agg(F.max("score").alias("score"), F.first("cost").alias("cost"))
    by_score = W.partitionBy("query_id").orderBy(F.desc("score"), "node_id")
    ranked = best.withColumn("rank", F.row_number().over(by_score)).join(base, "query_id", "left")
    ranked = ranked.withColumn("total", F.coalesce("base", F.lit(0)) + F.sum("cost").over(by_score))
    every = W.partitionBy("query_id")
    ranked = ranked.withColumn("over", F.min(F.when(F.col("total") > budget["max_tokens"], F.col("rank"))).over(every))
    # only what the budget leaves has its keys compared
    ranked = saved(ranked, "context-ranked")
    fits = ranked.where("rank < coalesce(over, rank + 1)")
    n, order = budget["saturation_window"], W.partitionBy("query_id").orderBy("rank")
    if told or fits.where(F.col("rank") >= n).take(1):
        texts = texts.select("node_id", "text")
        held = included.select("query_id", "node_id").distinct().join(fits.select("query_id").distinct(), "query_id", "left_semi").join(texts, "node_id").select("query_id", F.explode(keys(F.col("text"))).alias("key")).distinct()
        fresh = fits.join(texts, "node_id").select("query_id", "rank", F.explode(keys(F.col("text"))).alias("key")).join(held, ["query_id", "key"], "left_anti")
        fresh = fresh.groupBy("query_id", "key").agg(F.min("rank").alias("rank")).groupBy("query_id", "rank").agg(F.count(F.lit(1)).alias("new_keys"))
        fits = fits.join(fresh, ["query_id", "rank"], "left").withColumn("new_keys", F.coalesce("new_keys", F.lit(0)))
    else:
        fits = fits.withColumn("new_keys", F.lit(None).cast("long"))
    dry = (F.col("rank") >= n) & (F.sum("new_keys").over(order.rowsBetween(1 - n, 0)) == 0)
    fits = fits.withColumn("dry", F.min(F.when(dry, F.col("rank"))).over(every))
    why = F.when(F.col("dry").isNotNull(), "saturation").when(F.col("over").isNotNull(), "budget").otherwise("exhausted")
    kept = fits.withColumn("stopped_because", why).where("rank <= coalesce(dry, rank)")
    return kept.select("query_id", "node_id", "rank", F.lit(1).alias("hops"), "score", "cost", "total", "new_keys", "stopped_because")


def walked(steps_: list[dict], base: int, held: set[str], most: int, window: int) -> tuple[list[tuple], str]:
    """(node_id, rank, hops, score, cost, total, new_keys) of the nodes taken, best step first, and why it ended.

    steps_: from_id, node_id, hops, score, cost, keys. Steps of the first hop are open from the start; others open when their node is taken.
    """
    out, taken, total, later = [], set(), base, {}
    heap = []
    for r in steps_:
        at = (-r["score"], r["node_id"], r["hops"], r["cost"], r["keys"])
        heap.append(at) if r["hops"] == 1 else later.setdefault((r["from_id"], r["hops"]), []).append(at)
    heapify(heap)
    while heap:
        score, node, hops, cost, words = heappop(heap)
        if node in taken:
            continue
        if total + cost > most:
            return out, "budget"
        total += cost
        fresh = set(words) - held
        held |= fresh
        taken.add(node)
        out.append((node, len(out) + 1, hops, -score, cost, total, len(fresh)))
        if len(out) >= window and not any(x[6] for x in out[-window:]):
            return out, "saturation"
        for at in later.get((node, hops + 1), ()):
            heappush(heap, at)
    return out, "exhausted"


def _walked(steps_: DataFrame, included: DataFrame, texts: DataFrame, base: DataFrame, budget: dict) -> DataFrame:
    """context() one query at a time: a row holds the steps of a query's neighbourhood and the keys of its nodes."""
    worded = texts.select("node_id", keys(F.col("text")).alias("keys"))
    asked = steps_.select("query_id").distinct()
    own = included.select("query_id", "node_id").distinct().join(asked, "query_id", "left_semi")
    held = own.join(worded, "node_id").select("query_id", F.explode("keys").alias("key")).distinct().groupBy("query_id").agg(F.collect_list("key").alias("held"))
    rows = steps_.join(worded, "node_id").groupBy("query_id").agg(F.collect_list(F.struct("from_id", "node_id", "hops", "score", "cost", "keys")).alias("steps"))
    rows = rows.join(base, "query_id", "left").join(held, "query_id", "left")
    window, most = budget["saturation_window"], budget["max_tokens"]

    @F.pandas_udf("struct<taken:array<struct<node_id:string,rank:int,hops:int,score:double,cost:int,total:long,new_keys:long>>,stopped_because:string>")
    def run(steps: pd.Series, base: pd.Series, held: pd.Series) -> pd.DataFrame:
        made = [walked(list(s), int(b), set(h), most, window) for s, b, h in zip(steps, base, held)]
        names = ("node_id", "rank", "hops", "score", "cost", "total", "new_keys")
        return pd.DataFrame({"taken": [[dict(zip(names, x)) for x in m[0]] for m in made], "stopped_because": [m[1] for m in made]})

    none = F.array().cast("array<string>")
    out = rows.select("query_id", run("steps", F.coalesce("base", F.lit(0)).cast("long"), F.coalesce("held", none)).alias("w"))
    return out.select("query_id", F.explode("w.taken").alias("t"), "w.stopped_because").select("query_id", "t.*", "stopped_because")


def violations(cited: DataFrame, walk: DataFrame, shown: DataFrame, nodes: DataFrame) -> DataFrame:
    """query_id, node_id (cited), missing_id, type: one closure step away from what is cited, in the graph, and not shown."""
    met = cited.select("query_id", "node_id").distinct().join(walk.select(F.col("from_id").alias("node_id"), F.col("to_id").alias("missing_id"), "type"), "node_id")
    met = met.join(shown.select("query_id", F.col("node_id").alias("missing_id")), ["query_id", "missing_id"], "left_anti")
    return met.join(nodes.select(F.col("node_id").alias("missing_id")), "missing_id", "left_semi").select("query_id", "node_id", "missing_id", "type").distinct()


def verdicts(cited: DataFrame, walk: DataFrame, shown: DataFrame, nodes: DataFrame, min_confidence: float = 0.0) -> DataFrame:
    """query_id, n_cited, missing (ids to add to the context, sorted), sound: the check of an answer's citations against what it was shown."""
    bad = violations(cited, walk.where(F.col("confidence") >= min_confidence), shown, nodes)
    bad = bad.groupBy("query_id").agg(F.array_sort(F.collect_set("missing_id")).alias("missing"))
    own = cited.groupBy("query_id").agg(F.count_distinct("node_id").alias("n_cited")).join(bad, "query_id", "left")
    return own.withColumn("missing", F.coalesce("missing", F.array().cast("array<string>"))).withColumn("sound", F.size("missing") == 0)


def assembled(shown: DataFrame, nodes: DataFrame) -> DataFrame:
    """query_id, context: the texts of what is shown in document order, an empty line between; n_nodes."""
    own = shown.select("query_id", "node_id").distinct().join(nodes.select("node_id", "doc_id", "seq", "text"), "node_id")
    parts = F.array_sort(F.collect_list(F.struct("doc_id", "seq", "text")))
    return joined(own.groupBy("query_id").agg(F.transform(parts, lambda p: p["text"]).alias("texts")))


def joined(texts: DataFrame) -> DataFrame:
    """texts: (query_id, texts)."""
    return texts.select("query_id", F.array_join("texts", "\n\n").alias("context"), F.size("texts").cast("long").alias("n_nodes"))
