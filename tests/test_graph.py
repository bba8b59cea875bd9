import inspect

from lexweave.operators import graph, retrieval

EDGES = "edge_id string, src string, dst string, type string, class string, confidence double"


def closed(spark, rows, *seeds, **more):
    edges = spark.createDataFrame([(f"e{i}", s, d, t, "closure", c) for i, (s, d, t, c) in enumerate(rows)], EDGES)
    nodes = spark.createDataFrame([(n,) for n in sorted({x for r in rows for x in r[:2]} - {"ghost"})], "node_id string")
    start = spark.createDataFrame([("q", s) for s in seeds], "query_id string, node_id string")
    reached, skipped = graph.closure(start, graph.steps(edges, "closure"), nodes, **more)
    return {r.node_id: r.hops for r in reached.collect()}, {r.reason for r in skipped.collect()}


def test_exceptions_come_from_behind_and_conditions_from_ahead(spark):
    got, _ = closed(spark, [("exc", "rule", "exception_of", 1.0), ("rule", "cond", "conditioned_on", 1.0), ("rule", "other", "exception_of", 1.0)], "rule")
    assert got == {"rule": 0, "exc": 1, "cond": 1}


def test_long_chain_and_cycle(spark):
    chain = [(f"n{i + 1}", f"n{i}", "exception_of", 1.0) for i in range(6)]
    got, _ = closed(spark, [*chain, ("n0", "n6", "exception_of", 1.0)], "n0")
    assert got == {f"n{i}": i for i in range(7)}


def test_definitions_are_capped_and_what_is_skipped_is_told(spark):
    got, skipped = closed(spark, [("a", "b", "defines", 1.0), ("b", "c", "defines", 1.0), ("c", "d", "defines", 1.0), ("ghost", "a", "exception_of", 1.0), ("w", "a", "exception_of", 0.2)], "a", min_confidence=0.5)
    assert got == {"a": 0, "b": 1, "c": 2}
    assert skipped == {"defines is capped at 2 hops", "node not in graph", "below minimum confidence"}


def test_what_the_rounds_leave_is_told(spark):
    chain = [(f"n{i + 1}", f"n{i}", "exception_of", 1.0) for i in range(4)]
    assert closed(spark, chain, "n0", most=2) == ({"n0": 0, "n1": 1, "n2": 2}, {"beyond 2 rounds"})
    assert closed(spark, chain, "n0", most=4) == ({f"n{i}": i for i in range(5)}, set())


def test_rounds_have_no_bound_of_their_own():
    assert inspect.signature(graph.closure).parameters["most"].default is None


def test_soundness_names_what_is_missing(spark):
    edges = spark.createDataFrame([("e", "exc", "rule", "exception_of", "closure", 1.0)], EDGES)
    nodes = spark.createDataFrame([("exc",), ("rule",)], "node_id string")
    shown = spark.createDataFrame([("q", "rule")], "query_id string, node_id string")
    assert [r.missing_id for r in graph.violations(shown, graph.steps(edges, "closure"), shown, nodes).collect()] == ["exc"]


def test_tfidf_and_fusion(spark):
    import math

    texts = spark.createDataFrame([("a", "red apple red"), ("b", "green apple"), ("c", "the of")], "id string, text string")
    got = {r.id: r.score for r in retrieval.scores(retrieval.build(texts), spark.createDataFrame([("q", "red apple")], "query_id string, text string")).collect()}
    red, apple = math.log(1 + 2 / 2), math.log(1 + 2 / 3)
    assert abs(got["a"] - (2 * red**2 + apple**2) / math.hypot(2 * red, apple)) < 1e-8 and set(got) == {"a", "b"}
    ranks = spark.createDataFrame([("q", "a", 1, "dense"), ("q", "a", 2, "sparse"), ("q", "b", 1, "sparse")], "query_id string, id string, rank int, source string")
    assert {r.id: r.score for r in retrieval.fused(ranks).collect()} == {"a": round(1 / 61 + 1 / 62, 9), "b": round(1 / 61, 9)}


def test_two_hops_of_context_and_the_budget(spark):
    """A far node that is relevant comes before a near one that is not, and only types of more hops lead on."""
    rows = [("e1", "s", "a", "elaborates", "context", 1.0), ("e2", "a", "b", "elaborates", "context", 1.0), ("e3", "b", "c", "elaborates", "context", 1.0), ("e4", "s", "z", "cites", "context", 1.0), ("e5", "a", "y", "cites", "context", 1.0)]
    edges = spark.createDataFrame(rows, EDGES)
    nodes = spark.createDataFrame([(n, f"word{n} {n * 9}") for n in "sabcyz"], "node_id string, text string")
    included = spark.createDataFrame([("q", "s")], "query_id string, node_id string")
    relevance = spark.createDataFrame([("q", "a", 0.9), ("q", "b", 0.8), ("q", "c", 1.0), ("q", "y", 1.0), ("q", "z", 0.1)], "query_id string, node_id string, relevance double")

    def found(**more):
        rows = graph.context(included, graph.steps(edges, "context"), nodes, edges, relevance, graph.BUDGET | more).orderBy("rank").collect()
        return [(r.node_id, r.hops) for r in rows], {r.stopped_because for r in rows}

    assert found() == ([("a", 1), ("b", 2), ("z", 1)], {"exhausted"})
    assert found(max_tokens=9) == ([("a", 1), ("b", 2)], {"budget"})


def test_queries_see_their_documents_only(spark):
    edges = spark.createDataFrame([("e1", "b", "a", "exception_of", "closure", 1.0), ("e2", "c", "b", "exception_of", "closure", 1.0)], EDGES)
    nodes = spark.createDataFrame([("a", "d1"), ("b", "d2"), ("c", "d1")], "node_id string, doc_id string")
    seeds = spark.createDataFrame([("q", "a"), ("r", "a")], "query_id string, node_id string")
    visible = spark.createDataFrame([("q", "d1"), ("r", "d1"), ("r", "d2")], "query_id string, doc_id string")
    reached, skipped = graph.closure(seeds, graph.steps(edges, "closure"), nodes, visible=visible)
    assert {(r.query_id, r.node_id) for r in reached.collect()} == {("q", "a"), ("r", "a"), ("r", "b"), ("r", "c")}
    assert [(r.query_id, r.reason) for r in skipped.collect()] == [("q", "document not visible")]


def test_verdicts_name_what_to_add(spark):
    edges = spark.createDataFrame([("e", "exc", "rule", "exception_of", "closure", 0.6)], EDGES)
    nodes = spark.createDataFrame([("exc",), ("rule",)], "node_id string")
    shown = spark.createDataFrame([("q", "rule")], "query_id string, node_id string")
    walk = graph.steps(edges, "closure")
    assert [(r.sound, r.missing) for r in graph.verdicts(shown, walk, shown, nodes).collect()] == [(False, ["exc"])]
    assert [(r.sound, r.missing) for r in graph.verdicts(shown, walk, shown, nodes, 0.7).collect()] == [(True, [])]


def test_saturation_ends_what_brings_nothing_new():
    step = lambda n, score, *keys: {"from_id": "s", "node_id": n, "hops": 1, "score": score, "cost": 1, "keys": list(keys)}
    steps = [step(f"n{i}", 1 - i / 10, "known") for i in range(6)]
    out, why = graph.walked(steps, 0, {"known"}, 100, 3)
    assert [x[0] for x in out] == ["n0", "n1", "n2"] and why == "saturation"
    assert graph.walked(steps, 98, set(), 100, 3)[1] == "budget"
