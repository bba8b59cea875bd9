"""What queries over large tables rest on: one pass, one shuffle, and the same rows as the plain way."""

import re

from lexweave.functions import pack
from lexweave.operators import edges, embed, evaluate, extract, graph, parse
from lexweave.sources import clauses, statute

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _nodes(spark, raws, doc="a"):
    rows = [(doc, i, f"{doc}:{i}", "structural" if raw.startswith("Section") else "proposition", 1 if raw.startswith("Section") else 2, raw) for i, raw in enumerate(raws)]
    return edges.linked(spark.createDataFrame(rows, "doc_id string, seq long, node_id string, kind string, level int, raw string"))


def test_statute_view_is_shuffled_once(spark):
    assert len(re.findall(r"Exchange hash", _plan(edges.linked(statute.view(spark, SF))))) == 1


def test_edges_of_one_row_are_the_same_as_when_all_meet(spark):
    raws = [
        "Section 1. Rules.", "(1) Notwithstanding the foregoing, and notwithstanding anything contained in section 2, the part stays.", "Provided that nothing in this section shall apply to it.",
        "Provided that it shall not apply to goods, and nothing in section 2 shall apply here.", "Explanation. - for the purposes of this section goods shall be deemed to be sold.", "(2) It shall be deemed to be sold for the purposes of sub-section (1),",
        "Section 2. More.", "(1) Subject to the provisions of section 1, it yields unless otherwise provided.", "SUBJECT TO THE OTHER PROVISIONS of section 1(1) it shall survive termination.", "Notwithſtanding anything contained in section 1 it stands.",
    ]
    nodes = _nodes(spark, raws)
    plain = edges.deduped(edges.part_of(nodes).unionByName(edges.unit_edges(nodes)).unionByName(edges.marker_edges(nodes)))
    made = edges.all_edges(nodes)
    assert made.schema.names == plain.schema.names
    assert {tuple(r) for r in made.collect()} == {tuple(r) for r in plain.collect()}
    assert made.count() == plain.count() > 15
    assert {m.name for m in pack.MARKERS if m.target == "referenced"} >= {r.marker for r in edges.marker_hits(nodes).where("raw like 'Notwithſ%'").collect()} == {"non_obstante"}


def test_steps_pass_over_their_edges_once(spark):
    own = spark.createDataFrame([("e", "a", "b", "contradicts", 1.0, "context"), ("f", "a", "b", "supports", 1.0, "context")], "edge_id string, src string, dst string, type string, confidence double, class string")
    walk = graph.steps(own, "context")
    assert "Union" not in _plan(walk)
    assert {(r.from_id, r.to_id, r.turn, r.edge_id) for r in walk.collect()} == {("b", "a", 0, "e"), ("a", "b", 1, "e"), ("a", "b", 1, "f")}


def test_marks_are_looked_for_once(spark):
    units = spark.createDataFrame([("a", 0, "Notwithſtanding anything contained in section 5 of AIR 1998 SC 12 it stands."), ("a", 1, 'Order XI, Rule 4: "it" means so.'), ("a", 2, None)], "doc_id string, unit_no int, unit string")
    hits = evaluate.unit_hits(units)
    assert not re.search(r"Filter.*RLIKE", evaluate.mark_counts(hits)._jdf.queryExecution().optimizedPlan().toString())
    assert [r.mark for r in evaluate.mark_counts(hits).collect()] == ["marker:non_obstante"]
    assert [(r.defines, r.cites) for r in hits.orderBy("unit_no").collect()] == [(False, True), (True, True), (None, None)]


def test_texts_are_spread_and_parsed_without_a_table_each(spark):
    assert clauses.texts(spark, SF).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert parse.physical(" (1) a\r\n\r\n b\nc") == [("(1) a", 1, 6, False, "b"), ("b", 11, 12, True, "c"), ("c", 13, 14, False, "")]
    files = spark.createDataFrame([("x", "(1) é: Provided that a.\n\nb: provided".encode()), ("y", None), ("z", b"\xff")], "doc_id string, content binary")
    made = {(r.doc_id, r.seq): (r.damaged, r.unit, r.raw, r.byte_start, r.byte_end) for r in parse.units(files).collect()}
    assert made == {("x", 0): (False, "subsec", "(1) é", 0, 6), ("x", 1): (False, "proviso", "Provided that a.", 8, 24), ("x", 2): (False, "text", "b: provided", 26, 37), ("y", None): (False, None, None, None, None), ("z", 0): (True, "text", "�", 0, 3)}


def test_gold_spans_meet_texts_by_rare_grams(spark, monkeypatch):
    import random

    r = random.Random(3)
    word = lambda: r.choice(["provided that nothing here shall apply to part", "keeps a record of it", "x", "holder of stock", "ab", "prevails"])
    text = lambda n: " ".join(f"{word()} {r.randint(0, 30)}" for _ in range(n))
    raws = [text(r.randint(1, 4)) for _ in range(150)]
    raws = [x for x in raws if len(x) >= 25]
    golds = [f"{r.choice(raws)} {r.choice(raws)}"[r.randint(0, 20) :] for _ in range(60)] + [r.choice(raws)[5:35] for _ in range(20)] + ["", "x", "ab 1", raws[0]]
    probe = lambda g, p: len(p) >= 60 and p in g
    plain = [(i, j) for i, g in enumerate(golds) for j, x in enumerate(raws) if x in g or g in x or probe(g, x[:80]) or probe(g, x[-80:])]
    assert evaluate.overlaps(golds, raws) == plain and any(len(x) > 80 for x in raws)
    monkeypatch.setattr(evaluate, "MEET", 20)  # documents in several blocks
    nodes = spark.createDataFrame([(f"d{i % 2}", f"n{i}", x) for i, x in enumerate(raws)], "doc_id string, node_id string, raw string")
    cases = spark.createDataFrame([(f"d{i % 2}", f"c{i}", g) for i, g in enumerate(golds)] + [("d0", "none", None), ("d9", "alone", "x")], "doc_id string, case_id string, gold_span string")
    got = sorted((r.case_id, r.node_id) for r in evaluate.gold_nodes(cases, nodes).collect())
    clean = lambda x: " ".join(x.split())
    assert got == sorted((f"c{i}", f"n{j}") for i, j in evaluate.overlaps([clean(g) for g in golds], [clean(x) for x in raws]) if i % 2 == j % 2)


def test_embedding_holds_one_batch_at_a_time(spark):
    rows = [(f"d{i % 3}", f"n{i:03}", i, f"t{i}") for i in range(60)]
    todo = spark.createDataFrame(rows, "doc_id string, node_id string, seq long, text string")

    def model(texts, doc):
        if doc == "d1" and "t31" in texts:
            raise ValueError("full")
        return [[float(len(texts))] for _ in texts]

    made = embed.embed(todo, model, "m", 8)
    assert "collect_list" not in _plan(made)
    got = {r.node_id: (r.doc_id, r.vector and r.vector[0], r.failure) for r in made.collect()}
    assert got == {n: (d, None, "ValueError: full at 8") if d == "d1" and i // 3 >= 8 else (d, 8.0 if i // 3 < 16 else 4.0, None) for d, n, i, _ in rows}


def test_windows_of_the_model_pass_need_no_join(spark):
    nodes = _nodes(spark, ["Section 1. Rules.", "(1) provided one.", "(2) two two two.", "(3) three.", "Section 2. More.", "(1) four."])
    made = extract.windows(nodes, 34)
    assert "Join" not in _plan(made)
    assert [(r.window, r.part, [m.node_id for m in r.members], r.title) for r in made.orderBy("window", "part").collect()] == [(1, 0, ["a:0", "a:1"], "Section 1. Rules."), (1, 1, ["a:2", "a:3"], "a"), (2, 0, ["a:4", "a:5"], "Section 2. More.")]


def test_keys_are_compared_only_where_they_count(spark):
    nodes = spark.createDataFrame([(x, f"{x} text") for x in "abc"], "node_id string, text string")
    own = spark.createDataFrame([(f"e{x}", "a", x, "supports", 1.0, "context") for x in "bc"], "edge_id string, src string, dst string, type string, confidence double, class string")
    included = spark.createDataFrame([("q", "a")], "query_id string, node_id string")
    relevance = spark.createDataFrame([("q", x, 1.0) for x in "bc"], "query_id string, node_id string, relevance double")
    ask = lambda window, told: graph.context(included, graph.steps(own, "context"), nodes, own, relevance, graph.BUDGET | {"saturation_window": window}, told=told)
    cols = ("node_id", "rank", "total", "stopped_because")
    assert "Join" not in _plan(ask(9, False)) and "Join" in _plan(ask(9, True))
    for window in (1, 9):
        assert [[r[c] for c in cols] for r in ask(window, False).collect()] == [[r[c] for c in cols] for r in ask(window, True).collect()] != []
