"""The model pass, the embedding pass, cases and ledger by hand."""

import json

import pytest

from lexweave.operators import embed, evaluate, extract
from lexweave.sources import cases

NODES = "doc_id string, node_id string, seq int, kind string, raw string"
ROWS = [("d", "h", 0, "structural", "Section 1. Of things"), ("d", "a", 1, "proposition", "(1) A thing is kept."), ("d", "b", 2, "proposition", "Provided that it is paid for."), ("d", "f", 3, "footnote", "1. Ins. by an act"), ("d", "k", 4, "structural", "Section 2. Quiet"), ("d", "m", 5, "proposition", "No mark here.")]


def test_the_pass_checks_what_the_model_says(spark):
    nodes = spark.createDataFrame(ROWS, NODES)
    edges = spark.createDataFrame([("e1", "b", "a", "exception_of", 0.6, "pattern", "d"), ("e2", "a", "h", "defines", 0.6, "pattern", "d"), ("e3", "m", "k", "defines", 0.6, "pattern", "d"), ("e4", "m", "a", "supersedes", 1.0, "pattern", "d")], "edge_id string, src string, dst string, type string, confidence double, provenance string, doc_id string")

    def model(said, labels):
        assert labels == {"N1": "h", "N2": "a", "N3": "b"} and "[N1] (heading) Section 1." in said[1]["content"]
        one = {"src": "N3", "dst": "N2", "type": "exception_of", "evidence": "Provided  that it is", "confidence": 0.9}
        return [one, one | {"confidence": 7}, one | {"dst": "N1", "type": "defines"}, one | {"type": "likes"}, one | {"dst": "N3"}, one | {"dst": "m"}, one | {"evidence": "paid"}, one | {"evidence": "PROVIDED THAT IT IS"}, one | {"evidence": "that it is not so"}, {"type": "none"}]

    made = extract.run(nodes, edges, model, "m1")
    assert {r.reason for r in made["proposals"].where("reason is not null").collect()} == {"type not allowed", "loop", "endpoint not in window", "evidence too_short", "evidence case_mismatch_only", "evidence not_in_window", "no relation"}
    assert [(r.edge_id, r.span, r.prompt_hash) for r in made["edges"].collect()] == [("model:defines:b:h", "Provided that it is", extract.program_hash())]
    assert {r.edge_id: (r.confidence, r.provenance) for r in made["reconciled"].collect()} == {"e1": (1.0, "verified"), "e2": (0.3, "pattern"), "e3": (0.6, "pattern"), "e4": (1.0, "pattern")}
    row = extract.summary(made, edges).first()
    assert row.asDict() == {"sections": 2, "admitted": 1, "calls": 1, "failures": 0, "candidates": 10, "rejected": 6, "edges_written": 1, "verified": 1, "unconfirmed": 1}


def test_a_failed_call_is_a_row_and_its_window_unexamined(spark):
    nodes = spark.createDataFrame(ROWS, NODES)
    edges = spark.createDataFrame([("e2", "a", "h", "defines", 0.6, "pattern", "d")], "edge_id string, src string, dst string, type string, confidence double, provenance string, doc_id string")

    def model(said, labels):
        raise TimeoutError("slow")

    made = extract.run(nodes, edges, model, "m1")
    assert [r.failure for r in made["calls"].collect()] == ["TimeoutError: slow"] and made["edges"].count() == 0
    assert [r.confidence for r in made["reconciled"].collect()] == [0.6]


def test_schema_is_closed_and_fences_go():
    s = extract.schema(["N1", "N2"])
    one = s["properties"]["edges"]["items"]
    assert one["required"] == list(one["properties"]) and one["properties"]["src"]["enum"] == ["N1", "N2"] and one["properties"]["type"]["enum"][-1] == "none"
    assert extract.answer_of("```json\n" + json.dumps({"edges": [{"src": "N1"}]}) + "\n```") == [{"src": "N1"}] == extract.answer_of('{"edges": [{"src": "N1"}]}')


def test_embedding_resumes_and_stops_a_document_that_fails(spark):
    nodes = spark.createDataFrame([(d, f"{d}{i}", i, None, f"text {d} {i}") for d in "abc" for i in range(5)], "doc_id string, node_id string, seq int, normalized string, raw string")
    docs = spark.createDataFrame([("a", "accepted"), ("b", "accepted"), ("c", "pending")], "doc_id string, review_state string")
    calls = spark.sparkContext.accumulator(0)

    def model(texts, doc):
        calls.add(1)
        if "text b 2" in texts:
            return [[0.0]]
        return embed.hash_embedder(texts, doc)

    made = embed.embed(embed.pending(nodes, docs, None, "m"), model, "m", 2).collect()
    assert {r.node_id for r in made if r.failure is None} == {*(f"a{i}" for i in range(5)), "b0", "b1"} and {r.failure for r in made if r.failure} == {"1 vectors for 2 nodes at 2"}
    done = spark.createDataFrame([(r.node_id, "m") for r in made if r.failure is None], "node_id string, model_id string")
    again = embed.embed(embed.pending(nodes, docs, done, "m"), embed.hash_embedder, "m")
    assert sorted(r.node_id for r in again.collect()) == ["b2", "b3", "b4"]
    assert embed.summary(again, nodes, docs).first().asDict() == {"documents_embedded": 1, "nodes_embedded": 3, "documents_failed": 0, "documents_pending": 1, "nodes_skipped": 7}
    native = nodes.select("node_id", embed.hash_vector("raw").alias("v")).collect()
    assert {r.node_id: list(r.v) for r in native} == {r.node_id: embed.hash_embedder([r.raw], "")[0] for r in nodes.collect()}


def test_cases_from_lines_and_ledger(spark, tmp_path):
    good = {"query": "q", "cause": "lost_scope", "source_file": "d", "gold_span": "g", "naive_retrieval_gets": "n", "why_it_fails": "w"}
    (tmp_path / "cases.jsonl").write_text("// a comment\n\n" + json.dumps(good) + "\n{broken\n")
    rows, bad = cases.read_lines(spark, str(tmp_path / "cases.jsonl"))
    assert [r.asDict() for r in rows.collect()] == [good] and [r.line for r in bad.collect()] == ["{broken"]
    own = spark.createDataFrame([("d", "parse", 5, 1, 2, None, None), ("e", "parse", 7, 1, 2, "m", None)], cases.LEDGER)
    cases.record(own, str(tmp_path / "ledger"))
    cases.record(own, str(tmp_path / "ledger"))
    total = cases.costs(spark.read.parquet(str(tmp_path / "ledger"))).where("level = 3").first()
    assert (total.documents, total.duration_ms) == (2, 24)
    dealt = cases.batches(spark.range(100).toDF("id"), "id", 40)
    assert {r.id: r.batch for r in dealt.collect()} == {i: i // 40 for i in range(100)}


@pytest.mark.parametrize("gold, raw, hit", [("A long sentence of law that is kept.", "a  LONG sentence of law that is kept.", True), ("x" * 90, "y" * 20 + "x" * 80, True), ("x" * 90, "y" * 50 + "x" * 59, False), ("short", "short", False)])
def test_gold_spans(spark, gold, raw, hit):
    cases_ = spark.createDataFrame([("c", "d", gold)], "case_id string, doc_id string, gold_span string")
    nodes = spark.createDataFrame([("d", "n", raw), ("e", "m", raw)], "doc_id string, node_id string, raw string")
    assert [r.node_id for r in evaluate.gold_nodes(cases_, nodes).collect()] == (["n"] if hit else [])


def test_units_end_at_sentences_and_blank_lines(spark):
    text = "A first sentence that goes on. A second one that goes on too; the third is not one\n\nshort\n\n(b) another of some length, at last"
    got = evaluate.split_units(spark.createDataFrame([("d", text)], "doc_id string, text string")).orderBy("unit_no").collect()
    assert [r.unit for r in got] == ["A first sentence that goes on.", "A second one that goes on too; the third is not one", "(b) another of some length, at last"]


def test_lint_finds_each_kind(spark):
    nodes = spark.createDataFrame([("d", "n1", "proposition", 'the "widget" is kept'), ("d", "n2", "proposition", "x")], "doc_id string, node_id string, kind string, raw string")
    terms = spark.createDataFrame([("t1", "d", "n2", "s1", "cog"), ("t2", "d", "n3", "s2", "cog")], "term_id string, doc_id string, definition_id string, scope_id string, canonical string")
    edges = spark.createDataFrame([("e1", "n1", "n2", "defines", "closure", 1.0), ("e2", "n1", "n2", "exception_of", "closure", 1.0), ("e3", "n2", "n1", "exception_of", "closure", 1.0)], "edge_id string, src string, dst string, type string, class string, confidence double")
    got = {(r.finding, r.subject_id) for r in evaluate.lint(nodes, terms, edges).collect()}
    assert got == {("unused term", "t2"), ("shadowed term", "t1"), ("shadowed term", "t2"), ("undefined term", "n1"), ("circular", "n1"), ("circular", "n2")}
