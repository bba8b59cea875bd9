"""Table contracts, summaries and the small reports."""

import pytest

from lexweave.operators import conflict, evaluate, parse, retrieval, sections
from lexweave.sources import contracts, ingest


def test_tables_of_an_ingest_conform(spark, tmp_path):
    (tmp_path / "a.txt").write_text("Section 1. Keepers\n\n(1) Every keeper shall hold it.\n\nProvided that one need not.")
    (tmp_path / "b.txt").write_bytes(b"plain \xff words\n\nmore plain words\n\nand more")
    raw = ingest.files(spark, f"file://{tmp_path}")
    made = ingest.tables(raw)
    for name in ingest.TABLES:
        assert contracts.conform(made[name], name).columns[: len(contracts.TABLES[name])] == contracts.TABLES[name].names
    told = parse.warnings(parse.units(raw))
    assert {r.warning for r in told.collect()} == {"bytes that are no UTF-8", "most units have no mark"}
    row = ingest.summary(made, told).first()
    assert (row.documents, row.pending, row.nodes, row.warnings) == (2, 1, 3, 2) and row.closure_edges >= 1
    assert [r.seq for r in contracts.doc_order(made["nodes"], made["documents"]).collect()] == [0, 1, 2]
    with pytest.raises(ValueError, match="lacks path"):
        contracts.conform(made["documents"].drop("path"), "documents")
    with pytest.raises(ValueError, match="seq is string"):
        contracts.conform(made["nodes"].withColumn("seq", made["nodes"]["seq"].cast("string")), "nodes")


def test_evidence_has_its_place():
    window = "A keeper\nshall hold the goods."
    assert sections.check_evidence(window, "shall hold the") == {"verdict": "exact", "span": "shall hold the", "start": 9, "end": 23, "reason": None}
    assert sections.check_evidence(window, "A keeper shall hold") == {"verdict": "reflowed", "span": "A keeper\nshall hold", "start": 0, "end": 19, "reason": None}
    assert [sections.check_evidence(window, s)["reason"] for s in (None, " ", "goods", "A KEEPER SHALL HOLD", "no such words here")] == ["missing", "empty", "too_short", "case_mismatch_only", "not_in_window"]


def test_conflicts_are_shown_up_to_a_number(spark):
    rows = [("d", f"a{i:02d}", "z") for i in range(12)] + [("e", "a", "b")]
    got = {r.doc_id: (len(r.shown), r.more) for r in conflict.report(spark.createDataFrame(rows, "doc_id string, a_id string, b_id string")).collect()}
    assert got == {"d": (10, 2), "e": (1, 0)}


def test_sections_in_order_and_titles_once(spark):
    df = spark.createDataFrame([("10A",), ("2",), ("10",)], "n string")
    assert [r.n for r in df.orderBy(*evaluate.section_order(df["n"])).collect()] == ["2", "10", "10A"]
    rows = [("d", i, f"The Act\ntext {i}", "The Act") for i in range(3)]
    got = evaluate.without_titles(spark.createDataFrame(rows, "doc_id string, seq int, text string, title string")).orderBy("seq").collect()
    assert [r.text for r in got] == ["The Act\ntext 0", "text 1", "text 2"]


def test_seeders_by_mode(spark):
    texts = spark.createDataFrame([("a", "red apple"), ("b", "green apple")], "id string, text string")
    ask = spark.createDataFrame([("q", "red apple")], "query_id string, text string")
    assert [r.id for r in retrieval.seeder_of("lexical", texts)(ask, 1).collect()] == ["a"]
    with pytest.raises(ValueError, match="embed first"):
        retrieval.seeder_of("hybrid", texts)
    with pytest.raises(ValueError, match="none of"):
        retrieval.seeder_of("other", texts)
