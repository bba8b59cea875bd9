import pytest

from lexweave.operators import edges, sections
from lexweave.operators.edges import references

NODES = "node_id string, doc_id string, seq long, kind string, level int, raw string"


def cited(text, marker, side="after"):
    at = text.index(marker)
    return references(text, at, at + len(marker), side)


@pytest.mark.parametrize(
    "text, marker, side, want",
    [
        ("Notwithstanding anything contained in sections 57 and 58, x", "contained in", "after", ["section:57", "section:58"]),
        ("subject to Secs . 7, 8 and 9A of it", "subject to", "after", ["section:7", "section:8", "section:9A"]),
        ("anything in this Act, the order in section 183", "anything in", "after", []),
        ("anything in section 12 of the Tax Act, no tax", "anything in", "after", []),
        ("anything in sub-sections (2) to (4)", "anything in", "after", ["sub:2", "sub:3", "sub:4"]),
        ("anything in sub-section (1) of section 9", "anything in", "after", ["section:9", "sub:1"]),
        ("In section 3, and in section 4, the words shall be omitted", "shall be omitted", "before", ["section:4"]),
        ("nothing in section 28, section 30 shall apply", "nothing in section 28, section 30", "within", ["section:28", "section:30"]),
    ],
)
def test_references(text, marker, side, want):
    assert [r for r, _ in cited(text, marker, side)] == want


def test_scope_of_a_sub_section():
    assert cited("in sub-section (1) of section 9a", "in") == [("section:9A", None), ("sub:1", "9A")]


def act(spark, *raws):
    rows = [(f"d:{i}", "d", i, "structural" if r.startswith("Section") else "proposition", 1 if r.startswith("Section") else 2 if r.startswith("(") else 9, r) for i, r in enumerate(raws)]
    return edges.linked(spark.createDataFrame(rows, NODES))


def found(spark, *raws):
    return {(r.src[2:], r.dst[2:], r.type) for r in edges.all_edges(act(spark, *raws)).collect()}


def test_edges_of_a_small_act(spark):
    got = found(
        spark, "Section 1. One", "(1) A rule holds.", "Provided that it does not on Sundays.", "(2) Notwithstanding anything contained in section 2, it holds.",
        "Section 2. Two", "(1) Subject to the provisions of sub-section (2) of section 1, all is well.", "(2) A cat shall be deemed to be a dog.",
    )
    assert {("2", "1", "exception_of"), ("3", "4", "supersedes"), ("5", "3", "conditioned_on"), ("5", "0", "conditioned_on"), ("5", "6", "defines"), ("1", "0", "part_of"), ("3", "1", "part_of"), ("3", "0", "part_of")} <= got


def test_duplicates_keep_the_most_confident(spark):
    rows = [("a", "x", "y", "defines", 0.6, "pattern", 3, "d"), ("b", "x", "y", "defines", 0.8, "pattern", 1, "d"), ("c", "x", "y", "cites", 0.1, "pattern", 3, "d")]
    got = edges.deduped(spark.createDataFrame(rows, "edge_id string, src string, dst string, type string, confidence double, provenance string, source int, doc_id string")).collect()
    assert {(r.edge_id, r["class"]) for r in got} == {("b", "closure"), ("c", "context")}


@pytest.mark.parametrize(
    "window, span, verdict, reason",
    [
        ("the quick\nbrown fox jumps", "quick\nbrown fox", "exact", None), ("the quick\n  brown fox jumps", "quick brown fox", "reflowed", None), ("abc", None, "rejected", "missing"), ("abc", " ", "rejected", "empty"),
        ("abc", "short", "rejected", "too_short"), ("The Quick Brown Fox", "the quick brown fox", "rejected", "case_mismatch_only"), ("abc", "something else here", "rejected", "not_in_window"),
    ],
)
def test_evidence(window, span, verdict, reason):
    got = sections.check_evidence(window, span)
    assert (got["verdict"], got["reason"]) == (verdict, reason) and (got["span"] is None or window[got["start"] : got["end"]] == got["span"])
