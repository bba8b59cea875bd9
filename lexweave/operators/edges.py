"""Deterministic edges: nesting, siblings, structural units, markers, references, de-duplication. One shuffle by document."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lexweave.functions import pack
from lexweave.sources.bundle import saved


def in_order():
    return W.partitionBy("doc_id").orderBy("seq")


DEEPEST = 9
"""The level of units that open no level of their own (provisos, explanations, plain text)."""


def nested(nodes: DataFrame) -> DataFrame:
    """nodes (doc_id, seq, node_id, level) with parent_id: the nearest earlier node of a smaller level."""
    parent = F.lit(None).cast("struct<seq:bigint,id:string>")
    at = F.struct(F.col("seq").cast("bigint").alias("seq"), F.col("node_id").alias("id"))
    for level in (0, 1, 2, 3):
        last = F.last(F.when(F.col("level") == level, at), ignorenulls=True).over(in_order().rowsBetween(W.unboundedPreceding, -1))
        parent = F.greatest(parent, F.when(F.col("level") > level, last))
    return nodes.withColumn("parent_id", parent["id"])


def siblings(nodes: DataFrame, parent: str = "parent_id") -> DataFrame:
    """nodes with prev_id and next_id: neighbours under the same parent; footnotes don't count, nor do nodes without a parent."""
    w = W.partitionBy("doc_id", parent, F.col("kind") == "footnote").orderBy("seq")
    real = (F.col("kind") != "footnote") & F.col(parent).isNotNull()
    return nodes.withColumns({"prev_id": F.when(real, F.lag("node_id").over(w)), "next_id": F.when(real, F.lead("node_id").over(w))})


def headings(nodes: DataFrame) -> DataFrame:
    """doc_id, section (number as in references), node_id: the last heading of a number counts."""
    number = F.upper(F.regexp_extract("raw", r"(?i)^\s*(?:(?:section|article)\s+)?(?:\d{1,3}\[)*(\d{1,9}[a-z]{0,2})\.?", 1))
    own = nodes.where("kind = 'structural'").withColumn("number", number).where("number != ''")
    return own.groupBy("doc_id", "number").agg(F.max_by("node_id", "seq").alias("heading_id"))


def unit_edges(nodes: DataFrame) -> DataFrame:
    """An edge for the first structural unit that fits a node: to the previous sibling, else the parent."""
    name, kind = F.lit(None).cast("string"), F.lit(None).cast("string")
    for unit, pattern, ignore_case, edge in reversed(pack.UNITS):
        fits = F.col("raw").rlike(pack.java(pattern, ignore_case))
        name, kind = F.when(fits, unit).otherwise(name), F.when(fits, edge).otherwise(kind)
    own = nodes.where("kind = 'proposition'").withColumns({"unit": name, "type": kind, "dst": F.coalesce("prev_id", "parent_id")})
    own = own.where("unit is not null and dst is not null")
    edge_id = F.concat_ws(":", F.lit("struct"), "unit", "node_id", "dst")
    return own.select(edge_id.alias("edge_id"), F.col("node_id").alias("src"), "dst", "type", F.lit(1.0).alias("confidence"), F.lit("structural").alias("provenance"), F.lit(2).alias("source"), "doc_id")


#: Letters beyond ASCII that patterns without case take for ASCII ones.
_FOLDED = ("ſıİ\u212a", "siik")


def low(text: Column) -> Column:
    """text in lower case, for held()."""
    return F.lower(F.translate(text, *_FOLDED))


def held(low: str, marker: pack.Marker) -> Column:
    """Does a text in lower case hold a word that every match of the marker has?"""
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in _word_of(marker.pattern).split("|")])


def opened(rows: DataFrame, array: Column, name: str) -> DataFrame:
    """rows, each repeated with one element of an array. explode() alone would have arrays made twice, as Spark filters by their size first."""
    return rows.withColumn(name, F.explode_outer(array)).where(F.col(name).isNotNull())


def marker_hits(nodes: DataFrame, markers=pack.MARKERS) -> DataFrame:
    """nodes with a row for each marker that fires: marker, type, target, side, confidence, span."""
    span = lambda m: F.when(held("_low", m), F.regexp_extract("raw", m.java, 0)).otherwise("")
    hits = [
        F.struct(F.lit(m.name).alias("marker"), F.lit(m.edge).alias("type"), F.lit(m.target).alias("target"), F.lit(m.side).alias("side"), F.lit(m.confidence).alias("confidence"), span(m).alias("span"))
        for m in markers
    ]
    own = nodes.where(F.col("kind") == "proposition").withColumn("_low", low(F.col("raw")))
    words = {w for m in markers for w in _word_of(m.pattern).split("|")}
    own = own.where(F.col("_low").rlike("|".join(sorted(words))))
    return opened(own, F.filter(F.array(*hits), lambda h: h["span"] != ""), "hit").select(*nodes.columns, "hit.*")


def _word_of(pattern: str) -> str:
    """The longest literal words of a pattern's alternatives, as a cheap test that lets no match through unseen."""
    words = {
        "notwithstanding": "notwithstanding", "subject": "subject", "save": "provided", "nothing": "nothing", "unless": "unless", "deemed": "deemed", "not apply": "apply", "purposes": "purpose", "substituted": "substituted",
        "inserted": "inserted", "omitted": "omitted", "repeal": "repeal", "overrul": "overrul|good", "incuriam": "incuriam", "distinguish": "distinguish|facts", "affirmed": "affirmed|upheld", "bexcept": "except", "however": "however", "survive": "survive", "liab": "liab|exceed",
    }
    flat = pattern.replace(r"\s+", " ")
    return "|".join(w for k, w in words.items() if k in flat)


_MARKERS = {m.name: pack.python(m.pattern) for m in pack.MARKERS}
_SECTION, _SUBSECTION, _FOREIGN, _BREAK = (pack.python(p) for p in (pack.SECTION_REF, pack.SUBSECTION_REF, pack.FOREIGN_REF, pack.BREAK))


def _spelled_out(listed: str) -> list[str]:
    """Numbers of a list like "(1), (2A) and (4) to (6)"; only ranges of plain numbers have members between."""
    out: list[str] = []
    for joint, number in re.findall(r"(?i)(\bto\b)?\s*\(\s*(\d{1,3}[a-z]?)\s*\)", listed):
        if joint and out and out[-1].isdigit() and number.isdigit():
            out += map(str, range(int(out[-1]) + 1, int(number)))
        out.append(number)
    return out


def references(text: str, start: int, end: int, side: str) -> list[tuple[str, str | None]]:
    """(kind:number, section) that a marker at text[start:end] cites, sections first, then sub-sections.

    After a marker, citations of a kind count up to the first clause break between two of them; before it, only the last
    of each kind does. Those of another act name nothing here.
    """
    window = {"after": text[end:], "within": text[start:end], "before": text[:start]}[side]
    out: list[tuple[str, str | None]] = []
    for pattern in (_SECTION, _SUBSECTION):
        found, at = [], 0
        for m in pattern.finditer(window):
            if side == "after" and _BREAK.search(window, at, m.start()):
                break
            found.append(m)
            at = m.end()
        for m in found[-1:] if side == "before" else found:
            if _FOREIGN.match(window[m.end() : m.end() + 160]):
                continue
            if pattern is _SECTION:
                out += [("section:" + x.upper(), None) for x in re.findall(r"\d{1,4}[A-Za-z]{0,2}", m[1])]
            else:
                out += [("sub:" + x.upper(), m[2] and m[2].upper()) for x in _spelled_out(m[1])]
    return list(dict.fromkeys(out))


def referenced(hits: DataFrame, nodes: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    """hits (doc_id, node_id, section_id, raw, marker, type, side, confidence) of markers that cite, with to: the headings and sub-sections that they name.

    Sub-sections are numbered only if some hit cites one.
    """

    @F.pandas_udf("array<struct<ref:string,section:string>>")
    def cited(raw: pd.Series, marker: pd.Series, side: pd.Series) -> pd.Series:
        out = []
        for text, name, where in zip(raw, marker, side):
            m = _MARKERS[name].search(text)
            out.append([{"ref": r, "section": s} for r, s in references(text, m.start(), m.end(), where)] if m else [])
        return pd.Series(out, dtype=object)

    heads = heads if heads is not None else headings(nodes)
    far = opened(hits, cited("raw", "marker", "side"), "cite")
    far = far.select("doc_id", "node_id", "section_id", "marker", "type", "confidence", F.regexp_extract("cite.ref", ":(.*)", 1).alias("number"), F.col("cite.ref").startswith("sub:").alias("sub"), F.col("cite.section").alias("of"))
    far = saved(far, "cited")
    cols = ["doc_id", "node_id", "to", "marker", "type", "confidence"]
    whole = far.where("not sub").join(heads, ["doc_id", "number"]).withColumn("to", F.col("heading_id")).select(cols)
    if not far.where("sub").take(1):
        return whole
    enumerated = nodes.withColumn("number", F.upper(F.regexp_extract("raw", r"^\s*\(\s*(\d{1,3}[A-Za-z]?)\s*\)", 1))).where("number != '' and section_id is not null")
    subs = enumerated.groupBy("doc_id", F.col("section_id").alias("in_id"), "number").agg(F.min_by("node_id", "seq").alias("sub_id"))
    named = heads.select("doc_id", F.col("number").alias("of"), F.col("heading_id").alias("of_id"))
    part = far.where("sub").join(named, ["doc_id", "of"], "left").withColumn("in_id", F.when(F.col("of").isNull(), F.col("section_id")).otherwise(F.col("of_id")))
    return whole.unionByName(part.join(subs, ["doc_id", "in_id", "number"]).withColumn("to", F.col("sub_id")).select(cols))


def _marked(rows: DataFrame) -> DataFrame:
    """Edges of rows (doc_id, node_id, to, marker, type, confidence)."""
    back = F.col("type") == "defines"
    own = rows.where("to is not null and to != node_id")
    return own.select(F.concat_ws(":", F.lit("marker"), "marker", "node_id", "to").alias("edge_id"), F.when(back, F.col("to")).otherwise(F.col("node_id")).alias("src"), F.when(back, F.col("node_id")).otherwise(F.col("to")).alias("dst"), "type", "confidence", F.lit("pattern").alias("provenance"), F.lit(3).alias("source"), "doc_id").distinct()


def marker_edges(nodes: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    """Edges of all markers. nodes need parent_id, prev_id, next_id and section_id (the enclosing heading)."""
    hits = marker_hits(nodes)
    near = hits.where("target != 'referenced'").withColumn("to", F.when(F.col("target") == "following", F.col("next_id")).otherwise(F.coalesce("prev_id", "parent_id")))
    far = referenced(hits.where("target = 'referenced'"), nodes, heads)
    return _marked(near.select(far.columns).unionByName(far))


def part_of(nodes: DataFrame) -> DataFrame:
    own = nodes.where("parent_id is not null")
    return own.select(F.concat_ws(":", F.lit("struct"), "node_id", F.lit("part_of"), "parent_id").alias("edge_id"), F.col("node_id").alias("src"), F.col("parent_id").alias("dst"), F.lit("part_of").alias("type"), F.lit(1.0).alias("confidence"), F.lit("structural").alias("provenance"), F.lit(0).alias("source"), "doc_id")


def deduped(edges: DataFrame) -> DataFrame:
    """One edge for each (src, dst, type): the most confident, then the earliest source, then the smallest id."""
    best = F.min_by(F.struct("edge_id", "confidence", "provenance", "source", "doc_id"), F.struct(-F.col("confidence"), "source", "edge_id"))
    return _classed(edges.groupBy("src", "dst", "type").agg(best.alias("_b")).select("src", "dst", "type", "_b.*"))


def _classed(edges: DataFrame) -> DataFrame:
    return edges.withColumn("class", F.when(F.col("type").isin(*sorted(pack.CLOSURE)), "closure").otherwise("context"))


def sectioned(nodes: DataFrame) -> DataFrame:
    """nodes with section_id: the last structural node at or before each."""
    return nodes.withColumn("section_id", F.last(F.when(F.col("kind") == "structural", F.col("node_id")), ignorenulls=True).over(in_order()))


def linked(nodes: DataFrame) -> DataFrame:
    return siblings(nested(sectioned(nodes)))


@dataclass(frozen=True)
class Kind:
    """A kind of edge that a node's own text and neighbours give."""

    confidence: float
    source: int
    prefix: str
    """What its edges' ids begin with."""
    type: str
    target: str
    """parent, preceding (the previous sibling, else the parent) or following."""
    marker: str | None = None


#: In the order in which deduped() prefers edges of the same ends and type.
KINDS = sorted(
    [Kind(1.0, 0, "struct", "part_of", "parent"), *(Kind(1.0, 2, f"struct:{n}:", e, "preceding") for n, _, _, e in pack.UNITS)]
    + [Kind(m.confidence, 3, f"marker:{m.name}:", m.edge, m.target, m.name) for m in pack.MARKERS if m.target != "referenced"],
    key=lambda k: (-k.confidence, k.source, k.prefix),
)
FAR = tuple(m for m in pack.MARKERS if m.target == "referenced")


def _found(nodes: DataFrame) -> DataFrame:
    """nodes with kinds (places in KINDS, ascending) and far (places in FAR, ascending) of what their texts hold; raw is kept where there is some far."""
    unit = F.lit(None).cast("int")
    for name, pattern, ignore_case, _ in reversed(pack.UNITS):
        at = next(i for i, k in enumerate(KINDS) if k.prefix == f"struct:{name}:")
        unit = F.when(F.col("raw").rlike(pack.java(pattern, ignore_case)), at).otherwise(unit)
    real = F.col("kind") == "proposition"
    fits = lambda m: real & held("_low", m) & F.col("raw").rlike(m.java)
    by_name = {m.name: m for m in pack.MARKERS}
    some = lambda *c: F.array_compact(F.array(*c))
    marks = [F.when(fits(by_name[k.marker]), i) for i, k in enumerate(KINDS) if k.marker]
    own = nodes.withColumn("_low", low(F.col("raw")))
    own = own.select("doc_id", "node_id", "parent_id", "prev_id", "next_id", "section_id", "raw", some(F.lit(0), F.when(real, unit), *marks).alias("kinds"), some(*[F.when(fits(m), i) for i, m in enumerate(FAR)]).alias("far"))
    return own.withColumn("raw", F.when(F.size("far") > 0, F.col("raw")))


def all_edges(nodes: DataFrame, mentions: DataFrame | None = None) -> DataFrame:
    """nodes: linked(), each node_id once. part_of, mention, unit and marker edges, de-duplicated.

    What a node's own text and neighbours give is de-duplicated within its row. Only edges that other rows may give too meet in
    deduped(): those of citations and of their types, definitions (some point back) and, if there are mentions, all.
    """
    found = saved(_found(nodes), "found")
    of = lambda values, at: F.element_at(F.array(*map(F.lit, values)), at + 1)
    type_ = lambda at: of([k.type for k in KINDS], at)
    end = lambda at: F.when(of([k.target for k in KINDS], at) == "parent", F.col("parent_id")).when(of([k.target for k in KINDS], at) == "following", F.col("next_id")).otherwise(F.coalesce("prev_id", "parent_id"))
    ends = F.transform("kinds", lambda k: F.struct(k.alias("kind"), end(k).alias("to"), type_(k).alias("type")))
    ends = F.filter(ends, lambda e: e["to"].isNotNull() & ((of([k.marker is None for k in KINDS], e["kind"])) | (e["to"] != F.col("node_id"))))
    far_types = F.transform("far", lambda i: of([m.edge for m in FAR], i))
    shared = lambda e: (e["type"] == "defines") | F.array_contains("_far", e["type"]) if mentions is None else F.lit(True)
    own = found.select("*", ends.alias("ends"), far_types.alias("_far"))
    own = own.select("doc_id", "node_id", F.filter("ends", lambda e: ~shared(e)).alias("lone"), F.filter("ends", shared).alias("shared"))
    first = lambda e, i: ~F.exists(F.slice("lone", F.lit(1), i), lambda x: (x["to"] == e["to"]) & (x["type"] == e["type"]))

    def edges(rows: DataFrame) -> DataFrame:
        """rows: (doc_id, node_id, e)."""
        kind, to = F.col("e.kind"), F.col("e.to")
        is_part = kind == next(i for i, k in enumerate(KINDS) if k.target == "parent")
        edge_id = F.when(is_part, F.concat_ws(":", F.lit("struct"), "node_id", F.lit("part_of"), to)).otherwise(F.concat(of([k.prefix for k in KINDS], kind), "node_id", F.lit(":"), to))
        back = of([k.marker is not None and k.type == "defines" for k in KINDS], kind)
        src, dst = F.when(back, to).otherwise(F.col("node_id")), F.when(back, F.col("node_id")).otherwise(to)
        source = of([k.source for k in KINDS], kind)
        return rows.select(src.alias("src"), dst.alias("dst"), F.col("e.type").alias("type"), edge_id.alias("edge_id"), of([k.confidence for k in KINDS], kind).alias("confidence"), F.when(source == 3, "pattern").otherwise("structural").alias("provenance"), source.alias("source"), "doc_id")

    far = found.where("size(far) > 0").select("doc_id", "node_id", "section_id", "raw", F.explode("far").alias("i"))
    far = far.select("doc_id", "node_id", "section_id", "raw", *[of([getattr(m, a) for m in FAR], F.col("i")).alias(name) for name, a in (("marker", "name"), ("type", "edge"), ("side", "side"), ("confidence", "confidence"))])
    met = edges(opened(own, F.col("shared"), "e")).unionByName(_marked(referenced(far, nodes)))
    lone = edges(opened(own, F.filter("lone", first), "e"))
    return _classed(lone).unionByName(deduped(met if mentions is None else met.unionByName(mentions)))
