"""Evaluation: densities by unit, gate reports by term, gold spans, retrieval arms, case validation, mining of hard cases."""

from __future__ import annotations

from collections import Counter
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.functions import pack
from lexweave.operators import graph
from lexweave.operators.edges import held, low, opened
from lexweave.sources.bundle import saved

# Results depend on exactly these patterns, words and numbers.
UNIT_BREAK = r"(?<=[.;:])\s+(?=[A-Z(\"“])|\n{2,}"
UNIT_CHARS, GOLD_CHARS, PROBE, LEAST_PROBE = 25, 25, 80, 60
LEAST_GOLD, LEAST_RULE = 80, 40
QUOTED = "[\"“«]"
CAUSES = ("lost_referent", "lost_scope", "lost_exception", "wrong_version", "needs_aggregation", "topic_not_proposition")
MINED = {"exception_of": "lost_exception", "supersedes": "wrong_version", "amends": "wrong_version", "conditioned_on": "lost_scope"}
# End of the fixed values.


def split_units(texts: DataFrame) -> DataFrame:
    """texts (doc_id, text) as doc_id, unit_no, unit: what stands between sentence ends, if longer than UNIT_CHARS."""
    parts = F.transform(F.split("text", pack.java(UNIT_BREAK, False)), lambda p: F.regexp_replace(p, r"(?U)^\s+|\s+$", ""))
    return texts.select("doc_id", F.posexplode(F.filter(parts, lambda p: F.length(p) > UNIT_CHARS)).alias("unit_no", "unit"))


def _any(text: Column, patterns) -> Column:
    return reduce(lambda a, b: a | b, [text.rlike(pack.java(p, i)) for p, i in patterns])


#: For each of pack.CITATIONS, words one of which every match has (in lower case where the pattern ignores case).
CITED = (("scc",), ("air",), ("insc",), ("scc",), ("scr", "crilj", "itr"), ("ec", "§"), ("rticle",), ("Act",), ("ule",), ("ule",), ("lause",), ("Schedule", "Annexure", "Exhibit", "Appendix"))


def _cites(text: Column, citation: tuple[str, bool], words: tuple[str, ...]) -> Column:
    pattern, ignore_case = citation
    where = F.col("_low") if ignore_case else text
    return reduce(lambda a, b: a | b, [F.contains(where, F.lit(w)) for w in words]) & text.rlike(pack.java(pattern, ignore_case))


def unit_hits(units: DataFrame) -> DataFrame:
    """units (unit) with closure, context (does it have a mark of the kind?), defines, cites and marks (names that fit)."""
    text = F.col("unit")
    own = [(f"struct:{n}", text.rlike(pack.java(p, i)), e in pack.CLOSURE) for n, p, i, e in pack.UNITS]
    own += [(f"marker:{m.name}", held("_low", m) & text.rlike(m.java), True) for m in pack.MARKERS]
    marks = F.filter(F.array(*[F.when(hit, F.struct(F.lit(n).alias("name"), F.lit(c).alias("closure"))) for n, hit, c in own]), lambda m: m.isNotNull())
    # every definition has a quotation mark
    defines, cites = text.rlike(QUOTED) & _any(text, [(p, True) for _, p in pack.DEFINITIONS]), reduce(lambda a, b: a | b, [_cites(text, *c) for c in zip(pack.CITATIONS, CITED)])
    made = units.withColumn("_low", low(text)).withColumns({"marks": marks, "defines": defines, "cites": cites}).drop("_low")
    return made.withColumns({"closure": F.exists("marks", lambda m: m["closure"]), "context": F.exists("marks", lambda m: ~m["closure"])})


def density(hits: DataFrame) -> DataFrame:
    """doc_id, units, closure_units, context_units, definitions, citations."""
    count = lambda c: F.count_if(F.col(c)).alias({"closure": "closure_units", "context": "context_units", "defines": "definitions", "cites": "citations"}[c])
    return hits.groupBy("doc_id").agg(F.count(F.lit(1)).alias("units"), *map(count, ("closure", "context", "defines", "cites")))


def mark_counts(hits: DataFrame) -> DataFrame:
    return opened(hits, F.col("marks.name"), "mark").groupBy("mark").agg(F.count(F.lit(1)).alias("n"))


def gate_terms(texts: DataFrame) -> DataFrame:
    """texts (text) of windows: term, windows (that have it), alone (that have no other)."""
    low = F.lower("text")
    found = F.filter(F.array(*[F.when(low.contains(t), F.lit(t)) for t in pack.GATE_TERMS]), lambda t: t.isNotNull())
    own = texts.select(found.alias("terms")).select(F.explode("terms").alias("term"), (F.size("terms") == 1).alias("alone"))
    return own.groupBy("term").agg(F.count(F.lit(1)).alias("windows"), F.count_if("alone").alias("alone"))


def gate_by_document(sections: DataFrame) -> DataFrame:
    """sections (doc_id, admitted) as one row: documents, least, median and most of the documents' admitted shares."""
    by = sections.groupBy("doc_id").agg(F.avg(F.col("admitted").cast("double")).alias("share"))
    return by.agg(F.count(F.lit(1)).alias("documents"), F.min("share").alias("least"), F.median("share").alias("middle"), F.max("share").alias("most"))


def parser_report(units: DataFrame, documents: DataFrame) -> DataFrame:
    """units (doc_id, raw): doc_id, nodes, median, p95 and most characters, parse_confidence."""
    n = F.length("raw")
    by = units.groupBy("doc_id").agg(F.count(F.lit(1)).alias("nodes"), F.array_sort(F.collect_list(n)).alias("_n"))
    middle = lambda i: F.get("_n", F.floor((F.size("_n") + i) / 2).cast("int"))
    by = by.withColumn("median_chars", (middle(-1) + middle(0)) / 2)
    by = by.withColumns({"p95_chars": F.get("_n", F.floor(F.lit(0.95) * F.col("nodes")).cast("int")), "max_chars": F.array_max("_n")}).drop("_n")
    return by.join(documents.select("doc_id", "parse_confidence"), "doc_id")


def flat(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")))


#: Length and step of the grams that tell which texts may hold each other; rows of a document (or of many small ones) that meet at once.
GRAM, STEP, MEET = 12, 4, 20_000


def holders(patterns: list[str], texts: list[str]) -> list[tuple[int, int]]:
    """(place of pattern, place of text) of all patterns that stand in texts.

    Each pattern is known by its rarest gram, so texts are compared only with patterns whose gram they hold.
    """
    out: list[tuple[int, int]] = []
    places: dict[str, list[int]] = {}
    for i, p in enumerate(patterns):
        places.setdefault(p, []).append(i)
    short, starts, count = [], {}, Counter()
    for p in places:
        if len(p) < GRAM:
            short.append(p)
        else:
            starts[p] = at = [*range(0, len(p) - GRAM, STEP), len(p) - GRAM]
            count.update(p[i : i + GRAM] for i in at)
    known: dict[str, list[tuple[int, str]]] = {}
    for p, at in starts.items():
        i = min(at, key=lambda i: count[p[i : i + GRAM]])
        known.setdefault(p[i : i + GRAM], []).append((i, p))
    least, found = min(map(len, places), default=0), {}
    for n, text in enumerate(texts):
        if len(text) < least:
            continue
        if text not in found:
            hits = {p for p in short if p in text}
            if known:
                for j in range(len(text) - GRAM + 1):
                    for i, p in known.get(text[j : j + GRAM], ()):
                        if j >= i and text.startswith(p, j - i):
                            hits.add(p)
            found[text] = [i for p in hits for i in places[p]]
        out += [(i, n) for i in found[text]]
    return out


def overlaps(golds: list[str], raws: list[str]) -> list[tuple[int, int]]:
    """(place of gold, place of raw) of all pairs that gold_nodes() takes for the same text."""
    patterns, of = [], []
    for n, raw in enumerate(raws):
        # a text of more than PROBE characters stands in a span only if its first ones do
        own = [raw] if len(raw) <= PROBE else [raw[:PROBE], raw[-PROBE:]]
        patterns += own
        of += [n] * len(own)
    return sorted({(g, of[p]) for p, g in holders(patterns, golds)} | set(holders(golds, raws)))


def gold_nodes(cases: DataFrame, nodes: DataFrame) -> DataFrame:
    """cases (case_id, doc_id, gold_span): case_id, node_id of the nodes of the case's document whose text overlaps the gold span.

    One holds the other, or the node's first or last PROBE characters stand in the span; white space and case don't count.
    Cases and nodes of a document meet in blocks of about MEET rows of each; small documents share a block.
    """
    own = nodes.select("doc_id", "node_id", flat(F.col("raw")).alias("text")).where(F.length("text") >= GOLD_CHARS)
    asked = cases.select("doc_id", "case_id", flat(F.col("gold_span")).alias("text")).where("text is not null and doc_id is not null")
    parts = lambda rows, name: rows.groupBy("doc_id").agg(F.ceil(F.count(F.lit(1)) / MEET).cast("int").alias(name), F.count(F.lit(1)).alias("n_" + name))
    sizes = saved(parts(own, "rows").join(parts(asked, "asked"), "doc_id"), "gold-sizes")
    total = sizes.agg(F.sum(F.col("n_rows") * F.col("asked") + F.col("n_asked") * F.col("rows"))).first()[0] or 0
    blocks = -(-total // (2 * MEET)) or 1
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    part = lambda n, of: F.pmod(F.xxhash64(of), F.col(n)).cast("int")
    where = F.pmod(F.xxhash64("doc_id", "i", "j"), F.lit(blocks)).alias("block")
    left = asked.join(sizes, "doc_id").withColumn("i", part("asked", "case_id")).withColumn("j", every("rows")).select(where, F.col("doc_id").alias("doc"), "i", "j", "case_id", "text")
    right = own.join(sizes, "doc_id").withColumn("j", part("rows", "node_id")).withColumn("i", every("asked")).select(where, F.col("doc_id").alias("doc"), "i", "j", F.col("node_id").alias("node_id"), "text")

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        case, node, key = [], [], ["doc", "i", "j"]
        others = {k: (r["node_id"].tolist(), r["text"].tolist()) for k, r in right.groupby(key)}
        for k, l in left.groupby(key):
            if k in others:
                cases, (ids, raws) = l["case_id"].tolist(), others[k]
                for g, n in overlaps(l["text"].tolist(), raws):
                    case.append(cases[g])
                    node.append(ids[n])
        return pd.DataFrame({"case_id": pd.Series(case, dtype=left["case_id"].dtype), "node_id": pd.Series(node, dtype=right["node_id"].dtype)})

    types = {n: df.schema[n].dataType.simpleString() for df, n in ((cases, "case_id"), (nodes, "node_id"))}
    return left.groupBy("block").cogroup(right.groupBy("block")).applyInPandas(meet, f"case_id {types['case_id']}, node_id {types['node_id']}")


def arms(cases: DataFrame, gold: DataFrame, seeds: DataFrame, context: DataFrame, closure: DataFrame) -> DataFrame:
    """cases (case_id, cause) with arm_a (seeds), arm_b (seeds and context), arm_c (all): seed, expansion, never or no gold node.

    The others: (case_id, node_id); closure holds what the whole read path shows.
    """
    def has(rows: DataFrame, name: str) -> DataFrame:
        return gold.join(rows.select("case_id", "node_id").distinct(), ["case_id", "node_id"], "left_semi").select("case_id", F.lit(True).alias(name)).distinct()

    own = cases.join(gold.select("case_id", F.lit(True).alias("_any")).distinct(), "case_id", "left")
    for rows, name in ((seeds, "_seed"), (context, "_context"), (closure, "_closure")):
        own = own.join(has(rows, name), "case_id", "left")
    where = lambda pool: F.when(F.col("_any").isNull(), "no gold node").when(F.col("_seed"), "seed").when(pool, "expansion").otherwise("never")
    no = F.lit(False)
    return own.select(*cases.columns, where(no).alias("arm_a"), where(F.coalesce("_context", no)).alias("arm_b"), where(F.coalesce("_closure", no)).alias("arm_c"))


def arms_by_cause(rows: DataFrame) -> DataFrame:
    reached = lambda arm: F.count_if(F.col(arm).isin("seed", "expansion")).alias(arm.replace("arm", "reached"))
    return rows.groupBy("cause").agg(F.count(F.lit(1)).alias("cases"), *map(reached, ("arm_a", "arm_b", "arm_c")))


def case_errors(cases: DataFrame, texts: DataFrame) -> DataFrame:
    """cases (case_id, cause, doc_id, gold_span), texts (doc_id, text): case_id, error. A gold span must stand in its document letter by letter."""
    own = cases.join(texts.select("doc_id", "text"), "doc_id", "left")
    found = [
        F.when(~F.coalesce(F.col("cause").isin(*CAUSES), F.lit(False)), F.concat(F.lit("unknown cause "), F.coalesce("cause", F.lit("null")))),
        F.when(F.col("text").isNull(), F.lit("no such document")).when(~F.contains("text", "gold_span"), F.lit("gold span not in the document")),
    ]
    return own.select("case_id", F.explode(F.filter(F.array(*found), lambda e: e.isNotNull())).alias("error"))


def mined(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """gold_id, rule_id, cause: carve-outs and what they change, a case for each carve-out (of its smallest edge), long enough to ask about."""
    cause = F.create_map(*[F.lit(x) for kv in MINED.items() for x in kv])[F.col("type")]
    size = nodes.select("node_id", F.length(F.trim("raw")).alias("n"))
    own = edges.where("src != dst").withColumn("cause", cause).where("cause is not null")
    own = own.join(size.where(F.col("n") >= LEAST_GOLD).select(F.col("node_id").alias("src")), "src", "left_semi").join(size.where(F.col("n") >= LEAST_RULE).select(F.col("node_id").alias("dst")), "dst", "left_semi")
    best = F.min_by(F.struct("dst", "cause"), F.struct("edge_id"))
    return own.groupBy(F.col("src").alias("gold_id")).agg(best.alias("b")).select("gold_id", F.col("b.dst").alias("rule_id"), "b.cause")


def lint(nodes: DataFrame, terms: DataFrame, edges: DataFrame) -> DataFrame:
    """finding, subject_id, doc_id: terms that are unused, shadowed (another of the name in the document or corpus), undefined ones in quotes, and nodes that reach themselves."""
    used = edges.where("type = 'defines'").select(F.col("dst").alias("definition_id")).distinct()
    unused = terms.join(used, "definition_id", "left_anti").select(F.lit("unused term").alias("finding"), F.col("term_id").alias("subject_id"), "doc_id")
    named = terms.groupBy("canonical").agg(F.count_distinct("scope_id").alias("scopes")).where("scopes > 1")
    shadowed = terms.join(named, "canonical", "left_semi").select(F.lit("shadowed term").alias("finding"), F.col("term_id").alias("subject_id"), "doc_id")
    quoted = nodes.where("kind = 'proposition'").select("doc_id", "node_id", F.explode(F.array_distinct(F.regexp_extract_all("raw", F.lit('["“]([^"”]{2,80})["”]'), F.lit(1)))).alias("surface"))
    known = terms.select("doc_id", F.col("canonical").alias("_c")).distinct()
    missing = quoted.withColumn("_c", F.lower(F.trim("surface"))).join(known, ["doc_id", "_c"], "left_anti")
    undefined = missing.select(F.lit("undefined term").alias("finding"), F.col("node_id").alias("subject_id"), "doc_id").distinct()
    return unused.unionByName(shadowed).unionByName(undefined).unionByName(circular(nodes, edges))


def circular(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that closure leads back to."""
    walk = graph.steps(edges, "closure")
    first = walk.select(F.col("from_id").alias("query_id"), F.col("to_id").alias("node_id")).distinct()
    reached, _ = graph.closure(first, walk.withColumn("max_hops", F.lit(None).cast("int")), nodes)
    back = reached.where("query_id = node_id").select(F.col("node_id").alias("subject_id")).distinct()
    return back.join(nodes.select(F.col("node_id").alias("subject_id"), "doc_id"), "subject_id").select(F.lit("circular").alias("finding"), "subject_id", "doc_id")


def section_order(number: Column) -> list[Column]:
    """Sort keys for section numbers: 2 before 10, 10 before 10A."""
    return [F.regexp_extract(number, r"^(\d+)", 1).cast("long"), F.upper(F.regexp_extract(number, r"^\d+(.*)$", 1))]


def without_titles(sections: DataFrame, title: Column | str = "title") -> DataFrame:
    """sections (doc_id, seq, text, title): text without a first line that repeats the document's title, but for the first section."""
    from pyspark.sql import Window as W

    title = F.col(title) if isinstance(title, str) else title
    first = F.row_number().over(W.partitionBy("doc_id").orderBy("seq")) == 1
    head = F.trim(F.regexp_extract("text", r"^([^\n]*)", 1))
    rest = F.regexp_replace("text", r"^[^\n]*\n?\s*", "")
    return sections.withColumn("_first", first).withColumn("text", F.when(~F.col("_first") & (head == F.trim(title)), rest).otherwise(F.col("text"))).drop("_first")
