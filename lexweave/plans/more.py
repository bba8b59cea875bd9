"""More queries: every unit, marker, definition and kind of line, lookups, the model and embedding passes, evaluation, and the read path's options."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.functions import pack
from lexweave.functions.text import KEY_STOPWORDS
from lexweave.operators import analytics, conflict, edges, embed, evaluate, extract, graph, lexicon, lookup, parse, retrieval, sections
from lexweave.plans import ask
from lexweave.plans.catalog import D_INDEX, ORACLE_TOKENS, S_CONTEXT, S_REACH, _closed, _questions, _scored, load, query, statute_edges, statute_nodes
from lexweave.sources import bundle, cases, clauses, statute

GATE = " OR ".join(f"contains(lower({{0}}), '{t}')" for t in pack.GATE_TERMS)


# every pattern of the pack


@query(clauses.oracle("SELECT node_id, marker, CASE WHEN marker IN ('unless', 'for_the_purposes_of', 'distinguished', 'affirmed') THEN 0.6 ELSE 1.0 END :: DOUBLE AS confidence FROM x WHERE marker IS NOT NULL"))
def marker_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges.marker_hits(clauses.nodes(spark, sf_dir)).select("node_id", "marker", "confidence")


@query(clauses.oracle("SELECT node_id, unit FROM x WHERE unit IS NOT NULL"))
def unit_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = clauses.nodes(spark, sf_dir).withColumns({"prev_id": F.lit(None).cast("string"), "parent_id": F.lit("top")})
    return edges.unit_edges(own).select(F.col("src").alias("node_id"), F.split("edge_id", ":")[1].alias("unit"))


@query(clauses.oracle("SELECT node_id AS definition_id, surface, definition_kind FROM x WHERE surface IS NOT NULL"))
def definition_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon.terms(clauses.nodes(spark, sf_dir)).select("definition_id", "surface", "definition_kind")


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.array_sort(F.collect_list(F.struct("seq", "raw")))
    texts = clauses.nodes(spark, sf_dir).groupBy("doc_id").agg(F.array_join(F.transform(parts, lambda p: p["raw"]), " ").alias("text"))
    return evaluate.unit_hits(evaluate.split_units(texts))


X_MARKS = """m AS (SELECT *, marker IS NOT NULL AS marked, unit IN ('proviso', 'explanation', 'exception') AS closes FROM x)"""


@query(clauses.oracle(X_MARKS + """ SELECT doc_id, count(*) AS units, count(*) FILTER (WHERE marked OR closes) AS closure_units, count(*) FILTER (WHERE unit IS NOT NULL AND NOT closes) AS context_units,
  count(*) FILTER (WHERE surface IS NOT NULL) AS definitions, count(*) FILTER (WHERE cites) AS citations FROM m GROUP BY doc_id"""))
def density_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clauses, written out as texts and split into units again."""
    return evaluate.density(_hits(spark, sf_dir))


@query(clauses.oracle("SELECT mark, count(*) AS n FROM (SELECT 'marker:' || marker AS mark FROM x WHERE marker IS NOT NULL UNION ALL SELECT 'struct:' || unit FROM x WHERE unit IS NOT NULL) GROUP BY mark"))
def mark_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.mark_counts(_hits(spark, sf_dir))


@query(clauses.lines_oracle())
def line_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.units(clauses.texts(spark, sf_dir)).select("doc_id", F.col("seq").alias("n"), "unit", "raw")


@query(f"""WITH o AS (SELECT l_orderkey AS ok, min(l_partkey) AS p FROM lineitem GROUP BY l_orderkey), l(line) AS (VALUES {", ".join(f"('{line}')" for _, line in clauses.LINES)}),
n AS (SELECT 't' || CAST(ok AS VARCHAR) AS doc_id, length(replace(line, '{{p}}', CAST(p AS VARCHAR))) AS n FROM o, l)
SELECT doc_id, count(*) AS nodes, median(n) AS median_chars, max(n) AS p95_chars, max(n) AS max_chars, 1.0 :: DOUBLE AS parse_confidence FROM n GROUP BY doc_id""")
def parser_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = bundle.saved(parse.units(clauses.texts(spark, sf_dir)), "units")
    own = evaluate.parser_report(made.where("seq is not null"), parse.documents(made))
    return own.withColumns({"p95_chars": F.col("p95_chars").cast("long"), "max_chars": F.col("max_chars").cast("long")})


# lookups


@query(statute.oracle("""i AS (SELECT DISTINCT 'd' || CAST((l_orderkey - l_orderkey % 1000) // 1000 AS VARCHAR) || ':' || CAST(l_orderkey * 10 + l_linenumber + 1 AS VARCHAR) AS node_id FROM lineitem)
SELECT i.node_id, s.node_id IS NOT NULL AS found FROM i LEFT JOIN s ON s.node_id = i.node_id"""))
def node_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line after each line item, whether it is there or not."""
    at = "concat('d', cast((l_orderkey - l_orderkey % 1000) / 1000 as bigint), ':', l_orderkey * 10 + l_linenumber + 1)"
    ids = load(spark, sf_dir, "lineitem").select(F.expr(at).alias("node_id"))
    return lookup.get_nodes(statute.nodes(spark, sf_dir), ids).select("node_id", "found")


@query(statute.oracle("SELECT a.node_id AS anchor_id, b.node_id FROM s a JOIN s b ON a.doc_id = b.doc_id AND a.section = b.section AND a.ln > 0 AND b.ln > 0 UNION ALL SELECT node_id, node_id FROM s WHERE ln = 0"))
def section_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = statute.nodes(spark, sf_dir).withColumn("section_path", F.expr("if(ln = 0, null, cast(section as string))"))
    return lookup.get_sections(own, own.select("node_id")).select("anchor_id", "node_id")


@query(statute.oracle("SELECT src AS node_id, dst AS neighbor_id, type, 'out' AS direction FROM e WHERE type <> 'part_of' UNION ALL SELECT dst, src, type, 'in' FROM e WHERE type <> 'part_of'"))
def neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = bundle.saved(statute_nodes(spark, sf_dir), "nodes")
    return lookup.neighbors(statute_edges(spark, sf_dir, nodes), nodes.select("node_id"), ("exception_of", "supersedes", "conditioned_on"))


S_TERMS = "t AS MATERIALIZED (SELECT doc_id, node_id, section, p, ok FROM s WHERE ln % 4 = 3 AND ok % 7 = 0), u AS MATERIALIZED (SELECT doc_id, node_id, section, p, ok FROM s WHERE ln % 4 = 3)"


@query(statute.oracle(S_TERMS + " SELECT DISTINCT t.node_id AS definition_id, u.node_id, CASE WHEN t.section = u.section THEN 'section' ELSE 'document' END AS scope FROM u JOIN t ON t.doc_id = u.doc_id AND t.p = u.p WHERE t.node_id <> u.node_id"))
def find_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = bundle.saved(statute_nodes(spark, sf_dir), "nodes")
    terms = bundle.saved(lexicon.terms(nodes), "terms")
    return lexicon.find_references(lexicon.mentions(nodes, terms), nodes, terms)


@query(statute.oracle(S_TERMS + """, uses AS (SELECT * FROM u),
g AS (SELECT uses.doc_id, uses.node_id, p, (SELECT min(t.node_id) FROM t WHERE t.p = uses.p AND t.doc_id = uses.doc_id AND t.section = uses.section) AS d3, (SELECT min(t.node_id) FROM t WHERE t.p = uses.p AND t.doc_id = uses.doc_id) AS d2,
  (SELECT min(t.node_id) FROM t WHERE t.p = uses.p) AS d1 FROM uses)
SELECT DISTINCT doc_id, node_id, 'stock ' || CAST(p AS VARCHAR) AS canonical, coalesce(d3, d2, d1) AS definition_id, CASE WHEN d3 IS NOT NULL THEN 0 WHEN d2 IS NOT NULL THEN 1 ELSE 2 END AS distance FROM g WHERE d1 IS NOT NULL"""))
def goto_definition(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = bundle.saved(statute_nodes(spark, sf_dir), "nodes")
    uses = nodes.where("ln % 4 = 3").select("doc_id", "node_id", "section_id", F.concat(F.lit("stock "), "p").alias("canonical"))
    return lexicon.goto_definition(uses, lexicon.terms(nodes))


@query(statute.oracle("""v AS (SELECT node_id AS root, node_id, 0 AS hops FROM s WHERE ln = 0 UNION SELECT v.root, e.src, v.hops + 1 FROM v JOIN e ON e.dst = v.node_id AND e.type = 'supersedes' WHERE v.hops < 20),
d AS (SELECT root, v.node_id, min(hops) AS hops, any_value(coalesce(s.p, 0)) AS dated FROM v JOIN s ON s.node_id = v.node_id GROUP BY root, v.node_id)
SELECT root AS query_id, node_id, row_number() OVER (PARTITION BY root ORDER BY dated, hops, node_id) AS place FROM d"""))
def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = bundle.saved(statute_nodes(spark, sf_dir).withColumn("dated", F.coalesce("p", F.lit(0))), "nodes")
    return lookup.timeline(nodes, statute_edges(spark, sf_dir, nodes), nodes.where("ln = 0")).select("query_id", "node_id", "place")


@query("""WITH k AS (SELECT doc_id AS id, lower(regexp_replace(text, '[^\\p{L}\\p{N}]+', '', 'g')) AS k FROM documents), m AS (SELECT k, min(id) AS dst FROM k WHERE k <> '' GROUP BY k)
SELECT k.id AS src, m.dst, 'possibly_same_as' AS type FROM k JOIN m ON m.k = k.k WHERE k.id <> m.dst""")
def same_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return lookup.same_entities(own, F.col("text")).select("src", "dst", "type")


@query("""SELECT o_custkey AS id, count(*) AS n FROM orders WHERE o_orderdate <= TIMESTAMP '1996-06-01' AND (o_orderstatus <> 'F' OR o_orderdate + INTERVAL 90 DAY > TIMESTAMP '1996-06-01') GROUP BY o_custkey""")
def in_force(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = load(spark, sf_dir, "orders").selectExpr("o_custkey as id", "o_orderdate as valid_from", "if(o_orderstatus = 'F', o_orderdate + interval 90 days, null) as valid_to")
    return lookup.as_of(own, F.lit("1996-06-01").cast("timestamp")).groupBy("id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_type AS stage, count(DISTINCT user_id) AS documents, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS duration_ms FROM events GROUP BY ROLLUP (event_type)")
def ledger_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = load(spark, sf_dir, "events").selectExpr("cast(user_id as string) as doc_id", "event_type as stage", "cast(floor(value) as bigint) as duration_ms", "cast(null as bigint) as input_tokens", "cast(null as bigint) as output_tokens", "cast(null as string) as model_id")
    return cases.costs(own).where("level in (1, 3)").select("stage", "documents", "duration_ms")


@query(f"""WITH {D_INDEX}, r AS (SELECT query_id, scored.id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, scored.id) AS rank FROM scored JOIN documents ON documents.doc_id = scored.id WHERE score > 0 AND lang = 'en')
SELECT * FROM r WHERE rank <= 5""")
def search_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", "lang")
    return retrieval.search(docs, _questions(spark, sf_dir), 5, "lang = 'en'").select("query_id", "id", F.round("score", 6).alias("score"), "rank")


WORDS = "list_distinct(list_filter(regexp_extract_all(lower({0}), '[a-z]{{3,}}'), lambda x: NOT list_contains([" + ", ".join(f"'{w}'" for w in analytics.OVERLAP_STOPWORDS) + "], x)))"


@query(f"""WITH {D_INDEX}, c AS (SELECT query_id, id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM scored WHERE score > 0) WHERE rank <= 32),
w AS (SELECT query_id, id, {WORDS.format("benchmark.text")} AS q, {WORDS.format("documents.text")} AS g FROM c JOIN benchmark ON item_id = query_id JOIN documents ON doc_id = id),
v AS (SELECT query_id, id, CASE WHEN len(q) = 0 THEN 1.0 :: DOUBLE ELSE len(list_intersect(q, g)) / CAST(len(q) AS DOUBLE) END AS score FROM w),
r AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM v WHERE score > 0)
SELECT * FROM r WHERE rank <= 8""")
def rerank_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    seeder = retrieval.rerank_seeder(retrieval.lexical_seeder(retrieval.build(texts)), texts, analytics.overlap(F.col("query"), F.col("text")))
    return seeder(_questions(spark, sf_dir), 8)


# the embedding pass

EMBED = """w AS (SELECT s.*, CAST(regexp_extract(doc_id, '[0-9]+') AS BIGINT) AS d, trim(regexp_replace(regexp_replace(raw, '^\\s*(?:\\([0-9]{1,3}[A-Z]?\\)|\\([a-z]{1,3}\\)|[0-9]{1,4}[A-Z]{0,2}\\.)\\s*', ''), '\\s+', ' ', 'g')) AS n FROM s),
x AS (SELECT *, d % 5 = 4 AS pending, d % 7 = 3 AS fails, ok % 3 = 0 AS had FROM w)"""


def _embedded(spark: SparkSession, sf_dir: str):
    from lexweave.functions.text import normalized

    nodes = bundle.saved(statute.view(spark, sf_dir).withColumn("normalized", normalized(F.col("raw"))), "nodes")
    number = F.regexp_extract("doc_id", "[0-9]+", 0).cast("long")
    docs = nodes.select("doc_id").distinct().withColumn("review_state", F.when(number % 5 == 4, "pending").otherwise("accepted"))
    had = nodes.where("ok % 3 = 0").select("node_id", F.lit(embed.HASH_MODEL).alias("model_id"))

    def model(texts: list[str], doc: str) -> list[list[float]]:
        if int(re.sub(r"\D", "", doc)) % 7 == 3:
            raise RuntimeError("no memory")
        return embed.hash_embedder(texts, doc)

    made = embed.embed(embed.pending(nodes, docs, had, embed.HASH_MODEL), model, embed.HASH_MODEL, 32)
    return nodes, docs, bundle.saved(made, "vectors")


@query(statute.oracle(EMBED + """ SELECT node_id, CASE WHEN NOT fails THEN 8 END AS dim, CASE WHEN NOT fails THEN round(8 + list_sum(list_transform(range(8), lambda i: CAST('0x' || substr(sha256(CASE WHEN n = '' THEN raw ELSE n END), 2 * i + 1, 2) AS INTEGER) / 127.5 - 1)), 6) END AS total,
CASE WHEN fails THEN 'RuntimeError: no memory at 0' END AS failure FROM x WHERE NOT pending AND NOT had"""))
def embed_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = F.aggregate("vector", F.lit(0.0), lambda s, v: s + v) + 8
    return _embedded(spark, sf_dir)[2].select("node_id", "dim", F.round(total, 6).alias("total"), "failure")


@query(statute.oracle(EMBED + """, t AS (SELECT doc_id, bool_or(fails) AS fails, count(*) AS n FROM x WHERE NOT pending AND NOT had GROUP BY doc_id)
SELECT (SELECT count(*) FROM t WHERE NOT fails) AS documents_embedded, (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) FROM t WHERE NOT fails) AS nodes_embedded, (SELECT count(*) FROM t WHERE fails) AS documents_failed,
  (SELECT count(DISTINCT doc_id) FROM x WHERE pending) AS documents_pending, (SELECT count(*) FROM x WHERE NOT pending AND had) AS nodes_skipped"""))
def embed_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, docs, made = _embedded(spark, sf_dir)
    return embed.summary(made, nodes, docs)


@query("SELECT 'm' || CAST(label AS VARCHAR) AS model_id, count(*) AS vectors, CAST(max(vec_id) AS BIGINT) AS computed_at FROM embeddings GROUP BY label")
def vector_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = load(spark, sf_dir, "embeddings").select(F.concat(F.lit("m"), "label").alias("model_id"), F.col("vec_id").alias("computed_at"))
    return lookup.vector_models(own)


# the model pass, with a model that answers by rule


def rule_model(said: list[dict], labels: dict[str, str]) -> list[dict]:
    """Proposes what a proviso's wording says, and mistakes of every kind that validation is to catch."""
    units = re.findall(r"^\[(N\d+)\](?: \(heading\))? (.*)$", said[1]["content"], re.M)
    if int(re.search(r"lot (\d+)", units[0][1])[1]) % 13 == 0:
        raise RuntimeError("busy")
    out = []
    for (before, _), (label, text) in zip(units, units[1:]):
        p = {"src": label, "dst": before, "evidence": text, "confidence": 1.4, "type": "exception_of"}
        if text.startswith("Provided that"):
            out.append(p)
        elif "Notwithstanding" in text:
            out.append(p | {"dst": label, "type": "supersedes"})
        elif "Subject to" in text:
            out.append(p | {"type": "relates"})
        elif '" means' in text:
            out += [p | {"dst": "N99", "type": "defines"}, p | {"evidence": text.upper(), "type": "defines"}]
        else:
            out.append(p | {"type": "none"})
    return out


def _passed(spark: SparkSession, sf_dir: str):
    nodes = bundle.saved(statute_nodes(spark, sf_dir), "nodes")
    own = nodes.where("ln > 0").select("doc_id", F.col("node_id").alias("src"), "ok", "ln", F.col("section_id"), F.lag("node_id").over(edges.in_order()).alias("before"))
    row = lambda kind, to: F.struct(F.concat_ws(":", F.lit("p"), F.lit(kind), "src").alias("edge_id"), to.alias("dst"), F.lit(kind).alias("type"))
    before = nodes.select("doc_id", "node_id", F.lag("node_id").over(edges.in_order()).alias("before"))
    own = own.drop("before").join(before.select(F.col("node_id").alias("src"), "before"), "src")
    both = F.array(row("defines", F.col("section_id")), F.when((F.col("ln") % 4 == 0) & (F.col("ok") % 2 == 0), row("exception_of", F.col("before"))))
    pattern = own.select("doc_id", "src", F.explode(F.filter(both, lambda e: e.isNotNull())).alias("e")).select("e.edge_id", "src", "e.dst", "e.type", F.lit(0.6).alias("confidence"), F.lit("pattern").alias("provenance"), "doc_id")
    pattern = bundle.saved(pattern, "pattern")
    return nodes, pattern, extract.run(nodes, pattern, rule_model, "rules")


S_PASS = """gate AS (SELECT doc_id, section, string_agg(raw, chr(10) ORDER BY seq) AS text FROM s GROUP BY doc_id, section),
g AS MATERIALIZED (SELECT doc_id, section, """ + GATE.format("text") + """ AS admitted FROM gate),
m AS MATERIALIZED (SELECT s.*, g.admitted, g.admitted AND ok % 13 <> 0 AS examined, lag(node_id) OVER (PARTITION BY s.doc_id ORDER BY seq) AS before, s.doc_id || ':' || CAST(s.section * 10 AS VARCHAR) AS heading FROM s JOIN g ON g.doc_id = s.doc_id AND g.section = s.section)"""


@query(statute.oracle(S_PASS + """ SELECT reason, count(*) AS n FROM (
  SELECT CASE ln % 4 WHEN 1 THEN 'loop' WHEN 2 THEN 'type not allowed' ELSE CASE WHEN ok % 7 = 0 THEN 'endpoint not in window' ELSE 'no relation' END END AS reason FROM m WHERE examined AND ln > 0 AND ln % 4 <> 0
  UNION ALL SELECT 'evidence case_mismatch_only' FROM m WHERE examined AND ln % 4 = 3 AND ok % 7 = 0) GROUP BY reason"""))
def model_rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _passed(spark, sf_dir)[2]["proposals"].where("reason is not null").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query(statute.oracle(S_PASS + " SELECT 'model:exception_of:' || node_id || ':' || before AS edge_id, node_id AS src, before AS dst, 1.0 :: DOUBLE AS confidence, raw AS span FROM m WHERE examined AND ln > 0 AND ln % 4 = 0 AND ok % 2 = 1"))
def model_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _passed(spark, sf_dir)[2]["edges"].select("edge_id", "src", "dst", "confidence", "span")


@query(statute.oracle(S_PASS + """ SELECT 'p:defines:' || node_id AS edge_id, CASE WHEN examined THEN 0.3 ELSE 0.6 END :: DOUBLE AS confidence, 'pattern' AS provenance FROM m WHERE ln > 0
UNION ALL SELECT 'p:exception_of:' || node_id, CASE WHEN examined THEN 1.0 ELSE 0.6 END :: DOUBLE, CASE WHEN examined THEN 'verified' ELSE 'pattern' END FROM m WHERE ln > 0 AND ln % 4 = 0 AND ok % 2 = 0"""))
def model_reconciled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _passed(spark, sf_dir)[2]["reconciled"].select("edge_id", F.round("confidence", 6).alias("confidence"), "provenance")


@query(statute.oracle(S_PASS + """ SELECT (SELECT count(*) FROM g) AS sections, (SELECT count(*) FROM g WHERE admitted) AS admitted, (SELECT count(*) FROM g WHERE admitted AND section % 13 <> 0) AS calls, (SELECT count(*) FROM g WHERE admitted AND section % 13 = 0) AS failures,
  (SELECT count(*) + count(*) FILTER (WHERE ln % 4 = 3 AND ok % 7 = 0) FROM m WHERE examined AND ln > 0) AS candidates, (SELECT count(*) FILTER (WHERE ln % 4 IN (1, 2)) + 2 * count(*) FILTER (WHERE ln % 4 = 3 AND ok % 7 = 0) FROM m WHERE examined) AS rejected,
  (SELECT count(*) FROM m WHERE examined AND ln > 0 AND ln % 4 = 0 AND ok % 2 = 1) AS edges_written, (SELECT count(*) FROM m WHERE examined AND ln > 0 AND ln % 4 = 0 AND ok % 2 = 0) AS verified, (SELECT count(*) FROM m WHERE examined AND ln > 0) AS unconfirmed"""))
def model_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, pattern, made = _passed(spark, sf_dir)
    return extract.summary(made, pattern)


@query(statute.oracle("""r AS (SELECT doc_id, section, node_id, length(raw) AS n, row_number() OVER (PARTITION BY doc_id, section ORDER BY seq) AS i FROM s),
q AS (SELECT doc_id, section, node_id, i, n AS used, 0 AS part FROM r WHERE i = 1
  UNION ALL SELECT r.doc_id, r.section, r.node_id, r.i, CASE WHEN q.used > 0 AND q.used + r.n > 120 THEN r.n ELSE q.used + r.n END, q.part + CASE WHEN q.used > 0 AND q.used + r.n > 120 THEN 1 ELSE 0 END FROM q JOIN r ON r.doc_id = q.doc_id AND r.section = q.section AND r.i = q.i + 1)
SELECT node_id, part FROM q"""))
def window_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections.parts(statute.nodes(spark, sf_dir), 120).select("node_id", "part")


@query(statute.oracle("""w AS (SELECT doc_id, section, raw, seq, row_number() OVER (PARTITION BY doc_id, section ORDER BY seq) AS i FROM s)
SELECT doc_id, dense_rank() OVER (PARTITION BY doc_id ORDER BY section) AS window_no, prompt FROM (SELECT doc_id, section, string_agg('[N' || CAST(i AS VARCHAR) || '] ' || raw, chr(10) ORDER BY seq) AS prompt FROM w GROUP BY doc_id, section)"""))
def window_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections.prompts(statute.nodes(spark, sf_dir)).select("doc_id", F.col("window").alias("window_no"), "prompt")


# evaluation


@query(statute.oracle("w AS (SELECT doc_id, section, lower(string_agg(raw, chr(10) ORDER BY seq)) AS text FROM s GROUP BY doc_id, section), t AS (SELECT list_filter([" + ", ".join(f"'{t}'" for t in pack.GATE_TERMS) + "], lambda x: contains(text, x)) AS found FROM w) SELECT term, count(*) AS windows, count(*) FILTER (WHERE n = 1) AS alone FROM (SELECT unnest(found) AS term, len(found) AS n FROM t) GROUP BY term"))
def gate_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.gate_terms(sections.section_texts(statute.nodes(spark, sf_dir)))


@query(statute.oracle("w AS (SELECT doc_id, section, string_agg(raw, chr(10) ORDER BY seq) AS text FROM s GROUP BY doc_id, section), r AS (SELECT doc_id, avg(CASE WHEN " + GATE.format("text") + " THEN 1.0 :: DOUBLE ELSE 0 END) AS share FROM w GROUP BY doc_id) SELECT count(*) AS documents, round(min(share), 6) AS least, round(median(share), 6) AS middle, round(max(share), 6) AS most FROM r"))
def gate_by_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = evaluate.gate_by_document(sections.section_texts(statute.nodes(spark, sf_dir)))
    return made.select("documents", *[F.round(c, 6).alias(c) for c in ("least", "middle", "most")])


#: a case for each proviso: its span runs over the line before, in other case and spacing
S_CASES = """x AS MATERIALIZED (SELECT s.*, lag(raw) OVER (PARTITION BY doc_id ORDER BY seq) AS before FROM s),
cs AS MATERIALIZED (SELECT node_id AS case_id, doc_id, CASE WHEN ok % 2 = 0 THEN 'lost_exception' WHEN ok % 3 = 0 THEN 'lost_scope' ELSE 'lost_thing' END AS cause, upper(before) || '  ' || chr(10) || raw AS gold_span, ok, section FROM x WHERE ln > 0 AND ln % 4 = 0),
f AS MATERIALIZED (SELECT doc_id, node_id, lower(trim(regexp_replace(raw, '\\s+', ' ', 'g'))) AS r FROM s), kf AS (SELECT case_id, doc_id, lower(trim(regexp_replace(gold_span, '\\s+', ' ', 'g'))) AS g FROM cs),
gold AS MATERIALIZED (SELECT case_id, node_id FROM kf JOIN f ON f.doc_id = kf.doc_id AND length(r) >= 25 AND (contains(g, r) OR contains(r, g) OR length(left(r, 80)) >= 60 AND contains(g, left(r, 80)) OR length(right(r, 80)) >= 60 AND contains(g, right(r, 80))))"""


def _cases(nodes: DataFrame) -> DataFrame:
    own = nodes.withColumn("before", F.lag("raw").over(edges.in_order())).where("ln > 0 and ln % 4 = 0")
    cause = F.when(F.col("ok") % 2 == 0, "lost_exception").when(F.col("ok") % 3 == 0, "lost_scope").otherwise("lost_thing")
    return own.select(F.col("node_id").alias("case_id"), "doc_id", cause.alias("cause"), F.concat(F.upper("before"), F.lit("  \n"), "raw").alias("gold_span"), "section_id")


@query(statute.oracle(S_CASES + " SELECT case_id, node_id FROM gold"))
def gold_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = bundle.saved(statute_nodes(spark, sf_dir), "nodes")
    return evaluate.gold_nodes(_cases(nodes), nodes)


@query(statute.oracle(S_CASES + ", d AS (SELECT doc_id, string_agg(raw, chr(10) ORDER BY seq) AS text FROM s GROUP BY doc_id) SELECT case_id, error FROM (SELECT case_id, 'unknown cause lost_thing' AS error FROM cs WHERE cause = 'lost_thing' UNION ALL SELECT case_id, 'gold span not in the document' FROM cs JOIN d ON d.doc_id = cs.doc_id WHERE NOT contains(text, gold_span))"))
def case_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = bundle.saved(statute_nodes(spark, sf_dir), "nodes")
    parts = F.array_sort(F.collect_list(F.struct("seq", "raw")))
    texts = nodes.groupBy("doc_id").agg(F.array_join(F.transform(parts, lambda p: p["raw"]), "\n").alias("text"))
    return evaluate.case_errors(_cases(nodes), texts)


@query(statute.oracle(S_CASES + """,
seeds AS (SELECT DISTINCT cs.case_id AS query_id, coalesce(sib.parent_id, s.node_id) AS node_id FROM cs JOIN s ON s.node_id = cs.doc_id || ':' || CAST(cs.section * 10 AS VARCHAR) LEFT JOIN sib ON sib.node_id = cs.case_id AND cs.ok % 5 = 0),
""" + S_REACH.split(",\n", 1)[1] + """,
w AS (SELECT case_id, cause, EXISTS (SELECT 1 FROM gold WHERE gold.case_id = cs.case_id) AS has_gold, EXISTS (SELECT 1 FROM gold JOIN seeds ON seeds.query_id = gold.case_id AND seeds.node_id = gold.node_id WHERE gold.case_id = cs.case_id) AS a,
  EXISTS (SELECT 1 FROM gold JOIN reach ON reach.query_id = gold.case_id AND reach.node_id = gold.node_id WHERE gold.case_id = cs.case_id) AS c FROM cs)
SELECT cause, count(*) AS cases, count(*) FILTER (WHERE a) AS reached_a, count(*) FILTER (WHERE a) AS reached_b, count(*) FILTER (WHERE a OR c) AS reached_c FROM w GROUP BY cause"""))
def labelled_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeds are the case's section heading, or the proviso's parent for one section in five; no context is taken, so arm B is arm A."""
    nodes = bundle.saved(statute_nodes(spark, sf_dir), "nodes")
    made = bundle.saved(statute_edges(spark, sf_dir, nodes), "edges")
    own = bundle.saved(_cases(nodes), "cases")
    asked = own.join(nodes.select(F.col("node_id").alias("case_id"), "parent_id", "ok"), "case_id")
    seeds = asked.select(F.col("case_id").alias("query_id"), F.expr("if(ok % 5 = 0, parent_id, section_id)").alias("node_id"))
    reached, _ = graph.closure(seeds, graph.steps(made, "closure"), nodes)
    gold = bundle.saved(evaluate.gold_nodes(own, nodes), "gold")
    named = lambda df: df.select(F.col("query_id").alias("case_id"), "node_id")
    return evaluate.arms_by_cause(evaluate.arms(own.select("case_id", "cause"), gold, named(seeds), named(seeds), named(reached)))


@query(statute.oracle("""z AS (SELECT e.src AS gold_id, e.dst AS rule_id, CASE type WHEN 'exception_of' THEN 'lost_exception' WHEN 'supersedes' THEN 'wrong_version' ELSE 'lost_scope' END AS cause,
  CASE type WHEN 'exception_of' THEN 'struct:proviso:' WHEN 'supersedes' THEN 'marker:non_obstante:' ELSE 'marker:subject_to:' END || src || ':' || dst AS edge_id
  FROM e JOIN s a ON a.node_id = e.src JOIN s b ON b.node_id = e.dst WHERE type <> 'part_of' AND src <> dst AND 2 * length(a.raw) + 1 >= 80 AND 2 * length(b.raw) + 1 >= 40)
SELECT gold_id, arg_min(rule_id, edge_id) AS rule_id, arg_min(cause, edge_id) AS cause FROM z GROUP BY gold_id"""))
def mined_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = bundle.saved(statute_nodes(spark, sf_dir), "nodes")
    return evaluate.mined(statute_edges(spark, sf_dir, nodes), nodes.withColumn("raw", F.concat_ws(" ", "raw", "raw")))  # lines alone are too short to ask about


@query(statute.oracle(S_TERMS + """, used AS (SELECT DISTINCT t.node_id FROM u JOIN t ON t.doc_id = u.doc_id AND t.p = u.p WHERE t.node_id <> u.node_id),
many AS (SELECT p FROM t GROUP BY p HAVING count(DISTINCT section) > 1),
walk AS (SELECT from_id AS a, to_id AS b FROM steps), back AS (SELECT a, b FROM walk UNION SELECT back.a, walk.b FROM back JOIN walk ON walk.a = back.b)
SELECT 'unused term' AS finding, 'term:' || node_id AS subject_id FROM t WHERE node_id NOT IN (SELECT node_id FROM used)
UNION ALL SELECT 'shadowed term', 'term:' || node_id FROM t JOIN many ON many.p = t.p UNION ALL SELECT DISTINCT 'circular', a FROM back WHERE a = b"""))
def lint(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = bundle.saved(statute_nodes(spark, sf_dir), "nodes")
    terms = bundle.saved(lexicon.terms(nodes), "terms")
    linked = statute_edges(spark, sf_dir, nodes)
    used = lexicon.mentions(nodes, terms).select("src", "dst", "type", "edge_id", "confidence", "provenance", "source", "doc_id", F.lit("closure").alias("class"))
    found = evaluate.lint(nodes, terms, used).where("finding != 'circular'").unionByName(evaluate.circular(nodes, linked))
    return found.select("finding", "subject_id")


# the read path


@query(statute.oracle("""shown AS (SELECT node_id AS query_id, node_id FROM s UNION SELECT node_id, prev_id FROM sib WHERE prev_id IS NOT NULL),
bad AS (SELECT s.node_id AS query_id, list_sort(list(DISTINCT steps.to_id)) AS missing FROM s JOIN steps ON steps.from_id = s.node_id JOIN s t ON t.node_id = steps.to_id WHERE NOT EXISTS (SELECT 1 FROM shown WHERE shown.query_id = s.node_id AND shown.node_id = steps.to_id) GROUP BY s.node_id)
SELECT s.node_id AS query_id, 1 :: BIGINT AS n_cited, array_to_string(coalesce(missing, []), ',') AS missing, missing IS NULL AS sound FROM s LEFT JOIN bad ON bad.query_id = s.node_id"""))
def verify_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each node is cited by an answer that was shown it and its previous sibling."""
    nodes = bundle.saved(statute_nodes(spark, sf_dir), "nodes")
    walk = graph.steps(statute_edges(spark, sf_dir, nodes), "closure")
    cited = nodes.select(F.col("node_id").alias("query_id"), "node_id")
    shown = cited.unionByName(nodes.where("prev_id is not null").select(F.col("node_id").alias("query_id"), F.col("prev_id").alias("node_id")))
    return graph.verdicts(cited, walk, shown, nodes).withColumn("missing", F.array_join("missing", ","))


@query(statute.oracle("g AS (SELECT 'stock ' || CAST(p AS VARCHAR) AS surface, arg_max(raw, 'term:' || node_id) AS gloss FROM s WHERE ln % 4 = 3 AND ok % 7 = 0 GROUP BY p),\n" + S_REACH + """,
r AS (SELECT query_id, s.doc_id, s.seq, s.raw, g.surface, g.gloss, row_number() OVER (PARTITION BY query_id, g.surface ORDER BY s.doc_id, s.seq) AS i FROM reach JOIN s ON s.node_id = reach.node_id LEFT JOIN g ON s.ln % 4 = 3 AND g.surface = 'stock ' || CAST(s.p AS VARCHAR))
SELECT query_id, string_agg(CASE WHEN surface IS NOT NULL AND i = 1 THEN replace(raw, surface, surface || ' [= ' || gloss || ']') ELSE raw END, chr(10) || chr(10) ORDER BY doc_id, seq) AS context FROM r GROUP BY query_id"""))
def gloss_splice(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, _, reached, _ = _closed(spark, sf_dir)
    shown = reached.select("query_id", "node_id").join(nodes.select("node_id", "doc_id", "seq", F.col("raw").alias("text")), "node_id").select("query_id", "doc_id", "seq", "text")
    return graph.joined(lexicon.spliced(shown, lexicon.glossary(lexicon.terms(nodes)))).select("query_id", "context")


@query(statute.oracle("""v AS (SELECT node_id, section % 2 = 1 AS odd FROM s),
hop AS (SELECT node_id AS query_id, node_id FROM s UNION SELECT hop.query_id, steps.to_id FROM hop JOIN v q ON q.node_id = hop.query_id JOIN steps ON steps.from_id = hop.node_id JOIN v t ON t.node_id = steps.to_id WHERE q.odd = t.odd)
SELECT query_id, node_id FROM hop"""))
def visible_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of even and of odd number are two documents here, and a query sees its own only."""
    nodes = bundle.saved(statute_nodes(spark, sf_dir), "nodes")
    walk = graph.steps(statute_edges(spark, sf_dir, nodes), "closure")
    own = nodes.withColumn("doc_id", F.concat("doc_id", F.lit("/"), F.col("section") % 2))
    seen = own.select(F.col("node_id").alias("query_id"), "doc_id")
    reached, _ = graph.closure(own.select(F.col("node_id").alias("query_id"), "node_id"), walk, own, visible=seen)
    return reached.select("query_id", "node_id")


@query(statute.oracle("""el AS MATERIALIZED (SELECT a.node_id AS src, b.node_id AS dst FROM s a JOIN s b ON b.doc_id = a.doc_id AND b.section = a.section AND b.seq = (SELECT min(c.seq) FROM s c WHERE c.doc_id = a.doc_id AND c.section = a.section AND c.seq > a.seq)),
h1 AS (SELECT src AS query_id, dst AS node_id FROM el), h2 AS (SELECT h1.query_id, el.dst AS node_id FROM h1 JOIN el ON el.src = h1.node_id)
SELECT query_id, node_id, 1 AS hops FROM h1 UNION ALL SELECT query_id, node_id, 2 FROM h2"""))
def context_two_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line elaborates the next one of its section; the policy follows that for two hops."""
    nodes = bundle.saved(statute_nodes(spark, sf_dir), "nodes")
    after = F.lead("node_id").over(edges.W.partitionBy("doc_id", "section").orderBy("seq"))
    el = nodes.select("node_id", after.alias("dst"), "doc_id").where("dst is not null").select(F.concat(F.lit("el:"), "node_id").alias("edge_id"), F.col("node_id").alias("src"), "dst", F.lit("elaborates").alias("type"), F.lit(1.0).alias("confidence"), F.lit("context").alias("class"))
    own = nodes.select(F.col("node_id").alias("query_id"), "node_id")
    relevance = nodes.select(F.lit(None).cast("string").alias("query_id"), "node_id", F.lit(1.0).alias("relevance")).limit(0)
    budget = graph.BUDGET | {"max_tokens": 1 << 30, "saturation_window": 1000}
    return graph.context(own, graph.steps(el, "context"), nodes.withColumn("text", F.col("raw")), el, relevance, budget).select("query_id", "node_id", "hops")


KEYS = "list_filter(regexp_extract_all(lower({0}), '[a-z][a-z0-9\\-]{{2,}}'), lambda w: NOT list_contains([" + ", ".join(f"'{w}'" for w in KEY_STOPWORDS) + "], w))"
SATURATED = """,
base AS (SELECT query_id, sum(greatest(1, length(s.raw) // 4)) AS base FROM reach JOIN s ON s.node_id = reach.node_id GROUP BY query_id),
ranked AS MATERIALIZED (SELECT cand.query_id, cand.node_id, row_number() OVER w AS rank, CAST(base + sum(cost) OVER w AS BIGINT) AS total FROM cand JOIN base ON base.query_id = cand.query_id WINDOW w AS (PARTITION BY cand.query_id ORDER BY score DESC, cand.node_id)),
held AS (SELECT DISTINCT query_id, unnest(""" + KEYS.format("s.raw") + """) AS key FROM reach JOIN s ON s.node_id = reach.node_id),
had AS (SELECT query_id, key, min(rank) AS rank FROM (SELECT query_id, rank, unnest(""" + KEYS.format("s.raw") + """) AS key FROM ranked JOIN s ON s.node_id = ranked.node_id) GROUP BY query_id, key),
fresh AS (SELECT had.query_id, had.rank, count(*) AS n FROM had LEFT JOIN held ON held.query_id = had.query_id AND held.key = had.key WHERE held.key IS NULL GROUP BY had.query_id, had.rank),
told AS (SELECT ranked.*, coalesce(fresh.n, 0) AS new_keys, sum(coalesce(fresh.n, 0)) OVER (PARTITION BY ranked.query_id ORDER BY ranked.rank ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS lately FROM ranked LEFT JOIN fresh ON fresh.query_id = ranked.query_id AND fresh.rank = ranked.rank),
dry AS (SELECT query_id, min(rank) AS dry FROM told WHERE rank >= 2 AND lately = 0 GROUP BY query_id)
SELECT told.query_id, node_id, rank, CAST(new_keys AS BIGINT) AS new_keys, CASE WHEN dry IS NULL THEN 'exhausted' ELSE 'saturation' END AS stopped_because FROM told LEFT JOIN dry ON dry.query_id = told.query_id WHERE rank <= coalesce(dry, rank)"""


@query(statute.oracle(S_CONTEXT + SATURATED))
def context_saturation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexweave.plans.catalog import _around

    return _around(spark, sf_dir, graph.BUDGET | {"saturation_window": 2, "max_tokens": 1 << 30}, told=True).select("query_id", "node_id", "rank", "new_keys", "stopped_because")


def asked(nodes: DataFrame) -> DataFrame:
    """A question for each section: its lot's number and the one before."""
    return nodes.where("ln = 0").select(F.col("node_id").alias("query_id"), F.concat("ok", F.lit(" "), F.col("ok") - 1).alias("text"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions over the statute: seeds by words, closure, context, glosses, conflicts, assembled text and verdict."""
    nodes = bundle.saved(statute_nodes(spark, sf_dir), "nodes")
    made = bundle.saved(statute_edges(spark, sf_dir, nodes), "edges")
    clashes = conflict.mutual(conflict.claims(nodes.withColumn("section", F.col("section") % 1000 + 1)))
    glosses = lexicon.glossary(lexicon.terms(nodes))
    return ask.run(nodes.withColumn("text", F.col("raw")), made, asked(nodes), 4, graph.BUDGET | {"max_tokens": 400}, glosses=glosses, conflicts=bundle.saved(clashes, "conflicts"))


def _ask_sql() -> str:
    return statute.oracle(f"""tf AS MATERIALIZED (SELECT id, term, count(*) AS tf FROM (SELECT node_id AS id, unnest({ORACLE_TOKENS.format("raw")}) AS term FROM s) GROUP BY id, term),
idf AS MATERIALIZED (SELECT term, ln(1 + (SELECT greatest(count(DISTINCT id), 1) FROM tf) / CAST(1 + count(*) AS DOUBLE)) AS idf FROM tf GROUP BY term),
norm AS MATERIALIZED (SELECT id, sqrt(sum(pow(tf * idf, 2))) AS norm FROM tf JOIN idf USING (term) GROUP BY id),
q AS (SELECT node_id AS query_id, unnest(list_distinct({ORACLE_TOKENS.format("CAST(ok AS VARCHAR) || ' ' || CAST(ok - 1 AS VARCHAR)")})) AS term FROM s WHERE ln = 0),
scored AS MATERIALIZED (SELECT query_id, id, round(sum(tf * idf * idf) / any_value(norm), 9) AS score FROM q JOIN idf USING (term) JOIN tf USING (term) JOIN norm USING (id) GROUP BY query_id, id),
rel AS MATERIALIZED (SELECT query_id, id, least(1.0, score / max(score) OVER (PARTITION BY query_id)) AS relevance FROM scored),
seeds AS MATERIALIZED (SELECT query_id, id AS node_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM scored WHERE score > 0) WHERE rank <= 4),
""" + S_REACH.split(",\n", 1)[1].replace("reach AS (", "reach AS MATERIALIZED (") + """,
deg AS MATERIALIZED (SELECT node_id, count(*) AS degree FROM (SELECT src AS node_id FROM e UNION ALL SELECT dst FROM e) GROUP BY node_id),
near AS (SELECT DISTINCT reach.query_id, e.dst AS node_id FROM reach JOIN e ON e.src = reach.node_id AND e.type = 'part_of' WHERE NOT EXISTS (SELECT 1 FROM reach r WHERE r.query_id = reach.query_id AND r.node_id = e.dst)),
cand AS MATERIALIZED (SELECT near.query_id, near.node_id, round(0.4 * coalesce(rel.relevance, 0.0) * 0.7 / ln(2 + degree), 12) AS score, greatest(1, length(s.raw) // 4) AS cost FROM near JOIN s ON s.node_id = near.node_id JOIN deg ON deg.node_id = near.node_id LEFT JOIN rel ON rel.query_id = near.query_id AND rel.id = near.node_id)""" + SATURATED.split("SELECT told.query_id")[0].replace("ROWS BETWEEN 1 PRECEDING", "ROWS BETWEEN 4 PRECEDING").replace("WHERE rank >= 2 AND lately", "WHERE rank >= 5 AND lately").replace("FROM told WHERE", "FROM told WHERE total <= 400 AND").rstrip() + """,
cut AS (SELECT query_id, min(rank) AS over FROM ranked WHERE total > 400 GROUP BY query_id),
around AS (SELECT told.query_id, told.node_id FROM told LEFT JOIN dry ON dry.query_id = told.query_id LEFT JOIN cut ON cut.query_id = told.query_id WHERE rank <= coalesce(dry, rank) AND rank < coalesce(over, rank + 1)),
shown AS MATERIALIZED (SELECT query_id, node_id, CASE WHEN hops = 0 THEN 'seed' ELSE 'closure' END AS origin FROM reach UNION ALL SELECT query_id, node_id, 'context' FROM around),
g AS (SELECT 'stock ' || CAST(p AS VARCHAR) AS surface, arg_max(raw, 'term:' || node_id) AS gloss FROM s WHERE ln % 4 = 3 AND ok % 7 = 0 GROUP BY p),
r AS (SELECT query_id, s.doc_id, s.seq, s.raw, g.surface, g.gloss, row_number() OVER (PARTITION BY query_id, g.surface ORDER BY s.doc_id, s.seq) AS i FROM shown JOIN s ON s.node_id = shown.node_id LEFT JOIN g ON s.ln % 4 = 3 AND g.surface = 'stock ' || CAST(s.p AS VARCHAR)),
texts AS (SELECT query_id, string_agg(CASE WHEN surface IS NOT NULL AND i = 1 THEN replace(raw, surface, surface || ' [= ' || gloss || ']') ELSE raw END, chr(10) || chr(10) ORDER BY doc_id, seq) AS context, count(*) AS n_nodes FROM r GROUP BY query_id),
counts AS (SELECT query_id, count(*) FILTER (WHERE origin = 'seed') AS n_seeds, count(*) FILTER (WHERE origin = 'closure') AS n_closure, count(*) FILTER (WHERE origin = 'context') AS n_context FROM shown GROUP BY query_id),
claim AS MATERIALIZED (SELECT doc_id, node_id, section % 1000 + 1 AS section, ok % 11 = 0 AS wide, CASE WHEN ok % 11 <> 0 THEN k % 1000 + 1 END AS target FROM s WHERE ln % 4 = 1),
clash AS (SELECT a.node_id AS x, b.node_id AS y FROM claim a JOIN claim b ON a.doc_id = b.doc_id AND a.target = b.section AND a.section = b.target WHERE a.node_id < b.node_id
  UNION SELECT least(a.node_id, b.node_id), greatest(a.node_id, b.node_id) FROM claim a JOIN claim b ON a.doc_id = b.doc_id AND a.target = b.section WHERE b.wide AND NOT a.wide AND a.section <> b.section),
ends AS (SELECT x, y, x AS node_id FROM clash UNION SELECT x, y, y FROM clash),
clashes AS (SELECT query_id, count(DISTINCT x || y) AS n_conflicts FROM shown JOIN ends ON ends.node_id = shown.node_id GROUP BY query_id),
bad AS (SELECT seeds.query_id, count(DISTINCT (seeds.node_id, steps.to_id, steps.type)) AS violations FROM seeds JOIN steps ON steps.from_id = seeds.node_id JOIN s ON s.node_id = steps.to_id WHERE NOT EXISTS (SELECT 1 FROM shown WHERE shown.query_id = seeds.query_id AND shown.node_id = steps.to_id) GROUP BY seeds.query_id)
SELECT s.node_id AS query_id, context, coalesce(n_nodes, 0) AS n_nodes, coalesce(n_seeds, 0) AS n_seeds, coalesce(n_closure, 0) AS n_closure, coalesce(n_context, 0) AS n_context, 0 :: BIGINT AS n_skipped, coalesce(violations, 0) AS violations, coalesce(n_conflicts, 0) AS n_conflicts, violations IS NULL AS sound
FROM s LEFT JOIN texts ON texts.query_id = s.node_id LEFT JOIN counts ON counts.query_id = s.node_id LEFT JOIN clashes ON clashes.query_id = s.node_id LEFT JOIN bad ON bad.query_id = s.node_id WHERE s.ln = 0""")


@query(_ask_sql())
def ask_statute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flagship(spark, sf_dir)
