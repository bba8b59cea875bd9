"""The queries over the test tables, each with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lexweave import ship
from lexweave.functions import pack
from lexweave.functions.text import STOPWORDS, normalized, rendered, token_estimate, tokens
from lexweave.operators import analytics, conflict, edges, graph, lexicon, parse, retrieval, sections
from lexweave.sources import bundle, statute

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def statute_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Not kept yet: its windows over documents go on in the shuffle that made the view."""
    ship(spark)
    return edges.linked(statute.view(spark, sf_dir))


def statute_edges(spark: SparkSession, sf_dir: str, nodes: DataFrame | None = None) -> DataFrame:
    return edges.all_edges(bundle.saved(statute_nodes(spark, sf_dir), "nodes") if nodes is None else nodes)


def seeds(nodes: DataFrame) -> DataFrame:
    """Each node, a section or what stands in one, asks a query of its own."""
    return nodes.select(F.col("node_id").alias("query_id"), "node_id")


S_SEEDS = "seeds AS (SELECT node_id AS query_id, node_id FROM s)"
S_REACH = S_SEEDS + """,
hop AS (SELECT query_id, node_id, 0 AS hops FROM seeds UNION SELECT hop.query_id, steps.to_id, hop.hops + 1 FROM hop JOIN steps ON steps.from_id = hop.node_id WHERE hop.hops < 40),
reach AS (SELECT query_id, node_id, min(hops) AS hops FROM hop GROUP BY query_id, node_id)"""
ORACLE_TOKENS = "list_filter(regexp_extract_all(lower({0}), '[a-z0-9][a-z0-9\\-'']*'), lambda w: length(w) > 1 AND NOT list_contains([" + ", ".join(f"'{w}'" for w in STOPWORDS) + "], w))"
D_INDEX = f"""tf AS (SELECT doc_id AS id, term, count(*) AS tf FROM (SELECT doc_id, unnest({ORACLE_TOKENS.format("text")}) AS term FROM documents) GROUP BY 1, 2),
idf AS (SELECT term, count(*) AS df, ln(1 + (SELECT greatest(count(DISTINCT id), 1) FROM tf) / CAST(1 + count(*) AS DOUBLE)) AS idf FROM tf GROUP BY term),
norm AS (SELECT id, sqrt(sum(pow(tf * idf, 2))) AS norm FROM tf JOIN idf USING (term) GROUP BY id),
q AS (SELECT item_id AS query_id, unnest(list_distinct({ORACLE_TOKENS.format("text")})) AS term FROM benchmark),
scored AS (SELECT query_id, id, round(sum(tf * idf * idf) / any_value(norm), 9) AS score FROM q JOIN idf USING (term) JOIN tf USING (term) JOIN norm USING (id) GROUP BY query_id, id)"""
D_VECTOR = """qv AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id % 20 = 0),
vscored AS (SELECT query_id, vec_id AS id, round(list_cosine_similarity(v, CAST(embedding AS DOUBLE[])), 9) AS score FROM qv, embeddings)"""


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _indexed(spark: SparkSession, sf_dir: str) -> retrieval.Index:
    return retrieval.build(load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.scores(_indexed(spark, sf_dir), _questions(spark, sf_dir))


def _best(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    return retrieval.best(_indexed(spark, sf_dir), _questions(spark, sf_dir), k)


@query(f"""WITH t AS (SELECT doc_id, unnest({ORACLE_TOKENS.format("text")}) AS term FROM documents)
SELECT term, count(*) AS cf, count(DISTINCT doc_id) AS df FROM t GROUP BY term""")
def tokenize_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = load(spark, sf_dir, "documents").select("doc_id", F.explode(tokens(F.col("text"))).alias("term"))
    return own.groupBy("term", "doc_id").agg(F.count(F.lit(1)).alias("n")).groupBy("term").agg(F.sum("n").alias("cf"), F.count(F.lit(1)).alias("df"))


@query(f"WITH {D_INDEX} SELECT query_id, id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM scored WHERE score > 0) WHERE rank <= 8")
def tfidf_search_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _best(spark, sf_dir, 8).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query(f"WITH {D_INDEX} SELECT query_id, id, round(least(1.0, score / max(score) OVER (PARTITION BY query_id)), 6) AS relevance FROM scored WHERE score > 0")
def tfidf_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.relevance(_scored(spark, sf_dir).where("score > 0")).withColumn("relevance", F.round("relevance", 6))


def _nearest(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    own = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return retrieval.vector_top(own, own.where("id % 20 = 0").select(F.col("id").alias("query_id"), "vector"), k)


@query(f"WITH {D_VECTOR} SELECT query_id, id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM vscored WHERE score > 0) WHERE rank <= 10")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nearest(spark, sf_dir, 10).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query(f"""WITH {D_INDEX}, {D_VECTOR},
r AS (SELECT query_id, id, 'dense' AS source, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM vscored WHERE score > 0
  UNION ALL SELECT query_id, id, 'sparse', row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) FROM scored WHERE score > 0)
SELECT query_id, id, round(sum(1.0 / (60 + rank)), 6) AS score, string_agg(source, ',' ORDER BY source) AS sources FROM r WHERE rank <= 24 GROUP BY query_id, id""")
def rrf_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    dense, sparse = (df.select("query_id", "id", "rank", F.lit(name).alias("source")) for df, name in ((_nearest(spark, sf_dir, 24), "dense"), (_best(spark, sf_dir, 24), "sparse")))
    return retrieval.fused(dense, sparse).withColumn("score", F.round("score", 6))


@query(statute.oracle("SELECT node_id, parent_id, prev_id, next_id FROM sib"))
def prev_next_sibling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statute_nodes(spark, sf_dir).where("kind = 'proposition'").select("node_id", "parent_id", "prev_id", "next_id")


# a proviso belongs to the section here, as only sub-sections and deeper units open levels 2 and 3
@query("""WITH RECURSIVE """ + statute.oracle("").split("WITH RECURSIVE ")[1].split(",\nsib0 AS")[0] + """,
x AS (SELECT *, CASE WHEN ln = 0 THEN 1 WHEN ln % 4 = 0 THEN 3 ELSE 2 END AS lv FROM s)
SELECT node_id, lv AS level, CASE WHEN lv = 1 THEN NULL WHEN lv = 2 THEN doc_id || ':' || CAST(section * 10 AS VARCHAR)
  ELSE last_value(CASE WHEN lv < 3 THEN node_id END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS parent_id FROM x""")
def nesting_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = statute.nodes(spark, sf_dir).withColumn("level", F.expr("CASE WHEN ln = 0 THEN 1 WHEN ln % 4 = 0 THEN 3 ELSE 2 END"))
    return edges.nested(own).select("node_id", "level", "parent_id")


@query(statute.oracle("SELECT node_id AS src, coalesce(prev_id, parent_id) AS dst, CASE WHEN ln % 4 = 0 THEN 'exception_of' ELSE 'part_of' END AS type FROM sib"))
def structural_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges.unit_edges(statute_nodes(spark, sf_dir)).select("src", "dst", "type")


@query(statute.oracle("""SELECT marker, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (
  SELECT doc_id, CASE WHEN ln % 4 = 0 THEN 'nothing_shall_apply' WHEN ln % 4 = 1 THEN 'non_obstante' ELSE 'subject_to' END AS marker FROM sib WHERE ln % 4 <> 3) GROUP BY marker"""))
def marker_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = edges.marker_hits(statute.nodes(spark, sf_dir))
    return hits.groupBy("marker", "doc_id").agg(F.count(F.lit(1)).alias("n")).groupBy("marker").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("docs"))


@query(statute.oracle("SELECT src, dst, type FROM e0 WHERE origin = 'marker' AND type <> 'exception_of'"))
def marker_referenced_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges.marker_edges(bundle.saved(statute_nodes(spark, sf_dir), "nodes")).where("type != 'exception_of'").select("src", "dst", "type")


@query(statute.oracle("SELECT src, dst, type, CASE WHEN type = 'part_of' THEN 'context' ELSE 'closure' END AS class FROM e"))
def edge_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statute_edges(spark, sf_dir).select("src", "dst", "type", "class")


@query(statute.oracle("SELECT node_id, count(*) AS degree FROM (SELECT src AS node_id FROM e UNION ALL SELECT dst FROM e) GROUP BY node_id"))
def degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degrees(statute_edges(spark, sf_dir))


def _closed(spark: SparkSession, sf_dir: str):
    nodes = bundle.saved(statute_nodes(spark, sf_dir), "nodes")
    made = bundle.saved(statute_edges(spark, sf_dir, nodes), "edges")
    reached, skipped = graph.closure(seeds(nodes), graph.steps(made, "closure"), nodes)
    return nodes, made, reached, skipped


@query(statute.oracle(S_REACH + " SELECT query_id, node_id FROM reach").replace("{rest}", ""))
def closure_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _closed(spark, sf_dir)[2].select("query_id", "node_id")


@query(statute.oracle(S_REACH + " SELECT query_id, node_id, hops FROM reach"))
def closure_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _closed(spark, sf_dir)[2].select("query_id", "node_id", "hops")


@query(statute.oracle(S_REACH + " SELECT query_id, node_id, CASE WHEN hops = 0 THEN 'seed' ELSE 'closure' END AS origin FROM reach"))
def provenance_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _closed(spark, sf_dir)[2].select("query_id", "node_id", F.when(F.col("hops") == 0, "seed").otherwise("closure").alias("origin"))


@query(statute.oracle(S_SEEDS + """ SELECT DISTINCT query_id, seeds.node_id, steps.to_id AS missing_id, type FROM seeds JOIN steps ON steps.from_id = seeds.node_id JOIN s ON s.node_id = steps.to_id
WHERE NOT EXISTS (SELECT 1 FROM seeds x WHERE x.query_id = seeds.query_id AND x.node_id = steps.to_id)"""))
def soundness_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = bundle.saved(statute_nodes(spark, sf_dir), "nodes")
    walk = graph.steps(statute_edges(spark, sf_dir, nodes), "closure")
    own = seeds(nodes)
    return graph.violations(own, walk, own, nodes)


@query(statute.oracle(S_REACH + """,
v AS (SELECT DISTINCT query_id FROM seeds JOIN steps ON steps.from_id = seeds.node_id JOIN s ON s.node_id = steps.to_id WHERE steps.to_id <> seeds.node_id),
f AS (SELECT DISTINCT seeds.query_id FROM seeds JOIN steps ON steps.from_id = seeds.node_id LEFT JOIN reach ON reach.query_id = seeds.query_id AND reach.node_id = steps.to_id WHERE reach.node_id IS NULL)
SELECT (SELECT count(*) FROM seeds) AS queries, (SELECT count(*) FROM v) AS flat_unsound, (SELECT count(*) FROM f) AS full_unsound"""))
def flat_vs_full_unsound_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, made, reached, _ = _closed(spark, sf_dir)
    own, walk = seeds(nodes), graph.steps(made, "closure")
    flat, full = (graph.violations(own, walk, shown, nodes).select("query_id").distinct().withColumn(name, F.lit(1)) for shown, name in ((own, "flat"), (reached, "full")))
    every = own.select("query_id").distinct().join(flat, "query_id", "left").join(full, "query_id", "left")
    return every.agg(F.count(F.lit(1)).alias("queries"), F.count("flat").alias("flat_unsound"), F.count("full").alias("full_unsound"))


S_CONTEXT = S_REACH + """,
deg AS (SELECT node_id, count(*) AS degree FROM (SELECT src AS node_id FROM e UNION ALL SELECT dst FROM e) GROUP BY node_id),
cand AS (SELECT reach.query_id, e.dst AS node_id, max(round(0.4 * 0.7 * (1.0 - (s.seq % 5) * 0.1) / ln(2 + deg.degree), 12)) AS score, any_value(greatest(1, length(s.raw) // 4)) AS cost
  FROM reach JOIN e ON e.src = reach.node_id AND e.type = 'part_of' JOIN s ON s.node_id = e.dst LEFT JOIN deg ON deg.node_id = e.dst
  WHERE NOT EXISTS (SELECT 1 FROM reach r WHERE r.query_id = reach.query_id AND r.node_id = e.dst) GROUP BY reach.query_id, e.dst)"""


def _around(spark: SparkSession, sf_dir: str, budget: dict, told: bool = False) -> DataFrame:
    nodes, made, reached, _ = _closed(spark, sf_dir)
    texts = nodes.withColumn("text", F.col("raw"))
    # relevance from the node's number, for want of a question
    near = reached.select("query_id", F.col("node_id").alias("src")).join(made.where("type = 'part_of'"), "src").select("query_id", F.col("dst").alias("node_id")).distinct()
    relevance = near.join(nodes.select("node_id", "seq"), "node_id").select("query_id", "node_id", (1.0 - (F.col("seq") % 5) * 0.1).alias("relevance"))
    return graph.context(reached.select("query_id", "node_id"), graph.steps(made, "context"), texts, made, relevance, budget, told=told)


@query(statute.oracle(S_CONTEXT + " SELECT query_id, node_id, round(score, 6) AS score FROM cand"))
def frontier_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _around(spark, sf_dir, graph.BUDGET | {"saturation_window": 1000, "max_tokens": 1 << 30}).select("query_id", "node_id", F.round("score", 6).alias("score"))


@query(statute.oracle(S_CONTEXT + """,
base AS (SELECT query_id, sum(greatest(1, length(s.raw) // 4)) AS base FROM reach JOIN s ON s.node_id = reach.node_id GROUP BY query_id),
ranked AS (SELECT cand.query_id, cand.node_id, row_number() OVER w AS rank, CAST(base + sum(cost) OVER w AS BIGINT) AS total FROM cand JOIN base ON base.query_id = cand.query_id WINDOW w AS (PARTITION BY cand.query_id ORDER BY score DESC, cand.node_id)),
cut AS (SELECT query_id, min(rank) AS over FROM ranked WHERE total > 150 GROUP BY query_id)
SELECT ranked.query_id, node_id, rank, total, CASE WHEN over IS NULL THEN 'exhausted' ELSE 'budget' END AS stopped_because FROM ranked LEFT JOIN cut ON cut.query_id = ranked.query_id WHERE rank < coalesce(over, rank + 1)"""))
def context_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _around(spark, sf_dir, graph.BUDGET | {"saturation_window": 1000, "max_tokens": 150}).select("query_id", "node_id", "rank", "total", "stopped_because")


@query(statute.oracle(S_REACH + " SELECT query_id, string_agg(s.raw, chr(10) || chr(10) ORDER BY doc_id, seq) AS context, count(*) AS n_nodes FROM reach JOIN s ON s.node_id = reach.node_id GROUP BY query_id"))
def assemble_doc_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, _, reached, _ = _closed(spark, sf_dir)
    return graph.assembled(reached, nodes.withColumn("text", F.col("raw")))


@query(statute.oracle("""SELECT 'term:' || node_id AS term_id, node_id AS definition_id, doc_id || ':' || CAST(section * 10 AS VARCHAR) AS scope_id, 'stock ' || CAST(p AS VARCHAR) AS surface, 'means' AS definition_kind
FROM s WHERE ln % 4 = 3 AND ok % 7 = 0"""))
def definition_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon.terms(statute.nodes(spark, sf_dir)).select("term_id", "definition_id", "scope_id", "surface", "definition_kind")


S_MENTIONS = "t AS MATERIALIZED (SELECT doc_id, node_id, p FROM s WHERE ln % 4 = 3 AND ok % 7 = 0), u AS MATERIALIZED (SELECT doc_id, node_id, p FROM s WHERE ln % 4 = 3)"


@query(statute.oracle(S_MENTIONS + " SELECT u.node_id AS src, t.node_id AS dst, 0.8 :: DOUBLE AS confidence FROM u JOIN t ON t.doc_id = u.doc_id AND t.p = u.p WHERE t.node_id <> u.node_id"))
def mention_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = statute.nodes(spark, sf_dir)
    return lexicon.mentions(nodes, lexicon.terms(nodes)).select("src", "dst", "confidence")


@query(statute.oracle(S_MENTIONS + ", g AS (SELECT 'stock ' || CAST(p AS VARCHAR) AS surface, s.raw, 'term:' || s.node_id AS id FROM s WHERE ln % 4 = 3 AND ok % 7 = 0) SELECT surface, arg_max(raw, id) AS gloss FROM g GROUP BY surface"))
def glossary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon.glossary(lexicon.terms(statute.nodes(spark, sf_dir)))


def _numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statute.nodes(spark, sf_dir).withColumn("section", F.col("section") % 1000 + 1)


S_CLAIMS = "c AS MATERIALIZED (SELECT doc_id, node_id, CAST(section % 1000 + 1 AS VARCHAR) AS section, CASE WHEN ok % 11 = 0 THEN 'document' ELSE 'section' END AS scope, CASE WHEN ok % 11 <> 0 THEN CAST(k % 1000 + 1 AS VARCHAR) END AS target FROM s WHERE ln % 4 = 1)"


# claims that name sections meet crosswise; a claim over the whole document meets those that name its section
@query(statute.oracle(S_CLAIMS + """,
named AS MATERIALIZED (SELECT * FROM c WHERE scope = 'section'), w AS MATERIALIZED (SELECT * FROM c WHERE scope = 'document'),
p AS (SELECT n.doc_id, n.node_id AS x, m.node_id AS y FROM named n JOIN named m ON n.doc_id = m.doc_id AND n.target = m.section AND n.section = m.target WHERE n.node_id < m.node_id
  UNION SELECT n.doc_id, least(n.node_id, w.node_id), greatest(n.node_id, w.node_id) FROM named n JOIN w ON n.doc_id = w.doc_id AND n.target = w.section WHERE n.section <> w.section)
SELECT doc_id, x AS a_id, y AS b_id, 1.0 :: DOUBLE AS confidence FROM p"""))
def override_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conflict.mutual(conflict.claims(_numbered(spark, sf_dir))).select("doc_id", "a_id", "b_id", "confidence")


@query(statute.oracle(S_CLAIMS + " SELECT doc_id, count(*) AS n_claims, count(DISTINCT section) AS n_sections, 0.5 :: DOUBLE AS confidence FROM c WHERE scope = 'document' GROUP BY doc_id HAVING count(*) >= 2 AND count(DISTINCT section) >= 2"))
def doc_scope_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conflict.clusters(conflict.claims(_numbered(spark, sf_dir)))


S_WINDOWS = "w AS (SELECT doc_id, section, count(*) AS n_nodes, string_agg(raw, chr(10) ORDER BY seq) AS text FROM s GROUP BY doc_id, section), g AS (SELECT doc_id, n_nodes, text, length(text) AS chars, " + " OR ".join(f"contains(lower(text), '{t}')" for t in pack.GATE_TERMS) + " AS admitted FROM w)"


@query(statute.oracle(S_WINDOWS + " SELECT doc_id, dense_rank() OVER (PARTITION BY doc_id ORDER BY section) AS window_no, n_nodes, length(text) AS chars FROM w"))
def section_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections.section_texts(statute.nodes(spark, sf_dir)).select("doc_id", F.col("window").alias("window_no"), F.col("n_nodes").cast("long").alias("n_nodes"), F.col("chars").cast("long").alias("chars"))


@query(statute.oracle(S_WINDOWS + """ SELECT count(*) AS sections, CAST(sum(chars) AS BIGINT) AS chars, count(*) FILTER (WHERE admitted) AS admitted, CAST(coalesce(sum(chars) FILTER (WHERE admitted), 0) AS BIGINT) AS admitted_chars,
round(count(*) FILTER (WHERE admitted) / CAST(count(*) AS DOUBLE), 6) AS section_share, round(coalesce(sum(chars) FILTER (WHERE admitted), 0) / CAST(sum(chars) AS DOUBLE), 6) AS char_share FROM g"""))
def cost_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections.gate_report(sections.section_texts(statute.nodes(spark, sf_dir)))


@query(statute.oracle("SELECT doc_id, round(avg(CASE WHEN " + " OR ".join(f"contains(lower(raw), '{t}')" for t in pack.GATE_TERMS) + " THEN 1.0 ELSE 0.0 END), 6) AS rate, count(*) AS nodes FROM s GROUP BY doc_id"))
def gate_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = statute.nodes(spark, sf_dir)
    return own.groupBy("doc_id").agg(F.round(F.avg(sections.admitted(F.col("raw")).cast("double")), 6).alias("rate"), F.count(F.lit(1)).alias("nodes"))


@query(statute.oracle("""SELECT node_id, CASE WHEN ln % 4 = 2 AND ln > 4 THEN 'rejected' WHEN ln % 4 = 2 THEN 'reflowed' ELSE 'exact' END AS verdict,
CASE WHEN ln % 4 = 2 AND ln > 4 THEN 'case_mismatch_only' END AS reason FROM s WHERE ln > 0"""))
def evidence_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    own = statute.view(spark, sf_dir).where("ln > 0")
    flat = F.regexp_replace("raw", r"\s+", " ")
    span = F.when((F.col("ln") % 4 == 2) & (F.col("ln") > 4), F.upper(flat)).otherwise(flat)
    return own.withColumn("e", sections.evidence("raw", span)).select("node_id", "e.verdict", "e.reason")


S_CHAINS = "x AS (SELECT doc_id, seq, ln % 4 <> 3 AND ln > 0 AS hit, row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS n FROM s), i AS (SELECT doc_id, seq, n - row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS island FROM x WHERE hit), c AS (SELECT doc_id, min(seq) AS start, count(*) AS length FROM i GROUP BY doc_id, island)"


def _chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = statute.nodes(spark, sf_dir)
    words = "|".join(["provided", "notwithstanding", "subject to"])
    return analytics.chains(own.select("doc_id", "seq", F.lower("raw").rlike(words).alias("hit")))


@query(statute.oracle(S_CHAINS + " SELECT doc_id, start, length FROM c"))
def chain_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chains(spark, sf_dir)


@query(statute.oracle(S_CHAINS + ", r AS (SELECT length, row_number() OVER (ORDER BY length) AS rn, count(*) OVER () AS n FROM c) SELECT length AS value FROM r WHERE rn = CAST(round_even(0.95 * (n - 1), 0) AS BIGINT) + 1"))
def chain_p95(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.nearest_rank(_chains(spark, sf_dir), "length", 0.95)


@query(statute.oracle("SELECT doc_id, count(*) AS units, count(*) FILTER (WHERE ln % 4 <> 3) AS closure_units, round(count(*) FILTER (WHERE ln % 4 <> 3) / CAST(count(*) AS DOUBLE), 6) AS density FROM s WHERE ln > 0 GROUP BY doc_id"))
def closure_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = statute.nodes(spark, sf_dir).where("ln > 0")
    hits = edges.marker_hits(own).where(F.col("type").isin(*pack.CLOSURE)).select("node_id").distinct().withColumn("hit", F.lit(1))
    every = own.join(hits, "node_id", "left").groupBy("doc_id").agg(F.count(F.lit(1)).alias("units"), F.count("hit").alias("closure_units"))
    return every.withColumn("density", F.round(F.col("closure_units") / F.col("units"), 6))


@query(statute.oracle("SELECT count(*) AS exceptions, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM e WHERE e.src = sib.node_id AND e.type = 'exception_of')) AS linked FROM sib WHERE ln % 4 = 0"))
def exception_linkage(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = bundle.saved(statute_nodes(spark, sf_dir), "nodes")
    made = statute_edges(spark, sf_dir, nodes).where("class = 'closure'").select(F.col("src").alias("node_id")).distinct().withColumn("out", F.lit(1))
    return nodes.where(F.col("raw").rlike(pack.java(pack.UNITS[0][1]))).join(made, "node_id", "left").agg(F.count(F.lit(1)).alias("exceptions"), F.count("out").alias("linked"))


@query("SELECT doc_id, line, content FROM (SELECT doc_id, generate_subscripts(p, 1) - 1 AS line, unnest(p) AS content FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents))")
def line_split_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.line_units(load(spark, sf_dir, "documents")).withColumn("line", F.col("line").cast("long"))


@query("SELECT doc_id, count(*) AS n_units, median(length(content)) AS median_chars, CAST(max(length(content)) AS BIGINT) AS max_chars FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS content FROM documents) GROUP BY doc_id")
def parser_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.report(analytics.line_units(load(spark, sf_dir, "documents"))).withColumn("max_chars", F.col("max_chars").cast("long"))


@query("SELECT substr(sha256(text), 1, 16) AS content_id, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1")
def content_hash_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").groupBy(F.substring(F.sha2("text", 256), 1, 16).alias("content_id")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))


@query("""WITH w AS (SELECT conv_id, turn, list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z]{3,}'), lambda x: NOT list_contains([""" + ", ".join(f"'{w}'" for w in analytics.OVERLAP_STOPWORDS) + """], x))) AS w FROM conversations),
p AS (SELECT a.conv_id, a.turn, a.w AS q, b.w AS g FROM w a JOIN w b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1)
SELECT conv_id, turn, CASE WHEN len(q) = 0 THEN 1.0 :: DOUBLE ELSE round(len(list_intersect(q, g)) / CAST(len(q) AS DOUBLE), 6) END AS ratio FROM p""")
def overlap_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = load(spark, sf_dir, "conversations")
    following = own.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reply"))
    return own.join(following, ["conv_id", "turn"]).select("conv_id", "turn", F.round(analytics.overlap(F.col("text"), F.col("reply")), 6).alias("ratio"))


@query(statute.oracle(r"""SELECT node_id, CASE WHEN n <> raw THEN n END AS normalized, greatest(1, length(CASE WHEN n = '' THEN raw ELSE n END) // 4) AS tokens
FROM (SELECT node_id, raw, trim(regexp_replace(regexp_replace(raw, '^\s*(?:\([0-9]{1,3}[A-Z]?\)|\([a-z]{1,3}\)|[0-9]{1,4}[A-Z]{0,2}\.)\s*', ''), '\s+', ' ', 'g')) AS n FROM s)"""))
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = statute.nodes(spark, sf_dir).withColumn("normalized", normalized(F.col("raw")))
    return own.select("node_id", "normalized", token_estimate(rendered(F.lit("current"), F.lit(""), F.col("normalized"), F.col("raw"))).cast("long").alias("tokens"))


@query(statute.oracle("""v AS (SELECT node_id AS root, node_id, 0 AS hops FROM s WHERE ln = 0 UNION SELECT v.root, e.src, v.hops + 1 FROM v JOIN e ON e.dst = v.node_id AND e.type = 'supersedes' WHERE v.hops < 20)
SELECT root AS query_id, node_id, min(hops) AS hops FROM v GROUP BY root, node_id"""))
def version_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = bundle.saved(statute_nodes(spark, sf_dir), "nodes")
    walk = graph.steps(statute_edges(spark, sf_dir, nodes).where("type = 'supersedes'"), "closure")
    roots = nodes.where("ln = 0").select(F.col("node_id").alias("query_id"), "node_id")
    return graph.closure(roots, walk, nodes)[0].select("query_id", "node_id", "hops")


@query(statute.oracle("""SELECT 'nodes' AS key, CAST(count(*) AS VARCHAR) AS value FROM s UNION ALL SELECT 'edges', CAST(count(*) AS VARCHAR) FROM e UNION ALL SELECT CASE WHEN type = 'part_of' THEN 'edges_context' ELSE 'edges_closure' END, CAST(count(*) AS VARCHAR) FROM e GROUP BY 1
UNION ALL SELECT 'documents', CAST(count(DISTINCT doc_id) AS VARCHAR) FROM s UNION ALL SELECT 'pending_documents', '0' UNION ALL SELECT 'terms', CAST(count(*) AS VARCHAR) FROM s WHERE ln % 4 = 3 AND ok % 7 = 0"""))
def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = bundle.saved(statute_nodes(spark, sf_dir), "nodes")
    return bundle.manifest(nodes.select("doc_id").distinct(), nodes, lexicon.terms(nodes), bundle.saved(statute_edges(spark, sf_dir, nodes), "edges"))


@query(statute.oracle("""SELECT doc_id, row_number() OVER w - 1 AS n, CASE WHEN ln = 0 THEN 'structural' ELSE 'proposition' END AS kind, CASE WHEN ln = 0 THEN 'heading' WHEN ln % 4 = 0 THEN 'proviso' ELSE 'subsec' END AS unit, raw,
CAST(CASE WHEN ln = 0 THEN NULL WHEN ln % 4 = 0 THEN last_value(CASE WHEN ln % 4 <> 0 OR ln = 0 THEN n END IGNORE NULLS) OVER v ELSE last_value(CASE WHEN ln = 0 THEN n END IGNORE NULLS) OVER v END AS BIGINT) AS parent
FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY seq) - 1 AS n FROM s) WINDOW w AS (PARTITION BY doc_id ORDER BY seq), v AS (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""))
def parse_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statutes, written out as texts and parsed again."""
    parts = F.array_sort(F.collect_list(F.struct("seq", "raw")))
    texts = statute.nodes(spark, sf_dir).groupBy("doc_id").agg(F.array_join(F.transform(parts, lambda p: p["raw"]), "\n\n").cast("binary").alias("content"))
    made = parse.nodes(bundle.saved(parse.units(texts), "units"))
    return made.select("doc_id", F.col("seq").alias("n"), "kind", "unit", "raw", F.regexp_extract("parent_id", r":(\d+)$", 1).cast("long").alias("parent"))
