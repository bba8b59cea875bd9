"""Statutes made from the relational tables: a thousand orders are one, each a section, its lines sub-sections, provisos and definitions.

The same SQL text runs in Spark and in the oracle; only the name of the string type differs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lexweave.sources.bundle import dealt, saved

SECTIONS = """l AS (SELECT l_orderkey AS ok, CAST(l_linenumber AS BIGINT) AS ln, min(l_partkey) AS p FROM {lineitem} GROUP BY l_orderkey, l_linenumber),
o AS (SELECT DISTINCT ok, CAST((ok - ok % 1000) / 1000 AS BIGINT) AS d FROM l),
n AS (SELECT ok, d, lag(ok) OVER (PARTITION BY d ORDER BY ok) AS pk, lead(ok) OVER (PARTITION BY d ORDER BY ok) AS nk FROM o),
k AS (SELECT ok, d, CASE WHEN ok % 2 = 0 THEN coalesce(pk, nk) ELSE coalesce(nk, pk) END AS k FROM n),
s AS (
  SELECT 'd' || CAST(d AS {string}) AS doc_id, ok * 10 AS seq, 'd' || CAST(d AS {string}) || ':' || CAST(ok * 10 AS {string}) AS node_id, 'structural' AS kind, 1 AS level, ok AS section,
    'Section ' || CAST(ok % 1000 + 1 AS {string}) || '. Rules of lot ' || CAST(ok AS {string}) || '.' AS raw, ok, CAST(0 AS BIGINT) AS ln, CAST(NULL AS BIGINT) AS p, k FROM k
  UNION ALL
  SELECT 'd' || CAST(d AS {string}), l.ok * 10 + ln, 'd' || CAST(d AS {string}) || ':' || CAST(l.ok * 10 + ln AS {string}), 'proposition', CASE WHEN ln % 4 = 0 THEN 9 ELSE 2 END, l.ok,
    CASE WHEN ln % 4 = 0 THEN 'Provided that nothing in this section shall apply to part ' || CAST(p AS {string}) || '.'
      WHEN ln % 4 = 1 AND l.ok % 11 = 0 THEN '(' || CAST(ln AS {string}) || ') Notwithstanding anything contained in this Act, part ' || CAST(p AS {string}) || ' prevails.'
      WHEN ln % 4 = 1 THEN '(' || CAST(ln AS {string}) || ') Notwithstanding anything contained in section ' || CAST(k % 1000 + 1 AS {string}) || ', part ' || CAST(p AS {string}) || ' prevails.'
      WHEN ln % 4 = 2 THEN '(' || CAST(ln AS {string}) || ') Subject to the provisions of section ' || CAST(k % 1000 + 1 AS {string}) || ',  part ' || CAST(p AS {string}) || ' yields.'
      WHEN l.ok % 7 = 0 THEN '(' || CAST(ln AS {string}) || ') "stock ' || CAST(p AS {string}) || '" means goods of that part.'
      ELSE '(' || CAST(ln AS {string}) || ') The holder of stock ' || CAST(p AS {string}) || ' keeps a record of it.' END,
    l.ok, ln, p, k FROM l JOIN k ON l.ok = k.ok)"""


def view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node_id, doc_id, seq, kind, level, section, raw and the numbers they come from: s of SECTIONS, shuffled once, by document."""
    own = spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr("l_orderkey AS ok", "CAST(l_linenumber AS BIGINT) AS ln", "l_partkey AS p", "CAST((l_orderkey - l_orderkey % 1000) / 1000 AS BIGINT) AS d")
    # a window over documents asks for their rows together; groups within documents then need no other shuffle
    lines = dealt(own.where("ok IS NOT NULL").withColumn("doc_id", F.concat(F.lit("d"), "d")), "doc_id").groupBy("doc_id", "d", "ok", "ln").agg(F.min("p").alias("p"))
    sections = lines.groupBy("doc_id", "d", "ok").agg(F.collect_list(F.struct(F.lit(False).alias("head"), "ln", "p")).alias("lines"))
    w = W.partitionBy("doc_id").orderBy("ok")
    before, after = F.lag("ok").over(w), F.lead("ok").over(w)
    sections = sections.withColumn("k", F.when(F.col("ok") % 2 == 0, F.coalesce(before, after)).otherwise(F.coalesce(after, before))).where("k IS NOT NULL")
    head = F.expr("array(named_struct('head', true, 'ln', 0L, 'p', CAST(NULL AS BIGINT)))")
    rows = sections.select("doc_id", "d", "ok", "k", F.explode(F.concat(head, "lines")).alias("x")).select("doc_id", "d", "ok", "k", "x.*")
    return rows.selectExpr("doc_id", *[f"{e} AS {n}" for n, e in _columns().items() if n != "doc_id"])


def _columns() -> dict[str, str]:
    """The columns of s over rows of headings (head) and lines; what a line says is SECTIONS' own text."""
    string = "STRING"
    told = SECTIONS.split("l.ok,\n    CASE ")[1].split(" END,\n")[0].replace("{string}", string).replace("l.ok", "ok")
    return {
        "doc_id": "doc_id", "seq": "ok * 10 + ln", "node_id": f"doc_id || ':' || CAST(ok * 10 + ln AS {string})", "kind": "CASE WHEN head THEN 'structural' ELSE 'proposition' END",
        "level": "CASE WHEN head THEN 1 WHEN ln % 4 = 0 THEN 9 ELSE 2 END", "section": "ok",
        "raw": f"CASE WHEN head THEN 'Section ' || CAST(ok % 1000 + 1 AS {string}) || '. Rules of lot ' || CAST(ok AS {string}) || '.' {told} END", "ok": "ok", "ln": "ln", "p": "p", "k": "k",
    }


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return saved(view(spark, sf_dir), "statute")


def oracle(rest: str) -> str:
    """SQL over s (nodes) and e (edges in closed form: part_of, exception_of, supersedes, conditioned_on)."""
    own = SECTIONS.replace("{string}", "VARCHAR").replace("{lineitem}", "lineitem").replace("\ns AS (", "\ns0 AS (")
    return f"""WITH RECURSIVE {own},
s AS MATERIALIZED (SELECT * FROM s0 WHERE k IS NOT NULL),
sib0 AS (SELECT *, doc_id || ':' || CAST(section * 10 AS VARCHAR) AS heading, last_value(CASE WHEN ln % 4 <> 0 THEN node_id END IGNORE NULLS) OVER (PARTITION BY doc_id, section ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS above FROM s WHERE kind = 'proposition'),
sib1 AS (SELECT *, CASE WHEN ln % 4 = 0 THEN coalesce(above, heading) ELSE heading END AS parent_id FROM sib0),
sib AS MATERIALIZED (SELECT *, lag(node_id) OVER w AS prev_id, lead(node_id) OVER w AS next_id FROM sib1 WINDOW w AS (PARTITION BY doc_id, parent_id ORDER BY seq)),
e0 AS (
  SELECT node_id AS src, parent_id AS dst, 'part_of' AS type, 'parser' AS origin FROM sib
  UNION ALL SELECT node_id, coalesce(prev_id, parent_id), CASE WHEN ln % 4 = 0 THEN 'exception_of' ELSE 'part_of' END, 'unit' FROM sib
  UNION ALL SELECT node_id, coalesce(prev_id, parent_id), 'exception_of', 'marker' FROM sib WHERE ln % 4 = 0
  UNION ALL SELECT node_id, doc_id || ':' || CAST(k * 10 AS VARCHAR), CASE WHEN ln % 4 = 1 THEN 'supersedes' ELSE 'conditioned_on' END, 'marker' FROM sib WHERE ln % 4 = 2 OR ln % 4 = 1 AND ok % 11 <> 0),
e AS MATERIALIZED (SELECT DISTINCT src, dst, type FROM e0),
steps AS MATERIALIZED (
  SELECT dst AS from_id, src AS to_id, type FROM e WHERE type IN ('exception_of', 'supersedes')
  UNION ALL SELECT src, dst, type FROM e WHERE type = 'conditioned_on'){"" if rest.lstrip().startswith("SELECT") or not rest else ","}
{rest}"""
