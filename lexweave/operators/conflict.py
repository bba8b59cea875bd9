"""Override claims and the conflicts between them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.functions import pack
from lexweave.operators.edges import marker_hits


def claims(nodes: DataFrame) -> DataFrame:
    """doc_id, node_id, section, marker, scope (section, document, external), target. Hits whose scope can't be told are left out."""
    hits = marker_hits(nodes, tuple(m for m in pack.MARKERS if m.edge == "supersedes"))
    rest = F.expr("substring(raw, instr(raw, span) + length(span))")
    scope = F.lit(None).cast("string")
    for name, pattern, ignore_case in reversed(pack.SCOPES):
        scope = F.when(pack.starts(rest, pattern, ignore_case), name).otherwise(scope)
    number = pack.java(r"\A" + next(p for n, p, _ in pack.SCOPES if n == "section").replace(r"\d+[A-Za-z]*", r"(\d+[A-Za-z]*)"))
    own = hits.withColumns({"scope": scope, "target": F.upper(F.regexp_extract(rest, number, 1))}).where("scope is not null")
    return own.select("doc_id", "node_id", F.col("section").cast("string").alias("section"), "marker", "scope", F.when(F.col("scope") == "section", F.col("target")).alias("target"))


def mutual(claimed: DataFrame) -> DataFrame:
    """Pairs of claims of a document that cover each other's section, at least one of them naming it."""
    own = claimed.where("scope in ('section', 'document') and section is not null")
    named = own.where("scope = 'section'")
    b = lambda df: df.select(*[F.col(c).alias("b_" + c) for c in df.columns])
    # both name a section: an equi-join on the two sections, crosswise
    both = named.join(b(named), [F.col("doc_id") == F.col("b_doc_id"), F.col("target") == F.col("b_section"), F.col("section") == F.col("b_target")])
    both = both.where(F.col("node_id") < F.col("b_node_id")).select("doc_id", F.col("node_id").alias("a_id"), F.col("b_node_id").alias("b_id"))
    # one names the section of one that covers the whole document
    wide = b(own.where("scope = 'document'"))
    one = named.join(wide, [F.col("doc_id") == F.col("b_doc_id"), F.col("target") == F.col("b_section")]).where(F.col("section") != F.col("b_section"))
    one = one.select("doc_id", F.least("node_id", "b_node_id").alias("a_id"), F.greatest("node_id", "b_node_id").alias("b_id"))
    return both.unionByName(one).distinct().select("doc_id", "a_id", "b_id", F.lit("mutual_reference").alias("kind"), F.lit(1.0).alias("confidence"))


def clusters(claimed: DataFrame) -> DataFrame:
    """Documents with two or more document-wide claims in two or more sections."""
    own = claimed.where("scope = 'document'").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_claims"), F.count_distinct(F.coalesce("section", F.lit("-"))).alias("n_sections"))
    return own.where("n_claims >= 2 and n_sections >= 2").withColumn("confidence", F.lit(0.5))


def report(conflicts: DataFrame, most: int = 10) -> DataFrame:
    """doc_id, shown (the first pairs, "a / b"), more (how many are not shown)."""
    from pyspark.sql import Window as W

    place = F.row_number().over(W.partitionBy("doc_id").orderBy("a_id", "b_id"))
    own = conflicts.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    first = conflicts.withColumn("place", place).where(F.col("place") <= most).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("place", F.concat_ws(" / ", "a_id", "b_id").alias("pair")))).alias("p"))
    return own.join(first, "doc_id").select("doc_id", F.transform("p", lambda x: x["pair"]).alias("shown"), F.greatest(F.lit(0), F.col("n") - most).alias("more"))
