"""Corpus analytics: densities, chains, percentiles, linkage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def chains(units: DataFrame) -> DataFrame:
    """units (doc_id, seq, hit) as doc_id, start, length of each run of consecutive hits."""
    w = W.partitionBy("doc_id").orderBy("seq")
    numbered = units.withColumn("n", F.row_number().over(w)).where("hit")
    island = numbered.withColumn("island", F.col("n") - F.row_number().over(w))
    return island.groupBy("doc_id", "island").agg(F.min("seq").alias("start"), F.count(F.lit(1)).alias("length")).drop("island")


def nearest_rank(values: DataFrame, value: str, q: float) -> DataFrame:
    """The value at index round(q * (n - 1)), halves to even, of all values: from counts, so nothing is sorted as a whole."""
    counts = values.groupBy(value).agg(F.count(F.lit(1)).alias("c"))
    w = W.orderBy(value)
    ranked = counts.withColumns({"upto": F.sum("c").over(w), "n": F.sum("c").over(W.partitionBy())})
    return ranked.where(F.col("upto") > F.bround(F.lit(q) * (F.col("n") - 1), 0)).agg(F.min(value).alias("value"))


def line_units(texts: DataFrame) -> DataFrame:
    """texts (doc_id, text) as doc_id, line, content: physical lines, a final empty one included."""
    return texts.select("doc_id", F.posexplode(F.split("text", "\r\n|\r|\n", -1)).alias("line", "content"))


def report(lines: DataFrame) -> DataFrame:
    n = F.length("content")
    return lines.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_units"), F.median(n).alias("median_chars"), F.max(n).alias("max_chars"))


# Results depend on exactly these words.
OVERLAP_STOPWORDS = (
    "the", "and", "for", "any", "all", "not", "but", "with", "that", "this", "such", "shall", "may", "his", "her", "its", "been", "have", "has", "was", "were", "are", "is", "be", "of", "in", "to", "on", "by", "or", "as",
    "at", "from", "under", "which", "who", "whom", "whose", "where", "when", "what", "act", "section", "sub", "clause", "provided", "provision", "person", "state", "government",
)
# End of the fixed values.


def content_words(text: Column) -> Column:
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z]{3,}"), F.lit(0))
    return F.array_distinct(F.filter(words, lambda w: ~w.isin(*OVERLAP_STOPWORDS)))


def overlap(query: Column, gold: Column) -> Column:
    """Share of the query's distinct content words that gold has; 1 for a query without."""
    q, g = content_words(query), content_words(gold)
    return F.when(F.size(q) == 0, 1.0).otherwise(F.size(F.array_intersect(q, g)) / F.size(q))
