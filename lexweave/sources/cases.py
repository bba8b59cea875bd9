"""Cases and questions as lines of JSON, and what stage of an ingest took how long."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CASE = T.StructType([T.StructField(n, T.StringType()) for n in ("query", "cause", "source_file", "gold_span", "naive_retrieval_gets", "why_it_fails")])
LEDGER = T.StructType([
    T.StructField("doc_id", T.StringType()), T.StructField("stage", T.StringType()), T.StructField("duration_ms", T.LongType()), T.StructField("input_tokens", T.LongType()), T.StructField("output_tokens", T.LongType()),
    T.StructField("model_id", T.StringType()), T.StructField("recorded_at", T.TimestampType()),
])


def read_lines(spark: SparkSession, path: str, schema: T.StructType = CASE) -> tuple[DataFrame, DataFrame]:
    """The rows of lines of JSON, and the lines that are none (line). Empty lines and comments (//) don't count."""
    lines = spark.read.text(path).select(F.trim("value").alias("line")).where("line != '' and not startswith(line, '//')")
    whole = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    parsed = lines.select("line", F.from_json("line", whole, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    return parsed.where("r._bad is null").select(*[f"r.{f.name}" for f in schema.fields]), parsed.where("r._bad is not null").select("line")


def record(ledger: DataFrame, path: str) -> None:
    """Appends rows of LEDGER."""
    ledger.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in LEDGER.fields]).write.mode("append").parquet(path)


def costs(ledger: DataFrame) -> DataFrame:
    """stage, model_id, documents, duration_ms, input_tokens, output_tokens, with a row for all of each stage (model_id null) and of all."""
    sums = [F.sum(c).alias(c) for c in ("duration_ms", "input_tokens", "output_tokens")]
    return ledger.rollup("stage", "model_id").agg(F.count_distinct("doc_id").alias("documents"), *sums, F.grouping_id().alias("level"))


def batches(rows: DataFrame, order: str, size: int = 40) -> DataFrame:
    """rows with batch: so many in each, in order. Counts of partitions give places, so nothing is sorted in one task."""
    from pyspark.sql import Window as W

    parts = rows.repartitionByRange(F.col(order)).withColumn("_part", F.spark_partition_id())
    from lexweave.sources.bundle import saved

    parts = saved(parts, "batches")
    counts = {r["_part"]: r["count"] for r in parts.groupBy("_part").count().collect()}  # a row a partition
    before = rows.sparkSession.createDataFrame([(p, sum(n for q, n in counts.items() if q < p)) for p in counts] or [(0, 0)], "_part int, _before long")
    place = F.row_number().over(W.partitionBy("_part").orderBy(order)) - 1
    own = parts.withColumn("_place", place).join(F.broadcast(before), "_part")
    return own.withColumn("batch", F.floor((F.col("_place") + F.col("_before")) / size).cast("int")).drop("_part", "_place", "_before")
