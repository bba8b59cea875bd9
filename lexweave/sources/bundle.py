"""Bundles: a folder of Parquet tables, and tables kept between the steps of a job."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lexweave import ship

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir; where that is unset, a folder in the warehouse, or on a single machine one of our own."""
    if where := spark.conf.get("spark.checkpoint.dir", None):
        return where.rstrip("/")
    sc = spark.sparkContext
    if sc.master.startswith("local") and not sc.master.startswith("local-cluster"):
        return _OWN.setdefault(sc.applicationId, "file://" + tempfile.mkdtemp(prefix="lexweave-"))
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/")


def saved(df: DataFrame, label: str, *by: str) -> DataFrame:
    """df, written to the shared folder, in folders by some columns, and read again: an end to its lineage that lost executors don't undo. sweep() deletes what is there."""
    spark = df.sparkSession
    ship(spark)
    path = f"{shared_dir(spark)}/lexweave/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dealt(rows: DataFrame, *by: str) -> DataFrame:
    """rows, shuffled by columns to spark.sql.shuffle.partitions tasks. Slim rows that are to grow wide would else be put together to few tasks."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def sweep(spark: SparkSession) -> None:
    """Deletes all that saved() has kept for this application. DataFrames that were made from it can't be used any more."""
    delete(spark, f"{shared_dir(spark)}/lexweave/{spark.sparkContext.applicationId}")


def write(tables: dict[str, DataFrame], path: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def read(spark: SparkSession, path: str, *names: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in names}


def upsert(old: DataFrame, new: DataFrame, *key: str) -> DataFrame:
    """old with the rows of new, which replace those of the same key."""
    return old.join(new.select(*key), list(key), "left_anti").unionByName(new)


def manifest(documents: DataFrame, nodes: DataFrame, terms: DataFrame, edges: DataFrame) -> DataFrame:
    """key, value: counts of what a bundle holds."""
    count = lambda df, key: df.agg(F.count(F.lit(1)).cast("string").alias("value")).select(F.lit(key).alias("key"), "value")
    out = count(documents, "documents").unionByName(count(nodes, "nodes")).unionByName(count(terms, "terms")).unionByName(count(edges, "edges"))
    by_class = edges.groupBy("class").agg(F.count(F.lit(1)).cast("string").alias("value")).select(F.concat(F.lit("edges_"), "class").alias("key"), "value")
    pending = documents.where("review_state = 'pending'") if "review_state" in documents.columns else documents.limit(0)
    return out.unionByName(by_class).unionByName(count(pending, "pending_documents"))


def latest(rows: DataFrame, *key: str, by: str) -> DataFrame:
    w = W.partitionBy(*key).orderBy(F.desc(by))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
