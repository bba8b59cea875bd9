"""Ingest as a stream: files that arrive in a folder are added to a bundle, batch by batch, each document once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from lexweave.sources import ingest


def follow(spark: SparkSession, path: str, out: str, checkpoint: str, pattern: str = "*.{txt,md}", **trigger) -> StreamingQuery:
    """Starts the stream. A batch that runs again adds nothing: tables are written documents last, and known documents are left out of each."""

    def add(batch: DataFrame, _: int) -> None:
        own = batch.sparkSession
        made = ingest.tables(ingest.with_ids(batch.select("path", "content")))
        for name in (*(t for t in ingest.TABLES if t != "documents"), "documents"):
            rows = made[name]
            try:
                known = own.read.parquet(f"{out}/{name}").select("doc_id").distinct()
                rows = rows.join(known, "doc_id", "left_anti")
            except Exception as e:
                if "PATH_NOT_FOUND" not in str(e):
                    raise
            rows.write.mode("append").parquet(f"{out}/{name}")

    source = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", pattern).load(path)
    return source.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
