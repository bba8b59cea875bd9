"""Exact deduplication against a persistent digest index.

The index is a Parquet table in a folder of its own, bucketed and sorted within files by SHA-256 digest, a row for each known
digest. New rows are reduced to classes of equal texts; those whose digest the index lacks are found by a sort-merge
anti-join, for which the index is read in its buckets without a shuffle, and appended. Classes that it knows go to a second
table of the same layout, as deltas: a digest's keep_id is the largest of its rows, its group_size their sum. compact() folds
the deltas in. The catalog only holds the tables' names: an index that is opened again, in whatever session, is declared over
the files that are there.

Edge cases: a null text counts as the empty one. Of equal texts the largest doc_id stays, over all batches; a null doc_id
stays only if no other row has its text and isn't null. Rows that repeat a doc_id and its text are the same document and get
the same verdict; drop_copies() keeps one of them. Rows of one doc_id with different texts are different documents. Very long
texts only count by their digest. An empty table gives an empty result. Other columns stay as they are in drop_copies(),
whatever their names, and are left out of dedup().
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave import ship
from lexweave.llm.common import delete, saved, shared_dir, small_or_not

BUCKETS = 32
HOT = 1000
"""At most so many classes hold 1/HOT of the rows or more; these are looked up by broadcast, so no task gets a hot class."""


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


class DigestIndex:
    """The index under path. buckets must be what it was made with."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets, self.names = spark, path.rstrip("/"), buckets, {}
        for part in ("known", "again"):
            self.names[part] = f"digests_{part}_{uuid.uuid4().hex}"
            spark.sql(
                f"CREATE TABLE {self.names[part]} (digest BINARY, keep_id BIGINT, group_size BIGINT) USING parquet "
                f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{self.path}/{part}'"
            )

    @classmethod
    def fresh(cls, spark: SparkSession) -> DigestIndex:
        return cls(spark, f"{shared_dir(spark)}/lexweave/digests-{uuid.uuid4().hex}", max(BUCKETS, int(spark.conf.get("spark.sql.shuffle.partitions"))))

    def table(self, part: str = "known") -> DataFrame:
        return self.spark.table(self.names[part])

    def state(self) -> DataFrame:
        """digest, keep_id, group_size as of now, each digest once."""
        if not self.table("again").take(1):
            return self.table()
        more = self.table("again").groupBy("digest").agg(F.max("keep_id").alias("_id"), F.sum("group_size").alias("_n"))  # in buckets, like the join
        both = self.table().join(more.hint("merge"), "digest", "left")
        return both.select("digest", F.greatest("keep_id", "_id").alias("keep_id"), (F.col("group_size") + F.coalesce("_n", F.lit(0))).alias("group_size"))

    def unknown(self, classes: DataFrame) -> DataFrame:
        """The classes whose digest the index lacks."""
        return classes.join(self.table().select("digest").hint("merge"), "digest", "left_anti")

    def append(self, classes: DataFrame) -> None:
        """Adds classes (digest, keep_id, group_size), each digest once."""
        new = self.unknown(classes)
        if self.table().take(1):
            self._write("again", classes.join(self.table().select("digest").hint("merge"), "digest", "left_semi"))
        self._write("known", new)

    def _write(self, part: str, classes: DataFrame) -> None:
        rows = classes.select("digest", "keep_id", "group_size").repartition(self.buckets, "digest")
        rows.write.bucketBy(self.buckets, "digest").sortBy("digest").format("parquet").mode("append").saveAsTable(self.names[part], path=f"{self.path}/{part}")

    def compact(self) -> None:
        """One row a digest and one file a bucket. Not to be run while others use the index."""
        now = saved(self.state(), "digests-all")
        self.drop()
        self.__init__(self.spark, self.path, self.buckets)
        self._write("known", now)

    def close(self) -> None:
        """Takes the tables out of the catalog; files stay."""
        for name in self.names.values():
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def drop(self) -> None:
        self.close()
        delete(self.spark, self.path)


def classes_of(digests: DataFrame) -> DataFrame:
    return digests.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))


def dedup(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """One row per document: doc_id, digest, keep_id, group_size (rows with this text known to the index by now), kept.

    Without an index, one is made for these documents only.
    """
    spark = docs.sparkSession
    ship(spark)
    own_index = index or DigestIndex.fresh(spark)
    own = saved(docs.select("doc_id", digest(F.col("text")).alias("digest")), "digests")
    classes = saved(classes_of(own), "classes")
    own_index.append(classes)
    n = own.count()
    hot = F.broadcast(classes.where(F.col("group_size") >= max(2, -(-n // HOT))).select("digest"))
    known = own_index.state()
    known_hot = known.join(hot, "digest", "left_semi")
    few = own.join(hot, "digest", "left_anti").join(known.hint("merge"), "digest")
    many = own.join(F.broadcast(known_hot), "digest")
    out = few.unionByName(many).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull()))
    if index is None:
        out = saved(out, "verdicts")
        own_index.drop()
    return out


def drop_copies(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """docs without the rows of which another row with the same text stays; of rows that repeat a doc_id and its text one stays."""
    verdicts = dedup(docs, index)
    verdicts = verdicts if index is None else saved(verdicts, "verdicts")  # without an index, dedup() has kept them
    gone = verdicts.where("not kept").select("doc_id", "digest").distinct()
    twice = verdicts.where("kept").groupBy("doc_id", "digest").count().where("count > 1").select("doc_id", "digest")
    at = "at_" + uuid.uuid4().hex  # a name that the caller's columns don't have
    row = F.struct(F.col("doc_id"), digest(F.col("text")).alias("digest")).alias(at)
    marked = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), row)
    keyed = lambda df: small_or_not(df.select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest")), 250_000)
    same = F.col(f"{at}.doc_id").eqNullSafe(F.col("_id")) & (F.col(f"{at}.digest") == F.col("_digest"))
    marked = marked.join(keyed(gone), same, "left_anti")
    if twice.take(1):
        repeated = marked.join(keyed(twice), same, "left_semi").groupBy(at).agg(F.first("row").alias("row"))
        marked = marked.join(keyed(twice), same, "left_anti").select("row", at).unionByName(repeated.select("row", at))
    return marked.select("row.*")
