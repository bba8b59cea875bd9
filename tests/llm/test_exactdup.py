import hashlib
import os
import re
import subprocess
import sys

from pyspark.sql import functions as F

from lexweave.llm import exactdup
from lexweave.llm.queries import QUERIES

from tests.conftest import ROOT

from .helpers import DOCS, clashing, none, odd, odd_rows


def test_against_brute_force(spark, tmp_path):
    odd(spark).write.parquet(f"{tmp_path}/documents.parquet")
    rows = QUERIES["op8_exact_dedup"](spark, str(tmp_path)).collect()
    groups: dict = {}
    for d in odd_rows():
        groups.setdefault(d[1] or "", []).append(d[0])
    assert len(rows) == len(odd_rows())
    texts = {d[0]: d[1] or "" for d in odd_rows()}
    for r in rows:
        own = groups[texts[r.doc_id]]
        keep = max((i for i in own if i is not None), default=None)
        assert r.keep_id == keep and r.group_size == len(own) and r.kept == (r.doc_id == keep) and r.text_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_index_persists_over_batches(spark):
    a = spark.createDataFrame([(1, "x", "", "", 0), (2, "y", "", "", 0), (3, "x", "", "", 0)], DOCS)
    b = spark.createDataFrame([(10, "x", "", "", 0), (11, "z", "", "", 0), (12, "z", "", "", 0)], DOCS)
    index = exactdup.DigestIndex.fresh(spark)
    assert {r.doc_id for r in exactdup.dedup(a, index).where("kept").collect()} == {2, 3}
    rows = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exactdup.dedup(b, index).collect()}
    assert rows == {10: (10, 3, True), 11: (12, 2, False), 12: (12, 2, True)}
    assert index.table().count() == 3 and index.table("again").count() == 1
    index.compact()
    assert index.table().count() == 3 and index.table("again").count() == 0
    c = spark.createDataFrame([(4, "x", "", "", 0)], DOCS)
    assert [tuple(r)[2:] for r in exactdup.dedup(c, index).select("doc_id", "digest", "keep_id", "group_size", "kept").collect()] == [(10, 4, False)]
    index.drop()


def test_the_anti_join_is_a_merge_over_buckets(spark):
    index = exactdup.DigestIndex.fresh(spark)
    rows = spark.range(1000).selectExpr("id as doc_id", "cast(id as string) as text")
    exactdup.dedup(rows, index)
    classes = exactdup.classes_of(rows.select("doc_id", exactdup.digest(F.col("text")).alias("digest")))
    plan = index.unknown(classes)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "LeftAnti" in plan and "Bucketed: true" in plan
    assert not re.search("Python|Pandas|Arrow", plan + exactdup.dedup(rows)._jdf.queryExecution().toString())
    index.drop()


OTHER_SESSION = """
import sys
from pyspark.sql import SparkSession
from lexweave.llm import exactdup
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.sql.warehouse.dir", sys.argv[2]).getOrCreate()
index = exactdup.DigestIndex(spark, sys.argv[1], 4)
docs = spark.createDataFrame([(9, "known"), (1, "new")], "doc_id long, text string")
print(sorted(tuple(r) for r in exactdup.dedup(docs, index).select("doc_id", "keep_id", "group_size", "kept").collect()))
"""


def test_another_session_opens_the_index(spark, tmp_path):
    index = exactdup.DigestIndex(spark, f"file://{tmp_path}/index", 4)
    exactdup.dedup(spark.createDataFrame([(2, "known"), (3, "known")], "doc_id long, text string"), index)
    run = subprocess.run([sys.executable, "-c", OTHER_SESSION, f"file://{tmp_path}/index", f"{tmp_path}/warehouse"], cwd=ROOT, env={k: v for k, v in os.environ.items() if k != "PYSPARK_GATEWAY_PORT"}, capture_output=True, text=True, timeout=300)
    assert run.stdout.strip().endswith("[(1, 1, 1, True), (9, 9, 3, True)]"), run.stderr[-2000:]
    index.drop()


def test_hot_group(spark):
    df = spark.range(5000).selectExpr("id as doc_id", "if(id % 3 = 0, 'hot', cast(id as string)) as text")
    rows = exactdup.dedup(df).where("kept").collect()
    assert len(rows) == 5000 - 1667 + 1


def test_drop_copies_keeps_columns(spark):
    docs = clashing(odd(spark), "digest", "kept", "keep_id")
    kept = exactdup.drop_copies(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {2, 3, 6, 7, 8, 9, 10, 11, None}
    assert exactdup.dedup(none(spark)).count() == 0


def test_a_repeated_id_keeps_its_other_text(spark):
    docs = spark.createDataFrame([(5, "a"), (5, "b"), (7, "a")], "doc_id long, text string")
    assert sorted(map(tuple, exactdup.drop_copies(docs).collect())) == [(5, "b"), (7, "a")]


def test_repeated_rows_and_two_texts_of_an_id(spark):
    rows = [(12, "z"), (12, "q"), (13, "q"), (9, "x y"), (9, "x y"), (None, "n"), (None, "n"), (None, "q")]
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string"), "_id", "_digest", "row")
    kept = exactdup.drop_copies(docs)
    assert kept.columns == docs.columns and sorted(map(repr, ((r.doc_id, r.text, r.row) for r in kept.collect()))) == sorted(map(repr, [(12, "z", "x"), (13, "q", "x"), (9, "x y", "x"), (None, "n", "x")]))
