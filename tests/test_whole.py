"""The queries ask about all questions, vectors, sections and roots."""

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest

from lexweave.operators import retrieval
from lexweave.plans import catalog

DATA = "/root/testdata/sf0.001"

@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in ("lineitem", "benchmark", "documents", "embeddings"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con


def test_every_node_and_every_question_has_a_result(spark, db):
    nodes = db.execute("SELECT count(*) + count(DISTINCT l_orderkey) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)").fetchone()[0]
    row = catalog.flat_vs_full_unsound_rate(spark, DATA).first()
    assert row.queries == nodes and row.full_unsound == 0
    assert catalog.version_chain(spark, DATA).select("query_id").distinct().count() == db.execute("SELECT count(DISTINCT l_orderkey) FROM lineitem").fetchone()[0]


def test_vector_search_in_blocks_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 7)
    monkeypatch.setattr(retrieval, "VECTOR_BLOCK", 90)
    t = pq.read_table(f"{DATA}/embeddings.parquet", columns=["vec_id", "embedding"]).to_pydict()
    v = np.array(t["embedding"], float)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    want = set()
    for i, q in enumerate(t["vec_id"]):
        if q % 20 == 0:
            near = np.round(v @ v[i], 9)
            best = sorted((-s, n) for s, n in zip(near, t["vec_id"]) if s > 0)[:10]
            want |= {(q, n, rank) for rank, (_, n) in enumerate(best, 1)}
    assert {(r.query_id, r.id, r.rank) for r in catalog.vector_topk(spark, DATA).collect()} == want


def test_vectors_of_other_length_and_without_any(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0, 5.0]), (3, [0.0, 0.0]), (4, None), (5, [1.0, None]), (6, [-1.0])], "id long, vector array<double>")
    queries = spark.createDataFrame([("q", [2.0])], "query_id string, vector array<double>")
    assert {r.id: r.score for r in retrieval.vector_top(vectors, queries, 5).collect()} == {1: 1.0, 2: round(26**-0.5, 9)}
