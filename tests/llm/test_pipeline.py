"""The pipeline's stages against what each of them is to decide, on the smallest tables."""

import pytest

pytest.importorskip("corpus_pipeline")

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    import corpus_pipeline
    from lexweave.llm import exactdup, neardup, quality
    from lexweave.llm.common import table

    try:
        docs = table(spark, SF, "documents")
    except Exception:
        pytest.skip("no test data")
    scores = {r.doc_id: r.predicted for r in quality.classify(docs, table(spark, SF, "labels")).collect()}
    stages = [f for _, f in corpus_pipeline.STAGES]
    good = stages[0](spark, docs, SF)
    assert good.columns == docs.columns and {r.doc_id for r in good.collect()} == {i for i, p in scores.items() if p}
    unique = stages[1](spark, good, SF)
    assert unique.columns == docs.columns and {r.doc_id for r in unique.collect()} == {r.doc_id for r in exactdup.dedup(good).where("kept").collect()}
    from .test_neardup import brute

    near = stages[2](spark, unique, SF)
    kept = {i for i, (_, c) in brute([(r.doc_id, r.text) for r in unique.collect()], 80).items() if i == c}
    assert near.columns == docs.columns and {r.doc_id for r in near.collect()} == kept
    mixed = stages[3](spark, near, SF)
    assert mixed.columns == docs.columns and {r.doc_id for r in mixed.collect()} <= kept
    done = stages[4](spark, mixed, SF)
    assert "ids" in done.columns and done.count() == mixed.count()
    assert neardup.near_duplicates(near, 80).where("not kept").count() == 0


def test_empty_documents(spark, tmp_path):
    import corpus_pipeline

    from .helpers import none

    none(spark).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_odd_rows_in_every_stage(spark, tmp_path):
    """Nulls, empty and long texts, repeated rows, and columns named like those that operators make."""
    import corpus_pipeline

    from .helpers import clashing, odd, odd_rows

    spark.createDataFrame([(4, 1, 0), (9, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    names = ("size", "target", "taken", "copies", "row", "rank", "first", "stats", "kept", "component_id", "mark", "n", "_key", "_rank", "_first", "digest", "_id", "score")
    docs = clashing(odd(spark), *names)
    stages = [f for _, f in corpus_pipeline.STAGES]
    good = stages[0](spark, docs, str(tmp_path))
    assert good.columns == docs.columns and good.count() == len(odd_rows())
    kept = stages[1](spark, good, str(tmp_path))
    assert {r.doc_id for r in kept.collect()} == {2, 3, 6, 7, 8, 9, 10, 11, None} and kept.count() == 9
    near = stages[2](spark, kept, str(tmp_path))
    assert {r.doc_id for r in near.collect()} == {2, 3, 6, 7, 9, 10, None}
    mixed = stages[3](spark, near, str(tmp_path))
    assert mixed.columns == docs.columns and all(r[n] == "x" for r in mixed.collect() for n in names) and {r.doc_id for r in mixed.collect()} <= {6, 7, 9, 10, None}
    done = stages[4](spark, mixed, str(tmp_path))
    assert done.columns == [c for c in docs.columns if c != "text"] + ["ids", "n_tokens"] and all(len(r.ids) == r.n_tokens for r in done.collect())
