"""What searches over large tables rest on: few rows leave a block of texts, and the same rows as the plain way."""

from lexweave.operators import retrieval


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((x is not None, str(x)) for x in r))


def _texts(spark):
    texts = [(i, f"apple pear{i % 7} {'plum ' * (i % 3)}fig{i % 50}") for i in range(400)]
    odd = [(1000, None), (1001, ""), (1002, "the of"), (None, "apple nobody"), (None, "plum"), (1003, "apple"), (1003, "apple Plum KKiwi"), (1004, "don't re-enter don't")]
    return spark.createDataFrame(texts + odd, "id long, text string").repartition(4)


def _questions(spark):
    return spark.createDataFrame([("a", "apple plum"), ("b", "pear3 fig9 nothing-like-it"), ("c", "the"), ("d", None), ("e", "don't apple"), ("e", "apple"), (None, "plum kkiwi")], "query_id string, text string")


def test_questions_meet_texts_in_blocks_with_the_same_scores(spark, monkeypatch):
    index, questions = retrieval.build(_texts(spark)), _questions(spark)
    blocks, best = _rows(retrieval.scores(index, questions)), _rows(retrieval.best(index, questions, 3))
    left = retrieval._scores(index, questions, 3).count()
    monkeypatch.setattr(retrieval, "BLOCK_CELLS", 20)
    assert _rows(retrieval.best(index, questions, 3)) == best
    monkeypatch.setattr(retrieval, "ASKED", 0)  # as with many questions: joined by terms
    plain = retrieval.scores(index, questions)
    assert blocks == _rows(plain) and best == _rows(retrieval.top(plain, 3)) and len(best) == 4 * 3
    assert left < len(blocks) / 4


def test_norms_know_terms_of_every_frequency(spark, monkeypatch):
    every = _rows(retrieval.build(_texts(spark)).norm)
    monkeypatch.setattr(retrieval, "FREQUENT", 5)
    some = _rows(retrieval.build(_texts(spark)).norm)
    assert [i for i, _ in every] == [i for i, _ in some] and all(abs(a - b) < 1e-12 for (_, a), (_, b) in zip(every, some))


def test_a_search_of_an_empty_corpus_finds_nothing(spark):
    index = retrieval.build(spark.createDataFrame([(1, None)], "id long, text string"))
    assert retrieval.best(index, _questions(spark), 3).collect() == [] == retrieval.scores(index, _questions(spark)).collect()


def test_candidates_go_to_their_texts(spark):
    from pyspark.sql import functions as F

    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = spark.createDataFrame([("a", 1), ("a", 2), ("a", 9999)], "query_id string, id long")
        got = retrieval.reranked(found, _texts(spark), _questions(spark), F.length("text").cast("double"), 5)
        assert "BroadcastHashJoin" in got._jdf.queryExecution().executedPlan().toString()
        assert [(r.query_id, r.id) for r in got.orderBy("rank").collect()] == [("a", 2), ("a", 1)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
