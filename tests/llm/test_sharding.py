import zlib

from lexweave.llm import sharding

from .helpers import clashing, none, odd, words


def check(rows, shards):
    by: dict = {}
    for r in rows:
        assert r.size == len((r.text or "").encode()) + 1 and r.law == "bytes" and r.grown_shard is None
        by.setdefault(r.shard, []).append(r)
    assert set(by) <= set(range(shards))
    for part in by.values():
        assert sorted(r.slot for r in part) == list(range(len(part)))
    total, most = sum(r.size for r in rows), max((r.size for r in rows), default=0)
    for k in range(shards):
        assert abs(sum(r.size for r in by.get(k, [])) - total / shards) <= 0.002 * total / shards + 2 * most


def test_odd_rows(spark):
    check(sharding.shard(clashing(odd(spark), "size", "shard", "slot"), 4).collect(), 4)


def test_sizes_hot_group_and_reruns(spark):
    rows = [(i, words(20, 1) if i % 3 == 0 else words(1 + i % 50, i)) for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    made = sharding.shard(df, 16).collect()
    check(made, 16)
    again = sharding.shard(df.repartition(9), 16).collect()
    assert {(r.doc_id, r.shard, r.slot) for r in made} == {(r.doc_id, r.shard, r.slot) for r in again}
    # equal texts are neighbours: those of the hot group fill whole shards but for the two at its ends
    hot = {r.shard for r in made if r.text == words(20, 1)}
    assert hot == set(range(min(hot), max(hot) + 1))


def test_one_text_only_and_empty(spark):
    check(sharding.shard(spark.createDataFrame([(i, "same") for i in range(500)], "doc_id long, text string"), 16).collect(), 16)
    assert sharding.shard(none(spark), 16).count() == 0


def test_query_columns(spark, tmp_path):
    from lexweave.llm.queries import QUERIES

    odd(spark).write.parquet(f"{tmp_path}/documents.parquet")
    rows = QUERIES["op7_sharding"](spark, str(tmp_path)).collect()
    texts = {r.doc_id: r.text or "" for r in odd(spark).collect()}
    assert all(r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) for r in rows) and len(rows) == odd(spark).count()


def test_against_a_sort_of_all_keys(spark, monkeypatch):
    """Shards are runs of the sorted keys that end within the tolerance of the exact bytes; slots count within them."""
    monkeypatch.setattr(sharding, "SORTED", 50)
    rows = [(i, words(10, 1) if i % 3 == 0 else words(1 + i % 50, i)) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    keys = {r.doc_id: (r._h % 2**64, r._g % 2**64, r.size) for r in sharding.keyed(df).collect()}
    made = {r.doc_id: (r.shard, r.slot) for r in sharding.shard(df, 8).collect()}
    order = sorted(keys, key=lambda i: (*keys[i][:2], i))
    assert [made[i] for i in order] == sorted(made.values())
    total, largest = sum(k[2] for k in keys.values()), max(k[2] for k in keys.values())
    at, last = 0, 0
    for i in order:
        for k in range(last + 1, made[i][0] + 1):
            assert abs(at - k * total / 8) <= 0.002 * total / 8 + largest
        last, at = made[i][0], at + keys[i][2]
    assert max(sum(1 for _ in sharding.intervals(sharding.keyed(df), 8)), 1) >= 3000 / 50


def test_main_path_is_native(spark):
    import re

    assert not re.search("Python|Pandas|Arrow", sharding.shard(odd(spark), 4)._jdf.queryExecution().toString())
