from pyspark.sql import functions as F

from lexweave.llm import urls
from lexweave.llm.urls import RULES, Cascade, judge_urls, tracking_keys

from .helpers import clashing

URLS = [
    None, "", "no scheme", "http://", "https://EXAMPLE.com/en/a?x=1", "http://www.example.com/en/b", "http://www.example.com/de/", "http://notexample.com/en/", "http://a.net/es/x#y", "http://net/fr/", "http://other.org/p/q?utm_source=1",
    "http://other.org/p/r?utm_source=2", "http://other.org/z/", "http://x.net/fr", "ftp://a.net/es/://", "http://net?utm_x", "http://other.org/p/q?utm_source=1",
]


def brute(url, listed):
    host, path = "", ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
        path = rest[end:]
        path = path[: min([i for i in map(path.find, "?#") if i >= 0], default=len(path))]
    fits = [(len(h + p), h + p, kind) for kind, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    first = path[: path.find("/", 1) + 1] if path.find("/", 1) > 0 else path
    if fits:
        return host, path, max(fits)[1], max(fits)[2], host + first
    return host, path, None, "block" if host + first in listed else "allow", host + first


def test_urls_against_brute_force(spark):
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string")
    keys: dict = {}
    for u in URLS:
        keys.setdefault(brute(u, ())[4], []).append("utm_" in (u or ""))
    listed = {k for k, v in keys.items() if sum(v) >= 0.15 * len(v)}
    found = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judge_urls(clashing(pages, "host", "rule"), tracking_keys(pages)).collect()}
    assert found == {i: brute(u, listed)[:4] for i, u in enumerate(URLS)}


def test_many_cascades_give_the_same_without_a_join(spark):
    pages = spark.createDataFrame(list(enumerate(URLS * 3)), "page_id long, url string")
    one, many = (judge_urls(pages, tracking_keys(pages), max_listed=m) for m in (1 << 20, 1))
    assert sorted(map(str, one.collect())) == sorted(map(str, many.collect())) and many.columns == one.columns
    assert "Join" not in many._jdf.queryExecution().toString()


def test_ties_of_rules_go_to_the_longer_host_then_block(spark):
    rules = (("allow", "a.com", "/bc"), ("block", "xa.com", "/b"), ("allow", "b.com", "/p"), ("block", "b.com", "/p"))
    pages = spark.createDataFrame([(1, "http://a.com/bc"), (2, "http://b.com/p"), (3, "http://y.a.com/bcd")], "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in judge_urls(pages, tracking_keys(pages), rules).collect()}
    assert got == {1: ("a.com/bc", "allow"), 2: ("b.com/p", "block"), 3: ("a.com/bc", "allow")}


def test_empty_table(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    assert judge_urls(pages, tracking_keys(pages)).count() == 0


def test_cascade_is_exact_over_its_universe(spark):
    universe = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("key"), (F.col("id") % 7 == 0).alias("listed")).cache()
    cascade = Cascade.build(universe)
    assert len(cascade.levels) > 1
    assert universe.where(cascade.contains(F.col("key")) != F.col("listed")).count() == 0


def test_main_path_runs_no_python(spark):
    pages = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string").repartition(2)
    plan = urls.judge_urls(pages, tracking_keys(pages))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_cascade_is_exact_when_the_levels_run_out(spark):
    universe = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("key"), (F.col("id") % 7 == 0).alias("listed")).cache()
    for most in (0, 1, 2, 4):
        cascade = Cascade.build(universe, most)
        assert len(cascade.levels) == most and cascade.rest[1] > urls.FEW
        assert universe.where(cascade.contains(F.col("key")) != F.col("listed")).count() == 0
