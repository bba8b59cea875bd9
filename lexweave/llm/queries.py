"""The queries opN_<name> and pipeline, with SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.llm import ann, exactdup, licenses, mixing, neardup, pieces, quality, sharding, toxicity, urls
from lexweave.llm.common import saved, table


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judge_urls(pages, urls.tracking_keys(pages)).select("page_id", "host", "path", "rule", "verdict")


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = mixing.sized(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).select("doc_id", "source", "size")
    return mixing.mix(saved(docs, "sizes")).select("doc_id", "size", "source_size", "target", "taken")


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = pieces.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), check=True)
    return made.select("doc_id", "n_tokens", "round_trip", "ids")


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32")
    rows = saved(sharding.keyed(docs).select("doc_id", "size", crc, *sharding.KEYS), "shard-keys")
    return sharding.deal(rows).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = exactdup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return made.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (op1_url_filters, op2_source_mixing, op3_nearest_neighbours, op4_license_scan, op5_sentencepiece, op6_minhash_near_dedup, op7_sharding, op8_exact_dedup, op9_quality_classifier, op10_toxicity, pipeline)
}


def _op1_sql() -> str:
    fits = []
    for kind, h, p in sorted(urls.RULES, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r[0] != "block")):
        fits.append((f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')", h + p, kind))
    rule = " ".join(f"WHEN {c} THEN '{r}'" for c, r, _ in fits)
    verdict = " ".join(f"WHEN {c} THEN '{k}'" for c, _, k in fits)
    lower = ", ".join(f"'{x}'" for x in ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    pattern = "(?s)^.*?://([^/?#]*)([^?#]*)"
    return f"""WITH parts AS (
  SELECT page_id, url, translate(coalesce(regexp_extract(url, '{pattern}', 1), ''), {lower}) AS host, coalesce(regexp_extract(url, '{pattern}', 2), '') AS path FROM pages),
keyed AS (SELECT *, host || regexp_extract(path, '^/[^/]*/?') AS k FROM parts),
listed AS (SELECT k FROM keyed GROUP BY k HAVING sum(CASE WHEN contains(url, 'utm_') THEN 1 ELSE 0 END) >= CAST(0.15 AS DOUBLE) * count(*))
SELECT page_id, host, path, CASE {rule} END AS rule,
  CASE {verdict} WHEN k IN (SELECT k FROM listed) THEN 'block' ELSE 'allow' END AS verdict FROM keyed"""


def _op4_sql() -> str:
    lower = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
    words, run = licenses.TOKEN.replace(r"\x40\x5B-", ""), licenses.RUN
    listed = lambda w: "[" + ", ".join(f"'{x}'" for x in w) + "]"
    places = []
    for p in licenses.PHRASES:
        parts = p.split(" ")
        fits = " AND ".join(f"w[i + {j + 1}] = '{x}'" for j, x in enumerate(parts))
        places.append(f"list_filter(range(greatest(len(w) - {len(parts) - 1}, 0)), lambda i: {fits})")
    base = ", ".join(f"CASE WHEN len(a{i}) > 0 THEN '{x}' END" for i, x in enumerate(licenses.PHRASES.values()))
    every = "flatten([" + ", ".join(f"a{i}" for i in range(len(places))) + "])"
    tests = []
    for name, t in licenses.TEMPLATES.items():
        own = licenses.tokens_of(t.text)
        told = f"len(list_intersect(b, {listed(own)})) >= {licenses.need_of(len(own))} AND len(list_intersect(b, {listed(t.must.split())})) = {len(t.must.split())}"
        told += f" AND len(list_intersect(b, {listed(t.without.split())})) = 0" if t.without else ""
        tests.append(f"SELECT doc_id, '{name}' AS label, len(list_intersect(b, {listed(own)})) / CAST({len(own)} AS DOUBLE) AS share FROM blocks WHERE {told}")
    return f"""WITH t AS (SELECT doc_id, translate(coalesce(text, ''), {lower}) AS x FROM documents),
words AS (SELECT doc_id, regexp_extract_all(x, '{words}') AS w FROM t),
found AS (SELECT doc_id, len(w) AS n_words, {", ".join(f"{p} AS a{i}" for i, p in enumerate(places))} FROM words),
base AS (SELECT doc_id, n_words, {every} AS places, list_filter([{base}], lambda l: l IS NOT NULL) AS found FROM found),
paragraphs AS (SELECT doc_id, regexp_extract_all(p, '{words}') AS w FROM (SELECT doc_id, unnest(string_split_regex(x, '{licenses.BLANK}')) AS p FROM t)),
blocks AS MATERIALIZED (
  SELECT doc_id, list_distinct(w) AS b FROM paragraphs WHERE len(w) <= {2 * run}
  UNION ALL SELECT doc_id, list_distinct(w[i + 1:i + {2 * run}]) FROM (SELECT doc_id, w, unnest(range(0, len(w) - {run}, {run})) AS i FROM paragraphs WHERE len(w) > {2 * run})),
hits AS ({" UNION ALL ".join(tests)}),
more AS (SELECT doc_id, list(DISTINCT label) AS labels, max(share) AS best FROM hits GROUP BY doc_id)
SELECT base.doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(len(places) AS BIGINT) AS n_base, CAST(list_min(places) AS BIGINT) AS first_word, CAST(list_max(places) AS BIGINT) AS last_word,
  array_to_string(list_sort(list_distinct(found)), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(found, coalesce(more.labels, [])))), ',') AS labels,
  CASE WHEN len(found) > 0 THEN CAST(1 AS DOUBLE) ELSE coalesce(best, CAST(0 AS DOUBLE)) END AS score
FROM base LEFT JOIN more ON base.doc_id = more.doc_id"""


_OP8_SQL = """WITH t AS (SELECT doc_id, coalesce(text, '') AS x FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(x) AS text_sha256
FROM t WINDOW w AS (PARTITION BY x)"""

#: op3 is left out: its result is approximate. The others learn, solve or iterate.
ORACLE_SQL = {"op1_url_filters": _op1_sql(), "op4_license_scan": _op4_sql(), "op8_exact_dedup": _OP8_SQL}
