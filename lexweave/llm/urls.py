"""URL filters: allow and block rules by host suffix and path prefix, and a Bloom filter cascade for listed keys.

The cascade's odd levels encode listed keys, its even levels the false positives that the level before has among the
corpus's other keys (and, in turn, among the listed ones), until few or none are left or the levels have run out; what is
left is kept as it is, dealt out by hash. For every key of the corpus membership is therefore exact, and judging a url needs
neither join nor shuffle: a few array reads inside code generation. More than MAX_LISTED listed keys are dealt by hash to several
cascades, each of which judges the urls of its own keys; pages are then kept by the same hash, so each is still read once.

Edge cases: a null url or one without "://" has empty host and path, and the key ''. Repeated urls get equal verdicts.
An empty table gives an empty result. Columns beside the url are kept, those named like new ones are replaced.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce
from math import ceil, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.llm.common import lower_ascii, saved

#: verdict, host, path prefix
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
MAX_LISTED = 1 << 22
"""Listed keys of one cascade, about; it is sent to all executors with some 12 bits for each of them, 6 MB at most."""
FEW = 64
"""Keys that are kept as they are rather than encoded in one more level."""


def split_url(url: Column) -> tuple[Column, Column]:
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    part = lambda n: F.coalesce(F.regexp_extract(url, pattern, n), F.lit(""))
    return lower_ascii(part(1)), part(2)


def url_key(host: Column, path: Column) -> Column:
    """The part of a site that lists name: host and first path segment."""
    return F.concat(host, F.regexp_extract(path, "^/[^/]*/?", 0))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """Rule string and verdict of the longest rule that fits (ties: longer host, then block), else null."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), len(r[1]), r[0])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


class Cascade:
    """levels: (words as an array column of 64-bit longs, bits, hashes) in turn; rest: what one more level would encode, as an array column of lists by hash, and their count."""

    def __init__(self, levels: list[tuple[Column, int, int]], rest: tuple[Column, int] | None = None):
        self.levels, self.rest = levels, rest

    @staticmethod
    def positions(key: Column, level: int, bits: int, hashes: int) -> list[Column]:
        return [F.pmod(F.xxhash64(F.lit(level * 64 + j), key), F.lit(bits)) for j in range(hashes)]

    @classmethod
    def hit(cls, key: Column, level: int, words: Column, bits: int, hashes: int) -> Column:
        tests = [F.getbit(F.get(words, F.shiftright(p, 6).cast("int")), p.bitwiseAND(63).cast("int")) == 1 for p in cls.positions(key, level, bits, hashes)]
        out = tests[0]
        for t in tests[1:]:
            out = out & t
        return out

    def contains(self, key: Column) -> Column:
        """True for listed keys of the universe that the cascade was built for."""
        out = F.lit(len(self.levels) % 2 == 1)
        if self.rest:
            lists, n = self.rest
            out = out != F.coalesce(F.array_contains(F.get(lists, F.pmod(F.xxhash64(key), F.lit(n)).cast("int")), key), F.lit(False))
        for level in range(len(self.levels) - 1, -1, -1):
            out = F.when(self.hit(key, level, *self.levels[level]), out).otherwise(F.lit(level % 2 == 1))
        return out

    @classmethod
    def build(cls, universe: DataFrame, max_levels: int = 24) -> Cascade:
        """universe: distinct keys, (key, listed). The first level has 1 false positive in 50 or fewer, later ones 1 in 2."""
        spark, levels = universe.sparkSession, []
        encode, others = universe.where("listed").select("key"), universe.where("not listed").select("key")
        n = encode.count()
        while n and len(levels) < max_levels and (n > FEW or not levels):
            level, rate = len(levels), 0.02 if not levels else 0.5
            hashes = max(1, round(-log(rate) / log(2)))
            bits = 64 * ceil(max(64, n * hashes / log(2)) / 64)
            at = encode.select(F.explode(F.array(*cls.positions(F.col("key"), level, bits, hashes))).alias("p"))
            made = at.groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("v"))
            words = [0] * (bits // 64)
            for row in made.toLocalIterator():  # at most MAX_LISTED keys' bits
                words[row.w] = row.v
            column = spark.createDataFrame([(words,)], "words array<bigint>").scalar()
            levels.append((column, bits, hashes))
            encode, others = others.where(cls.hit(F.col("key"), level, column, bits, hashes)), encode
            n = encode.count()
        if not n:
            return cls(levels)
        lists: list[list[str]] = [[] for _ in range(n)]
        for row in encode.select("key", F.pmod(F.xxhash64("key"), F.lit(n)).cast("int").alias("at")).toLocalIterator():  # halved by every second level
            lists[row.at].append(row.key)
        return cls(levels, (spark.createDataFrame([(lists,)], "lists array<array<string>>").scalar(), n))


def judge_urls(pages: DataFrame, universe: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, url: str = "url", max_listed: int = MAX_LISTED) -> DataFrame:
    """pages with host, path, rule and verdict. universe: (key, listed), each key of the pages once."""
    host, path = split_url(F.col(url))
    out = pages.withColumns({"host": host, "path": path})
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    universe = saved(universe.select("key", "listed"), "url-keys")
    key = url_key(F.col("host"), F.col("path"))
    shards = max(1, ceil(universe.where("listed").count() / max_listed))

    def judged(some: DataFrame, keys: DataFrame) -> DataFrame:
        listed = Cascade.build(keys).contains(key)
        return some.withColumns({"rule": name, "verdict": F.coalesce(verdict, F.when(listed, F.lit("block")).otherwise(F.lit("allow")))})

    if shards == 1:
        return judged(out, universe)
    at, of = f"shard_{uuid.uuid4().hex}", lambda k: F.pmod(F.xxhash64(F.lit(99), k), F.lit(shards)).cast("int")
    dealt = saved(out.withColumn(at, of(key)), "url-pages", at)
    parts = [judged(dealt.where(F.col(at) == i), universe.where(of(F.col("key")) == i)).drop(at) for i in range(shards)]
    return reduce(DataFrame.unionByName, parts)


def tracking_keys(pages: DataFrame, url: str = "url", share: float = 0.15) -> DataFrame:
    """All keys of the corpus; listed are those of which at least this share of urls carries tracking parameters."""
    host, path = split_url(F.col(url))
    tracked = F.coalesce(F.col(url).contains("utm_"), F.lit(False)).cast("long")
    return pages.groupBy(url_key(host, path).alias("key")).agg((F.sum(tracked) >= F.lit(share) * F.count(F.lit(1))).alias("listed"))
