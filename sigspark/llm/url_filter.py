"""Url rules by a Bloom filter cascade, with DataFrame functions only.

Level 1 encodes the listed keys. Level 2 encodes those of the other keys of the universe that level 1 takes for
listed; level 3 those listed keys that level 2 takes for others; and so on until a level errs on none. A key's
number of levels passed, odd or even, then tells exactly whether it is listed, for every key of the universe, without
a join. The universe is complete: all (host suffix, path prefix) keys that the corpus's urls ask for. Only those of them
that pass level 1 are ever gathered, so a universe of any size is one scan and no shuffle of its own.

The first level's size follows from the listed keys and the ratio of others to them, so later levels hold fewer
keys than are listed: all levels together stay a few bytes a listed key, whatever the corpus. A filter stands in the plan
as one constant array of 64-bit words; its size is checked.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lowered; empty where there is no ://."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s).*?://([^/?#]*)", 1)
    return F.translate(found, UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s).*?://[^/?#]*([^?#]*)", 1)


#: Most bytes of one filter.
MOST_BYTES = 64 << 20
#: Rate of false positives of the later levels: fewer levels, and so fewer passes, than at a half, for some bits a key more.
LATER = 1 / 16


def _positions(key: Column, level: int, bits: int, hashes: int) -> Column:
    a = F.pmod(F.xxhash64(F.lit(2 * level), key), F.lit(bits).cast("long"))
    b = F.pmod(F.xxhash64(F.lit(2 * level + 1), key), F.lit(bits - 1).cast("long")) + 1
    return F.array(*(F.pmod(a + F.lit(i) * b, F.lit(bits).cast("long")) for i in range(hashes)))


class Level:
    """A Bloom filter as 64-bit words."""

    def __init__(self, level: int, bits: int, hashes: int, words: list[int]):
        self.level, self.bits, self.hashes = level, bits, hashes
        # One constant once the plan is optimised, however many words there are.
        self.words = F.split(F.lit(",".join(map(str, words))), ",").cast("array<long>")

    @classmethod
    def build(cls, keys: DataFrame, level: int, n: int, rate: float) -> Level:
        """keys: one column key, n rows; rate: chance of a false positive."""
        bits = max(64, math.ceil(n * -math.log(rate) / math.log(2) ** 2))
        if bits > 8 * MOST_BYTES:
            raise ValueError(f"{n} keys need a filter of {bits // 8} bytes, over {MOST_BYTES}")
        hashes = max(1, round(-math.log(rate) / math.log(2)))
        at = keys.select(F.explode(_positions(F.col("key"), level, bits, hashes)).alias("at"))
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("at", F.lit(64)).cast("int"))
        words = at.groupBy(F.floor(F.col("at") / 64).alias("w")).agg(F.bit_or(bit).alias("bits")).toPandas()  # no more rows than words
        filled = np.zeros(-(-bits // 64), np.int64)
        filled[words["w"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
        return cls(level, bits, hashes, filled.tolist())

    def might_contain(self, key: Column) -> Column:
        bit = lambda p: F.call_function("shiftright", F.get(self.words, F.floor(p / 64).cast("int")), F.pmod(p, F.lit(64)).cast("int")).bitwiseAND(F.lit(1))
        return F.forall(_positions(key, self.level, self.bits, self.hashes), lambda p: bit(p) == 1)


class Cascade:
    """Exact membership of keys of a universe in a listed set."""

    def __init__(self, levels: list[Level]):
        self.levels = levels

    @classmethod
    def build(cls, listed: DataFrame, universe: DataFrame, scratch: Scratch, name: str, asked: int | None = None, most: int = 40) -> Cascade:
        """listed, universe: one column key; listed keys are distinct, those of the universe may repeat. asked: about how many
        the universe has, counted where it isn't given; only the filters' sizes depend on it."""
        inside = listed
        n = inside.count()
        if asked is None:
            asked = universe.agg(F.approx_count_distinct("key")).first()[0]
        rate = min(LATER, max(1e-9, n / math.sqrt(2) / max(1, asked)))
        levels = [Level.build(inside, 0, n, rate)] if n else []
        if levels:
            # From here on only keys of the universe that pass level 1 count, listed or not.
            passed = scratch.save(universe.where(levels[0].might_contain(F.col("key"))).distinct(), f"{name}-passed")
            others = scratch.save(passed.join(listed.hint("merge"), "key", "left_semi"), f"{name}-0")
            inside = scratch.save(passed.join(listed.hint("merge"), "key", "left_anti"), f"{name}-1")
            n = inside.count()
        while n:
            if len(levels) == most:
                raise RuntimeError("the cascade did not settle")
            level = Level.build(inside, len(levels), n, LATER)
            levels.append(level)
            wrong = scratch.save(others.where(level.might_contain(F.col("key"))), f"{name}-{len(levels)}")
            inside, others, n = wrong, inside, wrong.count()
        scratch.drop(f"{name}-passed", *(f"{name}-{i}" for i in range(len(levels) + 1)))
        return cls(levels)

    def contains(self, key: Column) -> Column:
        """True for a listed key of the universe, false for any other key of it: the first level that lacks the key is
        an even one (counted from 1), or all of an odd number of levels have it."""
        answer = F.lit(len(self.levels) % 2 == 1)
        for i in reversed(range(len(self.levels))):
            answer = F.when(self.levels[i].might_contain(key), answer).otherwise(F.lit(i % 2 == 1))
        return answer


def candidate_keys(host: Column, path: Column, lengths: list[int]) -> Column:
    """Keys a url's rule can have, longest first: every host suffix at a dot with path prefixes of the rules' lengths."""
    labels = F.split(host, r"\.", -1)
    suffixes = F.when(host != "", F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).otherwise(F.array().cast("array<string>"))
    fit = [F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in sorted(lengths, reverse=True)]
    paths = F.filter(F.array(*fit), lambda p: p.isNotNull())
    keys = F.flatten(F.transform(suffixes, lambda s: F.transform(paths, lambda p: F.concat(s, p))))
    return F.transform(F.array_sort(F.transform(keys, lambda k: F.struct((-F.length(k)).alias("n"), k.alias("key")))), lambda x: x["key"])


def url_verdicts(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule and verdict of each row of pages(page_id, url). rules: (host, path, verdict), distinct
    by host and path.

    A rule fits its host and all subdomains where the path starts with the rule's; the longest (host and path together)
    wins. Without a fitting rule the rule is null and the verdict is default: no listed key is a member. A null url, one
    without :// and one without a host ask for no key. Repeated rows are judged alike; an empty table, or no rules, needs
    no level. A very long url asks for no more keys than its host has labels times the rules' path lengths. Other columns
    are not looked at.
    """
    scratch = Scratch(pages.sparkSession, "urls")
    asked = pages.select("page_id", F.col("url").cast("string").alias("url")).select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rules = scratch.save(rules.select(F.concat("host", "path").alias("key"), F.length("path").alias("n"), "verdict").distinct(), "rules")
    lengths = [r["n"] for r in rules.select("n").distinct().collect()]  # no more than the longest rule path is long
    if not lengths:
        return asked.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    keys = candidate_keys(F.col("host"), F.col("path"), lengths)
    universe = asked.select(F.explode(keys).alias("key"))
    n = universe.agg(F.approx_count_distinct("key")).first()[0]
    allow, block = (Cascade.build(rules.where(F.col("verdict") == v).select("key").distinct(), universe, scratch, v, n) for v in ("allow", "block"))
    judge = F.transform(keys, lambda k: F.struct(k.alias("rule"), F.when(allow.contains(k), "allow").when(block.contains(k), "block").alias("verdict")))
    hit = F.get(F.filter(judge, lambda x: x["verdict"].isNotNull()), F.lit(0))
    out = asked.withColumn("hit", hit)
    return out.select("page_id", "host", "path", F.col("hit.rule").alias("rule"), F.coalesce("hit.verdict", F.lit(default)).alias("verdict"))


#: The query's fixed rules: host, path, verdict.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """url_verdicts() of pages by RULES."""
    rows = F.array(*(F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for h, p, v in RULES))
    rules = spark.range(1).select(F.inline(rows))
    return url_verdicts(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules)


ORACLE_OP2 = r"""
WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path, row_number() OVER () AS i FROM pages),
r(rh, rp, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
m AS (SELECT u.*, rh || rp AS rule, v, row_number() OVER (PARTITION BY i ORDER BY length(rh || rp) DESC) AS k
  FROM u LEFT JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM m WHERE k = 1
"""
