"""URL filters by a cascade of Bloom filters, in DataFrame operations only.

The key universe is every host of the corpus and every parent domain of it. Level 1 is a Bloom filter of the listed keys;
level 2 one of the unlisted keys of the universe that pass level 1; level 3 one of the listed keys that pass level 2; and so
on until nothing passes wrongly. Of the universe, a key is listed if and only if the first level that it fails is an even one,
or the cascade ends after an odd one: exact membership with a few bits a key and no join over the corpus.

Filters are arrays of 64-bit words in the plan: a level has BITS_A_KEY bits a key. MAX_LISTED is the proven bound on what is sent to
all tasks (1 MB for level 1); a longer list is joined with the distinct hosts instead, which gives the same verdicts by another way.

Null urls and urls without :// have an empty host and path, and no key: no rule fits, and the verdict is allow. Equal urls get
equal verdicts. Other columns pass through untouched only where the caller keeps them. An empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cliquora.llm.common import let

#: (host, path, verdict): a rule fits the host and its subdomains where the url's path starts with the rule's.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
BITS_A_KEY, PROBES, MAX_LISTED, MAX_LEVELS = 8, 4, 1_000_000, 40
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits (null if none) and its verdict."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r[0])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def keys_of(host: Column) -> Column:
    """The host and its parent domains; an empty host has none."""
    parts = F.split(host, r"\.")
    chain = let(parts, lambda p: F.transform(F.sequence(F.lit(1), F.size(p)), lambda i: F.array_join(F.slice(p, i, F.size(p)), ".")))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(chain)


def bit(key: Column, level: int, probe: int, bits: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(level), F.lit(probe)), F.lit(bits).cast("long"))


class Filter:
    """A Bloom filter of the keys (a column `key`), of which there are n."""

    def __init__(self, keys: DataFrame, n: int, level: int):
        self.level, self.bits = level, 64 * max(1, math.ceil(n * BITS_A_KEY / 64))
        at = keys.select(F.explode(F.array(*[bit(F.col("key"), level, i, self.bits) for i in range(PROBES)])).alias("at"))
        words = at.groupBy(F.floor(F.col("at") / 64).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("value"))
        self.words = [0] * (self.bits // 64)
        for r in words.collect():  # at most bits / 64 rows, by MAX_LISTED
            self.words[r.word] = r.value

    def passes(self, key: Column) -> Column:
        # one literal, whatever its length
        words = F.from_json(F.lit("[" + ",".join(map(str, self.words)) + "]"), "array<bigint>")
        hits = []
        for i in range(PROBES):
            at = bit(key, self.level, i, self.bits)
            value = F.element_at(words, (F.floor(at / 64) + 1).cast("int"))
            hits.append(F.getbit(value, (at % 64).cast("int")) == 1)
        return hits[0] & hits[1] & hits[2] & hits[3]


class Cascade:
    """Exact membership of the universe's keys in the list."""

    def __init__(self, universe: DataFrame, listed: DataFrame):
        """universe, listed: a column `key` each."""
        inside = universe.join(F.broadcast(listed.distinct()), "key", "left_semi").distinct().persist()
        self.levels: list[Filter] = []
        try:
            self.build(universe, inside)
        finally:
            inside.unpersist()

    def build(self, universe: DataFrame, inside: DataFrame) -> None:
        n = inside.count()
        if n == 0:
            return
        self.levels.append(Filter(inside, n, 1))
        # what passes level 1 wrongly is few: all further levels work on it and on the list
        outside = universe.where(self.levels[0].passes(F.col("key"))).distinct().join(F.broadcast(inside), "key", "left_anti").persist()
        sides = [outside, inside]
        try:
            for level in range(2, MAX_LEVELS):
                wrong = sides[level % 2].where(self.levels[-1].passes(F.col("key"))) if level > 2 else outside
                n = wrong.count()
                if n == 0:
                    return
                self.levels.append(Filter(wrong, n, level))
                sides[level % 2] = wrong
        finally:
            outside.unpersist()
        raise ValueError("the cascade does not end")

    def has(self, key: Column) -> Column:
        """Walks the levels: failing an even level, or none of an odd number, means listed."""
        out = F.lit(len(self.levels) % 2 == 1)
        for f in reversed(self.levels):
            out = F.when(~f.passes(key), F.lit(f.level % 2 == 0)).otherwise(out)
        return out


def hyphenated(pages: DataFrame) -> DataFrame:
    """A list of keys drawn from the corpus by a rule: every host and parent domain whose own (first) label has a hyphen."""
    host, _ = host_and_path(F.col("url"))
    keys = pages.select(host.alias("host")).distinct().select(F.explode(keys_of(F.col("host"))).alias("key")).distinct()
    return keys.where(F.substring_index("key", ".", 1).contains("-"))


def filter_urls(pages: DataFrame, listed: DataFrame, keys=("page_id",), rules=RULES) -> DataFrame:
    """The keys, host, path, rule, verdict (allow or block), listed (boolean: the host or a parent of it is listed)."""
    host, path = host_and_path(F.col("url"))
    rows = pages.select(*keys, host.alias("host"), path.alias("path"))
    listed = listed.select("key").where("key is not null").distinct()
    if listed.limit(MAX_LISTED + 1).count() <= MAX_LISTED:
        universe = rows.select("host").distinct().select(F.explode(keys_of(F.col("host"))).alias("key")).distinct()
        cascade = Cascade(universe, listed)
        rows = rows.withColumn("listed", F.exists(keys_of(F.col("host")), cascade.has))
    else:
        hosts = rows.select("host").distinct().select("host", F.explode(keys_of(F.col("host"))).alias("key"))
        hits = hosts.join(listed, "key", "left_semi").select("host").distinct().withColumn("listed", F.lit(True))
        rows = rows.join(hits, "host", "left").withColumn("listed", F.coalesce("listed", F.lit(False)))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "by_rule": verdict})
    verdict = F.coalesce("by_rule", F.when(F.col("listed"), "block").otherwise("allow"))
    return rows.select(*keys, "host", "path", "rule", verdict.alias("verdict"), "listed")


ORACLE = r"""
with rest as (
  select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
parts as (
  select page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) as path
  from rest),
ruled as (
  select *,
    case when (host = 'www.example.com' or host like '%.www.example.com') and starts_with(path, '/en/') then 'www.example.com/en/'
         when (host = 'example.com' or host like '%.example.com') and starts_with(path, '/en/') then 'example.com/en/'
         when (host = 'net' or host like '%.net') and starts_with(path, '/es/') then 'net/es/'
         when (host = 'net' or host like '%.net') and starts_with(path, '/fr/') then 'net/fr/'
         when (host = 'com' or host like '%.com') and starts_with(path, '/') then 'com/' end as rule,
    contains(host, '-') as listed
  from parts)
select page_id, host, path, rule,
  case when rule in ('com/', 'www.example.com/en/') then 'allow' when rule is not null then 'block' when listed then 'block' else 'allow' end as verdict, listed
from ruled
"""
