"""URL filters by a cascade of Bloom filters, in DataFrame operations only.

A rule is a host with its subdomains and a beginning of the path. The keys of an address are its host suffixes, each
with the beginnings of its path that are as long as a rule's. Level 1 of a cascade holds the listed keys; level 2 the
keys of the corpus that level 1 takes for listed; level 3 the listed keys that level 2 takes for such errors; and so
on until a level makes no error. As the levels are built from every key of the corpus, membership is exact for
all of them, and a page is judged by bit tests alone: the judging plan has no join and no shuffle.

Level 1 has so many bits that its errors are fewer than the listed keys, so the size of a cascade follows the list and
not the corpus. The list is a parameter of at most `MAX_KEYS` keys.

Defined results: a null address or one without ``://`` has an empty host and path, fits no rule and is allowed;
repeated rows are judged alike; an empty table gives no rows; other columns are never read. Without rules everything is
allowed. Of rules of equal length the later in text order wins.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from karyospark.llm import common

# Verdict and rule, as host and path.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
MAX_KEYS = 1_000_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), path


def candidate_keys(host: Column, path: Column, lengths: list[int]) -> Column:
    """Every host suffix with each beginning of the path of one of the given lengths, if the path is so long."""
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    heads = F.filter(F.array(*(F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths)), lambda p: p.isNotNull())
    return F.flatten(F.transform(suffixes, lambda s: F.transform(heads, lambda p: F.concat(s, p))))


@dataclass(frozen=True)
class Level:
    """A Bloom filter: its bits in 32-bit words, most significant byte first, and how many hashes it takes."""

    number: int
    bits: int
    hashes: int
    words: bytes

    def places(self, key: Column) -> list[Column]:
        return _places(key, self.number, self.bits, self.hashes)

    def holds(self, key: Column) -> Column:
        def bit(place: Column) -> Column:
            word = F.substring(F.lit(bytearray(self.words)), (4 * F.floor(place / 32) + 1).cast("int"), F.lit(4))
            return F.getbit(F.conv(F.hex(word), 16, 10).cast("long"), F.pmod(place, F.lit(32)).cast("int")) == 1

        out = F.lit(True)
        for place in self.places(key):
            out = out & bit(place)
        return out


def _places(key: Column, number: int, bits: int, hashes: int) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(number), F.lit(j), key), F.lit(bits)) for j in range(hashes)]


def _level(keys: DataFrame, number: int, count: int, rate: float) -> Level:
    """The filter of ``keys``; its words are put together in the cluster, a row per word that has a bit."""
    bits = max(64, 32 * math.ceil(count * 1.44 * math.log2(1 / rate) / 32))
    hashes = max(1, round(math.log2(1 / rate)))
    set_bits = keys.select(F.explode(F.array(*_places(F.col("key"), number, bits, hashes))).alias("place"))
    rows = set_bits.groupBy(F.floor(F.col("place") / 32).alias("word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("place", F.lit(32)).cast("int"))).alias("bits")).collect()
    words = bytearray(bits // 8)
    for r in rows:
        words[4 * r.word: 4 * r.word + 4] = int(r.bits).to_bytes(4, "big")
    return Level(number, bits, hashes, bytes(words))


@dataclass(frozen=True)
class Cascade:
    levels: tuple[Level, ...]

    def holds(self, key: Column) -> Column:
        """Exact for every key of the corpus the cascade was built for."""
        out = F.lit(len(self.levels) % 2 == 1)
        for level in reversed(self.levels):
            inside = level.number % 2 == 0  # what a key is that an even level doesn't hold
            out = F.when(level.holds(key), out).otherwise(F.lit(inside))
        return out


def build(spark: SparkSession, listed: list[str], universe: DataFrame, size: int) -> Cascade:
    """A cascade for the ``listed`` keys over ``universe`` (key), which has ``size`` distinct keys."""
    listed = sorted(set(listed))
    if len(listed) > MAX_KEYS:
        raise ValueError(f"a list of {len(listed)} keys; a cascade takes at most {MAX_KEYS}")
    if not listed:
        return Cascade(())
    inside = spark.range(1).select(F.explode(F.array(*map(F.lit, listed))).alias("key"))
    outside = universe.join(F.broadcast(inside), "key", "left_anti")
    levels, count = [], len(listed)
    rate = min(0.5, count * math.sqrt(0.5) / max(1, size))
    while count:
        encoded, other = (outside, inside) if len(levels) % 2 else (inside, outside)
        levels.append(_level(encoded, len(levels) + 1, count, rate))
        errors = other.where(levels[-1].holds(F.col("key")))
        count, rate = errors.count(), 0.5
        if len(levels) % 2:
            outside = errors
        else:
            inside = errors
    return Cascade(tuple(levels))


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict of every page. The keys' lists are cascades; the longest listed key wins."""
    spark = pages.sparkSession
    lengths = sorted({len(rule) - rule.index("/") for _, rule in rules})
    host, path = host_and_path(F.col("url"))
    split = pages.select("page_id", host.alias("host"), path.alias("path"))
    keyed = split.select("page_id", "host", "path", candidate_keys(F.col("host"), F.col("path"), lengths).alias("keys"))
    universe = common.written(keyed.select(F.explode("keys").alias("key")).distinct(), "url-keys")
    size = universe.count()
    lists = {v: build(spark, [r for verdict, r in rules if verdict == v], universe, size) for v in ("block", "allow")}

    def verdict(key: Column) -> Column:
        return F.when(lists["block"].holds(key), "block").when(lists["allow"].holds(key), "allow")

    tested = F.transform("keys", lambda k: F.struct(F.length(k).alias("n"), k.alias("key"), verdict(k).alias("verdict")))
    best = F.array_max(F.filter(tested, lambda k: k["verdict"].isNotNull()))
    return keyed.select("page_id", "host", "path", best.alias("best")).select(
        "page_id", "host", "path", F.col("best.key").alias("rule"), F.coalesce("best.verdict", F.lit("allow")).alias("verdict"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(common.table(spark, sf_dir, "pages"))


ORACLE_SQL = r"""
WITH parts AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
rules AS (
  SELECT * FROM (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'),
                        ('allow', 'org', '/fr/')) AS v(verdict, rule_host, rule_path)),
fits AS (
  SELECT s.page_id, s.host, s.path, r.rule_host || r.rule_path AS rule, r.verdict,
         row_number() OVER (PARTITION BY s.page_id ORDER BY length(r.rule_host || r.rule_path) DESC NULLS LAST) AS n
  FROM split s LEFT JOIN rules r
    ON (s.host = r.rule_host OR ends_with(s.host, '.' || r.rule_host)) AND starts_with(s.path, r.rule_path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM fits WHERE n = 1
"""
