"""URL rules with a Bloom filter cascade behind them, in DataFrame functions only.

The cascade answers "is this host listed?" exactly for every host of the corpus and needs
no join: level 1 encodes the listed hosts, level 2 the unlisted hosts of the corpus that
level 1 takes wrongly, level 3 the listed ones that level 2 takes wrongly, and so on until
a level errs on none. The levels are bit arrays held as constants of the plan; their
size follows the list (LEVEL_BITS a key). Hosts are split by a hash to as many segments as keep
a level below MAX_WORDS, each with a cascade of its own, so a list of any length is answered in the same way.

Defined cases: null url or one without "://" has an empty host and path, fits no rule
and is listed only if "" is; hosts compare with A-Z lower-cased; repeated rows get
equal results; an empty table or list works (nothing listed, all allowed); input columns
named like an output column are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, table, with_columns

#: (verdict, host, path), as the contract states them.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: Bits and hash functions a key of the first level and of later ones.
LEVEL_BITS, LEVEL_HASHES = (10, 2), (5, 1)
#: Words of 64 bits of a level of one segment; levels.
MAX_WORDS, MAX_LEVELS = 1 << 17, 64


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, URL, 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def _bits(key: Column, level: int, n_bits: int, n_hashes: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(level), F.lit(i)), F.lit(n_bits).cast("long")) for i in range(n_hashes)]


class Cascade:
    """Alternating Bloom filters: exact over the universe they were built from."""

    def __init__(self):
        self.levels: list[tuple[int, int, list[tuple[int, int]]]] = []

    def _holds(self, key: Column, level: int) -> Column:
        n_bits, n_hashes, rows = self.levels[level]
        dense = [0] * (n_bits // 64)
        for word, bits in rows:
            dense[word] = bits
        array = F.split(F.lit(",".join(map(str, dense))), ",").cast("array<bigint>")  # folded to one constant
        out = F.lit(True)
        for at in _bits(key, level, n_bits, n_hashes):
            word = F.get(array, F.floor(at / 64).cast("int"))
            out = out & (F.call_function("shiftright", word, (at % 64).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1)
        return out

    def listed(self, key: Column) -> Column:
        """The first level that does not hold the key decides; the last holds no wrong one."""
        out = F.lit(len(self.levels) % 2 == 1)
        for level in reversed(range(len(self.levels))):
            out = F.when(~self._holds(key, level), F.lit(level % 2 == 1)).otherwise(out)
        return out

    @classmethod
    def build(cls, universe: DataFrame) -> Cascade:
        """universe: distinct (key, listed).

        A level's bits come to the driver as 64-bit words, merged by the executors; the count
        of its keys is known, so its size is, before anything is gathered.
        """
        out = cls()
        inside, outside = universe.filter("listed").select("key"), universe.filter("NOT listed").select("key")
        for level in range(MAX_LEVELS):
            n = inside.count()
            if not n:
                return out
            bits, hashes = LEVEL_BITS[min(level, 1)], LEVEL_HASHES[min(level, 1)]
            n_words = -(-max(n * bits, 64) // 64)
            at = inside.select(F.explode(F.array(*_bits(F.col("key"), level, n_words * 64, hashes))).alias("at"))
            one = F.expr("shiftleft(1L, cast(at % 64 AS int))")
            rows = at.groupBy(F.floor(F.col("at") / 64).cast("int").alias("word")).agg(F.bit_or(one).alias("bits")).collect()
            out.levels.append((n_words * 64, hashes, [(r["word"], r["bits"]) for r in rows]))
            wrong = table(outside.filter(out._holds(F.col("key"), level)), f"cascade-{level}")
            inside, outside = wrong, inside
        raise RuntimeError("the cascade did not end")


class Segments:
    """Cascades of the segments of a universe."""

    def __init__(self, universe: DataFrame, max_words: int = MAX_WORDS):
        n = universe.filter("listed").count()
        self.n = max(1, -(-n * LEVEL_BITS[0] // (64 * max_words)))
        own = self._segment(F.col("key"))
        self.cascades = [Cascade.build(universe.filter(own == i)) for i in range(self.n)]

    def _segment(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key, F.lit("segment")), F.lit(self.n))

    def listed(self, key: Column) -> Column:
        out = self.cascades[0].listed(key)
        for i in range(1, self.n):
            out = F.when(self._segment(key) == i, self.cascades[i].listed(key)).otherwise(out)
        return out


def judge(pages: DataFrame, listed: DataFrame, url: str = "url", rules: Sequence[tuple[str, str, str]] = RULES, max_words: int = MAX_WORDS) -> DataFrame:
    """pages with host, path, rule and verdict. listed: a column ``key`` of listed hosts.

    A rule fits its host and all subdomains where the path starts with the rule's path; the
    longest wins. Where none fits, listed hosts are blocked and others allowed.
    """
    hosts = pages.select(host_of(F.col(f"`{url}`")).alias("key")).withColumn("listed", F.lit(False))
    both = hosts.unionByName(listed.select(F.col("key"), F.lit(True).alias("listed")).filter("key IS NOT NULL"))
    universe = table(both.groupBy("key").agg(F.max("listed").alias("listed")), "url-universe")
    host, path = F.col("__host"), F.col("__path")
    out = pages.withColumns({"__host": host_of(F.col(f"`{url}`")), "__path": path_of(F.col(f"`{url}`"))})
    hit = Segments(universe, max_words).listed(host)
    rule, verdict = F.lit(None).cast("string"), F.when(hit, "block").otherwise("allow")
    for kind, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return with_columns(out, {"host": host, "path": path, "rule": rule, "verdict": verdict}).drop("__host", "__path")


def stand_in_list(pages: DataFrame) -> DataFrame:
    """The query's list, in place of one from outside: the hosts whose md5 starts with 0 to 3."""
    hosts = pages.select(host_of(F.col("url")).alias("key")).filter("key <> ''").distinct()
    return hosts.filter(F.substring(F.md5("key"), 1, 1).isin("0", "1", "2", "3"))


def op8_url_filter(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages, stand_in_list(pages)).select("page_id", "host", "path", "rule", "verdict")


SQL = r"""
WITH cut AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
ruled AS (SELECT *, CASE
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule FROM cut)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN host <> '' AND substr(md5(host), 1, 1) IN ('0', '1', '2', '3') THEN 'block' ELSE 'allow' END AS verdict FROM ruled
"""
