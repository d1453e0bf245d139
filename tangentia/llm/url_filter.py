"""URL rules and block lists by Bloom filter cascades, in DataFrame functions only.

Level 0 encodes the listed keys; level 1 the other keys of the corpus that pass level 0;
level 2 the listed keys that pass level 1; and so on, until a level lets nothing false
through. For the keys of that corpus, membership is then exact, without a join: a key
belongs to the side of the last level that it passed. Level 0 is so sized that about as
many false keys pass as are listed, which bounds all levels by the list's size times the
logarithm of the universe's.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tangentia.llm.runtime import saved

#: Fixed values: (verdict, host, path) rules of the contract.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Hosts that are blocked, with their subdomains, where no rule fits.
BLOCKED = tuple(f"{name}.example.{top}" for name in ("adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm") for top in ("com", "net", "org"))


@dataclass(frozen=True)
class Level:
    bits: tuple[int, ...]  #: words of 64 bits
    size: int  #: bits
    hashes: int
    seed: int

    def holds(self, key: Column) -> Column:
        """Whether the key's bits are all set."""
        words = F.array(*[F.lit(x) for x in self.bits])
        h1, h2 = F.xxhash64(key, F.lit(2 * self.seed)), F.xxhash64(key, F.lit(2 * self.seed + 1))
        out = F.lit(True)
        for j in range(self.hashes):
            at = _place(h1, h2, j, self.size)
            word = F.element_at(words, (F.floor(at / 64) + 1).cast("int"))
            out &= _bit(word, at) == 1
        return out


def _place(h1: Column, h2: Column, j: int, size: int) -> Column:
    return (F.pmod(h1, F.lit(size)) + F.lit(j) * F.pmod(h2, F.lit(size))) % size


def _bit(word: Column, at: Column) -> Column:
    return F.call_function("shiftrightunsigned", word, (at % 64).cast("int")).bitwiseAND(F.lit(1))


def _encoded(keys: DataFrame, n: int, rate: float, seed: int) -> Level:
    """A Bloom filter of the n keys; only its words come to the driver."""
    size = 64 * max(1, math.ceil(n * math.log2(1 / rate) * 1.4427 / 64))
    hashes = max(1, round(math.log2(1 / rate)))
    h1, h2 = F.xxhash64("key", F.lit(2 * seed)), F.xxhash64("key", F.lit(2 * seed + 1))
    at = F.explode(F.array(*[_place(h1, h2, j, size) for j in range(hashes)]))
    words = keys.select(at.alias("at")).groupBy(F.floor(F.col("at") / 64).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("at") % 64).cast("int"))).alias("bits"))
    got = {r["word"]: r["bits"] for r in words.collect()}
    return Level(tuple(got.get(i, 0) for i in range(size // 64)), size, hashes, seed)


@dataclass(frozen=True)
class Cascade:
    levels: tuple[Level, ...]

    def contains(self, key: Column) -> Column:
        """Exact for the keys of the universe that the cascade was built over."""
        out = F.lit(len(self.levels) % 2 == 1)
        for i in range(len(self.levels) - 1, -1, -1):
            out = F.when(self.levels[i].holds(key), out).otherwise(F.lit(i % 2 == 1))
        return out


def build_cascade(universe: DataFrame, listed: Sequence[str], first_seed: int = 1) -> Cascade:
    """universe: distinct non-null `key`s. An empty list gives a cascade that holds nothing."""
    listed = sorted(set(listed))
    if not listed:
        return Cascade(())
    spark = universe.sparkSession
    own = spark.range(1, numPartitions=1).select(F.explode(F.array(*[F.lit(x) for x in listed])).alias("key"))
    others = universe.filter(~F.col("key").isin(*listed))
    rate = min(0.5, len(listed) / max(1, others.count()))
    sides, levels, n = [own, others], [], len(listed)
    while n:
        at = len(levels)
        levels.append(level := _encoded(sides[at % 2], n, rate if at == 0 else 0.5, first_seed + at))
        sides[(at + 1) % 2] = sides[(at + 1) % 2].filter(level.holds(F.col("key")))
        n = sides[(at + 1) % 2].count()
    return Cascade(tuple(levels))


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): after the first ://, A-Z lower-cased, up to / ? #; then up to ? #. Both empty for null or without ://."""
    pattern = "(?s)^.*?://([^/?#]*)([^?#]*)"
    text = F.coalesce(url, F.lit(""))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.regexp_extract(text, pattern, 1), upper, upper.lower()), F.regexp_extract(text, pattern, 2)


def _keys(host: Column, path: Column, listed: Sequence[tuple[str, str]]) -> Column:
    """The keys of a URL that could be listed: its last labels before each path start of a listed length."""
    labels = range(1, max((h.count(".") + 1 for h, _ in listed), default=0) + 1)
    starts = sorted({len(p) for _, p in listed})
    ends = F.array_distinct(F.array(*[F.substring_index(host, ".", -n) for n in labels]))
    heads = F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in starts])
    return F.flatten(F.transform(ends, lambda e: F.transform(F.filter(heads, lambda h: h.isNotNull()), lambda h: F.concat(e, h))))


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, blocked: Sequence[str] = BLOCKED, url_col: str = "url") -> DataFrame:
    """The rows of pages with `host`, `path`, `rule` and `verdict`; columns of these names are replaced.

    A rule fits its host and all subdomains where the path starts with its own; the longest
    (host and path together; of equal ones the first by name) decides. Without one, `rule`
    is null, and a host on the block list, or below one, is blocked; all else is allowed.
    A null URL, or one without ://, has an empty host and path and is allowed. Rows stay as
    they are. The keys of all rows are counted once (a shuffle of distinct keys alone); the
    verdict itself is a projection.
    """
    pairs = [(h, p) for _, h, p in rules]
    if any(not p.startswith("/") or not h for h, p in pairs) or len(set(pairs)) != len(pairs):
        raise ValueError("each rule has a host and a path that starts with /, and stands once")
    host, path = url_parts(pages[url_col])
    of_rules, of_hosts = _keys(F.col("host"), F.col("path"), pairs), _keys(F.col("host"), F.lit(""), [(h, "") for h in blocked])
    parts = pages.select(host.alias("host"), path.alias("path")).distinct()
    universe = saved(parts.select(F.explode(F.concat(of_rules, of_hosts)).alias("key")).distinct())
    ruled = build_cascade(universe, [h + p for h, p in pairs], 1)
    stopped = build_cascade(universe, [h + p for v, h, p in rules if v == "block"] + list(blocked), 101)
    found = F.array_sort(
        F.filter(of_rules, ruled.contains),
        lambda a, b: F.when(F.length(a) > F.length(b), -1).when(F.length(a) < F.length(b), 1).when(a < b, -1).when(a > b, 1).otherwise(0),
    )
    out = pages.withColumns({"host": host, "path": path})
    out = out.withColumn("rule", F.get(found, 0))
    bad = F.when(F.col("rule").isNotNull(), stopped.contains(F.col("rule"))).otherwise(F.exists(of_hosts, stopped.contains))
    return out.withColumn("verdict", F.when(bad, "block").otherwise("allow"))
