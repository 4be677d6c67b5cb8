"""URL rules answered by Bloom filter cascades, in DataFrame operations only.

A rule is a host and a path prefix; it fits the host and its subdomains. A
URL's lookup keys are its host's endings by label, each with its path cut to
each length that rules have. The rules' keys are the listed keys; the lookup
keys of all URLs are the universe. Level 0 of a cascade encodes the listed
keys, level 1 those keys of the universe that level 0 takes wrongly, level 2
the listed keys that level 1 takes wrongly, and so on until no key is wrong:
membership is then exact for every key of the corpus, and no URL is joined to
the rules. A cascade has some 1.5 log2(universe / listed) + 5 bits a listed
key, so its size is bounded by the rules', not by the corpus.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from estate_spark.session import materialise

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MOST_BITS = 1 << 25  # of one level: 4 MB, the bound on what goes to every task
LEVELS = 64


@dataclass(frozen=True)
class Rule:
    action: str  # allow or block
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class Level:
    words: np.ndarray  # bits, 64 in a long
    bits: int
    hashes: int
    seed: int


def host_of(url: Column) -> Column:
    """From after the first ``://`` to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://`` or url."""
    return F.coalesce(F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def lookup_keys(host: Column, path: Column, rules: list[Rule]) -> list[Column]:
    """The keys a URL may be listed under; null where host or path is too short for one."""
    depths = sorted({rule.host.count(".") + 1 for rule in rules})
    lengths = sorted({len(rule.path) for rule in rules})
    return [
        F.when(F.length(path) >= n, F.concat(F.substring_index(host, ".", -depth), F.substring(path, 1, n)))
        for depth in depths
        for n in lengths
    ]


def positions(key: Column, level: Level | None = None, *, bits: int = 0, hashes: int = 0, seed: int = 0) -> list[Column]:
    """The bits of a key, by double hashing with two 31-bit hashes."""
    if level is not None:
        bits, hashes, seed = level.bits, level.hashes, level.seed
    one, two = (F.shiftrightunsigned(F.xxhash64(key, F.lit(2 * seed + k)), 33) for k in range(2))
    return [F.pmod(one + two * F.lit(k), F.lit(bits).cast("long")) for k in range(hashes)]


def build_level(keys: DataFrame, count: int, rate: float, seed: int) -> Level:
    """A filter of all ``keys`` that takes others at about ``rate``."""
    hashes = max(1, round(-math.log2(rate)))
    bits = 64 * max(1, math.ceil(count * -math.log2(rate) / math.log(2) / 64))
    if bits > MOST_BITS:
        raise ValueError(f"{count} listed keys need {bits} bits, more than {MOST_BITS}: split the rules over several calls")
    at = keys.select(F.explode(F.array(*positions(F.col("key"), bits=bits, hashes=hashes, seed=seed))).alias("at"))
    one = F.expr("shiftleft(1L, cast(at % 64 as int))")
    found = at.groupBy(F.expr("at div 64").alias("word")).agg(F.bit_or(one).alias("set")).collect()
    words = np.zeros(bits // 64, np.int64)
    for row in found:
        words[row.word] = row.set
    return Level(words, bits, hashes, seed)


def takes(level: Level, key: Column) -> Column:
    words = F.lit(level.words)
    hit = [F.getbit(F.get(words, F.floor(at / 64).cast("int")), F.pmod(at, F.lit(64)).cast("int")) == 1 for at in positions(key, level)]
    out = hit[0]
    for more in hit[1:]:
        out = out & more
    return out


def member(cascade: list[Level], key: Column) -> Column:
    """Exact for the universe's keys: whether the first level that refuses the key is one of false positives."""
    inside: Column = F.lit(len(cascade) % 2 == 1)
    for number in range(len(cascade) - 1, -1, -1):
        inside = F.when(takes(cascade[number], key), inside).otherwise(F.lit(number % 2 == 1))
    return F.coalesce(inside, F.lit(False))


def build_cascade(spark: SparkSession, listed: list[str], universe: DataFrame) -> list[Level]:
    """Levels for ``listed`` over the distinct, non-null ``key`` of ``universe``."""
    listed = sorted(set(listed))
    if not listed:
        return []
    inside = spark.range(1).select(F.explode(F.array(*map(F.lit, listed))).alias("key"))
    outside = universe.where(~F.col("key").isin(listed)) if len(listed) <= 1000 else universe.join(inside, "key", "left_anti")
    counts = [len(listed), outside.count()]
    sets, cascade = [inside, outside], []
    for number in range(LEVELS):
        mine, other = number % 2, 1 - number % 2
        if not counts[mine]:
            return cascade
        rate = min(0.5, counts[0] / (math.sqrt(2) * max(counts[1], 1))) if number == 0 else 0.5
        cascade.append(build_level(sets[mine], counts[mine], rate, number))
        # from here on only keys that this level takes matter
        sets[other] = sets[other].where(takes(cascade[-1], F.col("key")))
        counts[other] = sets[other].count()
    raise ValueError("keys whose hashes agree at every level cannot be told apart")


def judge(pages: DataFrame, rules: list[Rule], key: str = "page_id", url: str = "url", other: str = "allow") -> DataFrame:
    """Each row's ``key``, ``host``, ``path``, ``rule`` (the longest that fits, else null) and ``verdict``.

    Without a fitting rule the url is not listed and the verdict is ``other``.
    Null urls and urls without ``://`` have empty host and path. Rows with null
    or repeated keys are judged each; an empty table gives an empty result;
    other columns are not read.
    """
    rows = pages.select(F.col(key).alias("k"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    keys = lookup_keys(F.col("host"), F.col("path"), rules)
    found = F.lit(None).cast("struct<size:int,rule:string,verdict:string>")
    if keys:
        universe = rows.select(F.explode(F.array_distinct(F.array(*keys))).alias("key")).where("key IS NOT NULL")
        universe = materialise(universe.distinct())
        hits = []
        for action in sorted({rule.action for rule in rules}):
            cascade = build_cascade(pages.sparkSession, [r.text for r in rules if r.action == action], universe)
            hits += [F.when(member(cascade, k), F.struct(F.length(k).alias("size"), k.alias("rule"), F.lit(action).alias("verdict"))) for k in keys]
        found = F.greatest(*hits) if len(hits) > 1 else hits[0]
    judged = rows.withColumn("found", found)
    return judged.select(
        F.col("k").alias(key), "host", "path", F.col("found.rule").alias("rule"), F.coalesce("found.verdict", F.lit(other)).alias("verdict")
    )
