"""URL filters by a cascade of Bloom filters.

The first filter holds the listed keys. The second holds those keys of the corpus that the first
takes for listed although they are not, the third those listed keys that the second takes for
false, and so on until a level errs on no key. Over the keys it was built on, the cascade is exact;
a look-up is a few bit tests against constants, without a join.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm.common import UPPER
from shelfmark.operators.joins import lookup_join
from shelfmark.session import staged_with_counts

# A level beyond this size is refused: it would not fit as a constant into each task.
MAX_LEVEL_BYTES = 64 * 1024 * 1024
# Most hash functions of a level.
MAX_HASHES = 16


@dataclass(frozen=True)
class Level:
    number: int
    bits: int
    hashes: int
    bitmap: bytes

    def contains(self, key: Column) -> Column:
        bitmap = F.lit(bytearray(self.bitmap))
        found = F.lit(True)
        for position in _positions(key, self.number, self.bits, self.hashes):
            byte = F.conv(F.hex(F.substring(bitmap, (F.floor(position / 8) + 1).cast("int"), F.lit(1))), 16, 10)
            found = found & (F.getbit(byte.cast("int"), position % 8) == 1)
        return found


@dataclass(frozen=True)
class Cascade:
    levels: Sequence[Level]

    def contains(self, key: Column) -> Column:
        """Whether a key of the universe is listed: decided by the first level that says no."""
        answer = F.lit(len(self.levels) % 2 == 1)
        for level in reversed(self.levels):
            listed_level = level.number % 2 == 0
            answer = F.when(level.contains(key), answer).otherwise(F.lit(not listed_level))
        return answer if self.levels else F.lit(False)


def build_cascade(listed: DataFrame, universe: DataFrame) -> Cascade:
    """A cascade that is exact for every key of ``universe``; both tables have one column ``key``.

    Null keys are left out. Sizes follow the list: the chance of error of the first level is set so
    that about as many unlisted keys pass as there are listed ones, and later levels halve them.
    """
    listed, n_listed = _counted(listed.where("key IS NOT NULL").distinct(), "cascade-listed")
    universe, n_universe = _counted(universe.where("key IS NOT NULL").distinct(), "cascade-keys")
    levels: list[Level] = []
    inside, n_inside = listed, n_listed
    outside, n_outside = universe, max(n_universe - n_listed, 1)
    while n_inside:
        error = min(0.5, math.sqrt(2) * n_inside / n_outside) if not levels else 0.5
        levels.append(_level(inside, n_inside, len(levels), error))
        passed = outside.where(levels[-1].contains(F.col("key")))
        if len(levels) == 1:  # only here the tested keys may include listed ones
            passed = lookup_join(passed, listed, ["key"], "left_anti")
        passed, n_passed = _counted(passed, "cascade-passed")
        inside, n_inside, outside, n_outside = passed, n_passed, inside, n_inside
    return Cascade(levels)


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A to Z lower-cased) and path of a URL; both empty for null or without ``://``."""
    start = F.instr(url, "://")
    rest = F.when(start > 0, F.substring(url, start + 3, F.char_length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, UPPER.lower())
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return host, path


def url_keys(host: Column, path: Column, path_lengths: Sequence[int]) -> Column:
    """All rule keys that could fit: each suffix of the host by labels with each listed length of path."""
    labels = F.split(host, r"\.", -1)
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )
    heads = F.filter(
        F.array(*[F.when(F.char_length(path) >= n, F.substring(path, 1, n)) for n in path_lengths]),
        lambda head: head.isNotNull(),
    )
    return F.flatten(F.transform(suffixes, lambda s: F.transform(heads, lambda p: F.concat(s, p))))


def filter_urls(
    pages: DataFrame,
    allow: Sequence[tuple[str, str]],
    block: Sequence[tuple[str, str]],
    default: str = "allow",
    url: str = "url",
) -> DataFrame:
    """Adds host, path, rule and verdict (allow or block) to each page; columns of these names are replaced.

    A rule (host, path) fits its host and all subdomains of it where the URL's path starts with the
    rule's; of the fitting rules the longest wins, and of equal ones an allowing rule. Without a
    fitting rule, rule is null and the verdict is ``default``: a URL none of whose keys is listed
    in a cascade. Null, empty and malformed URLs have empty host and path. Repeated rows are judged
    alike, one by one.
    """
    spark = pages.sparkSession
    lengths = sorted({len(path) for _, path in [*allow, *block]}) or [0]
    host, path = url_parts(F.col(url))
    kept = pages.drop(*[c for c in ("host", "path", "rule", "verdict") if c != url])
    keyed = kept.withColumn("host", host).withColumn("path", path)
    universe = keyed.select("host", "path").distinct().select(
        F.explode(url_keys(F.col("host"), F.col("path"), lengths)).alias("key")
    )
    universe, _ = _counted(universe.distinct(), "url-keys")
    allowed = build_cascade(_rule_keys(spark, allow), universe)
    blocked = build_cascade(_rule_keys(spark, block), universe)
    keys = url_keys(F.col("host"), F.col("path"), lengths)

    def longest(cascade: Cascade) -> Column:
        hits = F.filter(keys, lambda key: cascade.contains(key))
        return F.array_max(F.transform(hits, lambda key: F.struct(F.char_length(key).alias("n"), key.alias("key"))))

    allow_hit, block_hit = longest(allowed), longest(blocked)
    allow_n, block_n = F.coalesce(allow_hit["n"], F.lit(-1)), F.coalesce(block_hit["n"], F.lit(-1))
    blocks = block_n > allow_n
    return keyed.withColumn(
        "rule", F.when(blocks, block_hit["key"]).otherwise(allow_hit["key"])
    ).withColumn(
        "verdict",
        F.when(blocks, "block").when(allow_n >= 0, "allow").otherwise(F.lit(default)),
    )


def _rule_keys(spark: SparkSession, rules: Sequence[tuple[str, str]]) -> DataFrame:
    keys = F.array(*[F.lit(host + path) for host, path in rules]).cast("array<string>")
    return spark.range(1).select(F.explode(keys).alias("key"))


def _counted(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    rows, counts = staged_with_counts(df, name, F.count(F.lit(1)).alias("n"))
    return rows, counts["n"]


def _positions(key: Column, level: int, bits: int, hashes: int) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(level * MAX_HASHES + i), key), F.lit(bits)) for i in range(hashes)]


def _level(keys: DataFrame, n: int, number: int, error: float) -> Level:
    hashes = min(MAX_HASHES, max(1, round(-math.log2(error))))
    bits = max(64, 8 * math.ceil(-n * math.log(error) / math.log(2) ** 2 / 8))
    if bits > 8 * MAX_LEVEL_BYTES:
        raise ValueError(f"{n} keys need {bits // 8} bytes of filter; at most {MAX_LEVEL_BYTES} are allowed")
    position = F.explode(F.array(*[p + 1 for p in _positions(F.col("key"), number, bits, hashes)]))
    pieces = (
        keys.select(position.alias("p"))
        .groupBy(F.bitmap_bucket_number("p").alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("piece"))
        .collect()  # the filter itself, of the size checked above
    )
    width = len(pieces[0]["piece"])
    bitmap = bytearray(width * math.ceil(bits / (8 * width)))
    for row in pieces:
        bitmap[(row["bucket"] - 1) * width : row["bucket"] * width] = row["piece"]
    return Level(number, bits, hashes, bytes(bitmap[: math.ceil(bits / 8)]))
