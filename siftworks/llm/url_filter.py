"""URL filters: allow and block rules, then a Bloom filter cascade for listed keys.

The cascade answers exactly for every key of its universe: level 0 encodes the listed keys, level 1 the
unlisted keys that level 0 wrongly holds, level 2 the listed keys that level 1 wrongly holds, and so on
until a level has no false positive. A key that the first c levels hold, and the next doesn't, is listed
when c is odd. Only DataFrame functions are used. Each level is one array of 64-bit words that reaches
the executors as a scalar subquery, so rows are judged in place: no join and no shuffle of pages. Each
position is a hash seeded with its own number, so keys that meet in one level part in the next; should a
key be left after MAX_LEVELS levels, the last one is the keys themselves. The keys are split by hash into
as many groups as keep one cascade under `max_filter_bytes`; with more than one group pages and keys are
written once, in a folder a group, and each group reads only its own.

Nulls: a null url, or one without `://`, has an empty host and path; the empty key is never listed.
Null keys and repeated keys in the list count once or not at all. Extra columns pass through.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, kept, stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BITS_PER_KEY, PROBES, MAX_FILTER_BYTES, MAX_LEVELS = 10, 7, 8_000_000, 40


#: Files of a group of pages.
GROUP_FILES = 8


def url_host(url: Column) -> Column:
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.length(url))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return F.when(at > 0, host).otherwise(F.lit(""))


def url_path(url: Column) -> Column:
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.length(url))
    return F.when(at > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise(F.lit(""))


def rule_column(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, or nulls. rules: (`allow` or `block`, host/path)."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for action, text in sorted(rules, key=lambda r: len(r[1])):
        at = text.index("/")
        site, prefix = text[:at], text[at:]
        fits = ((host == site) | host.endswith("." + site)) & path.startswith(prefix)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(action)).otherwise(verdict)
    return rule, verdict


def _positions(key: Column, level: int, bits: int) -> list[Column]:
    """Bit positions of a key in one level. The number goes first: it seeds the hash of the key."""
    return [F.pmod(F.xxhash64(F.lit(level * PROBES + i), key), F.lit(bits)) for i in range(PROBES)]


def _bit(at: Column) -> Column:
    """A 64-bit word with the bit of position `at`."""
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), at.bitwiseAND(63).cast("int"))


def _holds(words: Column, key: Column, level: int, bits: int) -> Column:
    if not bits:
        return F.array_contains(words, key)
    tests = [F.get(words, F.shiftright(p, 6).cast("int")).bitwiseAND(_bit(p)) != 0 for p in _positions(key, level, bits)]
    return reduce(lambda a, b: a & b, tests)


def _level(encoded: DataFrame, level: int, bits: int) -> DataFrame:
    """One row, one dense array of 64-bit words; its length is bounded by the group's filter size."""
    spots = encoded.select(F.explode(F.array(*_positions(F.col("key"), level, bits))).alias("at"))
    words = spots.groupBy(F.shiftright("at", 6).alias("word")).agg(
        F.bit_or(_bit(F.col("at"))).alias("bits")
    )
    blank = encoded.sparkSession.range(bits // 64).select(F.col("id").alias("word"), F.lit(0).cast("bigint").alias("bits"))
    dense = words.unionByName(blank).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    return kept(dense.agg(F.array_sort(F.collect_list(F.struct("word", "bits"))).getField("bits").alias("words")))


def build_cascade(universe: DataFrame) -> list[tuple[DataFrame, int]]:
    """Levels of the cascade over `universe` (key, listed): one-row tables of words with their bits; 0 bits: of keys."""
    encoded, others = universe.filter("listed"), universe.filter("NOT listed")
    levels: list[tuple[DataFrame, int]] = []
    while (n := encoded.count()) > 0:
        if len(levels) == MAX_LEVELS:  # exact, so the last; each level holds about a hundredth of the keys before
            levels.append((kept(encoded.agg(F.collect_set("key").alias("words"))), 0))
            break
        bits = -(-n * BITS_PER_KEY // 64) * 64
        at = len(levels)
        words = _level(encoded, at, bits)
        levels.append((words, bits))
        wrong = others.filter(_holds(words.scalar(), F.col("key"), at, bits))
        encoded, others = kept(wrong), encoded
    return levels


def listed_column(levels: list[tuple[DataFrame, int]], key: Column) -> Column:
    """True for listed keys of the universe: the depth to which levels hold the key is odd."""
    out = F.lit(len(levels) % 2 == 1)
    for at, (words, bits) in reversed(list(enumerate(levels))):
        out = F.when(_holds(words.scalar(), key, at, bits), out).otherwise(F.lit(at % 2 == 1))
    return out


def filter_urls(
    pages: DataFrame,
    listed: DataFrame,
    rules: list[tuple[str, str]],
    url_col: str = "url",
    max_filter_bytes: int = MAX_FILTER_BYTES,
) -> DataFrame:
    """Adds host, path, rule and verdict to `pages`. `listed`: one column `key` of blocked host+path keys.

    Existing columns of those names are replaced. An empty table gives an empty result.
    """
    pages = pages.withColumn("host", url_host(F.col(url_col))).withColumn("path", url_path(F.col(url_col)))
    pages = pages.withColumns({"host": F.coalesce("host", F.lit("")), "path": F.coalesce("path", F.lit(""))})
    key = F.concat(F.col("host"), F.col("path"))
    universe = kept(
        pages.select(key.alias("key"), F.lit(False).alias("listed"))
        .unionByName(listed.select("key", F.lit(True).alias("listed")).filter("key <> ''"))
        .groupBy("key")
        .agg(F.bool_or("listed").alias("listed"))
    )
    n = universe.filter("listed").count()
    groups = max(1, -(-n * BITS_PER_KEY // (8 * max_filter_bytes)))
    rule, verdict = rule_column(F.col("host"), F.col("path"), rules)

    def judged(part: DataFrame, levels: list[tuple[DataFrame, int]]) -> DataFrame:
        by_list = F.when(listed_column(levels, key), F.lit("block")).otherwise(F.lit("allow"))
        return part.withColumns({"rule": rule, "verdict": F.coalesce(verdict, by_list)})

    if groups == 1:
        return judged(pages, build_cascade(universe))
    g = free_name(pages, "_group")
    group = F.pmod(F.xxhash64(F.lit("group"), key), F.lit(groups))
    # Each group's rows lie in about GROUP_FILES files, so a key of many pages isn't one task.
    salt = (F.rand(7) * GROUP_FILES).cast("int")
    dealt = stored(pages.withColumn(g, group).repartition(groups * GROUP_FILES, g, salt), "pages", by=g)
    keys = stored(universe.withColumn("_group", F.pmod(F.xxhash64(F.lit("group"), F.col("key")), F.lit(groups))).repartition(groups, "_group"), "keys", by="_group")
    parts = [judged(dealt.filter(F.col(g) == i).drop(g), build_cascade(keys.filter(F.col("_group") == i).drop("_group"))) for i in range(groups)]
    return reduce(DataFrame.unionByName, parts)
