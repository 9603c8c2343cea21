"""URL filters: host and path rules, then a blocked Bloom filter of listed canonical URLs before an exact hash join.

Only DataFrame functions. The Bloom filter is a table of blocks of four 64-bit words; a URL's hash names one block and one
bit in each word, so a look-up reads one row. The table has at most `MAX_BLOCKS` rows, which bounds its broadcast; what
passes is joined with the list itself, so false positives never decide.

Results: a null URL, or one without `://`, has empty host and path, no rule and no canonical URL, and is allowed; equal
URLs are judged alike; null ids give rows; extra columns are not read; an empty list allows whatever has no rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS_PER_URL, WORDS, MAX_BLOCKS = 16, 4, 1 << 18
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, _URL, 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """Host and path without the scheme, a leading www., trailing slashes, query and fragment; null without a host."""
    return F.when(host != "", F.concat(F.regexp_replace(host, r"^www\.", ""), F.regexp_replace(path, "/+$", "")))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest rule (`host/path`) whose host is the URL's or a parent of it and whose path begins the URL's; else null."""
    out = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: len(r[0])):
        at = rule.index("/")
        fits = ((host == rule[:at]) | host.endswith("." + rule[:at])) & path.startswith(rule[at:])
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def _bits(url: Column, blocks: int) -> tuple[Column, list[Column]]:
    """The block of a URL and its bit in each of the block's words."""
    place, choice = F.xxhash64(url), F.xxhash64(url, F.lit(1))
    return F.pmod(place, F.lit(blocks)), [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(choice, 6 * i).bitwiseAND(F.lit(63)).cast("int")) for i in range(WORDS)]


def bloom_blocks(listed: DataFrame, column: str, blocks: int) -> DataFrame:
    """The filter: block and its words, for blocks that hold anything."""
    block, bits = _bits(F.col(column), blocks)
    marks = listed.filter(F.col(column).isNotNull()).select(block.alias("block"), *(b.alias(f"w{i}") for i, b in enumerate(bits)))
    return marks.groupBy("block").agg(*(F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)))


def listed_urls(urls: DataFrame, listed: DataFrame) -> DataFrame:
    """`urls` (with a column canonical) with the column listed: whether the canonical URL is in `listed` (canonical)."""
    exact = listed.filter("canonical is not null").select("canonical").distinct()
    n = exact.count()
    blocks = 1
    while blocks * WORDS * 64 < n * BITS_PER_URL and blocks < MAX_BLOCKS:
        blocks *= 2
    block, bits = _bits(F.col("canonical"), blocks)
    table = F.broadcast(bloom_blocks(exact, "canonical", blocks))  # at most MAX_BLOCKS rows
    passes = F.col("w0").isNotNull()
    for i, bit in enumerate(bits):
        passes = passes & (F.col(f"w{i}").bitwiseAND(bit) == bit)
    tested = urls.withColumn("block", block).join(table, "block", "left").withColumn("possible", F.coalesce(passes, F.lit(False))).drop("block", *(f"w{i}" for i in range(WORDS)))
    missed = tested.filter("not possible").withColumn("listed", F.lit(False))
    hits = tested.filter("possible").join(exact.withColumn("listed", F.lit(True)).hint("shuffle_hash"), "canonical", "left")
    return missed.unionByName(hits.select(*missed.columns[:-1], F.coalesce("listed", F.lit(False)).alias("listed"))).drop("possible")


def judge(pages: DataFrame, rules: list[tuple[str, str]], listed: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict and listed of each row of `pages` (page_id, url)."""
    split = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    split = split.withColumn("canonical", canonical(F.col("host"), F.col("path"))).withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    tested = listed_urls(split, listed)
    verdict = F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow"))
    for rule, says in rules:
        verdict = F.when(F.col("rule") == rule, F.lit(says)).otherwise(verdict)
    return tested.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "listed")


def claimed_twice(pages: DataFrame) -> DataFrame:
    """The canonical URLs that more than one row claims: a list drawn from the whole table."""
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    found = pages.select(canonical(host, path).alias("canonical")).filter("canonical is not null")
    return found.groupBy("canonical").agg(F.count("*").alias("n")).filter("n > 1").select("canonical")
