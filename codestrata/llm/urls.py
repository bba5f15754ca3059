"""URL filter by a cascade of Bloom filters, in DataFrame functions alone.

The listed keys (rules for a host and its subdomains with a path prefix, and hosts of a block list) are encoded by a
first filter. What the corpus's own keys pass it falsely is encoded by a second one, what of the listed keys passes that
falsely by a third, and so on until nothing is left. Over the corpus's complete set of keys the cascade is then exact,
and each url is judged where it stands, without a join or a shuffle.

The filters together hold a few bits for each listed key, whatever the corpus's size: the first one's error rate falls
as the corpus grows, so that the second encodes about as many keys. They reach the tasks as literals, up to
``MAX_BITS``; longer lists are looked up by a join over the distinct urls instead.

Results for odd input: a null url, or one without ``://``, has an empty host and path, fits no rule and is allowed;
repeated rows are judged each; extra columns, whatever their names, are left out; an empty table gives no rows. Of a host only as
many labels are looked at as the longest listed host has, so that the time is linear in a url's length.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Verdict, host, path of each rule of the contract (fixed values).
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Hosts that the method itself blocks, with their subdomains, where no rule fits.
BLOCKED_HOSTS = (
    "ads-track.example.com", "casino-win.example.net", "spam-farm.example.org", "adult-x.example.com", "cheap-pills.example.com",
    "cheap-pills.example.net", "free-bets.example.net",
)

#: Bits of all the filters that are sent as literals.
MAX_BITS = 1 << 23
#: Bits in a byte of a literal: with seven, each byte is a character of ASCII.
BYTE = 7
HASHES = 4
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@dataclass(frozen=True)
class Level:
    bits: int
    hashes: int
    literal: bytes


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host and path as the contract defines them."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, UPPER.lower())
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def suffixes(host: Column, labels: int) -> Column:
    """A host and its parent domains, of at most so many labels, so that the work is linear in a host of any length."""
    parts = F.split(F.substring_index(host, ".", -labels), r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def keys(host: Column, path: Column, rules: Iterable[tuple[str, str, str]]) -> Column:
    """What to look up for a url: parent domains with each length of path prefix that the rules have."""
    labels = max((h.count(".") + 1 for _, h, _ in rules), default=1)

    def of_length(n: int) -> Column:
        joined = F.transform(suffixes(host, labels), lambda h: F.concat(h, F.substring(path, 1, n)))
        return F.when(F.length(path) >= n, joined).otherwise(F.array().cast("array<string>"))

    return F.concat(F.array().cast("array<string>"), *(of_length(n) for n in sorted({len(p) for _, _, p in rules})))


def _place(key: Column, level: int, j: int, bits: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(level), F.lit(j)), F.lit(bits))


def _passes(key: Column, number: int, level: Level) -> Column:
    out = None
    for j in range(level.hashes):
        at = _place(key, number, j, level.bits)
        byte = F.substr(F.lit(level.literal), (F.floor(at / BYTE) + 1).cast("int"), F.lit(1))
        hit = F.getbit(F.ascii(byte.cast("string")), F.pmod(at, F.lit(BYTE)).cast("int")) == 1
        out = hit if out is None else out & hit
    return out


def contains(key: Column, cascade: list[Level]) -> Column:
    """Whether a key of the corpus is a listed one: the first level that it does not pass tells."""
    out = F.lit(len(cascade) % 2 == 1)
    for number in range(len(cascade), 0, -1):
        out = F.when(~_passes(key, number, cascade[number - 1]), F.lit(number % 2 == 0)).otherwise(out)
    return out


def _level(members: DataFrame, count: int, rate: float, number: int) -> Level:
    hashes = HASHES if rate < 0.1 else 1
    bits = max(BYTE, math.ceil(-hashes * count / math.log(1 - rate ** (1 / hashes))))
    places = members.select(F.explode(F.array(*(_place(F.col("key"), number, j, bits) for j in range(hashes)))).alias("at"))
    rows = places.groupBy(F.floor(F.col("at") / BYTE).alias("byte")).agg(F.bit_or(F.expr(f"shiftleft(1, cast(pmod(at, {BYTE}) AS INT))")).alias("value")).collect()
    literal = bytearray(-(-bits // BYTE))
    for row in rows:
        literal[row["byte"]] = row["value"]
    return Level(bits, hashes, bytes(literal))


def build(listed: DataFrame, universe: DataFrame, max_bits: int = MAX_BITS) -> list[Level] | None:
    """The cascade for ``listed`` (distinct ``key``) over ``universe`` (``key``, repeated or not).

    None if it would take more than ``max_bits``. Only filters and counts come to the driver.
    """
    count = listed.count()
    if not count:
        return []
    total = universe.agg(F.approx_count_distinct("key")).head()[0]
    rate = min(0.5, max(2.0**-30, math.sqrt(0.5) * count / max(total, 1)))
    cascade: list[Level] = []
    one, other = listed, None
    size = 0
    while count:
        if size + 2 * count > max_bits:
            return None
        cascade.append(_level(one, count, rate, len(cascade) + 1))
        size += cascade[-1].bits
        if size > max_bits:
            return None
        here = _passes(F.col("key"), len(cascade), cascade[-1])
        if other is None:
            passed = universe.where(here).distinct()
            flagged = passed.withColumn("listed", F.lit(0)).unionByName(listed.withColumn("listed", F.lit(1)))
            other = flagged.groupBy("key").agg(F.max("listed").alias("listed")).where("listed = 0").select("key")
        else:
            other = other.where(here)
        other = cut(other)
        one, other, count, rate = other, one, other.count(), 0.5
    return cascade


def _tagged(kind: str, key: Column) -> Column:
    return F.concat(F.lit(f"{kind}|"), key)


def judge(pages: DataFrame, rules=RULES, blocked_hosts=BLOCKED_HOSTS, max_bits: int = MAX_BITS) -> DataFrame:
    """``page_id``, ``host``, ``path``, the rule that fits (or null), the verdict, and the listed host if one told.

    ``blocked_hosts`` are names in lower case, or a table of any size with a column ``host``.
    """
    spark = pages.sparkSession
    host, path = host_and_path(F.col("url"))
    urls = pages.select("page_id", "url").withColumns({"host": host, "path": path})
    table = isinstance(blocked_hosts, DataFrame)
    if table:
        labels = blocked_hosts.agg(F.max(F.size(F.split("host", r"\.")))).head()[0] or 1
    else:
        labels = max((h.count(".") + 1 for h in blocked_hosts), default=1)
    urls = urls.withColumns({"candidates": keys(F.col("host"), F.col("path"), rules), "domains": suffixes(F.col("host"), labels)})
    entries = {f"{verdict}|{h}{p}" for verdict, h, p in rules} | {f"host|{h}" for h in (() if table else blocked_hosts)}
    listed = spark.createDataFrame([(x,) for x in sorted(entries)], "key string")
    if table:
        named = blocked_hosts.where(F.length("host") > 0).select(_tagged("host", F.translate("host", UPPER, UPPER.lower())).alias("key"))
        listed = cut(listed.unionByName(named.distinct()))
    every = F.concat(F.transform("candidates", lambda c: _tagged("allow", c)), F.transform("candidates", lambda c: _tagged("block", c)), F.transform("domains", lambda d: _tagged("host", d)))
    cascade = build(listed, urls.select(F.explode(every).alias("key")), max_bits)
    if cascade is None:
        found = urls.select("url", F.explode(every).alias("key")).distinct().join(listed, "key").groupBy("url").agg(F.collect_set("key").alias("hits"))
        urls = urls.join(found, "url", "left").withColumn("hits", F.coalesce("hits", F.array().cast("array<string>")))
        has = lambda key: F.array_contains("hits", key)
    else:
        has = lambda key: contains(key, cascade)

    def fitting(verdict: str) -> Column:
        """The longest rule of one verdict that fits; empty if none."""
        hits = F.filter("candidates", lambda c: has(_tagged(verdict, c)))
        return F.aggregate(hits, F.lit(""), lambda best, c: F.when(F.length(c) > F.length(best), c).otherwise(best))

    judged = urls.withColumns({"allow": fitting("allow"), "block": fitting("block"), "listed_host": F.get(F.filter("domains", lambda d: has(_tagged("host", d))), F.lit(0))})
    blocked = F.length("block") >= F.length("allow")  # of one rule listed both ways, the block holds
    rule = F.when(blocked, F.col("block")).otherwise(F.col("allow"))
    none = F.length(rule) == 0
    verdict = F.when(none, F.when(F.col("listed_host").isNotNull(), "block").otherwise("allow")).when(blocked, "block").otherwise("allow")
    return judged.select("page_id", "host", "path", F.when(~none, rule).alias("rule"), verdict.alias("verdict"), "listed_host")
