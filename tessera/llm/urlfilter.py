"""URL filter: a blocked Bloom filter in front of an exact hash join, in DataFrame functions only.

Two kinds of entries are listed. A *rule* is a host with a path prefix; it fits the host, all its
subdomains, and every path that starts with the prefix. A *listed URL* is one exact page. Both are
turned into canonical keys and put in one blocked Bloom filter (256 bits a block). For each URL the
keys that could match are tested against the filter; only possible hits are joined, by hash and
exactly, with the lists, which removes the false positives.

Defined results. Null URLs and URLs without ``://`` have an empty host and path and fit no rule but one
with an empty host. Repeated rows each get their verdict. An empty table gives an empty result; empty
lists allow everything. Of two fitting rules the longer wins, then the one first by code point.
Extra columns of the input are kept unless their name is one of the columns added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import LOWER, UPPER

#: Bound of the filter: 2**16 blocks of 256 bits are 2 MB. Longer lists only get more false positives, which the join removes.
MAX_BLOCKS = 1 << 16
BITS_PER_KEY = 16
ADDED = ("host", "path", "rule", "verdict")


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    at = F.locate("://", F.coalesce(url, F.lit("")))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    return F.translate(F.regexp_extract(rest, r"\A([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)


def canonical_page(host: Column, path: Column) -> Column:
    """One spelling for a page: no leading ``www.`` or ``m.``, no closing slash or ``.html``."""
    return F.concat(F.regexp_replace(host, r"\A(?:www|m)\.", ""), F.regexp_replace(path, r"(?:/|\.html)\z", ""))


def _rule_key(host: Column, path: Column) -> Column:
    return F.concat(F.lit("r"), host, F.lit(" "), path)


def _page_key(host: Column, path: Column) -> Column:
    return F.concat(F.lit("p"), canonical_page(host, path))


def _block(key: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")


def _mask(key: Column, word: int) -> Column:
    """Two of 64 bits for each of the block's four words, from a second hash."""
    h = F.xxhash64(key, F.lit(7))
    one = lambda shift: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, shift).bitwiseAND(F.lit(63)).cast("int"))
    return one(12 * word).bitwiseOR(one(12 * word + 6))


def bloom(keys: DataFrame, n_blocks: int) -> list[int]:
    """The filter over the column ``key`` as 4 * n_blocks words; its size does not depend on the keys."""
    rows = keys.groupBy(_block(F.col("key"), n_blocks).alias("b")).agg(*[F.bit_or(_mask(F.col("key"), w)).alias(f"w{w}") for w in range(4)])
    words = [0] * (4 * n_blocks)
    for r in rows.collect():  # at most n_blocks rows
        words[4 * r.b : 4 * r.b + 4] = [r.w0, r.w1, r.w2, r.w3]
    return words


def url_filter(pages: DataFrame, rules: DataFrame, listed: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """Adds host, path, rule and verdict to ``pages``.

    rules: columns host, path, verdict. listed: column url (and optionally verdict, else ``block``).
    A fitting rule decides; otherwise a listed URL; otherwise ``default``.
    """
    spark = pages.sparkSession
    rules = rules.select(F.translate("host", UPPER, LOWER).alias("host"), "path", "verdict").where("host is not null and path is not null and verdict is not null")
    lhost, lpath = url_parts(F.col("url"))
    entries = rules.select(_rule_key(F.col("host"), F.col("path")).alias("key"), F.concat("host", "path").alias("rule"), "verdict")
    said = F.col("verdict") if "verdict" in listed.columns else F.lit("block")
    entries = entries.unionByName(
        listed.where("url is not null").select(_page_key(lhost, lpath).alias("key"), F.lit(None).cast("string").alias("rule"), said.alias("verdict"))
    ).groupBy("key").agg(F.min("rule").alias("rule"), F.min("verdict").alias("verdict"))
    lengths = sorted({r[0] for r in rules.select(F.char_length("path")).distinct().collect()})  # at most one for each length of a path
    n = entries.count()
    n_blocks = 1
    while n_blocks < MAX_BLOCKS and 256 * n_blocks < BITS_PER_KEY * n:
        n_blocks *= 2
    words = bloom(entries, n_blocks)
    passes = F.array(F.lit(0).cast("long")) if not any(words) else F.from_json(F.lit(str(words)), "array<bigint>")

    host, path = url_parts(F.col(url))
    kept = [c for c in pages.columns if c not in ADDED]
    base = pages.select(*[F.col(f"`{c}`") for c in kept], host.alias("host"), path.alias("path"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    def rule_keys(k: int) -> Column:
        made = F.transform(suffixes, lambda s: _rule_key(s, F.substring("path", 1, k)))
        return F.when(F.char_length("path") >= k, made).otherwise(F.array().cast("array<string>"))

    keys = F.concat(F.array(_page_key(F.col("host"), F.col("path"))), *[rule_keys(k) for k in lengths])

    def possible(key: Column) -> Column:
        at = _block(key, n_blocks) * 4
        hit = F.lit(True)
        for w in range(4):
            m = _mask(key, w)
            hit = hit & (F.get(F.col("bits"), at + w).bitwiseAND(m) == m)
        return hit

    # One row for each distinct URL that may match, however many pages have it.
    spelled = base.select("host", "path").distinct().withColumn("bits", passes)
    hits = spelled.select("host", "path", F.explode(F.filter(keys, possible) if any(words) else F.array().cast("array<string>")).alias("key"))
    found = hits.join(entries, "key").groupBy("host", "path").agg(
        F.min_by(F.struct("rule", "verdict"), F.struct(F.col("rule").isNull(), -F.char_length(F.col("rule")), "rule")).alias("best"),
        F.min(F.when(F.col("rule").isNull(), F.col("verdict"))).alias("page_verdict"),
        F.max(F.col("rule").isNotNull()).alias("ruled"),
    )
    best = found.select(
        "host", "path",
        F.when(F.col("ruled"), F.col("best.rule")).alias("rule"),
        F.when(F.col("ruled"), F.col("best.verdict")).otherwise(F.col("page_verdict")).alias("verdict"),
    )
    return base.join(best, ["host", "path"], "left").select(*[F.col(f"`{c}`") for c in kept], "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
