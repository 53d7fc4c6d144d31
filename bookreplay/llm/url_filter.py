"""URL filters: host and path rules, then a blocked Bloom filter of listed canonical URLs whose hits
are verified by an exact hash join (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookreplay.llm.common import ascii_lower, cut

BLOCK_BITS = 512
#: The filter is broadcast up to this size, else joined by its block numbers; the listed urls themselves go by
#: their own size.
BROADCAST_BYTES = 16 << 20
#: Bytes of a row that is broadcast beside its text.
ROW_BYTES = 64
#: Beyond it, rows of one url or block are spread over so many places.
SALTS, BLOCK_SALTS = 32, 8


def host_of(url: Column) -> Column:
    after = F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://(.*)$", 1)
    return ascii_lower(F.regexp_extract(after, "^[^/?#]*", 0))


def path_of(url: Column) -> Column:
    after = F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://(.*)$", 1)
    return F.regexp_extract(after, "^[^/?#]*([^?#]*)", 1)


def canonical(url: Column) -> Column:
    """host/path?query: no scheme, ``www.``, fragment, trailing slash or tracking parameters, and
    the other parameters sorted. Empty for a null url or one without ``://``."""
    host = F.regexp_replace(host_of(url), "^www\\.", "")
    path = F.regexp_replace(path_of(url), "/+$", "")
    query = F.regexp_extract(F.coalesce(url, F.lit("")), "^[^?#]*\\?([^#]*)", 1)
    kept = F.filter(F.split(query, "&"), lambda q: (q != "") & ~q.rlike("^(utm_[a-z]*|ref|fbclid|gclid)="))
    query = F.array_join(F.array_sort(kept), "&")
    return F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def rule_for(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest fitting rule; of equally long ones the last in code point order. A rule is ``host/path``: it fits that host and its subdomains where
    the path starts with its own. Rules are a parameter of a few hundred at most."""
    fits = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        h, _, p = rule.partition("/")
        own = (host == h) | host.endswith("." + h)
        fits = F.when(own & path.startswith("/" + p), F.lit(rule)).otherwise(fits)
    return fits


def bloom_blocks(keys: DataFrame, blocks: int) -> DataFrame:
    """One row for each block that holds a key: eight 64-bit words, in each of which a key sets one bit."""
    bits = [_bit("url", i).alias(f"w{i}") for i in range(8)]
    return keys.select(_block("url", blocks), *bits).groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(8)])


def _block(url: str, blocks: int) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(blocks)).alias("block")


def _bit(url: str, i: int) -> Column:
    turn = F.shiftrightunsigned(F.xxhash64(F.lit("bits"), F.col(url)), 6 * i).bitwiseAND(F.lit(63)).cast("int")
    return F.call_function("shiftleft", F.lit(1).cast("long"), turn)


def listed_urls(rows: DataFrame, listed: DataFrame, bits_per_key: int = 16, broadcast_bytes: int | None = None) -> DataFrame:
    """``rows`` (with a canonical ``url``) plus ``maybe`` (the Bloom filter's answer) and ``is_listed``.

    Only rows that the filter passes reach the exact join; a filter has no false negatives, so the
    others are not listed. Empty urls are never listed. With an empty list no row passes. The filter and the
    listed urls that were met are broadcast where their sizes, each checked for itself, allow it."""
    broadcast_bytes = BROADCAST_BYTES if broadcast_bytes is None else broadcast_bytes
    keys = cut(listed.select("url").where("url <> ''").distinct(), "listed-urls")
    size = keys.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("url") + ROW_BYTES).alias("octets")).first()
    blocks = max(1, -(-size["n"] * bits_per_key // BLOCK_BITS))
    words = bloom_blocks(keys, blocks)
    probed = rows.withColumn("block", _block("url", blocks))
    all_set = F.lit(True)
    for i in range(8):
        all_set = all_set & (F.col(f"w{i}").bitwiseAND(_bit("url", i)) != 0)
    maybe = F.coalesce(all_set, F.lit(False)) & (F.col("url") != "")
    if blocks * (BLOCK_BITS // 8 + 16) <= broadcast_bytes:
        probed = probed.join(F.broadcast(words), "block", "left")
    else:
        probed = probed.withColumn("salt", F.floor(F.rand(11) * BLOCK_SALTS).cast("int")).join(words.select("*", _salts(BLOCK_SALTS)), ["block", "salt"], "left").drop("salt")
    probed = cut(probed.withColumn("maybe", maybe).drop("block", *[f"w{i}" for i in range(8)]), "probed")
    # A url that a third of the rows share is one row here.
    hits = probed.where("maybe")
    verified = hits.select("url").distinct().join(keys, "url", "left_semi").withColumn("is_listed", F.lit(True))
    if (size["octets"] or 0) <= broadcast_bytes:  # what was met of the list is no larger than the list
        hits = hits.join(F.broadcast(verified), "url", "left")
    else:  # and its rows meet it in as many places as there are salts
        hits = hits.withColumn("salt", F.floor(F.rand(7) * SALTS).cast("int")).join(verified.select("*", _salts(SALTS)), ["url", "salt"], "left").drop("salt")
    hits = hits.withColumn("is_listed", F.coalesce("is_listed", F.lit(False)))
    return probed.where("not maybe").withColumn("is_listed", F.lit(False)).unionByName(hits)


def _salts(n: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("salt")


def filter_urls(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str]], url: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, maybe, is_listed for every row of ``pages``.

    ``listed`` has a column ``url`` of canonical URLs. The verdict is the rule's where one fits, else
    block for listed URLs and allow for the others. Null urls and urls without ``://`` have empty
    parts and are allowed. Repeated rows are judged one by one; other columns are not carried. An empty
    table gives no rows, an empty list lists nothing. Urls of any length are read whole."""
    verdicts = {rule: verdict for verdict, rule in rules}
    u = F.col(url).cast("string")
    rows = pages.select("page_id", host_of(u).alias("host"), path_of(u).alias("path"), canonical(u).alias("url"))
    judged = listed_urls(rows, listed).withColumn("rule", rule_for(F.col("host"), F.col("path"), rules))
    verdict = F.when(F.col("is_listed"), "block").otherwise("allow")
    for rule, said in verdicts.items():
        verdict = F.when(F.col("rule") == rule, said).otherwise(verdict)
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "maybe", "is_listed")
