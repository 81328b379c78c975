"""URL filters: host and path rules, and a blocked Bloom filter before an exact hash join.

Each listed canonical URL sets one bit in each of the eight 64-bit words of one block.  The
block table is built by a ``bit_or`` aggregate and has at most ``max_blocks`` rows of 72 bytes
(65536 rows, 5 MB, by default), so it may be broadcast.  URLs that the filter passes
go on to an exact join with the list, which removes false positives; a URL that it stops is on
no list, and its row stays where it is: only hits are shuffled.  A longer list raises the share
of false positives, never the broadcast; give ``max_blocks`` more for lists of millions.

Canonical URLs keep the query parameters that tell pages apart and drop those that only track
where a visitor came from (``TRACKING``).

Edge cases: a NULL url, or one without ``://``, has an empty host and path, fits no rule and is
on no list.  An empty list gives ``allow`` wherever no rule fits.  Repeated rows are judged one
by one.  Of the input only the id and the url are read, so other columns can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varkit.llm.common import stored

#: (verdict, host, path) of the rules; a host stands for its subdomains too.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"),
         ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

# Names of query parameters that identify no page.
TRACKING = r"^(utm_[^=]*|ref|gclid|fbclid)(=|$)"
# Words of a host's name, between dots and hyphens, that mark gambling, adult, pill, spam and tracking sites.
BAD_HOST = r"(^|[.-])(ads|adult|bets|casino|pills|poker|porn|spam|track|tracker|xxx)([.-]|$)"

WORDS = 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def query_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1), F.lit(""))


def canonical(host: Column, path: Column, query: Column) -> Column:
    """Host without a leading ``www.``, path without trailing slashes and the parameters of the
    query, in their order, without empty and tracking ones; scheme and fragment are dropped.
    NULL without a host."""
    told = F.array_join(F.filter(F.split(query, "&"), lambda x: (x != "") & ~x.rlike(TRACKING)), "&")
    url = F.concat(F.regexp_replace(host, r"^www\.", ""), F.regexp_replace(path, r"/+$", ""),
                   F.when(told != "", F.concat(F.lit("?"), told)).otherwise(""))
    return F.when(host != "", url)


def canonical_of(url: Column) -> Column:
    return canonical(host_of(url), path_of(url), query_of(url))


def rule_columns(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, NULL where none does.  ``rules`` is a
    parameter of a few dozen entries; they become one CASE, longest first."""
    rule = verdict = None
    for v, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1], r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, h + p) if rule is None else rule.when(fits, h + p)
        verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
    none = F.lit(None).cast("string")
    return (none if rule is None else rule), (none if verdict is None else verdict)


def _bits() -> list[Column]:
    """One bit for each word, from six bits each of the hash in column ``_h``."""
    return [F.expr(f"shiftleft(1L, cast(shiftrightunsigned(_h, {6 * i}) & 63 as int))") for i in range(WORDS)]


def bloom_blocks(listed: DataFrame, key: str, blocks: int) -> DataFrame:
    """(block, w0..w7) of the filter over the distinct values of ``key``."""
    rows = listed.select(F.col(key).alias("_k")).where(F.col("_k").isNotNull())
    rows = rows.select(F.pmod(F.xxhash64("_k"), F.lit(blocks)).alias("block"), F.xxhash64("_k", F.lit(1)).alias("_h"))
    return (rows.select("block", *[b.alias(f"w{i}") for i, b in enumerate(_bits())])
            .groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)]))


def probe(df: DataFrame, key: str, filter_blocks: DataFrame, blocks: int) -> DataFrame:
    """Adds the boolean ``_maybe``: false only where ``key`` is on no list."""
    f = F.broadcast(filter_blocks.select(F.col("block").alias("_b"), *[F.col(f"w{i}").alias(f"_w{i}") for i in range(WORDS)]))
    rows = df.withColumn("_h", F.xxhash64(key, F.lit(1))).withColumn("_blk", F.pmod(F.xxhash64(key), F.lit(blocks)))
    hit = F.col(key).isNotNull() & F.col("_b").isNotNull()
    for i, b in enumerate(_bits()):
        hit = hit & (F.col(f"_w{i}").bitwiseAND(b) != 0)
    return (rows.join(f, F.col("_blk") == F.col("_b"), "left")
            .withColumn("_maybe", F.coalesce(hit, F.lit(False)))
            .drop("_h", "_blk", "_b", *[f"_w{i}" for i in range(WORDS)]))


def judge_urls(urls: DataFrame, listed: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url",
               listed_col: str = "url", bits_per_url: int = 16, max_blocks: int = 65536) -> DataFrame:
    """(id, host, path, rule, canonical_url, passed_filter, is_listed, verdict) per row.

    The verdict is the longest fitting rule's; where none fits, ``block`` for a listed URL and
    else ``allow``.  ``listed`` holds URLs in ``listed_col``; they are made canonical first.
    """
    names = stored(listed.select(canonical_of(F.col(f"`{listed_col}`")).alias("_c")).where("_c IS NOT NULL").distinct(), "listed")
    n = names.count()
    blocks = max(1, min(max_blocks, -(-n * bits_per_url // 512)))

    u = F.col(f"`{url_col}`")
    rows = urls.select(F.col(f"`{id_col}`").alias(id_col), host_of(u).alias("host"), path_of(u).alias("path"), query_of(u).alias("_query"))
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    rows = rows.select(F.col(id_col), "host", "path", rule.alias("rule"), verdict.alias("_verdict"),
                       canonical(F.col("host"), F.col("path"), F.col("_query")).alias("canonical_url"))
    probed = probe(rows, "canonical_url", bloom_blocks(names, "_c", blocks), blocks)
    hits = probed.where("_maybe").join(names, F.col("canonical_url") == F.col("_c"), "left")
    out = (hits.withColumn("is_listed", F.col("_c").isNotNull()).drop("_c")
           .unionByName(probed.where("NOT _maybe").withColumn("is_listed", F.lit(False))))
    return out.select(F.col(id_col), "host", "path", "rule", "canonical_url", F.col("_maybe").alias("passed_filter"), "is_listed",
                      F.coalesce("_verdict", F.when(F.col("is_listed"), "block").otherwise("allow")).alias("verdict"))


def bad_host_urls(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """The URLs in ``pages`` whose host is named after what no corpus wants (``BAD_HOST``)."""
    u = F.col(f"`{url_col}`")
    return pages.select(u.alias("url")).where(host_of(u).rlike(BAD_HOST)).distinct()
