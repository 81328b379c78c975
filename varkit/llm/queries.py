"""Registered queries of the subpackage and their SQL.

Each ``opN_...`` applies its operator with production parameters to its whole table and derives
the columns of its contract from the operator's own output.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

WORD_RE = r"[^\x20\x09-\x0D]+"


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE_SQL[name] = sql
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ------------------------------------------------------------------ 1 token counts
PUNCTUATED = r"[\p{L}\p{N}]+|[^\p{L}\p{N}\x20\x09-\x0D]"

TOKEN_COUNTS_SQL = f"""
WITH f AS (SELECT *, coalesce(doc_id > min(doc_id) OVER (PARTITION BY coalesce(text, '')), false) AS copy FROM documents),
d AS (
  SELECT source, lang, coalesce(length(text), 0) AS chars,
    len(regexp_extract_all(coalesce(text, ''), '{WORD_RE}')) AS words,
    len(regexp_extract_all(coalesce(text, ''), '{PUNCTUATED}')) AS pieces
  FROM f WHERE NOT copy
), r AS (
  SELECT source, lang, 'words-1' AS tokenizer_version, chars, words AS n FROM d WHERE words < 200
  UNION ALL
  SELECT source, lang, 'pieces-1', chars, pieces FROM d WHERE words >= 200
)
SELECT source, lang, tokenizer_version, CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(chars) AS BIGINT) AS n_chars,
  CAST(sum(n) AS BIGINT) AS n_tokens
FROM r GROUP BY ALL
"""


@register("op1_token_counts", TOKEN_COUNTS_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three batches over all documents: all are inserted, counted in words; those of 200 words
    or more are revised to counts by a second tokenizer version; exact copies of a document with a smaller id are
    deleted, with the figures that they have by then.  The first two batches are then sent again, which changes nothing."""
    from varkit.llm.common import WORD, scratch, stored
    from varkit.llm.token_counts import Ledger, later_copies, state
    text = F.coalesce("text", F.lit(""))
    docs = stored(table(spark, sf_dir, "documents").select(
        "doc_id", "source", "lang", F.length(text).alias("chars"), F.regexp_count(text, F.lit(WORD)).alias("words"),
        F.regexp_count(text, F.lit(PUNCTUATED)).alias("pieces"), F.sha2(text, 256).alias("digest")), "counted")
    old = state("source", "lang", F.lit("words-1"), F.col("chars"), F.col("words"))
    new = state("source", "lang", F.lit("pieces-1"), F.col("chars"), F.col("pieces"))
    none = F.lit(None).cast("struct<source:string,lang:string,tokenizer_version:string,n_chars:bigint,n_tokens:bigint>")
    insert = docs.select(none.alias("old"), old.alias("new"))
    revise = docs.where("words >= 200").select(old.alias("old"), new.alias("new"))
    delete = later_copies(docs, "doc_id", "digest").select(F.when(F.col("words") >= 200, new).otherwise(old).alias("old"), none.alias("new"))
    ledger = Ledger(spark, scratch(spark, "token-counts"))
    for name, batch in (("0001-insert", insert), ("0002-revise", revise), ("0003-delete", delete),
                        ("0001-insert", insert), ("0002-revise", revise)):
        ledger.commit(name, batch)
    return ledger.totals()


# ------------------------------------------------------------------ 6 quality rules
def _quality_sql() -> str:
    from varkit.llm.quality import COMMON_WORDS, MAX_CHAR_DISTANCE, MAX_WORD_DISTANCE, MIN_CHARS, MIN_HISTOGRAM_WORDS
    from varkit.llm.quality import REFERENCE_CAPITALS, REFERENCE_SYMBOLS
    without = lambda pattern: f"length(t) - length(regexp_replace(t, '{pattern}', '', 'g'))"
    classes = [without(p) for p in (r"\p{Ll}", r"\p{Lu}", "[0-9]", r"[\x20\x09-\x0D]", r"[.,;:!?''\"()\-]", r"[#*$%&|<>]")]
    words = " ".join(f"WHEN '{k}' THEN [{', '.join(repr(w) for w in v)}]" for k, v in COMMON_WORDS.items())
    size = len(next(iter(COMMON_WORDS.values())))
    means = lambda a, n: "[" + ", ".join(f"avg({a}[{i}] / list_sum({a})) FILTER (list_sum({a}) > 0)" for i in range(1, n + 1)) + "]"
    def distance(a, b, n):
        x, y = f"({a}[i] / list_sum({a}))", f"({b}[i] / list_sum({b}))"
        part = lambda v: f"CASE WHEN {v} > 0 THEN {v} * log2({v} / (({x} + {y}) / 2)) ELSE 0 END"
        return (f"CASE WHEN list_sum({a}) > 0 AND list_sum({b}) > 0 THEN sqrt(greatest(0.0, list_sum(list_transform(range(1, {n + 1}), "
                f"lambda i: {part(x)} + {part(y)})) / 2)) END")
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS t FROM documents),
a AS (
  SELECT *, regexp_extract_all(t, '{WORD_RE}') AS w,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines,
    [{', '.join(classes)}] AS c6,
    CASE lang {words} END AS common,
    regexp_extract_all(regexp_replace(lower(t), '[.,;:!?''\"()\\-]+', '', 'g'), '{WORD_RE}') AS flat
  FROM d
), f AS (
  SELECT rid, doc_id, lang, t, length(t) AS chars, w, lines, c6, list_append(c6, length(t) - list_sum(c6)) AS c,
    CASE WHEN common IS NOT NULL THEN list_append(list_transform(common, lambda x: len(list_filter(flat, lambda y: y = x))),
      len(list_filter(flat, lambda y: NOT list_contains(common, y)))) END AS h
  FROM a
), g AS (
  SELECT rid, i, array_to_string(w[i:i + 4], ' ') AS x FROM f, unnest(range(1, greatest(len(w) - 3, 1))) u(i) WHERE len(w) >= 5
), o AS (
  SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt
  FROM (SELECT *, count(*) OVER (PARTITION BY rid, x) AS k FROM g) WHERE k > 1
), rep AS (SELECT rid, sum(least(5, coalesce(nxt - i, 5))) AS n FROM o GROUP BY rid),
r AS (
  SELECT lang, {means('c', 7)} AS rc, {means('h', size + 1)} AS rh
  FROM (SELECT DISTINCT ON (lang, t) f.* FROM f LEFT JOIN rep USING (rid)
        WHERE len(w) >= 10 AND 100 * coalesce(rep.n, 0) <= 20 * len(w)
          AND c[6] * {REFERENCE_SYMBOLS} <= chars AND c[2] * {REFERENCE_CAPITALS} <= chars) GROUP BY lang
), b AS (
  SELECT doc_id, chars, CAST(len(w) AS BIGINT) AS n_words, CAST(chars - c[4] AS BIGINT) AS word_chars, CAST(c[6] AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
    {distance('c', 'rc', 7)} AS dc, {distance('h', 'rh', size + 1)} AS dh
  FROM f LEFT JOIN rep USING (rid) LEFT JOIN r ON r.lang IS NOT DISTINCT FROM f.lang
), v AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, n_words >= {MIN_HISTOGRAM_WORDS} AS long,
    coalesce(dc > {MAX_CHAR_DISTANCE}, false) AS farc, coalesce(dh > {MAX_WORD_DISTANCE}, false) AS farh FROM b
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (chars >= {MIN_CHARS} AND farc AND (long OR farh) OR long AND farh) AS kept
FROM v
"""


@register("op6_quality", _quality_sql())
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from varkit.llm.quality import quality
    q = quality(table(spark, sf_dir, "documents"))
    return q.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


# ------------------------------------------------------------------ 10 URL filters
URL_FILTER_SQL = r"""
WITH u AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path,
    array_to_string(list_filter(string_split(coalesce(regexp_extract(url, '(?s)^.*?://[^?#]*\?([^#]*)', 1), ''), '&'),
      lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[^=]*|ref|gclid|fbclid)(=|$)')), '&') AS told
  FROM pages
), c AS (
  SELECT *, CASE WHEN host <> '' THEN regexp_replace(host, '^www\.', '') || regexp_replace(path, '/+$', '')
    || CASE WHEN told <> '' THEN '?' || told ELSE '' END END AS canon FROM u
), listed AS (
  SELECT DISTINCT canon FROM c
  WHERE canon IS NOT NULL AND regexp_matches(host, '(^|[.-])(ads|adult|bets|casino|pills|poker|porn|spam|track|tracker|xxx)([.-]|$)')
), r AS (
  SELECT page_id, host, path, canon, CASE
    WHEN (host = 'example.com' OR suffix(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'example.net' OR suffix(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'org' OR suffix(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR suffix(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM c
)
SELECT page_id, host, path, rule, canon IN (SELECT canon FROM listed) AND canon IS NOT NULL AS is_listed,
  CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
       WHEN canon IN (SELECT canon FROM listed) THEN 'block' ELSE 'allow' END AS verdict
FROM r
"""


@register("op10_url_filter", URL_FILTER_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list is taken from the crawl itself: URLs of hosts that are named after gambling, adult, pill, spam and tracking sites."""
    from varkit.llm.url_filter import bad_host_urls, judge_urls
    pages = table(spark, sf_dir, "pages")
    return judge_urls(pages, bad_host_urls(pages)).select("page_id", "host", "path", "rule", "is_listed", "verdict")


# ------------------------------------------------------------------ 7 mixing
@register("op7_mixing")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from varkit.llm.mixing import mix, taken_words
    return taken_words(mix(table(spark, sf_dir, "documents"))).select("doc_id", "size", "source_size", "target", "taken")


# ------------------------------------------------------------------ 9 WARC
WARC_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
h AS (SELECT page_id, octet_length(b) AS n, upper(sha1(b)) AS hex FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY hex) AS first FROM h),
bits AS (SELECT *, list_transform(range(0, 8), lambda g: ('0x' || substr(hex, CAST(g * 5 + 1 AS INTEGER), 5))::BIGINT) AS v FROM f)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(v, lambda x: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((x >> 15) & 31 AS INTEGER) + 1, 1)
    || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((x >> 10) & 31 AS INTEGER) + 1, 1)
    || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((x >> 5) & 31 AS INTEGER) + 1, 1)
    || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(x & 31 AS INTEGER) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM bits
"""


@register("op9_warc", WARC_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from varkit.llm.common import scratch
    from varkit.llm.warc import read_archives, write_archives
    path = scratch(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    return read_archives(spark, path)


# ------------------------------------------------------------------ 5 BPE
def byte_bpe_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


@register("op5_bpe")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from varkit.llm.bpe import encode_documents
    return encode_documents(table(spark, sf_dir, "documents"), byte_bpe_path(), with_ids=False)


# ------------------------------------------------------------------ 8 n-gram Jaccard join
JACCARD_SQL = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD_RE}') AS w
  FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS g FROM w
), n AS (SELECT doc_id, CAST(len(g) AS BIGINT) AS n FROM s),
e AS (SELECT doc_id, unnest(g) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
sym AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach(doc_id, r) AS (
  SELECT doc_id, doc_id FROM n UNION SELECT reach.doc_id, sym.b FROM reach JOIN sym ON reach.r = sym.a
)
SELECT doc_id, n AS n_shingles, min(r) AS component_id FROM n JOIN reach USING (doc_id) GROUP BY doc_id, n
"""


@register("op8_jaccard", JACCARD_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from varkit.llm.jaccard import near_duplicates
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


# ------------------------------------------------------------------ 3 HTML extraction
@register("op3_html")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from varkit.llm.sitetree import extract
    return extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


# ------------------------------------------------------------------ 4 nearest neighbours
@register("op4_nearest")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from varkit.llm.nearest import search
    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.where("vec_id % 50 = 0")).select("query_id", "rank", F.col("id").alias("vec_id"), "score")


# ------------------------------------------------------------------ 2 token-id files
@register("op2_token_files")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    from tokenizers import Tokenizer

    from varkit.llm.common import scratch
    from varkit.llm.token_files import read_documents, write_token_files
    tokenizer, path = public_tokenizers.path("word_bpe_49k.json"), scratch(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), path, tokenizer)
    size = Tokenizer.from_file(tokenizer).get_vocab_size(with_added_tokens=True)
    return read_documents(spark, path, size).withColumnRenamed("id", "doc_id")


# ------------------------------------------------------------------ 13 filter interaction audit
FILTER_AUDIT_SQL = f"""
WITH w AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '{WORD_RE}') AS w FROM documents
), first AS (SELECT t, min(doc_id) AS first FROM w GROUP BY t),
marks AS (
  SELECT doc_id, max(CAST(quality = 1 AS INTEGER)) AS good, max(CAST(toxic = 1 AS INTEGER)) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), d AS (
  SELECT rid, part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, [
      len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w),
      100 * (length(w.t) - length(regexp_replace(w.t, '[A-Z]', '', 'g'))) > 3 * length(w.t),
      regexp_matches(w.t, '[#$%&*|]'), coalesce(doc_id > first, false)] AS fails
  FROM w JOIN first ON first.t = w.t LEFT JOIN marks USING (doc_id)
), cells AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM d GROUP BY ALL),
ids AS (SELECT unnest([1, 2, 3, 4, 5]) AS i),
orders AS (
  SELECT [a.i, b.i, c.i, e.i, f.i] AS o FROM ids a, ids b, ids c, ids e, ids f
  WHERE len(list_distinct([a.i, b.i, c.i, e.i, f.i])) = 5
), steps AS (
  SELECT o, i AS step, o[i] AS f, o[1:i - 1] AS earlier, list_aggregate(list_transform(o, lambda x: substr('ABCDE', x, 1)), 'string_agg', '') AS filter_order
  FROM orders, ids
), x AS (
  SELECT part, filter_order, step, f, n, good, toxic, fails[f] AS bad,
    len(list_filter(earlier, lambda e: fails[e])) > 0 AS gone, len(list_filter(fails, lambda y: y)) AS n_fails FROM cells, steps
), y AS (
  SELECT part, filter_order, step, f, sum(n) FILTER (NOT bad AND NOT gone) AS kept, sum(n) FILTER (bad AND NOT gone) AS removed,
    sum(n) FILTER (bad AND gone) AS redundant, sum(n) FILTER (bad AND n_fails = 1) AS unique_fails,
    sum(good) FILTER (bad AND NOT gone) AS good_lost, sum(toxic) FILTER (bad AND NOT gone) AS toxic_lost
  FROM x GROUP BY ALL
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed,
  CAST(coalesce(redundant, 0) AS BIGINT) AS redundant, CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails,
  CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
  CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM y
"""


@register("op13_filter_audit", FILTER_AUDIT_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from varkit.llm.filter_audit import audit
    docs = table(spark, sf_dir, "documents").withColumn("lang", F.coalesce("lang", F.lit("")))
    return audit(docs, table(spark, sf_dir, "labels"))


# ------------------------------------------------------------------ 11 ranked lexical search
_TERM_RE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_TERMS = (f"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_TERM_RE}')")

LEXICAL_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_TERMS} AS w FROM documents),
s AS (SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(len(w)) AS BIGINT) AS l FROM d WHERE len(w) > 0),
q AS (SELECT row_number() OVER () AS qid, item_id, {_TERMS} AS w FROM benchmark),
qt AS (SELECT DISTINCT qid, item_id, unnest(w) AS x FROM q),
p AS (SELECT rid, doc_id, n, x, count(*) AS tf FROM (SELECT rid, doc_id, len(w) AS n, unnest(w) AS x FROM d) WHERE x IN (SELECT x FROM qt) GROUP BY ALL),
f AS (SELECT x, count(*) AS df FROM p GROUP BY x),
i AS (
  SELECT rid, doc_id, p.x, CAST(floor(1000 * ln((2 * s.n + 2) / (2 * f.df + 1))) AS BIGINT)
    * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * p.n * s.n) // s.l)))) AS part
  FROM p JOIN f USING (x), s
), r AS (
  SELECT qid, item_id, rid, doc_id, CAST(sum(part) AS BIGINT) AS score FROM qt JOIN i USING (x) GROUP BY ALL HAVING sum(part) > 0
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM r) WHERE rank <= 50
"""


@register("op11_lexical", LEXICAL_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    from varkit.llm.lexical import search
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


# ------------------------------------------------------------------ 12 toxicity
@register("op12_toxicity")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from varkit.llm.toxicity import score_documents
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
