"""Quality rules by distribution divergence, in DataFrame functions only.

A document is a probability distribution over character classes and over the common words of
its language.  Both are compared with the language's reference by the Jensen-Shannon distance
(base 2, so 0 to 1).  The reference of a language is gathered from the whole corpus: the mean of the histograms of
the distinct texts of that ``lang`` that pass the base rules and read like text (few symbols, few capitals).  Every
such text weighs one, whatever its length and however many copies it has, so neither a group of copies nor long junk bends a
reference.  Documents too short for a histogram to mean anything are left to the base rules (the minimum-length guards).

All of a document's figures come from its own row; the references (one row per language) take one aggregate by
language and digest of the text, which drops copies map-side, and one by language; they are joined back by language.

Edge cases: NULL text counts as empty; an empty document has zero words and fails the base
rules.  A NULL or unknown ``lang`` has its own character-class reference and no common words; a
language with no reference text passes the comparison.  Repeated rows are judged one by one.
Only the id, text and lang columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varkit.llm.common import SPACES, stored, text_or_empty

# Common words by language.
COMMON_WORDS = {
    "en": "the of and to a in is that it for was on with as be by this are at from".split(),
    "fr": "de la le et les des en un du une que pour est par dans qui avec pas sur au".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im nicht dem ein eine als".split(),
    "es": "de la que el en y los se las del un por con no su una para es al lo".split(),
}

#: Base rules.
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
#: A document belongs to the reference when symbols are at most 1/50 and capitals at most 1/3 of its characters.
REFERENCE_SYMBOLS, REFERENCE_CAPITALS = 50, 3
#: Minimum-length guards and largest distances: character classes, then common words.
MIN_CHARS, MAX_CHAR_DISTANCE = 200, 0.20
MIN_HISTOGRAM_WORDS, MAX_WORD_DISTANCE = 100, 0.285

#: References of up to so many languages (2 KB each) are broadcast; more are joined by a shuffle.
BROADCAST_LANGUAGES = 1000

CLASSES = ("lower", "upper", "digit", "space", "mark", "symbol", "other")


def _bind(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once however often ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def _pairs(a: Column, b: Column, f, skip: int = 1) -> Column:
    """``f(a[i], b[i + skip])`` for every i for which both are there."""
    n = F.greatest(F.size(b) - skip, F.lit(0))
    return F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1 + skip), n), f)


def _repeat_words(words: Column) -> Column:
    """Words in windows of five words that occur twice or more, the first occurrence included.

    Windows are 64-bit hashes, put together from word hashes by pairs.  Most documents repeat
    no window and stop there; in others a sort brings equal windows together.
    """
    zero = F.lit(0).cast("long")
    mix = lambda x, y: F.xxhash64(x, y)

    def windows(h):
        return _bind(_pairs(h, h, mix), lambda two: _bind(_pairs(two, two, mix, 2), lambda four: _pairs(four, h, mix, 4)))

    def positions(s):
        same = _pairs(s, s, lambda x, y: x["h"] == y["h"])
        return _bind(same, lambda e: F.sort_array(F.filter(F.zip_with(
            s, F.zip_with(F.concat(F.array(F.lit(False)), e), F.concat(e, F.array(F.lit(False))), lambda x, y: x | y),
            lambda x, twice: F.when(twice, x["i"])), lambda i: i.isNotNull())))

    def covered(p):
        steps = _pairs(p, p, lambda x, y: F.least(F.lit(5), y - x))
        return F.aggregate(steps, F.lit(5).cast("long"), lambda total, x: total + x)

    def count(w):
        keyed = F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return (F.when(F.size(F.array_distinct(w)) == F.size(w), zero)
                .otherwise(_bind(_bind(keyed, positions), covered)))

    hashes = F.transform(words, lambda x: F.xxhash64(x))
    return F.when(F.size(words) < 6, zero).otherwise(_bind(_bind(hashes, windows), count))


def base_figures(text: Column, words: Column, classes: Column) -> dict[str, Column]:
    """The base columns; ``text`` is not NULL, ``words`` are its words and ``classes`` its
    ``class_counts``."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": (F.aggregate(classes, F.lit(0), lambda a, x: a + x) - classes[3]).cast("long"),
        "n_symbols": classes[5].cast("long"),
        "n_dup_lines": _bind(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": _repeat_words(words),
    }


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACES), lambda x: x != "")


def class_counts(text: Column) -> Column:
    """Characters by class, in the order of ``CLASSES``.  Each class is taken out of what the
    classes before it have left."""
    patterns = (r"\p{Ll}+", r"\p{Lu}+", r"[0-9]+", SPACES, r"[.,;:!?'\"()\-]+", r"[#*$%&|<>]+")

    def rest(left: Column, length: Column, i: int) -> Column:
        if i == len(patterns):
            return F.array(length)
        after = F.regexp_replace(left, patterns[i], "")
        return _bind(after, lambda t: _bind(F.length(t), lambda n: F.concat(F.array(length - n), rest(t, n, i + 1))))

    return rest(text, F.length(text), 0)


def word_counts(text: Column, lang: Column) -> Column:
    """Counts of the language's common words, in lower case and without marks, then of all
    other words; NULL for a language without a list."""
    flat = words_of(F.regexp_replace(F.lower(text), r"[.,;:!?'\"()\-]+", ""))

    def counts(words):
        def of(common, total):
            each = F.transform(F.array(*[F.lit(w) for w in words]), lambda w: F.size(common) - F.size(F.array_remove(common, w)))
            return F.concat(each, F.array(total - F.size(common)))
        return lambda all_words: _bind(F.filter(all_words, lambda x: x.isin(words)), lambda c: of(c, F.size(all_words)))

    out = None
    for name, words in COMMON_WORDS.items():
        c = _bind(flat, counts(words))
        out = F.when(lang == name, c) if out is None else out.when(lang == name, c)
    return out


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two arrays of counts of the same length; NULL where either is
    NULL or sums to zero."""
    zero = F.lit(0.0)
    def total(a):
        return F.aggregate(a, zero, lambda s, x: s + x)

    def kl(x, m):
        return F.when(x > 0, x * F.log2(x / m)).otherwise(zero)

    def divergence(a, sa, b, sb):
        terms = F.zip_with(a, b, lambda x, y: _bind(F.struct((x / sa).alias("x"), (y / sb).alias("y"), ((x / sa + y / sb) / 2).alias("m")),
                                                    lambda z: kl(z["x"], z["m"]) + kl(z["y"], z["m"])))
        return F.sqrt(F.greatest(zero, F.aggregate(terms, zero, lambda s, x: s + x) / 2))

    sums = F.struct(total(p).alias("p"), total(q).alias("q"))
    return _bind(sums, lambda s: F.when((s["p"] > 0) & (s["q"] > 0), divergence(p, s["p"], q, s["q"])))


def _doubles(a: Column) -> Column:
    return F.transform(a, lambda x: x.cast("double"))


def _figures(docs: DataFrame, columns: tuple[str, ...], text_col: str, lang_col: str) -> DataFrame:
    """Per row, in one pass over its text: ``_row`` (the given columns), ``_l`` (language), ``_h`` (digest), ``_chars``, the base
    columns, ``base_failed`` and both histograms, ``_cc`` and ``_wc``."""
    d = docs.select((F.struct(*[F.col(f"`{c}`") for c in columns]) if columns else F.lit(None)).alias("_row"),
                    text_or_empty(text_col).alias("_t"), F.col(f"`{lang_col}`").cast("string").alias("_l"))
    d = d.withColumns({"_w": words_of(F.col("_t")), "_cc": class_counts(F.col("_t"))})
    figures = base_figures(F.col("_t"), F.col("_w"), F.col("_cc"))
    d = d.select("_row", "_l", F.md5("_t").alias("_h"), F.length("_t").alias("_chars"), *[c.alias(k) for k, c in figures.items()],
                 "_cc", word_counts(F.col("_t"), F.col("_l")).alias("_wc"))
    return d.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


def _shares(counts: Column) -> Column:
    """The counts' shares; NULL where there are none."""
    return _bind(F.aggregate(counts, F.lit(0.0), lambda s, x: s + x), lambda n: F.when(n > 0, F.transform(counts, lambda x: x / n)))


def _reference_of(figures: DataFrame) -> DataFrame:
    reads = (~F.col("base_failed") & (F.col("_cc")[5] * REFERENCE_SYMBOLS <= F.col("_chars"))
             & (F.col("_cc")[1] * REFERENCE_CAPITALS <= F.col("_chars")))
    # the filter stays above the aggregate: below, it would compute the histograms twice
    once = figures.groupBy("_l", "_h").agg(F.first(reads).alias("reads"), F.first("_cc").alias("c"), F.first("_wc").alias("w")).where("reads")
    once = once.select("_l", _shares(F.col("c")).alias("c"), _shares(F.col("w")).alias("w"))
    size = len(next(iter(COMMON_WORDS.values()))) + 1
    means = lambda a, n: F.array(*[F.avg(F.col(a)[i]) for i in range(n)])
    return (once.groupBy("_l").agg(means("c", len(CLASSES)).alias("c"), means("w", size).alias("w"))
            .select(F.col("_l").alias("_lang"), F.col("c").alias("_class_reference"),
                    F.when(F.col("w")[0].isNotNull(), F.col("w")).alias("_word_reference")))


def references(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per language: mean class shares and common-word shares of its reference texts."""
    return _reference_of(_figures(docs, (), text_col, lang_col))


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
            reference: DataFrame | None = None, keep_columns: tuple[str, ...] = ()) -> DataFrame:
    """Base figures, both distances and the verdict per document.

    ``kept`` is false when the base rules fail.  A text of ``MIN_HISTOGRAM_WORDS`` words or
    more is also rejected when either distance is over its limit, a shorter one
    of at least ``MIN_CHARS`` characters only when both are.  ``reference`` is a result of ``references()`` over another corpus;
    by default it is gathered from ``docs``.
    """
    d = _figures(docs, (id_col, *keep_columns), text_col, lang_col)
    if reference is None and not keep_columns:
        d = stored(d, "quality-figures")                             # small rows; carried columns may hold the texts
        reference = _reference_of(d)
    ref = stored(references(docs, text_col, lang_col) if reference is None else reference, "quality-reference")
    if ref.count() <= BROADCAST_LANGUAGES:
        ref = F.broadcast(ref)
    figures = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    d = d.join(ref, F.col("_l").eqNullSafe(F.col("_lang")), "left")
    d = d.select("_row", "_chars", *figures, "base_failed",
                 js_distance(_doubles(F.col("_cc")), F.col("_class_reference")).alias("char_distance"),
                 js_distance(_doubles(F.col("_wc")), F.col("_word_reference")).alias("word_distance"))
    far = lambda c, most: F.coalesce(F.col(c) > most, F.lit(False))
    long_enough = F.col("n_words") >= MIN_HISTOGRAM_WORDS
    odd = ((F.col("_chars") >= MIN_CHARS) & far("char_distance", MAX_CHAR_DISTANCE) & (long_enough | far("word_distance", MAX_WORD_DISTANCE))
           | long_enough & far("word_distance", MAX_WORD_DISTANCE))
    return d.select("_row.*", *figures, "base_failed", "char_distance", "word_distance",
                    (~F.col("base_failed") & ~odd).alias("kept"))
