"""Toxicity scores: gradient-boosted trees over dense text features, calibrated by isotonic regression.

* The *lexicon* is learned: words and word beginnings (4 or 5 characters) whose share of toxic texts is
  far above that of other texts, each with its log odds.  While the model is fitted, a text is read with
  the lexicon of the other folds, so its features are those of a text not seen before.
* The *trees* (Spark ML ``GBTClassifier``) work on dense features of a text: lexicon densities and
  strengths, nearness of lexicon words to words of the second person, capitals, punctuation, and rates
  of obfuscated spelling (digits or symbols for letters, separators between letters, stretched letters).
* The *calibration* is an isotonic map from the trees' probability to the share of toxic texts, fitted on
  folds that the trees have not seen.

Labels are read from rows for which ``crc32(doc_id) mod 3`` is not 1, at most about ``TRAIN_ROWS`` of
them: beyond that a row is taken when a hash of its id is below a threshold.  A text that occurs several
times counts once, as toxic if any of its rows is, and belongs to one fold, so a group of copies has no
weight of its own.  The three fits read the bounded sample only; scoring is map-only over all rows, whole
texts, and never sees labels, lang, source or ids.

Edge cases: NULL text counts as empty; empty texts get the score of their (zero) features.  A NULL id is
not held out and has no label.  NULL labels are no labels; with several label rows the largest counts.
Where the tree folds have only one class (no labels, an empty table) every text gets the share of toxic
texts in the sample, 0 without any.  Repeated rows are scored one by one.  Only named columns are read.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varkit.llm.common import stored

#: Bound on the labelled rows a model is fitted on.
TRAIN_ROWS = 24_000
#: Folds by hash of the text: those of the trees; the rest calibrate.
FOLDS, TREE_FOLDS = 5, (0, 1, 2)
#: A lexicon entry has so many toxic texts at least, such a share of them, and such log odds; so many entries at most, the strongest.
MIN_TEXTS, MIN_SHARE, MIN_LOG_ODDS, LEXICON_SIZE = 2, 0.004, 2.5, 5_000
STEMS = (4, 5)
#: Lexicon words count as addressed to someone when a word of the second person is so many words away at most.
NEAR = 5
TREES = dict(maxIter=20, maxDepth=3, stepSize=0.3, maxBins=32, minInstancesPerNode=3, seed=7)
#: Scores from here on are predicted toxic.
THRESHOLD = 0.7

# Words of the second person (en, fr, de, es).
SECOND_PERSON = frozenset(
    "you your yours yourself yourselves u ur tu te toi ton ta tes vous votre vos du dich dir dein deine deinen deiner ihr euch euer eure "
    "ti tus tuyo tuya usted ustedes vosotros vuestro vuestra".split())
# Characters written in place of letters.
LOOKALIKES = str.maketrans("013457@$!", "oleastasi")

FEATURES = ["log_words", "hit_share", "strength_share", "top_strength", "log_hits", "distinct_hits", "near_share", "near_hits",
            "capital_share", "shout_share", "mark_share", "exclaim_share", "disguised_share", "disguised_hits", "stretched_share"]

_EDGE = " \t.,;:!?\"'()[]{}<>«»„“”¿¡…-_*/\\|"
_INNER = re.compile(r"(?<=\w)[.\-_*'|/\\]+(?=\w)")
_MIXED = re.compile(r"[^\W\d_][0-9@$!*]+[^\W\d_]")
_STRETCH = re.compile(r"(\w)\1{2,}")


_SHOUT = re.compile(rb"\b[A-Z]{3,}\b")


def plain_spelling(word: str) -> str:
    """A trimmed lower-case word as it reads without separators, stretched letters and lookalikes."""
    word = _STRETCH.sub(r"\1", _INNER.sub("", word))
    return word.translate(LOOKALIKES) if any(c.isalpha() for c in word) else word


def keys(word: str) -> list[str]:
    """What a word can match in the lexicon: itself, and its beginnings that are shorter than it."""
    return ["=" + word] + ["^" + word[:n] for n in STEMS if len(word) > n]


def trimmed_words(low: str) -> set[str]:
    return {w if w.isalpha() else w.strip(_EDGE) for w in set(low.split())} - {""}


class Reader:
    """Features of texts under a lexicon."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon
        # a word can match only if it begins as some entry does
        self.heads = {k[1:4] for k in lexicon}

    def strength(self, word: str) -> float:
        return max(self.lexicon.get(k, 0.0) for k in keys(word)) if word[:3] in self.heads else 0.0

    def features(self, text: bytes) -> list[float]:
        low = text.decode("utf-8", "replace").lower()
        words = low.split()
        hits = distinct = disguised = hidden = stretched = near = 0
        total = top = 0.0
        found: dict[str, float] = {}
        any_stretch = _STRETCH.search(low) is not None
        heads = self.heads
        for raw, k in Counter(words).items():
            word, veiled = raw, False
            if not raw.isalpha():
                word = raw.strip(_EDGE)
                if not word:
                    continue
                if not word.isalpha():
                    separators = len(_INNER.findall(word))
                    veiled = bool(_MIXED.search(word)) or (separators > 1 and 2 * separators >= len(word) - separators - 1)
                    disguised += k * veiled
            long = any_stretch and _STRETCH.search(word) is not None
            stretched += k * long
            s = self.strength(word) if word[:3] in heads else 0.0
            if not s and (veiled or long):
                s = self.strength(plain_spelling(word))
                hidden += k * (s > 0)
            if s:
                found[raw] = s
                hits, distinct, total, top = hits + k, distinct + 1, total + k * s, max(top, s)
        if hits:
            near = self._near(words, found)
        n, size = max(len(words), 1), max(len(text), 1)
        without = lambda chars: len(text) - len(text.translate(None, chars))
        return [math.log1p(len(words)), hits / n, total / n, top, math.log1p(hits), float(distinct), near / n, float(near),
                without(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ") / size, len(_SHOUT.findall(text)) / n, without(b".,;:!?\"'()-*#$%&@") / size,
                without(b"!?") / size, disguised / n, float(hidden), stretched / n]

    @staticmethod
    def _near(words: list[str], found: dict[str, float]) -> int:
        """Lexicon words with a word of the second person at most ``NEAR`` words before or after."""
        near, last, waiting = 0, -NEAR - 1, []
        for at, raw in enumerate(words):
            if raw.strip(_EDGE) in SECOND_PERSON:
                near += sum(at - w <= NEAR for w in waiting)
                last, waiting = at, []
            if raw in found:
                if at - last <= NEAR:
                    near += 1
                else:
                    waiting.append(at)
        return near


def crc_of_id(id_col: str = "doc_id") -> Column:
    return F.crc32(F.col(id_col).cast("long").cast("string").cast("binary")) % 3


def _text(text: str) -> Column:
    return F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")


def sample(docs: DataFrame, labels: DataFrame, bound: int = TRAIN_ROWS) -> DataFrame:
    """``text, toxic, fold`` of the labelled training rows, one row per text, from about ``bound`` rows at most."""
    marks = (labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
             .agg(F.max((F.col("toxic") == 1).cast("int")).alias("toxic")).where(crc_of_id() != 1))
    rows = marks.count()
    if rows > bound:
        marks = marks.where(F.pmod(F.xxhash64("doc_id", F.lit("train")), F.lit(1 << 20)) < F.lit(int(bound / rows * (1 << 20))))
    # the marks are bounded by ``bound``, which is what allows the broadcast
    x = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _text("text").alias("text")).join(F.broadcast(marks), "doc_id")
    x = x.groupBy("text").agg(F.max("toxic").alias("toxic"))
    return x.withColumn("fold", (F.crc32("text") % FOLDS).cast("int"))


def learn_lexicons(texts: DataFrame) -> list[dict[str, float]]:
    """From ``text, toxic, fold`` rows: per fold the lexicon of all other folds, and last that of all of them."""
    names = [f"{kind}{f}" for kind in ("clean", "toxic") for f in range(FOLDS)]

    def count(batches):
        def flush():
            return pa.RecordBatch.from_arrays([pa.array(list(seen))] + [pa.array(x, pa.int64()) for x in zip(*seen.values())], ["key", *names])
        seen: dict[str, list] = {}
        for b in batches:
            for text, toxic, fold in zip(b.column(0), b.column(1).to_pylist(), b.column(2).to_pylist()):
                at = toxic * FOLDS + fold
                for key in {k for w in trimmed_words(text.as_py().decode("utf-8", "replace").lower()) for k in keys(w)}:
                    row = seen.get(key)
                    if row is None:
                        row = seen[key] = [0] * len(names)
                    row[at] += 1
                if len(seen) > 200_000:
                    yield flush()
                    seen = {}
        if seen:
            yield flush()

    sizes = [[0] * FOLDS, [0] * FOLDS]
    for r in texts.groupBy("toxic", "fold").agg(F.count(F.lit(1)).alias("n")).collect():
        sizes[r["toxic"]][r["fold"]] = r["n"]
    counted = texts.select("text", "toxic", "fold").mapInArrow(count, "key string, " + ", ".join(f"{n} long" for n in names))
    counted = counted.groupBy("key").agg(*[F.sum(n).alias(n) for n in names])
    clean, toxic = (sum((F.col(n) for n in names[i:i + FOLDS]), F.lit(0)) for i in (0, FOLDS))
    odds = F.log((toxic + 0.5) / F.lit(sum(sizes[1]) + 1.0)) - F.log((clean + 0.5) / F.lit(sum(sizes[0]) + 1.0))
    support = lambda n: max(MIN_TEXTS, MIN_SHARE * n)
    entries = (counted.where(toxic >= MIN_TEXTS).withColumn("odds", odds).where(F.col("odds") >= MIN_LOG_ODDS)
               .orderBy(F.col("odds").desc(), "key").limit(LEXICON_SIZE).collect())
    lexicons = []
    for left_out in [*range(FOLDS), None]:
        of = [f for f in range(FOLDS) if f != left_out]
        n_clean, n_toxic = (sum(sizes[i][f] for f in of) + 1.0 for i in (0, 1))
        lexicon = {}
        for r in entries:
            t, c = sum(r[f"toxic{f}"] for f in of), sum(r[f"clean{f}"] for f in of)
            strength = math.log((t + 0.5) / n_toxic) - math.log((c + 0.5) / n_clean)
            if t >= support(n_toxic) and strength >= MIN_LOG_ODDS:
                lexicon[r["key"]] = strength
        lexicons.append(lexicon)
    return lexicons


def with_features(rows: DataFrame, lexicons: list[dict[str, float]]) -> DataFrame:
    """``rows`` with ``text`` (bytes) replaced by ``features``, an array of doubles: by the lexicon of the
    row's ``fold`` if there is such a column, else by the last."""
    from pyspark.sql import types as T
    kept = [f for f in rows.schema.fields if f.name != "text"]
    by_fold = "fold" in rows.columns

    def run(batches):
        readers = [Reader(x) for x in lexicons]
        for b in batches:
            fold = b.column(b.schema.get_field_index("fold")).to_pylist() if by_fold else [-1] * b.num_rows
            values = [readers[f].features(t.as_py()) for f, t in zip(fold, b.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array(values, pa.list_(pa.float64()))] + [b.column(i) for i in range(1, b.num_columns)],
                                             ["features"] + [f.name for f in kept])
    schema = T.StructType([T.StructField("features", T.ArrayType(T.DoubleType())), *kept])
    return rows.select("text", *[f.name for f in kept]).mapInArrow(run, schema)


class Scorer:
    """A fitted lexicon, its trees and its calibration; ``share`` alone where there is nothing to learn from."""

    def __init__(self, lexicon: dict[str, float], trees, calibration, share: float):
        self.lexicon, self.trees, self.calibration, self.share = lexicon, trees, calibration, share

    def raw(self, rows: DataFrame) -> DataFrame:
        """``rows`` (with array ``features``) with the trees' probability in ``raw``."""
        from pyspark.ml.functions import array_to_vector, vector_to_array
        kept = [c for c in rows.columns if c != "features"]
        out = self.trees.transform(rows.withColumn("features", array_to_vector("features")))
        return out.select(*kept, vector_to_array("probability")[1].alias("raw"))

    def score(self, rows: DataFrame) -> DataFrame:
        """``rows`` (``text`` as bytes and other columns) with ``score`` in place of the text."""
        kept = [c for c in rows.columns if c != "text"]
        if self.trees is None:
            return rows.select(*kept, F.lit(self.share).alias("score"))
        out = self.raw(with_features(rows, [self.lexicon]))
        if self.calibration is not None:
            out = self.calibration.transform(out).withColumnRenamed("calibrated", "raw_score")
        else:
            out = out.withColumn("raw_score", F.col("raw"))
        return out.select(*kept, F.least(F.greatest("raw_score", F.lit(0.0)), F.lit(1.0)).alias("score"))


def fit(docs: DataFrame, labels: DataFrame, bound: int = TRAIN_ROWS) -> Scorer:
    """Fit the three parts on their folds of the labelled sample."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import IsotonicRegression
    texts = stored(sample(docs, labels, bound), "toxicity-sample")
    counts = texts.agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("toxic"),
                       F.count_distinct(F.when(F.col("fold").isin(*TREE_FOLDS), F.col("toxic"))).alias("classes")).collect()[0]
    share = (counts["toxic"] or 0) / counts["n"] if counts["n"] else 0.0
    if counts["classes"] < 2:
        return Scorer({}, None, None, share)
    lexicons = learn_lexicons(texts)
    rest = stored(with_features(texts, lexicons), "toxicity-features")
    tree_rows = rest.where(F.col("fold").isin(*TREE_FOLDS)).select(array_to_vector("features").alias("features"), F.col("toxic").cast("double").alias("label"))
    trees = GBTClassifier(featuresCol="features", labelCol="label", **TREES).fit(tree_rows)
    scorer = Scorer(lexicons[-1], trees, None, share)
    held = scorer.raw(rest.where(~F.col("fold").isin(*TREE_FOLDS))).select("raw", F.col("toxic").cast("double").alias("label"))
    if held.agg(F.count_distinct("label")).collect()[0][0] == 2:
        scorer.calibration = IsotonicRegression(featuresCol="raw", labelCol="label", predictionCol="calibrated").fit(held)
    return scorer


def score_documents(docs: DataFrame, labels: DataFrame, bound: int = TRAIN_ROWS) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document, by a model fitted on the labels that are not held out."""
    scorer = fit(docs, labels, bound)
    rows = docs.select(_text("text").alias("text"), F.col("doc_id").cast("long").alias("doc_id"))
    out = scorer.score(rows)
    return out.select("doc_id", F.coalesce(crc_of_id() == 1, F.lit(False)).alias("held_out"), "score",
                      (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
