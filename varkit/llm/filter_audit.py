"""Audit of how quality filters interact, by contractions of a contingency tensor.

Every document passes or fails each of five filters.  Per part (language) the documents are
counted in a 2 x 2 x 2 x 2 x 2 tensor, one axis per filter, index 0 for pass and 1 for fail.  All
figures of the audit are contractions of that tensor: along each axis one of three vectors selects
pass, fail or all, so one ``einsum`` with the 3 x 2 matrix of these vectors on every axis yields the
3^5 possible sums, and each (order, step) reads its own: a filter at some step of an order *keeps*
the documents that pass it and all before it, *removes* those that pass all before it and fail it.

Filters (a text is NULL: empty; a word is a maximal run of characters other than space and U+0009..U+000D):

* A: under ``MIN_WORDS`` words;
* B: 100 * distinct words < ``DISTINCT_PERCENT`` * words;
* C: 100 * ``[A-Z]`` characters > ``CAPITAL_PERCENT`` * code points;
* D: holds any of ``SYMBOLS``;
* E: identical to the text of a smaller doc_id, anywhere in the table.

Plan: one scan computes a digest and the four text filters per document.  Documents meet their
labels by id, are counted by (digest, part, filters, labels) with map-side combining, so a group of
copies is a few rows before any join, and the smallest id of a digest decides filter E.  At most 32
rows per part remain; tensors are contracted a batch of parts at a time inside tasks.

Edge cases: an id that is NULL fails no E and makes nobody else fail it; rows of one id with one text
are no copies of each other.  A NULL part is a part of its own in the operator (the registered query
shows it as an empty string).  Several label rows of an id count as good or toxic when any of them is.
An empty table has no parts and no rows.  Only the named columns are read, so extra columns can't clash.
"""

from __future__ import annotations

import hashlib
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FILTERS = "ABCDE"
MIN_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT, SYMBOLS = 200, 50, 3, b"#$%&*|"

CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
CONTINUATION = bytes(range(0x80, 0xC0))

#: Rows of the selection matrix: what of an axis a contraction sums.
PASS, FAIL, ALL = 0, 1, 2
SELECT = np.array([[1, 0], [0, 1], [1, 1]], np.int64)

#: The audit's measures, one tensor each.
MEASURES = ("n", "good", "toxic")
FIGURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def text_failures(text: bytes) -> int:
    """Filters A to D as bits 0 to 3 (set: the text fails), from its UTF-8 bytes."""
    words = text.split()  # bytes split at space and U+0009..U+000D only
    points = len(text) if text.isascii() else len(text.translate(None, CONTINUATION))
    capitals = len(text) - len(text.translate(None, CAPITALS))
    return ((len(words) < MIN_WORDS) | (100 * len(set(words)) < DISTINCT_PERCENT * len(words)) << 1
            | (100 * capitals > CAPITAL_PERCENT * points) << 2 | (len(text.translate(None, SYMBOLS)) < len(text)) << 3)


def _judge(batches):
    for b in batches:
        texts = b.column(2).to_pylist()
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary()),
             pa.array([text_failures(t) for t in texts], pa.int32())], ["doc_id", "part", "digest", "fails"])


def contract(tensor: np.ndarray) -> np.ndarray:
    """All 3^5 selections of (parts, 2, 2, 2, 2, 2) tensors at once: (parts, 3, 3, 3, 3, 3)."""
    return np.einsum("pabcde,ia,jb,kc,ld,me->pijklm", tensor, SELECT, SELECT, SELECT, SELECT, SELECT, optimize=True)


def audit_steps(tensors: dict[str, np.ndarray]) -> list[tuple[str, int, dict[str, np.ndarray]]]:
    """``(order, step, figures)`` for all orders and steps; a figure has one value per part."""
    sums = {m: contract(t) for m, t in tensors.items()}
    out, shapley = [], {f: 0 for f in FILTERS}
    for order in permutations(range(len(FILTERS))):
        at = [ALL] * len(FILTERS)
        for step, f in enumerate(order, 1):
            pick = lambda m, choice: sums[m][(slice(None), *at[:f], choice, *at[f + 1:])]  # noqa: B023,E731
            removed = pick("n", FAIL)
            alone = [PASS] * len(FILTERS)
            alone[f] = FAIL
            failing = [ALL] * len(FILTERS)
            failing[f] = FAIL
            out.append(("".join(FILTERS[i] for i in order), step, {
                "kept": pick("n", PASS), "removed": removed, "redundant": sums["n"][(slice(None), *failing)] - removed,
                "unique_fails": sums["n"][(slice(None), *alone)], "good_lost": pick("good", FAIL), "toxic_lost": pick("toxic", FAIL)}))
            shapley[FILTERS[f]] = shapley[FILTERS[f]] + removed
            at[f] = PASS
    for order, step, figures in out:
        figures["shapley"] = shapley[order[step - 1]]
    return out


def _audit(batches):
    shape = (-1,) + (2,) * len(FILTERS)
    for b in batches:
        if not b.num_rows:
            continue
        # bit i of the pattern is filter i, so the last filter is the slowest axis of the flat array
        tensors = {m: np.stack([np.asarray(x, np.int64) for x in b.column(1 + i).to_pylist()]).reshape(shape).transpose(0, 5, 4, 3, 2, 1)
                   for i, m in enumerate(MEASURES)}
        for order, step, figures in audit_steps(tensors):
            k = b.num_rows
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([order] * k), pa.array([step] * k, pa.int32())] + [pa.array(figures[f], pa.int64()) for f in FIGURES],
                ["part", "filter_order", "step", *FIGURES])


def patterns(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, pattern, n, good, toxic``: documents per part by what they fail (bit i: filter i)."""
    x = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("part"),
                    F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    x = x.mapInArrow(_judge, "doc_id long, part string, digest binary, fails int")
    marks = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    x = x.join(marks, "doc_id", "left").select("doc_id", "part", "digest", "fails", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "toxic")])
    cell = ["digest", "part", "fails", "good", "toxic"]
    # rows of an id are counted where the join left them; the least struct then carries the rows of the cell's smallest id
    rows = x.groupBy("doc_id", *cell).agg(F.count(F.lit(1)).alias("c"))
    cells = rows.groupBy(*cell).agg(
        F.sum("c").alias("n"), F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("c"))), F.lit(0)).alias("no_id"),
        F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "c"))).alias("low"))
    first = cells.groupBy("digest").agg(F.min("low.doc_id").alias("first"))
    cells = cells.join(first, "digest")
    original = F.col("no_id") + F.when(F.col("low.doc_id") == F.col("first"), F.col("low.c")).otherwise(0)
    split = F.explode(F.array(F.struct(F.lit(0).alias("copy"), original.alias("k")), F.struct(F.lit(1).alias("copy"), (F.col("n") - original).alias("k"))))
    cells = cells.select("part", "fails", "good", "toxic", split.alias("s")).select("part", "fails", "good", "toxic", "s.*")
    return cells.where("k > 0").groupBy("part", (F.col("fails") + 16 * F.col("copy")).alias("pattern")).agg(
        F.sum("k").alias("n"), F.sum(F.col("k") * F.col("good")).alias("good"), F.sum(F.col("k") * F.col("toxic")).alias("toxic"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, filter_order, step`` and the seven counts, for every part, all 120 orders and five steps."""
    size = 2 ** len(FILTERS)
    counted = patterns(docs, labels)
    flat = counted.groupBy("part").agg(*[F.map_from_entries(F.collect_list(F.struct("pattern", m))).alias(m) for m in MEASURES])
    at = lambda m, i: F.coalesce(F.try_element_at(m, F.lit(i)), F.lit(0)).cast("long")
    tensors = flat.select("part", *[F.array(*[at(m, i) for i in range(size)]).alias(m) for m in MEASURES])
    return tensors.mapInArrow(_audit, "part string, filter_order string, step int, " + ", ".join(f"{f} long" for f in FIGURES))
