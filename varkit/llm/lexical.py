"""Ranked lexical search: best-first document intervals bounded by range maxima of posting lists.

Documents are cut into *segments* of bounded text.  A segment is a small inverted index over the terms
the queries use: posting lists (document position, impact) one after the other in term order, and a
sparse table of maximum-impact positions over them, so the largest impact of a term in any interval of
documents is two look-ups.  A query starts with one interval, the whole segment.  An interval's bound is
the sum over the query's terms of weight times range maximum; no document in it scores higher.  The
intervals of highest bound are taken first and split at a document of maximum impact (of the term that
contributes most), which is scored exactly; the parts left and right of it get bounds of their own.
Intervals of up to ``LEAF`` documents are scored whole.  Intervals whose bound is below the k-th best
score so far are dropped; equal bounds stay, as ties go to the smaller id.  So the answer is exact.

Score: terms are maximal runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased.  With
N documents that have a term, L terms in all, n of a document, df and tf of a term,
w = floor(1000 ln((2N+2)/(2df+1))), m = 50 + (50 n N) div L, and a document scores
sum of w * ((10^9 tf) div (1000 tf + 20 m)) over the query's distinct terms.

Plan: queries are taken in blocks of bounded vocabulary.  Per block, one scan tokenizes the documents
and writes the segments; N, L and df are sums over the segments; a scan of the segments answers all of
the block's queries, each task carrying its k best per query from segment to segment.  What is shuffled
is k rows per query and task, merged in two levels.  Nothing is gathered but the block's vocabulary counts.

Edge cases: NULL and empty texts have no terms: such documents never match and such queries have no
rows.  A NULL id ranks after other ids of equal score.  Repeated rows, of documents or of queries, are
rows of their own.  A very long text is a segment of its own.  Only id and text columns are read.
"""

from __future__ import annotations

import math
from array import array
from collections import Counter
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varkit.llm.common import stored

#: UTF-8 bytes of text in a segment; a longer document is one by itself.
SEGMENT_BYTES = 16 << 20
#: Intervals of up to so many documents are scored whole; so many intervals are taken at a time.
LEAF, BATCH = 32, 256
#: Vocabulary of a block of queries, in UTF-8 bytes; a query with more is a block by itself.
BLOCK_BYTES = 4 << 20
#: Commonest terms whose presence orders the documents of a segment, so that like documents are neighbours.
ORDER_TERMS = 16
#: First-level groups when the tasks' answers to a query are merged.
MERGE_GROUPS = 64

_LETTERS = bytes(range(0x30, 0x3A)) + bytes(range(0x41, 0x5B)) + bytes(range(0x61, 0x7B))
TERM_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or b in _LETTERS else 0x20 for b in range(256))

SEGMENT = ("n_docs long, n_terms long, tid array<int>, df array<int>, ids binary, has_id binary, lengths binary, "
           "docs binary, tfs binary")


def terms(text: bytes) -> list[bytes]:
    """The terms of a text, given and returned as UTF-8."""
    return text.translate(TERM_BYTES).split()


# ------------------------------------------------------------------------------ index
def _segment(ids: list, lengths: list, tids: array, docs: array, tfs: array, n_docs: int, n_terms: int) -> dict:
    """One segment row: postings sorted by (term, document), documents renumbered so that like ones are neighbours."""
    tid, doc, tf = (np.frombuffer(x, np.int32) if len(x) else np.zeros(0, np.int32) for x in (tids, docs, tfs))
    present, df = np.unique(tid, return_counts=True)
    signature = np.zeros(len(ids), np.int64)
    for bit, t in enumerate(present[np.argsort(-df, kind="stable")][:ORDER_TERMS]):
        signature[doc[tid == t]] |= 1 << (ORDER_TERMS - bit)
    order = np.argsort(signature, kind="stable")
    place = np.empty(len(ids), np.int32)
    place[order] = np.arange(len(ids), dtype=np.int32)
    doc = place[doc]
    by = np.lexsort((doc, tid))
    return {"n_docs": n_docs, "n_terms": n_terms, "tid": present.astype(np.int32), "df": df.astype(np.int32),
            "ids": np.array([0 if i is None else i for i in ids], np.int64)[order].tobytes(),
            "has_id": np.array([i is not None for i in ids], np.uint8)[order].tobytes(),
            "lengths": np.array(lengths, np.int64)[order].tobytes(), "docs": doc[by].tobytes(), "tfs": tf[by].tobytes()}


def build_segments(docs: DataFrame, id_col: str, text_col: str, vocabulary: dict[bytes, int]) -> DataFrame:
    """The segments of a table: per segment its document and term counts, its terms and their document counts, and the postings."""
    names = [c.split()[0] for c in SEGMENT.split(", ")]
    limit = SEGMENT_BYTES

    def build(batches):
        def flush():
            row = _segment(ids, lengths, tids, places, tfs, n_docs, n_terms)
            return pa.RecordBatch.from_arrays([pa.array([row[c]], kind) for c, kind in zip(names, kinds)], names)

        kinds = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())] + [pa.binary()] * 5
        find = vocabulary.get
        ids, lengths, tids, places, tfs, n_docs, n_terms, size = [], [], array("i"), array("i"), array("i"), 0, 0, 0
        for b in batches:
            for i, text in zip(b.column(0).to_pylist(), b.column(1)):
                text = text.as_py()
                words = terms(text)
                if not words:
                    continue
                n_docs, n_terms, size = n_docs + 1, n_terms + len(words), size + len(text)
                found = Counter(map(find, words))
                found.pop(None, None)
                if found:
                    tids.extend(found.keys())
                    tfs.extend(found.values())
                    places.extend([len(ids)] * len(found))
                    ids.append(i)
                    lengths.append(len(words))
                if size >= limit:
                    yield flush()
                    ids, lengths, tids, places, tfs, n_docs, n_terms, size = [], [], array("i"), array("i"), array("i"), 0, 0, 0
        if n_docs:
            yield flush()

    x = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))
    return x.mapInArrow(build, SEGMENT)


class Segment:
    """A segment ready for search: impacts, and the sparse table of the positions of range maxima."""

    def __init__(self, row: dict, n_docs: int, n_terms: int):
        read = lambda c, kind: np.frombuffer(row[c], kind)
        self.ids, self.has_id = read("ids", np.int64), read("has_id", np.uint8).astype(bool)
        self.size = len(self.ids)
        self.docs, tf = read("docs", np.int32), read("tfs", np.int32).astype(np.int64)
        m = 50 + 50 * read("lengths", np.int64) * n_docs // n_terms
        self.impact = 1_000_000_000 * tf // (1000 * tf + 20 * m[self.docs])
        df = np.array(row["df"], np.int64)
        self.start = np.concatenate([[0], np.cumsum(df)])
        self.local = {t: i for i, t in enumerate(row["tid"])}
        self.keys = np.repeat(np.arange(len(df), dtype=np.int64), df) * self.size + self.docs
        # best[k][p]: position of the largest impact among the 2^k postings from p on
        levels = [np.arange(len(self.docs), dtype=np.int32)]
        span = 1
        while len(df) and 2 * span <= df.max():
            a = levels[-1]
            b = np.minimum(np.arange(len(a)) + span, len(a) - 1)
            levels.append(np.where(self.impact[a] >= self.impact[a[b]], a, a[b]))
            span *= 2
        self.best = np.stack(levels)
        self.log = np.zeros(int(df.max(initial=1)) + 1, np.int64)
        for i in range(2, len(self.log)):
            self.log[i] = self.log[i // 2] + 1

    def bounds(self, lo: np.ndarray, hi: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bound and split document of intervals; ``lo`` and ``hi`` have a row per interval and a column per term."""
        some = hi > lo
        k = self.log[np.where(some, hi - lo, 1)]
        first = self.best[k, np.where(some, lo, 0)]
        last = self.best[k, np.where(some, hi - (1 << k), 0)]
        top = np.where(self.impact[first] >= self.impact[last], first, last)
        parts = np.where(some, self.impact[top] * weight, -1)
        chosen = top[np.arange(len(top)), parts.argmax(1)]
        return np.maximum(parts, 0).sum(1), self.docs[chosen]

    def search(self, tids: list[int], weights: list[int], k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """(positions, scores) of all documents that can be among the k best, given that scores below ``floor`` can't."""
        have = [(self.local[t], w) for t, w in zip(tids, weights) if t in self.local and w > 0]
        if not have:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        t, weight = np.array([a for a, _ in have]), np.array([w for _, w in have], np.int64)
        lo, hi = self.start[t][None, :], self.start[t + 1][None, :]
        a, b = np.array([0]), np.array([self.size])
        bound, split = self.bounds(lo, hi, weight)
        found, scores = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        while len(a):
            have_scores = np.concatenate(scores)
            if len(have_scores) >= k:
                floor = max(floor, int(np.partition(have_scores, len(have_scores) - k)[len(have_scores) - k]))
            alive = bound >= max(floor, 1)
            a, b, lo, hi, bound, split = (x[alive] for x in (a, b, lo, hi, bound, split))
            if not len(a):
                break
            take = np.zeros(len(a), bool)
            take[np.argpartition(-bound, BATCH)[:BATCH] if len(a) > BATCH else slice(None)] = True
            leaf, inner = take & (b - a <= LEAF), take & (b - a > LEAF)
            if leaf.any():
                at, value = self._score_all(a[leaf], b[leaf], lo[leaf], hi[leaf], weight)
                found.append(at)
                scores.append(value)
            stay = ~take
            parts = [[x[stay]] for x in (a, b, lo, hi, bound, split)]
            if inner.any():
                ia, ib, il, ih, d = a[inner], b[inner], lo[inner], hi[inner], split[inner].astype(np.int64)
                key = t[None, :] * self.size + d[:, None]
                p = np.searchsorted(self.keys, key)
                hit = self.keys[np.minimum(p, len(self.keys) - 1)] == key
                found.append(d)
                scores.append((np.where(hit, self.impact[np.minimum(p, len(self.keys) - 1)], 0) * weight).sum(1))
                p = np.clip(p, il, ih)
                for ca, cb, cl, ch in ((ia, d, il, p), (d + 1, ib, p + hit, ih)):
                    ok = cb > ca
                    cbound, csplit = self.bounds(cl[ok], ch[ok], weight)
                    for part, x in zip(parts, (ca[ok], cb[ok], cl[ok], ch[ok], cbound, csplit)):
                        part.append(x)
            a, b, lo, hi, bound, split = (np.concatenate(x) for x in parts)
        return np.concatenate(found), np.concatenate(scores)

    def _score_all(self, a, b, lo, hi, weight) -> tuple[np.ndarray, np.ndarray]:
        """Every document of short intervals with its score, from the postings inside them."""
        count = (hi - lo).ravel()
        ends = np.cumsum(count)
        flat = np.arange(ends[-1]) - np.repeat(ends - count - lo.ravel(), count)
        cell = np.repeat(np.arange(len(count)), count)
        interval, term = cell // lo.shape[1], cell % lo.shape[1]
        base = np.concatenate([[0], np.cumsum(b - a)])
        slot = self.docs[flat] - a[interval] + base[interval]
        # sums of integers below 2^53, so doubles hold them exactly
        total = np.bincount(slot, self.impact[flat] * weight[term], minlength=int(base[-1])).astype(np.int64)
        docs = np.arange(base[-1]) - np.repeat(base[:-1], b - a) + np.repeat(a, b - a)
        return docs[total > 0], total[total > 0]


# ------------------------------------------------------------------------------ search
def query_blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[int | None, list[bytes]]]]:
    """The queries, (id, distinct terms), in blocks whose vocabulary is bounded; read as a stream."""
    block, size, seen = [], 0, set()
    rows = items.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))
    for r in rows.toLocalIterator():
        words = sorted(set(terms(bytes(r["text"]))))
        if not words:
            continue
        more = sum(len(w) for w in words if w not in seen)
        if block and (size + more > BLOCK_BYTES or len(block) * 32 > BLOCK_BYTES):
            yield block
            block, size, seen = [], 0, set()
            more = sum(map(len, words))
        block.append((r["id"], words))
        seen.update(words)
        size += more
    if block:
        yield block


def _answers(segments: DataFrame, block: list, vocabulary: dict[bytes, int], weights: dict[int, int], n_docs: int, n_terms: int, k: int) -> DataFrame:
    queries = [(q, [vocabulary[w] for w in words], [weights.get(vocabulary[w], 0) for w in words]) for q, words in block]

    def run(batches):
        best = [(np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)) for _ in queries]
        for batch in batches:
            for i in range(batch.num_rows):
                segment = Segment(batch.slice(i, 1).to_pylist()[0], n_docs, n_terms)
                for q, (_, tids, w) in enumerate(queries):
                    ids, has_id, scores = best[q]
                    at, found = segment.search(tids, w, k, int(scores[-1]) if len(scores) >= k else 0)
                    if not len(at):
                        continue
                    ids, has_id, scores = np.concatenate([ids, segment.ids[at]]), np.concatenate([has_id, segment.has_id[at]]), np.concatenate([scores, found])
                    top = np.lexsort((ids, ~has_id, -scores))[:k]
                    best[q] = ids[top], has_id[top], scores[top]
        for q, (ids, has_id, scores) in enumerate(best):
            if len(ids):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([q] * len(ids), pa.int32()), pa.array(ids, mask=~has_id), pa.array(scores)], ["q", "doc_id", "score"])

    found = segments.mapInArrow(run, "q int, doc_id long, score long").withColumn("g", F.spark_partition_id() % MERGE_GROUPS)
    order: list[Column] = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    for keys in (["q", "g"], ["q"]):
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)
    names = found.sparkSession.createDataFrame([(q, i) for q, (i, _) in enumerate(block)], "q int, item_id long")
    return found.join(F.broadcast(names), "q").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = 50, doc_id: str = "doc_id", text: str = "text",
           item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` highest-scoring documents of every query, scores above 0."""
    spark = docs.sparkSession
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for block in query_blocks(items, item_id, item_text):
        vocabulary = {w: i for i, w in enumerate(sorted({w for _, words in block for w in words}))}
        segments = stored(build_segments(docs, doc_id, text, vocabulary), "lexical")
        n = segments.agg(F.sum("n_docs"), F.sum("n_terms")).collect()[0]
        if not n[0]:
            return out
        # one row per term of the block's vocabulary
        df = segments.select(F.explode(F.arrays_zip("tid", "df")).alias("x")).groupBy("x.tid").agg(F.sum("x.df").alias("df")).collect()
        weights = {r["tid"]: math.floor(1000 * math.log((2 * n[0] + 2) / (2 * r["df"] + 1))) for r in df}
        out = out.unionByName(_answers(segments, block, vocabulary, weights, n[0], n[1], k))
    return out
