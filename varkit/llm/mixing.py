"""Mixing sources to target weights.

The words of a source, its documents laid end to end in ascending id order, are cut into blocks
of ``block`` words (the last may be shorter).  The mix is a row of output shards with the same
number of slots; each shard draws multinomial source counts from what the sources still need.
Draw i of a source takes block perm(i), where perm is a pseudorandom permutation of the source's
block numbers (a keyed Feistel network, another key for every pass over the source), so draws
need no shuffled copy of the data and repeats are spread as evenly as they can be.  Slots meet
blocks in an equi-join on (source, block).  The last draw of a source is cut where its
target is met.

Offsets of documents within their source come from ``prefix_sums``: no source is gathered in one
task, however large.  The driver holds one row per source and the draw plan,
at most ``MAX_PLAN`` numbers, whatever the size of the tables.

Edge cases: NULL text is empty (size 0) and contributes nothing; a NULL source is a source of its
own, last in order; an empty table gives an empty mix.  Repeated rows and equal ids are separate
documents (``_rid``); among rows with equal ids the order is by a hash of the text.  Targets are
zero for sources without words.  Same rows, parameters and seed give the same mix.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varkit.llm.common import prefix_sums, scratch, stored, text_or_empty, word_count

WEIGHTS = (5, 2, 1)
MAX_PASSES = 3
BLOCK = 1024
SHARDS = 64
MAX_PLAN = 4_000_000


def targets(sizes: list[int], weights: list[float], passes: int = MAX_PASSES) -> list[float]:
    """Shares the sum of ``sizes`` by weight; a target stops at ``passes`` times its source's
    size and the excess is shared anew by weight among the others until none is above."""
    total, out = float(sum(sizes)), [0.0] * len(sizes)
    open_, left = [i for i, s in enumerate(sizes) if s > 0], total
    while open_:
        w = math.fsum(weights[i] for i in open_)
        full = [i for i in open_ if left * weights[i] / w > passes * sizes[i]]
        if not full:
            for i in open_:
                out[i] = left * weights[i] / w
            break
        for i in full:
            out[i] = float(passes * sizes[i])
        left = total - math.fsum(out[i] for i in range(len(sizes)) if out[i])
        open_ = [i for i in open_ if i not in set(full)]
    return out


def permute(x: np.ndarray, n: np.ndarray, key: np.ndarray, inverse: bool = False) -> np.ndarray:
    """Keyed permutation of 0..n-1: a four-round Feistel network on the next even number of bits,
    walked until the value falls below n (under four steps on average)."""
    x, n, key = (np.asarray(v, np.uint64) for v in np.broadcast_arrays(x, n, key))
    kinds, which = np.unique(n, return_inverse=True)
    half = np.array([max(1, ((int(v) - 1).bit_length() + 1) // 2) for v in kinds], np.uint64)[which]
    out, todo = x.copy(), np.ones(len(x), bool)
    rounds = (3, 2, 1, 0) if inverse else (0, 1, 2, 3)
    while todo.any():
        h, k = half[todo], key[todo]
        mask = (np.uint64(1) << h) - np.uint64(1)
        a, b = out[todo] >> h, out[todo] & mask
        for r in rounds:
            if inverse:
                a, b = b ^ (_mix(a ^ _mix(k + np.uint64(r))) & mask), a
            else:
                a, b = b, a ^ (_mix(b ^ _mix(k + np.uint64(r))) & mask)
        out[todo] = (a << h) | b
        todo[todo] = out[todo] >= n[todo]
    return out.astype(np.int64)


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _keys(source: np.ndarray, turn: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _mix(np.asarray(source, np.uint64) * np.uint64(0x9E3779B97F4A7C15) + _mix(np.asarray(turn, np.uint64) + np.uint64(seed)))


@dataclass
class Plan:
    """Draws per source and shard.  ``first[k, s]`` is the number of draws of source s before
    shard k; ``cut[s]`` the words that the last draw of s takes."""

    sizes: np.ndarray
    blocks: np.ndarray
    draws: np.ndarray
    cut: np.ndarray
    first: np.ndarray
    block: int
    seed: int

    @property
    def slots(self) -> int:
        return int(self.draws.sum())


def make_plan(sizes: list[int], goal: list[float], block: int = BLOCK, shards: int = SHARDS, seed: int = 7) -> Plan:
    sizes_, want = np.array(sizes, np.int64), np.array([round(g) for g in goal], np.int64)
    blocks = -(-sizes_ // block)
    draws, cut = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    for s, (size, n, w) in enumerate(zip(sizes_, blocks, want)):
        if not w:
            continue
        turn, rest = divmod(int(w), int(size))
        if not rest:
            turn, rest = turn - 1, int(size)
        # words of the first m draws of this pass: m blocks, less what the short block lacks
        lack = int(n * block - size)
        short = int(permute([n - 1], [n], _keys([s], [turn], seed), inverse=True)[0])
        m = -(-rest // block)
        if short < m:
            m = max(short + 1, -(-(rest + lack) // block)) if rest > short * block else m
        before = (m - 1) * block - (lack if short < m - 1 else 0)
        draws[s], cut[s] = turn * n + m, rest - before
    shards = max(1, min(shards, MAX_PLAN // max(1, len(sizes)), int(draws.sum())))
    per = -(-int(draws.sum()) // shards)
    first, need = np.zeros((shards + 1, len(sizes)), np.int64), draws.copy()
    for k in range(shards):
        slots = min(per, int(need.sum()))
        if slots:
            got = np.zeros(len(sizes), np.int64)
            rng = np.random.default_rng([seed, k])
            while (left := slots - int(got.sum())) > 0:  # again only for what a used-up source can't give
                p = (need - got) / (need - got).sum()
                got = np.minimum(got + rng.multinomial(left, p), need)
        else:
            got = np.zeros(len(sizes), np.int64)
        need -= got
        first[k + 1] = first[k] + got
    return Plan(sizes_, blocks, draws, cut, first, block, seed)


def slot_rows(plan: Plan, start: np.ndarray) -> pd.DataFrame:
    """The slots with the given numbers: shard, place in the shard, source number, pass, block,
    words taken."""
    per = plan.first.sum(axis=1)
    shard = np.searchsorted(per, start, "right") - 1
    inside = start - per[shard]
    size = per[shard + 1] - per[shard]
    # the shard's draws in source order, met in a pseudorandom order
    rank = permute(inside, size, _keys(shard, np.full(len(shard), 1 << 40), plan.seed))
    source, i = np.empty(len(start), np.int64), np.empty(len(start), np.int64)
    for k in np.unique(shard):
        at = shard == k
        ends = np.cumsum(plan.first[k + 1] - plan.first[k])
        s = np.searchsorted(ends, rank[at], "right")
        source[at] = s
        i[at] = rank[at] - (ends[s] - (plan.first[k + 1] - plan.first[k])[s]) + plan.first[k][s]
    n = plan.blocks[source]
    turn = i // n
    block = permute(i % n, n, _keys(source, turn, plan.seed))
    words = np.minimum(plan.block, plan.sizes[source] - block * plan.block)
    last = i == plan.draws[source] - 1
    words[last] = plan.cut[source][last]
    return pd.DataFrame({"shard": shard, "slot": inside, "source_no": source, "turn": turn, "block": block, "words": words})


@dataclass
class Mix:
    """``documents``: one row per input row with ``_rid``, size, source_size and target.
    ``pieces``: one row per slot and document that it takes words from: shard, slot, turn,
    ``_rid``, ``word_from`` and ``word_to`` (word numbers in the document, end excluded)."""

    documents: DataFrame
    pieces: DataFrame


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: tuple[float, ...] = WEIGHTS, passes: int = MAX_PASSES, block: int = BLOCK,
        shards: int = SHARDS, seed: int = 7, keep_columns: tuple[str, ...] = ()) -> Mix:
    """Sources take ``weights`` in the order of their code points, repeating, NULL last."""
    spark = docs.sparkSession
    text = text_or_empty(text_col)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in (id_col, *keep_columns)]).alias("_row"),
                       F.col(f"`{source_col}`").cast("string").alias("_source"), word_count(text).alias("_size"),
                       F.col(f"`{id_col}`").alias("_order"), F.xxhash64(text).alias("_tie"))
    rows = prefix_sums(rows, "_source", ["_order", "_tie"], "_size", "_start", "mix")

    # one row per source comes to the driver
    found = {r["_source"]: int(r["n"]) for r in rows.groupBy("_source").agg(F.sum("_size").alias("n")).collect()}
    names = sorted((k for k in found if k is not None)) + [None] * (None in found)
    sizes = [found[k] for k in names]
    goal = targets(sizes, [weights[i % len(weights)] for i in range(len(names))], passes)
    catalogue = spark.createDataFrame([(k, i, s, t) for i, (k, s, t) in enumerate(zip(names, sizes, goal))],
                                      "_name string, source_no long, source_size long, target double")
    documents = rows.join(F.broadcast(catalogue) if len(names) <= 100_000 else catalogue,
                          F.col("_source").eqNullSafe(F.col("_name")), "left")
    documents = documents.select(F.col("_row")[id_col].alias(id_col), "_row", F.col("_source").alias("_mix_source"), "_rid", "_start", F.col("_size").alias("size"),
                                 "source_no", "source_size", "target")

    plan = make_plan(sizes, goal, block, shards, seed)
    if not plan.slots:
        return Mix(documents, spark.createDataFrame([], "shard long, slot long, turn long, _rid long, word_from long, word_to long"))

    def slots(batches):
        for b in batches:
            yield slot_rows(plan, b["id"].to_numpy())

    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    drawn = spark.range(0, plan.slots, 1, tasks).mapInPandas(
        slots, "shard long, slot long, source_no long, turn long, block long, words long")
    cover = documents.where("size > 0").select("_rid", "_start", "size", F.col("source_no").alias("_s"), F.explode(F.sequence(
        F.floor(F.col("_start") / block), F.floor((F.col("_start") + F.col("size") - 1) / block))).alias("_b"))
    joined = drawn.join(cover, (F.col("source_no") == F.col("_s")) & (F.col("block") == F.col("_b")))
    begin = F.col("_b") * block
    pieces = joined.select("shard", "slot", "turn", "_rid",
                           F.greatest(begin - F.col("_start"), F.lit(0)).cast("long").alias("word_from"),
                           F.least(begin + F.col("words") - F.col("_start"), F.col("size")).cast("long").alias("word_to"))
    return Mix(documents, pieces.where("word_to > word_from"))


def taken_words(m: Mix) -> DataFrame:
    """``m.documents`` with ``taken``, the words that the mix takes from each, repeats counted."""
    took = m.pieces.groupBy("_rid").agg(F.sum(F.col("word_to") - F.col("word_from")).alias("_took"))
    return (m.documents.join(took.withColumnRenamed("_rid", "_r"), F.col("_rid") == F.col("_r"), "left")
            .withColumn("taken", F.coalesce("_took", F.lit(0)).cast("long")).drop("_r", "_took"))


def mixed_documents(docs: DataFrame, columns: list[str], id_col: str = "doc_id", text_col: str = "text",
                    source_col: str = "source", chars_col: str | None = "n_chars", **options) -> DataFrame:
    """The mix as documents: a row per document and pass that takes words from it, with the
    words taken in that pass in document order as its text (the whole text, unchanged, where the pass
    takes all), and the columns ``columns`` of the input.  ``chars_col`` is set to the new
    text's length."""
    m = mix(docs, id_col, text_col, source_col, keep_columns=tuple(c for c in columns if c != id_col), **options)
    row = lambda c: F.col("_row")[c]
    spans = (m.pieces.groupBy("_rid", "turn")
             .agg(F.sort_array(F.collect_list(F.struct("word_from", "word_to"))).alias("_spans"),
                  F.sum(F.col("word_to") - F.col("word_from")).alias("_took")).withColumnRenamed("_rid", "_r"))
    d = m.documents.join(spans, F.col("_rid") == F.col("_r"))
    # a group is one document's blocks in one pass; its spans are cut out of the row's own text
    words = F.regexp_extract_all(row(text_col), F.lit(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"), F.lit(0))
    part = F.transform(F.array(words), lambda w: F.regexp_replace(F.concat_ws("", F.flatten(F.transform(
        F.col("_spans"), lambda s: F.slice(w, (s["word_from"] + 1).cast("int"), (s["word_to"] - s["word_from"]).cast("int"))))),
        r"[\x20\x09-\x0D]+$", ""))[0]
    text = F.when(F.col("_took") == F.col("size"), row(text_col)).otherwise(part)
    d = d.withColumn("_text", text)
    return d.select(*[F.col("_text").alias(c) if c == text_col else F.length("_text").cast("long").alias(c) if c == chars_col
                      else row(c).alias(c) for c in columns])
