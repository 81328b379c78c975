"""Token-id files: an adaptive context-mixing range coder in independent blocks.

Each id is coded under one distribution, a mixture of the predictions of orders 2, 1 and 0:
P(id) = w2 [id = p2] + w1 [id = p1] + w0 P0(id), where p2 and p1 are the ids that last followed the same two ids and the same
id, and P0 is the distribution of the block's ids so far.  The weights adapt: they are the shares of what was right before in the
same state of confidence.  P0 gives the ids that have not occurred the share that Good and Turing estimate from those that
occurred once.  All sums are integers, so encoder and decoder agree to the bit.  A 64-bit range coder takes one step per id.
All models start afresh in every block, and a block
carries its length, its documents and a checksum of its ids, so blocks are read alone and in any order.

P0 is renewed at fixed places, from then on every ``RENEWAL`` ids to the block's end (``renewals``), so the encoder finds all
probabilities with array operations; the coder itself and the decoder run many blocks in step, one array element per block.
A block's ids are numbered as they first occur; contexts and order-0 tables go by these local numbers, so tables grow
with the ids that a block holds and not with the vocabulary.  P0 has the ids it has seen first, then all others by id.

Files: documents are range-partitioned by id and sorted, so part numbers, block numbers and
documents ascend with the id.  Blocks are rows of binary payloads in files of Spark's own
writer, which any store that Spark writes to can hold.  Tasks buffer at most ``LANES`` blocks.

Edge cases: NULL text is empty and has only the end id; a document longer than a block
continues in the next ones and its checksum is put together from theirs; NULL ids sort first; rows that repeat an id
are separate documents, ordered by a hash of their text.  An empty table writes no block and
reads back empty.  Only the id and text columns are read.
"""

from __future__ import annotations

import os
import re
import string
import struct
import unicodedata
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from varkit.llm.common import stored, text_or_empty, worker_cache

BLOCK_TOKENS, LANES = 8192, 1024
RENEWAL = 1024
#: The weights of the mixture sum to this.
MIX = 1 << 9
#: P0 before any id: weights as of ranks, since vocabularies built by merges list frequent ids first.
PRIOR_TOP, PRIOR_FLAT = 50_000, 500
ORDER1_BITS, ORDER2_BITS = 12, 13
MAGIC, HEADER = b"VKT1", "<4sIIIIQ"
END_ID = 1
CHUNKS_KEPT = 300_000

U = np.uint64
LOW32 = U(0xFFFFFFFF)
#: Order-0 weights of a lane sum to less than 1 << LANE_BITS.
LANE_BITS = 22
BUCKET_BITS = 11
STATES = 32


def _contexts(prev: np.ndarray, prev2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the order-1 and order-2 tables, from the local numbers of the last two ids (unsigned 32-bit)."""
    two = (prev * np.uint32(0x85EBCA6B) + prev2 * np.uint32(0xC2B2AE35)) * np.uint32(0x9E3779B1)
    return prev & np.uint32((1 << ORDER1_BITS) - 1), two >> np.uint32(32 - ORDER2_BITS)


def _sorted_runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stable order of keys (small integers, sorted by radix), and in that order whether
    an element has the same key as the one before."""
    order = np.argsort(key.astype(np.uint16), kind="stable")
    k = key[order]
    same = np.zeros(len(key), bool)
    same[1:] = k[1:] == k[:-1]
    return order, same


def _back(order: np.ndarray, values: np.ndarray) -> np.ndarray:
    out = np.empty_like(values)
    out[order] = values
    return out


def _history(slot: np.ndarray, local: np.ndarray) -> np.ndarray:
    """For each place, what its context's table entry holds: 0 before the context has occurred, else the local number
    that followed it last, times 4, plus how often in a row (up to 2) that had been right, plus one."""
    order, same = _sorted_runs(slot)
    v = local[order]
    right = np.zeros(len(v), bool)
    right[1:] = same[1:] & (v[1:] == v[:-1])
    # run before t: 0, 1 or 2 right guesses in a row at t-1, t-2
    once = np.zeros(len(v), bool)
    once[1:] = same[1:] & right[:-1]
    twice = np.zeros(len(v), bool)
    twice[1:] = once[1:] & once[:-1]
    entry = np.zeros(len(v), np.int64)
    entry[1:] = same[1:] * (v[:-1] * 4 + 1 + once[1:] + twice[1:])
    return _back(order, entry)


def _state(e2: np.ndarray, e1: np.ndarray) -> np.ndarray:
    """Number of the mixing state; its lowest bit says whether order 1 adds a guess of its own."""
    own = (e1 >> 2 != e2 >> 2) & (e1 > 0)
    return (e2 & 3) * 8 + (e1 & 3) * 2 + own


def renewals(n: int) -> list[int]:
    """The places of a block of ``n`` ids where P0 is renewed: powers of two, then every ``RENEWAL`` ids."""
    early = [1 << i for i in range(6, RENEWAL.bit_length() - 1)]
    return [t for t in (*early, *range(RENEWAL, n, RENEWAL)) if t < n]


def prior(size: int) -> np.ndarray:
    return 1 + PRIOR_TOP // (np.arange(size, dtype=np.int64) + PRIOR_FLAT)


def _each(n, once, whole: int):
    """What an occurrence weighs in P0 after ``n`` ids, of which ``once`` came once: the prior, of sum ``whole``, keeps their share."""
    n, once = np.maximum(n, 1), np.maximum(once, 1)
    return np.maximum(1, np.minimum(whole * (n - once) // (n * once), ((1 << LANE_BITS) - 1 - whole) // n))


def order0(seen: np.ndarray, base: np.ndarray) -> np.ndarray:
    """Cumulated order-0 weights, from 0 on, after the ids ``seen``, all ids in ascending order: the prior's ``base`` and the
    occurrences.  The coders have the same weights in the order of ``_spread`` and ``_Lanes.renew``."""
    counts = np.bincount(seen, minlength=len(base))
    out = np.zeros(len(base) + 1, np.int64)
    np.cumsum(counts * int(_each(len(seen), (counts == 1).sum(), int(base.sum()))) + base, out=out[1:])
    return out


def _weights(c2, c1, total, e2, own):
    """Weights of orders 2, 1 and 0 in the mixture, from the counts of what was right in a state.  Quotients of such
    small integers as doubles are cut to the right integers."""
    w2 = ((c2 * (MIX - 3) / total).astype(np.int64) + 1) * (e2 > 0)
    w1 = ((c1 * (MIX - 3) / total).astype(np.int64) + 1) * own
    return w2, w1, MIX - w2 - w1


def _numbered(ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Local numbers of ids, from 1 on in the order of first occurrence, and the ids so numbered.  ``first`` is scratch space."""
    place = np.arange(len(ids))
    first[ids[::-1]] = place[::-1]
    came = first[ids]
    new = came == place
    return np.cumsum(new)[came], ids[new]


def _spread(local, names, places, base, line):
    """P0 of a block from each of ``places`` on, by local number: begin and weight of each id in it, and its sum.
    The ids that occurred before lie first, by local number; behind them the others, by id."""
    k, whole, n = len(names), int(line[-1]), len(local)
    segment = np.repeat(np.arange(len(places)), np.diff([*places, n]))
    came = np.bincount(segment * k + local - 1, minlength=len(places) * k).reshape(-1, k)
    counts = np.cumsum(came, axis=0) - came
    each = _each(np.array(places), (counts == 1).sum(1), whole)
    seen = counts > 0
    weight = base[names] + counts * each[:, None]
    ends = np.cumsum(weight * seen, axis=1)
    by_id = np.argsort(names)
    taken = (seen * base[names])[:, by_id]
    less = np.empty_like(ends)
    less[:, by_id] = np.cumsum(taken, axis=1) - taken
    begin = np.where(seen, ends - weight, ends[:, -1:] + line[names] - less)
    return segment * k - 1, begin.ravel(), weight.ravel(), (whole + each * np.array(places))[segment]


def _events(ids, base, line, first):
    """Begin, width and whole of each id in the mixture that codes it."""
    local, names = _numbered(ids, first)
    prev, prev2 = np.zeros(len(ids), np.uint32), np.zeros(len(ids), np.uint32)
    prev[1:], prev2[2:] = local[:-1], local[:-2]
    s1, s2 = _contexts(prev, prev2)
    e1, e2 = _history(s1, local), _history(s2, local)
    state, g2, g1 = _state(e2, e1), e2 >> 2, e1 >> 2
    own = state & 1
    hit2, hit1 = g2 == local, own * (g1 == local)
    # counts of each part in the state so far, one more to start with
    order, same = _sorted_runs(state)
    begin = np.maximum.accumulate(np.where(same, 0, np.arange(len(ids))))
    counts = []
    for hit in (hit2, hit1):
        came = hit[order]
        before = np.cumsum(came) - came
        counts.append(_back(order, before - before[begin] + 1))
    w2, w1, w0 = _weights(*counts, _back(order, np.arange(len(ids)) - begin + 3), e2, own)
    row, starts, weights, total = _spread(local, names, [0, *renewals(len(ids))], base, line)
    at = row + local
    start = starts[at]
    ahead2, ahead1 = starts[row + np.maximum(g2, 1)] < start, starts[row + np.maximum(g1, 1)] < start
    return w0 * start + total * (w2 * ahead2 + w1 * ahead1), w0 * weights[at] + total * (w2 * hit2 + w1 * hit1), MIX * total


def _by_length(lengths, blocks) -> list[np.ndarray]:
    """Numbers of blocks in groups of up to ``LANES``, long ones first, so the lanes still at work come first in a group."""
    order = np.argsort(-np.array(lengths, np.int64), kind="stable")
    return [order[at:at + LANES] for at in range(0, len(blocks), LANES)]


def encode_blocks(blocks: list[np.ndarray], size: int) -> list[bytes]:
    """Codes of blocks of ids below ``size``; the lengths go into the blocks' headers."""
    out: list[bytes] = [b""] * len(blocks)
    for group in _by_length([len(b) for b in blocks], blocks):
        for i, code in zip(group, _encode([blocks[i] for i in group], size)):
            out[i] = code
    return out


def _encode(blocks, size):
    lanes, n = len(blocks), len(blocks[0])
    base, first = prior(size), np.zeros(size, np.int64)
    line = np.concatenate([[0], np.cumsum(base)])
    # all three are below 2 ** 31
    events = np.zeros((3, lanes, n), np.uint32)
    for i, b in enumerate(blocks):
        events[:, i, :len(b)] = _events(b, base, line, first)
    active = np.searchsorted(-np.array([len(b) for b in blocks]), -np.arange(n), "left").tolist()
    low, rng = np.zeros(lanes, U), np.full(lanes, U(0xFFFFFFFFFFFFFFFF))
    words, filled = np.zeros((lanes, n + 2), np.uint32), np.zeros(lanes, np.int64)
    with np.errstate(over="ignore"):
        for t in range(n):
            if t % 64 == 0:
                steps = np.ascontiguousarray(events[:, :, t:t + 64].transpose(2, 0, 1)).astype(U)
            m = active[t]
            start, width, whole = steps[t % 64, :, :m]
            step = rng[:m] // whole
            was = low[:m].copy()
            low[:m] += step * start
            rng[:m] = step * width
            a = np.flatnonzero(low[:m] < was)
            at = filled[a] - 1
            while len(a):                                        # the carry goes through words of ones
                words[a, at] += np.uint32(1)
                on = words[a, at] == 0
                a, at = a[on], at[on] - 1
            a = np.flatnonzero(rng[:m] <= LOW32)
            if len(a):
                words[a, filled[a]] = low[a] >> U(32)
                filled[a] += 1
                low[a] <<= U(32)
                rng[a] <<= U(32)
    out = []
    for i in range(lanes):
        tail = np.array([low[i] >> U(32), low[i] & LOW32], np.uint32)
        out.append(np.concatenate([words[i, :filled[i]], tail]).astype("<u4").tobytes())
    return out


def decode_blocks(codes: list[bytes], lengths: list[int], size: int) -> list[np.ndarray]:
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(codes)
    for group in _by_length(lengths, codes):
        for i, ids in zip(group, _decode([codes[i] for i in group], [lengths[i] for i in group], size)):
            out[i] = ids
    return out


class _Lanes:
    """The order-0 models of blocks that are decoded in step.  Ids go by their local numbers, 0 stands for none, so what a lane
    looks up lies in a few KB."""

    def __init__(self, lanes: int, size: int, n: int):
        self.base = prior(size)
        self.line = np.concatenate([[0], np.cumsum(self.base)])
        self.id_at = np.repeat(np.arange(size, dtype=np.int32), self.base)
        self.lift = np.arange(lanes, dtype=np.int64) << LANE_BITS
        self.lift32 = self.lift.astype(np.uint32)
        self.known = np.zeros(lanes * size, np.uint16 if n < 1 << 16 else np.uint32)
        self.known_row = np.arange(lanes, dtype=np.int64) * size
        self.last, self.cap, self.most = np.zeros(lanes, np.int64), 64, 0
        self.names, self.counts, self.spans = (np.zeros((lanes, 64), np.int64) for _ in range(3))
        self._room()
        self.renew(0, None)

    def _room(self) -> None:
        """Columns for all local numbers and two more."""
        self.most = int(self.last.max())
        if self.most + 2 > self.cap:
            more = ((0, 0), (0, self.cap))
            self.names, self.counts, self.spans = (np.pad(x, more) for x in (self.names, self.counts, self.spans))
            self.cap *= 2
        self.row = np.arange(len(self.last), dtype=np.int64) * self.cap
        self.name, self.span = self.names.reshape(-1), self.spans.reshape(-1)

    def renew(self, t: int, came) -> None:
        """P0 after ``t`` ids; ``came`` are the local numbers, by place and lane, since the last renewal."""
        lanes, whole = len(self.last), int(self.line[-1])
        if t:
            self.counts += np.bincount((came + self.row).ravel(), minlength=lanes * self.cap).reshape(lanes, self.cap)
            self.counts[:, 0] = 0
        self._room()
        k = self.most + 2
        counts, names = self.counts[:, :k], self.names[:, :k]
        seen = counts > 0
        each = _each(t, (counts == 1).sum(1), whole)
        taken = self.base[names] * seen
        weight = taken + counts * each[:, None]
        ends = np.cumsum(weight, axis=1)
        start = ends - weight
        self.spans[:, :k] = start | weight << 32
        self.rest, self.total = ends[:, -1], whole + each * t
        # begins by buckets of places: in a bucket a few steps of binary search are left
        self.shift = max(0, int(self.total.max()).bit_length() - BUCKET_BITS)
        row = np.arange(lanes, dtype=np.int64)[:, None]
        held = np.bincount(((start >> self.shift) + (row << BUCKET_BITS))[seen], minlength=lanes << BUCKET_BITS).astype(np.int32)
        below = np.cumsum(held.reshape(lanes, -1), axis=1, dtype=np.int32) - held.reshape(lanes, -1)
        self.bucket, self.bucket_row = (below + (row * k).astype(np.int32)).ravel(), row[:, 0] << BUCKET_BITS
        self.steps = [1 << i for i in reversed(range(int(held.max()).bit_length()))]
        self.table, self.table_row = (start + self.lift[:, None]).astype(np.uint32).ravel(), row[:, 0] * k
        # the other ids in ascending order: where the ids that occurred were cut out of the prior's line
        size = len(self.base)
        by_id = np.sort(np.where(seen, names, size), axis=1)
        taken = np.append(self.base, 0)[by_id]
        less = np.cumsum(taken, axis=1)
        cuts = np.zeros((2, lanes, k + 1), np.int64)
        cuts[0, :, 1:], cuts[1, :, 1:] = self.line[by_id] - less + taken, less
        cuts[0] += self.lift[:, None]
        self.cuts, self.less = cuts.reshape(2, -1)

    def find(self, place: np.ndarray) -> np.ndarray:
        """Local numbers of the ids at these places of P0, one per lane, where ids that it has seen lie there."""
        m = len(place)
        at = self.bucket.take((place >> self.shift) + self.bucket_row[:m], mode="clip")
        place = place.astype(np.uint32) + self.lift32[:m]
        for h in self.steps:
            at += (self.table.take(at + h, mode="clip") <= place) * np.int32(h)
        return at - self.table_row[:m]

    def others(self, b: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Local numbers of ids at places of P0 behind the ids that it has seen, in the lanes ``b``."""
        if self.most + 2 >= self.cap:
            self._room()
        place = np.minimum(place, self.total[b] - 1)
        on = place - self.rest[b]
        on += self.less.take(np.searchsorted(self.cuts, on + self.lift[b], "right") - 1)
        x = self.id_at.take(on)
        at = self.known_row[b] + x
        local = self.known.take(at).astype(np.int64)
        new = local == 0
        self.most += 1
        self.last[b] += new
        local = np.where(new, self.last[b], local)
        self.known[at] = local
        here = self.row[b] + local
        self.name[here] = x
        self.span[here] = place - on + self.line.take(x) | self.base.take(x) << 32
        return local


def _decode(codes, lengths, size):
    lanes, n = len(codes), lengths[0]
    words = [np.frombuffer(c, "<u4") for c in codes]
    wide = max(len(w) for w in words) + 1
    data = np.zeros((lanes, wide), np.uint32)
    for i, w in enumerate(words):
        data[i, :len(w)] = w
    data, at = data.ravel(), np.arange(lanes, dtype=np.int64) * wide
    code, at, stop = data[at].astype(U) << U(32) | data[at + 1], at + 2, at + wide - 1
    rng = np.full(lanes, U(0xFFFFFFFFFFFFFFFF))
    model, lane = _Lanes(lanes, size, n), np.arange(lanes, dtype=np.int64)
    one, two = np.zeros(lanes << ORDER1_BITS, np.int32), np.zeros(lanes << ORDER2_BITS, np.int32)
    lane1, lane2, lane_state = lane << ORDER1_BITS, lane << ORDER2_BITS, lane * STATES
    counts = np.full(lanes * STATES, 1 | 1 << 20 | 1 << 40, np.int64)
    mask, low = np.int64((1 << 20) - 1), np.int64(LOW32)
    local = np.zeros((n, lanes), np.uint32)
    prev = prev2 = np.zeros(lanes, np.uint32)
    active, places, since = np.searchsorted(-np.array(lengths), -np.arange(n), "left").tolist(), set(renewals(n)), 0
    for t in range(n):
        if t in places:
            # lanes that have ended go on with local number 0, which nothing reads
            model.renew(t, local[since:t])
            since = t
        m = active[t]
        s1, s2 = _contexts(prev[:m], prev2[:m])
        s1, s2 = lane1[:m] + s1, lane2[:m] + s2
        e1, e2 = one.take(s1), two.take(s2)
        g1, g2 = e1 >> 2, e2 >> 2
        own = (g1 != g2) & (e1 > 0)
        where = lane_state[:m] + ((e2 & 3) * 8 + (e1 & 3) * 2 + own)
        c = counts.take(where)
        c2, c1 = c & mask, c >> 20 & mask
        w2, w1, w0 = _weights(c2, c1, c2 + c1 + (c >> 40), e2, own)
        total, row = model.total[:m], model.row[:m]
        span2, span1 = model.span.take(row + g2), model.span.take(row + g1)
        start2, start1 = span2 & low, span1 & low
        m2, m1 = total * w2, total * w1
        whole = total * MIX
        step = rng[:m] // whole.view(U)
        value = np.minimum((code[:m] // step).view(np.int64), whole - 1)
        # the masses of the two guesses lie on top of P0: those below the value are taken off
        less = start2 < start1
        from2, from1 = value - (w0 * start2 + m1 * ~less), value - (w0 * start1 + m2 * less)
        past2, past1 = from2 >= 0, from1 >= 0
        is2, is1 = past2 & (from2 < w0 * (span2 >> 32) + m2), past1 & (from1 < w0 * (span1 >> 32) + m1)
        place = ((value - m2 * past2 - m1 * past1) / w0).astype(np.int64)
        x = model.find(place)
        is1 |= is2
        b = np.flatnonzero((place >= model.rest[:m]) > is1)
        x = np.where(is1, np.where(is2, g2, g1), x)
        if len(b):
            x[b] = model.others(b, place[b])
            row = model.row[:m]
        span = model.span.take(row + x)
        start = span & low
        hit2, hit1 = g2 == x, g1 == x
        code[:m] -= (w0 * start + m2 * (start2 < start) + m1 * (start1 < start)).view(U) * step
        rng[:m] = (w0 * (span >> 32) + m2 * hit2 + m1 * hit1).view(U) * step
        a = np.flatnonzero(rng[:m] <= LOW32)
        if len(a):
            place = at[a]
            code[a] = code[a] << U(32) | data[place]
            at[a] = np.minimum(place + 1, stop[a])
            rng[a] <<= U(32)
        counts[where] = c + np.where(hit2, 1, np.where(hit1, 1 << 20, 1 << 40))
        hold = x * 4 + 1
        one[s1] = hold + hit1 * np.minimum(e1 & 3, 2)
        two[s2] = hold + hit2 * np.minimum(e2 & 3, 2)
        local[t, :m] = x
        prev2, prev = prev, local[t]
    return [model.names[i, local[:k, i]] for i, k in enumerate(lengths)]


def _apply(matrix: list[int], v: int) -> int:
    out = 0
    for row in matrix:
        if not v:
            break
        if v & 1:
            out ^= row
        v >>= 1
    return out


def _zero_steps() -> list[list[int]]:
    """The effect on a checksum of 1, 2, 4, ... zero bits, as matrices over GF(2)."""
    steps = [[0xEDB88320] + [1 << i for i in range(31)]]
    for _ in range(60):
        steps.append([_apply(steps[-1], row) for row in steps[-1]])
    return steps


def crc32_join(a: int, b: int, length: int) -> int:
    """CRC-32 of two byte strings put together, from theirs and the second one's length."""
    cache = worker_cache()
    if "crc32" not in cache:
        cache["crc32"] = _zero_steps()
    for i, matrix in enumerate(cache["crc32"]):
        if 8 * length >> i & 1:
            a = _apply(matrix, a)
    return a ^ b


MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
MARKS_OR_REST = re.compile("[!-&(-/:-@\\[-`{-~]+|[^!-&(-/:-@\\[-`{-~]+")


class _Texts:
    """Ids of texts by the tokenizers library, memorised by the parts between white space, which
    the vocabulary's tokens never cross."""

    def __init__(self, path: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.end = np.array([end_id], np.uint16 if self.size <= 1 << 16 else np.uint32)
        self.kind = self.end.dtype
        # words that are normal need no normalizer, and the suffix of their last tokens shows where each ends
        self.words = Tokenizer(self.tokenizer.model)
        if self.tokenizer.pre_tokenizer is not None:
            self.words.pre_tokenizer = self.tokenizer.pre_tokenizer
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.ends = np.zeros(self.size, bool)
        self.ends[[i for token, i in self.tokenizer.get_vocab().items() if suffix and token.endswith(suffix)]] = True
        upper, lower = (self.tokenizer.encode(x, add_special_tokens=False).ids for x in (string.ascii_uppercase, string.ascii_lowercase))
        self.folds = upper == lower
        #: Two generations: parts that come up again move from the old one to the new one.
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _library(self, parts: list[str]) -> None:
        for p, e in zip(parts, self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)):
            self.known[p] = np.array(e.ids, self.kind).tobytes()

    def _library_words(self, words: list[str]) -> None:
        """The same for normal words of letters, many at a time."""
        ids = np.array(self.words.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, self.kind)
        ends = ((np.flatnonzero(self.ends[ids]) + 1) * ids.itemsize).tolist()
        if len(ends) != len(words):                              # another kind of vocabulary
            return self._library(words)
        data = ids.tobytes()
        self.known.update({w: data[a:b] for w, a, b in zip(words, [0, *ends], ends)})

    def _new(self, parts) -> list[str]:
        """Those of ``parts`` that neither generation holds; ``known`` gets those that the old one holds."""
        known, old, new = self.known, self.old, []
        for p in parts:
            if p not in known:
                e = old.get(p)
                if e is None:
                    new.append(p)
                else:
                    known[p] = e
        return new

    def _split(self, part: str) -> list[str] | None:
        """Words and marks of a part, split as the vocabulary's pre-tokenizer does, where that is plain."""
        if self.folds and part.isascii():
            part = part.lower()
        core = part.rstrip(MARKS)
        if core.isalpha() and core.lower().isalnum():
            return [core, part[len(core):]] if len(core) < len(part) else [core]
        pieces = MARKS_OR_REST.findall(part)
        return pieces if all(y[0] in MARKS or y.isalnum() and y.lower().isalnum() for y in pieces) else None

    def _fill(self, parts: set[str]) -> None:
        """Makes ``known`` hold all of ``parts``; parts that are not plain go to the library whole."""
        if len(self.known) > CHUNKS_KEPT:
            self.known, self.old = {}, self.known
        missing = self._new(parts)
        split = {p: x for p in missing if "'" not in p and "<|" not in p and (x := self._split(p))}
        pieces = self._new({y for x in split.values() for y in x} | (set(missing) - split.keys()))
        words = [y for y in pieces if y.isalpha() and y == y.lower() and (y.isascii() or unicodedata.is_normalized("NFC", y))]
        if words:
            self._library_words(words)
        self._library(list(set(pieces).difference(words)))
        for p, x in split.items():
            self.known[p] = b"".join([self.known[y] for y in x])

    def ids(self, text: str) -> np.ndarray:
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):          # white space to str.split() only
            found = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind)
            return np.concatenate([found, self.end])
        # special tokens are found before the case is folded
        parts = (text.lower() if self.folds and text.isascii() and "<|" not in text else text).split()
        found = list(map(self.known.get, parts))
        if None in found:
            self._fill({p for p, e in zip(parts, found) if e is None})
            found = [self.known[p] if e is None else e for p, e in zip(parts, found)]
        data = b"".join(found)
        return np.concatenate([np.frombuffer(data, self.kind), self.end])


def _texts(path: str, end_id: int) -> _Texts:
    cache = worker_cache()
    if ("tokenizer", path, end_id) not in cache:
        cache["tokenizer", path, end_id] = _Texts(path, end_id)
    return cache["tokenizer", path, end_id]


def pack(ids: np.ndarray, code: bytes, segments: list[tuple], first_doc: int) -> bytes:
    """A block's payload.  A segment is (document id or None, number of ids, starts here, ends here)."""
    names = np.array([0 if s[0] is None else s[0] for s in segments], "<i8")
    counts = np.array([s[1] for s in segments], "<u4")
    flags = np.array([(s[0] is not None) | s[2] << 1 | s[3] << 2 for s in segments], "u1")
    index = zlib.compress(names.tobytes() + counts.tobytes() + flags.tobytes())
    return struct.pack(HEADER, MAGIC, len(ids), len(segments), len(index), zlib.crc32(ids.astype("<u4").tobytes()), first_doc) + index + code


def unpack(payload: bytes):
    """(n_ids, segments, checksum, first document's number, code) of a block's payload."""
    magic, n, k, size, check, first_doc = struct.unpack_from(HEADER, payload)
    if magic != MAGIC:
        raise ValueError("not a block of token ids")
    index = zlib.decompress(payload[struct.calcsize(HEADER):struct.calcsize(HEADER) + size])
    names, counts, flags = (np.frombuffer(index, t, k, o) for t, o in (("<i8", 0), ("<u4", 8 * k), ("u1", 12 * k)))
    segments = [(int(a) if f & 1 else None, int(c), bool(f & 2), bool(f & 4)) for a, c, f in zip(names, counts, flags)]
    return n, segments, check, first_doc, payload[struct.calcsize(HEADER) + size:]


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
                      end_id: int = END_ID, block_tokens: int = BLOCK_TOKENS) -> None:
    """Writes the ids of every document, each followed by ``end_id``, in ascending id order."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    rows = (rows.repartitionByRange(n, F.col("id").asc_nulls_first()).sortWithinPartitions(F.col("id").asc_nulls_first(), F.xxhash64("text"))
            .withColumn("part", F.spark_partition_id()))

    def write(batches):
        texts = _texts(tokenizer_path, end_id)
        done, part, doc_no = 0, None, 0
        ready: list[tuple[np.ndarray, list, int]] = []
        held, segments, room, first_doc = [], [], block_tokens, 0

        def flush():
            nonlocal done
            codes = encode_blocks([b for b, _, _ in ready], texts.size)
            out = pa.RecordBatch.from_arrays(
                [pa.array([part] * len(ready), pa.int32()), pa.array(range(done, done + len(ready)), pa.int64()),
                 pa.array([pack(b, c, s, f) for (b, s, f), c in zip(ready, codes)], pa.binary())], ["part", "block", "payload"])
            done += len(ready)
            ready.clear()
            return out

        for batch in batches:
            for part, name, text in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                ids = texts.ids(text)
                at = 0
                while at < len(ids):
                    take = min(room, len(ids) - at)
                    if not held:
                        first_doc = doc_no
                    held.append(ids[at:at + take])
                    segments.append((name, take, at == 0, at + take == len(ids)))
                    at, room = at + take, room - take
                    if not room:
                        ready.append((np.concatenate(held).astype(np.int64), segments, first_doc))
                        held, segments, room = [], [], block_tokens
                        if len(ready) == LANES:
                            yield flush()
                doc_no += 1
        if held:
            ready.append((np.concatenate(held).astype(np.int64), segments, first_doc))
        if ready:
            yield flush()

    rows.select("part", "id", "text").mapInArrow(write, "part int, block long, payload binary").write.option(
        "compression", "uncompressed").parquet(path)


def read_segments(spark: SparkSession, path: str, size: int, with_ids: bool = False) -> DataFrame:
    """What the files hold: part, doc_no (in the part), block, id, n, crc32, whole (the document is
    in this block alone) and, if asked for, its ids there."""
    schema = "part int, doc_no long, block long, id long, n long, crc32 long, whole boolean" + ", ids array<int>" * with_ids

    def read(batches):
        for b in batches:
            for at in range(0, len(b), LANES):
                sub = b.iloc[at:at + LANES]
                heads = [unpack(bytes(p)) for p in sub["payload"]]
                found = decode_blocks([h[4] for h in heads], [h[0] for h in heads], size)
                out = []
                for part, block, (n, segments, check, first_doc, _), ids in zip(sub["part"], sub["block"], heads, found):
                    raw = memoryview(ids.astype("<u4").tobytes())
                    if zlib.crc32(raw) != check:
                        raise ValueError(f"block {block} of part {part} is damaged")
                    place = 0
                    for k, (name, count, starts, ends) in enumerate(segments):
                        row = (part, first_doc + k, block, name, count, zlib.crc32(raw[4 * place:4 * (place + count)]), starts and ends)
                        out.append((*row, ids[place:place + count]) if with_ids else row)
                        place += count
                # as objects: a NULL beside them would turn the ids into doubles
                yield pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")], dtype=object)

    return spark.read.schema("part int, block long, payload binary").parquet(path).mapInPandas(read, schema)


def read_documents(spark: SparkSession, path: str, size: int) -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every document in the files."""
    segments = stored(read_segments(spark, path, size), "token-segments")

    columns = ["part", "doc_no", "id", "n", "crc32"]

    def batch_of(rows):
        arrays = [pa.array([r[i] for r in rows], pa.int64() if i else pa.int32()) for i in range(len(columns))]
        return pa.RecordBatch.from_arrays(arrays, columns)

    def join(batches):
        """Puts the segments of a document, which follow one another, together as they come."""
        held = None
        for b in batches:
            out = []
            for part, doc_no, name, n, crc in zip(*[b.column(i).to_pylist() for i in range(len(columns))]):
                if held is not None and held[:2] == [part, doc_no]:
                    held[4] = crc32_join(held[4], crc, 4 * n)
                    held[3] += n
                else:
                    out += [held] * (held is not None)
                    held = [part, doc_no, name, n, crc]
            yield batch_of(out)
        if held is not None:
            yield batch_of([held])

    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cut = (segments.where("NOT whole").select(*columns, "block").repartition(parts, "part", "doc_no")
           .sortWithinPartitions("part", "doc_no", "block").select(*columns).mapInArrow(join, "part int, doc_no long, id long, n long, crc32 long"))
    docs = segments.where("whole").select(*columns).unionByName(cut)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)     # one row per part
    base = segments.groupBy("part").agg(F.sum("n").alias("_n")).select(F.col("part").alias("_p"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("part").orderBy("doc_no").rowsBetween(Window.unboundedPreceding, -1)
    return (docs.withColumn("_in", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(F.broadcast(base), F.col("part") == F.col("_p"))
            .select("id", (F.col("_base") + F.col("_in")).cast("long").alias("start"), F.col("n").alias("n_tokens"), F.col("crc32").alias("ids_crc32")))
