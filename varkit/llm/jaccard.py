"""N-gram Jaccard self-join by universe partitioning and the pigeonhole principle.

A document is the set of its 5-word shingles (64-bit hashes).  Sets x and y with Jaccard
similarity of at least t differ in at most (1-t)/(1+t) * (|x|+|y|) shingles.  For each band of set
sizes the universe of shingles is hashed into more segments than that, so two linked sets agree
on whole segments: the subset of a set that falls into a segment is a signature, and linked sets
share signatures.  A set is indexed in its own band and, if it can be the smaller partner, in the next.

Allocation by cost: in bands of small sets, where segments would be left with hardly a shingle, half as
many segments are used and each gives its subset plus its one-deletion neighbourhood, which finds
segments that differ in one shingle.  In both kinds of band empty segments say nothing and are skipped while
a set's other segments suffice; only a set for which they don't adds them.  A set must share a minimum
number of signatures to have any partner at all; sets with fewer leave the join, and the others
probe with the rarest of theirs, so signatures of common passages are left out.

Links found are verified exactly on the whole sets.  The result is connected components, so a
large group need not be expanded into all its pairs: first each set is verified against one leader of its
signatures, then only pairs between different components are left.  Nothing is dropped: every
pair that shares a probed signature is inside a component already, ruled out by a bound, or verified.
The bound is the number of bits in which the sets' parity vectors differ (each bit is the parity
of the number of shingles in one hash bucket), which the symmetric difference can't be smaller than; it is tested
inside the join, so a large group of half-similar texts yields no rows for its pairs.

Signatures that repeat inside one batch of rows are combined before the shuffle, and so are equal
sets, so a group of copies enters the shuffle once per batch.

Edge cases: NULL or word-less text is the empty set, linked with nothing; a text with fewer words than
a shingle is one shingle of all its words.  Rows that share an id are one node, linked by
either text; each row keeps its own size.  A row with a NULL id is not linked and gets a NULL component.
An empty table gives an empty result.  Only the id and text columns are read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from varkit.llm.common import stored, text_or_empty

WORDS = 5
#: Similarity of at least 80 percent; segments per shingle of the largest set of a band; the
#: largest band with one-deletion signatures.
PERCENT, SEGMENT_SHARE, DELETION_UP_TO = 80, 0.26, 48
GROWTH = 1.5
PIECE = 1 << 20

U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _salt(*numbers: int) -> U:
    x = np.zeros(1, U)
    with np.errstate(over="ignore"):
        for n in numbers:
            x = _mix(x * U(0x9E3779B97F4A7C15) + U(n & (1 << 64) - 1) + U(1))
    return x[0]


class Hasher:
    """Hashes of words and shingles of whole texts."""

    def __init__(self, words: int = WORDS):
        self.words = words
        base = np.arange(256, dtype=U)
        base[65:91] += U(32)                                   # A-Z as a-z
        self.value = _mix(base + U(0x51ED270B))
        space = np.zeros(256, bool)
        space[[9, 10, 11, 12, 13, 32]] = True
        self.space = space
        self.root = U(0x2545F4914F6CDD1D)                       # odd, so it has an inverse modulo 2**64
        self.inverse = U(pow(int(self.root), -1, 1 << 64))
        self._powers = (np.ones(1, U), np.ones(1, U))
        self.factor = _mix(np.arange(words, dtype=U) + U(77)) | U(1)

    def _upto(self, n: int):
        if len(self._powers[0]) < n:
            with np.errstate(over="ignore"):
                self._powers = tuple(np.cumprod(np.concatenate([np.ones(1, U), np.full(n, r, U)])) for r in (self.root, self.inverse))
        return self._powers

    def word_hashes(self, data: np.ndarray) -> np.ndarray:
        """Hash of each word of a text's bytes, by prefix sums of a polynomial; the text is taken
        in pieces that end between words."""
        out, at, n = [], 0, len(data)
        while at < n:
            end = min(at + PIECE, n)
            while end < n and not self.space[data[end]]:
                look = data[end:end + 4096]
                stop = np.flatnonzero(self.space[look])
                end += int(stop[0]) if len(stop) else len(look)
            piece = data[at:end]
            inside = ~self.space[piece]
            edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
            first, last = edge[::2], edge[1::2]
            up, down = self._upto(len(piece) + 1)
            with np.errstate(over="ignore"):
                total = np.concatenate([np.zeros(1, U), np.cumsum(self.value[piece] * up[:len(piece)])])
                out.append(_mix((total[last] - total[first]) * down[first] + (last - first).astype(U)))
            at = end
        return np.concatenate(out) if out else np.zeros(0, U)

    def shingles(self, text: str) -> np.ndarray:
        """The distinct shingles of a text, ascending."""
        w = self.word_hashes(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8))
        if not len(w):
            return w
        k = min(self.words, len(w))
        n = len(w) - k + 1
        with np.errstate(over="ignore"):
            s = np.full(n, _salt(k), U)
            for i in range(k):
                s += w[i:i + n] * self.factor[i]
        return np.unique(_mix(s))


def bands(largest: int) -> list[tuple[int, int]]:
    """(lowest, highest) size of each band, up to the band of ``largest``."""
    out, hi = [], 0
    while hi < largest:
        lo = hi + 1
        hi = max(lo, int(hi * GROWTH)) if hi > 3 else (lo if lo < 4 else 6)
        out.append((lo, hi))
    return out


def most_different(x: int, y: int, percent: int = PERCENT) -> int:
    """Largest size of the symmetric difference of linked sets of these sizes."""
    return (100 - percent) * (x + y) // (100 + percent)


def allocation(hi: int, percent: int = PERCENT) -> tuple[int, bool]:
    """(segments, with one-deletion neighbourhoods) of the band up to ``hi``."""
    h = most_different(hi, hi, percent)
    if h == 0:
        return 1, False
    if hi < DELETION_UP_TO:
        return h // 2 + 2, True
    return max(h + 1, int(SEGMENT_SHARE * hi)) + 2, False


def signatures(s: np.ndarray, band: int, lo: int, hi: int, percent: int = PERCENT) -> tuple[np.ndarray, int]:
    """The signatures of a set in a band, and how many of them, at least, any partner shares."""
    m, deletions = allocation(hi, percent)
    n = len(s)
    h = most_different(n, min(hi, 100 * n // percent), percent)
    segment = (_mix(s ^ _salt(band, 1)) % U(m)).astype(np.int64)
    token = _mix(s ^ _salt(band, 2))
    order = np.argsort(segment, kind="stable")
    segment, token = segment[order], token[order]
    size = np.bincount(segment, minlength=m)
    with np.errstate(over="ignore"):
        total = np.zeros(m, U)
        full = np.flatnonzero(size)
        total[full] = np.add.reduceat(token, np.concatenate([[0], np.cumsum(size[full])[:-1]]))
        name = _mix(np.arange(m, dtype=U) + _salt(band, 3))
        weight = int(np.minimum(size, 2 if deletions else 1).sum())
        short = weight <= h                                      # needs its empty segments as well
        keep = np.ones(m, bool) if short else size > 0
        out = [_mix(total[keep] + name[keep])]
        if deletions:
            left = np.ones(n, bool) if short else size[segment] > 1
            out.append(_mix(total[segment[left]] - token[left] + name[segment[left]]))
    need = 1 if deletions or short else max(1, int(len(full)) - h)
    return np.concatenate(out), need


#: Kinds of the rows of ``INDEXED``: a document's size; a band's minimum of shared signatures; a
#: signature; one that has members in its own batch; such a member, whose key is
#: the signature xor ``_spread`` of the id; a copy within a batch, whose key is the id that it copies.
DOCUMENT, MINIMUM, SIGNATURE, LEADER, MEMBER, COPY = range(6)
#: ``meta`` is the kind, the band (8 bits on) and the size or minimum (16 bits on).
INDEXED = "key long, id long, meta long"
PARITY_WORDS = 8


def _spread(ids: np.ndarray) -> np.ndarray:
    """A different 64-bit number for each id, the same as ``spread_column``."""
    with np.errstate(over="ignore"):
        x = np.asarray(ids, np.int64).view(U)
        x = x ^ (x << U(21))
        x = x ^ (x >> U(35))
        x = x ^ (x << U(4))
    return x.view(np.int64)


SPREAD_SQL = """transform(array(id), x -> transform(array(x ^ shiftleft(x, 21)), y -> transform(
    array(y ^ shiftrightunsigned(y, 35)), z -> z ^ shiftleft(z, 4))[0])[0])[0]"""


def parity(s: np.ndarray) -> np.ndarray:
    """The set's parity vector."""
    bit = _mix(s ^ _salt(99))
    out = np.zeros(PARITY_WORDS, U)
    np.bitwise_xor.at(out, (bit >> U(6)) % U(PARITY_WORDS), U(1) << (bit & U(63)))
    return out.view(np.int64)


def index_batch(ids: np.ndarray, texts, copied: np.ndarray, hasher: Hasher, percent: int = PERCENT) -> pd.DataFrame:
    """Rows of kind ``INDEXED`` for a batch of documents with ids.  Of ``copied`` ones only the size is given."""
    parts, seen, table = [], {}, bands(4)
    doc_n, copies, sigs, sig_id, sig_band, minima = [], [], [], [], [], []
    for i, text, copy in zip(ids, texts, copied):
        s = hasher.shingles(text)
        n = len(s)
        doc_n.append(n)
        if not n or copy:
            continue
        with np.errstate(over="ignore"):
            mark = (n, int(_mix(s).sum()), int(_mix(s ^ U(0xABCDEF12345)).sum()))
        if mark in seen:
            copies.append((i, seen[mark]))
            continue
        seen[mark] = i
        if table[-1][1] < 2 * n:
            table = bands(2 * n)
        own = next(k for k, (_, hi) in enumerate(table) if n <= hi)
        for band in (own, own + 1):
            lo, hi = table[band]
            if band == own or 100 * n >= percent * lo:
                out, need = signatures(s, band, lo, hi, percent)
                sigs.append(out)
                sig_id.append(np.full(len(out), i, np.int64))
                sig_band.append(np.full(len(out), band, np.int32))
                minima.append((i, band, need))

    def rows(kind, key, id_, band=0, n=0):
        meta = np.asarray(kind, np.int64) | np.asarray(band, np.int64) << 8 | np.asarray(n, np.int64) << 16
        parts.append(pd.DataFrame({"key": key, "id": id_, "meta": np.broadcast_to(meta, id_.shape)}))

    all_ids = np.asarray(ids, np.int64)
    rows(DOCUMENT, _spread(all_ids), all_ids, n=np.asarray(doc_n, np.int64))
    if copies:
        c = np.asarray(copies, np.int64)
        rows(COPY, c[:, 1], c[:, 0])
    if minima:
        c = np.asarray(minima, np.int64)
        rows(MINIMUM, _spread(c[:, 0]), c[:, 0], c[:, 1], c[:, 2])
    if sigs:
        sig, who, band = np.concatenate(sigs).view(np.int64), np.concatenate(sig_id), np.concatenate(sig_band)
        order = np.lexsort((who, sig))
        sig, who, band = sig[order], who[order], band[order]
        first = np.concatenate([[True], sig[1:] != sig[:-1]])
        leads = first & np.concatenate([~first[1:], [False]])
        rows(np.where(leads, LEADER, SIGNATURE)[first], sig[first], who[first], band[first])
        rows(MEMBER, sig[~first] ^ _spread(who[~first]), who[~first], band[~first])
    return pd.concat(parts, ignore_index=True)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for the nodes of ``edges``; the component is its smallest node.

    Every node points to its smallest neighbour or itself, pointers are followed to their ends, the
    path halving with each step, and the edges between different ends form the next graph.  Ends
    are nodes without a smaller neighbour, at most half of the nodes of a component, so rounds and the steps
    of a round are each at most log2 of the largest component: a sorted chain takes one round.  Each
    step is a written table.
    """
    left = stored(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct(), "edges")
    done = left.select(F.col("a").alias("node")).union(left.select("b")).distinct().withColumn("component", F.col("node"))
    while not left.isEmpty():
        both = left.union(left.select("b", "a"))
        up = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("to"))
        moved = True
        while moved:
            over = up.select(F.col("a").alias("_x"), F.col("to").alias("_y"))
            up = stored(up.join(over, F.col("to") == F.col("_x")).select("a", F.col("_y").alias("to"), (F.col("to") != F.col("_y")).alias("moved")), "pointers")
            moved = not up.where("moved").isEmpty()
        done = stored(done.join(up, F.col("component") == F.col("a"), "left")
                      .select("node", F.coalesce("to", "component").alias("component")), "components")
        x = up.select(F.col("a").alias("_a"), F.col("to").alias("_ta"))
        y = up.select(F.col("a").alias("_b"), F.col("to").alias("_tb"))
        left = stored(left.join(x, F.col("a") == F.col("_a")).join(y, F.col("b") == F.col("_b"))
                      .select(F.greatest("_ta", "_tb").alias("a"), F.least("_ta", "_tb").alias("b")).where("a <> b").distinct(), "edges")
    return done


def verified(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) whose sets are linked.  Sizes are compared before sets move."""
    size = sets.select(F.col("id").alias("_i"), F.col("n").alias("_n"))
    x, y = size.toDF("_ia", "_na"), size.toDF("_ib", "_nb")
    near = (pairs.join(x, F.col("a") == F.col("_ia")).join(y, F.col("b") == F.col("_ib"))
            .where((100 * F.col("_na") >= percent * F.col("_nb")) & (100 * F.col("_nb") >= percent * F.col("_na"))).select("a", "b").distinct())
    x, y = sets.select("id", "shingles").toDF("_ia", "_sa"), sets.select("id", "shingles").toDF("_ib", "_sb")
    met = near.join(x, F.col("a") == F.col("_ia")).join(y, F.col("b") == F.col("_ib"))
    common = F.size(F.array_intersect("_sa", "_sb"))
    return met.where(100 * common >= percent * (F.size("_sa") + F.size("_sb") - common)).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """(id, n_shingles, component_id) per row of ``docs``."""
    from varkit.llm.url_filter import bloom_blocks, probe
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), text_or_empty(text_col).alias("text"))

    # Equal texts first: a copy is linked to the smallest id that has its text and is indexed no
    # more.  Only the rows that may be copies (a Bloom filter's hits) meet the list of copies.
    named = rows.where(F.col("id").isNotNull() & F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    digests = stored(named.select("id", F.sha2("text", 256).alias("d")), "digests")
    first = digests.groupBy("d").agg(F.min("id").alias("b"), F.max("id").alias("_last")).where("b <> _last").withColumnRenamed("d", "_d")
    equal = stored(digests.join(first, F.col("d") == F.col("_d")).where("id <> b").select(F.col("id").alias("a"), "b", "d").distinct(), "equal")
    size = max(1, min(65536, -(-equal.count() * 16 // 512)))
    probed = probe(rows.where("id IS NOT NULL"), "id", bloom_blocks(equal, "a", size), size)
    gone = equal.select(F.col("a").alias("_a"), F.col("d").alias("_d"))
    hits = probed.where("_maybe").withColumn("_digest", F.sha2("text", 256)).join(
        gone, (F.col("id") == F.col("_a")) & (F.col("_digest") == F.col("_d")), "left")
    calm = probed.where("NOT _maybe").select("id", "text", F.lit(False).alias("copy"))
    texts = calm.unionByName(hits.select("id", "text", F.col("_a").isNotNull().alias("copy")))

    def index(batches):
        hasher = Hasher(words)
        for b in batches:
            if len(b):
                yield index_batch(b["id"].to_numpy(), b["text"], b["copy"].to_numpy(), hasher, percent)

    indexed = texts.mapInPandas(index, INDEXED)
    kind = F.col("meta").bitwiseAND(F.lit(255))
    # only signatures that two batches have, or two members of one, go on
    w = Window.partitionBy("key").orderBy("id")
    is_sig = kind == SIGNATURE
    met = stored(indexed.withColumns({"_next": F.lead("id").over(w), "_back": F.lag("id").over(w)})
                 .where(~is_sig | F.col("_next").isNotNull() | F.col("_back").isNotNull())
                 .select("key", "id", kind.cast("int").alias("kind"), F.shiftright("meta", 8).bitwiseAND(F.lit(255)).cast("int").alias("band"),
                         F.shiftright("meta", 16).alias("n")), "signatures")

    documents = met.where(F.col("kind") == DOCUMENT).select("id", "n")
    copies = met.where(F.col("kind") == COPY).select(F.col("id").alias("a"), F.col("key").alias("b"))
    # Sets that share fewer signatures than any partner would share with them leave.  A group is one
    # set's signatures in a band, with the row that holds its minimum.
    is_member = F.col("kind").isin(SIGNATURE, LEADER, MEMBER)
    mine = Window.partitionBy("id", "band")
    members = (met.where(is_member | (F.col("kind") == MINIMUM))
               .withColumns({"need": F.min(F.when(F.col("kind") == MINIMUM, F.col("n"))).over(mine), "_shared": F.count(F.when(is_member, 1)).over(mine)})
               .where(is_member & (F.col("_shared") >= F.col("need")))
               .select(F.when(F.col("kind") == MEMBER, F.expr(f"key ^ {SPREAD_SQL}")).otherwise(F.col("key")).alias("sig"), "id", "band", "need"))
    sizes = members.groupBy("sig").agg(F.count(F.lit(1)).alias("held"), F.min("id").alias("leader")).where("held > 1").withColumnRenamed("sig", "_s")
    members = stored(members.join(sizes, F.col("sig") == F.col("_s")).drop("_s"), "members")

    # the sets of those that are left
    wanted = stored(members.select("id").distinct(), "wanted")
    blocks = max(1, min(65536, -(-wanted.count() * 16 // 512)))
    passing = probe(rows, "id", bloom_blocks(wanted, "id", blocks), blocks).where("_maybe").drop("_maybe")

    def sets_of(batches):
        hasher = Hasher(words)
        for b in batches:
            s = [hasher.shingles(t) for t in b["text"]]
            yield pd.DataFrame({"id": b["id"], "n": [len(x) for x in s], "shingles": [x.view(np.int64) for x in s], "parity": [parity(x) for x in s]})

    of_sets = "id long, n long, shingles array<long>, parity array<long>"
    sets = stored(passing.join(wanted, "id", "left_semi").mapInPandas(sets_of, of_sets), "sets")

    # round 1: every set against the leader that it meets most often
    often = (members.where("leader <> id").groupBy("id", "leader").agg(F.count(F.lit(1)).alias("c"))
             .groupBy("id").agg(F.max_by("leader", F.struct("c", -F.col("leader"))).alias("leader")))
    links = stored(verified(often.toDF("a", "b"), sets, percent).unionByName(copies).unionByName(equal.select("a", "b")), "links")
    of = components(links)

    # round 2: pairs between components, one side probing with its rarest signatures
    placed = members.join(of.withColumnRenamed("node", "_n"), F.col("id") == F.col("_n"), "left").select(
        "sig", "id", "band", "held", "need", F.coalesce("component", "id").alias("c"))
    several = placed.groupBy("sig").agg(F.min("c").alias("_lo"), F.max("c").alias("_hi")).where("_lo <> _hi").select(F.col("sig").alias("_s"))
    own = Window.partitionBy("id", "band")
    # all that a set shares with sets of other components is here, and it shares at least ``need``
    # with a partner: leaving out the need - 1 most frequent can't miss it
    placed = placed.join(several, F.col("sig") == F.col("_s")).drop("_s").withColumns(
        {"_rank": F.row_number().over(own.orderBy("held", "sig")), "_here": F.count(F.lit(1)).over(own)})
    marks = sets.select(F.col("id").alias("_i"), "n", *[F.col("parity")[i].alias(f"p{i}") for i in range(PARITY_WORDS)])
    placed = stored(placed.join(marks, F.col("id") == F.col("_i")).select(
        "sig", "id", "c", (F.col("_rank") <= F.col("_here") - F.col("need") + 1).alias("probes"), "n", *[f"p{i}" for i in range(PARITY_WORDS)]), "placed")
    x, y = placed.where("probes").alias("x"), placed.alias("y")
    apart = " + ".join(f"bit_count(x.p{i} ^ y.p{i})" for i in range(PARITY_WORDS))
    near = F.expr(f"x.sig = y.sig AND x.c <> y.c AND 100 * x.n >= {percent} * y.n AND 100 * y.n >= {percent} * x.n "
                  f"AND ({apart}) * {100 + percent} <= {100 - percent} * (x.n + y.n)")
    found = x.join(y, near).select(F.greatest("x.id", "y.id").alias("a"), F.least("x.id", "y.id").alias("b")).distinct()
    links = stored(verified(found, sets, percent), "links")
    la, lb = of.toDF("_x", "_cx"), of.toDF("_y", "_cy")
    bridges = (links.join(la, F.col("a") == F.col("_x"), "left").join(lb, F.col("b") == F.col("_y"), "left")
               .select(F.coalesce("_cx", "a").alias("a"), F.coalesce("_cy", "b").alias("b")))
    over = components(bridges).toDF("_k", "_top")

    nodes = documents.join(of.withColumnRenamed("node", "_n"), F.col("id") == F.col("_n"), "left").select(
        "id", "n", F.coalesce("component", "id").alias("c"))
    out = nodes.join(over, F.col("c") == F.col("_k"), "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("_top", "c").alias("component_id"))
    nameless = rows.where("id IS NULL").mapInPandas(sets_of, of_sets).select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"))
    return out.unionByName(nameless)


def one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each component the row with the smallest id
    stays, unchanged.  Rows without words or without an id are in no group and stay.  Of rows that
    share an id that stays, one is kept (the smallest by text hash)."""
    from varkit.llm.url_filter import bloom_blocks, probe
    groups = stored(near_duplicates(docs, id_col, text_col, percent, words), "groups").where("n_shingles > 0").toDF("_id", "_n", "_c")
    repeated = groups.groupBy("_id").agg(F.count(F.lit(1)).alias("_rows"), F.max(F.col("_c") != F.col("_id")).alias("_gone"))
    touched = stored(repeated.where("_gone OR _rows > 1"), "touched")
    blocks = max(1, min(65536, -(-touched.count() * 16 // 512)))
    # few rows pass the filter; the others stay where they are, so their texts aren't shuffled
    text = text_or_empty(text_col)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(f"`{id_col}`").cast("long").alias("_key"),
                       text.rlike(r"[^\x20\x09-\x0D]").alias("_has"), F.xxhash64(text).alias("_order"))
    probed = probe(rows, "_key", bloom_blocks(touched, "_id", blocks), blocks)
    calm = probed.where("NOT _maybe")
    met = probed.where("_maybe").join(touched, F.col("_key") == F.col("_id"), "left").where("_gone IS NULL OR NOT _gone OR NOT _has")
    once = (F.col("_rows") > 1) & F.col("_has")
    first = met.where(once).withColumn("_k", F.row_number().over(Window.partitionBy("_key").orderBy("_order"))).where("_k = 1")
    rest = met.where(~F.coalesce(once, F.lit(False)))
    return calm.select("_row").unionByName(first.select("_row")).unionByName(rest.select("_row")).select("_row.*")
