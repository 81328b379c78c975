import math
import re
from collections import Counter

import numpy as np
import pytest
from helpers import documents
from varkit.llm import lexical as X

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k=50):
    """Sorted (item, rank, doc, score) by scoring every document for every query."""
    tf = [(i, Counter(words(t))) for i, t in docs]
    tf = [(i, c, sum(c.values())) for i, c in tf if c]
    big_n, big_l = len(tf), sum(n for *_, n in tf)
    df = Counter(w for _, c, _ in tf for w in c)
    out = []
    for item, text in items:
        w = {t: math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[t] + 1))) for t in set(words(text))}
        found = []
        for i, c, n in tf:
            m = 100 - 50 + (50 * n * big_n) // big_l
            s = sum(w[t] * (1000000000 * c[t] // (1000 * c[t] + 20 * m)) for t in w if t in c)
            if s > 0:
                found.append((-s, i is None, i or 0))
        out += [(item, r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=repr)


def rows(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=repr)


@pytest.mark.parametrize("limit", [X.SEGMENT_BYTES, 3000])
def test_against_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(X, "SEGMENT_BYTES", limit)
    monkeypatch.setattr(X, "BLOCK_BYTES", 2000 if limit == 3000 else X.BLOCK_BYTES)
    rng = np.random.default_rng(1)
    pool = [f"{a}{b}" for a in "abcdefghijklmnopqrst" for b in ("en", "üß", "X9", "\x80z")]
    weight = 1 / np.arange(1, len(pool) + 1)
    weight /= weight.sum()
    text = lambda n: " ".join(rng.choice(pool, n, p=weight)).replace("a", rng.choice(["a", "A", "a-", "@a"]))
    docs = [(int(i), text(int(rng.integers(1, 60)))) for i in rng.permutation(700)]
    docs += [(900, docs[0][1]), (901, docs[0][1]), (900, docs[0][1]), (2**53 + 1, docs[1][1]), (None, docs[1][1]), (902, None), (903, ""), (904, " -!{ "),
             (905, "aen " * 30000), (906, docs[2][1] + " ")]
    items = [(i, text(int(rng.integers(1, 12)))) for i in range(25)] + [(30, None), (31, " ."), (32, "nowhere"), (None, docs[0][1]), (3, docs[1][1]), (33, docs[3][1])]
    df = documents(spark, [(i, t, "en", "s") for i, t in docs])
    it = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    assert rows(X.search(df, it)) == brute(docs, items)
    assert rows(X.search(df, it, k=3)) == brute(docs, items, 3)


def test_empty_tables(spark):
    none, item = documents(spark, []), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert X.search(none, item).count() == 0
    assert X.search(documents(spark, [(1, "a", "en", "s")]), item.where("false")).count() == 0
    assert X.search(documents(spark, [(1, None, "en", "s")]), item).count() == 0


def test_intervals_are_pruned():
    """A rare term's documents are found without looking at the other documents' postings."""
    rng = np.random.default_rng(2)
    n = 20000
    texts = [b"common " * int(rng.integers(1, 9)) + (b"rare " if i % 400 == 7 else b"") for i in range(n)]
    vocabulary = {b"common": 0, b"rare": 1}
    tids, docs, tfs = (X.array("i") for _ in range(3))
    for i, t in enumerate(texts):
        c = X.Counter(map(vocabulary.get, X.terms(t)))
        tids.extend(c.keys()), tfs.extend(c.values()), docs.extend([i] * len(c))
    length = [len(X.terms(t)) for t in texts]
    segment = X.Segment(X._segment(list(range(n)), length, tids, docs, tfs, n, sum(length)), n, sum(length))
    at, scores = segment.search([0, 1], [1, 6000], 10, 0)
    assert len(at) < n / 10  # documents scored exactly
    assert {int(segment.ids[i]) for i in at[np.argsort(-scores)[:10]]} <= set(range(7, n, 400))
