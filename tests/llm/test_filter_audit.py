import re
from collections import defaultdict
from itertools import permutations

from helpers import WORD, documents
from varkit.llm import filter_audit as A


def brute(rows, labels):
    """{(part, order, step): figures} by applying the filters one after the other."""
    smallest = {}
    for i, t, *_ in rows:
        if i is not None:
            smallest[t or ""] = min(i, smallest.get(t or "", i))
    good = {i for i, q, _ in labels if q == 1} - {None}  # no id is no match
    toxic = {i for i, _, t in labels if t == 1} - {None}
    parts = defaultdict(list)
    for i, t, lang, _ in rows:
        t = t or ""
        w = WORD.findall(t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
                 "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and t in smallest and smallest[t] < i}
        parts[lang].append((fails, i in good, i in toxic))
    out = {}
    for part, docs in parts.items():
        share = defaultdict(int)
        for order in permutations("ABCDE"):
            left = docs
            for step, f in enumerate(order, 1):
                removed = [d for d in left if d[0][f]]
                left = [d for d in left if not d[0][f]]
                share[f] += len(removed)
                out[part, "".join(order), step] = [
                    len(left), len(removed), sum(d[0][f] for d in docs) - len(removed), sum(d[0][f] and sum(d[0].values()) == 1 for d in docs),
                    sum(d[1] for d in removed), sum(d[2] for d in removed)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(share[order[step - 1]])
    return out


def long(n, extra=""):
    return " ".join(f"word{i}" for i in range(n)) + extra


def test_against_brute_force(spark):
    rows = [(1, long(250), "en", "s"), (2, long(250), "en", "s"), (2, long(250), "en", "s"), (3, long(250), "de", "s"), (3, long(250), None, "s"),
            (4, "", "en", "s"), (5, None, "en", "s"), (6, "a " * 500, "en", "s"), (7, "A B C" * 90, "en", "s"), (8, long(300, " #"), "de", "s"),
            (9, "ÄÖ Ü\x1cx " * 210, None, "s"), (None, long(250), "en", "s"), (None, "", "fr", "s"), (None, None, "fr", "s"), (10, "x" * 200_000, "fr", "s"),
            (2**53 + 1, "e é " * 300, "de", "s"), (2**53, "e é " * 300, "de", "s"), (11, long(199, " 漢 " * 99), "de", "s")]
    labels = [(1, 1, 0), (2, 1, 1), (2, 0, None), (4, 1, 1), (5, None, None), (None, 1, 1), (8, 1, 0), (2**53 + 1, 1, 1), (77, 1, 1)]
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").selectExpr("*", "'x' AS part", "1 AS n")
    got = {(r.part, r.filter_order, r.step): [r[f] for f in A.FIGURES] for r in A.audit(documents(spark, rows), lab).collect()}
    assert got == brute(rows, labels)


def test_efficiency_of_shapley_and_empty_table(spark):
    lab = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert A.audit(documents(spark, []), lab).count() == 0
    rows = [(i, long(150 + i) if i % 3 else "same", "en", "s") for i in range(90)]
    got = A.audit(documents(spark, rows), lab).collect()
    # the removed of all filters, over all orders, are the documents that fail any filter, 120 times
    lost = {r.filter_order: 0 for r in got}
    for r in got:
        lost[r.filter_order] += r.removed
    assert len(set(lost.values())) == 1 and sum({r.filter_order[r.step - 1]: r.shapley for r in got}.values()) == 120 * lost["ABCDE"]
