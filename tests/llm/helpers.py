"""Brute-force versions that the operators are held against."""

import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    """(doc_id, text, lang, source) rows as a documents table with columns that clash with names
    used inside the operators."""
    from pyspark.sql import functions as F
    df = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], DOCS)
    return df.withColumns({c: F.lit("clash") for c in ("id", "n", "key", "part", "size", "kept", "_id", "sig", "component", "host")})


def components(nodes, pairs):
    par = {i: i for i in nodes}

    def top(x):
        while par[x] != x:
            x = par[x]
        return x
    for a, b in pairs:
        a, b = top(a), top(b)
        par[max(a, b)] = min(a, b)
    return {i: top(i) for i in nodes}


def shingles(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def near_duplicates(rows):
    """doc_id -> (n_shingles, component) of (doc_id, text) rows."""
    sets = {i: shingles(t) for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b]
             and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    top = components(sets, links)
    return {i: (len(s), top[i]) for i, s in sets.items()}


def base_figures(text):
    w = WORD.findall(text or "")
    grams = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
    often = Counter(grams)
    covered = {k for i, g in enumerate(grams) if often[g] > 1 for k in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered))
