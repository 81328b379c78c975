import math

import numpy as np

from conftest import SF_SMALL
from helpers import base_figures, documents
from varkit.llm import quality as Q

TEXTS = ["", None, " \n\t", "a b c d e f", "a b c d e " * 7, "x\nx\n \n\nx\ty\nx", "one two three four five one two three four five six",
         "#$%& a|b <c> **", "\x0b\x0c a \x1c b", "é É ß 漢 字 १ 2   z", "w" * 100_000, "a b c d e f g h " * 4000, "same line\nsame line\n" * 9]


def test_base_figures_match_brute_force(spark):
    docs = documents(spark, [(i, t, "en" if i % 2 else None, "s") for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "en", "s")])
    got = {}
    for r in Q.quality(docs).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert len(got[3]) == 2 and got[3][0] == got[3][1]
    for i, t in enumerate(TEXTS):
        r = got[i][0]
        want = base_figures(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, t
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r.kept and r.base_failed)


def test_whole_table_query_and_distance(spark):
    from varkit.llm.queries import op6
    docs = {r.doc_id: r.text for r in spark.read.parquet(SF_SMALL + "/documents.parquet").collect()}
    rows = op6(spark, SF_SMALL).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base_figures(docs[r.doc_id])

    def js(p, q):
        p, q = np.array(p) / sum(p), np.array(q) / sum(q)
        m = (p + q) / 2
        kl = lambda a: sum(x * math.log2(x / y) for x, y in zip(a, m) if x > 0)
        return math.sqrt((kl(p) + kl(q)) / 2)
    df = spark.createDataFrame([([1.0, 2.0, 0.0], [0.0, 1.0, 5.0]), ([1.0, 1.0, 1.0], [2.0, 2.0, 2.0]), ([0.0, 0.0, 0.0], [1.0, 1.0, 1.0])],
                               "p array<double>, q array<double>")
    got = [r[0] for r in df.select(Q.js_distance(df.p, df.q)).collect()]
    assert abs(got[0] - js([1, 2, 0], [0, 1, 5])) < 1e-12 and abs(got[1]) < 1e-7 and got[2] is None


def test_junk_goes_and_prose_stays(spark):
    rng = np.random.default_rng(0)
    pool = Q.COMMON_WORDS["en"] + ["stone", "river", "winter", "garden", "letter", "window", "market", "silver"] * 2
    prose = lambda n: " ".join(rng.choice(pool, n)).capitalize() + "."
    clean = [(i, " ".join(prose(12) for _ in range(15)), "en", "s") for i in range(30)]
    junk = [(100, " ".join(w + "###" for w in prose(150).split()), "en", "s"), (101, " ".join(w.upper() + "!!" for w in prose(150).split()), "en", "s"),
            (102, " | ".join(rng.choice(["thnd", "eres", "onor"]) + str(i) for i in range(150)), "en", "s")]
    kept = {r.doc_id for r in Q.quality(documents(spark, clean + junk)).where("kept").collect()}
    assert kept == {r[0] for r in clean}


def test_copies_and_junk_do_not_bend_the_reference(spark):
    """A group of copies without common words, a third of all rows, and long failures of the base rules weigh no more than one text."""
    rng = np.random.default_rng(1)
    pool = Q.COMMON_WORDS["es"] + ["piedra", "invierno", "carta", "ventana", "mercado", "plata"] * 3
    clean = [(i, " ".join(rng.choice(pool, 150)) + ".", "es", "s") for i in range(40)]
    odd = " ".join(f"palabra{i}" for i in range(400))
    copies, junk = [(100 + i, odd, "es", "s") for i in range(40)], [(200 + i, f"ruido{i} " * 3000, "es", "s") for i in range(5)]
    def of(rows):
        return {r._lang: (r._class_reference, r._word_reference) for r in Q.references(documents(spark, rows)).collect()}["es"]
    once, often = of(clean + copies[:1]), of(clean + copies + junk)
    assert np.allclose(once[0], often[0]) and np.allclose(once[1], often[1])
    # worked independently: the mean of the shares of each distinct kept text
    words = Q.COMMON_WORDS["es"]
    shares = [[x.strip(".").split().count(w) / len(x.split()) for w in words] for x in [r[1] for r in clean] + [odd]]
    assert np.allclose(often[1][:-1], np.mean(shares, axis=0))
    kept = {r.doc_id for r in Q.quality(documents(spark, clean + copies + junk)).where("kept").collect()}
    assert {r[0] for r in clean} <= kept and not kept & {r[0] for r in junk}
    carried = {r.doc_id for r in Q.quality(documents(spark, clean + copies + junk), keep_columns=("text",)).where("kept").collect()}
    assert carried == kept


def test_empty_table(spark):
    assert Q.quality(documents(spark, [])).count() == 0
