import zlib

import numpy as np
import pytest
from conftest import SF_ORACLE
from helpers import documents
from varkit.llm import toxicity as T

LABELS = "doc_id long, quality int, toxic int"
BAD = ["grumbo", "fennak", "smurgle"]


def corpus(n=1200, seed=3):
    """Documents and labels: texts of common words, a sixth of them with invented insults."""
    rng = np.random.default_rng(seed)
    pool = [a + b for a in ("stone", "river", "winter", "garden", "letter", "window", "market", "silver") for b in ("", "s", "ing", "ed", "ly")]
    docs, labels = [], []
    for i in range(n):
        words = list(rng.choice(pool, int(rng.integers(20, 120))))
        toxic = i % 6 == 0
        if toxic:
            for _ in range(int(rng.integers(2, 5))):
                words.insert(int(rng.integers(0, len(words))), str(rng.choice(BAD)))
        docs.append((i, " ".join(words), "en", "s"))
        labels.append((i, 1, int(toxic)))
    return docs, labels


def remainder(i):
    return zlib.crc32(str(i).encode()) % 3


def test_held_out_accuracy_and_fold(spark):
    docs, labels = corpus()
    odd = [(5000, None, None, None), (5001, "", "en", "s"), (None, "you grumbo you fennak " * 4, "en", "s"), (5002, "you sm.u.r.gle gr1mbo and fennak! " * 5, "en", "s"),
           (5003, "garden " * 60_000, "en", "s"), (docs[6][0], docs[6][1], "en", "s")]
    lab = spark.createDataFrame(labels + [(None, 1, 1), (5001, 1, None), (12, 0, 0), (9999, 1, 1)], LABELS).selectExpr("*", "'x' AS text", "0.5 AS score", "1 AS fold")
    df = documents(spark, docs + odd).selectExpr("*", "1.0 AS score", "array(1.0) AS features", "0 AS fold", "'r' AS raw")
    got = T.score_documents(df, lab).collect()
    assert len(got) == len(docs) + len(odd)
    by = {}
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)
        assert r.held_out == (r.doc_id is not None and remainder(r.doc_id) == 1)
        assert by.setdefault(r.doc_id, r) == r  # repeated rows have equal scores
    held = [(i, t) for i, _, t in labels if remainder(i) == 1]
    assert sum(by[i].predicted == t for i, t in held) >= 0.98 * len(held)
    assert by[None].predicted == 1 and by[5000].score == by[5001].score and by[5003].predicted == 0


def test_held_out_labels_are_never_read(spark):
    docs, labels = corpus(400)
    df = documents(spark, docs)
    fair = spark.createDataFrame(labels, LABELS)
    wrong = spark.createDataFrame([(i, q, 1 - t if remainder(i) == 1 else t) for i, q, t in labels], LABELS)
    score = lambda lab: {r.doc_id: r.score for r in T.score_documents(df, lab).collect()}
    assert score(fair) == score(wrong)


def test_features_of_spellings():
    reader = T.Reader({"=grumbo": 5.0, "^fenn": 4.0})
    f = lambda t: dict(zip(T.FEATURES, reader.features(t.encode())))
    assert f("")["log_words"] == 0 and f("a clean text")["hit_share"] == 0
    assert f("Grumbo, fennakish things")["distinct_hits"] == 2 and f("Grumbo, x")["top_strength"] == 5
    assert f("g.r.u.m.b.o x")["disguised_hits"] == 1 and f("gruuuumbo x")["disguised_hits"] == 1 and f("gr&mbo x")["hit_share"] == 0
    assert f("you a b grumbo")["near_hits"] == 1 and f("you a b c d e grumbo")["near_hits"] == 0 and f("grumbo a b your")["near_hits"] == 1
    assert f("WHAT now!!")["shout_share"] == 0.5 and f("WHAT now!!")["exclaim_share"] == 0.2


@pytest.mark.parametrize("labels", [[], [(1, 1, 1)], [(i, 1, 0) for i in range(9)]])
def test_nothing_to_learn_from(spark, labels):
    lab = spark.createDataFrame(labels, LABELS)
    assert T.score_documents(documents(spark, []), lab).count() == 0
    got = T.score_documents(documents(spark, [(i, "some text", "en", "s") for i in range(9)]), lab).collect()
    assert len({r.score for r in got}) == 1 and len(got) == 9


def test_sample_is_bounded_and_copies_count_once(spark):
    docs = documents(spark, [(i, "copy" if i % 2 else f"text {i}", "en", "s") for i in range(3000)])
    lab = spark.createDataFrame([(i, 1, int(i % 2 and i % 5 == 0)) for i in range(3000)], LABELS)
    whole = T.sample(docs, lab)
    assert whole.where("text = 'copy'").select("toxic").collect()[0][0] == 1 and whole.count() == 1 + sum(remainder(i) != 1 for i in range(0, 3000, 2))
    assert 100 < T.sample(docs, lab, 400).count() < 300  # about half of the bounded rows are copies of one text


def test_query(spark):
    from varkit.llm.queries import op12
    got = {r.doc_id: r for r in op12(spark, SF_ORACLE).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(SF_ORACLE + "/labels.parquet").collect()}
    held = [i for i in labels if got[i].held_out]
    assert sum(got[i].predicted == labels[i] for i in held) >= 0.95 * len(held)
