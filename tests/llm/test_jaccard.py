import random

import numpy as np
import pytest

from conftest import SF_ORACLE
from helpers import documents, near_duplicates
from varkit.llm import jaccard as J


def _texts(seed=3):
    """Families of edited copies of all lengths, so that similarities lie on both sides of 0.8, with a
    passage that many texts share."""
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage = " ".join(rnd.choice(words) for _ in range(55))
    out = []
    for length in (1, 2, 4, 5, 6, 7, 8, 9, 11, 14, 20, 30, 45, 60, 61, 90, 150, 400):
        for _ in range(3):
            base = [rnd.choice(words) for _ in range(length)]
            out.append(" ".join(base))
            for edits in (0, 1, 1, 2, 3, max(1, length // 50), length // 25):
                copy = list(base)
                for _ in range(edits):
                    at = rnd.randrange(len(copy))
                    if rnd.random() < .5:
                        copy[at] = rnd.choice(words)
                    else:
                        copy.insert(at, rnd.choice(words))
                out.append(" ".join(copy).upper() if rnd.random() < .2 else "\n".join(copy))
    out += [passage + " " + " ".join(rnd.choice(words) for _ in range(90)) for _ in range(60)] + ["", None, " \t"]
    rnd.shuffle(out)
    return out


@pytest.mark.parametrize("seed", [3, 4])
def test_same_components_as_brute_force(spark, seed):
    rows = list(enumerate(_texts(seed)))
    want = near_duplicates(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.near_duplicates(
        documents(spark, [(i, t, "en", "s") for i, t in rows]).repartition(5)).collect()}
    assert got == want
    assert len({c for _, c in want.values()}) < len(rows) - 50


def test_whole_query(spark):
    from varkit.llm.queries import op8
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in op8(spark, "/root/testdata/sf0.001").collect()} == near_duplicates(docs)


def test_linked_sets_always_share_enough_signatures():
    """The pigeonhole guarantee, on pairs right at the threshold."""
    rng = np.random.default_rng(1)
    table = J.bands(4000)
    for _ in range(1500):
        y = int(np.exp(rng.uniform(0, 7)))
        x = int(rng.integers(-(-80 * y // 100), y + 1))
        common = -(-80 * (x + y) // 180)
        if common > x or not x:
            continue
        u = rng.integers(0, 2**63, x + y - common).astype(np.uint64)
        a, b = np.unique(np.concatenate([u[:common], u[common:x]])), np.unique(np.concatenate([u[:common], u[x:]]))
        band = next(k for k, (_, hi) in enumerate(table) if len(b) <= hi)
        lo, hi = table[band]
        assert 100 * len(a) >= 80 * lo
        (sa, na), (sb, nb) = J.signatures(a, band, lo, hi), J.signatures(b, band, lo, hi)
        assert len(np.intersect1d(sa, sb)) >= max(na, nb)


def test_large_groups_null_ids_and_repeats(spark):
    rnd = random.Random(1)
    base = [rnd.choice("abcdefghij") + str(rnd.randrange(99)) for _ in range(200)]
    rows = [(i, " ".join(base[:k] + [f"x{i}"] + base[k:]), "en", "s") for i, k in enumerate(rnd.randrange(200) for _ in range(300))]
    rows += [(1000 + i, " ".join(base), "en", "s") for i in range(300)] + [(1000, "other text of a row with the same id", "en", "s"), (None, " ".join(base), "en", "s")]
    got = J.near_duplicates(documents(spark, rows).repartition(7)).collect()
    assert len(got) == len(rows)
    assert {r.component_id for r in got if r.doc_id is not None} == {0} and [r.component_id for r in got if r.doc_id is None] == [None]
    kept = J.one_per_group(documents(spark, rows + [(5000, "", "en", "s"), (5000, "", "en", "s")]).repartition(3)).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["0", "5000", "5000", "None"]


def test_words_longer_than_a_piece_and_empty_table(spark, monkeypatch):
    monkeypatch.setattr(J, "PIECE", 64)
    text = " ".join(["x" * 9000, "y", "z" * 70, "q", "r", "s"] * 3)
    cut = J.Hasher().shingles(text)
    monkeypatch.setattr(J, "PIECE", 1 << 20)
    assert (cut == J.Hasher().shingles(text)).all() and len(cut) == 6
    assert J.near_duplicates(documents(spark, [])).count() == 0


@pytest.mark.parametrize("kind", ["sorted", "shuffled", "zigzag"])
def test_chains_take_few_rounds(spark, monkeypatch, kind):
    """Chains of 4096 nodes: at most 2 log2(n) tables of pointers, and the right components."""
    n = 4096
    names = list(range(n))
    if kind == "shuffled":
        random.Random(2).shuffle(names)
    elif kind == "zigzag":
        names = [x for i in range(n // 2) for x in (n // 2 + i, i)]
    edges = [(names[i], names[i + 1]) for i in range(n - 1)] + [(10_000 + i, 10_000) for i in range(1, 50)] + [(7, 7)]
    made, plain = [], J.stored
    monkeypatch.setattr(J, "stored", lambda df, name: (made.append(name), plain(df, name))[1])
    got = {r.node: r.component for r in J.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert made.count("pointers") <= 24, made
    assert got == {**{i: 0 for i in range(n)}, **{10_000 + i: 10_000 for i in range(50)}}
