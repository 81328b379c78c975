import numpy as np
import pytest

from conftest import SF_SMALL
from helpers import WORD, documents
from varkit.llm import mixing as M


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000])
def test_permutations(n):
    x, key = np.arange(n), M._keys(np.array([5]), np.array([2]), 7)[0]
    p = M.permute(x, np.full(n, n), np.full(n, key))
    assert sorted(p) == list(range(n)) and (M.permute(p, np.full(n, n), np.full(n, key), inverse=True) == x).all()


def test_targets_share_everything_and_stop_at_three_times():
    sizes, weights = [100, 1, 1, 0, 50], [1, 5, 5, 5, 2]
    t = M.targets(sizes, weights)
    assert t[1] == t[2] == 3 and t[3] == 0 and abs(sum(t) - 152) < 1e-9
    assert abs(t[0] - 146 / 3) < 1e-9 and abs(t[4] - 2 * 146 / 3) < 1e-9
    assert M.targets([], []) == [] and M.targets([0], [1]) == [0.0]


@pytest.mark.parametrize("block,shards", [(1, 3), (4, 16), (1000, 64)])
def test_plan_takes_each_source_to_its_target(block, shards):
    rng = np.random.default_rng(block)
    for _ in range(30):
        sizes = [int(x) for x in rng.integers(0, 300, 6)]
        goal = M.targets(sizes, [5, 2, 1, 5, 2, 1])
        plan = M.make_plan(sizes, goal, block, shards)
        if not plan.slots:
            continue
        rows = M.slot_rows(plan, np.arange(plan.slots))
        took = rows.groupby("source_no")["words"].sum().reindex(range(6), fill_value=0)
        assert list(took) == [round(g) for g in goal]
        assert rows.groupby(["source_no", "block"]).size().max() <= 3
        assert not rows.duplicated(["source_no", "turn", "block"]).any() and not rows.duplicated(["shard", "slot"]).any()


def test_shard_counts_spread_like_a_multinomial():
    """The variance of a source's count in a shard is that of slots draws, not of a rounded share; the totals still hold."""
    sizes, shards, block = [60_000, 30_000, 15_000], 16, 10
    goal = M.targets(sizes, [5, 2, 1])
    plans = [M.make_plan(sizes, goal, block, shards, seed) for seed in range(120)]
    counts = np.array([np.diff(p.first, axis=0) for p in plans])          # plan, shard, source
    assert (counts.sum(axis=1) == plans[0].draws).all()
    slots, p = counts[0, 0].sum(), plans[0].draws / plans[0].draws.sum()
    assert (counts[:, :-1].sum(axis=2) == slots).all()
    want = np.sqrt(slots * p * (1 - p))
    assert (np.abs(counts[:, 0].std(axis=0) / want - 1) < .25).all()
    assert (np.abs(counts[:, 0].mean(axis=0) - slots * p) < 4 * want / np.sqrt(len(plans))).all()
    assert (counts[:, -1].std(axis=0) < 2 * want).all()                   # the last shard takes what is left


def _shares(sizes, weights):
    """Targets worked out another way: the level at which all words are given out, by bisection."""
    lo, hi = 0.0, 3.0 * sum(sizes) + 1
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(min(3 * s, mid * w) for s, w in zip(sizes, weights)) < sum(sizes) else (lo, mid)
    return [min(3 * s, hi * w) for s, w in zip(sizes, weights)]


def _check(spark, rows, got):
    sizes = {}
    for _, t, _, s in rows:
        sizes[s] = sizes.get(s, 0) + len(WORD.findall(t or ""))
    names = sorted(k for k in sizes if k is not None) + [None] * (None in sizes)
    goal = dict(zip(names, _shares([sizes[k] for k in names], [(5, 2, 1)[i % 3] for i in range(len(names))])))
    for k in names:
        mine = [r for r in got if r["source"] == k]
        assert abs(sum(r["taken"] for r in mine) - goal[k]) < .51
        assert all(r["source_size"] == sizes[k] and abs(r["target"] - goal[k]) < 1e-6 * (1 + goal[k]) for r in mine)
    assert all(r["taken"] <= 3 * r["size"] for r in got)


def test_nulls_repeats_ties_and_reruns(spark):
    rows = [(1, "a b c", "en", "x"), (1, "a b c", "en", "x"), (2, None, "en", "x"), (3, "", "en", None), (None, "d e", "en", None), (4, "long " * 3000, "en", "y"),
            (4, "tie", "en", "y"), (5, "f", "en", "z"), (6, " g\th\n", "en", "Z")]
    docs = documents(spark, rows)
    runs = []
    for parts in (1, 4):
        m = M.taken_words(M.mix(docs.repartition(parts), keep_columns=("source",), block=7))
        got = [{**r.asDict(), "source": r["_row"]["source"]} for r in m.collect()]
        assert len(got) == len(rows)
        _check(spark, rows, got)
        runs.append(sorted((str(r["doc_id"]), r["size"], r["taken"]) for r in got))
    assert runs[0] == runs[1]
    texts = M.mixed_documents(docs, ["doc_id", "text", "lang", "source", "n_chars"], block=7).collect()
    assert sum(len(WORD.findall(r.text)) for r in texts) == sum(x[2] for x in runs[0])
    assert all(r.n_chars == len(r.text) for r in texts)


def test_query_and_empty_table(spark):
    from varkit.llm.queries import op7
    docs = {r.doc_id: r for r in spark.read.parquet(SF_SMALL + "/documents.parquet").collect()}
    got = [{**r.asDict(), "source": docs[r.doc_id].source} for r in op7(spark, SF_SMALL).collect()]
    _check(spark, [(i, d.text, d.lang, d.source) for i, d in docs.items()], got)
    none = documents(spark, [])
    assert M.taken_words(M.mix(none)).count() == 0 and M.mixed_documents(none, ["doc_id", "text", "lang", "source", "n_chars"]).count() == 0
