import numpy as np
import pytest

from varkit.llm import nearest as N

SCHEMA = "vec_id long, embedding array<float>, id string, v string, list string"


def _search(spark, rows, **kw):
    df = spark.createDataFrame([(i, v, "a", "b", "c") for i, v in rows], SCHEMA)
    got = {}
    for r in N.search(df, df.where("vec_id % 50 = 0"), **kw).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.id, r.score))
    return {k: sorted(v) for k, v in got.items()}


def _brute(rows, k=5):
    fine = sorted({(i, tuple(np.float32(v).tolist())) for i, v in rows if i is not None and v is not None and len(v) == 3 and all(x is not None and np.isfinite(x) for x in v) and any(v)})
    out = {}
    for q in {i for i, _ in fine if i % 50 == 0}:
        best = {}
        for a in (v for i, v in fine if i == q):
            for i, b in fine:
                if i != q:
                    best[i] = max(best.get(i, -2), float(N.cosines(np.array([a]), np.array([b]))[0]))
        s = sorted((-c, i) for i, c in best.items())[:k]
        out[q] = [(n, i, -c) for n, (c, i) in enumerate(s, 1)]
    return out


def test_an_id_with_several_vectors_is_one_candidate(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=3)]) for i in range(120)]
    rows += [(50, [1.0, 0.1 * j, 0.0]) for j in range(30)] + [(7, [0.3 * j, 1.0, 0.5]) for j in range(30)]
    assert _search(spark, rows) == _brute(rows)


def test_ties_copies_and_unusable_vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 3)]) for i in range(300)]
    rows += [(1000 + i, [1.0, 2.0, 3.0]) for i in range(400)] + [(50, rows[50][1])]
    rows += [(5000, None), (5050, []), (5100, [0.0, 0.0, 0.0]), (5150, [1.0, None, 2.0]), (5200, [float("nan"), 1.0, 1.0]), (5250, [float("inf"), 1.0, 1.0]),
             (None, [1.0, 1.0, 1.0]), (5300, [1.0, 2.0])]
    got, want = _search(spark, rows), _brute(rows)
    assert got == want
    small = _search(spark, rows, list_size=20)
    assert {k: [x[1] for x in v] for k, v in small.items()}.keys() == want.keys()


def test_few_candidates_and_empty(spark):
    assert _search(spark, [(0, [1.0, 0.0, 0.0]), (7, [1.0, 1.0, 0.0])]) == {0: [(1, 7, pytest.approx(0.5 ** 0.5))]}
    assert _search(spark, [(0, [1.0, 0.0, 0.0])]) == {} and _search(spark, []) == {}


def test_lists_are_cut_into_parts_without_loss(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=3)]) for i in range(700)]
    whole = {"target": 1.0, "tune": 1000}                            # fitted on every row: nothing is missed
    want = _search(spark, rows, **whole)
    monkeypatch.setattr(N, "PART", 50)
    monkeypatch.setattr(N, "QUERY_PART", 3)
    assert _search(spark, rows, **whole) == want == _brute(rows)


def test_recall_against_brute_force(spark):
    from varkit.llm.queries import op4
    sf = "/root/testdata/sf0.1"
    t = spark.read.parquet(sf + "/embeddings.parquet").select("vec_id", "embedding").toArrow()
    ids, x = np.array(t.column("vec_id")), np.array(t.column("embedding").to_pylist())
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    got = {}
    for r in op4(spark, sf).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hit = total = 0
    for q in np.flatnonzero(ids % 50 == 0):
        s = u @ u[q]
        s[q] = -2
        best = set(ids[np.lexsort((ids, -s))[:5]])
        hit, total = hit + len(best & got[ids[q]]), total + 5
    assert hit >= 0.9 * total


def test_query_on_its_own_centroid(spark):
    """An outlier is a cluster of its own, at no distance from its centroid; it has neighbours all the same."""
    rng = np.random.default_rng(7)
    rows = [(i, [float(x) for x in (1, *rng.normal(size=2) * 0.2)]) for i in range(1, 400) if i % 50]
    rows += [(0, [-1.0, 0.0, 0.0]), (50, [0.0, -1.0, 0.0]), (401, [0.0, -1.0, 0.0])]
    got, want = _search(spark, rows, list_size=40, target=1.0), _brute(rows)
    assert {q: len(v) for q, v in got.items()} == {0: 5, 50: 5} and got == want


def _share(x):
    """(recall, share of the table that a query scans) of the fitted pruning, on vectors apart from those it is fitted on."""
    g = N.Graph(N.balanced_centroids(x[:N.SAMPLE], max(1, len(x[:N.SAMPLE]) * N.LIST_SIZE // len(x))))
    asked = np.arange(len(x) - 300, len(x))
    score = x[asked] @ x.T
    score[np.arange(300), asked] = -2
    best = np.argpartition(-score, 5, axis=1)[:, :5]
    held = g.lists_of(x[best.ravel()], N.REPLICAS, N.BOUNDARY)
    places = [held[5 * i:5 * i + 5] for i in range(300)]
    sizes = np.bincount([j for h in g.lists_of(x, N.REPLICAS, N.BOUNDARY) for j in h], minlength=len(g.c))
    most, ratio = g.fit_pruning(x[asked[:200]], places[:200], sizes, 36, N.TARGET)
    took = g.probes_of(x[asked[200:]], most, ratio, sizes, 36)
    recall = np.mean([not set(h).isdisjoint(t) for t, p in zip(took, places[200:]) for h in p])
    return recall, np.mean([sizes[t].sum() for t in took]) / len(x)


def test_pruning_is_fitted_to_the_vectors():
    """Vectors in clusters are searched in a few lists, vectors without structure in as many as they need."""
    rng = np.random.default_rng(1)
    c = rng.normal(size=(400, 64))
    near = N._unit(c[rng.integers(0, 400, 20_000)] + 0.25 * rng.normal(size=(20_000, 64))).astype(np.float32)
    recall, share = _share(near)
    assert recall >= 0.9 and share < 0.05
    recall, share = _share(N._unit(rng.normal(size=(20_000, 64))).astype(np.float32))
    assert recall >= 0.88


def test_graph_finds_the_nearest_centroids():
    rng = np.random.default_rng(5)
    c = N._unit(rng.normal(size=(600, 24)))
    g = N.Graph(c)
    q = N._unit(rng.normal(size=(100, 24)))
    ids, _ = g.search(q, 10)
    best = np.argsort(-(q @ c.T), axis=1)[:, :10]
    assert np.mean([len(set(a) & set(b)) for a, b in zip(ids, best)]) > 9
    x = N._unit(rng.normal(size=(3000, 24)))
    sizes = np.bincount(N._nearest(x, N.balanced_centroids(x, 100)))
    assert sizes.max() < 400
