"""Approximate nearest neighbours by balanced posting lists.

Centroids come from balanced hierarchical clustering of a bounded sample (about ``SAMPLE`` vectors, taken by a
threshold on a hash of the id; at most ``MAX_LISTS`` centroids).  They are held in memory, here a broadcast of
proven size, under a pruned neighbour graph that is searched best-first, for vectors and queries alike.  Every vector
goes to the list of its nearest centroid; a vector near the boundary is replicated to further
lists, unless a list that it is already in is nearer to the new centroid than the vector is.

A query takes the lists whose centroid distance is within a ratio of the nearest one's, up to a number of lists.  Neither is
fixed: about ``TUNE`` held-out vectors are searched exactly, in one scan, and ratio and number are the least that find the ``TARGET``
share of their neighbours.  So vectors that lie in clusters are searched in few lists, and vectors without structure in as many
as their recall takes, at every size of the table.  A query always takes the nearest ``LEAST`` lists and as many as are sure to
hold k + 1 vectors, and the ratio is to the distance of the last list needed for these, so a query on its own centroid is
not left with that list.

Lists and their queries meet in groups of bounded size: a long list is cut into parts, and so
are the queries of a list that many queries take.  Equal vectors enter the index with their smallest ids only,
as many as a query can return, found with a map-side limit, so a very common vector neither fills
a list nor a task; equal query vectors are searched once.

Scores are cosines in double precision of the original vectors, computed the same way wherever
a pair is met, so ties are exact and go to the smaller id.

Edge cases: vectors that are NULL, empty, zero or hold NULL or non-finite components take no
part, as candidate or query; so do rows with a NULL id.  Vectors of different length are never compared: the most
frequent length takes part (the smaller on a tie).  An empty table gives an empty result.  Rows that repeat an id and a vector
count once; an id with several vectors is one candidate, and one query, at the cosine of its best pair.  Only the id and
vector columns are read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from varkit.llm.common import stored

SAMPLE, MAX_LISTS, LIST_SIZE = 32_768, 8192, 160
REPLICAS, BOUNDARY = 6, 1.12
#: Held-out vectors that the pruning is fitted on, the share of their neighbours to be found, and the least lists of a query.
TUNE, TARGET, LEAST = 256, 0.95, 2
HASHES = 1 << 40
DEGREE, BEAM = 24, 96
PART, QUERY_PART = 4096, 1024
#: Rows of query vectors that a batch is written out in at most.
PROBE_ROWS = 65_536


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.argmax(x @ c.T, axis=1)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-30)


def balanced_centroids(x: np.ndarray, leaf: int, seed: int = 3, ways: int = 8) -> np.ndarray:
    """Unit centroids of clusters of at most about ``leaf`` rows of the unit vectors ``x``: clusters are
    split by k-means whose assignment charges for crowded clusters until they are small enough."""
    rng, out, todo = np.random.default_rng(seed), [], [x]
    while todo:
        part = todo.pop()
        if len(part) <= leaf or (part == part[0]).all():
            out.append(_unit(part.mean(axis=0)))
            continue
        k = min(ways, -(-len(part) // leaf))
        c = part[rng.choice(len(part), k, replace=False)]
        crowd, load = 0.0, np.zeros(k)
        for _ in range(10):
            score = part @ c.T
            which = np.argmax(score - crowd * load, axis=1)
            load = np.bincount(which, minlength=k) / len(part)
            crowd = 0.5 * float(np.abs(score).std()) * k / 2
            c = np.stack([_unit(part[which == j].mean(axis=0)) if (which == j).any() else part[rng.integers(len(part))] for j in range(k)])
        which = _nearest(part, c)
        sizes = np.bincount(which, minlength=k)
        if sizes.max() > 0.95 * len(part):                       # hardly divisible: cut in halves along the widest direction
            along = part @ _unit(part[0] - part.mean(axis=0) + 1e-9)
            which = (np.argsort(np.argsort(along, kind="stable"), kind="stable") * 2 // len(part)).astype(int)
            k = 2
        todo += [part[which == j] for j in range(k) if (which == j).any()]
    return np.stack(out)


class Graph:
    """Unit centroids under a relative-neighbourhood graph with links in both directions."""

    def __init__(self, centroids: np.ndarray, degree: int = DEGREE, beam: int = BEAM):
        self.c = centroids.astype(np.float32)
        n = len(self.c)
        self.beam = min(beam, n)
        wide = min(n - 1, 3 * degree)
        links: list[list[int]] = []
        for i in range(n):
            s = self.c @ self.c[i]
            s[i] = -2
            near = np.argsort(-s)[:wide] if wide else np.zeros(0, int)
            kept: list[int] = []
            for j in near:
                if len(kept) < degree and (not kept or (self.c[kept] @ self.c[j]).max() < s[j]):
                    kept.append(int(j))
            kept += [int(j) for j in near if int(j) not in kept][: max(0, degree // 2 - len(kept))]
            links.append(kept)
        back = [set(x) for x in links]
        for i, x in enumerate(links):
            for j in x:
                back[j].add(i)
        most = max((len(x) for x in back), default=0)
        self.links = np.full((n, max(most, 1)), -1, np.int32)
        for i, x in enumerate(back):
            self.links[i, :len(x)] = sorted(x)
        step = max(1, n // 16)
        self.entries = np.arange(0, n, step)[:16]

    @classmethod
    def of(cls, state: dict) -> "Graph":
        """The graph with these arrays; broadcasts carry arrays, not classes."""
        g = cls.__new__(cls)
        g.__dict__.update(state)
        return g

    def search(self, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(centroids, cosines), best first, of the best ``k`` found for each unit vector; -1 pads."""
        k = min(k, len(self.c))
        beam = max(self.beam, k)
        out_i, out_s = [], []
        for at in range(0, len(q), 512):
            x = q[at:at + 512].astype(np.float32)
            m = len(x)
            rows = np.arange(m)[:, None]
            seen = np.zeros((m, len(self.c) + 1), bool)
            seen[:, self.entries] = True
            ids = np.broadcast_to(self.entries, (m, len(self.entries))).copy()
            score = x @ self.c[self.entries].T
            fresh = np.ones_like(ids, bool)
            while True:
                order = np.argsort(-score, axis=1, kind="stable")[:, :beam]
                ids, score, fresh = ids[rows, order], score[rows, order], fresh[rows, order]
                if not (fresh & (ids >= 0)).any():
                    break
                # the four best nodes not yet opened of each row
                rank = np.argsort(~(fresh & (ids >= 0)), axis=1, kind="stable")[:, :4]
                opened = fresh[rows, rank] & (ids[rows, rank] >= 0)
                fresh[rows, rank] = False
                new = np.where(opened[:, :, None], self.links[np.maximum(ids[rows, rank], 0)], -1).reshape(m, -1)
                new = np.where(seen[rows, new], -1, new)
                new = np.sort(new, axis=1)
                new[:, 1:][new[:, 1:] == new[:, :-1]] = -1
                seen[rows, new] = True
                s = np.einsum("ij,ikj->ik", x, self.c[np.maximum(new, 0)])
                s[new < 0] = -3
                ids, score = np.concatenate([ids, new], axis=1), np.concatenate([score, s], axis=1)
                fresh = np.concatenate([fresh, new >= 0], axis=1)
            out_i.append(np.where(score[:, :k] > -2.5, ids[:, :k], -1))
            out_s.append(score[:, :k])
        if not out_i:
            return np.zeros((0, k), int), np.zeros((0, k))
        return np.concatenate(out_i), np.concatenate(out_s)

    def lists_of(self, v: np.ndarray, replicas: int, boundary: float) -> list[list[int]]:
        """The lists that hold each unit vector, nearest first."""
        ids, s = self.search(v, 4 * replicas)
        dist = np.sqrt(np.maximum(2 - 2 * s, 0))
        out = []
        for i, d in zip(ids, dist):
            kept: list[int] = []
            for j, dj in zip(i, d):
                if j < 0 or len(kept) == replicas or kept and dj > boundary * d[0] + 1e-6:
                    break
                if all(2 - 2 * float(self.c[j] @ self.c[o]) > dj * dj for o in kept):
                    kept.append(int(j))
            out.append(kept)
        return out

    def probes_of(self, q: np.ndarray, most: int, ratio: float, sizes: np.ndarray, need: int) -> list[list[int]]:
        """The lists that each unit query vector takes, nearest first: by the graph, up to ``most`` within ``ratio``, with
        ``need`` postings or more.  ``sizes`` are the postings of each list.  All centroids are
        ranked only for a query whose nearest lists are too small for that."""
        n = len(self.c)
        out: list[list[int]] = []
        ids, s = self.search(q, max(most, LEAST))
        for x, i, near in zip(q, ids, s):
            i, near = i[i >= 0], near[i >= 0]
            if sizes[i].sum() < need and len(i) < n:
                all_s = self.c @ x.astype(np.float32)
                i = np.argsort(-all_s, kind="stable")
                near = all_s[i]
            dist = np.sqrt(np.maximum(2 - 2 * near, 0))
            last = min(max(int(np.searchsorted(np.cumsum(sizes[i]), need)), LEAST - 1), len(i) - 1)
            rank = np.arange(len(i))
            out.append(i[(rank <= last) | (rank < most) & (dist <= ratio * dist[last] + 1e-6)].tolist())
        return out

    def fit_pruning(self, q: np.ndarray, places: list[list[list[int]]], sizes: np.ndarray, need: int, target: float) -> tuple[int, float]:
        """(most, ratio): the least that reach ``target`` of the neighbours of the unit vectors ``q``.
        ``places`` holds, per vector and neighbour, the lists that the neighbour is in."""
        ranks, ratios = [], []
        for x, neighbours in zip(q, places):
            s = self.c @ x.astype(np.float32)
            order = np.argsort(-s, kind="stable")
            rank = np.empty(len(s), int)
            rank[order] = np.arange(len(s))
            dist = np.sqrt(np.maximum(2 - 2 * s, 0))
            last = min(max(int(np.searchsorted(np.cumsum(sizes[order]), need)), LEAST - 1), len(s) - 1)
            for held in neighbours:
                best = min(held, key=rank.__getitem__)
                ranks.append(rank[best] + 1)
                ratios.append(dist[best] / max(dist[order[last]], 1e-6))
        if not ranks:
            return len(self.c), float("inf")
        # the share that may be missed is split between the two bounds
        miss = 1 - target
        return (int(np.quantile(ranks, 1 - 0.7 * miss, method="higher")),
                max(1.0, float(np.quantile(ratios, 1 - 0.3 * miss, method="higher"))))


def _matrix(column) -> np.ndarray:
    return np.array([np.asarray(x, np.float64) for x in column])


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, summed in the same order wherever a pair is met."""
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v) of the vectors that take part, as doubles."""
    d = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"),
                       F.transform(F.col(f"`{vec_col}`"), lambda x: x.cast("double")).alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    d = d.where(F.coalesce(fine, F.lit(False)) & F.exists("v", lambda x: x != 0))
    widths = d.groupBy(F.size("v").alias("w")).count().orderBy(F.desc("count"), "w").limit(1).collect()
    return d.where(F.size("v") == (widths[0].w if widths else 0)).distinct()


def _some(df: DataFrame, n: int, wanted: int, seed: int):
    """About ``wanted`` of the ``n`` rows, by a threshold on a hash: every task keeps its own few."""
    d = df if n <= wanted else df.where(F.pmod(F.xxhash64("id", "v", F.lit(seed)), F.lit(HASHES)) < int(HASHES * wanted / n))
    t = d.select("id", "v").toArrow()
    return np.array(t.column("id"), np.int64), _unit(np.array(t.column("v").to_pylist(), np.float64).reshape(len(t), -1))


def _exact(index: DataFrame, ids: np.ndarray, units: np.ndarray, k: int) -> DataFrame:
    """(s, id): the ``k`` nearest rows of each sample vector number ``s``, by one scan."""
    spark = index.sparkSession
    held = spark.sparkContext.broadcast((ids, units))              # about TUNE vectors

    def scan(batches):
        names, u = held.value
        for b in batches:
            if not len(b):
                continue
            score = u @ _unit(_matrix(b["v"])).T
            score[names[:, None] == b["id"].to_numpy()[None, :]] = -2
            top = np.argpartition(-score, min(k, len(b)) - 1, axis=1)[:, :k]
            yield pd.DataFrame({"s": np.repeat(np.arange(len(u), dtype=np.int32), top.shape[1]), "id": b["id"].to_numpy()[top.ravel()],
                                "score": np.take_along_axis(score, top, 1).ravel()})

    best = Window.partitionBy("s").orderBy(F.desc("score"), "id")
    return (index.mapInPandas(scan, "s int, id long, score double").where("score > -1.5")
            .withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k).select("s", "id"))


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding",
           list_size: int = LIST_SIZE, max_lists: int = MAX_LISTS, sample: int = SAMPLE, replicas: int = REPLICAS,
           boundary: float = BOUNDARY, tune: int = TUNE, target: float = TARGET) -> DataFrame:
    """(query_id, rank, id, score): for each row of ``queries`` the ``k`` nearest rows of
    ``vectors`` with another id."""
    spark = vectors.sparkSession
    base, asked = usable(vectors, id_col, vec_col), usable(queries, id_col, vec_col)
    # row_number with a small bound is limited map-side, before the shuffle
    first = Window.partitionBy("v").orderBy("id")
    index = stored(base.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= k + 1).select("id", "v"), "vectors")
    asked = stored(asked, "queries")

    n = index.count()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, id long, score double")
    _, x = _some(index, n, sample, 1)
    if not len(x):                                                   # a small table by an unlucky threshold
        _, x = _some(index, n, n, 1)
    x = x.astype(np.float32)
    lists = min(max_lists, -(-n // list_size))
    centroids = balanced_centroids(x, max(1, len(x) // lists))
    local = Graph(centroids)
    graph = spark.sparkContext.broadcast(local.__dict__)

    def assign(batches):
        for b in batches:
            held = Graph.of(graph.value).lists_of(_unit(_matrix(b["v"])), replicas, boundary) if len(b) else []
            rep = [len(h) for h in held]
            yield pd.DataFrame({"list": np.array([j for h in held for j in h], np.int32), "id": np.repeat(b["id"].to_numpy(), rep),
                                "v": [v for v, r in zip(b["v"], rep) for _ in range(r)]})

    postings = stored(index.mapInPandas(assign, "list int, id long, v array<double>"), "postings")
    sizes = np.zeros(len(centroids), np.int64)
    for r in postings.groupBy("list").count().collect():             # one row per list
        sizes[r["list"]] = r["count"]
    need = replicas * (k + 1)                                        # an id is in so many lists at most

    s_ids, s_units = _some(index, n, tune, 2)
    truth = _exact(index, s_ids, s_units, k)                         # at most about tune * k rows
    where = postings.select("id", "list").join(F.broadcast(truth), "id").groupBy("s", "id").agg(F.collect_set("list").alias("lists"))
    places: list[list[list[int]]] = [[] for _ in s_ids]
    for r in where.collect():
        places[r.s].append(r.lists)
    most, ratio = local.fit_pruning(s_units, places, sizes, need, target)
    held = spark.sparkContext.broadcast(sizes)

    def ask(batches):
        for b in batches:
            step = max(1, PROBE_ROWS // max(most, LEAST))
            for at in range(0, len(b), step):
                part = b.iloc[at:at + step]
                took = Graph.of(graph.value).probes_of(_unit(_matrix(part["v"])), most, ratio, held.value, need)
                rep = [len(h) for h in took]
                yield pd.DataFrame({"list": np.array([j for h in took for j in h], np.int32), "q": np.repeat(part["q"].to_numpy(), rep),
                                    "v": [v for v, r in zip(part["v"], rep) for _ in range(r)]})

    # one search for equal query vectors, named by a number of their own
    once = stored(asked.groupBy("v").agg(F.lit(1)).select("v", F.monotonically_increasing_id().alias("q")), "asked")
    probing = stored(once.mapInPandas(ask, "list int, q long, v array<double>"), "probes")

    parts = postings.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts")).withColumnRenamed("list", "_l")
    qparts = probing.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / QUERY_PART).cast("int").alias("qparts")).withColumnRenamed("list", "_q")
    plan = F.broadcast(parts.join(qparts, F.col("_l") == F.col("_q")).drop("_q"))     # at most max_lists rows
    left = (postings.join(plan, F.col("list") == F.col("_l")).withColumn("part", F.pmod(F.xxhash64("id", "v"), F.col("parts")).cast("int"))
            .withColumn("qpart", F.explode(F.sequence(F.lit(0), F.col("qparts") - 1))).select("list", "part", "qpart", "id", "v"))
    right = (probing.join(plan, F.col("list") == F.col("_l")).withColumn("qpart", F.pmod(F.xxhash64("q"), F.col("qparts")).cast("int"))
             .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("list", "part", "qpart", "q", "v"))

    def meet(have, want):
        empty = pd.DataFrame({"q": np.zeros(0, np.int64), "id": np.zeros(0, np.int64), "score": np.zeros(0)})
        if not len(have) or not len(want):
            return empty
        have = have.sort_values("id", kind="stable")
        names, starts = np.unique(have["id"].to_numpy(), return_index=True)
        a, b = _matrix(want["v"]), _matrix(have["v"])
        rough = _unit(a) @ _unit(b).T
        each = np.maximum.reduceat(rough, starts, axis=1)            # an id's vectors are one candidate
        most = min(k + 1, len(names))
        bar = -np.partition(-each, most - 1, axis=1)[:, most - 1] - 1e-9
        i, j = np.nonzero(rough >= bar[:, None])
        out = pd.DataFrame({"q": want["q"].to_numpy()[i], "id": have["id"].to_numpy()[j], "score": cosines(a[i], b[j])})
        out = out.sort_values(["q", "score", "id"], ascending=[True, False, True]).drop_duplicates(["q", "id"])
        return out.groupby("q").head(k + 1)

    keys = ["list", "part", "qpart"]
    met = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(meet, "q long, id long, score double")
    best = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    top = met.groupBy("q", "id").agg(F.max("score").alias("score")).withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k + 1).drop("_r")
    # back to the queries: each leaves itself out
    names = asked.join(once.withColumnRenamed("v", "_v"), F.col("v") == F.col("_v")).select(F.col("id").alias("query_id"), F.col("q").alias("_q"))
    found = (top.join(names, F.col("q") == F.col("_q")).where("id <> query_id")
             .groupBy("query_id", "id").agg(F.max("score").alias("score")))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "id", "score"))
