"""Neighbour joins, spanning forests and density clusters against plain versions that look at all distances at once."""

import itertools
import random
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pytest

from litforge.operators import density, forest, graph, neighbors, topics
from litforge.plans import statistics  # noqa: F401  registers its queries
from litforge.plans.registry import QUERIES


def distances(x):
    return np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(2))


def single_linkage(w):
    """Prim's tree on a full matrix of distances."""
    n = len(w)
    inside, best, source, edges = np.zeros(n, bool), np.full(n, np.inf), np.zeros(n, int), []
    best[0] = -1
    for k in range(n):
        i = int(np.argmin(np.where(inside, np.inf, best)))
        inside[i] = True
        if k:
            edges.append((float(best[i]), int(source[i]), i))
        closer = (w[i] < best) & ~inside
        best[closer], source[closer] = w[i][closer], i
    return edges


def parts(points, edges):
    near = defaultdict(list)
    for _, a, b in edges:
        near[a].append(b)
        near[b].append(a)
    seen, out = set(), []
    for p in points:
        if p not in seen:
            todo, part = [p], []
            seen.add(p)
            while todo:
                part.append(q := todo.pop())
                todo += [r for r in near[q] if r not in seen and not seen.add(r)]
            out.append(part)
    return out


def clusters_top_down(x, least, k, epsilon=0.0):
    """Splits from the whole down, all edges of one length at once: (cluster, probability, outlier score) of each row."""
    n, d = len(x), distances(x)
    core = np.sort(d, axis=1)[:, min(k, n - 1)]
    w = np.maximum(d, np.maximum(core[:, None], core))
    found, own, left = [], [None] * n, [0.0] * n
    todo = [(list(range(n)), single_linkage(w), None, 0.0)] if n >= least else []
    while todo:
        points, edges, up, birth = todo.pop()
        c = len(found)
        found.append({"up": up, "birth": birth, "mass": -len(points) * birth, "kids": [], "death": 0.0})
        if up is not None:
            found[up]["kids"].append(c)
        while edges:
            longest = max(e[0] for e in edges)
            dense = 1 / max(longest, density.LEAST)
            edges = [e for e in edges if e[0] < longest]
            pieces = parts(points, edges)
            big = [p for p in pieces if len(p) >= least]
            found[c]["death"] = dense
            for p in pieces:
                if len(p) < least:
                    for q in p:
                        own[q], left[q] = c, dense
                if len(p) < least or len(big) > 1:
                    found[c]["mass"] += len(p) * dense
            if len(big) != 1:
                todo += [(p, [e for e in edges if e[1] in set(p)], c, dense) for p in big]
                break
            points = big[0]
            kept = set(points)
            edges = [e for e in edges if e[1] in kept]
    under = lru_cache(None)(lambda c: sum(max(found[k]["mass"], under(k)) for k in found[c]["kids"]))
    peak = lru_cache(None)(lambda c: max([found[c]["death"], *map(peak, found[c]["kids"])]))

    def topmost(c, marks):
        best = None
        while c is not None:
            best, c = (c if c in marks else best), found[c]["up"]
        return best

    marks = {c for c in range(1, len(found)) if found[c]["mass"] >= under(c)}
    marks = {topmost(c, marks) for c in marks}
    if epsilon:
        climbed = set()
        for c in marks:
            if 1 / found[c]["birth"] < epsilon:
                while found[found[c]["up"]]["up"] is not None:
                    c = found[c]["up"]
                    if 1 / found[c]["birth"] > epsilon:
                        break
            climbed.add(c)
        marks = climbed
    best = [topmost(c, marks) for c in own]
    members = defaultdict(list)
    for i, c in enumerate(best):
        members[c].append(i)
    number = {c: i for i, c in enumerate(sorted((c for c in members if c is not None), key=lambda c: (-len(members[c]), members[c][0])))}
    return [(number.get(c, -1), 0.0 if c is None else min(left[i], found[c]["death"]) / found[c]["death"], 0.0 if own[i] is None else (peak(own[i]) - left[i]) / peak(own[i])) for i, c in enumerate(best)]


def blobs(seed, n, grid):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(6, 3)) * 6
    x = np.concatenate([centre[i] + rng.normal(size=(n // 8, 3)) * (0.3 + 0.2 * (i % 3)) for i in range(6)] + [rng.uniform(-12, 12, size=(n - 6 * (n // 8), 3))])
    return np.round(x * grid) / grid if grid else x


def same(got, want):
    assert len(got) == len(want)
    for i, w in enumerate(want):
        assert got[i][0] == w[0] and abs(got[i][1] - w[1]) < 1e-6 and abs(got[i][2] - w[2]) < 1e-6, (i, got[i], w)


@pytest.mark.parametrize("n,grid,least,k,epsilon,options", [
    (2000, 2, 30, 5, 0.0, {"block": 300}),  # ties and copies
    (260, 0, 8, 4, 1.5, {"block": 64, "level": 120, "one_task": 0}),  # levels, and rounds without one-task steps
    (500, 1, 40, 3, 1.2, {"level": 90}),
])
def test_density_clusters(spark, n, grid, least, k, epsilon, options):
    x = blobs(n, n, grid)
    want = clusters_top_down(x, least, k, epsilon)
    assert max(w[0] for w in want) >= 2 and min(w[0] for w in want) == -1
    df = spark.createDataFrame([(i, r.tolist(), "c", 1) for i, r in enumerate(x)], "id long, v array<double>, comp string, m int").repartition(3)
    same({r[0]: r[1:] for r in density.density_clusters(df, "id", "v", least, k, epsilon, **options).collect()}, want)


def test_density_edges(spark):
    cluster = [(i, [0.1 * (i % 5), 0.0]) for i in range(12)]
    odd = [(20, None), (21, [float("nan"), 0.0]), (22, [None, 1.0]), (23, [1.0]), (24, [float("inf"), 0.0]), (25, [])]
    kind = "id long, v array<double>"
    got = {r[0]: tuple(r)[1:] for r in density.density_clusters(spark.createDataFrame(cluster + odd, kind), "id", "v", 5, 2).collect()}
    assert {got[i] for i, _ in odd} == {(-1, 0.0, 0.0)} and len(got) == 18
    assert density.density_clusters(spark.createDataFrame([], kind), "id", "v").count() == 0
    # two groups of copies and nothing between: two clusters, whole
    pair = [(i, [float(i % 2) * 9, -0.0 if i % 4 else 0.0]) for i in range(40)]
    assert {r[1:] for r in map(tuple, density.density_clusters(spark.createDataFrame(pair, kind), "id", "v", 10, 3).collect())} == {(0, 1.0, 0.0), (1, 1.0, 0.0)}
    assert {r[1] for r in density.density_clusters(spark.createDataFrame([(1, [1.0]), (2, [2.0])], kind), "id", "v", 10, 3).collect()} == {-1}


def test_density_query_by_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    rows = topics.principal(spark.read.parquet(f"{folder}/embeddings.parquet"), "embedding", 3, "flat").orderBy("vec_id").collect()
    x = np.array([r["flat"] for r in rows], np.float64)
    got = {r["vec_id"]: (r["cluster_id"], r["probability"], r["outlier_score"]) for r in QUERIES["vec3_density_clusters"](spark, folder).collect()}
    same([got[r["vec_id"]] for r in rows], clusters_top_down(x, 10, 5, 0.15))


@pytest.mark.parametrize("block", [2048, 40])
def test_nearest_neighbours(spark, block):
    x = blobs(7, 300, 2)
    x = np.unique(x, axis=0)
    df = spark.createDataFrame([(i, r.tolist(), 1) for i, r in enumerate(x)], "id long, v array<double>, m long")
    got = {r["id"]: [(n["d"], n["other"]) for n in r["near"]] for r in neighbors.nearest_neighbours(neighbors.Cells(df, block), 6).collect()}
    d = distances(x)
    for i in range(len(x)):
        assert got[i] == sorted((float(d[i, j]), j) for j in range(len(x)) if j != i)[:6]


def widest(edges, nodes):
    best = {(a, b): 0 for a in nodes for b in nodes}
    for a, b, n in edges:
        best[a, b] = best[b, a] = max(best[a, b], n)
    for k, a, b in itertools.product(nodes, repeat=3):
        best[a, b] = max(best[a, b], min(best[a, k], best[k, b]))
    return best


@pytest.mark.parametrize("most,one_task", [(3, 0), (1000, 100)])
def test_bottlenecks(spark, most, one_task):
    rng = random.Random(most)
    edges = [(a, b, rng.randint(1, most)) for a in range(40) for b in range(40) if a != b and rng.random() < 0.06] + [(50, 51, 2), (51, 50, 2), (51, 50, 1)]
    df = spark.createDataFrame([*edges, (3, 3, 9), (1, 2, None)], "a long, b long, s long")
    found, tree = forest.bottlenecks(df, one_task)
    best = widest(edges, sorted({x for a, b, _ in edges for x in (a, b)}))
    assert sorted((r["a"], r["b"], r["s"], r["weakest"]) for r in found.collect()) == sorted((a, b, n, best[a, b]) for a, b, n in edges)
    taken = [tuple(r) for r in tree.collect()]
    in_tree = widest(taken, sorted({x for a, b, _ in edges for x in (a, b)}))
    assert in_tree == best and len(taken) == len({x for a, b, _ in edges for x in (a, b)}) - len(parts({x for a, b, _ in edges for x in (a, b)}, [(n, a, b) for a, b, n in edges]))
    kept = graph.pathfinder(df, "s", one_task).collect()
    assert sorted((int(r["a"]), int(r["b"]), r["s"]) for r in kept) == sorted((a, b, n) for a, b, n in edges if n >= best[a, b])
