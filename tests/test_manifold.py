"""The manifold projection: its neighbour graph against all distances, its memberships, its layout against principal components, and odd vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from litforge.operators import manifold, neighbors, topics
from litforge.scratch import stored

K = 15


@pytest.fixture(scope="module")
def table(spark):
    """500 given vectors, their rows by id, and the order of all others by distance from each."""
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", "embedding")
    rows = df.orderBy("vec_id").collect()
    x = np.array([r["embedding"] for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    return df, {r["vec_id"]: i for i, r in enumerate(rows)}, np.argsort(d, axis=1, kind="stable")


def trustworthiness(order, y):
    n = len(y)
    rank = np.argsort(order, axis=1)
    e = ((y[:, None] - y[None]) ** 2).sum(2)
    np.fill_diagonal(e, np.inf)
    r = np.take_along_axis(rank, np.argsort(e, axis=1)[:, :K], 1) + 1
    return 1 - 2 / (n * K * (2 * n - 3 * K - 1)) * np.maximum(r - K, 0).sum()


def test_neighbour_graph(table):
    df, place, order = table
    points = stored(manifold.unit_vectors(df, "vec_id", "embedding").select(F.col("row").alias("id"), "v", F.lit(1).alias("m")))
    lists = stored(manifold.neighbour_graph(neighbors.Cells(points, 64), K))
    got = {r["id"]: [place[o["other"]] for o in r["near"]] for r in lists.collect()}
    assert np.mean([len(set(got[v]) & set(order[i, :K].tolist())) / K for v, i in place.items()]) >= 0.95
    assert all(len(set(n)) == K and place[v] not in n for v, n in got.items())
    edges = manifold.memberships(lists).collect()
    w = {(r["i"], r["j"]): r["w"] for r in edges}
    assert len(w) == len(edges) and all(0 < x <= 1 + 1e-12 and w[j, i] == x for (i, j), x in w.items())


def test_projection(table):
    df, place, order = table
    first, second = ({r["vec_id"]: r["position"] for r in manifold.project(df.repartition(n), "vec_id", "embedding", block=128).collect()} for n in (2, 5))
    assert first == second
    y = np.array([first[v] for v in sorted(place, key=place.get)])
    flat = {r["vec_id"]: r["flat"] for r in topics.principal(df, "embedding", 2, "flat").collect()}
    assert trustworthiness(order, y) > trustworthiness(order, np.array([flat[v] for v in sorted(place, key=place.get)])) + 0.01


def test_projection_edges(spark):
    kind = "id long, v array<double>, p string, near int"
    rows = [(1, None, "p", 1), (2, [0.0, 0.0], "p", 1), (3, [float("nan"), 1.0], "p", 1), (4, [1.0, None], "p", 1), *[(10 + i, [1.0, float(i % 6)], "p", 1) for i in range(12)]]
    got = {r["id"]: r["position"] for r in manifold.project(spark.createDataFrame(rows, kind), "id", "v", rounds=2, epochs=3).collect()}
    assert [got[i] for i in (1, 2, 3, 4)] == [None] * 4 and len(got) == 16
    assert all(got[10 + i] == got[16 + i] and len(got[10 + i]) == 2 for i in range(6)) and len({tuple(got[10 + i]) for i in range(6)}) == 6
    assert manifold.project(spark.createDataFrame([], kind), "id", "v").count() == 0
    assert manifold.project(spark.createDataFrame(rows[:2], kind), "id", "v").count() == 2


def test_curve():
    a, b = manifold.curve(0.1)
    assert (round(a, 3), round(b, 3)) == (1.577, 0.895)
