"""Exact neighbour searches in Euclidean space: points are dealt to cells around pivots and to rings within a cell, and a search visits only rings that can hold something nearer than its bound.

By the triangle inequality a point at distance x from a pivot lies at least \\|y - x\\| from a query at distance y. Pivots are at most 512 of the points;
rings hold about BLOCK points each, so that their bounds (a number a ring) are a five-hundredth of the points. A group is a block of points and a part of the queries that visit it,
both of bounded size, whatever the points are like.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litforge.scratch import stored

BLOCK, PIVOTS, VISITORS = 512, 512, 8192
LISTS = ("id", "v", "m", "cell", "ring", "sub", "dp")


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A column of equally long lists as rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def exact(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of pairs of rows; the same two rows give the same number wherever they meet."""
    return np.sqrt(((x - y) ** 2).sum(axis=1))


def squares(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Squared distances of all rows by one product, and how far they may be off."""
    a, b = (x * x).sum(axis=1), (y * y).sum(axis=1)
    return np.maximum(a[:, None] + b - 2 * x @ y.T, 0), 1e-11 * (1 + x.shape[1]) * float(a.max(initial=0) + b.max(initial=0))


def nearest(x: np.ndarray, y: np.ndarray, ids: np.ndarray, others: np.ndarray, k: int, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of x, row of y, distance) of the k nearest rows of y to each row of x, itself left out, none beyond its bound; by distance, then id."""
    rows: list[tuple] = []
    step = max(1, (1 << 22) // max(len(y), 1))
    for lo in range(0, len(x), step):
        d, off = squares(x[lo : lo + step], y)
        d[ids[lo : lo + step, None] == others] = np.inf
        limit = np.partition(d, k - 1, axis=1)[:, k - 1] if k <= d.shape[1] else np.full(len(d), np.inf)
        far = np.minimum(limit, np.square(bound[lo : lo + step])) + 2 * off
        i, j = np.nonzero((d <= far[:, None]) & np.isfinite(d))
        e = exact(x[lo + i], y[j])
        keep = e <= bound[lo + i]
        i, j, e = i[keep], j[keep], e[keep]
        order = np.lexsort((others[j], e, i))
        i, j, e = i[order], j[order], e[order]
        rank = np.arange(len(i)) - np.searchsorted(i, i)
        rows.append((lo + i[rank < k], j[rank < k], e[rank < k]))
    return tuple(np.concatenate(c) for c in zip(*rows, strict=True)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


class Cells:
    """The points (id, v, m) of a table with their cell, ring, block and distance to the pivot, stored; and what a search needs to know of them."""

    def __init__(self, points: DataFrame, block: int = BLOCK, pivots: int = PIVOTS):
        n = points.count()
        k = int(min(pivots, max(1, 2 * n // block)))
        first = points.select("id", "v", F.xxhash64("id").alias("_h")).orderBy("_h", "id").limit(k).collect()  # at most PIVOTS rows
        self.ids, self.n = np.array([r["id"] for r in first], np.int64), n
        self.pivots = p = np.array([r["v"] for r in first], np.float64).reshape(len(first), -1)

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    x = matrix(b.column("v"))
                    cell = squares(x, p)[0].argmin(axis=1)
                    yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32)), pa.array(exact(x, p[cell]))], [*b.schema.names, "cell", "dp"])

        kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in points.schema)
        dealt = stored(points.mapInArrow(assign, f"{kinds}, cell int, dp double"), "cells")
        sizes = dealt.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("dp").alias("r")).collect()  # a row a pivot
        per = {s["cell"]: -(-s["n"] // block) for s in sizes}
        most = max([1, *per.values()])
        cuts: dict[int, list[float]] = {}
        if most > 1:
            shares = [i / most for i in range(1, most)]
            large = dealt.filter(F.col("cell").isin([c for c, r in per.items() if r > 1]))
            cuts = {r["cell"]: r["q"] for r in large.groupBy("cell").agg(F.percentile_approx("dp", shares, 10_000).alias("q")).collect()}  # a number a ring
        # a cell takes as many of the cuts as it needs
        self.edges = {c: np.array(sorted({cuts[c][i * most // r - 1] for i in range(1, r)} if c in cuts else set())) for c, r in per.items()}
        edges = self.edges

        if most == 1:  # nothing to part
            self.rings = sorted((s["cell"], 0, 0.0, s["r"], 1) for s in sizes)
            self.points = dealt.withColumns({"ring": F.lit(0), "sub": F.lit(0)})
            return

        def ringed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                cell, dp = b.column("cell").to_numpy(), b.column("dp").to_numpy()
                ring = np.zeros(len(cell), np.int32)
                for c in np.unique(cell):
                    ring[cell == c] = np.searchsorted(edges[c], dp[cell == c], side="left")
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ring)], [*b.schema.names, "ring"])

        placed = stored(dealt.mapInArrow(ringed, f"{kinds}, cell int, dp double, ring int"), "rings")
        spans = placed.groupBy("cell", "ring").agg(F.count(F.lit(1)).alias("n"), F.min("dp").alias("lo"), F.max("dp").alias("hi")).collect()  # a row a ring
        # points of a ring at one and the same distance can't be told by it, and are dealt by id
        self.rings = sorted((r["cell"], r["ring"], r["lo"], r["hi"], -(-r["n"] // (2 * block))) for r in spans)
        many = {(c, g): s for c, g, _, _, s in self.rings if s > 1}
        sub = F.lit(1)
        if many:
            spread = placed.sparkSession.createDataFrame([(c, g, s) for (c, g), s in many.items()], "cell int, ring int, subs int")
            placed = placed.join(F.broadcast(spread), ["cell", "ring"], "left")  # a row a ring
            sub = F.coalesce("subs", F.lit(1))
        self.points = stored(placed.withColumn("sub", F.pmod(F.xxhash64("id"), sub).cast("int")).drop("subs"), "blocks")

    def visits(self, queries: DataFrame, skip: np.ndarray | None = None, own: bool = True) -> DataFrame:
        """A row for each query and block that can hold a point within its bound. queries: (id, v, bound, ...), with ``comp`` if cells of one component (skip: a component a cell, -1 for several) are to be left out;
        with own=False the query's own block (cell, ring, sub) is left out."""
        p = self.pivots
        cells, ring, lo, hi, subs = (np.array(c) for c in zip(*self.rings, strict=True))
        names = [c for c in queries.columns if c not in ("cell", "ring", "sub")]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for start in range(0, whole.num_rows, 512):
                    b = whole.slice(start, 512)
                    x, bound = matrix(b.column("v")), b.column("bound").to_numpy()
                    d2, off = squares(x, p)
                    d, slack = np.sqrt(d2), np.sqrt(off)
                    y = d[:, cells]
                    near = (y - hi <= bound[:, None] + slack) & (lo - y <= bound[:, None] + slack)
                    if skip is not None:
                        near &= skip[cells] != b.column("comp").to_numpy()[:, None]
                    q, r = np.nonzero(near)
                    s = subs[r]
                    q, r = np.repeat(q, s), np.repeat(r, s)
                    part = np.arange(len(q)) - np.repeat(np.cumsum(s) - s, s)
                    if not own:
                        mine = [b.column(c).to_numpy()[q] for c in ("cell", "ring", "sub")]
                        keep = (mine[0] != cells[r]) | (mine[1] != ring[r]) | (mine[2] != part)
                        q, r, part = q[keep], r[keep], part[keep]
                    picked = b.select(names).take(pa.array(q))
                    yield pa.RecordBatch.from_arrays([*picked.columns, *[pa.array(c.astype(np.int32)) for c in (cells[r], ring[r], part)]], [*names, "cell", "ring", "sub"])

        kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in queries.schema if f.name not in ("cell", "ring", "sub"))
        return queries.mapInArrow(run, f"{kinds}, cell int, ring int, sub int")

    def meet(self, visits: DataFrame, members: DataFrame, run: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
        """``run`` on the visitors and the members of each block; a block with many visitors meets them in parts."""
        key = ["cell", "ring", "sub"]
        visits = stored(visits, "visits")
        parts = visits.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / VISITORS).cast("int").alias("parts"))
        v = visits.join(parts, key).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).drop("parts")
        m = members.join(parts, key).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
        return v.groupBy(*key, "part").cogroup(m.groupBy(*key, "part")).applyInArrow(run, schema)


def nearest_neighbours(cells: Cells, k: int) -> DataFrame:
    """(id, near: array of (d, other, m)) with the k nearest other points of each point, by distance, then id."""
    schema = "id long, d double, other long, m long"
    kinds = pa.schema([("id", pa.int64()), ("d", pa.float64()), ("other", pa.int64()), ("m", pa.int64())])

    def rows(q: pa.Table, m: pa.Table, bound: np.ndarray) -> pa.Table:
        a, b = q.column("id").to_numpy(), m.column("id").to_numpy()
        i, j, d = nearest(matrix(q.column("v")), matrix(m.column("v")), a, b, k, bound)
        return pa.Table.from_arrays([pa.array(a[i]), pa.array(d), pa.array(b[j]), pa.array(m.column("m").to_numpy()[j])], schema=kinds)

    def inner(t: pa.Table) -> pa.Table:
        return rows(t, t, np.full(t.num_rows, np.inf))

    def outer(q: pa.Table, m: pa.Table) -> pa.Table:
        return rows(q, m, q.column("bound").to_numpy()) if q.num_rows and m.num_rows else kinds.empty_table()

    points = cells.points.select("id", "v", F.col("m").cast("long").alias("m"), "cell", "ring", "sub")
    here = stored(points.groupBy("cell", "ring", "sub").applyInArrow(inner, schema), "near")
    bounds = here.groupBy("id").agg(F.when(F.count(F.lit(1)) >= k, F.max("d")).otherwise(F.lit(float("inf"))).alias("bound"))
    queries = points.join(bounds, "id", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf")))).drop("m")
    away = cells.meet(cells.visits(queries, own=False), points, outer, schema)
    # a point has at most k rows from each block it visits, and those only within its bound
    best = here.unionAll(away).groupBy("id").agg(F.slice(F.array_sort(F.collect_list(F.struct("d", "other", "m"))), 1, k).alias("near"))
    return points.select("id").join(best, "id", "left").select("id", F.coalesce("near", F.array().cast("array<struct<d:double,other:bigint,m:bigint>>")).alias("near"))
