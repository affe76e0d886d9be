"""VEC2: manifold projection. A neighbour graph by descent (neighbours of neighbours are likely neighbours) in joins, fuzzy memberships by bisection, and a layout by rounds of sampled edges.

Every step works on rows of one point and its few neighbours, or on blocks of about 512 points. In a round of the layout each block moves its own points for some epochs, among the positions the others had when
the round began; the repelling samples of a round are positions of at most POOL points. Seeds depend on block and round alone and rows are put in order first, so the same table gives the same layout.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litforge.operators.neighbors import BLOCK, Cells, matrix, nearest
from litforge.operators.topics import principal
from litforge.scratch import stored

POOL = 1000
RATE = 0.1


def unit_vectors(df: DataFrame, identifier: str, vector: str) -> DataFrame:
    """(id, v, m): distinct directions as vectors of length one, m how many rows share it; null, zero and non-finite vectors have none. Distances between them order as cosines do."""
    x = df.select(F.col(identifier).cast("long").alias("row"), F.col(vector).cast("array<double>").alias("v")).filter(F.col("v").isNotNull() & ~F.exists("v", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))))
    x = x.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, e: s + e * e))).filter("norm > 0")
    return x.select("row", F.transform("v", lambda e: e / F.col("norm") + 0.0).alias("v"))


def neighbour_graph(cells: Cells, k: int = 15, rounds: int = 12, sample: int = 40, wide: int = 30, enough: float = 0.001) -> DataFrame:
    """(id, near: array of (d, other)), about the k nearest others of each point. Starts with the neighbours in a point's own block and in two random groups; a round introduces up to ``sample`` neighbours of a point, either way, to each other,
    by a hash that changes from round to round; lists are ``wide`` entries long until the end, as the longer they are the more is found; it is done when fewer than ``enough`` of all entries change, or after ``rounds`` rounds."""
    wide, keep = max(wide, k), k
    k = wide
    points = cells.points.select("id", F.col("v").cast("array<float>").alias("v"), "cell", "ring", "sub")
    kinds = pa.schema([("id", pa.int64()), ("d", pa.float64()), ("other", pa.int64())])

    def inner(t: pa.Table) -> pa.Table:
        ids, x = t.column("id").to_numpy(), matrix(t.column("v")).astype(np.float64)
        i, j, d = nearest(x, x, ids, ids, k, np.full(len(ids), np.inf))
        return pa.Table.from_arrays([pa.array(ids[i]), pa.array(d), pa.array(ids[j])], schema=kinds)

    def introduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for met in b.column("met"):
                ids = met.values.field("id").to_numpy()
                if len(ids) < 2:
                    continue
                x, far = matrix(met.values.field("v")).astype(np.float64), met.values.field("far").to_numpy()
                d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(2))
                i, j = np.nonzero((d < far[:, None]) & (ids[:, None] != ids))
                out.append((ids[i], d[i, j], ids[j]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], schema=kinds)

    vectors = points.select("id", "v")
    # the block gives near ones; two random groups of its size give links between blocks
    groups = [F.struct("cell", "ring", "sub"), *[F.struct(F.lit(-1 - s).alias("cell"), F.pmod(F.xxhash64("id", F.lit(s)), F.lit(max(1, cells.n // BLOCK))).cast("int").alias("ring"), F.lit(0).alias("sub")) for s in (0, 1)]]
    near = points.select("id", "v", F.explode(F.array(*groups)).alias("g")).groupBy("g").applyInArrow(inner, "id long, d double, other long")
    best = lambda rows: rows.groupBy("id").agg(F.slice(F.array_sort(F.collect_set(F.struct("d", "other"))), 1, k).alias("near"))
    lists = stored(vectors.select("id").join(best(near), "id", "left").select("id", F.coalesce("near", F.array().cast("array<struct<d:double,other:bigint>>")).alias("near")), "lists")
    for r in range(rounds):
        links = lists.select("id", F.explode("near").alias("x")).select("id", "x.other")
        both = links.unionAll(links.select("other", "id")).unionAll(lists.select("id", "id")).distinct()
        # of each point a few neighbours; so many rows a point, whatever its fame: the rest is cut off before vectors are fetched
        picked = both.groupBy("id").agg(F.slice(F.array_sort(F.collect_list(F.struct(F.xxhash64("id", "other", F.lit(r)).alias("h"), "other"))), 1, sample).alias("s"))
        reach = lists.select(F.col("id").alias("other"), F.when(F.size("near") < k, float("inf")).otherwise(F.element_at("near", -1)["d"]).alias("far")).join(vectors.withColumnRenamed("id", "other"), "other")
        met = picked.select("id", F.explode("s.other").alias("other")).join(reach, "other").groupBy("id").agg(F.collect_list(F.struct(F.col("other").alias("id"), "v", "far")).alias("met"))
        found = met.select("met").mapInArrow(introduce, "id long, d double, other long").distinct()
        old = lists.select("id", F.explode("near").alias("x")).select("id", "x.d", "x.other")
        # the same pair has the same distance wherever it met
        fresh = lists.select("id").join(best(old.unionAll(found)), "id", "left").select("id", F.coalesce("near", F.array().cast("array<struct<d:double,other:bigint>>")).alias("near"))
        fresh = stored(fresh, "lists")
        changed = fresh.join(lists.select("id", F.col("near").alias("_old")), "id").agg(F.sum(F.size(F.array_except(F.transform("near", lambda x: x["other"]), F.transform("_old", lambda x: x["other"])))).alias("n")).first()["n"]
        lists = fresh
        if (changed or 0) <= enough * cells.n * k:
            break
    return lists.select("id", F.slice("near", 1, keep).alias("near"))


def memberships(lists: DataFrame) -> DataFrame:
    """(i, j, w), both ways: how much two points are neighbours, 1 to the nearest and falling with a width at which the weights of a point sum to log2 of their number, found by bisection; either way's weight counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column("near")
            n = np.diff(column.offsets.to_numpy())
            rows = np.repeat(np.arange(len(n)), n)
            flat = column.flatten()
            d, other = flat.field("d").to_numpy(), flat.field("other").to_numpy()
            if not len(d):
                continue
            rho = np.full(len(n), np.inf)
            np.minimum.at(rho, rows[d > 0], d[d > 0])
            gap = np.maximum(d - np.where(np.isfinite(rho), rho, 0.0)[rows], 0)
            lo, hi, sigma, target = np.zeros(len(n)), np.full(len(n), np.inf), np.ones(len(n)), np.log2(np.maximum(n, 2))
            for _ in range(64):
                total = np.bincount(rows, np.exp(-gap / sigma[rows]), len(n))
                wide = total > target
                hi, lo = np.where(wide, sigma, hi), np.where(wide, lo, sigma)
                sigma = np.where(np.isfinite(hi), (lo + hi) / 2, lo * 2)
                sigma = np.maximum(sigma, 1e-12)
            yield pa.RecordBatch.from_arrays([pa.array(b.column("id").to_numpy()[rows]), pa.array(other), pa.array(np.exp(-gap / sigma[rows]))], ["i", "j", "w"])

    one = lists.mapInArrow(run, "i long, j long, w double")
    x = one.groupBy(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b")).agg(F.sum("w").alias("s"), F.product("w").alias("p"), F.count(F.lit(1)).alias("n"))
    x = x.select("a", "b", F.when(F.col("n") == 1, F.col("s")).otherwise(F.col("s") - F.col("p")).alias("w")).filter("w > 1e-6")
    return x.select(F.col("a").alias("i"), F.col("b").alias("j"), "w").unionAll(x.select("b", "a", "w"))


def curve(min_dist: float, spread: float = 1.0) -> tuple[float, float]:
    """a and b of 1 / (1 + a d^2b), fitted by ever finer grids to a curve that is 1 up to min_dist and falls off exponentially beyond."""
    d = np.linspace(1e-3, 3 * spread, 300)
    want = np.where(d < min_dist, 1.0, np.exp(-(d - min_dist) / spread))
    a, b, step = 1.5, 1.0, 0.5
    for _ in range(40):
        grid = [(x, y) for x in a + step * np.linspace(-1, 1, 9) for y in b + step * np.linspace(-1, 1, 9) if x > 0 and y > 0]
        a, b = min(grid, key=lambda g: float(((1 / (1 + g[0] * d ** (2 * g[1])) - want) ** 2).sum()))
        step *= 0.7
    return float(a), float(b)


def block_moves(a: float, b: float, top: float, dims: int, r: int, rounds: int, epochs: int, seed: int, negatives: int, pool: np.ndarray):
    """The epochs of one round in one block. e: edges (i, j, w, q) with the far end's position; n: the block's points (id, p)."""
    key = ["cell", "ring", "sub"]

    def move(keys: tuple, e: pd.DataFrame, n: pd.DataFrame) -> pd.DataFrame:
        n, e = n.sort_values("id"), e.sort_values(["i", "j"])
        rng = np.random.default_rng([seed, r, *[int(k) for k in keys]])
        ids, x = n["id"].to_numpy(), np.stack(n["p"].to_numpy())
        i = np.searchsorted(ids, e["i"].to_numpy())
        at = np.minimum(np.searchsorted(ids, e["j"].to_numpy()), len(ids) - 1)
        here = ids[at] == e["j"].to_numpy()
        away, chance = (np.stack(e["q"].to_numpy()) if len(e) else np.zeros((0, dims))), e["w"].to_numpy() / top
        for step in range(epochs):
            alpha = 1 - (r * epochs + step) / (rounds * epochs)
            live = np.flatnonzero(rng.random(len(i)) < chance)
            if not len(live):
                continue
            u, v = i[live], np.where(here[live, None], x[at[live]], away[live])
            gap = x[u] - v
            d2 = (gap**2).sum(1)
            pull = np.where(d2 > 0, -2 * a * b * np.maximum(d2, 1e-12) ** (b - 1) / (1 + a * d2**b), 0.0)
            change = np.zeros_like(x)
            np.add.at(change, u, np.clip(pull[:, None] * gap, -4, 4))
            for _ in range(negatives):
                gap = x[u] - pool[rng.integers(len(pool), size=len(u))]
                d2 = (gap**2).sum(1)
                push = np.where(d2 > 0, 2 * b / ((1e-3 + d2) * (1 + a * d2**b)), 0.0)
                np.add.at(change, u, np.clip(push[:, None] * gap, -4, 4))
            # all of a point's edges of an epoch move it at once, so by a part of what each would alone, and by one at most
            size = np.sqrt((change**2).sum(1, keepdims=True))
            x = x + RATE * alpha * change * np.minimum(1, 1 / np.maximum(size, 1e-12))
        return pd.DataFrame({"id": ids, **{k: np.int32(v) for k, v in zip(key, keys, strict=True)}, "p": list(x)})

    return move


def layout(edges: DataFrame, start: DataFrame, a: float, b: float, rounds: int, epochs: int, seed: int, negatives: int = 5) -> DataFrame:
    """(id, p): positions after rounds. edges: (i, j, w), both ways; start: (id, cell, ring, sub, p)."""
    key = ["cell", "ring", "sub"]
    dims = len(start.first()["p"])
    top = edges.agg(F.max("w")).first()[0] or 1.0
    where = stored(start, "layout")
    own = stored(edges.join(where.select(F.col("id").alias("i"), *key), "i"), "edges")
    for r in range(rounds):
        pool = np.array([x["p"] for x in where.select(F.xxhash64("id", F.lit(seed), F.lit(r)).alias("h"), "id", "p").orderBy("h", "id").limit(POOL).collect()])

        near = own.join(where.select(F.col("id").alias("j"), F.col("p").alias("q")), "j")
        moved = near.groupBy(*key).cogroup(where.groupBy(*key)).applyInPandas(block_moves(a, b, top, dims, r, rounds, epochs, seed, negatives, pool), "id long, cell int, ring int, sub int, p array<double>")
        where = stored(moved, "layout")
    return where.select("id", "p")


def project(df: DataFrame, identifier: str, vector: str, dims: int = 2, k: int = 15, min_dist: float = 0.1, rounds: int = 20, epochs: int = 10, seed: int = 42, block: int = BLOCK) -> DataFrame:
    """VEC2: (identifier, position) for every row, neighbours by cosine. Null, zero and non-finite vectors have a null position, equal directions share one. Identifiers are distinct whole numbers."""
    rows = stored(unit_vectors(df, identifier, vector), "directions")
    everyone = df.select(F.col(identifier).cast("long").alias(identifier))
    points = stored(rows.groupBy("v").agg(F.min("row").alias("id"), F.count(F.lit(1)).alias("m")).select("id", "v", "m"), "points")
    n = points.count()
    if not n:
        return everyone.withColumn("position", F.lit(None).cast("array<double>"))
    cells = Cells(points, block)
    width = len(points.first()["v"])
    flat = principal(cells.points.select("id", "v", "cell", "ring", "sub"), "v", min(dims, width), "p")
    size = flat.agg(F.max(F.aggregate("p", F.lit(0.0), lambda s, e: F.greatest(s, F.abs(e)))).alias("s")).first()["s"] or 1.0
    jitter = lambda i: (F.pmod(F.xxhash64("id", F.lit(seed), i), F.lit(20001)) - 10000) / 1e8  # noqa: E731  no two points begin at one place
    # components are sums in no fixed order, so their last digits go
    begin = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.round(F.coalesce(F.get("p", i), F.lit(0.0)) * 10 / size, 6) + jitter(i))
    start = flat.select("id", "cell", "ring", "sub", begin.alias("p"))
    edges = stored(memberships(neighbour_graph(cells, k)), "memberships")
    done = layout(edges, start, *curve(min_dist), rounds, epochs, seed)
    placed = rows.join(points.select("v", "id"), "v").join(done, "id").select(F.col("row").alias(identifier), F.col("p").alias("position"))
    return everyone.join(placed, identifier, "left")
