"""VEC3: density clustering by hierarchy. Core distances from an exact nearest-neighbour join, a spanning tree of mutual reachability by Borůvka rounds, and a condensed tree from which the clusters of the greatest excess of mass are taken.

Merges at one distance are one merge of all parts concerned, so that ties give one result, whichever spanning tree was found. The tree is built in levels of distance: within a level every connected
part is a group of its own, later levels see it as one node, and no group holds more than about ``level`` edges, whatever the number of points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litforge.operators.forest import ONE_TASK, parts_of
from litforge.operators.neighbors import BLOCK, Cells, exact, matrix, nearest_neighbours, squares
from litforge.operators.running import placed
from litforge.scratch import stored

INF = float("inf")
LEAST = 1e-9  # distances below count as this one, so that densities stay finite
LEVEL = 2_000_000


def core_distances(points: DataFrame, near: DataFrame, min_samples: int, others: int) -> DataFrame:
    """(id, v, m, core, radius, near): the distance within which ``min_samples`` other points lie, copies counted; radius: no point outside of the list is nearer. others: how many distinct points there are besides."""
    start = F.struct((F.col("m") - 1).alias("seen"), F.when(F.col("m") > min_samples, 0.0).otherwise(INF).alias("core"))
    step = lambda a, x: F.struct((a["seen"] + x["m"]).alias("seen"), F.when(a["core"] < INF, a["core"]).when(a["seen"] + x["m"] >= min_samples, x["d"]).otherwise(INF).alias("core"))
    x = points.join(near, "id").withColumn("core", F.aggregate("near", start, step)["core"])
    last = F.try_element_at("near", F.lit(-1))["d"]
    return x.withColumn("core", F.when(F.col("core") == INF, F.coalesce(last, F.lit(0.0))).otherwise(F.col("core"))).withColumn("radius", F.when(F.size("near") >= others, INF).otherwise(F.coalesce(last, F.lit(0.0))))


def crossing(q: pa.Table, m: pa.Table) -> pa.Table:
    """Of each visitor the least mutual reachability to a member of another component, within its bound."""
    kinds = pa.schema([("comp", pa.int64()), ("w", pa.float64()), ("a", pa.int64()), ("b", pa.int64()), ("other", pa.int64())])
    if not q.num_rows or not m.num_rows:
        return kinds.empty_table()
    x, y = matrix(q.column("v")), matrix(m.column("v"))
    core, bound, comp, ids = (q.column(c).to_numpy() for c in ("core", "bound", "comp", "id"))
    core2, comp2, ids2 = (m.column(c).to_numpy() for c in ("core", "comp", "id"))
    out: list[tuple] = []
    step = max(1, (1 << 22) // len(y))
    for lo in range(0, len(x), step):
        hi = min(lo + step, len(x))
        d, off = squares(x[lo:hi], y)
        d = np.maximum(d, np.square(np.maximum(core[lo:hi, None], core2)))
        d[comp[lo:hi, None] == comp2] = np.inf
        least = np.minimum(d.min(axis=1), np.square(bound[lo:hi])) + 2 * off
        i, j = np.nonzero((d <= least[:, None]) & np.isfinite(d))
        w = np.maximum(exact(x[lo + i], y[j]), np.maximum(core[lo + i], core2[j]))
        order = np.lexsort((ids2[j], w, i))
        first = order[np.flatnonzero(np.diff(i[order], prepend=-1))]
        first = first[w[first] <= bound[lo + i[first]]]
        i, j, w = i[first], j[first], w[first]
        out.append((comp[lo + i], w, ids[lo + i], ids2[j], comp2[j]))
    return pa.Table.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], schema=kinds)


def reachability_tree(cells: Cells, cored: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """(a, b, w): edges of a spanning tree of mutual reachability (more where weights are equal, which joins nothing else).

    A part's best edge is among the listed neighbours unless some point's list may end before it; only such points search the blocks, within the best edge known so far: a listed one, or one to a pivot.
    The largest part searches nothing, as the others come to it.
    """
    known = cored.select("id", "core")
    listed = cored.select(F.col("id").alias("a"), "core", F.explode("near").alias("x")).select("a", F.col("x.other").alias("b"), "core", "x.d")
    e = listed.join(known.select(F.col("id").alias("b"), F.col("core").alias("_c")), "b").select("a", "b", F.greatest("d", "core", "_c").alias("w"))
    live = stored(e.withColumns({"ca": F.col("a"), "cb": F.col("b")}), "reach")
    info = stored(cells.points.select("id", "v", "cell", "ring", "sub", "dp").join(cored.select("id", "core", "radius"), "id").withColumn("comp", F.col("id")), "parts")
    taken: list[DataFrame] = []
    while True:
        sizes = info.groupBy("comp").agg(F.count(F.lit(1)).alias("n"))
        biggest = sizes.agg(F.max(F.struct("n", "comp")).alias("m"), F.count(F.lit(1)).alias("k")).first()
        if biggest["k"] <= 1:
            break
        large = F.lit(biggest["m"]["comp"]) if biggest["m"]["n"] > 1 else F.lit(None).cast("long")
        apart = F.coalesce(F.col("comp") != large, F.lit(True))
        # the best edge known: listed, or to a pivot
        known_edge = F.min(F.struct("w", "a", "b", "other")).alias("e")
        best = live.select(F.col("ca").alias("comp"), "w", "a", "b", F.col("cb").alias("other")).filter(apart)
        searching = info.filter(apart)
        # a row a pivot, which is the one point without a distance to it: whether its cell is all of one part, and its own part
        cell = info.groupBy("cell").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max(F.when(F.col("dp") == 0, F.struct("id", "comp", "core"))).alias("p")).collect()
        marks = {r["p"]["id"]: (r["p"]["comp"], r["p"]["core"]) for r in cell if r["p"]}
        skip = np.full(len(cells.pivots), -1, np.int64)
        skip[[r["cell"] for r in cell]] = [r["lo"] if r["lo"] == r["hi"] else -1 for r in cell]
        best = best.unionAll(searching.mapInArrow(_to_pivots(cells, marks), "comp long, w double, a long, b long, other long")).groupBy("comp").agg(known_edge).select("comp", "e.w", "e.a", "e.b", "e.other")
        best = stored(best, "best")
        open_ = searching.join(best.select("comp", F.col("w").alias("bound")), "comp").filter((F.greatest("core", "radius") < F.col("bound")))
        found = cells.meet(cells.visits(open_.select("id", "v", "core", "comp", "bound"), skip), info.select("id", "v", "core", "comp", "cell", "ring", "sub"), crossing, "comp long, w double, a long, b long, other long")
        chosen = stored(best.unionAll(found.select(best.columns)).groupBy("comp").agg(known_edge).select("comp", "e.w", "e.a", "e.b", "e.other"), "chosen")
        taken.append(chosen.select("a", "b", "w"))
        parts = stored(parts_of(chosen.select(F.col("comp").alias("a"), F.col("other").alias("b")), one_task).select(F.col("id").alias("_c"), F.col("component").alias("_to")), "joined")
        for end in ("ca", "cb"):
            live = live.join(parts, live[end] == parts["_c"], "left").withColumn(end, F.coalesce("_to", end)).drop("_c", "_to")
        live = stored(live.filter("ca <> cb"), "reach")
        info = stored(info.join(parts, info["comp"] == parts["_c"], "left").withColumn("comp", F.coalesce("_to", "comp")).drop("_c", "_to"), "parts")
    out = taken[0] if taken else live.select("a", "b", "w").filter("false")
    for t in taken[1:]:
        out = out.unionAll(t)
    copies = cored.filter("m > 1").select(F.col("id").alias("a"), F.col("id").alias("b"), F.col("core").alias("w"))
    return stored(out.unionAll(copies), "tree")


def _to_pivots(cells: Cells, marks: dict[int, tuple[int, float]]):
    """Of each part its least mutual reachability to a pivot of another part, batch by batch."""
    some = np.array([i in marks for i in cells.ids.tolist()])
    pivots, pivot_ids = cells.pivots[some], cells.ids[some]
    comps, cores = (np.array([marks[i][k] for i in pivot_ids.tolist()]) for k in (0, 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows and len(pivots):
                x, comp, core, ids = matrix(b.column("v")), b.column("comp").to_numpy(), b.column("core").to_numpy(), b.column("id").to_numpy()
                d = np.maximum(np.sqrt(squares(x, pivots)[0]), np.maximum(core[:, None], cores))
                d[comp[:, None] == comps] = np.inf
                j = d.argmin(axis=1)
                w = np.where(np.isfinite(d[np.arange(len(j)), j]), np.maximum(exact(x, pivots[j]), np.maximum(core, cores[j])), np.inf)
                order = np.lexsort((ids, w, comp))
                first = order[np.flatnonzero(np.r_[True, comp[order][1:] != comp[order][:-1]])]
                first = first[np.isfinite(w[first])]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (comp[first], w[first], ids[first], pivot_ids[j[first]], comps[j[first]])], ["comp", "w", "a", "b", "other"])

    return run


STATE = "node long, size long, cluster string, mass double, below double, death double, peak double"
EVENTS = "kind string, node long, into long, size long, cluster string, parent string, mass double, below double, death double, peak double, w double, lambda double, chosen boolean"


def merge_level(least: int):
    """One connected part of a level: its edges (a, b, w) between nodes and the state of these nodes, to the state of what they become, the clusters that end, and the points' way out.

    State: size; cluster, null below ``least`` points; mass, the sum of the densities at which its points left it so far; below, the best excess of mass in its subtree; death, the density at which it came to be; peak, the greatest density below it.
    """

    def run(edges: pd.DataFrame, states: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        states = states.astype(object).where(states.notna(), None)
        state = {r.node: [r.size, r.cluster, r.mass, r.below, r.death, r.peak] for r in states.itertuples()}
        parent = {n: n for n in state}
        loose = {n: [n] for n, s in state.items() if s[1] is None}  # nodes of parts that are no cluster yet
        label = dict.fromkeys(state)  # smallest node of a part

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for w, tie in edges.sort_values(["w", "a", "b"]).groupby("w", sort=False):
            density = 1 / max(w, LEAST)
            joined: dict[int, set[int]] = {}
            for a, b in zip(tie["a"].tolist(), tie["b"].tolist(), strict=True):
                a, b = root(a), root(b)
                mine = joined.pop(a, {a}) | joined.pop(b, {b})
                top = min(mine)
                for x in mine:
                    parent[x] = top
                joined[top] = mine
            for top in sorted(joined):
                parts = sorted(joined[top])
                big = [p for p in parts if state[p][1] is not None]
                small = [p for p in parts if state[p][1] is None]
                total = sum(state[p][0] for p in parts)
                gone = [n for p in small for n in loose.pop(p)]
                if not big and total < least:
                    state[top], loose[top] = [total, None, 0.0, 0.0, 0.0, 0.0], gone
                    continue
                left = sum(state[p][0] for p in small) * density
                if len(big) == 1:
                    _, cluster, mass, below, death, peak = state[big[0]]
                    new = [total, cluster, mass + left, below, death, peak]
                else:
                    cluster, below = f"{top}@{w!r}", 0.0
                    for p in big:
                        size, c, mass, under, death, peak = state[p]
                        excess = mass - size * density
                        out.append(("cluster", None, None, size, c, cluster, excess, under, death, peak, w, density, excess >= under))
                        below += max(excess, under)
                    new = [total, cluster, total * density, below, density, max([density, *[state[p][5] for p in big]])]
                state[top] = new
                out += [("left", n, None, None, cluster, None, None, None, None, None, w, density, None) for n in gone]
        for n in label:
            out.append(("node", n, root(n), None, None, None, None, None, None, None, None, None, None))
        for n in sorted({root(n) for n in label}):
            size, cluster, mass, below, death, peak = state[n]
            out.append(("state", n, None, size, cluster, None, mass, below, death, peak, None, None, None))
        return pd.DataFrame(out, columns=[c.split()[0] for c in EVENTS.split(", ")])

    return run


def condensed(points: DataFrame, tree: DataFrame, least: int, level: int, one_task: int = ONE_TASK) -> tuple[DataFrame, DataFrame]:
    """(id, cluster, lambda): the cluster each point left, and at which density; and (cluster, parent, w, death, peak, chosen): all clusters, w the distance at which they join others, null for the last."""
    n = tree.count()
    cuts = [-INF] if n <= level else sorted({-INF, *tree.approxQuantile("w", [i / -(-n // level) for i in range(1, -(-n // level))], 0.0005)})
    where = points.select("id", F.col("id").alias("node"), F.lit(None).cast("string").alias("cluster"), F.lit(None).cast("double").alias("lambda"))
    state = points.select(F.col("id").alias("node"), F.col("m").cast("long").alias("size"), F.lit(None).cast("string").alias("cluster"), *[F.lit(0.0).alias(c) for c in ("mass", "below", "death", "peak")])
    ended: list[DataFrame] = []
    for i, low in enumerate(cuts):
        edges = tree.filter(F.col("w") >= low) if i else tree
        edges = edges.filter(F.col("w") < cuts[i + 1]) if i + 1 < len(cuts) else edges
        if len(cuts) == 1:
            edges, nodes = edges.withColumn("g", F.lit(0).cast("long")), state.withColumn("h", F.lit(0).cast("long"))
        else:
            for end in "ab":
                edges = edges.join(where.select(F.col("id").alias(end), F.col("node").alias("_n")), end).withColumn(end, F.col("_n")).drop("_n")
            edges = stored(edges.select("a", "b", "w"), "level")
            touched = edges.select(F.col("a").alias("id")).unionAll(edges.select("b")).distinct()
            parts = touched.join(parts_of(edges, one_task), "id", "left").select("id", F.coalesce("component", "id").alias("g"))
            parts = stored(parts, "groups")
            edges = edges.join(parts.withColumnRenamed("id", "a"), "a")
            nodes = state.join(parts.select(F.col("id").alias("node"), F.col("g").alias("h")), "node")
        events = stored(edges.groupBy("g").cogroup(nodes.groupBy("h")).applyInPandas(merge_level(least), EVENTS), "events")
        ended.append(events.filter("kind = 'cluster'").select("cluster", "parent", "w", "death", "peak", "chosen"))
        left = events.filter("kind = 'left'").select("node", F.col("cluster").alias("_cluster"), F.col("lambda").alias("_lambda"))
        to = events.filter("kind = 'node'").select("node", F.col("into").alias("_into"))
        # copies of one point leave with it; a point leaves once
        where = where.join(left, "node", "left").join(to, "node", "left")
        where = stored(where.select("id", F.coalesce("_into", "node").alias("node"), F.coalesce("cluster", "_cluster").alias("cluster"), F.coalesce("lambda", "_lambda").alias("lambda")), "where")
        fresh = events.filter("kind = 'state'").select("node", "size", "cluster", "mass", "below", "death", "peak")
        state = stored(state.join(to, "node", "left_anti").unionAll(fresh), "state") if len(cuts) > 1 else fresh
    last = state.filter("cluster is not null").select("cluster", F.lit(None).cast("string").alias("parent"), F.lit(None).cast("double").alias("w"), "death", "peak", F.lit(False).alias("chosen"))
    for e in ended:
        last = last.unionAll(e)
    return where.select("id", "cluster", "lambda"), stored(last, "clusters")


def topmost(clusters: DataFrame, chosen: DataFrame) -> DataFrame:
    """(cluster, best): of each cluster the topmost chosen one among itself and those above, by pointer doubling; null where there is none."""
    marks = chosen.select(F.col("cluster").alias("_m")).distinct()
    x = clusters.join(marks, F.col("cluster") == F.col("_m"), "left").select("cluster", F.col("parent").alias("up"), F.col("_m").alias("best"))
    while True:
        x = stored(x, "topmost")
        if x.filter("up is not null").isEmpty():
            return x.select("cluster", "best")
        y = x.select(F.col("cluster").alias("_c"), F.col("up").alias("_up"), F.col("best").alias("_best"))
        x = x.join(y, F.col("up") == F.col("_c"), "left").select("cluster", F.col("_up").alias("up"), F.coalesce("_best", "best").alias("best"))


def selected(clusters: DataFrame, epsilon: float) -> DataFrame:
    """(cluster, best): which final cluster each cluster belongs to: those of the greatest excess of mass, and where they join others within epsilon, the first one above that reaches beyond it; never the last of all."""
    found = topmost(clusters, clusters.filter("chosen"))
    if epsilon <= 0:
        return found
    eom = found.filter("best is not null").select(F.col("best").alias("cluster")).distinct()
    tops = clusters.filter("parent is null").select(F.col("cluster").alias("_t"))
    can = clusters.filter(F.col("w") <= epsilon).join(tops, F.col("parent") == F.col("_t"), "left_anti").select("cluster", "parent")
    x = clusters.select("cluster").join(can, "cluster", "left").select("cluster", F.coalesce("parent", "cluster").alias("to"))
    while True:
        x = stored(x, "climb")
        y = x.select(F.col("cluster").alias("_c"), F.col("to").alias("_to"))
        z = x.join(y, F.col("to") == F.col("_c")).select("cluster", "to", "_to")
        if z.filter("to <> _to").isEmpty():
            break
        x = z.select("cluster", F.col("_to").alias("to"))
    climbs = eom.join(clusters.select("cluster", "w"), "cluster").join(x, "cluster").select(F.when(F.col("w") < epsilon, F.col("to")).otherwise(F.col("cluster")).alias("cluster"))
    return topmost(clusters, climbs)


def density_clusters(df: DataFrame, identifier: str, vector: str, min_cluster: int = 50, min_samples: int = 5, epsilon: float = 0.0, listed: int = 15, level: int = LEVEL, block: int = BLOCK, one_task: int = ONE_TASK) -> DataFrame:
    """VEC3: (identifier, cluster_id, probability, outlier_score) for each row. Clusters are numbered by size (ties by smallest identifier); -1 is noise.

    ``min_samples`` other points make a place dense; ``min_cluster`` points make a cluster; clusters that join within ``epsilon`` are one. Identifiers are whole numbers and distinct. Vectors that are null, of another length than
    most rows' (the first one's), or hold null or non-finite components are noise with probability 0 and outlier score 0. Equal vectors are one point with a weight.
    """
    good = F.col(vector).isNotNull() & ~F.exists(F.col(vector), lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == INF))
    rows = stored(df.select(F.col(identifier).cast("long").alias("row"), F.when(good, F.col(vector).cast("array<double>")).alias("v")), "vectors")
    size = rows.filter("v is not null").groupBy(F.size("v").alias("k")).count().orderBy(F.desc("count"), "k").first()  # a row a length
    nothing = rows.select(F.col("row").alias(identifier), F.lit(-1).cast("long").alias("cluster_id"), F.lit(0.0).alias("probability"), F.lit(0.0).alias("outlier_score"))
    if size is None:
        return nothing
    usable = rows.filter(F.size("v") == size["k"]).withColumn("v", F.transform("v", lambda x: x + 0.0))  # no negative zeros
    points = stored(usable.groupBy("v").agg(F.min("row").alias("id"), F.count(F.lit(1)).alias("m")).select("id", "v", "m"), "points")
    cells = Cells(points, block)
    near = nearest_neighbours(cells, max(listed, min_samples))
    cored = stored(core_distances(cells.points.select("id", "m"), near, min_samples, cells.n - 1), "cores")
    tree = reachability_tree(cells, cored, one_task)
    where, clusters = condensed(points, tree, min_cluster, level, one_task)
    best = selected(clusters, epsilon)
    each = where.join(clusters.select("cluster", "peak"), "cluster").join(best, "cluster").join(clusters.select(F.col("cluster").alias("best"), "death"), "best", "left")
    probability = F.when(F.col("best").isNull(), 0.0).otherwise(F.least("lambda", "death") / F.col("death"))
    each = each.select("id", "best", probability.alias("probability"), ((F.col("peak") - F.least("lambda", "peak")) / F.col("peak")).alias("outlier_score"))
    back = usable.join(points.select("v", "id"), "v").select("row", "id")
    labelled = stored(back.join(each, "id", "left").select("row", "best", "probability", "outlier_score"), "labelled")
    numbers = placed(labelled.filter("best is not null").groupBy("best").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("least")), [F.desc("n"), "least"], "k").select("best", (F.col("k") - 1).alias("cluster_id"))
    x = rows.select("row").join(labelled.join(numbers, "best", "left"), "row", "left")
    return x.select(F.col("row").alias(identifier), F.coalesce("cluster_id", F.lit(-1)).cast("long").alias("cluster_id"), F.coalesce("probability", F.lit(0.0)).alias("probability"), F.coalesce("outlier_score", F.lit(0.0)).alias("outlier_score"))
