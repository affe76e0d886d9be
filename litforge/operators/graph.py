"""Evidence networks: edges and nodes from interaction rows, typed multigraphs, flows, communities and their scores."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from litforge.operators.forest import ONE_TASK, bottlenecks
from litforge.operators.running import placed
from litforge.scratch import stored


def top_value(df: DataFrame, keys: Sequence[str], value: str, name: str, prefer: Column | None = None) -> DataFrame:
    """The most frequent value of each key (preferred values first, ties by name)."""
    n = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    rank = F.struct((~prefer if prefer is not None else F.lit(False)).alias("p"), (-F.col("n")).alias("n"), F.col(value).alias("v"))
    return n.groupBy(*keys).agg(F.min(rank)["v"].alias(name))


def edge_aggregate(df: DataFrame, src: str, dst: str, record: str | None, tops: dict[str, str], sets: Sequence[str], mean: str, year: str, ordinal: tuple[str, dict[str, int]], prefer: dict[str, Column] | None = None) -> DataFrame:
    """AGG20-22: per pair its rows, most frequent values, sorted value sets with sizes, mean, highest value on an ordinal scale (ties by name), first and last year, and record ids. Without a record column no row grows with its pair, and ``lists.chunked(df, [src, dst], record)`` holds the ids in chunks."""
    keys = [src, dst]
    column, scale = ordinal
    level = F.lit(0)
    for k, v in scale.items():
        level = F.when(F.col(column) == k, v).otherwise(level)
    out = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_records"), F.avg(mean).alias(f"mean_{mean}"), F.min(year).alias("year_min"), F.max(year).alias("year_max"), (F.max(year) - F.min(year) + 1).alias("year_span"),
        F.min(F.when(F.col(column).isNotNull(), F.struct((-level).alias("l"), F.col(column).alias("v"))))["v"].alias(f"max_{column}"),
        *[F.array_join(F.array_sort(F.collect_set(c)), "|").alias(f"{c}_set") for c in sets], *[F.size(F.collect_set(c)).cast("long").alias(f"n_{c}") for c in sets],
        *([F.array_join(F.array_sort(F.collect_list(record)), "|").alias("record_ids")] if record else []),
    )
    for name, c in tops.items():
        out = out.join(top_value(df, keys, c, name, (prefer or {}).get(c)), keys, "left")
    return out


def node_table(edges: DataFrame, meta: DataFrame | None = None, src: str = "src", dst: str = "dst") -> DataFrame:
    """GRF5: distinct ends of edges with the metadata of their smallest row."""
    nodes = edges.select(F.col(src).alias("node_id"), F.lit("src").alias("node_type")).unionAll(edges.select(dst, F.lit("dst"))).distinct()
    if meta is None:
        return nodes
    rest = [c for c in meta.columns if c != "node_id"]
    first = meta.groupBy("node_id").agg(F.min(F.struct(*rest)).alias("m")).select("node_id", "m.*")
    return nodes.join(first, "node_id", "left")


def triples_to_edges(df: DataFrame, a: str, b: str, c: str, label: str) -> DataFrame:
    """GRF6: each triple as three typed edges with prefixed ends, counted by (src, dst, label)."""
    end = lambda k: F.concat(F.lit(f"{k}::"), F.col(k))
    pairs = F.array(*[F.struct(end(x).alias("src"), end(y).alias("dst"), F.lit(f"{x}_{y}").alias("edge_type")) for x, y in ((a, b), (b, c), (a, c))])
    return df.select(F.explode(pairs).alias("e"), F.col(label).alias("label")).select("e.*", "label").groupBy("src", "dst", "edge_type", "label").agg(F.count(F.lit(1)).alias("weight"))


def flows(df: DataFrame, a: str, b: str, c: str, k: int = 50) -> DataFrame:
    """AGG25, GRF7: the k most frequent chains, as the summed links of their two halves."""
    chains = df.groupBy(a, b, c).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), a, b, c).limit(k)
    left = chains.groupBy(F.concat(F.lit(f"{a}:"), a).alias("source"), F.concat(F.lit(f"{b}:"), b).alias("target")).agg(F.sum("n").alias("value"))
    return left.unionAll(chains.groupBy(F.concat(F.lit(f"{b}:"), b), F.concat(F.lit(f"{c}:"), c)).agg(F.sum("n")))


def thresholded(nodes: DataFrame, edges: DataFrame, node_least: int, edge_least: int) -> tuple[DataFrame, DataFrame]:
    """FLT15: nodes (node, n) and edges (a, b, n) above their thresholds, edges among kept nodes only."""
    kept = nodes.filter(F.col("n") >= node_least)
    e = edges.filter(F.col("n") >= edge_least)
    for end in "ab":
        e = e.join(kept.select(F.col("node").alias(end)), end, "left_semi")
    return kept, e.select("a", "b", "n")


def density(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """MTH8: nodes and distinct edges of a bipartite network, and both densities."""
    e = edges.select(src, dst).distinct()
    out = e.agg(F.countDistinct(src).alias("n_src"), F.countDistinct(dst).alias("n_dst"), F.count(F.lit(1)).alias("n_edges"))
    n = F.col("n_src") + F.col("n_dst")
    return out.select("*", F.try_divide(F.col("n_edges"), F.col("n_src") * F.col("n_dst")).alias("bipartite_density"), F.try_divide(2.0 * F.col("n_edges"), n * (n - 1)).alias("density"))


def degrees(edges: DataFrame) -> DataFrame:
    """Weighted degree and neighbours of each node of (a, b, n)."""
    both = edges.select(F.col("a").alias("node"), "n").unionAll(edges.select("b", "n"))
    return both.groupBy("node").agg(F.count(F.lit(1)).alias("degree"), F.sum("n").alias("strength"))


def modularity(edges: DataFrame, membership: DataFrame, resolution: float = 1.0) -> DataFrame:
    """GRF2 (score): modularity of a partition (node, community) of a weighted graph (a, b, n)."""
    m = membership.select(F.col("node").alias("a"), F.col("community").alias("ca"))
    k = membership.select(F.col("node").alias("b"), F.col("community").alias("cb"))
    e = edges.join(m, "a").join(k, "b")
    inside = e.filter("ca = cb").groupBy(F.col("ca").alias("community")).agg(F.sum("n").alias("inside"))
    total = edges.agg(F.sum("n").alias("m"))
    each = degrees(edges).join(membership, "node").groupBy("community").agg(F.sum("strength").alias("k"))
    share = F.coalesce("inside", F.lit(0)) / F.col("m") - resolution * F.pow(F.col("k") / (2 * F.col("m")), 2)
    return each.join(inside, "community", "left").crossJoin(F.broadcast(total)).agg(F.sum(share).alias("modularity"), F.count(F.lit(1)).alias("n_communities"))


def within_strength(edges: DataFrame, membership: DataFrame, k: int = 15) -> DataFrame:
    """GRF3: of each community the k nodes with most weight to its other nodes."""
    m = membership.select(F.col("node").alias("a"), F.col("community").alias("ca"))
    q = membership.select(F.col("node").alias("b"), F.col("community").alias("cb"))
    e = edges.join(m, "a").join(q, "b").filter("ca = cb")
    s = e.select("ca", F.col("a").alias("node"), "n").unionAll(e.select("ca", "b", "n")).groupBy(F.col("ca").alias("community"), "node").agg(F.sum("n").alias("strength"))
    return s.withColumn("rank", F.row_number().over(Window.partitionBy("community").orderBy(F.desc("strength"), "node")).cast("long")).filter(F.col("rank") <= k)


def louvain(edges: DataFrame, resolution: float = 1.0, least: int = 1, one_task: int = ONE_TASK) -> DataFrame:
    """GRF2: (node, community) of a graph (a, b, n) by local moves and folding; communities are numbered by size (ties by smallest node), those under ``least`` nodes go. No seed: all choices go by weight and name.

    A graph of more than ``one_task`` edges takes levels of rounds in which all nodes move at once (``moved``), and is folded after each; what is left at or below that count, as checked, one task finishes node by node.
    When communities no longer merge, nodes move once more from where they are, and if any does, levels start anew.
    """
    lo, hi = F.least(F.col("a").cast("string"), F.col("b").cast("string")), F.greatest(F.col("a").cast("string"), F.col("b").cast("string"))
    both_ends = F.when(lo == hi, 2.0).otherwise(1.0)  # a loop counts at both ends, here as in folded graphs
    graph = edges.filter("a is not null and b is not null and n > 0").select(lo.alias("a"), hi.alias("b"), (F.col("n").cast("double") * both_ends).alias("n"))
    graph = stored(graph.groupBy("a", "b").agg(F.sum("n").alias("n")), "graph")
    whole = graph
    home = graph.select(F.col("a").alias("node")).unionAll(graph.select("b")).distinct().withColumn("community", F.col("node"))
    if graph.count() <= one_task:
        home = stored(_in_one_task(graph, resolution), "home")
    else:
        parts, moves = moved(graph, resolution)
        while moves:
            home = stored(_through(home, parts), "home")
            graph = stored(folded(graph, parts), "graph")
            if graph.count() <= one_task:
                home, moves = stored(_through(home, _in_one_task(graph, resolution)), "home"), False
            else:
                parts, moves = moved(graph, resolution)
            if not moves:  # the communities stand; once more node by node, from where they are
                parts, moves = moved(whole, resolution, home)
                graph = whole
                if moves:
                    home = whole.select(F.col("a").alias("node")).unionAll(whole.select("b")).distinct().withColumn("community", F.col("node"))
    sizes = home.groupBy("community").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("first")).filter(F.col("size") >= least)
    number = placed(sizes, [F.desc("size"), "first"], "k").select("community", (F.col("k") - 1).alias("number"))
    return home.join(number, "community").select("node", F.col("number").alias("community"))


def _in_one_task(graph: DataFrame, resolution: float) -> DataFrame:
    return graph.withColumn("_g", F.lit(1)).groupBy("_g").applyInPandas(_local_communities(resolution), "node string, community string")


def _through(home: DataFrame, parts: DataFrame) -> DataFrame:
    """Nodes with the community that their community went to."""
    step = parts.select(F.col("node").alias("_node"), F.col("community").alias("_to"))
    return home.join(step, F.col("community") == F.col("_node"), "left").select("node", F.coalesce("_to", "community").alias("community"))


def folded(graph: DataFrame, parts: DataFrame) -> DataFrame:
    """The graph of the communities: weights between them, and loops that count weights within them at both ends."""
    for end in "ab":
        graph = graph.join(parts.select(F.col("node").alias(end), F.col("community").alias(f"c{end}")), end)
    inner = F.when((F.col("ca") == F.col("cb")) & (F.col("a") != F.col("b")), 2.0).otherwise(1.0)
    return graph.select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b"), (F.col("n") * inner).alias("n")).groupBy("a", "b").agg(F.sum("n").alias("n"))


def moved(graph: DataFrame, resolution: float = 1.0, start: DataFrame | None = None, gain: float = 1e-7) -> tuple[DataFrame, bool]:
    """One level of Louvain in rounds, from every node alone or from given communities: (node, community), and whether anything moved. Loops of the graph count both ends.

    In a round every node names the community that gains most. Those whose new community has a smaller name move together in one round, those with a greater name in the next, so that no two nodes swap for ever. If that does not
    raise the modularity, only moves are made that are the best of both communities they touch: they share no community, so their gains add up. Thus modularity rises from round to round, and rounds end.
    """
    sym = graph.filter("a <> b").select("a", "b", "n").unionAll(graph.filter("a <> b").select("b", "a", "n"))
    sym = stored(sym, "sym")
    k = sym.select("a", "n").unionAll(graph.filter("a = b").select("a", "n")).groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("k"))
    k = k.withColumn("c", F.col("node")) if start is None else k.join(start.select("node", F.col("community").alias("c")), "node")
    labels = stored(k.select("node", "k", "c"), "labels")
    whole = labels.agg(F.sum("k")).first()[0]
    if not whole:
        return labels.select("node", F.col("c").alias("community")), False

    def score(labels: DataFrame) -> float:
        near = labels.select(F.col("node").alias("b"), F.col("c").alias("cb"))
        inside = sym.join(labels.select(F.col("node").alias("a"), F.col("c").alias("ca")), "a").join(near, "b").filter("ca = cb").agg(F.sum("n").alias("i"))
        spread = labels.groupBy("c").agg(F.sum("k").alias("t")).agg(F.sum(F.pow(F.col("t") / whole, 2)).alias("s"))
        r = inside.crossJoin(spread).first()  # one row each; loops are the same in all partitions
        return (r["i"] or 0.0) / whole - resolution * r["s"]

    def wishes(labels: DataFrame) -> DataFrame:
        total = labels.groupBy("c").agg(F.sum("k").alias("t"))
        links = sym.join(labels.select(F.col("node").alias("b"), "c"), "b").groupBy("a", "c").agg(F.sum("n").alias("w"))
        own = labels.join(total, "c").select(F.col("node").alias("a"), F.col("c").alias("c0"), "k", F.col("t").alias("t0"))
        x = links.join(own, "a").join(total, "c")
        worth = F.col("w") - resolution * F.col("k") * (F.col("t") - F.when(F.col("c") == F.col("c0"), F.col("k")).otherwise(0.0)) / whole
        x = x.withColumn("g", worth).groupBy("a", "c0").agg(
            F.min(F.when(F.col("c") != F.col("c0"), F.struct((-F.round("g", 12)).alias("g"), F.col("c").alias("c")))).alias("best"),
            F.coalesce(F.max(F.when(F.col("c") == F.col("c0"), F.col("g"))), F.first(-resolution * F.col("k") * (F.col("t0") - F.col("k")) / whole)).alias("stay"),
        )
        return x.select(F.col("a").alias("node"), "c0", F.col("best.c").alias("c1"), (-F.col("best.g") - F.col("stay")).alias("more")).filter(F.col("more") > 1e-9)

    def made(labels: DataFrame, moves: DataFrame) -> DataFrame:
        to = moves.select("node", F.col("c1").alias("_to"))
        return stored(labels.join(to, "node", "left").select("node", "k", F.coalesce("_to", "c").alias("c")), "labels")

    now, any_move, down = score(labels), False, True
    while True:
        moves = stored(wishes(labels), "wishes")
        if moves.isEmpty():
            break
        after = None
        for way in (down, not down):
            some = moves.filter("c1 < c0" if way else "c1 > c0")
            if not some.isEmpty():
                trial = made(labels, some)
                value = score(trial)
                if value > now + gain:
                    labels, after, down = trial, value, not way
                    break
        if after is None:
            ends = moves.select(F.explode(F.array("c0", "c1")).alias("c"), F.struct("more", "node").alias("m")).groupBy("c").agg(F.max("m")["node"].alias("best"))
            apart = moves
            for c in ("c0", "c1"):
                apart = apart.join(ends.select(F.col("c").alias(c), F.col("best").alias("node")), [c, "node"], "left_semi")
            trial = made(labels, apart)
            value = score(trial)
            if value <= now + gain:
                break
            labels, after = trial, value
        now, any_move = after, True
    return labels.select("node", F.col("c").alias("community")), any_move


def _local_communities(resolution: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names = sorted(set(pdf["a"]) | set(pdf["b"]))
        place = {n: i for i, n in enumerate(names)}
        graph: list[dict[int, float]] = [{} for _ in names]
        for a, b, w in sorted(zip(pdf["a"], pdf["b"], pdf["n"], strict=True)):
            i, j = place[a], place[b]
            graph[i][j] = graph[i].get(j, 0) + w
            if i != j:
                graph[j][i] = graph[j].get(i, 0) + w
        whole, belongs, level = graph, list(range(len(names))), graph
        home, moved = _local_moves(whole, resolution, belongs)
        while moved:
            order = {c: k for k, c in enumerate(sorted(set(home)))}
            merged: list[dict[int, float]] = [{} for _ in order]
            for i, near in enumerate(level):
                for j, w in near.items():
                    a, b = order[home[i]], order[home[j]]
                    merged[a][b] = merged[a].get(b, 0) + w
            belongs = [order[home[g]] for g in belongs]
            level = merged
            home, moved = _local_moves(level, resolution, list(range(len(level))))
            if not moved:  # the communities stand; once more node by node, from where they are
                level = whole
                home, moved = _local_moves(whole, resolution, belongs)
                belongs = list(range(len(names))) if moved else belongs
        first: dict[int, str] = {}
        for n, g in zip(names, belongs, strict=True):
            first.setdefault(g, n)
        return pd.DataFrame([(n, first[g]) for n, g in zip(names, belongs, strict=True)], columns=["node", "community"])

    return run


def _local_moves(graph: list[dict[int, float]], resolution: float, start: list[int]) -> tuple[list[int], bool]:
    """Each node to the neighbouring community with the greatest gain, from where it is, until none moves. Loops of an aggregated graph count both ends already."""
    strength = [sum(near.values()) for near in graph]
    whole = sum(strength)
    home, total, any_move = list(start), [0.0] * len(graph), False
    for i, c in enumerate(home):
        total[c] += strength[i]
    again = True
    while again and whole:
        again = False
        for i, near in enumerate(graph):
            links: dict[int, float] = {}
            for j, w in near.items():
                if j != i:
                    links[home[j]] = links.get(home[j], 0) + w
            own = home[i]
            total[own] -= strength[i]
            gain = lambda c: links.get(c, 0) - resolution * strength[i] * total[c] / whole  # noqa: B023, E731
            best = max(sorted(links), key=lambda c: (round(gain(c), 12), -c), default=own)
            if links and gain(best) > gain(own) + 1e-12:
                home[i], again, any_move = best, True, True
            total[home[i]] += strength[i]
    return home, any_move


def label_propagation(edges: DataFrame, rounds: int = 5) -> DataFrame:
    """A distributed stand-in for Louvain on large graphs: each node takes the label with most weight among its neighbours, ties to the smallest; a fixed number of stored rounds."""
    both = stored(edges.select("a", "b", "n").unionAll(edges.select("b", "a", "n")), "sym")
    labels = both.select(F.col("a").alias("node")).distinct().withColumn("community", F.col("node"))
    for _ in range(rounds):
        near = both.join(labels.select(F.col("node").alias("b"), "community"), "b").groupBy("a", "community").agg(F.sum("n").alias("w"))
        labels = stored(near.groupBy(F.col("a").alias("node")).agg(F.min(F.struct((-F.col("w")).alias("w"), F.col("community").alias("c")))["c"].alias("community")), "labels")
    return labels


def thematic_map(pairs: DataFrame, counts: DataFrame, membership: DataFrame) -> DataFrame:
    """GRF9: Callon's centrality and density of each community: sums of equivalence indexes c*c/(f*g) to other communities and within it, the latter by its size."""
    f, g = (counts.select(F.col("node").alias(x), F.col("n").alias(f"f{x}")) for x in "ab")
    m = [membership.select(F.col("node").alias(x), F.col("community").alias(f"c{x}")) for x in "ab"]
    e = pairs.join(f, "a").join(g, "b").join(m[0], "a").join(m[1], "b").withColumn("e", F.col("n") * F.col("n") / (F.col("fa") * F.col("fb")))
    size = membership.groupBy("community").agg(F.count(F.lit(1)).alias("size"))
    out = e.filter("ca <> cb").select(F.col("ca").alias("community"), "e").unionAll(e.filter("ca <> cb").select("cb", "e")).groupBy("community").agg((10 * F.sum("e")).alias("centrality"))
    inner = e.filter("ca = cb").groupBy(F.col("ca").alias("community")).agg(F.sum("e").alias("i"))
    return size.join(out, "community", "left").join(inner, "community", "left").select("community", "size", F.coalesce("centrality", F.lit(0.0)).alias("centrality"), (100 * F.coalesce("i", F.lit(0.0)) / F.col("size")).alias("density"))


def three_fields(df: DataFrame, a: str, b: str, c: str, ks: tuple[int, int, int] = (20, 20, 30)) -> DataFrame:
    """GRF8: links a-b and b-c among the most frequent values of each field."""
    for x, k in zip((a, b, c), ks, strict=True):
        top = df.groupBy(x).agg(F.count(F.lit(1)).alias("_n")).orderBy(F.desc("_n"), x).limit(k).select(x)
        df = df.join(F.broadcast(top), x, "left_semi")  # k rows
    left = df.groupBy(F.col(a).cast("string").alias("source"), F.col(b).cast("string").alias("target")).agg(F.count(F.lit(1)).alias("value")).withColumn("side", F.lit("left"))
    return left.unionAll(df.groupBy(F.col(b).cast("string"), F.col(c).cast("string")).agg(F.count(F.lit(1))).withColumn("side", F.lit("right")))


def bursts(df: DataFrame, item: str, time: str, s: float = 2.0, gamma: float = 1.0) -> DataFrame:
    """GRF10: (item, first, last, weight) of burst periods by the two-state automaton: an item's share of each period's records, in a base and a raised state, cheapest path of states.

    A fold over the periods in order keeps the cheapest path to either state, with the bursts that the path has closed and the one it has open; so nothing is walked back, and no Python is involved. A row holds as many entries as there are periods.
    """
    each = df.filter(F.col(item).isNotNull() & F.col(time).isNotNull()).groupBy(F.col(item).cast("string").alias("item"), F.col(time).cast("long").alias("t")).agg(F.count(F.lit(1)).alias("r"))
    periods = each.groupBy("t").agg(F.sum("r").alias("d")).agg(F.array_sort(F.collect_list(F.struct("t", "d"))).alias("periods"), F.sum("d").cast("double").alias("whole"))  # one row
    x = each.groupBy("item").agg(F.map_from_entries(F.collect_list(F.struct("t", "r"))).alias("seen"), F.sum("r").cast("double").alias("n")).crossJoin(F.broadcast(periods))
    p0 = F.col("n") / F.col("whole")
    x = x.withColumns({"p0": p0, "p1": F.least(F.lit(0.9999), p0 * s), "up": gamma * F.log(F.size("periods") + F.lit(1.0))}).filter("p0 > 0 and p0 < 1")
    steps = F.transform("periods", lambda p: F.struct(p["t"].alias("t"), F.coalesce(F.try_element_at("seen", p["t"]), F.lit(0)).alias("r"), p["d"].alias("d")))
    burst = "struct<first:bigint,last:bigint,weight:double>"
    path = lambda v, done, open_: F.struct(v.cast("double").alias("v"), done.alias("done"), open_.cast(burst).alias("open"))
    none, closed = F.lit(None).cast(burst), F.array().cast(f"array<{burst}>")
    # the part of a cost that both states share is left out, as it decides nothing
    cost = lambda q, p: -(q["r"] * F.log(p) + (q["d"] - q["r"]) * F.log(1 - p))
    shut = lambda a: F.when(a["open"].isNull(), a["done"]).otherwise(F.concat(a["done"], F.array(a["open"])))

    def step(a: Column, q: Column) -> Column:
        base, raised, low, high = a["base"], a["raised"], cost(q, F.col("p0")), cost(q, F.col("p1"))
        longer = lambda b: F.struct(F.coalesce(b["first"], q["t"]).alias("first"), q["t"].alias("last"), (F.coalesce(b["weight"], F.lit(0.0)) + low - high).alias("weight"))
        stays, rises = base["v"] <= raised["v"], base["v"] + F.col("up") < raised["v"]
        to_base = F.when(stays, path(base["v"] + low, base["done"], none)).otherwise(path(raised["v"] + low, shut(raised), none))
        to_raised = F.when(rises, path(base["v"] + F.col("up") + high, base["done"], longer(none))).otherwise(path(raised["v"] + high, raised["done"], longer(raised["open"])))
        return F.struct(to_base.alias("base"), to_raised.alias("raised"))

    start = F.struct(path(F.lit(0.0), closed, none).alias("base"), path(F.col("up"), closed, none).alias("raised"))
    ends = F.aggregate(steps, start, step, lambda a: F.when(a["raised"]["v"] < a["base"]["v"], shut(a["raised"])).otherwise(shut(a["base"])))
    return x.select("item", F.explode(ends).alias("b")).select("item", "b.first", "b.last", "b.weight")


def g_index_nodes(df: DataFrame, period: str, item: str, weight: str, k: int = 25) -> DataFrame:
    """GRF10: (period, item, weight, rank) of each period's items that a scaled g-index keeps: the first g by weight, g the largest number with g*g <= k times their summed weight. df: a row for each period and item."""
    w = Window.partitionBy(period).orderBy(F.desc(weight), item)
    x = df.withColumns({"rank": F.row_number().over(w).cast("long"), "_upto": F.sum(weight).over(w.rowsBetween(Window.unboundedPreceding, 0))})
    # places grow by squares and sums ever slower, so what is kept is a head of the list
    return x.filter(F.col("rank") * F.col("rank") <= k * F.col("_upto")).select(period, item, weight, "rank")


def cosine_links(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """GRF10: links (a, b, n) with their cosine, n over the root of both ends' counts. nodes: (node, n)."""
    na, nb = (nodes.select(F.col("node").alias(e), F.col("n").alias(f"n_{e}")) for e in "ab")
    return pairs.join(na, "a").join(nb, "b").select("a", "b", "n", (F.col("n") / F.sqrt(F.col("n_a").cast("double") * F.col("n_b"))).alias("cosine"))


def pathfinder(edges: DataFrame, strength: str = "n", one_task: int = ONE_TASK) -> DataFrame:
    """GRF10: the edges (a, b, strength) of a Pathfinder network over paths of any length, a path being as strong as its weakest link: an edge stays if no path joins its ends by stronger links only.

    That is so if it is as strong as the strongest path's weakest link, which Borůvka rounds find for all edges together; so equal edges stay or go together, and a graph may be of any size.
    """
    whole = edges.select(F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b"), F.col(strength).alias("s"))
    return bottlenecks(whole, one_task)[0].filter("s >= weakest").select("a", "b", F.col("s").alias(strength))


def llr_labels(df: DataFrame, cluster: str, term: str, k: int = 5) -> DataFrame:
    """GRF10: (cluster, term, n, llr, rank) of the k terms that mark a cluster most by the log-likelihood ratio of rows in and outside of it; terms rarer inside than expected don't count."""
    x = df.filter(F.col(cluster).isNotNull() & F.col(term).isNotNull()).groupBy(F.col(cluster).alias("cluster"), F.col(term).alias("term")).agg(F.count(F.lit(1)).alias("n"))
    of = lambda *keys: F.sum("n").over(Window.partitionBy(*keys)).cast("double")
    total = x.agg(F.sum("n").cast("double").alias("_t"))
    x = x.withColumns({"_c": of("cluster"), "_w": of("term")}).crossJoin(F.broadcast(total))  # one row
    n, c, w, t = F.col("n").cast("double"), F.col("_c"), F.col("_w"), F.col("_t")
    part = lambda seen, expected: F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)
    llr = 2 * (part(n, c * w / t) + part(c - n, c * (t - w) / t) + part(w - n, (t - c) * w / t) + part(t - c - w + n, (t - c) * (t - w) / t))
    x = x.filter(n * t > c * w).select("cluster", "term", "n", llr.alias("llr"))
    return x.withColumn("rank", F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("llr"), "term")).cast("long")).filter(F.col("rank") <= k)
