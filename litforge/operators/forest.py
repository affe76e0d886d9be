"""Spanning forests by Borůvka rounds: each part takes its best edge to another part, parts so joined become one; a round at least halves the parts that have edges left."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litforge.operators.linkage import connected_components
from litforge.scratch import stored


ONE_TASK = 200_000


def parts_of(links: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """(id, component), the smallest id reachable by links (a, b), which are stored: rounds over stored tables, or one task while there are few links, as their count shows. Both give the same rows."""
    if links.count() > one_task:
        return connected_components(links)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        parent: dict = {}

        def root(x: object) -> object:
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for a, b in zip(pdf["a"].tolist(), pdf["b"].tolist(), strict=True):
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
        return pd.DataFrame([(x, root(x)) for x in list(parent)], columns=["id", "component"])

    kind = links.schema["a"].dataType.simpleString()
    return links.select("a", "b", F.lit(True).alias("_g")).groupBy("_g").applyInPandas(run, f"id {kind}, component {kind}")


def joined_parts(chosen: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """(c, part, s): the part that each part of (c, other, s) now belongs to, and the strength of the edge it took."""
    parts = parts_of(chosen.select(F.col("c").alias("a"), F.col("other").alias("b")), one_task)
    return stored(chosen.select("c", "s").join(parts.select(F.col("id").alias("c"), F.col("component").alias("part")), "c"), "joined")


def bottlenecks(edges: DataFrame, one_task: int = ONE_TASK) -> tuple[DataFrame, DataFrame]:
    """Of a graph (a, b, s), s the larger the stronger: its edges with the weakest link of the strongest path between their ends, and the edges (a, b, s) of its strongest spanning forest.

    The weakest edge between two nodes in the forest is the weakest of those that their parts took until they became one; so every edge carries the weakest seen so far from round to round,
    and the forest's paths are never walked. Of equally strong edges the order of their ends decides, which changes no strength. Loops and edges without strength go.
    """
    live = stored(edges.select("a", "b", "s", F.col("a").alias("ca"), F.col("b").alias("cb"), F.lit(None).cast(edges.schema["s"].dataType).alias("weakest")).filter("a <> b and s is not null"), "graph")
    done, taken = [live.filter("false").select("a", "b", "s", "weakest")], [live.filter("false").select("a", "b", "s")]
    while not live.isEmpty():
        e = F.struct("s", F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"))
        ends = live.select(F.col("ca").alias("c"), F.col("cb").alias("other"), e.alias("e")).unionAll(live.select("cb", "ca", e))
        chosen = stored(ends.groupBy("c").agg(F.max(F.struct("e", "other")).alias("m")).select("c", "m.other", "m.e.s", "m.e.x", "m.e.y"), "chosen")
        taken.append(chosen.select(F.col("x").alias("a"), F.col("y").alias("b"), "s"))
        parts = joined_parts(chosen, one_task)
        for end in ("ca", "cb"):
            p = parts.select(F.col("c").alias(end), F.col("part").alias("_part"), F.col("s").alias("_s"))
            live = live.join(p, end).withColumns({"weakest": F.least("weakest", "_s"), "_end": F.col("_part")}).drop(end, "_part", "_s").withColumnRenamed("_end", end)
        live = stored(live, "graph")
        done.append(live.filter("ca = cb").select("a", "b", "s", "weakest"))
        live = live.filter("ca <> cb")
    return reduce(DataFrame.unionAll, done), reduce(DataFrame.unionAll, taken).distinct()
