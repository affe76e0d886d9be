"""Connected components of a link table, wholly distributed: alternating large-star and small-star rounds, each written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litforge.llm.common import materialise


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): the smallest id reachable, for every id that has a link to another id. Ids are longs; loops and repeated links do no harm. Rounds go on until nothing moves."""
    pair = (F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    edges = materialise(links.filter(F.col(a) != F.col(b)).select(*pair).distinct(), "links")
    while True:
        # done when each u has one link, and to an id that links no further
        twice = edges.groupBy("u").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("u")
        chained = edges.join(edges.select(F.col("v").alias("w")).distinct(), F.col("u") == F.col("w"), "left_semi").select("u")
        if not twice.unionAll(chained).limit(1).count():
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionAll(edges.select("v", "v").distinct())
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = materialise(small.unionAll(low.select("u", F.col("m").alias("v"))).distinct(), "links")
