"""Productivity laws and citation measures: h-index, Bradford, Lotka, Kolmogorov-Smirnov, descriptives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from litforge.operators.running import placed


def h_index(df: DataFrame, cites: str, *groups: str) -> DataFrame:
    """WIN6: the largest h with h records of h citations and more. Records are counted by citation value first, so ranks run over distinct values, not records."""
    c = F.coalesce(F.col(cites), F.lit(0)).cast("long")
    n = df.groupBy(*groups, c.alias("_c")).agg(F.count(F.lit(1)).alias("_n"))
    above = F.sum("_n").over(Window.partitionBy(*groups).orderBy(F.desc("_c")).rowsBetween(Window.unboundedPreceding, 0))
    return n.withColumn("_r", above).groupBy(*groups).agg(F.max(F.least("_c", "_r")).alias("h_index"))


def citation_descriptives(df: DataFrame, cites: str) -> DataFrame:
    """AGG15"""
    c = F.col(cites)
    counts = [F.count_if(c >= k).alias(f"n_ge_{k}") for k in (10, 50, 100)]
    return df.agg(F.count(c).alias("n"), F.count_if(c == 0).alias("n_zero"), F.avg(c).alias("mean"), F.percentile(c, 0.5).alias("median"), F.max(c).alias("max"), *counts)


def bradford(df: DataFrame, source: str) -> DataFrame:
    """WIN5, WIN7: sources by records (ties by name), cumulative records and share, and zone 1, 2 or 3; the source that crosses a third stays in the lower zone.

    The zone follows from the records before a source, which differs from a step-by-step walk only if one source spans a whole third.
    """
    n = df.filter(F.col(source).isNotNull()).groupBy(source).agg(F.count(F.lit(1)).alias("n"))
    out = placed(n, [F.desc("n"), source], sums={"cumulative": "n"})
    out = out.crossJoin(F.broadcast(out.agg(F.sum("n").alias("_t"))))  # one row
    before = F.col("cumulative") - F.col("n")
    zone = 1 + (before * 3 >= F.col("_t")).cast("int") + (before * 3 >= 2 * F.col("_t")).cast("int")
    return out.select(source, "n", "rank", "cumulative", (100.0 * F.col("cumulative") / F.col("_t")).alias("cumulative_pct"), zone.alias("zone"))


def bradford_zones(ranked: DataFrame) -> DataFrame:
    """STA8, MTH4: sources and records of each zone, and the multiplier, the root of zone 3's sources over zone 1's."""
    z = ranked.groupBy("zone").agg(F.count(F.lit(1)).alias("sources"), F.sum("n").alias("records"))
    w = Window.partitionBy()
    return z.withColumn("multiplier", F.sqrt(F.sum(F.when(F.col("zone") == 3, F.col("sources"))).over(w) / F.sum(F.when(F.col("zone") == 1, F.col("sources"))).over(w)))


def productivity(df: DataFrame, producer: str) -> DataFrame:
    """(x, producers): how many producers have x records."""
    return df.filter(F.col(producer).isNotNull()).groupBy(producer).agg(F.count(F.lit(1)).alias("x")).groupBy("x").agg(F.count(F.lit(1)).alias("producers"))


def regime(alpha: Column) -> Column:
    """MTH3"""
    return F.when(alpha < 1.8, "sub").when(alpha > 2.5, "super").otherwise("classic")


def lotka(counts: DataFrame) -> DataFrame:
    """STA7, MTH2, WIN12: exponent, constant and fit of producers against x on log scales; the greatest distance of both cumulative distributions, and its critical value."""
    fit = counts.agg(
        (-F.regr_slope(F.log10("producers"), F.log10("x"))).alias("alpha"), F.pow(F.lit(10.0), F.regr_intercept(F.log10("producers"), F.log10("x"))).alias("c"),
        F.regr_r2(F.log10("producers"), F.log10("x")).alias("r2"), F.sum("producers").alias("total"),
    )
    p = counts.crossJoin(F.broadcast(fit)).withColumn("model", F.col("c") / F.pow(F.col("x"), F.col("alpha")))  # one row
    w, all_ = Window.orderBy("x").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy()
    gap = F.abs(F.sum("producers").over(w) / F.sum("producers").over(all_) - F.sum("model").over(w) / F.sum("model").over(all_))
    ks = p.select(gap.alias("gap")).agg(F.max("gap").alias("ks"))
    out = fit.crossJoin(ks).withColumn("ks_critical", 1.36 / F.sqrt("total"))
    return out.select("total", "alpha", "c", "r2", "ks", "ks_critical", (F.col("ks") < F.col("ks_critical")).alias("ks_pass"), regime(F.col("alpha")).alias("regime"))


def quadrants(df: DataFrame, x: str, y: str) -> DataFrame:
    """WIN13: quarter of the plane around both medians."""
    m = df.agg(F.percentile(x, 0.5).alias("mx"), F.percentile(y, 0.5).alias("my"))
    high_x, high_y = F.col(x) >= F.col("mx"), F.col(y) >= F.col("my")
    q = F.when(high_x & high_y, "Q1").when(~high_x & high_y, "Q2").when(~high_x & ~high_y, "Q3").otherwise("Q4")
    return df.crossJoin(F.broadcast(m)).withColumn("quadrant", q).drop("mx", "my")  # one row
