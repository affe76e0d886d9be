"""Exact order statistics of groups by counting: a histogram is refined around the wanted place until one value is left, so no group is sorted or gathered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from litforge.scratch import stored

BROADCAST_ROWS = 100_000
BINS = 64


def beside(df: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """The rows joined with a table of one row a key, null being a key of its own. The table is broadcast only while it is small; beyond, adaptive execution splits a key that is skewed."""
    t = table.withColumnRenamed(key, "_key")
    t = F.broadcast(t) if t.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else t
    return df.join(t, F.col(key).eqNullSafe(F.col("_key"))).drop("_key")


def order_statistic(df: DataFrame, group: str, value: str, place: Column, name: str = "cut", bins: int = BINS) -> DataFrame:
    """(group, name): the value at a place from 0 among the filled values of a group in ascending order. ``place`` is an expression on their number n. Groups without such a place are absent.

    A round counts the values of each bin between approximate quantiles of the bin before, and keeps the bin that holds the place. The smallest value is a bin of its own, so each round
    leaves less, whatever the quantiles: they only decide how fast it ends (by about ``bins`` times fewer values a round). Equal values share a bin and are only counted.
    """
    rows = df.select(group, F.col(value).alias("_v")).filter(F.col(value).isNotNull())
    cuts = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    shape = [F.count(F.lit(1)).alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"), F.percentile_approx("_v", cuts, F.lit(20 * bins)).alias("bounds")]
    # approximate quantiles are doubles inside, which can't tell large whole numbers apart; even steps can
    even = F.expr(f"transform(sequence(1, {bins - 1}), i -> try_add(lo, i * greatest(hi div {bins} - lo div {bins}, 1L)))") if dict(rows.dtypes)["_v"] == "bigint" else F.expr("slice(bounds, 1, 0)")
    state = rows.groupBy(group).agg(*shape).withColumn("at", place.cast("long")).filter("at >= 0 and at < n").drop("n")
    done = None
    while True:
        state = stored(state, "bins")
        ended = state.filter("lo <=> hi").select(group, F.col("lo").alias(name))
        done = ended if done is None else done.unionAll(ended)
        state = state.filter("not lo <=> hi")
        if state.isEmpty():
            return done
        edges = state.select(group, "lo", "hi", F.array_distinct(F.concat(F.array("lo"), "bounds", even)).alias("bounds"))
        bin_ = F.size(F.filter("bounds", lambda b: b < F.col("_v"))).alias("bin")
        binned = beside(rows, edges, group).filter("_v >= lo and _v <= hi").select(group, "_v", bin_)
        counts = binned.groupBy(group, "bin").agg(*shape)
        before = F.sum("n").over(Window.partitionBy(group).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1))  # a row a bin
        counts = beside(counts.withColumn("before", F.coalesce(before, F.lit(0))), state.select(group, "at"), group)
        state = counts.filter("before <= at and at < before + n").select(group, "lo", "hi", "bounds", (F.col("at") - F.col("before")).alias("at"))
