"""Counts over time: annual trends, growth, periods, top categories with the rest, rising and declining items."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from litforge.functions.text import assign_period

Periods = Sequence[tuple[str, int, int]]


def annual_counts(df: DataFrame, year: str = "year") -> DataFrame:
    """AGG6: (year, n)."""
    return df.filter(F.col(year).isNotNull()).groupBy(F.col(year).cast("long").alias("year")).agg(F.count(F.lit(1)).alias("n"))


def annual_trend(counts: DataFrame, window: int = 5) -> DataFrame:
    """WIN1-3: cumulative count, share of all, growth against the row before, centred mean over full windows. The input has a row a year, so one task orders it."""
    w = Window.orderBy("year")
    half = window // 2
    around = w.rowsBetween(-half, half)
    before = F.lag("n").over(w)
    return counts.select(
        "year", "n",
        F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("cumulative"),
        (100.0 * F.col("n") / F.sum("n").over(Window.partitionBy())).alias("pct_of_total"),
        ((F.col("n") / before - 1) * 100).alias("yoy_growth_pct"),
        F.when(F.count("n").over(around) == window, F.avg("n").over(around)).alias("rolling_mean"),
    )


def period_statistics(counts: DataFrame, periods: Periods) -> DataFrame:
    """AGG7 and MTH1: total, mean and compound annual growth of each closed period; null for a period of one year."""
    p = counts.withColumn("period", assign_period(F.col("year"), periods)).filter("period is not null").groupBy("period")
    out = p.agg(F.sum("n").alias("n_total"), F.avg("n").alias("annual_mean"), F.min_by("n", "year").alias("first"), F.max_by("n", "year").alias("last"), (F.max("year") - F.min("year")).alias("span"))
    growth = F.when((F.col("span") > 0) & (F.col("first") > 0), (F.pow(F.col("last") / F.col("first"), 1 / F.col("span")) - 1) * 100)
    return out.select("period", "n_total", "annual_mean", growth.alias("cagr_pct"))


def peak(counts: DataFrame) -> DataFrame:
    """WIN9: the first year with the highest count."""
    return counts.agg(F.max_by("year", F.struct("n", -F.col("year"))).alias("peak_year"), F.max("n").alias("n"))


def acceleration(trend: DataFrame, least: float = 20.0) -> DataFrame:
    """WIN10: years that grew by so many percent and more."""
    return trend.filter(F.col("yoy_growth_pct") >= least).select("year", "n", "yoy_growth_pct")


def linear_forecast(count: Column, months: float) -> Column:
    """PER3: a part of a year, carried on to a whole one."""
    return count * 12 / months


def topk_other(df: DataFrame, time: str, category: str, k: int = 8, other: str = "other") -> DataFrame:
    """AGG30: counts by time and category; all but the k most frequent categories (ties by name) count as other."""
    top = df.groupBy(category).agg(F.count(F.lit(1)).alias("_n")).orderBy(F.desc("_n"), category).limit(k).select(F.col(category).alias("_top"))
    joined = df.join(F.broadcast(top), F.col(category) == F.col("_top"), "left")  # k rows
    return joined.groupBy(time, F.coalesce("_top", F.lit(other)).alias("category")).agg(F.count(F.lit(1)).alias("n"))


def share_by_period(df: DataFrame, item: str, record: str, period: str) -> DataFrame:
    """TXT5: per item and period the distinct records, and their share of the period's distinct records."""
    total = df.groupBy(period).agg(F.countDistinct(record).alias("total"))
    return df.groupBy(item, period).agg(F.countDistinct(record).alias("n")).join(total, period).withColumn("pct", 100.0 * F.col("n") / F.col("total"))


def evolution(df: DataFrame, topic: str, period: str, early: str, late: str) -> DataFrame:
    """TXT4, MTH6: per topic its share of the early and of the late period, the difference, and the smoothed ratio."""
    n = df.filter(F.col(period).isin(early, late)).groupBy(topic).agg(F.count_if(F.col(period) == early).alias("n_early"), F.count_if(F.col(period) == late).alias("n_late"))
    w = Window.partitionBy()
    share = lambda c: 100.0 * F.col(c) / F.nullif(F.sum(c).over(w), F.lit(0))
    out = n.select(topic, "n_early", "n_late", share("n_early").alias("pct_early"), share("n_late").alias("pct_late"))
    return out.withColumns({"delta": F.col("pct_late") - F.col("pct_early"), "fold": (F.col("pct_late") + 0.01) / (F.col("pct_early") + 0.01)})


def rising_declining(shares: DataFrame, item: str, k: int = 10) -> DataFrame:
    """SRT2 over TXT5: the k items that gained most and the k that lost most."""
    up = shares.filter("delta > 0").orderBy(F.desc("delta"), item).limit(k).withColumn("trend", F.lit("rising"))
    down = shares.filter("delta < 0").orderBy(F.asc("delta"), item).limit(k).withColumn("trend", F.lit("declining"))
    return up.unionByName(down)
