"""Places and running sums over a whole table, without a task that sees all its rows: ranges of the order, a row of sums for each range, and windows within ranges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from litforge.scratch import stored

BEFORE = (Window.unboundedPreceding, -1)


def ranged(df: DataFrame, *order: Column | str) -> DataFrame:
    """The rows dealt by ranges of an order, with the number of the range (_part). Equal keys share a range. Stored, as the bounds are drawn from a sample and must not change between readings."""
    return stored(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranged")


def placed(df: DataFrame, order: Sequence[Column | str], rank: str = "rank", sums: dict[str, str] | None = None) -> DataFrame:
    """The rows with their place from 1 in a total order, and running sums (name -> column), the row itself included."""
    x = ranged(df, *order)
    sums = sums or {}
    here = Window.partitionBy("_part").orderBy(*order)
    upto = here.rowsBetween(Window.unboundedPreceding, 0)
    whole = x.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(f"_s_{k}") for k, c in sums.items()])
    earlier = Window.orderBy("_part").rowsBetween(*BEFORE)  # a row a range
    start = whole.select("_part", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"_b{c}") for c in whole.columns if c != "_part"])
    x = x.withColumns({rank: F.row_number().over(here).cast("long"), **{k: F.sum(c).over(upto) for k, c in sums.items()}}).join(F.broadcast(start), "_part")
    return x.select(*df.columns, (F.col(rank) + F.col("_b_n")).alias(rank), *[(F.col(k) + F.col(f"_b_s_{k}")).alias(k) for k in sums])
