"""Sorted lists of a key in chunks of a bounded length, for keys that may hold any part of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from litforge.operators.running import ranged
from litforge.scratch import stored

CHUNK = 10_000


def place_within(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "place") -> DataFrame:
    """The rows with their place from 0 within their keys. A key that fills many ranges of the order is placed by all of their tasks. A null key is a key.

    Ranges follow each other, so only the first key of a range may have begun in an earlier one, and only such keys carry counts on.
    """
    x = ranged(df, *keys, *order)
    counts = stored(x.groupBy("_part", *keys).agg(F.count(F.lit(1)).alias("_n")), "key-counts")
    heads = counts.groupBy("_part").agg(F.min(F.struct(*keys)).alias("_head")).select("_head").distinct()  # at most a row a range
    several = counts.join(F.broadcast(heads), F.struct(*keys).eqNullSafe(F.col("_head")))
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    carried = several.select(F.col("_part").alias("_p"), *[F.col(k).alias(f"_k_{k}") for k in keys], before.alias("_before")).filter("_before is not null")
    same = [F.col("_part") == F.col("_p"), *[F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]]
    here = x.withColumn(name, F.row_number().over(Window.partitionBy("_part", *keys).orderBy(*order)).cast("long") - 1)
    placed = here.join(F.broadcast(carried), same, "left")  # as few: each range has one first key, and what spans it is there
    return placed.withColumn(name, F.col(name) + F.coalesce("_before", F.lit(0))).select(*df.columns, name)


def chunked(df: DataFrame, keys: Sequence[str], item: str, size: int = CHUNK) -> DataFrame:
    """(keys, chunk from 0, items, n): the items of a key in ascending order, ``size`` in each chunk but the last, n in this one.

    Joined in the order of their chunks, the arrays are the sorted list of the key, repeats included; null items are left out, as lists leave them out. No row holds more than ``size`` items.
    """
    if size < 1:
        raise ValueError("a chunk holds at least one item")
    rows = df.select(*keys, item).filter(F.col(item).isNotNull())
    at = place_within(rows, keys, [item], "_place")
    chunk = F.floor(F.col("_place") / size).cast("long").alias("chunk")
    return at.groupBy(*keys, chunk).agg(F.array_sort(F.collect_list(item)).alias("items"), F.count(F.lit(1)).alias("n"))


def list_sizes(chunks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, n, n_chunks) of a table of chunks."""
    return chunks.groupBy(*keys).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_chunks"))
