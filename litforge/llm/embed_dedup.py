"""Operator 10: near-duplicate embeddings by random-hyperplane signs in several tables.

1. Equal vectors form a class; its smallest id stands for it, with the class size.
2. Each table gives a vector BITS signs of projections on random hyperplanes, one bucket. BITS grows with the logarithm of the number of vectors, so that a bucket holds TARGET vectors on average,
   TABLES with the recall wanted: a pair at the threshold meets in no table with a probability under MISS.
3. Buckets are found and cut into blocks of BLOCK vectors on narrow rows; then each vector goes, once for each pair of blocks, as the numbers of the source. A pair of blocks is compared by one
   matrix product, in double precision. A pair is counted in the first table where it meets, so no pair is ever written: only counts for each vector and a spanning forest of the block pair's
   links, one edge a vector, which suffices for components.
4. Links of a vector: other members of its class and the sizes of the classes linked to it.

Cases: null vectors, those of zeros, and those with null or non-finite components have no links; vectors of another length than the most common are compared with their like only;
null ids are kept and link with nothing; rows that share an id are separate vectors of one node, so an id joins the components of all its vectors; an empty table gives no rows; other columns are
not read, whatever their names; vectors may be as long as a row may.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from litforge.llm.common import materialise, small_batches
from litforge.llm.components import components

BLOCK = 512
TARGET = 256
MISS = 1e-6
SEED = 20240229


def shape(n: int, threshold: float) -> tuple[int, int]:
    """(bits, tables) for n vectors."""
    agree = 1 - math.acos(threshold) / math.pi
    bits = max(6, min(30, math.ceil(math.log2(max(n, 2) / TARGET))))
    return bits, math.ceil(math.log(MISS) / math.log1p(-(agree**bits)))


def units(x: np.ndarray) -> np.ndarray:
    """Vectors of length one, in double precision."""
    x = x.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def signatures(x: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """Bucket of each vector in each table, as 32-bit integers."""
    planes = np.random.default_rng([SEED, x.shape[1]]).standard_normal((x.shape[1], bits * tables))
    signs = (x @ planes > 0).reshape(len(x), tables, bits)
    return (signs * (1 << np.arange(bits))).sum(2).astype("<i4")


def signed(classes: DataFrame, bits: int, tables: int) -> DataFrame:
    """(row, id, size, dim, raw, buckets): the numbers of the source as bytes, and the bucket in each table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("vector")
            length = vectors.value_lengths().to_numpy(zero_copy_only=False)
            for dim in np.unique(length):
                at = pa.array(np.flatnonzero(length == dim))
                x = np.asarray(vectors.take(at).flatten()).reshape(len(at), dim)
                s = signatures(units(x), bits, tables)
                columns = [*(batch.column(c).take(at) for c in ("row", "id", "size")), pa.array(np.full(len(at), dim), pa.int32())]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(s) + 1) * tables, pa.int32()), pa.array(s.ravel()))
                yield pa.RecordBatch.from_arrays([*columns, pa.array([r.tobytes() for r in x], pa.binary()), lists], ["row", "id", "size", "dim", "raw", "buckets"])

    return classes.mapInArrow(run, "row long, id long, size long, dim int, raw binary, buckets array<int>")


def block_pairs(vectors: DataFrame) -> DataFrame:
    """Every vector once for each block pair it belongs to: (key, dim, t, bucket, lo, hi, mine, id, row, size, raw, packed)."""
    places = vectors.select("row", "dim", F.posexplode("buckets").alias("t", "bucket"))
    bucket = ["dim", "t", "bucket"]
    counts = places.groupBy(*bucket).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(*bucket, F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    placed = places.join(counts, bucket).withColumn("mine", F.pmod(F.xxhash64("row", F.lit(1)), F.col("blocks")).cast("int"))
    paired = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    paired = paired.select("row", *bucket, F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), "mine")
    return paired.join(vectors.drop("dim", "buckets"), "row").withColumn("key", F.xxhash64(*bucket, "lo", "hi"))


def roots(ids: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of ids, the smallest id that the links i-j between places reach from it."""
    order = np.argsort(ids, kind="stable")
    rank = np.empty(len(ids), np.int64)
    rank[order] = np.arange(len(ids))
    i, j = rank[i], rank[j]
    root = np.arange(len(ids))
    while True:
        was = root
        root = root.copy()
        np.minimum.at(root, was[i], was[j])  # a tree hangs on the smallest tree it has a link to
        np.minimum.at(root, was[j], was[i])
        while (root[root] != root).any():
            root = root[root]
        if (root == was).all():
            return ids[order][root[rank]]


def compare(pairs: DataFrame, threshold: float, kind: str, bits: int) -> DataFrame:
    """(row, id, near, least): for a vector and a block pair, the sizes of the classes linked here for the first time, and the smallest id that these links reach, its own included."""
    names = ["dim", "t", "bucket", "lo", "hi"]
    narrow = "<u2" if bits <= 16 else "<i4"

    def group(parts: list[pa.RecordBatch]) -> pa.RecordBatch | None:
        rows = pa.Table.from_batches(parts)
        n = rows.num_rows
        if n < 2:
            return None
        t, lo, hi = (rows.column(c)[0].as_py() for c in ("t", "lo", "hi"))
        ids, places, sizes, mine = (rows.column(c).to_numpy() for c in ("id", "row", "size", "mine"))
        x = units(np.frombuffer(b"".join(rows.column("raw").to_pylist()), kind).reshape(n, -1))
        left = np.flatnonzero(mine == lo)
        right = left if lo == hi else np.flatnonzero(mine == hi)
        i, j = np.nonzero(x[left] @ x[right].T >= threshold)
        i, j = left[i], right[j]
        fit = i < j if lo == hi else np.ones(len(i), bool)
        i, j = i[fit], j[fit]
        if len(i) and t:
            s = np.frombuffer(b"".join(rows.column("packed").to_pylist()), narrow).reshape(n, -1)[:, :t]
            first = np.concatenate([(s[i[at : at + BLOCK]] != s[j[at : at + BLOCK]]).all(1) for at in range(0, len(i), BLOCK)])
            i, j = i[first], j[first]
        if not len(i):
            return None
        near = np.bincount(i, sizes[j], n) + np.bincount(j, sizes[i], n)
        least = roots(ids, i, j)
        some = np.flatnonzero(near)
        return pa.RecordBatch.from_arrays([pa.array(places[some]), pa.array(ids[some]), pa.array(near[some].astype(np.int64)), pa.array(least[some])], ["row", "id", "near", "least"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        for batch in batches:
            keys = np.column_stack([batch.column(c).to_numpy() for c in names])
            cuts = (np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist()
            for lo, hi in zip([0, *cuts], [*cuts, len(keys)], strict=True):
                if hi > lo:
                    key = tuple(keys[lo])
                    if key != now:
                        if held and (found := group(held)):
                            yield found
                        held, now = [], key
                    held.append(batch.slice(lo, hi - lo))
        if held and (found := group(held)):
            yield found

    return pairs.repartition("key").sortWithinPartitions("key", *names).mapInArrow(run, "row long, id long, near long, least long")


def packed(vectors: DataFrame, bits: int) -> DataFrame:
    """The same with the buckets as bytes, two or four for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                s = np.asarray(batch.column("buckets").flatten()).reshape(batch.num_rows, -1).astype("<u2" if bits <= 16 else "<i4")
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], batch.column("buckets"), pa.array([r.tobytes() for r in s], pa.binary())], [*batch.schema.names, "packed"])

    return vectors.mapInArrow(run, "row long, id long, size long, dim int, raw binary, buckets array<int>, packed binary")


def near_vectors(table: DataFrame, threshold: float = 0.95, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """Per row: vec_id, n_links, component_id, kept. The table is read more than once, so it should be a stored one."""
    small_batches(table.sparkSession)
    narrow = table.schema[vector_column].dataType == T.ArrayType(T.FloatType(), table.schema[vector_column].dataType.containsNull) if isinstance(table.schema[vector_column].dataType, T.ArrayType) else False
    number, kind = ("float", "<f4") if narrow else ("double", "<f8")
    rows = table.select(table[id_column].cast("long").alias("vec_id"), table[vector_column].cast(f"array<{number}>").alias("vector"))
    sound = F.coalesce(F.expr("size(vector) > 0 and forall(vector, v -> v is not null and not isnan(v) and abs(v) < double('Infinity')) and exists(vector, v -> v <> 0)"), F.lit(False)) & F.col("vec_id").isNotNull()
    tagged = rows.withColumn("vector", F.when(sound, F.expr(f"transform(vector, v -> v + cast(0 as {number}))")))  # -0.0 becomes 0.0
    classes = tagged.filter("vector is not null").groupBy("vector").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("size"))
    classes = materialise(classes.withColumn("row", F.monotonically_increasing_id()), "vector-classes")
    n = classes.count()
    bits, tables = shape(n, threshold)
    vectors = materialise(packed(signed(classes.select("row", "id", "size", "vector"), bits, tables), bits), "signatures")
    found = materialise(compare(block_pairs(vectors), threshold, kind, bits), "near")
    near = found.groupBy("row").agg(F.sum("near").alias("near"))
    # an id with several rows joins the classes of all of them
    twice = materialise(tagged.filter("vector is not null").groupBy("vec_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("vec_id"), "repeated-ids")
    same = tagged.join(twice, "vec_id", "left_semi").join(classes, "vector").select(F.col("vec_id").alias("a"), F.col("id").alias("b"))
    groups = components(found.select(F.col("id").alias("a"), F.col("least").alias("b")).unionAll(same))
    heads = classes.join(near, "row", "left").join(groups, "id", "left")
    heads = heads.select(F.col("vector").alias("same"), F.coalesce("component", "id").alias("component"), (F.coalesce("near", F.lit(0)) + F.col("size") - 1).alias("links"))
    out = tagged.join(heads, F.col("vector") == F.col("same"), "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
