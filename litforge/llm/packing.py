"""Operator 5: best-fit packing of documents into sequences of a fixed length, planned on the histogram of lengths.

1. Documents are encoded once; only those longer than a sequence are cut. Each piece gets its rank among the pieces of its length, counted within its task.
2. The histogram, a row for each length at most, goes to the driver. There best-fit decreasing runs over counts: a length's pieces go to the fullest
   sequences that still have room, many sequences at once. The plan is a list of runs for each length: ranks from ... to, first sequence, pieces a sequence, offset.
3. Each piece finds its run by length and rank. Ranks become global by prefix sums over (task, length), so no length is ever gathered in one task.

The plan has at most as many rows as there are lengths; it is broadcast while its runs number under PLAN_RUNS, beyond that it is joined by shuffle.
Cases: null and empty texts are one end id; an empty table gives no rows; repeated rows are packed as often as they come.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from litforge.llm.common import materialise, slices, small_batches, texts_of
from litforge.llm.encoder import Encoder, encoder
from litforge.llm.token_files import with_end

CAPACITY = 2048
PLAN_RUNS = 100_000


def pieces(docs: DataFrame, path: str, kind: str = "word", capacity: int = CAPACITY) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32, task, place): place is the rank among the task's pieces of that length."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, task, seen = encoder(path, kind, Encoder), TaskContext.get().partitionId(), defaultdict(int)
        for part in slices(batches, "text"):
            tokens, bounds = with_end(*enc.encode(texts_of(part.column("text"))))
            wide, sizes = tokens.astype("<u4"), np.diff(bounds)
            count = (sizes + capacity - 1) // capacity
            doc = np.repeat(np.arange(len(sizes)), count)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
            start = piece * capacity
            length = np.minimum(capacity, sizes[doc] - start)
            at, memory = bounds[:-1][doc] + start, memoryview(wide).cast("B")
            crcs = [zlib.crc32(memory[4 * a : 4 * (a + n)]) for a, n in zip(at.tolist(), length.tolist(), strict=True)]
            place = np.empty(len(doc), np.int64)
            for i, n in enumerate(length.tolist()):
                place[i] = seen[n]
                seen[n] += 1
            ids = part.column("doc_id").take(pa.array(doc))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crcs, pa.int64()), pa.array(np.full(len(doc), task), pa.int32()), pa.array(place)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "task", "place"],
            )

    picked = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return picked.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, task int, place long")


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts. Runs (length, first rank, ranks, first sequence, pieces a sequence, offset).

    Open sequences are held by room left, as intervals of sequence numbers; a run fills the fullest that a length fits in.
    """
    room: dict[int, list[tuple[int, int]]] = defaultdict(list)
    rooms: list[int] = []  # ascending, those that have sequences
    runs, sequences = [], 0

    def put(left: int, first: int, count: int) -> None:
        if left and count:
            if not room[left]:
                bisect.insort(rooms, left)
            room[left].append((first, count))

    for length in sorted(histogram, reverse=True):
        rank, rest = 0, histogram[length]
        while rest:
            i = bisect.bisect_left(rooms, length)
            if i < len(rooms):
                left = rooms[i]
                first, count = room[left].pop()
                if not room[left]:
                    rooms.pop(i)
            else:
                left, first = capacity, sequences
                count = -(-rest // (capacity // length))
                sequences += count
            each = min(left // length, rest)
            full = min(count, rest // each)
            runs.append((length, rank, full * each, first, each, capacity - left))
            rank, rest = rank + full * each, rest - full * each
            put(left - each * length, first, full)
            put(left, first + full, count - full) if left < capacity or not rest else None
            if left == capacity and rest and count > full:  # the last new sequence holds fewer
                runs.append((length, rank, rest, first + full, rest, 0))
                put(capacity - rest * length, first + full, 1)
                rest = 0
    return runs


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """A place (sequence_id, offset) for each row of pieces(); read more than once, so it must be a written table."""
    spark = cut.sparkSession
    tally = cut.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = tally.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # capacity rows at most
    grouped = defaultdict(list)
    for length, *run in plan(histogram, capacity):
        grouped[length].append(tuple(run))
    schema = "length long, runs array<struct<rank: long, ranks: long, first: long, each: long, offset: long>>"
    planned = spark.createDataFrame(list(grouped.items()), schema)
    if sum(map(len, grouped.values())) < PLAN_RUNS:
        planned = F.broadcast(planned)
    ranked = cut.join(bases, ["task", "length"]).withColumn("k", F.col("base") + F.col("place"))
    found = ranked.join(planned, "length").withColumn("run", F.expr("filter(runs, r -> k >= r.rank and k < r.rank + r.ranks)[0]"))
    within = F.col("k") - F.col("run.rank")
    return found.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("run.first") + F.expr("(k - run.rank) div run.each")).alias("sequence_id"),
        (F.col("run.offset") + within % F.col("run.each") * F.col("length")).alias("offset"),
    )


def packed(docs: DataFrame, path: str, kind: str = "word", capacity: int = CAPACITY) -> DataFrame:
    """Encode, cut and pack all documents."""
    return pack(materialise(pieces(docs, path, kind, capacity), "pieces"), capacity)
