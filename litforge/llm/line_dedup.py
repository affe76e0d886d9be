"""Operator 8: repeated passages by overlapping windows of three lines.

A line is a run of text up to a line break, to a sentence's end (. ! ? before white space) or to a cut by content within a longer sentence, so that passages within a paragraph are seen
as well, and those that begin and end within a sentence or have no sentences: any 50 words hold three whole lines wherever they stand. With breaks_only, lines end at line breaks alone.
Every three lines in a row make a window with a 96-bit hash, however few words they have. The first window of equal ones, by (doc_id, line), stays; lines that later ones cover are removed,
and overlapping covers merge. min_words leaves windows of fewer words uncompared; by default none are.

Texts are hashed once and their windows stored. These are counted by the first 64 bits of their hash, the narrowest rows that tell which can be repeated; only those find their places, by joins that Spark may split where a passage is very common.
Cases: null, empty and one- or two-line texts stay as they are; null ids are not compared. Rows may share an id: a place is (doc_id, line), so a window that two such rows have at the same
line is at one place and stays in both, while at another line it is later and goes; a cover holds for the rows of an id that have its window there. A text that loses nothing stays
the same to the byte. Columns other than the text pass through unchanged, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from litforge.llm.common import materialise, mix64, slices, small_batches, utf8_of
from litforge.llm.shingles import sentence_units, unit_hashes

LINES = 3


def window_hashes(data: np.ndarray, offsets: np.ndarray, lines: int, min_words: int, breaks_only: bool) -> tuple[np.ndarray, ...]:
    """(text, first line, 64 bits, 32 bits more) of each window of a batch, then the lines' starts and the n+1 bounds of the texts."""
    start, end, words, bounds = sentence_units(data, offsets, breaks_only=breaks_only)
    n = len(start) - lines + 1
    if n < 1:
        return (*(np.zeros(0, t) for t in (np.int64, np.int32, np.int64, np.int32)), start, bounds)
    a, b = unit_hashes(data, start, end)
    total = np.zeros(n, np.int64)
    x, y = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    for j in range(lines):
        total += words[j : n + j]
        x, y = mix64(x * np.uint64(31) + a[j : n + j]), mix64(y * np.uint64(37) + b[j : n + j])
    at = np.arange(n)
    owner = np.searchsorted(bounds, at, "right") - 1
    at = np.flatnonzero((at + lines <= bounds[owner + 1]) & (total >= min_words))
    owner = owner[at]
    return owner, (at - bounds[owner]).astype(np.int32), x[at].view(np.int64), (y[at] >> np.uint64(32)).astype(np.uint32).view(np.int32), start, bounds


def windows(docs: DataFrame, lines: int, min_words: int, breaks_only: bool) -> DataFrame:
    """(doc_id, line, ha, hb): each window by its first line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            owner, line, ha, hb, _, _ = window_hashes(*utf8_of(part.column("text")), lines, min_words, breaks_only)
            if len(owner):
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(owner)), *map(pa.array, (line, ha, hb))], ["doc_id", "line", "ha", "hb"])

    return docs.filter("doc_id is not null").mapInArrow(run, "doc_id long, line int, ha long, hb int")


def without(column: pa.Array, data: np.ndarray, offsets: np.ndarray, start: np.ndarray, bounds: np.ndarray, gone: np.ndarray) -> pa.Array:
    """The texts without the bytes from the start of each line that is gone to the next line or the text's end."""
    if not gone.any():
        return column
    end = np.r_[start[1:], 0]
    full = np.diff(bounds) > 0
    end[bounds[1:][full] - 1] = offsets[1:][full]
    edge = np.zeros(len(data) + 1, np.int8)
    np.add.at(edge, start[gone], 1)
    np.add.at(edge, end[gone], -1)
    keep = np.cumsum(edge[:-1], dtype=np.int8) == 0
    places = np.r_[0, np.cumsum(keep)][offsets].astype(np.int32)
    valid = pa.py_buffer(np.packbits(column.is_valid().to_numpy(zero_copy_only=False), bitorder="little")) if column.null_count else None
    return pa.StringArray.from_buffers(len(column), pa.py_buffer(places), pa.py_buffer(data[keep]), valid)


def remove_repeats(docs: DataFrame, lines: int = LINES, min_words: int = 0, id_column: str = "doc_id", text_column: str = "text", breaks_only: bool = False) -> DataFrame:
    """All columns of docs with the text cleaned, and n_lines, n_removed. docs is read more than once, so it should be a stored table."""
    small_batches(docs.sparkSession)
    rows = docs.select(docs[id_column].cast("long").alias("doc_id"), docs[text_column].cast("string").alias("text"))
    # hashed once; the others are stored, so that Spark knows the sizes of both sides and may split what a common window puts into one task
    seen = materialise(windows(rows, lines, min_words, breaks_only), "windows")
    again = materialise(seen.groupBy("ha").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"), "repeated-hashes")
    # the windows that come again, and those whose first 64 bits alone do
    places = materialise(seen.join(again, "ha", "left_semi"), "repeated-windows")
    first = materialise(places.groupBy("ha", "hb").agg(F.min(F.struct("doc_id", "line")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"), "first-windows")
    later = places.join(first, ["ha", "hb"]).filter((F.col("doc_id") != F.col("first.doc_id")) | (F.col("line") != F.col("first.line")))
    # bounded by the windows of one document
    covers = later.groupBy(F.col("doc_id").alias("_cover_id")).agg(F.collect_set(F.struct("line", "ha")).alias("_cover"))
    joined = docs.join(covers, docs[id_column].cast("long") == F.col("_cover_id"), "left").drop("_cover_id")
    names = docs.columns
    plain = joined.toDF(*[f"c{i}" for i in range(len(names))], "cover")
    text = f"c{names.index(text_column)}"
    schema = plain.drop("cover").withColumn(text, F.col(text).cast("string")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text):
            column, cover = part.column(text), part.column("cover")
            data, offsets = utf8_of(column)
            start, _, _, bounds = sentence_units(data, offsets, breaks_only=breaks_only)
            covered = np.flatnonzero(cover.is_valid().to_numpy(zero_copy_only=False))
            gone = np.zeros(len(start), bool)
            if len(covered):
                owner, line, ha, *_ = window_hashes(*utf8_of(column.take(pa.array(covered))), lines, min_words, breaks_only)
                some = cover.take(pa.array(covered))
                lines_, hashes = (x.to_numpy(zero_copy_only=False) for x in some.flatten().flatten())
                of = np.repeat(np.arange(len(covered)), some.value_lengths().to_numpy(zero_copy_only=False))
                own, wanted = owner << 32 | line, of << 32 | lines_.astype(np.int64)
                at = np.searchsorted(own, wanted)
                fit = at < len(own)
                fit[fit] = (own[at[fit]] == wanted[fit]) & (ha[at[fit]] == hashes[fit])
                first = bounds[:-1][covered][of[fit]] + lines_[fit]
                for j in range(lines):
                    gone[first + j] = True
            removed = np.diff(np.r_[0, np.cumsum(gone)][bounds])
            columns = [without(column, data, offsets, start, bounds, gone) if c == text else part.column(c) for c in part.schema.names[:-1]]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.diff(bounds)), pa.array(removed)], [*part.schema.names[:-1], "n_lines", "n_removed"])

    out = T.StructType([*schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_removed", T.LongType())])
    return plain.withColumn(text, F.col(text).cast("string")).mapInArrow(run, out).toDF(*names, "n_lines", "n_removed")
