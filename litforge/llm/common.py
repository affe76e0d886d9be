"""Helpers that the training-data operators share: table access, the shared folder, Arrow batches, ragged arrays."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_BYTES = 8 << 20
BATCH_ROWS = 2000


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of a table; nothing else reaches the scan."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch may hold, in rows and in bytes, before Python sees it."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


_own: dict[str, str] = {}


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which driver and executors share; only a local session, as in tests, may do without one and is given a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not current.isDefined() and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = current.get() if current.isDefined() else _own.get("folder") or _own.setdefault("folder", "file://" + tempfile.mkdtemp(prefix="litforge-"))  # a core setting, which a session can't change
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex[:12]}"


def materialise(df: DataFrame, purpose: str) -> DataFrame:
    """Write a table to the shared folder and read it again: lineage ends there and a lost executor loses nothing."""
    spark = df.sparkSession
    path = shared_dir(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The Arrow file system and path of a folder URI; a bare path is a local one."""
    if "://" not in uri and uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri[5:]
    if "://" not in uri:
        return pafs.LocalFileSystem(), uri
    return pafs.FileSystem.from_uri(uri)


@contextmanager
def committed(fs: pafs.FileSystem, path: str):
    """A binary stream that becomes ``path`` only when it is complete, so a retried or speculative task never leaves half a file."""
    part = f"{path}.{uuid.uuid4().hex}.part"
    with fs.open_output_stream(part, compression=None) as out:
        yield out
    fs.move(part, path)


def open_bytes(fs: pafs.FileSystem, path: str) -> pa.NativeFile | pa.MemoryMappedFile:
    """Memory-mapped where the file is local, a random-access stream elsewhere."""
    if isinstance(fs, pafs.LocalFileSystem) and os.path.getsize(path):
        return pa.memory_map(path, "r")
    return fs.open_input_file(path)


def slices(batches: Iterator[pa.RecordBatch], column: str, chars: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Row ranges whose texts hold about ``chars`` bytes, one row at least; no text is cut."""
    for batch in batches:
        sizes = string_bytes(batch.column(column))
        group = np.maximum.accumulate(np.cumsum(sizes) // chars) if len(sizes) else sizes
        cuts = np.flatnonzero(np.diff(group)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            if hi > lo:
                yield batch.slice(lo, hi - lo)


def string_bytes(column: pa.Array) -> np.ndarray:
    """UTF-8 length of each value; null counts 0."""
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def texts_of(column: pa.Array) -> list[str]:
    """Python strings; null becomes the empty text."""
    return [x or "" for x in column.to_pylist()]


def utf8_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column as one array, and the n+1 offsets of its values; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    if pa.types.is_large_string(column.type):
        column = column.cast(pa.string())
    raw = column.buffers()
    offsets = np.frombuffer(raw[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(raw[2], np.uint8)[offsets[0] : offsets[-1]] if raw[2] is not None and len(column) else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indexes starts[0], starts[0]+1, ... for every run, one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    out = np.ones(total, np.int64)
    full = lengths > 0
    s, first = starts[full], (ends - lengths)[full]
    out[first] = s
    out[first[1:]] -= s[:-1] + lengths[full][:-1] - 1
    return np.cumsum(out)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift and multiply), vectorised."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_ODD = 0x9E3779B97F4A7C15
_INVERSE = pow(_ODD, -1, 1 << 64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd constant modulo 2**64 and of its inverse."""
    if len(_powers[0]) < n:
        size = 1 << int(n - 1).bit_length()
        for k, base in enumerate((_ODD, _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each values[start:end], equal for equal contents wherever they lie; values are mixed 64-bit codes."""
    forth, back = powers(len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * forth[: len(values)], out=total[1:])
    return mix64((total[ends] - total[starts]) * back[starts] + (ends - starts).astype(np.uint64))


def salted(column: str, groups: int) -> F.Column:
    """A number from 0 to groups-1 that spreads the rows of a hot key."""
    return F.pmod(F.xxhash64(F.col(column)), F.lit(groups)).cast("int")
