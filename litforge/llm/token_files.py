"""Operator 3: token ids in flat binary files.

Format of one shard: ``shard-NNNNN.bin`` holds little-endian unsigned integers, document after document, of 16 bits where the vocabulary fits and of 32 bits otherwise, as the manifest says;
``shard-NNNNN.idx`` holds two little-endian 64-bit arrays, the ids of the documents (n) and their offsets in ids (n+1). Documents ascend by id within
a shard and from shard to shard. The base of a shard, that is the ids in all shards before it, is the prefix sum over the manifest.

Cases: null text counts as empty and holds only the end id; null doc_ids come first and read back as null; repeated rows are written as often as they come, equal ids in order of
their text; texts of any length are written whole; other columns are not read, whatever their names; an empty table gives no shards and no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from litforge.llm.common import BATCH_ROWS, committed, filesystem, materialise, open_bytes, shared_dir, slices, small_batches, texts_of
from litforge.llm.encoder import Encoder, encoder

END = 0
NULL_ID = -(1 << 63)  # stands for a null doc_id in an index


def with_end(ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same documents with the end id behind each."""
    n = len(bounds) - 1
    out = np.full(len(ids) + n, END, ids.dtype)
    out[np.arange(len(ids)) + np.repeat(np.arange(n), np.diff(bounds))] = ids
    return out, bounds + np.arange(n + 1)


def write_token_files(docs: DataFrame, folder: str, path: str, kind: str = "byte", id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Encode, end and write all documents in ascending order of id; the manifest (shard, docs, tokens, file, width, base) is returned."""
    spark = docs.sparkSession
    small_batches(spark)
    picked = docs.select(docs[id_column].cast("long").alias("doc_id"), F.coalesce(docs[text_column].cast("string"), F.lit("")).alias("text"))
    ordered = picked.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, enc = TaskContext.get().partitionId(), encoder(path, kind, Encoder)
        fs, root = filesystem(folder)
        name = f"shard-{shard:05d}"
        ids, offsets, total = [], [np.zeros(1, np.int64)], 0
        first = next(parts := slices(batches, "text"), None)
        if first is None:
            return
        fs.create_dir(root, recursive=True)
        with committed(fs, f"{root}/{name}.bin") as out:
            while first is not None:
                tokens, bounds = with_end(*enc.encode(texts_of(first.column("text"))))
                out.write(tokens.astype(f"<u{enc.width().itemsize}").tobytes())
                ids.append(first.column("doc_id").fill_null(NULL_ID).to_numpy())
                offsets.append(bounds[1:] + total)
                total += int(bounds[-1])
                first = next(parts, None)
        ids = np.concatenate(ids)
        with committed(fs, f"{root}/{name}.idx") as out:
            out.write(ids.astype("<i8").tobytes())
            out.write(np.concatenate(offsets).astype("<i8").tobytes())
        yield pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([len(ids)]), pa.array([total]), pa.array([name]), pa.array([enc.width().itemsize], pa.int32())], ["shard", "docs", "tokens", "file", "width"])

    manifest = materialise(ordered.mapInArrow(run, "shard long, docs long, tokens long, file string, width int"), "token-manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row a shard
    return manifest.withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0)))


def read_token_files(manifest: DataFrame, folder: str, digest_only: bool = True) -> DataFrame:
    """Each document from the files: doc_id, start, n_tokens, ids_crc32, and the ids unless digest_only. Shards are mapped, not loaded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)
        for batch in batches:
            for row in batch.to_pylist():
                n, width = row["docs"], row["width"]
                with open_bytes(fs, f"{root}/{row['file']}.idx") as index, open_bytes(fs, f"{root}/{row['file']}.bin") as f:
                    for lo in range(0, n, BATCH_ROWS):
                        hi = min(n, lo + BATCH_ROWS)
                        index.seek(8 * lo)
                        ids = np.frombuffer(index.read_buffer(8 * (hi - lo)), "<i8")
                        index.seek(8 * (n + lo))
                        offsets = np.frombuffer(index.read_buffer(8 * (hi - lo + 1)), "<i8")
                        crcs, lists = [], []
                        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                            f.seek(width * a)
                            tokens = np.frombuffer(f.read_buffer(width * (b - a)), f"<u{width}").astype("<u4")
                            crcs.append(zlib.crc32(tokens.tobytes()))
                            lists.append(None if digest_only else tokens.astype(np.int32))
                        columns = [pa.array(ids, mask=ids == NULL_ID), pa.array(offsets[:-1] + row["base"]), pa.array(np.diff(offsets)), pa.array(crcs, pa.int64())]
                        names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                        if not digest_only:
                            columns.append(pa.array(lists, pa.list_(pa.int32())))
                            names.append("ids")
                        yield pa.RecordBatch.from_arrays(columns, names)

    shards = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ("" if digest_only else ", ids array<int>")
    return manifest.repartition(shards).mapInArrow(run, schema)


def token_table(docs: DataFrame, path: str, kind: str = "byte") -> DataFrame:
    """Write all documents to the shared folder and read them back."""
    folder = shared_dir(docs.sparkSession, "token-files")
    return read_token_files(write_token_files(docs, folder, path, kind), folder)
