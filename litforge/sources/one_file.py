"""One text file written by many tasks: every line knows its place in bytes, so tasks write their lines where they belong and the commit only checks and names the file."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from litforge.operators.running import placed
from litforge.scratch import stored


@dataclass
class Written(WriterCommitMessage):
    bytes: int


class PlacedLines(DataSourceArrowWriter):
    """Rows (at long, value string). A task that is run again writes the same bytes at the same places. The name is given at the end, by a link that fails if the file is there."""

    def __init__(self, path: str, total: int):
        self.path, self.total, self.part = path, total, f"{path}.{uuid.uuid4().hex[:12]}.part"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        written, here = 0, 0
        with os.fdopen(os.open(self.part, os.O_WRONLY | os.O_CREAT, 0o644), "wb") as f:
            for batch in iterator:
                for at, value in zip(batch.column("at").to_pylist(), batch.column("value").to_pylist(), strict=True):
                    line = value.encode() + b"\n"
                    if at != here:
                        f.seek(at)
                    f.write(line)
                    here = at + len(line)
                    written += len(line)
            f.flush()
            os.fsync(f.fileno())
        return Written(written)

    def commit(self, messages: Sequence[Written | None]) -> None:
        found = sum(m.bytes for m in messages if m)
        if found != self.total or (os.path.getsize(self.part) if os.path.exists(self.part) else 0) != self.total:
            self.abort(messages)
            raise ValueError(f"{found} of {self.total} bytes were written")
        if not self.total:
            open(self.part, "ab").close()
        try:
            os.link(self.part, self.path)
        finally:
            os.unlink(self.part)

    def abort(self, messages: Sequence[Written | None]) -> None:
        if os.path.exists(self.part):
            os.unlink(self.part)


class OneFile(DataSource):
    """``df.write.format("one_file")`` with the options file and bytes."""

    @classmethod
    def name(cls) -> str:
        return "one_file"

    def writer(self, schema, overwrite: bool) -> PlacedLines:
        return PlacedLines(self.options["file"], int(self.options["bytes"]))


def local_path(path: str) -> str:
    """A path of the file system; tasks write at places within a file, which object stores don't allow."""
    url = urlparse(path)
    if url.scheme not in ("", "file"):
        raise ValueError(f"one file is written by many tasks only on a shared file system, not on {url.scheme}")
    return unquote(url.path) if url.scheme else path


def write_lines(df: DataFrame, path: str, *order: Column | str, value: str = "value") -> None:
    """The lines of a table in a total order as one file, which must not exist, on a file system that driver and executors share. Null lines are empty ones.

    Places are running sums of bytes by ranges of the order, so no task sees more than its range. Until the commit the file has another name; a job that fails removes it.
    """
    target = local_path(path)
    if os.path.exists(target):
        raise FileExistsError(target)
    os.makedirs(os.path.dirname(target) or ".", exist_ok=True)
    lines = df.withColumn(value, F.coalesce(F.col(value), F.lit(""))).withColumn("_bytes", F.octet_length(value).cast("long") + 1)
    x = placed(lines, order, "_rank", {"_end": "_bytes"}).select((F.col("_end") - F.col("_bytes")).alias("at"), F.col(value).alias("value"), "_bytes")
    x = stored(x, "placed-lines")
    total = x.agg(F.coalesce(F.sum("_bytes"), F.lit(0)).alias("n")).first()["n"]  # one number
    df.sparkSession.dataSource.register(OneFile)
    x.select("at", "value").write.format("one_file").mode("append").option("file", target).option("bytes", str(total)).save()
