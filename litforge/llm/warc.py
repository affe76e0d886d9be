"""Operator 4: WARC archives with revisit records.

Headers (page_id, digest) are grouped by payload digest; the smallest page_id of equal payloads of MINIMUM bytes and more is the response, the others
become revisits that point to it. Then archives are written, one gzip member a record with fresh headers, and revisits carry no payload. The reader
goes through the members one by one, checks each response's digest, and gives the headers back.

Cases: null html is an empty payload; null urls leave WARC-Target-URI out; a repeated row of the smallest page_id is a response too; a null page_id is written
and read as null, is never referred to, and is a response unless a page with an id has its payload; an empty table gives no archives; payloads
may be as long as a row may; other columns are not read, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litforge.llm.common import BATCH_ROWS, committed, filesystem, materialise, shared_dir, small_batches

MINIMUM = 100
#: Fixed values of the WARC 1.1 standard.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
OUT = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def resolve(pages: DataFrame) -> DataFrame:
    """(page_id, html, url, digest, length, refers_to): refers_to is null for responses."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    rows = rows.withColumns({"digest": F.sha2(F.encode("html", "UTF-8"), 256), "length": F.octet_length("html").cast("long")})
    # payloads are only met by their headers; both tables are stored, so that Spark knows their sizes and may split a common payload
    heads = materialise(rows.filter(F.col("length") >= MINIMUM).select("page_id", "digest"), "headers")
    originals = materialise(heads.groupBy("digest").agg(F.min("page_id").alias("original"), F.count(F.lit(1)).alias("n")).filter("n > 1 and original is not null").drop("n"), "originals")
    again = heads.join(originals, "digest").filter(~F.col("page_id").eqNullSafe(F.col("original")))
    again = materialise(again.select(F.col("page_id").alias("same_id"), F.col("digest").alias("same"), F.col("original").alias("refers_to")).distinct(), "revisits")
    found = rows.join(again, F.col("page_id").eqNullSafe(F.col("same_id")) & (F.col("digest") == F.col("same")), "left")
    return found.select("page_id", "url", "html", "digest", "length", "refers_to")


def record(page_id: int | None, url: str | None, html: str, digest: str, refers_to: int | None, date: str) -> bytes:
    """One gzip member."""
    payload = html.encode()
    name = "" if page_id is None else str(page_id)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [VERSION, f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{name}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~' + chr(39))}")
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    else:
        head.append(f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(4, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def write_archives(resolved: DataFrame, folder: str, date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """One archive a task; returns (file, records)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)
        name, n = f"part-{TaskContext.get().partitionId():05d}.warc.gz", 0
        batch = next(batches, None)
        while batch is not None and not batch.num_rows:
            batch = next(batches, None)
        if batch is None:
            return
        fs.create_dir(root, recursive=True)
        with committed(fs, f"{root}/{name}") as out:
            while batch is not None:
                for row in batch.to_pylist():
                    out.write(record(row["page_id"], row["url"], row["html"], row["digest"], row["refers_to"], date))
                n += batch.num_rows
                batch = next(batches, None)
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n])], ["file", "records"])

    return resolved.mapInArrow(run, "file string, records long")


def members(stream) -> Iterator[bytes]:
    """The contents of a gzip file's members, one by one."""
    rest, unpack, out = b"", zlib.decompressobj(31), []
    while True:
        data = rest or stream.read(1 << 16)
        if not data:
            if out or unpack.unconsumed_tail:
                raise ValueError("the archive ends within a record")
            return
        out.append(unpack.decompress(data))
        rest = unpack.unused_data
        if unpack.eof:
            yield b"".join(out)
            unpack, out = zlib.decompressobj(31), []


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of a record."""
    head, _, rest = member.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError(f"no WARC record: {version[:40]}")
    headers = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    block = rest[: int(headers["content-length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    return headers, block


def page_of(urn: str | None) -> int | None:
    name = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(name) if name else None


def read_archives(files: DataFrame, folder: str, payloads: bool = False) -> DataFrame:
    """Each record: page_id, payload_bytes, payload_digest, record_type, refers_to, and for responses the payload if wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)
        schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())] + [("payload", pa.binary())] * payloads)
        for batch in batches:
            for name in batch.column("file").to_pylist():
                rows, held = [], 0
                with fs.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for member in members(stream):
                        headers, block = parse(member)
                        http, _, body = block.partition(b"\r\n\r\n")
                        size = int(http.lower().rpartition(b"content-length:")[2])
                        digest = headers["warc-payload-digest"].removeprefix("sha256:")
                        kind = headers["warc-type"]
                        if kind == "response" and (len(body) != size or hashlib.sha256(body).hexdigest() != digest):
                            raise ValueError(f"{headers['warc-record-id']}: the payload is not what its headers say")
                        row = {"page_id": page_of(headers["warc-record-id"]), "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": page_of(headers.get("warc-refers-to"))}
                        rows.append(row | ({"payload": body if kind == "response" else None} if payloads else {}))
                        held += len(body) * payloads
                        if len(rows) >= BATCH_ROWS or held > 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    n = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return files.repartition(n).mapInArrow(run, OUT + (", payload binary" if payloads else ""))


def archived(pages: DataFrame) -> DataFrame:
    """Write all pages to archives in the shared folder and read them back."""
    spark = pages.sparkSession
    small_batches(spark)
    folder = shared_dir(spark, "warc")
    return read_archives(materialise(write_archives(resolve(pages), folder), "warc-files"), folder)
