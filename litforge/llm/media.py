"""Operator 6: media columns in Ogg.

A payload is stored as unsigned 8-bit mono samples in frames of 576, one packet a frame, in one logical stream, and a caption stream is multiplexed beside it. Granule positions
count samples. The reader checks every page's checksum, splits pages into logical streams by serial number, joins packets by their lacing values across
pages, and derives each packet's time from the granule positions. Serial numbers and captions come from the length alone, so equal texts give equal bytes.

The column is written as a table, and checksums and features come from the table read back.

Cases: null and empty texts give one frame of bytes 255; no text is cut; repeated rows give equal rows; null ids pass through; an empty table gives no rows; columns other than doc_id and text are
not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from litforge.llm.common import materialise, slices, small_batches, texts_of

FRAME = 576
RATE = 8000
AUDIO, CAPTION = 1, 2  # serial numbers
#: A head of this stream's own kind: name, version, rate, bits, channels, frame.
HEAD = struct.pack("<8sHIHHI", b"PCMU8\0\0\0", 1, RATE, 8, 1, FRAME)
CAPTION_HEAD = b"CAPTION\0"
CONTINUED, FIRST, LAST = 1, 2, 4
_mirror = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def checksum(*parts: bytes) -> int:
    """CRC-32 as Ogg has it: generator 0x04c11db7, high bit first, from 0 and without a final inversion. It is zlib's on mirrored bits."""
    crc = 0xFFFFFFFF
    for p in parts:
        crc = zlib.crc32(p.translate(_mirror), crc)
    crc ^= 0xFFFFFFFF
    return int.from_bytes(crc.to_bytes(4, "little").translate(_mirror), "big")


def page(serial: int, number: int, granule: int, flags: int, lacing: bytes, body: bytes) -> bytes:
    head = struct.pack("<4sBBqII", b"OggS", 0, flags, granule, serial, number)
    tail = bytes([len(lacing)]) + lacing
    return head + struct.pack("<I", checksum(head, b"\0\0\0\0", tail, body)) + tail + body


def laced(size: int) -> bytes:
    return b"\xff" * (size // 255) + bytes([size % 255])


def paged(serial: int, packets: list[tuple[bytes, int]], number: int = 0, last: bool = True) -> list[tuple[int, bytes]]:
    """(granule, page) of some packets with their end granules; packets may go over page ends. A page that ends no packet has granule -1."""
    out, lacing, body, flags, granule = [], bytearray(), bytearray(), FIRST if number == 0 else 0, -1
    for k, (data, end) in enumerate(packets):
        values, at = laced(len(data)), 0
        for i, v in enumerate(values):
            lacing.append(v)
            body += data[at : at + v]
            at += v
            done = i == len(values) - 1
            granule = end if done else granule
            if len(lacing) == 255 or number == 0 and done or done and k == len(packets) - 1:
                final = LAST if last and done and k == len(packets) - 1 else 0
                out.append((granule, page(serial, number, granule, flags | final, bytes(lacing), bytes(body))))
                number, granule, flags = number + 1, -1, 0 if done else CONTINUED
                lacing.clear()
                body.clear()
    return out


def audio_pages(payload: bytes) -> list[tuple[int, bytes]]:
    """Pages of whole frames, 85 of them at most, as paged() would give for frames of 576 bytes."""
    out = paged(AUDIO, [(HEAD, 0)], last=False)
    lace = laced(FRAME)
    step = 255 // len(lace) * FRAME
    for number, at in enumerate(range(0, len(payload), step), 1):
        body = payload[at : at + step]
        end = at + len(body)
        out.append((end, page(AUDIO, number, end, LAST if end == len(payload) else 0, lace * (len(body) // FRAME), body)))
    return out


def store(payload: bytes, caption: bytes) -> bytes:
    """An Ogg file; pages of both streams in order of time, stream heads first."""
    audio, words = audio_pages(payload), paged(CAPTION, [(CAPTION_HEAD, 0), (caption, len(payload))])
    return b"".join([audio[0][1], words[0][1], *(p for _, p in sorted(audio[1:] + words[1:], key=lambda x: x[0]))])


class Stream:
    """What was read of one logical stream: packets and the granule after each (-1: not told)."""

    def __init__(self):
        self.packets: list[bytes] = []
        self.granules: list[int] = []
        self.part: list[bytes] = []
        self.number, self.ended = 0, False


def streams(data: bytes) -> dict[int, Stream]:
    """Logical streams of an Ogg file, each packet whole. Wrong checksums, lost pages and loose ends raise ValueError."""
    found: dict[int, Stream] = {}
    at, view = 0, memoryview(data)
    while at < len(data):
        mark, version, flags, granule, serial, number, crc, count = struct.unpack_from("<4sBBqIIIB", data, at)
        if mark != b"OggS" or version:
            raise ValueError(f"no page at byte {at}")
        lacing = data[at + 27 : at + 27 + count]
        begin = at + 27 + count
        end = begin + sum(lacing)
        if checksum(data[at : at + 22], b"\0\0\0\0", data[at + 26 : end]) != crc:
            raise ValueError(f"the page at byte {at} has another checksum")
        if bool(flags & FIRST) == (serial in found):
            raise ValueError(f"stream {serial} begins twice or not at all")
        s = found.setdefault(serial, Stream())
        if number != s.number or s.ended or bool(flags & CONTINUED) != bool(s.part):
            raise ValueError(f"page {number} of stream {serial} doesn't follow")
        closing = np.flatnonzero(np.frombuffer(lacing, np.uint8) < 255)
        ends = np.cumsum(np.frombuffer(lacing, np.uint8), dtype=np.int64)
        pos = 0
        for stop in ends[closing].tolist():
            s.packets.append(b"".join([*s.part, view[begin + pos : begin + stop]]))
            s.part = []
            s.granules.append(-1)
            pos = stop
        if len(closing):
            s.granules[-1] = granule
        if begin + pos < end or count and lacing[-1] == 255:
            s.part.append(bytes(view[begin + pos : end]))
        s.number, s.ended, at = number + 1, bool(flags & LAST), end
    if any(s.part or not s.ended for s in found.values()):
        raise ValueError("a stream has no end")
    return found


def times(granules: list[int], packets: list[bytes]) -> list[float]:
    """Seconds at which each audio packet ends: granules count samples, those not told follow from the next one told, backwards."""
    out, end = [], 0
    for g, p in zip(reversed(granules), reversed(packets), strict=True):
        end = g if g >= 0 else end
        out.append(end / RATE)
        end -= len(p)
    return out[::-1]


def restored(data: bytes) -> tuple[bytes, str]:
    """The payload read back, and its features: frames, seconds, mean, deviation, sign changes around the middle."""
    s = streams(data)[AUDIO]
    if s.packets[0] != HEAD:
        raise ValueError("another kind of audio")
    frames, clock = s.packets[1:], times(s.granules[1:], s.packets[1:])
    payload = b"".join(frames)
    if round(clock[-1] * RATE) != len(payload):
        raise ValueError("granule positions and samples disagree")
    x = np.frombuffer(payload, np.uint8)
    total, square = int(x.sum(dtype=np.int64)), int(np.dot(x.astype(np.float64), x))
    mean = total / len(x)
    crossings = int(np.count_nonzero(np.diff(x >= 128)))
    return payload, f"frames={len(frames)};seconds={clock[-1]:.4f};mean={mean:.4f};deviation={max(0.0, square / len(x) - mean * mean) ** 0.5:.4f};crossings={crossings}"


def media_table(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): every text as an Ogg file in a column."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 4 << 20):
            sizes, media = [], []
            for text in texts_of(part.column("text")):
                raw = text.encode()
                size = max(FRAME, -(-len(raw) // FRAME) * FRAME)
                sizes.append(len(raw))
                media.append(store(raw + b"\xff" * (size - len(raw)), f"{len(raw)} bytes".encode()))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    picked = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return picked.mapInArrow(run, "doc_id long, n_bytes long, media binary")


def described(media: DataFrame, keep_media: bool = False) -> DataFrame:
    """Checksums and features of a media column, all from its bytes; the bytes come along if wanted."""
    small_batches(media.sparkSession)
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "media", 4 << 20):
            rows = []
            for cell in part.column("media"):
                data = cell.as_py()
                payload, feature = restored(data)
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), feature))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            kept = [part.column("media")] * keep_media
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_bytes"), *columns, *kept], names + ["media"] * keep_media)

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, schema + (", media binary" if keep_media else ""))


def media_columns(docs: DataFrame, keep_media: bool = False) -> DataFrame:
    """Every text stored as a media column, which is read again and described."""
    return described(materialise(media_table(docs), "media"), keep_media)
