"""Operator 11: fill-in-middle by overlapping chunks.

Whether a unit (character, word or line) begins at a place follows from the two adjacent characters alone. So texts are cut into chunks that
share one character with the chunk before, and the beginnings in every chunk are counted side by side, without a look at any other chunk.
Prefix sums of these counts give the number of units of each text, and route the ranks of both cuts to the chunks that own them; only those
chunks are scanned again for the places. The pieces are then joined in the order of the form.

Cases: a null text counts as empty, and an empty one is plain; a null id is hashed as an empty one and passes through; texts may be of any
length, but the rearranged text is one row and so in one task; equal rows give equal rows, there are no ties; an empty table gives no rows;
other columns are not read, whatever their names. No row is dropped. Nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litforge.llm.common import slices, small_batches, utf8_of

CHUNK = 4096
MARKERS = ("<P>", "<S>", "<M>")
WHITE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])

#: Whether a unit begins at a byte, from it and the byte before. Words keep the white space behind them, lines their line break.
UNITS = {
    "char": lambda before, here: (here & 0xC0) != 0x80,
    "word": lambda before, here: WHITE[before] & ~WHITE[here],
    "line": lambda before, here: before == 0x0A,
}


class Chunks:
    """Unit counts of texts laid one after the other. data: their bytes; bounds: the n+1 places where they begin."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, unit: str = "char", size: int = CHUNK):
        self.data, self.bounds, self.begins, self.size = data, bounds, UNITS[unit], size
        per = -(-np.diff(bounds) // size)
        self.first = np.r_[0, np.cumsum(per)]  # first chunk of each text
        self.start = np.repeat(bounds[:-1], per) + size * (np.arange(self.first[-1]) - np.repeat(self.first[:-1], per))
        self.end = np.minimum(self.start + size, np.repeat(bounds[1:], per))
        self.opens = np.repeat(per > 0, per)
        self.opens[1:] = self.start[1:] == np.repeat(bounds[:-1], per)[1:]
        counts = np.zeros(len(self.start), np.int64)
        step = max(1, (1 << 20) // size)
        for lo in range(0, len(counts), step):  # as many chunks at once as make a megabyte
            hi = min(lo + step, len(counts))
            counts[lo:hi] = np.add.reduceat(self.flags(lo, hi), self.start[lo:hi] - self.start[lo])
        self.upto = np.r_[0, np.cumsum(counts)]  # units before each chunk, over all texts
        self.units = self.upto[self.first[1:]] - self.upto[self.first[:-1]]

    def flags(self, lo: int, hi: int) -> np.ndarray:
        """Where units begin in the chunks from lo to hi-1, which see one byte of the chunk before. The first byte of a text always begins one."""
        s, e = self.start[lo], self.end[hi - 1]
        seen = self.data[max(s - 1, 0) : e]
        out = self.begins(np.r_[seen[:1], seen[:-1]], seen)[s - max(s - 1, 0) :].astype(np.int64)
        out[self.start[lo:hi][self.opens[lo:hi]] - s] = 1
        return out

    def place(self, text: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Byte at which the unit of each rank (from 0) of each text begins; the text's end where the rank is the number of its units."""
        out = self.bounds[text + 1].copy()
        inner = np.flatnonzero(rank < self.units[text])
        whole = self.upto[self.first[text[inner]]] + rank[inner]
        owner = np.searchsorted(self.upto, whole, side="right") - 1
        for i, c, r in zip(inner.tolist(), owner.tolist(), (whole - self.upto[owner]).tolist(), strict=True):
            out[i] = self.start[c] + np.flatnonzero(self.flags(c, c + 1))[r]
        return out


def dice(identifier: Column, seed: int) -> list[Column]:
    """Four whole numbers below 2**32 from the id alone, so the same document is always cut alike."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(identifier.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(h, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]


def fill_in_middle(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", unit: str = "char", rate: int = 90, spm: int = 20, seed: int = 1, markers: Sequence[str] = MARKERS, chunk: int = CHUNK
) -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output): of ``rate`` texts in a hundred the middle between two random cuts goes to the end, with the suffix first in ``spm`` of a hundred of them.

    n counts units; form is psm, spm or plain. Texts that hold a marker stay plain. No marker may end as another begins, else the output could not be taken apart again.
    """
    for a in markers:
        for b in markers:
            if not a or a != b and a in b or any(a[-k:] == b[:k] for k in range(1, min(len(a), len(b)))):
                raise ValueError(f"markers {a!r} and {b!r} can overlap")
    if len(set(markers)) != 3:
        raise ValueError("three different markers are needed")
    small_batches(docs.sparkSession)
    text = F.coalesce(docs[text_column].cast("string"), F.lit(""))
    plain = text == ""
    for m in markers:
        plain = plain | F.contains(text, F.lit(m))
    kind = docs.schema[id_column].dataType.simpleString()
    picked = docs.select(docs[id_column].alias("id"), text.alias("text"), plain.alias("plain"), *dice(docs[id_column], seed))
    p, s, m = (x.encode() for x in markers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            data, bounds = utf8_of(part.column("text"))
            chunks = Chunks(data, bounds, unit, chunk)
            n = chunks.units
            h1, h2, h3, h4 = (part.column(f"h{i}").to_numpy() for i in range(1, 5))
            moved = np.flatnonzero(~part.column("plain").to_numpy(zero_copy_only=False) & (h3 % 100 < rate))
            ranks = np.sort(np.stack([h1 % (n + 1), h2 % (n + 1)])[:, moved], axis=0)
            cuts = np.stack([chunks.place(moved, r) for r in ranks])
            raw, edges = data.tobytes(), bounds.tolist()
            output = [raw[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
            form, before, within = ["plain"] * len(n), [None] * len(n), [None] * len(n)
            chars = lambda a, b: int(np.count_nonzero(UNITS["char"](None, data[a:b])))  # noqa: B023, E731
            for i, lo, hi, first in zip(moved.tolist(), *cuts.tolist(), (h4[moved] % 100 < spm).tolist(), strict=True):
                a, b = edges[i], edges[i + 1]
                prefix, middle, suffix = raw[a:lo], raw[lo:hi], raw[hi:b]
                form[i], before[i], within[i] = "spm" if first else "psm", chars(a, lo), chars(lo, hi)
                output[i] = b"".join((s, suffix, p, prefix, m, middle) if first else (p, prefix, s, suffix, m, middle))
            columns = [part.column("id"), pa.array(n), pa.array(form), pa.array(before, pa.int64()), pa.array(within, pa.int64()), pa.array(output, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n", "form", "prefix_chars", "middle_chars", "output"])

    out = picked.mapInArrow(run, f"id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")
    return out.withColumnRenamed("id", id_column)


def restored(output: Column, form: Column, markers: Sequence[str] = MARKERS) -> Column:
    """The text that an output was made of, from the output and its form alone."""
    p, s, m = markers
    between = lambda a, b: F.substring_index(F.substring_index(output, b, 1), a, -1)
    middle = F.substring_index(output, m, -1)
    return F.when(form == "psm", F.concat(between(p, s), middle, between(s, m))).when(form == "spm", F.concat(between(p, m), middle, between(s, p))).otherwise(output)
