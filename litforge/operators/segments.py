"""Candidates for similar texts by an exact index of segments.

A text of length l is parted into one segment more than there may be edits between it and any text at least as long. Let i be the first segment up to whose end there are no more than i edits:
it is untouched, exactly i edits lie before it, and the rest behind it. So the longer text holds the segment at a place shifted by at most i, and by no more than the edits left over allow
behind it; if edits are insertions and deletions only, the shift is even where i is. The longer text looks up these few substrings, for each length that its partner may have.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def most_edits(short: Column, long: Column, threshold: float, metric: str) -> Column:
    """Edits that two texts of these lengths may lie apart: insertions and deletions for ``indel``, with substitutions for ``levenshtein``."""
    whole = short + long if metric == "indel" else F.greatest(short, long)
    return F.floor(whole * (1 - threshold / 100.0) + 1e-9).cast("int")


def longest_partner(length: Column, threshold: float, metric: str) -> Column:
    """The greatest length at which a text of this length can still be alike."""
    factor = (200.0 - threshold) / threshold if metric == "indel" else 100.0 / threshold
    return F.floor(length * factor + 1e-9).cast("int")


def shortest_partner(length: Column, threshold: float, metric: str) -> Column:
    factor = threshold / (200.0 - threshold) if metric == "indel" else threshold / 100.0
    return F.greatest(F.ceil(length * factor - 1e-9).cast("int"), F.lit(1))


def place(i: Column, length: Column, parts: Column) -> Column:
    """Where segment i of a text begins, from 0; the last ones are a character longer where the length does not divide."""
    base = (length / parts).cast("int")
    return i * base + F.greatest(F.lit(0), i - (parts - length % parts))


def candidates(classes: DataFrame, blocks: Sequence[str], identifier: str, text: str, threshold: float, metric: str = "indel") -> DataFrame:
    """(a, ha, b, hb), each once: pairs of a block, with hashes of their texts, among which all pairs of different texts at or above the threshold are. Texts are not null; empty ones are like no other."""
    key = lambda *more: F.xxhash64(*[F.col(b) for b in blocks], *more)
    x = classes.filter(F.length(text) > 0).select(*blocks, F.col(identifier).alias("id"), F.xxhash64(text).alias("h"), F.col(text).alias("t"), F.length(text).alias("n"))
    parts = lambda n: most_edits(n, longest_partner(n, threshold, metric), threshold, metric) + 1
    cut = lambda t, start, size: F.substring(t, start + 1, size)
    size = lambda i, n, k: place(i + 1, n, k) - place(i, n, k)

    k = parts(F.col("n"))
    segment = F.transform(F.sequence(F.lit(0), k - 1), lambda i: key(F.col("n"), i, cut(F.col("t"), place(i, F.col("n"), k), size(i, F.col("n"), k))))
    # where edits may be as many as letters, no segment is left, and texts of these lengths meet
    held = x.select("id", "h", "n", F.explode(F.when(k <= F.col("n"), segment).otherwise(F.array(key(F.col("n"), F.lit(-1))))).alias("key"))

    def looked_up(n: Column) -> Column:
        gap, edits, p = F.col("n") - n, most_edits(n, F.col("n"), threshold, metric), parts(n)

        def shifted(i: Column) -> Column:
            lo, hi = F.greatest(-i, gap - (edits - i)), F.least(i, gap + (edits - i))
            shifts = F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>"))
            if metric == "indel":
                shifts = F.filter(shifts, lambda d: F.pmod(d - i, F.lit(2)) == 0)
            w = size(i, n, p)
            shifts = F.filter(shifts, lambda d: (place(i, n, p) + d >= 0) & (place(i, n, p) + d + w <= F.col("n")))
            return F.transform(shifts, lambda d: key(n, i, cut(F.col("t"), place(i, n, p) + d, w)))

        return F.when(p <= n, F.flatten(F.transform(F.sequence(F.lit(0), F.least(p - 1, edits)), shifted))).otherwise(F.array(key(n, F.lit(-1))))

    lengths = F.sequence(shortest_partner(F.col("n"), threshold, metric), F.col("n"))
    asked = x.select("id", "h", "n", F.explode(F.array_distinct(F.flatten(F.transform(lengths, looked_up)))).alias("key"))
    met = held.select(F.col("id").alias("i"), F.col("h").alias("hi"), "key").join(asked.select(F.col("id").alias("j"), F.col("h").alias("hj"), "key"), "key").filter("i <> j")
    small = F.col("i") < F.col("j")
    pick = lambda p, q: F.when(small, F.col(p)).otherwise(F.col(q))
    return met.select(pick("i", "j").alias("a"), pick("hi", "hj").alias("ha"), pick("j", "i").alias("b"), pick("hj", "hi").alias("hb")).distinct()
