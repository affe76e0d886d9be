"""Operator 13: how far the sources of a language diverge, and by which terms.

Terms are counted with integers. Within a batch each distinct term has a number, and one count over (group, number) serves all its texts. Counts of
all batches are summed by Spark and dealt by ranges of (lang, term), so that each range is a run of the sorted vocabulary: it is cut into chunks, in
each of which the terms kept are one sorted array, their place in it is their id (found by ``searchsorted`` among the numbers kept), and counts of
a chunk are a dense matrix, a row for each source. Ids keep the UTF-8 order of terms, so ties go by id. No vocabulary is ever whole in one place.

Arithmetic is exact in 64 bits: shares in billionths by long division in three steps (counts to 9e15), squares of at most (10**9+1)**2.

Cases: null text, lang and source count as ''; every row is a document, also where ids repeat or are null; ids are not read, nor other columns,
whatever their names; texts may be empty or of any length; a language without kept terms still gives its pairs, with value 0; a language of one
source gives no rows; an empty table gives none. Ties of value go by item in UTF-8 order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from litforge.llm.common import materialise, slices, small_batches, utf8_of

BILLION = 1_000_000_000
#: Bytes that end a term: all of ASCII but letters. Bytes from 0x80 on are parts of letters and signs beyond ASCII, and belong to terms.
LETTER = ~np.isin(np.arange(256), [*range(0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
FOLD = np.where((np.arange(256) >= 0x41) & (np.arange(256) <= 0x5A), np.arange(256) + 32, np.arange(256)).astype(np.uint8)
CHUNK_ROWS = 1 << 17  # rows (source, term) of a chunk
CELLS = 1 << 21  # cells of a dense matrix in work at a time
SHARES = 16  # parts in which the terms of a source are ranked first
SMALL = 4 << 20  # bytes of group names up to which they are broadcast


def found_terms(data: np.ndarray, bounds: np.ndarray) -> tuple[pa.StringArray, np.ndarray]:
    """The terms of texts laid one after the other, A-Z lower-cased, and the text of each."""
    letter = LETTER[data]
    first = letter.copy()
    first[1:] &= ~letter[:-1]
    opens = bounds[:-1][bounds[:-1] < len(data)]
    first[opens] = letter[opens]
    starts = np.flatnonzero(first)
    place = np.cumsum(letter)
    offsets = np.r_[place[starts] - 1, place[-1:]].astype(np.int32) if len(starts) else np.zeros(1, np.int32)
    terms = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(FOLD[data[letter]]))
    return terms, np.searchsorted(bounds, starts, side="right") - 1


def batch_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per run of texts: (lang, source, term, n, df), and for each group a row with the empty term, so that no group is lost."""
    for part in slices(batches, "text", 4 << 20):
        terms, doc = found_terms(*utf8_of(part.column("text")))
        numbers: dict[tuple, int] = {}
        group = np.array([numbers.setdefault(x, len(numbers)) for x in zip(part.column("lang").to_pylist(), part.column("source").to_pylist(), strict=True)], np.int64)
        coded = terms.dictionary_encode()
        ids, v = coded.indices.to_numpy().astype(np.int64), max(len(coded.dictionary), 1)
        cells, n = np.unique(group[doc] * v + ids, return_counts=True)
        once = np.unique(doc * v + ids)
        df = np.unique(group[once // v] * v + once % v, return_counts=True)[1]  # the same cells
        names = list(numbers)
        which = pa.array(np.r_[cells // v, np.arange(len(names))])
        word = pa.concat_arrays([coded.dictionary.take(pa.array(cells % v)), pa.array([""] * len(names), pa.string())])
        zeros = np.zeros(len(names), np.int64)
        lang, source = (pa.array(x, pa.string()).take(which) for x in zip(*names, strict=True))
        yield pa.RecordBatch.from_arrays([lang, source, word, pa.array(np.r_[n, zeros]), pa.array(np.r_[df, zeros])], ["lang", "source", "term", "n", "df"])


CHUNK = pa.schema([("lang", pa.string()), ("terms", pa.list_(pa.string())), ("sources", pa.list_(pa.string())), ("row", pa.list_(pa.int32())), ("id", pa.list_(pa.int32())), ("n", pa.list_(pa.int64())), ("sums", pa.list_(pa.int64()))])
PARTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])


def term_chunks(least: int, most: int):
    """Rows sorted by (lang, term) to chunks of the vocabulary: its terms in order, its sources, and the cells (row, id, n) of the matrix of both, by id; sums has the total of each row."""

    def chunk(rows: pa.Table) -> pa.RecordBatch:
        coded = rows.column("term").combine_chunks().dictionary_encode()  # rows are sorted, so numbers ascend with terms
        number = coded.indices.to_numpy().astype(np.int64)
        df = np.zeros(len(coded.dictionary), np.int64)
        np.add.at(df, number, rows.column("df").to_numpy())
        kept = np.flatnonzero(df >= least)
        names = sorted(set(rows.column("source").to_pylist()), key=str.encode)
        place = {s: i for i, s in enumerate(names)}
        source = np.array([place[s] for s in rows.column("source").to_pylist()], np.int64)
        known = np.flatnonzero((df >= least)[number])
        row, ids, n = source[known], np.searchsorted(kept, number[known]), rows.column("n").to_numpy()[known]
        sums = np.zeros(len(names), np.int64)
        np.add.at(sums, row, n)
        values = [rows.column("lang")[0].as_py(), coded.dictionary.take(pa.array(kept)), names, row, ids, n, sums]
        return pa.RecordBatch.from_arrays([pa.array([v], k.type) for v, k in zip(values, CHUNK, strict=True)], schema=CHUNK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def cut(rows: pa.Table, last: bool) -> tuple[list[pa.Table], pa.Table]:
            """Whole languages and terms off the front; what may go on in the next batch stays."""
            lang, term = (rows.column(c).combine_chunks().dictionary_encode().indices.to_numpy() for c in ("lang", "term"))
            new_lang = np.r_[True, lang[1:] != lang[:-1]]
            new = np.flatnonzero(new_lang | np.r_[True, term[1:] != term[:-1]])
            edges = [*np.flatnonzero(new_lang).tolist(), rows.num_rows if last else int(new[-1])]
            edges = sorted({e for e in edges if e <= edges[-1]})
            return [rows.slice(a, b - a) for a, b in zip(edges[:-1], edges[1:], strict=True)], rows.slice(edges[-1])

        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= most:
                whole, rest = cut(pa.Table.from_batches(held), last=False)
                for rows in whole:
                    yield chunk(rows)
                held, size = rest.to_batches(), rest.num_rows
        if size:
            for rows in cut(pa.Table.from_batches(held), last=True)[0]:
                yield chunk(rows)

    return run


def billionths(counts: np.ndarray, whole: np.ndarray | int) -> np.ndarray:
    """1 + floor(10**9 * (counts + 1) / whole), by long division to base 1000; counts + 1 <= whole < 9e15."""
    rest, out = counts + 1, np.zeros(np.broadcast_shapes(np.shape(counts), np.shape(whole)), np.int64)
    head = rest // whole
    rest = rest - head * whole
    out += head
    for _ in range(3):
        rest = rest * 1000
        digit = rest // whole
        rest -= digit * whole
        out = out * 1000 + digit
    return out + 1


def part_rows(lang: str, source: str, part: str, items: list[str], values: np.ndarray | list[int]) -> pa.RecordBatch:
    k = len(items)
    return pa.RecordBatch.from_arrays([pa.array([lang] * k), pa.array([source] * k), pa.array([part] * k), pa.array(items, pa.string()), pa.array(values, pa.int64())], schema=PARTS)


def divergences(top: int, cells: int = CELLS):
    """Chunks, each with the totals of its language, to (lang, source, part, item, value): sums over the task's chunks for pairs, the task's first terms of each source. Sums of a language with too many sources for one matrix leave block by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        names: dict[str, list[str]] = {}
        best: dict[tuple[str, str], list[tuple]] = {}

        def others(lang: str, i: int, values: np.ndarray) -> pa.RecordBatch:
            return part_rows(lang, names[lang][i], "pair", [s for j, s in enumerate(names[lang]) if j != i], np.delete(values, i))

        for batch in batches:
            for k in range(batch.num_rows):
                get = lambda c: batch.column(c)[k].values  # noqa: B023, E731
                lang, v, terms = batch.column("lang")[k].as_py(), batch.column("v")[k].as_py(), get("terms")
                every = get("all_sources").to_pylist()
                order = sorted(range(len(every)), key=lambda i: every[i].encode())  # noqa: B023
                n, every = get("all_sums").to_numpy()[order], [every[i] for i in order]
                at = {s: i for i, s in enumerate(every)}
                row = np.array([at[s] for s in get("sources").to_pylist()], np.int64)[get("row").to_numpy()]
                ids, given = get("id").to_numpy(), get("n").to_numpy()
                fits = len(every) ** 2 <= 4 * cells
                names[lang] = every
                if fits and lang not in sums:
                    if sum(x.size for x in sums.values()) + len(every) ** 2 > 4 * cells:
                        for old, table in sums.items():
                            yield from (others(old, i, x) for i, x in enumerate(table))
                        sums.clear()
                    sums[lang] = np.zeros((len(every), len(every)), np.int64)
                step = max(1, cells // len(every))
                for lo in range(0, max(len(terms), 1), step):
                    hi = min(lo + step, len(terms))
                    a, b = np.searchsorted(ids, [lo, hi])
                    c = np.zeros((len(every), hi - lo), np.int64)
                    c[row[a:b], ids[a:b] - lo] = given[a:b]
                    p, q = billionths(c, (n + v)[:, None]), billionths(c.sum(axis=0), int(n.sum()) + v)
                    for i, s in enumerate(every):
                        d = p[i] - p
                        f = (d * d // p).sum(axis=1)
                        if fits:
                            sums[lang][i] += f
                        else:
                            yield others(lang, i, f)
                        more = np.flatnonzero((c[i] > 0) & (p[i] > q))
                        if len(more):
                            d = (p[i] - q)[more]
                            f = d * d // q[more]
                            first = np.lexsort((more, -f))[:top]
                            seen = [(-int(x), y.encode()) for x, y in zip(f[first], terms.take(pa.array(lo + more[first])).to_pylist(), strict=True)]
                            best[lang, s] = sorted(best.get((lang, s), []) + seen)[:top]
        for lang, table in sums.items():
            yield from (others(lang, i, x) for i, x in enumerate(table))
        for (lang, s), found in best.items():
            yield part_rows(lang, s, "term", [t.decode() for _, t in found], [-x for x, _ in found])

    return run


def source_divergence(docs: DataFrame, least: int = 3, top: int = 200, chunk_rows: int = CHUNK_ROWS, small: int = SMALL, cells: int = CELLS) -> DataFrame:
    """(lang, source, part, item, value, rank): of each source the other sources by divergence, and its ``top`` terms beyond their share in the language. Terms count that ``least`` documents of a language hold."""
    small_batches(docs.sparkSession)
    text = lambda c: F.coalesce(docs[c].cast("string"), F.lit("")).alias(c)
    picked = docs.select(text("lang"), text("source"), text("text"))
    partial = picked.mapInArrow(batch_counts, "lang string, source string, term string, n long, df long")
    counts = partial.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
    ranged = counts.repartitionByRange("lang", "term").sortWithinPartitions("lang", "term")
    chunks = materialise(ranged.mapInArrow(term_chunks(least, chunk_rows), "lang string, terms array<string>, sources array<string>, row array<int>, id array<int>, n array<long>, sums array<long>"), "chunks")

    each = chunks.select("lang", F.explode(F.arrays_zip("sources", "sums")).alias("x")).groupBy("lang", F.col("x.sources").alias("source")).agg(F.sum("x.sums").alias("n"))
    groups = materialise(each, "groups")
    kept = chunks.groupBy("lang").agg(F.sum(F.size("terms").cast("long")).alias("v"))
    by_lang = groups.groupBy("lang").agg(F.collect_list("source").alias("all_sources"), F.collect_list("n").alias("all_sums")).join(kept, "lang")
    size = groups.agg(F.coalesce(F.sum(F.octet_length("source") + F.octet_length("lang") + 24), F.lit(0)).alias("b")).first()["b"]
    if size <= small:
        joined = chunks.join(F.broadcast(by_lang), "lang")
    else:  # a language's chunks meet copies of its totals in many tasks
        copies = 64
        salt = F.pmod(F.xxhash64(F.element_at("sources", 1), F.try_element_at("terms", F.lit(1)), F.size("terms")), F.lit(copies)).cast("int")
        joined = chunks.withColumn("_salt", salt).join(by_lang.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))), ["lang", "_salt"])
    parts = joined.select("lang", "terms", "sources", "row", "id", "n", "all_sources", "all_sums", "v").mapInArrow(divergences(top, cells), "lang string, source string, part string, item string, value long")
    summed = parts.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    # every task has its first terms; the first of all are among the first of some of them, so that no task ranks more than those few
    order = (F.desc("value"), "item")
    share = F.when(F.col("part") == "term", F.pmod(F.xxhash64("item"), F.lit(SHARES))).otherwise(F.lit(-1))
    few = summed.withColumn("_share", share).withColumn("_r", F.row_number().over(Window.partitionBy("lang", "source", "part", "_share").orderBy(*order))).filter((F.col("part") == "pair") | (F.col("_r") <= top)).drop("_share", "_r")
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(*order)).cast("int")
    return few.withColumn("rank", rank).filter((F.col("part") == "pair") | (F.col("rank") <= top))
