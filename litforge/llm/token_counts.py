"""Operator 12: token counts of every prefix, by dynamic programming.

A sequence of tokens is the encoding of its bytes if each adjacent pair would stay apart on its own (see bpe.py). So the encoding of a prefix ends in
the one token that is a suffix of the prefix and can follow the last token of the prefix before it; its count is one more than that prefix's.
Words are independent, so each distinct word is worked out once, all words of a batch side by side, place by place; what a text's prefix of any
length holds is the count up to its last word and that word's own prefix. The counts are kept beside the text, one for each character, and answer
how many tokens a prefix has and which prefix meets a budget with column expressions, without encoding anything again.

A prefix is a text of its own: its last white space is one word, even where the whole text gives the last blank to the word that follows; half of a
contraction ('r of 're) is two words; and a special token's string counts as one token once it is complete, before as ordinary characters.
Counts may fall as a prefix grows, when characters merge.

Cases: null text counts as empty and has the one count 0; null ids pass through; an empty table gives no rows; texts and words may be of any length;
other columns are not read, whatever their names; equal texts give equal counts, there are no ties. Characters newer than this Python's Unicode
tables get the class the library gives them. No row is dropped. Nothing is shuffled. Only files of the byte-level kind are taken.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litforge.llm.bpe import SpeculativeEncoder, _byte_code
from litforge.llm.common import ragged, slices, small_batches, span_hashes, string_bytes, texts_of
from litforge.llm.encoder import WordTable, encoder
from litforge.llm.pretokens import LETTER, NUMBER, OTHER, SPACE, UNKNOWN, Words, _tables, classes

SIDE_BY_SIDE = 128  # bytes up to which words are worked out together, place by place
MOST_COUNTS = 1 << 25  # counts of known words that a worker holds


class PrefixCounter(SpeculativeEncoder):
    """``prefix_counts(texts)``: the counts of all prefixes, n+1 for a text of n characters, one text after the other, and where each text's begin."""

    def __init__(self, path: str, kind: str = "byte"):
        super().__init__(path, kind)
        if any(a != b and a in b for a in self.special for b in self.special):
            raise ValueError("one special token holds another")
        self.split = re.compile("|".join(map(re.escape, self.special))) if self.special else None
        self.words = WordTable(width=np.int32)
        ids = np.array([i for i, b in enumerate(self.bytes) if b and (len(b) == 1 or self.rank[i] >= 0)])
        made, sizes = self.merged(self.flat[ragged(self.first[ids], self.sizes[ids])], self.sizes[ids])
        alone = sizes == 1  # a token that its own bytes don't give can't end a prefix
        ids = ids[alone][made[(np.cumsum(sizes) - sizes)[alone]] == ids[alone]]
        self.usable = ids
        self.longest = int(self.sizes[ids].max())
        h = span_hashes(_byte_code[self.flat], self.first[ids], self.first[ids] + self.sizes[ids])
        order = np.argsort(h)
        self.token_hash, self.token_id = h[order], ids[order]
        self.maybe = np.zeros(1 << 20, bool)  # most spans are no tokens, and go by this
        self.maybe[h & np.uint64(0xFFFFF)] = True
        self.known_pairs, self.fits_pair = np.zeros(0, np.int64), np.zeros(0, bool)
        self.automaton: ahocorasick.Automaton | None = None

    def follows(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether each b can follow its a (-1: nothing before); pairs are checked once and remembered."""
        out = a < 0
        some = np.flatnonzero(~out)
        pairs, index = np.unique(a[some] << 20 | b[some], return_inverse=True)
        row = np.minimum(np.searchsorted(self.known_pairs, pairs), max(len(self.known_pairs) - 1, 0))
        new = pairs[self.known_pairs[row] != pairs] if len(self.known_pairs) else pairs
        if len(new):
            if len(self.known_pairs) > 1 << 23:
                self.known_pairs, self.fits_pair, new = np.zeros(0, np.int64), np.zeros(0, bool), pairs
            at = np.searchsorted(self.known_pairs, new)
            self.known_pairs, self.fits_pair = np.insert(self.known_pairs, at, new), np.insert(self.fits_pair, at, self.compatible(new >> 20, new & 0xFFFFF))
        out[some] = self.fits_pair[np.searchsorted(self.known_pairs, pairs)][index]
        return out

    def side_by_side(self, data: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Tokens of each prefix of each word, in bytes: place by place, all words at once."""
        starts = np.cumsum(sizes) - sizes
        place = np.arange(len(data)) - np.repeat(starts, sizes)  # in the word
        reach = np.minimum(place + 1, self.longest)
        end = np.repeat(np.arange(len(data)), reach)
        size = 1 + np.arange(len(end)) - np.repeat(np.cumsum(reach) - reach, reach)
        h = span_hashes(_byte_code[data], end + 1 - size, end + 1)
        some = np.flatnonzero(self.maybe[h & np.uint64(0xFFFFF)])
        h = h[some]
        row = np.minimum(np.searchsorted(self.token_hash, h), len(self.token_hash) - 1)
        hit = np.flatnonzero(self.token_hash[row] == h)
        end, size, token = end[some[hit]], size[some[hit]], self.token_id[row[hit]]
        order = np.argsort(place[end], kind="stable")
        end, size, token = end[order], size[order], token[order]
        begins = np.searchsorted(place[end], np.arange(int(sizes.max(initial=0)) + 1))
        last, count = np.full(len(data), -1, np.int64), np.zeros(len(data), np.int32)
        for a, b in zip(begins[:-1], begins[1:], strict=True):
            e, s, t = end[a:b], size[a:b], token[a:b]
            inner = place[e] >= s
            before = np.where(inner, last[np.maximum(e - s, 0)], -1)
            good = self.follows(before, t)
            e, s, t, inner = e[good], s[good], t[good], inner[good]
            last[e], count[e] = t, 1 + np.where(inner, count[np.maximum(e - s, 0)], 0)
        return count

    def one_by_one(self, word: bytes) -> np.ndarray:
        """The same for a long word, by an automaton over the vocabulary."""
        if self.automaton is None:
            self.automaton = ahocorasick.Automaton()
            for i in self.usable.tolist():
                self.automaton.add_word(self.bytes[i].decode("latin-1"), i)
            self.automaton.make_automaton()
        last, count, seen, sizes = [-1] * len(word), np.zeros(len(word), np.int32), {}, self.sizes
        for e, t in self.automaton.iter(word.decode("latin-1")):
            k = e - int(sizes[t])
            if last[e] >= 0:
                continue
            if k >= 0:
                pair = (last[k], t)
                ok = seen.get(pair)
                if ok is None:
                    ok = seen[pair] = bool(self.compatible(np.array([last[k]]), np.array([t]))[0])
                if not ok:
                    continue
            last[e], count[e] = t, 1 + (count[k] if k >= 0 else 0)
        return count

    def new_words(self, data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts at each character of distinct words, flat, and how many each has."""
        count = np.zeros(len(data), np.int32)
        starts = np.cumsum(sizes) - sizes
        short = sizes <= SIDE_BY_SIDE
        if short.any():
            at = ragged(starts[short], sizes[short])
            count[at] = self.side_by_side(data[at], sizes[short])
        for s, n in zip(starts[~short].tolist(), sizes[~short].tolist(), strict=True):
            count[s : s + n] = self.one_by_one(data[s : s + n].tobytes())
        ends = np.r_[(data[1:] & 0xC0) != 0x80, True] if len(data) else np.zeros(0, bool)  # last bytes of characters
        return count[ends], np.add.reduceat(ends, starts).astype(np.int32) if len(sizes) else np.zeros(0, np.int32)

    def classify(self, text: str) -> None:
        """Ask the library for the class of characters that this Python does not know."""
        table = classes()
        chars = np.unique(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32))
        for c in chars[table[chars] == UNKNOWN].tolist():
            words = lambda s: len(self.library.pre_tokenizer.pre_tokenize_str(s))
            table[c] = LETTER if words("a" + chr(c)) == 1 else NUMBER if words("1" + chr(c)) == 1 else OTHER if words("!" + chr(c)) == 1 else SPACE

    def known(self, w: Words, start: np.ndarray, end: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of the first count, number of counts) of each word in the table; new words are worked out."""
        distinct = pa.array(hashes).dictionary_encode()
        keys, index = distinct.dictionary.to_numpy(), distinct.indices.to_numpy(zero_copy_only=False)
        row, there = self.words.find(keys)
        if not there.all():
            if len(self.words.hashes) + len(keys) > self.words.most or self.words.used > MOST_COUNTS:
                self.words.clear()
                there[:] = False
            at = np.zeros(len(keys), np.int64)
            at[index[::-1]] = np.arange(len(index))[::-1]
            new = at[~there]
            w.start, w.end, kept = start, end, (w.start, w.end)
            self.words.add(keys[~there], *self.new_words(*w.spelled(new)))
            w.start, w.end = kept
            row, there = self.words.find(keys)
        return self.words.first[row][index], self.words.count[row][index].astype(np.int64)

    def plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Counts of all prefixes of texts in which special tokens are ordinary characters."""
        joined = "".join(texts)
        if not joined.isascii():
            self.classify(joined)
        w = Words(texts, "byte")
        k, chars = classes()[w.chars], w.chars
        length = w.end - w.start
        # runs of white space that a word follows: as a prefix's end they are one word
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        stop = np.cumsum(sizes + 1) - 1
        space = k == SPACE
        space[stop] = False
        run_start = np.flatnonzero(space & ~np.r_[False, space[:-1]])
        run_end = np.flatnonzero(space & ~np.r_[space[1:], False]) + 1
        follows = ~np.isin(run_end, stop) & (run_end - run_start > 1)
        run_start, run_end = run_start[follows], run_end[follows]
        codes = _tables["code"][chars]
        start, end = np.r_[w.start, run_start], np.r_[w.end, run_end]
        first, count = self.known(w, start, end, np.r_[w.hashes, span_hashes(codes, run_start, run_end)])
        n = len(w.start)
        total = np.where(count[:n] > 0, self.words.ids[np.maximum(first[:n] + count[:n] - 1, 0)], 0).astype(np.int64)
        before = np.cumsum(total) - total  # over all texts
        inner = self.words.ids[ragged(first[:n], count[:n])] + np.repeat(before, length)
        out = np.zeros(len(chars), np.int64)  # place p+1 of a text has the count of its first p+1 characters; the line break's place starts the next
        at = ragged(w.start, length)
        out[at] = inner
        if len(run_start):
            word = np.searchsorted(w.start, run_start)  # a run begins a word, or its one blank is part of the word that follows
            out[run_end - 1] = before[word] + self.words.ids[first[n:] + count[n:] - 1]
        half = np.flatnonzero((length == 3) & (chars[w.start] == 0x27) & (k[np.minimum(w.start + 1, len(chars) - 1)] == LETTER))
        out[w.start[half] + 1] = before[half] + 2
        bounds = np.r_[0, np.cumsum(sizes + 1)]
        shift = np.zeros(len(texts), np.int64)
        has = sizes > 0
        head = np.searchsorted(w.start, bounds[:-1][has])
        shift[has] = before[head]
        counts = np.zeros(int(bounds[-1]), np.int64)
        counts[np.delete(np.arange(len(counts)), bounds[:-1])] = np.delete(out[: len(counts)], stop)
        counts -= np.repeat(shift, sizes + 1)
        counts[bounds[:-1]] = 0
        return counts.astype(np.int32), bounds

    def prefix_counts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        marked = {i: [m.span() for m in self.split.finditer(t)] for i, t in enumerate(texts) if self.mark in t} if self.split else {}
        marked = {i: spans for i, spans in marked.items() if spans}
        if not marked:
            return self.plain(texts)
        pieces, owner = [], []
        for i, t in enumerate(texts):
            # a piece goes on to where the next special token lacks its last character
            edges = [(0, 0), *marked.get(i, []), (len(t) + 1, len(t) + 1)]
            for (_, a), (_, b) in zip(edges[:-1], edges[1:], strict=True):
                pieces.append(t[a : b - 1])
                owner.append(i)
        counts, bounds = self.plain(pieces)
        parts, sizes, base, taken = [], np.zeros(len(texts), np.int64), 0, -1
        for p, i in enumerate(owner):
            if i != taken:
                base, taken, seen = 0, i, 0
            own = counts[bounds[p] : bounds[p + 1]]
            parts.append(own + base)
            sizes[i] += len(own)
            spans = marked.get(i, [])
            if seen < len(spans):
                start = spans[seen - 1][1] if seen else 0
                base += int(own[spans[seen][0] - start]) + 1
                seen += 1
        return np.concatenate(parts), np.r_[0, np.cumsum(sizes)]


def prefix_counts(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_bytes, counts): counts[i] is the number of tokens of the text's first i characters."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = encoder(path, "byte", PrefixCounter)
        for part in slices(batches, "text"):
            counts, bounds = counter.prefix_counts(texts_of(part.column("text")))
            lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(counts.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(string_bytes(part.column("text"))), lists], ["id", "n_bytes", "counts"])

    kind = docs.schema[id_column].dataType.simpleString()
    picked = docs.select(docs[id_column].alias("id"), docs[text_column].cast("string").alias("text"))
    return picked.mapInArrow(run, f"id {kind}, n_bytes long, counts array<int>").withColumnRenamed("id", id_column)


def tokens_of(counts: Column | str, chars: Column | int | None = None) -> Column:
    """Tokens of the first ``chars`` characters (all where the text is shorter), or of the whole text."""
    counts = F.col(counts) if isinstance(counts, str) else counts
    place = F.size(counts) if chars is None else F.least(F.size(counts), F.greatest(F.lit(chars) if isinstance(chars, int) else chars, F.lit(0)) + 1)
    return F.element_at(counts, place.cast("int")).cast("long")


def within_budget(counts: Column | str, budget: Column | int) -> Column:
    """Characters of the longest prefix with at most so many tokens; counts may fall, so a shorter prefix may be over the budget."""
    counts = F.col(counts) if isinstance(counts, str) else counts
    return F.array_max(F.transform(counts, lambda n, i: F.when(n <= budget, i))).cast("long")


def truncated(text: Column | str, counts: Column | str, budget: Column | int) -> Column:
    """The longest prefix of the text with at most so many tokens; null text counts as empty."""
    text = F.col(text) if isinstance(text, str) else text
    return F.substring(F.coalesce(text, F.lit("")), F.lit(1), within_budget(counts, budget).cast("int"))
