"""Words, shingle sets and sentence units from UTF-8 bytes, for whole batches of texts at once."""

from __future__ import annotations

import numpy as np

from litforge.llm.common import mix64, span_hashes

_white = np.zeros(256, bool)
_white[[0x20, *range(0x09, 0x0E)]] = True
_stop = np.zeros(256, bool)
_stop[list(b".!?")] = True
_lower = np.arange(256)
_lower[ord("A") : ord("Z") + 1] += 32
_exact = mix64(np.arange(1, 257, dtype=np.uint64))
_second = mix64(np.arange(1001, 1257, dtype=np.uint64))
_folded = _exact[_lower]
_STEP = np.uint64(0xA24BAED4963EE407)
SPAN = 13  # the most with which 50 words hold three units


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word, A-Z lower-cased, and the n+1 bounds of the texts."""
    white = _white[data]
    inner = np.r_[True, white, True]
    edge = offsets[1:-1]
    solid = ~white
    begins = solid & inner[:-2]
    ends = solid & inner[2:]
    cut = edge[(edge > 0) & (edge < len(data))]
    begins[cut] |= solid[cut]
    ends[cut - 1] |= solid[cut - 1]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return span_hashes(_folded[data], starts, stops), np.searchsorted(starts, offsets)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's k-word shingles: (flat, n+1 bounds). Fewer words make one shingle, no word none."""
    return shingles_of(*word_hashes(data, offsets), k)


def shingles_of(words: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    n = len(bounds) - 1
    count = np.diff(bounds)
    size = np.where(count >= k, count - k + 1, count > 0)
    out = np.empty(int(size.sum()), np.uint64)
    ends_ = np.cumsum(size)
    with np.errstate(over="ignore"):
        weights = [_STEP ** np.uint64(j + 1) for j in range(k)]
        total = np.zeros(max(len(words) - k + 1, 0), np.uint64)
        for j in range(k):
            total += words[j : len(words) - k + 1 + j] * weights[j]
        total = mix64(total + np.uint64(k))
        keep = np.ones(len(out), bool)
        for i in range(n):
            c, a, b = count[i], ends_[i] - size[i], ends_[i]
            if c >= k:
                part = out[a:b]
                part[:] = total[bounds[i] : bounds[i] + c - k + 1]
                part.sort()
                keep[a + 1 : b] = part[1:] != part[:-1]
            elif c:
                w = words[bounds[i] : bounds[i + 1]]
                out[a] = mix64(np.array([sum(int(x) * int(weights[j]) for j, x in enumerate(w)) + int(c) & (1 << 64) - 1], np.uint64))[0]
    kept = np.r_[0, np.cumsum(keep)]
    return out[keep], np.r_[0, kept[ends_]]


def inner_cuts(data: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Words before which a sentence is cut by content: of each SPAN words in a row of one sentence, the gap inside whose two words have the smallest hash, the last of equal ones."""
    n, gaps = len(start), SPAN - 1
    if n < SPAN:
        return np.zeros(0, np.int64)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_exact[data], out=total[1:])
    word = total[end] - total[start]  # the order of bytes within a word may be left out here
    pair = np.zeros(n, np.uint64)
    pair[1:] = mix64(word[:-1] * _STEP + word[1:])
    low = np.uint64((1 << 24) - 1)
    pair = (pair | np.uint64(1 << 63)) & ~low | low - (np.arange(n, dtype=np.uint64) & low)
    pair[first] = 0  # no window crosses a sentence's end
    least = pair[1:]
    have = 1
    while have < gaps:
        step = min(have, gaps - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    at = np.flatnonzero(least)
    begin = (at + 1).astype(np.uint64)
    return np.unique(begin + ((low - (least[at] & low) - begin) & low)).astype(np.int64)


def sentence_units(data: np.ndarray, offsets: np.ndarray, whole: bool = False, breaks_only: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Units that end at a line break, after . ! ? before white space, or at a cut by content within a sentence of SPAN words or more: (start, end without white space behind, words,
    n+1 bounds of the texts). A unit has fewer than SPAN words, and any 50 words hold three whole units that are the same wherever these words stand. With whole, sentences are not cut; with breaks_only, only line breaks end a unit."""
    white = _white[data]
    solid = np.flatnonzero(~white)
    if not len(solid):
        return solid, solid, solid, np.zeros(len(offsets), np.int64)
    breaks = np.r_[0, np.cumsum(data == 0x0A)]
    gap = np.diff(solid) > 1
    other = np.zeros(len(gap), bool)
    at = np.searchsorted(solid, offsets[1:-1])
    other[at[(at > 0) & (at < len(solid))] - 1] = True
    new = gap & (_stop[data[solid[:-1]]] & (not breaks_only) | (breaks[solid[1:]] > breaks[solid[:-1]])) | other
    word = np.flatnonzero(np.r_[True, gap | other])
    start, end = solid[word], solid[np.r_[word[1:] - 1, len(solid) - 1]] + 1
    first = np.r_[True, new][word]
    if not whole and not breaks_only:
        first[inner_cuts(data, start, end, first)] = True
    at = np.flatnonzero(first)
    start, end = start[at], end[np.r_[at[1:] - 1, len(word) - 1]]
    return start, end, np.diff(np.r_[at, len(word)]), np.searchsorted(start, offsets)


def unit_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each unit."""
    return span_hashes(_exact[data], start, end), span_hashes(_second[data], start, end)
