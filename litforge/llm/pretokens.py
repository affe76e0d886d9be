"""Vectorised pre-tokenisation: texts become one array of code points, word bounds come from class changes, and every word gets a 64-bit hash.

Two published patterns are covered. ``byte``: contractions, ``?\\p{L}+``, ``?\\p{N}+``, ``?other+`` with an optional leading space, white-space runs.
``word``: contractions, ``\\p{L}+``, one ``\\p{N}``, ``other+`` after NFC, lower case and with white space dropped.
"""

from __future__ import annotations

import unicodedata

import numpy as np

from litforge.llm.common import mix64, ragged, span_hashes

LETTER, NUMBER, SPACE, OTHER, UNKNOWN = range(5)
#: The code points with the Unicode White_Space property.
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

_tables: dict[str, np.ndarray] = {}


def classes() -> np.ndarray:
    """Class of every code point; those that this Python's Unicode tables don't know are UNKNOWN and leave the decision to the library."""
    if "class" not in _tables:
        kinds = {"L": LETTER, "N": NUMBER}
        out = np.fromiter((UNKNOWN if (c := unicodedata.category(chr(i))) == "Cn" else kinds.get(c[0], OTHER) for i in range(0x110000)), np.uint8, 0x110000)
        out[WHITE] = SPACE
        _tables["class"] = out
        _tables["code"] = mix64(np.arange(1, 0x110001, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return _tables["class"]


class Words:
    """Words of some texts: ``chars`` all code points, ``start`` and ``end`` of each word, ``hashes``, and ``bounds`` (n+1) with the first word of each text."""

    def __init__(self, texts: list[str], kind: str):
        table = classes()
        joined = "\n".join(texts) + "\n"  # a line break ends every word; those added are taken out again
        self.chars = c = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        after = np.cumsum(sizes + 1) - 1  # place of the line break behind each text
        k = table[c]
        k[after] = UNKNOWN + 1  # a class of its own, so that no word crosses it
        self.strange = np.add.reduceat(np.r_[k == UNKNOWN, False], np.r_[0, after[:-1] + 1]).astype(bool) if len(texts) else np.zeros(0, bool)
        n = len(c)
        change = np.empty(n, bool)
        change[0] = True
        np.not_equal(k[1:], k[:-1], out=change[1:])
        first = change.copy()
        if kind == "word":
            first |= k == NUMBER
        quote = np.flatnonzero((c == 0x27) & change & np.r_[change[1:], True])  # an apostrophe alone
        if kind == "byte":
            # the last blank of a white-space run goes to the word behind it, if it is a space; any other last one stands alone
            last = np.flatnonzero((k[:-1] == SPACE) & (k[1:] < SPACE) | (k[:-1] == SPACE) & (k[1:] == OTHER) | (k[:-1] == SPACE) & (k[1:] == UNKNOWN))
            first[last] = True
            first[last[c[last] == 0x20] + 1] = False
            quote = quote[~((c[quote - 1] == 0x20) & (quote > 0))]
        if len(quote):
            end = self._contractions(quote, after)
            hit = end > 0
            q, e = quote[hit], end[hit]
            inner = e - q
            for j in range(1, 3):
                first[q[inner > j] + j] = False
            first[q] = True
            first[e[k[e] == LETTER]] = True
        if len(after):
            first[after] = True
        start = np.flatnonzero(first)
        end = np.r_[start[1:], n]
        keep = k[start] <= UNKNOWN
        if kind == "word":
            keep &= k[start] != SPACE
        self.start, self.end = start[keep], end[keep]
        self.hashes = span_hashes(_tables["code"][c], self.start, self.end)
        self.bounds = np.r_[0, np.searchsorted(self.start, after)]

    def _contractions(self, at: np.ndarray, after: np.ndarray) -> np.ndarray:
        """Where the contraction that begins at each apostrophe ends; 0 where none does. S t re ve m ll d."""
        c = self.chars
        one, two = c[np.minimum(at + 1, len(c) - 1)], c[np.minimum(at + 2, len(c) - 1)]
        end = np.zeros(len(at), np.int64)
        for a in "stmd":
            end[one == ord(a)] = 2
        for a, b in ("re", "ve", "ll"):
            end[(one == ord(a)) & (two == ord(b))] = 3
        return np.where(end > 0, at + end, 0)

    def spelled(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 bytes of the chosen words, one after the other, and the bytes of each."""
        lengths = self.end[words] - self.start[words]
        c = self.chars[ragged(self.start[words], lengths)]
        wide = 1 + (c >= 0x80).astype(np.int64) + (c >= 0x800) + (c >= 0x10000)
        ends = np.r_[0, np.cumsum(wide)][np.cumsum(lengths)]
        return np.frombuffer(c.tobytes().decode("utf-32-le").encode(), np.uint8), np.diff(ends, prepend=0)


def prepared(text: str) -> str:
    """What the ``word`` tokenizer reads: composed (NFC), lower case letter by letter. White space needs no change, it only parts words."""
    if text.isascii():
        return text.lower()
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
