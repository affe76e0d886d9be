"""Whole texts to token ids by a public tokenizer file. Words are found and counted with arrays; the tokenizers library encodes each distinct word once."""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa

from litforge.llm.common import ragged
from litforge.llm.pretokens import Words, prepared

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")


def byte_alphabet() -> np.ndarray:
    """Code point that stands for each byte in a byte-level vocabulary: itself where it is printable Latin-1, else the next free one from 256 on."""
    plain = np.zeros(256, bool)
    for lo, hi in (("!", "~"), ("¡", "¬"), ("®", "ÿ")):
        plain[ord(lo) : ord(hi) + 1] = True
    return np.where(plain, np.arange(256), 255 + np.cumsum(~plain)).astype(np.uint32)


ALPHABET = byte_alphabet()


def byte_letters(data: np.ndarray, sizes: np.ndarray) -> list[str]:
    """Each word spelled in the letters of a byte-level vocabulary."""
    out = np.full(len(data) + len(sizes), 0x0A, np.uint32)
    out[np.arange(len(data)) + np.repeat(np.arange(len(sizes)), sizes)] = ALPHABET[data]
    return out.tobytes().decode("utf-32-le").split("\n")[:-1]


#: Fixed values of the two tokenizers whose words pretokens.py finds: normalizer and pre-tokenizer of the file.
KINDS = {
    "byte": (None, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}),
    "word": (
        {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
        {
            "type": "Sequence",
            "pretokenizers": [
                {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
                {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
            ],
        },
    ),
}


class WordTable:
    """Known words by hash, with their ids in one flat array. Beyond ``most`` words it starts anew, which costs time and changes nothing."""

    def __init__(self, most: int = 1_500_000, width: type = np.uint16):
        self.most, self.width = most, width
        self.clear()

    def clear(self) -> None:
        self.hashes, self.first, self.count = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.ids, self.used = np.zeros(1 << 16, self.width), 0

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row of each hash in the table, and whether it is there."""
        if not len(self.hashes):
            return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        row = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return row, self.hashes[row] == hashes

    def add(self, hashes: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        if len(self.hashes) + len(hashes) > self.most:
            self.clear()
        if self.used + len(ids) > len(self.ids):
            self.ids = np.r_[self.ids, np.zeros(max(len(self.ids), len(ids)), self.width)]
        self.ids[self.used : self.used + len(ids)] = ids
        order = np.argsort(hashes)
        first = (self.used + np.cumsum(counts) - counts)[order]
        at = np.searchsorted(self.hashes, hashes[order])
        self.hashes, self.first, self.count = np.insert(self.hashes, at, hashes[order]), np.insert(self.first, at, first), np.insert(self.count, at, counts[order])
        self.used += len(ids)


class Encoder:
    """``encode(texts)`` gives (ids, bounds): all ids, as 16-bit integers where the vocabulary fits, else 32-bit ones, and the n+1 places where texts begin; equal to the library's encode
    without special tokens added. A file whose normalizer and pre-tokenizer are not those of its kind is left to the library, text by text."""

    def __init__(self, path: str, kind: str):
        from tokenizers import Tokenizer

        self.library, self.kind = Tokenizer.from_file(path), kind
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.fits = kind in KINDS and (spec["normalizer"], spec["pre_tokenizer"]) == KINDS[kind] and spec["model"]["type"] == "BPE"
        self.library.no_padding()
        self.library.no_truncation()
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.mark = "<|" if all("<|" in s for s in self.special) else ""
        self.width = np.uint16 if max(self.library.get_vocab().values(), default=0) < 1 << 16 else np.uint32
        self.words = WordTable(width=self.width)

    def whole(self, text: str) -> np.ndarray:
        """By the library alone."""
        return np.array(self.library.encode(text, add_special_tokens=False).ids, self.width)

    def new_words(self, data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words, flat, and how many each has. data: their UTF-8 bytes, one word after the other; sizes: bytes of each."""
        found = list(map(self.library.model.tokenize, byte_letters(data, sizes)))
        counts = np.fromiter(map(len, found), np.int32, len(found))
        return np.fromiter((t.id for x in found for t in x), self.width, int(counts.sum())), counts

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if not self.fits:
            parts = [self.whole(t) for t in texts]
            return np.concatenate([*parts, np.zeros(0, self.width)]), np.r_[0, np.cumsum([len(p) for p in parts])].astype(np.int64)
        odd = {i for i, t in enumerate(texts) if self.mark in t and any(s in t for s in self.special)}
        plain = ["" if i in odd else prepared(t) if self.kind == "word" else t for i, t in enumerate(texts)] if odd or self.kind == "word" else texts
        w = Words(plain, self.kind)
        odd.update(np.flatnonzero(w.strange).tolist())
        distinct = pa.array(w.hashes).dictionary_encode()
        keys, index = distinct.dictionary.to_numpy(), distinct.indices.to_numpy(zero_copy_only=False)
        row, known = self.words.find(keys)
        if not known.all():
            if len(self.words.hashes) + len(keys) > self.words.most:
                self.words.clear()
                known[:] = False
            at = np.zeros(len(keys), np.int64)
            at[index[::-1]] = np.arange(len(index))[::-1]
            new = np.flatnonzero(~known)
            self.words.add(keys[new], *self.new_words(*w.spelled(at[new])))
            row, known = self.words.find(keys)
        first, count = self.words.first[row][index], self.words.count[row][index].astype(np.int64)
        ids = self.words.ids[ragged(first, count)]
        bounds = np.r_[0, np.cumsum(count)][w.bounds]
        if odd:
            parts = [self.whole(t) if i in odd else ids[bounds[i] : bounds[i + 1]] for i, t in enumerate(texts)]
            return np.concatenate([*parts, np.zeros(0, self.width)]), np.r_[0, np.cumsum([len(p) for p in parts])]
        return ids, bounds


_encoders: dict[tuple, Encoder] = {}


def encoder(path: str, kind: str, of: type = Encoder) -> Encoder:
    """One encoder for each worker process and file."""
    key = (path, kind, of)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = of(path, kind)
    return _encoders[key]
