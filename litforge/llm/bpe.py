"""Operator 7: byte-level BPE encoding and decoding by speculation and verification.

Words are cut into the longest vocabulary entries from the left (speculation). A cut is the true encoding if each adjacent pair would survive
if it stood alone: walking down the last merges of the left token's right edge and of the right token's left edge, no state of the two may
have a merge that comes earlier than the merge that ended that state. All pairs are checked at once with arrays (verification).
Words with a failing pair are merged exactly, and no others.

Cases: null ids pass through; an empty table gives no rows; texts may be of any length; other columns are not read, whatever their names; null text counts as empty; an empty text has no ids and decodes to an empty text; texts that hold a special token's string, or
characters newer than this Python's Unicode tables, are encoded by the library as a whole. Repeated rows give equal rows. No input row is dropped.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from litforge.llm.common import mix64, ragged, slices, small_batches, span_hashes, texts_of
from litforge.llm.encoder import ALPHABET, Encoder, encoder

NEVER = 1 << 30
_byte_code = mix64(np.arange(1, 257, dtype=np.uint64))


class SpeculativeEncoder(Encoder):
    def __init__(self, path: str, kind: str = "byte"):
        super().__init__(path, kind)
        if not self.fits:
            raise ValueError(f"{path} is no byte-level BPE file of the kind this operator verifies")
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        back = {chr(c): i for i, c in enumerate(ALPHABET)}
        size = max(max(vocab.values()), *[t["id"] for t in spec["added_tokens"]], 0) + 1
        self.rank = np.full(size, -1, np.int64)  # when a token comes into being; single bytes are there from the start
        self.left, self.right = np.arange(size), np.arange(size)
        pairs, ranks, made = np.empty(len(merges), np.int64), np.arange(len(merges)), np.empty(len(merges), np.int64)
        for r, (a, b) in enumerate(merges):
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            pairs[r], made[r] = x << 20 | y, z
            self.rank[z], self.left[z], self.right[z] = r, x, y
        order = np.argsort(pairs)
        self.pairs, self.pair_rank, self.pair_token = pairs[order], ranks[order], made[order]
        self.bytes = [b""] * size
        for t, i in vocab.items():
            self.bytes[i] = bytes(map(back.__getitem__, t))
        ordinary = [(len(b), i) for i, b in enumerate(self.bytes) if len(b) == 1 or self.rank[i] >= 0]
        for t in spec["added_tokens"]:
            self.bytes[t["id"]] = t["content"].encode()
        self.single = np.zeros(256, np.int64)
        for n, i in ordinary:
            if n == 1:
                self.single[self.bytes[i][0]] = i
        flat = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.sizes = np.fromiter(map(len, self.bytes), np.int64, size)
        self.first = np.cumsum(self.sizes) - self.sizes
        self.flat = flat
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in sorted({n for n, _ in ordinary if n > 1}):
            ids = np.array([i for m, i in ordinary if m == n])
            h = span_hashes(_byte_code[flat], self.first[ids], self.first[ids] + n)
            o = np.argsort(h)
            self.by_length[n] = h[o], ids[o]

    def speculate(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Longest vocabulary entry at each place, word by word: (ids, ids per word)."""
        codes = _byte_code[data]
        at, words = starts.copy(), np.arange(len(starts))
        found: list[tuple[np.ndarray, np.ndarray]] = []
        while len(words):
            token, open_ = self.single[data[at[words]]], np.ones(len(words), bool)
            room = ends[words] - at[words]
            for n in sorted(self.by_length, reverse=True):
                some = np.flatnonzero(open_ & (room >= n))
                if not len(some):
                    continue
                h, ids = self.by_length[n]
                place = at[words[some]]
                key = span_hashes_at(codes, place, n)
                row = np.minimum(np.searchsorted(h, key), len(h) - 1)
                hit = h[row] == key
                token[some[hit]] = ids[row[hit]]
                open_[some[hit]] = False
            found.append((words, token))
            at[words] += self.sizes[token]
            words = words[at[words] < ends[words]]
        owner = np.concatenate([w for w, _ in found])
        ids = np.concatenate([t for _, t in found])
        order = np.argsort(owner, kind="stable")
        return ids[order], np.bincount(owner, minlength=len(starts))

    def merge_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 20 | b
        row = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[row] == key, self.pair_rank[row], NEVER)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether each pair of tokens, standing alone, stays a pair. Of two equal tokens the left one was made first, so the right one is undone first."""
        ok = np.ones(len(a), bool)
        live = np.arange(len(a))
        x, y = a.copy(), b.copy()
        limit, last_right = np.full(len(a), NEVER), np.zeros(len(a), bool)
        while len(live):
            r = self.merge_rank(x, y)
            # a merge of the two at the rank of the merge that ended the state comes first only if it lies further left
            bad = (r < limit) | (r == limit) & last_right & (r < NEVER)
            ok[live[bad]] = False
            go = ~bad & ((self.rank[x] >= 0) | (self.rank[y] >= 0))
            live, x, y = live[go], x[go], y[go]
            undo_right = self.rank[y] >= self.rank[x]
            limit = np.where(undo_right, self.rank[y], self.rank[x])
            last_right = undo_right
            x, y = np.where(undo_right, x, self.right[x]), np.where(undo_right, self.left[y], y)
        return ok

    def merged(self, data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exact merging of many words side by side: in each round every word takes its earliest merge, wherever it occurs, from the left."""
        ids, owner = self.single[data], np.repeat(np.arange(len(sizes)), sizes)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(ids):
            rank = np.full(len(ids), NEVER)
            inner = np.flatnonzero(owner[1:] == owner[:-1])
            rank[inner] = self.merge_rank(ids[inner], ids[inner + 1])
            begins = np.flatnonzero(np.diff(owner, prepend=-1))
            least = np.repeat(np.minimum.reduceat(rank, begins), np.diff(np.r_[begins, len(ids)]))
            over = least == NEVER
            done.append((owner[over], ids[over]))
            hit = (rank == least) & ~over
            # in a run of equal tokens every second place is taken
            at = np.flatnonzero(hit)
            run = np.cumsum(np.diff(at, prepend=-2) != 1)
            take = at[(np.arange(len(at)) - np.searchsorted(run, run)) % 2 == 0]
            ids[take] = self.pair_token[np.searchsorted(self.pairs, ids[take] << 20 | ids[take + 1])]
            keep = ~over
            keep[take + 1] = False
            ids, owner = ids[keep], owner[keep]
        owner, ids = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(owner, kind="stable")
        return ids[order], np.bincount(owner, minlength=len(sizes))

    def new_words(self, data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ends = np.cumsum(sizes)
        ids, counts = self.speculate(data, ends - sizes, ends)
        owner = np.repeat(np.arange(len(sizes)), counts)
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        pair = ids[inner] << 20 | ids[inner + 1]
        distinct, index = np.unique(pair, return_inverse=True)
        good = self.compatible(distinct >> 20, distinct & 0xFFFFF)[index]
        failing = np.unique(owner[inner[~good]])
        self.proposed = getattr(self, "proposed", 0) + len(sizes)
        self.failed = getattr(self, "failed", 0) + len(failing)
        if not len(failing):
            return ids.astype(self.width), counts.astype(np.int32)
        exact, lengths = self.merged(data[ragged((ends - sizes)[failing], sizes[failing])], sizes[failing])
        first = np.cumsum(counts) - counts
        fixed = counts.copy()
        fixed[failing] = lengths
        out = np.empty(int(fixed.sum()), self.width)
        begin = np.cumsum(fixed) - fixed
        kept = np.ones(len(sizes), bool)
        kept[failing] = False
        out[ragged(begin[kept], fixed[kept])] = ids[ragged(first[kept], counts[kept])]
        out[ragged(begin[failing], fixed[failing])] = exact
        return out, fixed.astype(np.int32)

    def decode(self, ids: np.ndarray) -> str:
        """Text of some ids, special tokens kept; bytes that are no UTF-8 become U+FFFD."""
        return self.raw(ids).decode("utf-8", "replace")

    def raw(self, ids: np.ndarray) -> bytes:
        return self.flat[ragged(self.first[ids], self.sizes[ids])].tobytes()


def span_hashes_at(codes: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """Like span_hashes, for spans of one short length: computed from each span alone."""
    from litforge.llm.common import powers

    forth, _ = powers(n + 1)
    total = np.zeros(len(starts), np.uint64)
    for i in range(n):
        total += codes[starts + i] * forth[i]
    return mix64(total + np.uint64(n))


def encode_decode(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: the ids' number and digest, and the digest of the text decoded from them. Nothing is shuffled."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, "byte", SpeculativeEncoder)
        for part in slices(batches, "text"):
            ids, bounds = enc.encode(texts_of(part.column("text")))
            wide, lengths = ids.astype("<u4"), enc.sizes[ids]
            raw = enc.flat[ragged(enc.first[ids], lengths)].tobytes()
            cut = np.r_[0, np.cumsum(lengths)][bounds].tolist()
            memory, b = memoryview(wide).cast("B"), (bounds * 4).tolist()
            shas, decoded = [], []
            for i in range(len(b) - 1):
                shas.append(hashlib.sha256(memory[b[i] : b[i + 1]]).hexdigest())
                piece = raw[cut[i] : cut[i + 1]]
                decoded.append(hashlib.sha256(piece.decode("utf-8", "replace").encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([part.column(id_column), pa.array(np.diff(bounds)), pa.array(shas), pa.array(decoded)], [id_column, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_column].dataType.simpleString()
    picked = docs.select(id_column, docs[text_column].cast("string").alias("text"))
    return picked.mapInArrow(run, f"{id_column} {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
