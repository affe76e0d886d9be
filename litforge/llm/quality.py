"""Operator 9: a quality score learned from trusted positives and unlabelled text.

Positive-unlabelled learning: with a class prior p, the risk is p E_P[l(+)] + max(0, E_U[l(-)] - p E_P[l(-)]), l the logistic loss; its second part is an unbiased estimate of the negatives' risk
and is kept from going below zero, in which case a step is taken to raise it. A network of one hidden layer reads FEATURES of a text's form: shares of kinds of characters, lengths of words,
sentences and lines, repetition. Neither labels, language, source nor id are inputs.

The prior is estimated first: of a plain positive-against-unlabelled model's scores, the least ratio of unlabelled to positive mass above any threshold.
It is fitted on the driver on at most SAMPLE positives and SAMPLE unlabelled rows, taken by hash of the id, both outside the held-out fold; all rows are scored.

Cases: null and empty texts are scored like any other; null ids are never used for fitting, are not held out, and are scored; labels of null quality are ignored; without any
positive or unlabelled row every score is 0.5; of rows that share an id one is fitted on and all are scored; texts of any length are read whole; other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litforge.llm.common import slices, small_batches, utf8_of
from litforge.llm.shingles import sentence_units, shingles_of, word_hashes

SAMPLE = 20_000
FOLDS = 5
THRESHOLD = 0.3
HIDDEN = 24
_groups = ["ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", "!", "?", ".", ",", "*#$%&^~=+_", "|", "<>[]{}()\\/@", "\"'-:;`", " ", "\n\r\t"]
_kind = np.full(256, len(_groups), np.uint8)
for _i, _g in enumerate(_groups):
    _kind[list(_g.encode())] = _i
KINDS = len(_groups) + 1


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.r_[np.zeros(1), np.cumsum(values, dtype=np.float64)]
    return total[offsets[1:]] - total[offsets[:-1]]


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of numbers for each text."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    kind = _kind[data]
    owner = np.repeat(np.arange(n), size)
    shares = np.bincount(owner * KINDS + kind, minlength=n * KINDS).reshape(n, KINDS)
    per = shares / np.maximum(size, 1)[:, None]
    start, end, words, bounds = sentence_units(data, offsets, whole=True)
    count = sums(words, bounds)
    units = np.diff(bounds)
    hashes, places = word_hashes(data, offsets)
    again = np.r_[False, hashes[1:] == hashes[:-1]]
    again[places[:-1][places[:-1] < len(again)]] = False
    distinct = [np.diff(shingles_of(hashes, places, k)[1]) / np.maximum(count - k + 1, 1) for k in (1, 2, 4)]
    # what stands behind and before a byte in its own text; a text's ends count as spaces
    behind, ahead = np.r_[kind[1:], 11], np.r_[11, kind[:-1]]
    full = size > 0
    behind[offsets[1:][full] - 1] = 11
    ahead[offsets[:-1][full]] = 11
    word_end = ((kind < 11) | (kind == KINDS - 1)) & (behind >= 11) & (behind <= 12)
    odd_end = word_end & ((kind == 3) | (kind == 7) | (kind == 8))
    stop_end = word_end & ((kind == 4) | (kind == 5))
    comma_end = word_end & (kind == 6)
    capital = (kind == 0) & (ahead == 0)
    each = np.maximum(count, 1)
    # the worst stretch of a text: the unit with most signs, the one with most capitals, the longest
    sign = np.r_[0, np.cumsum((kind == 3) | (kind == 7) | (kind == 8))]
    caps = np.r_[0, np.cumsum(kind == 0)]
    width = np.maximum(end - start, 1)

    def worst(x: np.ndarray) -> np.ndarray:
        out = np.zeros(n)
        some = np.flatnonzero(units)
        if len(some):
            out[some] = np.maximum.reduceat(x, bounds[some])
        return out

    wide = [worst((sign[end] - sign[start]) / width), worst((caps[end] - caps[start]) / width * (width > 12)), np.log1p(worst(words))]
    columns = [
        np.log1p(size), np.log1p(count), np.log1p(units), size / each / 10, count / np.maximum(units, 1) / 20, *distinct,
        sums(odd_end, offsets) / each, sums(stop_end, offsets) / each, sums(comma_end, offsets) / each, sums(capital, offsets) / np.maximum(size, 1), *wide, sums(again, places) / each,
    ]
    return np.column_stack([per, np.sqrt(per), *columns])


def network(x: np.ndarray, weights: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    hidden = np.tanh(x @ weights[0] + weights[1])
    return hidden, hidden @ weights[2] + weights[3][0] + x @ weights[4]


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(z / 2))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None, steps: int, seed: int = 7) -> list[np.ndarray]:
    """Weights by Adam; prior None fits positives against unlabelled rows as if those were negatives."""
    rng = np.random.default_rng(seed)
    d = positive.shape[1]
    w = [rng.normal(0, d**-0.5, (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1), np.zeros(d)]
    m, v, step = [np.zeros_like(x) for x in w], [np.zeros_like(x) for x in w], 0
    size = 2048
    for _ in range(steps):
        p, u = positive[rng.integers(len(positive), size=size)], unlabelled[rng.integers(len(unlabelled), size=size)]
        x = np.vstack([p, u])
        h, z = network(x, w)
        zp, zu = z[:size], z[size:]
        if prior is None:
            g = np.r_[sigmoid(zp) - 1, sigmoid(zu)] / size
        else:
            loss = lambda s: np.logaddexp(0, s).mean()  # noqa: E731  of calling a row negative, given its score
            rest = loss(zu) - prior * loss(zp)
            negative = np.r_[-prior * sigmoid(zp), sigmoid(zu)] / size
            g = np.r_[prior * (sigmoid(zp) - 1), np.zeros(size)] / size + negative if rest >= 0 else -negative
        back = np.outer(g, w[2]) * (1 - h * h)
        grads = [x.T @ back, back.sum(0), h.T @ g, np.array([g.sum()]), x.T @ g]
        step += 1
        for i, grad in enumerate(grads):
            grad = grad + 1e-4 * w[i]
            m[i] = 0.9 * m[i] + 0.1 * grad
            v[i] = 0.999 * v[i] + 0.001 * grad * grad
            w[i] = w[i] - 0.005 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    return w


def class_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of positives among unlabelled rows, from both sides' scores."""
    cuts = np.quantile(positive, np.linspace(0, 0.9, 91))
    p = np.array([(positive >= c).mean() for c in cuts])
    u = np.array([(unlabelled >= c).mean() for c in cuts])
    return float(np.clip(np.min(u / p), 0.02, 0.98))


class Model:
    """A fitted scorer, small enough to go to every task."""

    def __init__(self, positive: np.ndarray, unlabelled: np.ndarray):
        self.weights, self.prior = None, None
        if len(positive) and len(unlabelled):
            both = np.vstack([positive, unlabelled])
            self.mean, self.scale = both.mean(0), both.std(0) + 1e-6
            p, u = self.standard(positive), self.standard(unlabelled)
            plain = fit(p[::2], u[::2], None, 600)
            self.prior = class_prior(network(p[1::2], plain)[1], network(u[1::2], plain)[1]) if len(p) > 1 and len(u) > 1 else 0.5
            self.weights = fit(p, u, self.prior, 1200)

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6)

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), 0.5) if self.weights is None else sigmoid(network(self.standard(x), self.weights)[1])


def held_out(column: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def gathered(docs: DataFrame, ids: DataFrame) -> np.ndarray:
    """Features of the documents with some ids, SAMPLE at most, in order of id; of rows that share an id, one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            x = features(*utf8_of(part.column("text")))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "x"])

    one = docs.join(F.broadcast(ids), "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    rows = one.mapInArrow(run, "doc_id long, x binary").collect()
    return np.array([np.frombuffer(x) for _, x in sorted((r["doc_id"], bytes(r["x"])) for r in rows)])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """docs: doc_id, text; labels: doc_id, quality."""
    pick = lambda ids: ids.distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    usable = labels.filter("doc_id is not null").filter(~held_out())
    positive = pick(usable.filter("quality = 1").select(F.col("doc_id").cast("long")))
    free = docs.select("doc_id").filter("doc_id is not null").filter(~held_out())
    unlabelled = pick(free)
    return Model(gathered(docs, positive), gathered(docs, unlabelled))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(model.score(features(*utf8_of(part.column("text")))))], ["doc_id", "score"])

    return docs.mapInArrow(run, "doc_id long, score double")


def quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted."""
    small_batches(docs.sparkSession)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    out = scored(rows, train(rows, labels))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that are not rejected, all their columns as they were. Scores are computed beside the row, so nothing is joined."""
    spark = docs.sparkSession
    small_batches(spark)
    model = train(docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")), labels)
    text = docs.columns.index("text")
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, f"c{text}"):
            yield part.filter(pa.array(model.score(features(*utf8_of(part.column(text)))) >= threshold))

    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
