"""Quality classifier: a linear-chain conditional random field labels every line of a text good or bad.

A line's features are shares of kinds of bytes, lengths, words that say the one before again, how it begins and ends, and whether it was there before, its own
and those of the lines beside it. Each line of a training document has its document's label. Forward-backward gives every
line's marginal; their mean, weighted by the lines' bytes, becomes the document's quality by a logistic curve fitted to
the training documents.

Training is a classifier's fit on a bounded sample: labelled documents, about SAMPLE of them, chosen by a hash of the id, each with
LINES successive lines, at a place that the hash gives, if it has more; the curve sees the same documents as a whole. Null texts count as
empty ones, which are one empty line; repeated rows and ties are scored one by one; very long texts are scored as a whole; an empty table
gives no rows. Without labels, every score is 0.5. Only ``doc_id`` and ``text``, and ``doc_id`` and ``quality`` of labels, are read; labels that are
neither 0 nor 1 are left out, and of several labels of a document the lowest counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saltmarsh.llm import _vec
from saltmarsh.llm._io import table

#: Documents that training takes, about; lines of each; held-out folds; steps; the score from which a document is predicted good.
SAMPLE, LINES, FOLDS, STEPS, GOOD = 6_000, 64, 5, 120, 0.3
RATE, DECAY = 0.2, 1e-3
_UPPER, _LOWER, _DIGIT, _SPACE, _MARK, _BANG, _OTHER, _WIDE = range(8)
_KIND = np.full(256, _OTHER, np.uint8)
for _kind, _bytes in ((_UPPER, range(65, 91)), (_LOWER, range(97, 123)), (_DIGIT, range(48, 58)), (_SPACE, b"\t\r\x0b\x0c "), (_MARK, b".,;:'\"()-"), (_BANG, b"!?"), (_WIDE, range(128, 256))):
    _KIND[list(_bytes)] = _kind
#: Own features of a line; with those of both neighbours and two marks of the ends they make up its potential.
OWN = 17


def lines_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all lines, without their newlines, and the rows' offsets among them; every row has one line at least."""
    ends = np.flatnonzero(data == 10)
    row = np.searchsorted(offsets, ends, "right") - 1
    every = np.concatenate([ends, offsets[1:]])
    owner = np.concatenate([row, np.arange(len(offsets) - 1)])
    order = np.lexsort((np.r_[np.zeros(len(ends), bool), np.ones(len(offsets) - 1, bool)], every, owner))
    ends, owner = every[order], owner[order]
    at = np.searchsorted(owner, np.arange(len(offsets)))
    starts = np.r_[0, ends[:-1] + 1].astype(np.int64)
    starts[at[:-1]] = offsets[:-1]
    return starts, ends, at


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lines, 3 * OWN + 2) features, the rows' offsets among the lines, and the lines' sizes in bytes."""
    starts, ends, at = lines_of(data, offsets)
    kind = _KIND[data]
    size = ends - starts
    counts = np.empty((len(starts), 8), np.float32)
    for k in range(8):
        sums = np.concatenate([[0], np.cumsum(kind == k, dtype=np.int64)])
        counts[:, k] = sums[ends] - sums[starts]
    first, last, words_at = _vec.word_spans(data, offsets)
    lettered = np.concatenate([[0], np.cumsum((kind <= _DIGIT) | (kind == _WIDE), dtype=np.int64)])
    lone = np.concatenate([[0], np.cumsum(lettered[last] == lettered[first], dtype=np.int64)])
    ended = np.concatenate([[0], np.cumsum(np.isin(kind[last - 1], (_OTHER, _BANG)), dtype=np.int64)]) if len(last) else np.zeros(1, np.int64)
    lo, hi = np.searchsorted(first, starts), np.searchsorted(first, ends)
    words = np.maximum(hi - lo, 1)
    full = np.maximum(size, 1)
    head, tail = (np.where(size > 0, kind[np.minimum(x, len(kind) - 1)], 255) if len(kind) else np.full(len(size), 255) for x in (starts, ends - 1))
    rolling = _vec.Rolling(data)
    hashes, word = rolling.ranges(starts, ends), rolling.ranges(first, last)
    echo = np.concatenate([[0], np.cumsum(np.r_[False, word[1:] == word[:-1]][: len(word)], dtype=np.int64)])
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    again = np.ones(len(starts), bool)
    again[np.unique(np.stack([row.astype(np.uint64), hashes]), axis=1, return_index=True)[1]] = False
    own = np.stack([
        np.ones(len(starts)), counts[:, _UPPER] / np.maximum(counts[:, _UPPER] + counts[:, _LOWER], 1), *(counts[:, k] / full for k in (_DIGIT, _SPACE, _MARK, _BANG, _OTHER, _WIDE)),
        np.minimum(np.log1p(size) / 10, 1), np.minimum((size - counts[:, _SPACE]) / words / 16, 2), (lone[hi] - lone[lo]) / words, (ended[hi] - ended[lo]) / words, (echo[hi] - echo[np.minimum(lo + 1, hi)]) / words,
        np.isin(tail, (_MARK, _BANG)), head == _UPPER, size == 0, again & (size > 0),
    ], axis=1).astype(np.float32)
    out = np.zeros((len(starts), 3 * OWN + 2), np.float32)
    out[:, :OWN] = own
    before, after = np.ones(len(starts), bool), np.ones(len(starts), bool)
    before[at[:-1]], after[at[1:] - 1] = False, False
    out[before, OWN : 2 * OWN] = own[np.flatnonzero(before) - 1]
    out[after, 2 * OWN : 3 * OWN] = own[np.flatnonzero(after) + 1]
    out[:, 3 * OWN], out[:, 3 * OWN + 1] = ~before, ~after
    return out, at, size


def marginals(logits: np.ndarray, edge: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over sequences whose lines stand at ``at``: each line's probability of good, and the expected number of
    each of the four changes between neighbours. Lines of all sequences at one place are handled together."""
    good = 1 / (1 + np.exp(-np.clip(logits, -30, 30)))
    emit = np.stack([1 - good, good], axis=1)
    move = np.exp(edge - edge.max())
    sizes = np.diff(at)
    order = np.argsort(-sizes, kind="stable")
    begin, sizes = at[:-1][order], sizes[order]
    active = np.searchsorted(-sizes, -np.arange(sizes[0] if len(sizes) else 0), "left")  # sequences longer than each place
    forth, back = emit.copy(), np.ones_like(emit)
    forth[begin] /= forth[begin].sum(axis=1, keepdims=True)
    for t in range(1, len(active)):
        here = begin[: active[t]] + t
        a = (forth[here - 1] @ move) * emit[here]
        forth[here] = a / a.sum(axis=1, keepdims=True)
    changes = np.zeros((2, 2))
    for t in range(len(active) - 1, 0, -1):
        here = begin[: active[t]] + t
        ahead = emit[here] * back[here]
        both = forth[here - 1][:, :, None] * move[None] * ahead[:, None, :]
        changes += (both / both.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        b = ahead @ move.T
        back[here - 1] = b / b.sum(axis=1, keepdims=True)
    p = forth * back
    return p[:, 1] / p.sum(axis=1), changes


@dataclass
class Model:
    """Weights of the lines' features, of changes between neighbours, and the curve from mean marginals to scores."""

    unary: np.ndarray
    edge: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def means(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """For each row the mean of its lines' marginals, weighted by their bytes."""
        x, at, size = features(data, offsets)
        p, _ = marginals(x @ self.unary, self.edge, at)
        weight = size + 1.0
        return _vec.row_sums(p * weight, at) / _vec.row_sums(weight, at)

    def score(self, means: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * log_odds(means) + self.shift, -30, 30)))


def log_odds(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def fit(x: np.ndarray, y: np.ndarray, at: np.ndarray, steps: int = STEPS) -> Model:
    """Weights by gradient steps (Adam) on the mean conditional log-likelihood of the lines' labels ``y``."""
    labels = y.astype(np.float64)
    inside = np.ones(len(y), bool)
    inside[at[:-1]] = False
    now, then = y[inside].astype(int), y[np.flatnonzero(inside) - 1].astype(int)
    seen = np.bincount(2 * then + now, minlength=4).reshape(2, 2)
    w = np.zeros(x.shape[1] + 4)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for k in range(1, steps + 1):
        p, changes = marginals(x @ w[:-4].astype(np.float32), w[-4:].reshape(2, 2), at)
        g = np.concatenate([(labels - p).astype(np.float32) @ x, (seen - changes).reshape(-1)]) / len(y) - DECAY * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w += RATE * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-9)
    return Model(w[:-4].astype(np.float32), w[-4:].reshape(2, 2))


def curve(means: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve over the log odds of mean marginals, by Newton's method."""
    x = np.stack([log_odds(means), np.ones(len(means))], axis=1)
    w = np.zeros(2)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2)
        w = w + np.clip(np.linalg.solve(h, x.T @ (y - p) - 1e-2 * w), -5, 5)
    return float(w[0]), float(w[1])


def fold(folds: int = FOLDS):
    return F.crc32(F.col("doc_id").cast("string")) % folds


def labelled(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, folds: int = FOLDS) -> DataFrame:
    """text, y, spot of about ``sample`` labelled documents outside of the held-out fold."""
    marks = labels.filter(F.col("quality").isin(0, 1) & (fold(folds) != 0)).groupBy("doc_id").agg(F.min("quality").cast("int").alias("y"))
    n = marks.count()
    spot = F.xxhash64("doc_id", F.lit(11))
    marks = marks.withColumn("spot", F.pmod(spot, F.lit(1 << 20)))
    if n > sample:
        marks = marks.filter(F.col("spot") < int(sample / n * (1 << 20)))
    return docs.select("doc_id", "text").join(F.broadcast(marks), "doc_id").select("text", "y", "spot")  # about ``sample`` rows of numbers


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, folds: int = FOLDS) -> Model | None:
    """The model; None without labelled documents. The driver gets LINES lines' features of each of the sample's documents."""
    rows = labelled(docs, labels, sample, folds)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _vec.chunks(batch):
                x, at, _ = features(*_vec.buffers(part.column("text")))
                out = []
                for k, (y, spot) in enumerate(zip(part.column("y").to_pylist(), part.column("spot").to_pylist(), strict=True)):
                    lines = int(at[k + 1] - at[k])
                    begin = at[k] + spot % max(1, lines - LINES + 1)
                    out.append((y, x[begin : min(begin + LINES, at[k + 1])].tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array([y for y, _ in out], pa.int32()), pa.array([f for _, f in out], pa.binary())], ["y", "x"])

    found = sorted((r.y, bytes(r.x)) for r in rows.mapInArrow(_vec.tidied(windows), "y int, x binary").collect())
    if not found:
        return None
    each = [np.frombuffer(f, np.float32).reshape(-1, 3 * OWN + 2) for _, f in found]
    at = np.concatenate([[0], np.cumsum([len(e) for e in each])])
    model = fit(np.concatenate(each), np.repeat([y for y, _ in found], np.diff(at)), at)
    del found, each

    def means(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _vec.chunks(batch):
                yield pa.RecordBatch.from_arrays([part.column("y"), pa.array(model.means(*_vec.buffers(part.column("text"))))], ["y", "mean"])

    points = sorted((r.y, r["mean"]) for r in rows.mapInArrow(_vec.tidied(means), "y int, mean double").collect())
    model.slope, model.shift = curve(np.array([m for _, m in points]), np.array([y for y, _ in points], float))
    return model


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, folds: int = FOLDS) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    model = train(docs, labels, sample, folds)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _vec.chunks(batch):
                score = model.score(model.means(*_vec.buffers(part.column("text")))) if model else np.full(part.num_rows, 0.5)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(score), pa.array((score >= GOOD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    held = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold(folds) == 0).alias("held_out"), "text")
    return held.mapInArrow(_vec.tidied(each), "doc_id long, held_out boolean, score double, predicted int")


def marked_lines(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, line (from 0), good: the marginal of every line of every document."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _vec.chunks(batch):
                x, at, _ = features(*_vec.buffers(part.column("text")))
                p, _ = marginals(x @ model.unary, model.edge, at)
                row = np.repeat(np.arange(part.num_rows), np.diff(at))
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(row)), pa.array(np.arange(len(row)) - at[row]), pa.array(p)], ["doc_id", "line", "good"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_vec.tidied(each), "doc_id long, line long, good double")


def query(spark, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
