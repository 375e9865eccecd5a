"""Document quality by a linear-chain conditional random field over lines.

Every line is good or bad.  Its potentials come from features of the line and of its neighbours
(shares of capitals, digits, symbols and bars, repeated words, word length, a line's length) and from
a transition matrix.  Document labels teach it: all lines of a good document are good, and for a bad
one the labels of the lines are hidden, so training maximises the likelihood with the chain's own
posterior, shifted towards bad, as their target.  A document's quality is the mean of its lines'
forward-backward marginals weighted by length, calibrated on the same sample by a logistic curve.

The fit uses a bounded sample (``SAMPLE_ROWS`` labelled documents, whole, of ``fitting.SAMPLE_BYTES``
together, a line counting as ``LINE_COST`` more); scoring reads every line of every text.

Null and empty texts count as one empty line and get the score of that; texts of line feeds only are so
many empty lines.  Very long texts are read whole, a text at a time.  Repeated rows are scored each,
equal texts alike; a score equal to the threshold is good.  Without usable labels, or with labels of one
kind only, the score is their share of good ones (0.5 without any).  Extra columns are ignored, whatever
their names, and an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fitting, tables
from .fitting import sigmoid
from .textcore import LOWER, SPACED, U64, mix, row_slices, string_buffer, words

SAMPLE_ROWS = 4000
#: What a line of the sample costs beside its bytes: its features on the driver.
LINE_COST = 256
THRESHOLD = 0.3
ROUNDS = 60
#: How much a bad document's lines lean to bad while their labels are hidden.
LEAN = 2.0

_CLASSES = np.zeros((6, 256), dtype=bool)
_CLASSES[0, 65:91] = True  # capitals
_CLASSES[1, 97:123] = _CLASSES[1, 65:91] = _CLASSES[1, 0x80:] = True  # letters
_CLASSES[2, 48:58] = True  # digits
_CLASSES[3, [ord(c) for c in "#$%&*@^~+=<>{}[]\\_"]] = True  # symbols
_CLASSES[4, [ord(c) for c in "|!"]] = True  # bars and shouts
_CLASSES[5, [ord(c) for c in ".,;:?"]] = True  # common punctuation
BASE = 14


def line_features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features and byte length of every line, and each row's first line; a row has one line at least."""
    feeds = np.flatnonzero(data == 10)
    start = np.sort(np.concatenate([offs[:-1], feeds + 1]))
    end = np.sort(np.concatenate([feeds, offs[1:]]))
    first = np.concatenate([[0], np.cumsum(1 + np.diff(np.searchsorted(feeds, offs)))])
    size = end - start
    x = np.zeros((len(start), BASE), np.float32)
    some = np.maximum(size, 1)
    for k, members in enumerate(_CLASSES):
        total = np.concatenate([[0], np.cumsum(members[data], dtype=np.int32)])
        x[:, k] = (total[end] - total[start]) / some
    w = words(data, offs, SPACED, LOWER)
    line = np.searchsorted(start, w.start, "right") - 1
    count = np.bincount(line, minlength=len(start))
    if len(line):
        again = np.concatenate([[False], (w.hash[1:] == w.hash[:-1]) & (line[1:] == line[:-1])])
        x[:, 6] = np.bincount(line[again], minlength=len(start)) / np.maximum(count, 1)
        key = np.sort(mix(w.hash + line.astype(U64) * U64(0x9E3779B97F4A7C15)))
        fresh = np.concatenate([[True], key[1:] != key[:-1]])
        if fresh.all():
            distinct = count
        else:
            _, at = np.unique(mix(w.hash + line.astype(U64) * U64(0x9E3779B97F4A7C15)), return_index=True)
            distinct = np.bincount(line[at], minlength=len(start))
        x[:, 7] = (count - distinct) / np.maximum(count, 1)
        x[:, 8] = np.minimum(np.bincount(line, weights=w.length, minlength=len(start)) / np.maximum(count, 1) / 20, 2)
    x[:, 9] = size == 0
    x[:, 10] = np.log1p(size) / 8
    x[:, 11] = x[:, 0] > 0.5 * np.maximum(x[:, 1], 1e-6)
    x[:, 12] = x[:, 3] > 0.1
    x[:, 13] = x[:, 4] > 0.03
    return x, size, first


def with_neighbours(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Each line's own features, then the line's before and the line's after, zero at a text's ends."""
    out = np.zeros((len(x), 3 * BASE + 2), np.float32)
    out[:, :BASE] = x
    out[1:, BASE : 2 * BASE] = x[:-1]
    out[:-1, 2 * BASE : 3 * BASE] = x[1:]
    out[first[:-1], BASE : 2 * BASE], out[first[1:] - 1, 2 * BASE : 3 * BASE] = 0, 0
    out[first[:-1], -2] = out[first[1:] - 1, -1] = 1
    return out


def marginals(e: np.ndarray, first: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward log odds of good per line; their sum is the marginal's.

    ``e``: log odds of the line alone; ``m[i, j]``: potential from state i to j, 0 bad and 1 good.
    All texts advance together, line by line; those that end drop out.
    """
    count = np.diff(first)
    order = np.argsort(-count, kind="stable")
    begin, count = first[:-1][order], count[order]
    alive = np.searchsorted(-count, -np.arange(1, (count[0] if len(count) else 0) + 1), "right")
    forward, backward = e.astype(np.float64).copy(), np.zeros(len(e))
    for t in range(1, len(alive)):
        at = begin[: alive[t]] + t
        before = forward[at - 1]
        forward[at] += np.logaddexp(before + m[1, 1], m[0, 1]) - np.logaddexp(before + m[1, 0], m[0, 0])
    for t in range(len(alive) - 1, 0, -1):
        at = begin[: alive[t]] + t
        after = e[at] + backward[at]
        backward[at - 1] = np.logaddexp(after + m[1, 1], m[1, 0]) - np.logaddexp(after + m[0, 1], m[0, 0])
    return forward, backward


def _pairs(forward: np.ndarray, backward: np.ndarray, e: np.ndarray, inner: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Expected transitions; ``inner``: lines that have a line after them in their text."""
    a, b = forward[inner], (e + backward)[inner + 1]
    z = np.stack([np.full(len(a), m[0, 0]), b + m[0, 1], a + m[1, 0], a + b + m[1, 1]])
    z = np.exp(z - z.max(0))
    return (z / z.sum(0)).sum(1).reshape(2, 2)


class Model:
    """Scaling, weights, transitions and calibration; small, and the same for every batch."""

    def __init__(self, prior: float):
        self.prior, self.trained = prior, False

    def fit(self, x: np.ndarray, size: np.ndarray, first: np.ndarray, y: np.ndarray) -> Model:
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-3
        x = (x - self.mean) / self.scale
        docs, lines = len(y), len(x)
        of = np.repeat(np.arange(docs), np.diff(first))
        good = y[of] == 1
        weight = np.where(good, 0.5 / max(1, good.sum()), 0.5 / max(1, (~good).sum())) * lines
        inner = np.setdiff1d(np.arange(lines), first[1:] - 1)
        w, m, bias = np.zeros(x.shape[1]), np.array([[0.5, 0.0], [0.0, 0.5]]), 0.0
        params = np.concatenate([w, [bias], m.ravel()])
        mean, square = np.zeros_like(params), np.zeros_like(params)
        for step in range(1, ROUNDS + 1):
            w, bias, m = params[:-5], params[-5], params[-4:].reshape(2, 2)
            e = x @ w + bias
            f, b = marginals(e, first, m)
            lean = e - np.where(good, -50.0, LEAN)
            tf, tb = marginals(lean, first, m)
            gap = (sigmoid(tf + tb) - sigmoid(f + b)) * weight
            pairs = _pairs(tf, tb, lean, inner, m) - _pairs(f, b, e, inner, m)
            grad = np.concatenate([x.T @ gap, [gap.sum()], pairs.ravel()]) / lines - 1e-3 * params
            mean, square = 0.9 * mean + 0.1 * grad, 0.99 * square + 0.01 * grad**2
            params = params + 0.1 * mean / (1 - 0.9**step) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
        self.w, self.bias, self.m, self.trained = params[:-5], params[-5], params[-4:].reshape(2, 2), True
        self.curve = np.array([1.0, 0.0])
        self.curve = fitting.logistic(self._summary(x, size, first), y, l2=0.1)
        return self

    def _summary(self, x: np.ndarray, size: np.ndarray, first: np.ndarray) -> np.ndarray:
        f, b = marginals(x @ self.w + self.bias, first, self.m)
        weight = size + 1e-3
        share = np.add.reduceat(sigmoid(f + b) * weight, first[:-1]) / np.add.reduceat(weight, first[:-1])
        share = np.clip(share, 1e-4, 1 - 1e-4)
        return np.column_stack([np.log(share / (1 - share)) / 4, share])

    def score(self, x: np.ndarray, size: np.ndarray, first: np.ndarray) -> np.ndarray:
        if not self.trained:
            return np.full(len(first) - 1, self.prior)
        s = self._summary((x - self.mean) / self.scale, size, first)
        return sigmoid(s @ self.curve[:-1] + self.curve[-1])


def _sample_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offs = string_buffer(batch.column(0))
        xs, sizes = [], []
        for a, b in row_slices(offs):
            x, size, first = line_features(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
            for i in range(b - a):
                s = slice(first[i], first[i + 1])
                xs.append(x[s].tobytes())
                sizes.append(size[s].astype(np.int64).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(xs, pa.binary()), pa.array(sizes, pa.binary())], ["y", "x", "size"])


def _cost(text):
    return F.octet_length(text) + LINE_COST * (1 + F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))))


def fit(documents: DataFrame, labels: DataFrame, held_out) -> Model:
    """The model of the labelled documents that are not held out."""
    sample = fitting.labelled_sample(documents, labels, "quality", held_out, SAMPLE_ROWS, _cost)
    rows = sample.select("text", "y", "doc_id").orderBy("doc_id", "text").select("text", "y").mapInArrow(_sample_lines, "y int, x binary, size binary").collect()
    y = np.array([r.y for r in rows], np.int64)
    model = Model(float(y.mean()) if len(y) else 0.5)
    if len(set(y.tolist())) < 2:
        return model
    xs = [np.frombuffer(r.x, np.float32).reshape(-1, BASE) for r in rows]
    first = np.concatenate([[0], np.cumsum([len(x) for x in xs])])
    return model.fit(with_neighbours(np.concatenate(xs), first), np.concatenate([np.frombuffer(r.size, np.int64) for r in rows]), first, y)


def _scores(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = string_buffer(batch.column(batch.schema.get_field_index("text")))
            score = np.zeros(batch.num_rows)
            for a, b in row_slices(offs):
                x, size, first = line_features(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
                score[a:b] = model.score(with_neighbours(x, first), size, first)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], [*batch.schema.names, "score"])

    return run


HELD_OUT = fitting.remainder(5, 0)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = tables.read(spark, sf_dir, "documents"), tables.read(spark, sf_dir, "labels")
    model = fit(documents, labels, HELD_OUT)
    scored = documents.select("doc_id", "text").mapInArrow(_slim(model), "doc_id long, score double")
    return scored.select("doc_id", HELD_OUT(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def _slim(model: Model):
    score = _scores(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in score(batches):
            yield batch.select(["doc_id", "score"])

    return run


def kept(model: Model):
    """For mapInArrow over whole rows: those of documents that are good enough."""
    score = _scores(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in score(batches):
            yield batch.filter(pa.compute.greater_equal(batch.column(batch.num_columns - 1), THRESHOLD)).select(list(range(batch.num_columns - 1)))

    return run
