"""Small models fitted on the driver from bounded samples."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tables


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 1.0, steps: int = 40) -> np.ndarray:
    """Weights and, last, the intercept of a ridge logistic regression, by Newton's method."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    ridge = np.full(len(w), l2)
    ridge[-1] = 1e-3
    for _ in range(steps):
        p = sigmoid(x @ w)
        step = np.linalg.solve(x.T * (p * (1 - p) + 1e-9) @ x + np.diag(ridge), x.T @ (y - p) - ridge * w)
        size = np.abs(step).max()
        w = w + step * min(1.0, 4.0 / max(size, 1e-12))
        if size < 1e-6:
            break
    return w


#: Cost of all sampled texts together, in bytes unless a fit says otherwise.
SAMPLE_BYTES = 64 << 20


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, held_out, rows: int, cost=F.octet_length) -> DataFrame:
    """At most ``rows`` labelled documents (doc_id, text, y), whole, chosen by a hash of their id and none held out.

    Only labels of 0 or 1 count; of an id with several labels the largest, of one with several texts
    the one of the smallest hash.  The sample's ids are bounded by ``rows``, so they are broadcast; the
    texts are stored for the fit's passes.  Where all texts together cost more than ``SAMPLE_BYTES``,
    those that no longer fit, in the order of the hash, are left out.
    """
    y = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    chosen = y.orderBy(F.xxhash64("doc_id", F.lit(17)), "doc_id").limit(rows)
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen.withColumn("doc_id", F.col("doc_id").cast("long"))), "doc_id")
    one = texts.groupBy("doc_id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("doc_id", "text", "y")
    sample = tables.stored(one, "sample")
    sizes = sample.select("doc_id", F.coalesce(cost(F.col("text")), F.lit(0)).alias("n"), F.xxhash64("doc_id", F.lit(17)).alias("h")).collect()
    held, out = 0, []
    for r in sorted(sizes, key=lambda r: (r.h, r.doc_id)):
        if held + r.n > SAMPLE_BYTES:
            out.append(r.doc_id)
        else:
            held += r.n
    return sample.where(~F.col("doc_id").isin(out)) if out else sample


def remainder(divisor: int, value: int):
    """Whether crc32 of the id as text leaves ``value``; false for a null id."""
    return lambda doc_id: F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % divisor == value, F.lit(False))
