"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes ratios.

Every hashed character n-gram (4 and 6 code points, lower-cased text) that occurs in a
text is one binary feature.  The feature's value is its naive Bayes log-count ratio;
logistic regression on those values is trained in numpy on the driver from a bounded
sample of labelled rows.  Whole texts are scored in Arrow batches.

Defined results: a null or empty text has no feature, so its score is the model's bias;
a table without both labels gives every text the share of label 1 (0 without labels).
Repeated rows are scored alike.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow

#: Lengths of character n-grams.  These, CLEAR, STEPS and SHRINK were chosen by cross-validation
#: within the rows that may be learned from.
ORDERS = (4, 6)
#: Hash table entries for each length.
BITS = 18
#: At most so many labelled rows are gathered for training.
SAMPLE_ROWS = 4000
#: At most so many code points of training text in all are gathered on the driver.
SAMPLE_CHARS = 24_000_000
THRESHOLD = 0.3
#: A feature whose log-count ratio is under so many standard errors has the value 0.
CLEAR = 4.5
#: Steps of the descent, and the weight of the squared weights in what it lowers.
STEPS, SHRINK = 300, 1e-5


@dataclass
class ToxicityModel:
    """weights[k] is the table for ORDERS[k]; the score is sigmoid(sum + bias)."""

    weights: np.ndarray
    bias: float

    def score(self, text: str | None) -> float:
        z = self.bias
        if text:
            for table, index in zip(self.weights, features(text), strict=True):
                z += float(table[index].sum())
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


_SEEN = np.zeros(1 << BITS, np.int32)


def features(text: str) -> list[np.ndarray]:
    """Distinct hashed n-grams of a text, an array for each length."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    codes[codes < 33] = 32
    edge = np.full(1, 32, np.uint64)
    codes = np.concatenate([edge, codes, edge])
    codes += np.uint64(1)
    out = []
    for n in ORDERS:
        m = len(codes) - n + 1
        if m <= 0:
            out.append(np.zeros(0, np.int64))
            continue
        h = codes[:m].copy()
        for j in range(1, n):
            h *= np.uint64(0x9E3779B97F4A7C15)
            h += codes[j : j + m]
        h *= np.uint64(0xD6E8FEB86659FD93)
        index = (h >> np.uint64(64 - BITS)).astype(np.int64)
        order = np.arange(m, dtype=np.int32)
        _SEEN[index] = order  # the last position of each entry stays
        out.append(index[_SEEN[index] == order])
    return out


def fit(texts: list[str], labels: list[int], steps: int = STEPS, l2: float = SHRINK, alpha: float = 1.0) -> ToxicityModel:
    """Train on texts with labels 0 or 1; the same rows give the same model."""
    size = 1 << BITS
    y = np.array(labels, np.float64)
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.0
        share = min(max(share, 1e-6), 1 - 1e-6)
        return ToxicityModel(np.zeros((len(ORDERS), size), np.float32), float(np.log(share / (1 - share))))
    rows, cols = [], []
    for i, text in enumerate(texts):
        for k, index in enumerate(features(text or "")):
            rows.append(np.full(len(index), i, np.int32))
            cols.append((index + k * size).astype(np.int32))
    row, col = np.concatenate(rows), np.concatenate(cols)
    width = size * len(ORDERS)
    one = np.bincount(col, weights=y[row], minlength=width) + alpha
    zero = np.bincount(col, weights=1 - y[row], minlength=width) + alpha
    ratio = np.log(one / (y.sum() + 2 * alpha)) - np.log(zero / ((1 - y).sum() + 2 * alpha))
    ratio[np.abs(ratio) < CLEAR * np.sqrt(1 / one + 1 / zero)] = 0
    value = ratio[col]
    use = value != 0
    row, value = row[use], value[use]
    kept, col = np.unique(col[use], return_inverse=True)
    width = len(kept)
    norm = np.sqrt(np.bincount(row, weights=value**2, minlength=len(y)).mean()) or 1.0
    value = (value / norm).astype(np.float32)
    weight, bias = np.zeros(width), float(np.log(y.mean() / (1 - y.mean())))
    m1, m2, b1, b2 = np.zeros(width), np.zeros(width), 0.0, 0.0
    for t in range(1, steps + 1):
        z = np.bincount(row, weights=weight[col] * value, minlength=len(y)) + bias
        gap = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)
        grad = np.bincount(col, weights=gap[row] * value, minlength=width) + l2 * weight
        m1 = 0.9 * m1 + 0.1 * grad
        m2 = 0.999 * m2 + 0.001 * grad**2
        weight -= 0.05 * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-8)
        g = gap.sum()
        b1, b2 = 0.9 * b1 + 0.1 * g, 0.999 * b2 + 0.001 * g * g
        bias -= 0.05 * (b1 / (1 - 0.9**t)) / (np.sqrt(b2 / (1 - 0.999**t)) + 1e-8)
    tables = np.zeros(size * len(ORDERS), np.float32)
    tables[kept] = weight * ratio[kept] / norm
    return ToxicityModel(tables.reshape(len(ORDERS), size), float(bias))


def train(documents: DataFrame, labels: DataFrame, where=None) -> ToxicityModel:
    """Fit on at most SAMPLE_ROWS rows of documents (doc_id, text) with labels (doc_id, toxic).

    ``where`` keeps rows off the sample (a held-out fold).  The rows are those with the
    smallest hash of doc_id, so a rerun takes the same ones.  If they have more than SAMPLE_CHARS
    characters, the longest are read up to a common limit; none is left out.
    """
    marked = labels.where(F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    marked = marked.where("doc_id is not null")
    if where is not None:
        marked = marked.where(where)
    picked = marked.withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").limit(SAMPLE_ROWS).select("doc_id", "toxic")
    rows = (
        documents.select("doc_id", "text").where("text is not null").join(F.broadcast(picked), "doc_id")
        .groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).withColumn("h", F.xxhash64("doc_id"))
    )
    longest = _level([r.n for r in rows.select(F.length("text").alias("n")).collect()], SAMPLE_CHARS)
    sample = rows.select("h", "doc_id", F.substring("text", 1, longest).alias("text"), "toxic").orderBy("h", "doc_id").collect()
    return fit([r.text for r in sample], [r.toxic for r in sample])


def _level(sizes: list[int], most: int) -> int:
    """The highest limit for which sizes, each cut to it, are at most ``most`` in all."""
    rest = len(sizes)
    for n in sorted(sizes):
        if n * rest > most:
            return most // rest
        most, rest = most - n, rest - 1
    return max(sizes, default=0)


def score(documents: DataFrame, model: ToxicityModel) -> DataFrame:
    """(doc_id, score) for every row of documents (doc_id, text)."""
    held = documents.sparkSession.sparkContext.broadcast(model)  # fixed size: ORDERS x 2**BITS floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            scores = [held.value.score(x.as_py()) for x in texts]
            yield pa.record_batch([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return in_arrow(rows, run, "doc_id long, score double")
