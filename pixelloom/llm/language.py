"""Language identification by a byte convolutional network.

A text is cut into windows of WINDOW bytes, all of them, the last padded.  Filters of
several widths run over the bytes of a window, each filter's largest response is kept
(max pooling), and a softmax layer on those gives the window's logits.  The text's
logits are the mean of its windows' logits weighted by their bytes.  The network is
trained in numpy on the driver from a bounded sample of labelled windows.

Defined results: a null text or one without a letter is ``und`` with score 0.  With no
labelled text at all, every text is ``und``.  Repeated rows get the same answer.
Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, in_arrow, text_buffers, text_chunks

#: Bytes of a window.
WINDOW = 128
#: Filters of each width.
FILTERS = 8
WIDTHS = (2, 3, 4)
#: At most so many texts, and so many windows of each, are gathered for training.
SAMPLE_TEXTS = 4000
SAMPLE_WINDOWS = 8
UNKNOWN = "und"
#: A filter keeps texts whose language has at least this score.
LEAST_SCORE = 0.5

#: Byte classes: letters in one case, white space, other ASCII, the 64 bytes that continue a
#: character, and the bytes that begin one.
CLASSES = 128
PAD = 0


def _classes() -> np.ndarray:
    out = np.full(256, 2, np.int32)
    out[:33] = 1
    for k in range(26):
        out[65 + k] = out[97 + k] = 3 + k
    out[128:192] = 32 + np.arange(64)
    out[192:] = 96 + np.arange(64) // 2
    return out


CLASS_OF = _classes()


@dataclass
class LanguageModel:
    """filters[w] is (w, CLASSES, FILTERS): one table of responses for each place of a filter."""

    languages: list[str]
    filters: dict[int, np.ndarray]
    bias: np.ndarray
    dense: np.ndarray
    out_bias: np.ndarray

    def __post_init__(self) -> None:
        pair = {}
        for w, f in self.filters.items():
            for j in range(0, w - 1, 2):
                pair[w, j] = (f[j][:, None, :] + f[j + 1][None, :, :]).reshape(CLASSES * CLASSES, -1).astype(np.float32)
            if w % 2:
                pair[w, w - 1] = f[w - 1].astype(np.float32)
        self.pair = pair

    def logits(self, codes: np.ndarray) -> np.ndarray:
        """Logits of windows given as (n, WINDOW) byte classes."""
        out = np.empty((len(codes), len(self.languages)), np.float32)
        for at in range(0, len(codes), 256):
            c = codes[at : at + 256]
            p = c[:, :-1] * CLASSES + c[:, 1:]
            pooled = []
            for w in self.filters:
                n = WINDOW - w + 1
                z = None
                for j in range(0, w, 2):
                    part = np.take(self.pair[w, j], p[:, j : j + n] if j + 1 < w else c[:, j : j + n], axis=0)
                    z = part if z is None else np.add(z, part, out=z)
                while z.shape[1] > 1:  # the largest of each filter, by halves
                    half = -(-z.shape[1] // 2)
                    z = np.maximum(z[:, :half], z[:, -half:])
                pooled.append(z[:, 0])
            h = np.maximum(np.concatenate(pooled, axis=1) + self.bias, 0)
            out[at : at + 256] = h @ self.dense + self.out_bias
        return out


def windows(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(byte classes of all windows, text number of each, bytes in each); empty texts have none."""
    data, offsets = text_buffers(column)
    sizes = np.diff(offsets)
    count = -(-sizes // WINDOW)
    text = np.repeat(np.arange(len(sizes)), count)
    codes = np.zeros((len(text), WINDOW), np.int32)
    if len(text):
        base = np.concatenate([[0], np.cumsum(count)])[:-1] * WINDOW
        place = np.arange(len(data)) + np.repeat(base - offsets[:-1], sizes)
        codes.reshape(-1)[place] = CLASS_OF[data]
    filled = (codes != PAD).sum(axis=1)
    return codes, text, filled


def fit(texts: list[str], langs: list[str], epochs: int = 5, seed: int = 7) -> LanguageModel:
    """Train on windows with their language; the same rows give the same network."""
    names = sorted(set(langs))
    rng = np.random.default_rng(seed)
    total = FILTERS * len(WIDTHS)
    par = {f"f{w}": rng.normal(0, 0.15, (w, CLASSES, FILTERS)).astype(np.float32) for w in WIDTHS}
    par |= {"b": np.zeros(total, np.float32), "d": rng.normal(0, 0.2, (total, max(1, len(names)))).astype(np.float32), "o": np.zeros(max(1, len(names)), np.float32)}
    model = lambda: LanguageModel(names, {w: par[f"f{w}"] for w in WIDTHS}, par["b"], par["d"], par["o"])
    if len(names) < 2:
        return model()
    codes, text, filled = windows(pa.array(texts))
    codes, text = codes[filled >= 1], text[filled >= 1]
    place = {n: i for i, n in enumerate(names)}
    y = np.array([place[x] for x in langs])[text]
    share = len(y) / (len(names) * np.maximum(1, np.bincount(y, minlength=len(names))))
    m1 = {k: np.zeros_like(v) for k, v in par.items()}
    m2 = {k: np.zeros_like(v) for k, v in par.items()}
    size, step = 128, 0
    epochs = max(epochs, -(-1500 * size // max(1, len(y)))) if len(y) < 40_000 else epochs
    limit = 1500
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), size):
            if step >= limit:
                break
            step += 1
            pick = order[at : at + size]
            c, t = codes[pick], y[pick]
            # short texts are met too: cut a part of the windows
            if step % 3 == 0:
                c = c.copy()
                c[:, int(rng.integers(8, 64)) :] = PAD
            pooled, where = [], []
            for w in WIDTHS:
                n = WINDOW - w + 1
                z = par[f"f{w}"][0][c[:, :n]]
                for j in range(1, w):
                    z += par[f"f{w}"][j][c[:, j : j + n]]
                top = z.argmax(axis=1)
                where.append(top)
                pooled.append(np.take_along_axis(z, top[:, None, :], axis=1)[:, 0])
            raw = np.concatenate(pooled, axis=1) + par["b"]
            h = np.maximum(raw, 0)
            z = h @ par["d"] + par["o"]
            z -= z.max(axis=1, keepdims=True)
            prob = np.exp(z)
            prob /= prob.sum(axis=1, keepdims=True)
            prob[np.arange(len(t)), t] -= 1
            prob *= (share[t] / len(t))[:, None]
            grad = {"d": h.T @ prob, "o": prob.sum(axis=0)}
            back = (prob @ par["d"].T) * (raw > 0)
            grad["b"] = back.sum(axis=0)
            for k, w in enumerate(WIDTHS):
                part = back[:, k * FILTERS : (k + 1) * FILTERS]
                g = np.zeros_like(par[f"f{w}"])
                rows = np.arange(len(t))[:, None]
                for j in range(w):
                    np.add.at(g[j], (c[rows, where[k] + j], np.arange(FILTERS)[None, :]), part)
                grad[f"f{w}"] = g
            rate = 0.01 * (1 - 0.9 * step / limit)
            for k, g in grad.items():
                m1[k] = 0.9 * m1[k] + 0.1 * g
                m2[k] = 0.99 * m2[k] + 0.01 * g * g
                par[k] = (par[k] - rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return model()


def train(documents: DataFrame, where=None) -> LanguageModel:
    """Fit on documents (doc_id, text, lang): at most SAMPLE_TEXTS rows with a language and
    a letter, and SAMPLE_WINDOWS places of each.  Languages share them evenly, so that a rare one
    is learned too; of a language the rows with the smallest hash of doc_id are taken.

    ``where`` keeps rows off the sample (a held-out fold).
    """
    rows = documents.where("lang is not null and doc_id is not null").select("doc_id", "lang", "text")
    if where is not None:
        rows = rows.where(where)
    rows = rows.where(F.col("text").rlike(r"\p{L}"))
    langs = rows.groupBy(F.col("lang").alias("_lang")).agg(F.count("*").alias("_n"))
    langs = Scratch(documents.sparkSession, "language").save(langs, "langs")
    kinds = langs.count()
    if not kinds:
        return fit([], [])
    quota = max(1, SAMPLE_TEXTS // kinds)
    # the place of a row among 1 / share rows of its language, about
    place = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 40)) / F.lit(float(1 << 40)) * F.greatest(F.col("_n") / quota, F.lit(1.0))
    rows = rows.join(langs, F.col("lang") == F.col("_lang")).withColumn("_place", place).where("_place < 1.25")
    far = F.floor((F.length("text") - 1) / WINDOW).cast("int")
    places = F.transform(F.sequence(F.lit(0), F.least(far, F.lit(SAMPLE_WINDOWS - 1))), lambda k: F.floor(k * far / F.greatest(F.least(far, F.lit(SAMPLE_WINDOWS - 1)), F.lit(1))))
    parts = rows.select(
        "_place", "doc_id", "lang", F.transform(places, lambda k: F.substring(F.col("text"), (k * WINDOW + 1).cast("int"), F.lit(WINDOW))).alias("parts")
    )
    got = parts.orderBy("_place", "doc_id", "lang", "parts").limit(SAMPLE_TEXTS).collect()
    return fit([p for r in got for p in r.parts], [r.lang for r in got for _ in r.parts])


def _judge(net: LanguageModel, texts: pa.Array, letters: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(language, score) of each text."""
    lang = np.full(len(texts), UNKNOWN, object)
    best = np.zeros(len(texts))
    letter = letters.to_numpy(zero_copy_only=False).astype(bool)
    if len(net.languages):
        codes, text, filled = windows(texts)
        total = np.zeros((len(texts), len(net.languages)))
        np.add.at(total, text, net.logits(codes).astype(np.float64) * filled[:, None])
        total /= np.maximum(1, np.bincount(text, weights=filled, minlength=len(texts)))[:, None]
        total -= total.max(axis=1, keepdims=True)
        prob = np.exp(total)
        prob /= prob.sum(axis=1, keepdims=True)
        top = prob.argmax(axis=1)
        lang[letter] = np.array(net.languages, object)[top[letter]]
        best[letter] = prob[np.arange(len(top)), top][letter]
    return lang, best


def _has_letter():
    return F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("_letter")


def identify(documents: DataFrame, model: LanguageModel) -> DataFrame:
    """(doc_id, lang_pred, score) for every row of documents (doc_id, text)."""
    held = documents.sparkSession.sparkContext.broadcast(model)  # fixed size: filters and a dense layer

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in text_chunks(batch, "text", 1 << 18):
                lang, best = _judge(held.value, chunk.column(1), chunk.column(2))
                yield pa.record_batch([chunk.column(0), pa.array(lang, pa.string()), pa.array(best, pa.float64())], ["doc_id", "lang_pred", "score"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", _has_letter())
    return in_arrow(rows, run, "doc_id long, lang_pred string, score double")


def keep_identified(documents: DataFrame, model: LanguageModel, least: float = LEAST_SCORE) -> DataFrame:
    """The rows of documents whose language is known with at least the given score, unchanged."""
    held = documents.sparkSession.sparkContext.broadcast(model)
    columns = documents.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in text_chunks(batch, "text", 1 << 18):
                lang, best = _judge(held.value, chunk.column("text"), chunk.column("_letter"))
                yield chunk.filter(pa.array((lang != UNKNOWN) & (best >= least))).select(columns)

    return in_arrow(documents.select("*", _has_letter()), run, documents.schema)
