"""Quality classifier: a byte-level convolutional network in numpy.

A text is cut into chunks of CHUNK bytes, each read with the WIDTH - 1 bytes that follow, so chunks overlap and every position of the
text is seen. Learned filters slide over the bytes of a chunk; each filter's largest answer is the chunk's value. A document's values
are the largest and the mean over its chunks; one logistic unit combines them into a probability.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts

CHUNK, WIDTH, SIZE, FILTERS = 256, 8, 8, 16
#: The bound of the training sample: labelled documents of each class, each read as a whole.
SAMPLE = 1500
THRESHOLD = 0.3


def chunks(text: bytes) -> np.ndarray:
    """Rows of CHUNK + WIDTH - 1 bytes; the last is filled with zero bytes, and an empty text is one row of them."""
    n = max(1, -(-len(text) // CHUNK))
    raw = np.zeros(n * CHUNK + WIDTH - 1, np.uint8)
    raw[: len(text)] = np.frombuffer(text, np.uint8)
    return np.lib.stride_tricks.as_strided(raw, (n, CHUNK + WIDTH - 1), (CHUNK, 1))


@dataclass
class Model:
    embed: np.ndarray  # byte, SIZE
    filters: np.ndarray  # offset, SIZE, filter
    bias: np.ndarray
    top: np.ndarray  # largest, then mean over chunks
    shift: float

    def tables(self) -> np.ndarray:
        """What each byte at each offset adds to each filter."""
        return (self.embed @ self.filters).astype(np.float32)

    def pooled(self, x: np.ndarray, tables: np.ndarray, where: bool = False):
        """Largest answer of each filter in each chunk (and its position)."""
        out, at = np.empty((len(x), FILTERS), np.float32), np.empty((len(x), FILTERS), np.int64)
        for i in range(0, len(x), 64):
            part = x[i : i + 64]
            total = tables[0][part[:, :CHUNK]]
            for k in range(1, WIDTH):
                total += tables[k][part[:, k : k + CHUNK]]
            out[i : i + 64] = total.max(axis=1)
            if where:
                at[i : i + 64] = total.argmax(axis=1)
        return np.maximum(out + self.bias, 0), at

    def probability(self, largest: np.ndarray, mean: np.ndarray) -> np.ndarray:
        z = np.concatenate([largest, mean], axis=1) @ self.top + self.shift
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def scores(self, texts: list[bytes], tables: np.ndarray | None = None) -> np.ndarray:
        tables = self.tables() if tables is None else tables
        out = np.empty(len(texts))
        for i in range(0, len(texts), 256):
            rows = [chunks(t) for t in texts[i : i + 256]]
            size = np.array([len(r) for r in rows])
            start = np.concatenate(([0], np.cumsum(size)[:-1]))
            value, _ = self.pooled(np.concatenate(rows), tables)
            out[i : i + 256] = self.probability(np.maximum.reduceat(value, start), np.add.reduceat(value, start) / size[:, None])
        return out


def gradients(m: Model, rows: list[np.ndarray], labels: np.ndarray) -> dict:
    """Of the mean log loss over some documents, by parameter. rows: each document's chunks."""
    x, size = np.concatenate(rows), np.array([len(r) for r in rows])
    start = np.concatenate(([0], np.cumsum(size)[:-1]))
    value, at = m.pooled(x, m.tables(), True)
    largest, mean = np.maximum.reduceat(value, start), np.add.reduceat(value, start) / size[:, None]
    error = (m.probability(largest, mean) - labels) / len(rows)
    z = np.concatenate([largest, mean], axis=1)
    back = error[:, None] * m.top
    doc = np.repeat(np.arange(len(rows)), size)
    top = value == largest[doc]
    top = top / np.maximum(np.add.reduceat(top.astype(float), start), 1)[doc]  # ties share
    g = (back[doc, :FILTERS] * top + back[doc, FILTERS:] / size[doc, None]) * (value > 0)
    seen = x[np.arange(len(x))[:, None, None], at[:, :, None] + np.arange(WIDTH)]  # the bytes under each largest answer: chunk, filter, offset
    d_embed, d_filters = np.zeros_like(m.embed), np.zeros_like(m.filters)
    for k in range(WIDTH):
        b = seen[:, :, k]
        d_filters[k] = np.einsum("mfd,mf->df", m.embed[b], g)
        np.add.at(d_embed, b.ravel(), (g[:, :, None] * m.filters[k].T[None]).reshape(-1, SIZE))
    return {"embed": d_embed, "filters": d_filters, "bias": g.sum(axis=0), "top": z.T @ error, "shift": error.sum()}


def train(rows: list[np.ndarray], labels: np.ndarray, share: float, epochs: int = 12, seed: int = 3, rate: float = 0.01, decay: float = 1e-4) -> Model:
    """Adam on the log loss. rows: each document's chunks. share: of good ones among all labelled documents, to which the probabilities are shifted."""
    rng = np.random.default_rng(seed)
    m = Model(rng.normal(0, 0.5, (256, SIZE)), rng.normal(0, 0.3, (WIDTH, SIZE, FILTERS)), np.zeros(FILTERS), np.zeros(2 * FILTERS), 0.0)
    first, second, step = dict.fromkeys(vars(m), 0.0), dict.fromkeys(vars(m), 0.0), 0
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for i in range(0, len(order), 32):
            take, step = order[i : i + 32], step + 1
            for n, grad in gradients(m, [rows[k] for k in take], labels[take]).items():
                grad = grad + decay * getattr(m, n)
                first[n] = 0.9 * first[n] + 0.1 * grad
                second[n] = 0.999 * second[n] + 0.001 * grad**2
                setattr(m, n, getattr(m, n) - rate * (first[n] / (1 - 0.9**step)) / (np.sqrt(second[n] / (1 - 0.999**step)) + 1e-8))
    own = float(np.clip(labels.mean(), 1e-3, 1 - 1e-3))
    share = float(np.clip(share, 1e-3, 1 - 1e-3))
    m.shift += np.log(share / (1 - share)) - np.log(own / (1 - own))
    return m


def held_out(doc_id="doc_id"):
    """crc32 of the id as text is a multiple of 5: never trained on."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Trains on labelled documents outside the held-out fold, whole texts: at most `sample` of each class, the first by a hash of the id.

    Of rows that repeat an id the least text counts. Several labels of one id count as their smallest. Without any labelled document the model answers 0.5 or more for every text.
    """
    known = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality")).filter(~held_out())
    share = known.agg(F.avg("quality")).first()[0]
    order = [F.xxhash64("doc_id", F.lit(11)), "doc_id"]
    chosen = known.filter("quality = 0").orderBy(*order).limit(sample).union(known.filter("quality = 1").orderBy(*order).limit(sample))

    some = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most 2 * sample rows
    got = some.groupBy("doc_id").agg(F.min(F.struct(F.coalesce("text", F.lit("")).alias("text"), "quality")).alias("r")).select("doc_id", "r.*").collect()
    got.sort(key=lambda r: r["doc_id"])
    if len({r["quality"] for r in got}) < 2:
        return Model(np.zeros((256, SIZE)), np.zeros((WIDTH, SIZE, FILTERS)), np.zeros(FILTERS), np.zeros(2 * FILTERS), 0.0 if not got or got[0]["quality"] else -2.0)
    return train([chunks(r["text"].encode()) for r in got], np.array([r["quality"] for r in got], float), share)


def score(docs: DataFrame, model: Model, keep=None, threshold: float = THRESHOLD) -> DataFrame:
    """docs with `score` (0 to 1, higher: better) and `predicted` (1 if score >= threshold). Null and empty texts are scored as empty; columns of those names give way."""

    def make():
        tables = model.tables()

        def work(texts):
            s = model.scores(texts, tables)
            return [pa.array(s), pa.array((s >= threshold).astype(np.int32))]

        return work

    return map_texts(docs, make, "score double, predicted int", keep)
