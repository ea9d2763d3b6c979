"""Quality classifier: random-indexing vectors pooled per document, then a two-layer network, calibrated.

A token (between white space) gives three units: its lower-case form, its shape (letters, digits and marks with runs
collapsed) and whether its three-token window came before in the text. Every unit has a fixed sparse random index
vector; a unit's context vector is the sum of the index vectors around it, its own included, over the texts learned
from. A document is the mean context vector of each kind of unit, and two dense layers give a logit; a temperature
chosen on rows kept back makes it a probability.

At most about SAMPLE labelled rows of the classes are learned from, chosen by a hash of the id (of one id's texts
the least); classes are weighed back to their shares. Vectors live in hash buckets, so the model has one size whatever the input. Scoring
covers every whole text. Null and empty texts pool to zero; equal texts score equally; null ids are never learned
from; other columns are ignored; an empty table gives an empty result. Without labelled rows of both classes every
score is 0.5.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, lower_ascii, mix, span_hashes, text_chunks, word_spans
from .toxicity import sampled

BUCKETS_BITS = 15
DIMENSIONS = 24
NONZERO = 4
WINDOW = 2
HIDDEN = 16
#: Labelled rows learned from: of class 0 and of class 1.
SAMPLE = (2500, 2500)
KINDS = 3


class Model(NamedTuple):
    first: np.ndarray  # (KINDS, buckets, HIDDEN): context vectors after the first layer
    first_bias: np.ndarray
    second: np.ndarray
    second_bias: float
    temperature: float


def _index_vectors() -> np.ndarray:
    rng = np.random.default_rng(5)
    out = np.zeros((1 << BUCKETS_BITS, DIMENSIONS), np.float32)
    for _ in range(NONZERO):
        out[np.arange(len(out)), rng.integers(0, DIMENSIONS, len(out))] += rng.choice(np.array([-1, 1], np.float32), len(out))
    return out


def units(data: np.ndarray, offsets: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Bucket numbers of each token's units, by kind, and the tokens before each document."""
    starts, ends, bounds = word_spans(data, offsets)
    shift = np.uint64(64 - BUCKETS_BITS)
    if not len(starts):
        return [np.zeros(0, np.int32)] * KINDS, bounds
    low = lower_ascii(data)
    words = span_hashes(low, starts, ends)
    shape = data.copy()
    shape[((data >= 97) & (data <= 122)) | (data >= 128)] = 97
    shape[(data >= 65) & (data <= 90)] = 65
    shape[(data >= 48) & (data <= 57)] = 48
    keep = np.ones(len(shape), bool)
    keep[1:] = shape[1:] != shape[:-1]
    keep[starts] = True
    place = np.concatenate([[0], np.cumsum(keep)])
    shapes = span_hashes(shape[keep], place[starts], place[ends])
    doc = np.repeat(np.arange(len(offsets) - 1, dtype=np.int64), np.diff(bounds))
    state = np.zeros(len(words), np.uint64)
    if len(words) > 2:
        window = mix(words[:-2] + words[1:-1] * np.uint64(0x9E3779B97F4A7C15) + words[2:] * np.uint64(0xC2B2AE3D27D4EB4F) + doc[2:].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        order = np.argsort(window, kind="stable")
        again = np.zeros(len(window), bool)
        again[order[1:]] = window[order[1:]] == window[order[:-1]]
        state[2:] = np.where(doc[2:] == doc[:-2], again.astype(np.uint64) + np.uint64(1), np.uint64(0))
    return [(mix(x + np.uint64(k)) >> shift).astype(np.int32) for k, x in enumerate((words, shapes, state))], bounds


def _pooled(table: np.ndarray, at: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Mean row of ``table`` over each document's units."""
    out = np.zeros((len(bounds) - 1, table.shape[1]), np.float64)
    step = 1 << 18
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    for a in range(0, len(at), step):
        d = doc[a : a + step]
        edge = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]]))
        out[d[edge]] += np.add.reduceat(table[at[a : a + step]], edge, axis=0)
    return out / np.maximum(np.diff(bounds), 1)[:, None]


def context_vectors(rows: list[tuple[list[np.ndarray], np.ndarray]]) -> np.ndarray:
    """(KINDS, buckets, DIMENSIONS): summed index vectors around each unit, scaled to unit length."""
    index = _index_vectors()
    out = np.zeros((KINDS, len(index), DIMENSIONS), np.float32)
    for kinds, bounds in rows:
        doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        for k, at in enumerate(kinds):
            np.add.at(out[k], at, index[at])
            for gap in range(1, WINDOW + 1):
                if len(at) > gap:
                    same = doc[gap:] == doc[:-gap]
                    np.add.at(out[k], at[gap:][same], index[at[:-gap][same]])
                    np.add.at(out[k], at[:-gap][same], index[at[gap:][same]])
    return out / np.maximum(np.linalg.norm(out, axis=2, keepdims=True), 1e-9)


def train(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float, float]:
    """Two layers by Adam on four fifths of the rows; the temperature by log-loss on the rest."""
    rng = np.random.default_rng(3)
    order = rng.permutation(len(x))
    back, use = order[: max(len(x) // 5, 1)], order[max(len(x) // 5, 1) :]
    p = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    m, v, t = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p], 0

    def logits(rows):
        return np.tanh(x[rows] @ p[0] + p[1]) @ p[2] + p[3][0]

    for _ in range(60):
        for rows in np.array_split(rng.permutation(use), max(len(use) // 64, 1)):
            h = np.tanh(x[rows] @ p[0] + p[1])
            out = 1 / (1 + np.exp(-np.clip(h @ p[2] + p[3][0], -35, 35)))
            d = (out - y[rows]) * weight[rows] / len(rows)
            dh = d[:, None] * p[2] * (1 - h * h)
            grads = [x[rows].T @ dh + 1e-4 * p[0], dh.sum(0), h.T @ d + 1e-4 * p[2], np.array([d.sum()])]
            t += 1
            for i, g in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                p[i] = p[i] - 0.01 * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    z = logits(back)

    def loss(temperature: float) -> float:
        q = np.clip(1 / (1 + np.exp(-np.clip(z / temperature, -35, 35))), 1e-9, 1 - 1e-9)
        return float(-(weight[back] * (y[back] * np.log(q) + (1 - y[back]) * np.log(1 - q))).sum())

    return p[0], p[1], p[2], float(p[3][0]), min(np.geomspace(0.5, 8, 25), key=loss)


def fit(docs: DataFrame, labels: DataFrame, learnable: Column, most: tuple[int, int] = SAMPLE) -> Model | None:
    """Learn from documents with a 0/1 ``quality`` label for which ``learnable`` (over doc_id) holds."""
    marked = labels.where("doc_id is not null and quality in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("int").alias("quality")).where(learnable)
    shares = {r["quality"]: r["count"] for r in marked.groupBy("quality").count().collect()}
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sample = texts.join(F.broadcast(sampled(marked, "quality", most, ":quality")), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text")).toPandas()  # sum(most) rows or so
    sample = sample.sort_values(["doc_id", "text"]).reset_index(drop=True)
    y = sample["quality"].to_numpy(float)
    if len(set(y)) < 2:
        return None
    rows = [(kinds, bounds) for kinds, bounds in (units(data, offsets) for _, data, offsets in text_chunks(pa.array(sample["text"], pa.string())))]
    vectors = context_vectors(rows)
    x = np.concatenate([np.concatenate([_pooled(vectors[k], kinds[k], bounds) for k in range(KINDS)], axis=1) for kinds, bounds in rows])
    own = {c: max(float((y == c).sum()), 1.0) for c in (0, 1)}
    weight = np.where(y == 1, shares[1] / own[1], shares[0] / own[0])
    w1, b1, w2, b2, temperature = train(x, y, weight / weight.mean())
    d = DIMENSIONS
    return Model(np.stack([vectors[k] @ w1[k * d : (k + 1) * d] for k in range(KINDS)]).astype(np.float32), b1, w2, b2, temperature)


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, score) of each row of ``docs`` (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # one size, about 6 MB

    def run(batches):
        m = shared.value
        for batch in batches:
            out = np.full(batch.num_rows, 0.5)
            if m is not None:
                for row, data, offsets in text_chunks(batch.column(1)):
                    kinds, bounds = units(data, offsets)
                    h = np.tanh(sum(_pooled(m.first[k], kinds[k], bounds) for k in range(KINDS)) + m.first_bias)
                    logit = (h @ m.second + m.second_bias) / m.temperature
                    out[row : row + len(offsets) - 1] = 1 / (1 + np.exp(-np.clip(logit, -35, 35)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], ["doc_id", "score"])

    return bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")
