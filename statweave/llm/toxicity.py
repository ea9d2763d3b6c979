"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the distinct hashed words, neighbouring pairs and pairs around one word of a text, letters only, ASCII
in lower case. The learner keeps per-coordinate rates and L1 sparsity, so what scoring needs is a short sorted list of
feature numbers with weights; a dense table of fixed size is made from it in each worker.

At most about SAMPLE labelled rows of the classes are learned from, chosen by a hash of the id (of one id's texts the
one whose features come first); scoring covers every whole text. Null and empty texts have no features and score as
the intercept says; equal texts score equally; null ids are never learned from; other columns are ignored; an empty
table gives an empty result. Without labelled rows of both classes every score is 0.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, lower_ascii, mix, relieved, sliced, span_hashes, text_chunks, word_spans

BITS = 20
#: Labelled rows learned from: of class 0 and of class 1.
SAMPLE = (6000, 3000)
EPOCHS = 8
ALPHA, BETA, L1, L2 = 4.0, 1.0, 16.0, 0.0


class Model(NamedTuple):
    intercept: float
    features: np.ndarray
    weights: np.ndarray


def letter_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (runs of letters, in lower case) and the words before each document."""
    low = lower_ascii(data)
    low[~(((low >= 97) & (low <= 122)) | (low >= 128))] = 32
    starts, ends, bounds = word_spans(low, offsets)
    return span_hashes(low, starts, ends), bounds


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Feature numbers (not distinct), the document of each, and the number of documents."""
    words, bounds = letter_words(data, offsets)
    docs = len(offsets) - 1
    doc = np.repeat(np.arange(docs, dtype=np.int32), np.diff(bounds))
    shift = np.uint64(64 - BITS)
    found, owner = [(mix(words + np.uint64(1)) >> shift).astype(np.int32)], [doc]
    for gap in (1, 2):
        if len(words) > gap:
            same = doc[gap:] == doc[:-gap]
            pair = mix(words[:-gap] * np.uint64(0x9E3779B97F4A7C15) + words[gap:] * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(gap))
            found.append((pair[same] >> shift).astype(np.int32))
            owner.append(doc[gap:][same])
    return np.concatenate(found), np.concatenate(owner), docs


def sampled(rows: DataFrame, label: str, most: tuple[int, int], salt: str) -> DataFrame:
    """About so many rows of class 0 and of class 1 at most, by a hash of the id."""
    counts = {r[label]: r["count"] for r in rows.groupBy(label).count().collect()}  # classes are 0 and 1
    share = F.lit(0.0)
    for value, n in counts.items():
        share = F.when(F.col(label) == value, F.lit(min(1.0, most[value] / max(n, 1)))).otherwise(share)
    return rows.where(F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit(salt))) < share * 4294967296.0)


def fit(docs: DataFrame, labels: DataFrame, learnable: Column, most: tuple[int, int] = SAMPLE) -> Model | None:
    """Learn from documents with a 0/1 ``toxic`` label for which ``learnable`` (over doc_id) holds."""
    marked = labels.where("doc_id is not null and toxic in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic")).where(learnable)
    chosen = sampled(marked, "toxic", most, ":toxic")

    def gather(batches):
        for batch in sliced(batches):
            out = []
            for row, data, offsets in text_chunks(batch.column(2)):
                found, owner, n = features(data, offsets)
                order = np.argsort(owner, kind="stable")
                found, owner = found[order], owner[order]
                cut = np.searchsorted(owner, np.arange(n + 1))
                out += [np.unique(found[a:b]).astype(np.int32).tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["doc_id", "label", "features"])

    texts = bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # The sample's size is bounded by ``most``, so it is broadcast and the texts stay where they are.
    found = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", "text").mapInArrow(gather, "doc_id long, label int, features binary")

    def teach(batches):
        rows = []
        for batch in batches:
            rows += zip(*(batch.column(i).to_pylist() for i in range(2)), [np.frombuffer(b.as_buffer(), np.int32) for b in batch.column(2)], strict=True)
        rows.sort(key=lambda r: r[0])
        marks = np.array([label for _, label, _ in rows], np.int32)
        if len(set(marks.tolist())) == 2:
            m = learn([f for _, _, f in rows], marks)
            yield pa.RecordBatch.from_arrays([pa.array([m.intercept]), pa.array([m.features.tobytes()], pa.binary()), pa.array([m.weights.tobytes()], pa.binary())], ["intercept", "features", "weights"])

    # A worker holds the sample and learns from it; the driver gets 12 bytes a weight.
    sample = found.groupBy("doc_id", "label").agg(F.min("features").alias("features")).repartition(1)
    learned = sample.mapInArrow(relieved(teach), "intercept double, features binary, weights binary").collect()
    return next((Model(r["intercept"], np.frombuffer(r["features"], np.int32), np.frombuffer(r["weights"], np.float64)) for r in learned), None)


def learn(rows: list[np.ndarray], labels: np.ndarray) -> Model:
    """FTRL-proximal over rows of feature numbers; the last coordinate is the intercept, without L1."""
    size = 1 << BITS
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    rng = np.random.default_rng(11)

    def weights(at: np.ndarray) -> np.ndarray:
        w = (np.sign(z[at]) * L1 - z[at]) / ((BETA + np.sqrt(n[at])) / ALPHA + L2)
        w[(np.abs(z[at]) <= L1) & (at < size)] = 0.0
        if len(at) and at[-1] == size:
            w[-1] = -z[size] / ((BETA + np.sqrt(n[size])) / ALPHA)
        return w

    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            at = np.append(rows[i], size)
            w = weights(at)
            p = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35)))
            g = p - labels[i]
            rate = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - rate * w
            n[at] += g * g
    used = np.flatnonzero(np.abs(z[:size]) > L1)
    return Model(float(weights(np.array([size]))[0]), used.astype(np.int32), weights(used))


def _scores(m: Model | None, column: pa.Array) -> np.ndarray:
    total = np.zeros(len(column))
    if m is None:
        return total
    table = np.zeros(1 << BITS, np.float32)
    table[m.features] = m.weights
    for row, data, offsets in text_chunks(column):
        found, owner, n = features(data, offsets)
        hit = np.flatnonzero(table[found] != 0)
        pair = np.unique(owner[hit].astype(np.int64) << 32 | found[hit])
        total[row : row + n] = m.intercept + np.bincount(pair >> 32, table[pair & 0xFFFFFFFF], minlength=n)
    return 1.0 / (1.0 + np.exp(-np.clip(total, -35, 35)))


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, score) of each row of ``docs`` (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 12 bytes a weight, 2**BITS weights at most

    def run(batches):
        for batch in sliced(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_scores(shared.value, batch.column(1)), pa.float64())], ["doc_id", "score"])

    return bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def below(docs: DataFrame, model: Model | None, limit: float) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores below ``limit``."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches):
        for batch in sliced(batches):
            yield batch.filter(pa.array(_scores(shared.value, batch.column(at)) < limit))

    plain = bounded_batches(docs).toDF(*[f"c{i}" for i in range(len(docs.columns))])  # names with dots can't go to Python
    return plain.mapInArrow(relieved(run), plain.schema).toDF(*docs.columns)
