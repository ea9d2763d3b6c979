"""Language identification by interpolated Kneser-Ney character models.

Each language has a model of ORDER characters over letters in lower case, everything else being one blank. The
highest order counts occurrences, the lower ones the distinct characters that an n-gram follows; each order is
discounted and interpolated with the next lower one down to a uniform distribution. A model is sorted arrays of
n-gram keys with their discounted shares and of contexts with their totals and back-off weights, so its parts are
found by binary search. A text gets the language with the lowest cross-entropy per character; the score is a
softmax of the cross-entropies with a temperature fitted on rows kept back, halved when the text is further from the
language than nearly all of its own rows (``accepted`` is false then).

At most about SAMPLE_PER_LANGUAGE labelled texts of each language are learned from, chosen by a hash of the id (of
one id's texts in a language the least), and MAX_LANGUAGES languages, else an error; scoring covers every whole text. Null texts and texts without a letter are
``und`` with score 0; null ids and null languages are never learned from; equal texts score equally; other columns
are ignored; an empty table gives an empty result; without labelled rows every text is ``und``.
"""

from __future__ import annotations

from functools import cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, text_chunks

ORDER = 4
DISCOUNT = 0.75
SAMPLE_PER_LANGUAGE = 1500
MAX_LANGUAGES = 256
BLANK = 32


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For each 16-bit code, its lower case, and the blank for all but letters."""
    lower, letter = np.full(1 << 16, BLANK, np.uint16), np.zeros(1 << 16, bool)
    for i in range(1 << 16):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            lower[i] = ord(low) if len(low) == 1 and ord(low) < 1 << 16 else i
            letter[i] = True
    return lower, letter


def _folded(code: int) -> int:
    """16 bits for a character above U+FFFF, a blank if it isn't a letter and never a blank if it is one."""
    c = chr(code)
    if not c.isalpha():
        return BLANK
    low = c.lower()
    key = (ord(low) if len(low) == 1 else code) & 0xFFFF
    return key if key != BLANK else key | 0x8000


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the ORDER-grams of UTF-8 texts, 16 bits a character (letters of higher planes are folded), and the grams before each text.

    Characters before a text count as blanks; runs of blanks are one; a text without letters has no grams.
    """
    lower, letter = _tables()
    head = (data & 0xC0) != 0x80
    places = np.concatenate([[0], np.cumsum(head)])[offsets]
    codes = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)
    if len(codes) != places[-1]:  # not UTF-8: text by text
        texts = [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "replace"), np.uint32)
        places = np.cumsum([0, *map(len, texts)])
    seq = lower[(codes & 0xFFFF).astype(np.uint16)]
    high = codes > 0xFFFF
    if high.any():
        found, at = np.unique(codes[high], return_inverse=True)
        seq[high] = np.array([_folded(int(c)) for c in found], np.uint16)[at]
    first = np.zeros(len(seq) + 1, bool)
    first[places] = True
    blank = seq == BLANK
    keep = ~blank
    keep[1:] |= ~blank[:-1]
    keep[first[:-1] & blank] = False
    seq, bounds = seq[keep], np.concatenate([[0], np.cumsum(keep)])[places]
    some = np.add.reduceat(np.concatenate([seq != BLANK, [False]]).astype(np.int64), bounds[:-1]) > 0 if len(bounds) > 1 else np.zeros(0, bool)
    some &= np.diff(bounds) > 0
    place = np.arange(len(seq)) - np.repeat(bounds[:-1], np.diff(bounds))
    key = seq.astype(np.uint64)
    for k in range(1, ORDER):
        before = np.full(len(seq), BLANK, np.uint64)
        before[k:] = seq[:-k] if len(seq) > k else before[k:]
        before[place < k] = BLANK
        key |= before << np.uint64(16 * k)
    valid = np.repeat(some, np.diff(bounds))
    return key[valid], np.concatenate([[0], np.cumsum(np.where(some, np.diff(bounds), 0))])


class Level(NamedTuple):
    keys: np.ndarray
    shares: np.ndarray
    contexts: np.ndarray
    backoff: np.ndarray


def _level(keys: np.ndarray, counts: np.ndarray) -> Level:
    """Discounted shares of n-grams in their contexts, and the weight left for the lower order."""
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order].astype(float)
    contexts, at = np.unique(keys >> np.uint64(16), return_inverse=True)
    total, kinds = np.bincount(at, counts), np.bincount(at)
    return Level(keys, (counts - DISCOUNT) / total[at], contexts, DISCOUNT * kinds / total)


def kneser_ney(keys: np.ndarray, counts: np.ndarray) -> list[Level]:
    """Levels 1 to ORDER from the distinct ORDER-grams of a language and their counts."""
    levels = [_level(keys, counts)]
    current = keys
    for n in range(ORDER - 1, 0, -1):
        lower = current & np.uint64((1 << (16 * n)) - 1)
        current, follows = np.unique(lower, return_counts=True)
        levels.append(_level(current, follows))
    return levels[::-1]


def _found(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.searchsorted(table, keys)
    at[at == len(table)] = 0
    return at, table[at] == keys


def log_probabilities(levels: list[Level], keys: np.ndarray, alphabet: int) -> np.ndarray:
    p = np.full(len(keys), 1.0 / alphabet)
    for n, level in enumerate(levels, 1):
        part = keys & np.uint64((1 << (16 * n)) - 1) if n < 4 else keys
        at, seen = _found(level.keys, part)
        context, known = _found(level.contexts, part >> np.uint64(16))
        p = np.where(known, np.where(seen, level.shares[at], 0.0) + level.backoff[context] * p, p)
    return np.log2(p)


class Models(NamedTuple):
    languages: list[str]
    levels: list[list[Level]]
    alphabet: int
    temperature: float
    limits: np.ndarray


def entropies(models: Models, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cross-entropy per character of each text (rows) under each language, and its characters."""
    keys, bounds = grams(data, offsets)
    n = np.diff(bounds)
    out = np.full((len(n), len(models.languages)), np.inf)
    if len(keys):
        each, distinct = pd.factorize(keys)
        rows = np.flatnonzero(n > 0)
        for j, levels in enumerate(models.levels):
            logs = log_probabilities(levels, distinct, models.alphabet)
            out[rows, j] = -np.add.reduceat(logs[each], bounds[:-1][rows]) / n[rows]
    return out, n


def softmax(bits: np.ndarray, length: np.ndarray, temperature: float) -> np.ndarray:
    z = -bits * np.sqrt(np.maximum(length, 1))[:, None] / temperature
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


def fit(docs: DataFrame, learnable: Column, per_language: int = SAMPLE_PER_LANGUAGE) -> Models | None:
    """Learn from the rows of ``docs`` (doc_id, text, lang) with a language for which ``learnable`` (over doc_id) holds."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("doc_id is not null and lang is not null and text is not null").where(learnable)
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()}
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not counts:
        return None
    share = F.element_at(F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, per_language / n) * 4294967296.0)]), F.col("lang"))
    chosen = rows.where(F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit(":lang"))) < share)
    sample = chosen.groupBy("doc_id", "lang").agg(F.min("text").alias("text")).toPandas()  # per_language rows or so of each
    sample = sample.sort_values(["lang", "doc_id", "text"]).reset_index(drop=True)
    back = np.arange(len(sample)) % 5 == 0 if len(sample) >= 50 else np.zeros(len(sample), bool)
    languages = sorted(counts)
    parts = []
    for language in languages:
        texts = sample["text"][(sample["lang"] == language) & ~back]
        keys = [grams(data, offsets)[0] for _, data, offsets in text_chunks(pa.array(texts, pa.string()))]
        parts.append(np.unique(np.concatenate([*keys, np.zeros(0, np.uint64)]), return_counts=True))
    kept = [i for i, (k, _) in enumerate(parts) if len(k)]
    if not kept:
        return None
    languages, parts = [languages[i] for i in kept], [parts[i] for i in kept]
    alphabet = len(np.unique(np.concatenate([k & np.uint64(0xFFFF) for k, _ in parts]))) + 1
    models = Models(languages, [kneser_ney(k, c) for k, c in parts], alphabet, 1.0, np.full(len(languages), np.inf))
    if not back.any():
        return models
    test = sample[back]
    found = [entropies(models, data, offsets) for _, data, offsets in text_chunks(pa.array(test["text"], pa.string()))]
    bits, length = (np.concatenate(x) for x in zip(*found, strict=True))
    known = {name: j for j, name in enumerate(languages)}
    truth = test["lang"].map(known).to_numpy(float)
    use = (length > 0) & ~np.isnan(truth)
    bits, length, truth = bits[use], length[use], truth[use].astype(int)
    if not len(truth):
        return models

    def loss(t: float) -> float:
        return float(-np.log(np.maximum(softmax(bits, length, t)[np.arange(len(truth)), truth], 1e-9)).mean())

    own = bits[np.arange(len(truth)), truth]
    limits = np.array([np.quantile(own[truth == j], 0.99) + 1.0 if (truth == j).any() else np.inf for j in range(len(languages))])
    return models._replace(temperature=float(min(np.geomspace(0.2, 5, 30), key=loss)), limits=limits)


def identify(docs: DataFrame, models: Models | None) -> DataFrame:
    """(doc_id, lang_pred, score, accepted) of each row of ``docs`` (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(models)  # arrays of the bounded sample's n-grams

    def run(batches):
        m = shared.value
        for batch in batches:
            names, score, accepted = ["und"] * batch.num_rows, np.zeros(batch.num_rows), np.zeros(batch.num_rows, bool)
            if m is not None:
                for row, data, offsets in text_chunks(batch.column(1)):
                    bits, length = entropies(m, data, offsets)
                    at = np.flatnonzero(length > 0)
                    if not len(at):
                        continue
                    best = bits[at].argmin(1)
                    p = softmax(bits[at], length[at], m.temperature)[np.arange(len(at)), best]
                    good = bits[at, best] <= m.limits[best]
                    score[row + at], accepted[row + at] = np.where(good, p, p / 2), good
                    for i, j in zip((row + at).tolist(), best.tolist(), strict=True):
                        names[i] = m.languages[j]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(accepted)], ["doc_id", "lang_pred", "score", "accepted"])

    return bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double, accepted boolean")
