"""Shared helpers of the training-data operators: checkpoints, vectorised text hashing, connected components."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: White space of every word rule here: the blank and the five ASCII controls from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
#: Bytes of text that one vectorised step handles; it bounds a worker's temporary arrays.
CHUNK_BYTES = 1 << 19
#: The session's bound of an Arrow batch, and what it is set to where the session names none.
BATCH_BOUND, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_MULT = _rng.integers(1, 2**63, 64, dtype=np.uint64) * U64(2) + U64(1)


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared folder of spark.checkpoint.dir; a folder of our own only on one machine."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="ckpt-"))
    return df.checkpoint(eager=True)


def parallelism(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)


def digest_column(c: Column) -> Column:
    return F.crc32(c.cast("string"))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply, shift, exclusive-or)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_powers: dict[str, np.ndarray] = {"p": np.ones(1, np.uint64), "q": np.ones(1, np.uint64)}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["p"]) < n:
        m = max(n, CHUNK_BYTES + 1)
        for key, base in (("p", _BASE), ("q", pow(_BASE, -1, 1 << 64))):
            table = np.full(m, base, np.uint64)
            table[0] = 1
            _powers[key] = np.cumprod(table, dtype=np.uint64)
    return _powers["p"], _powers["q"]


def text_chunks(column: pa.Array | pa.ChunkedArray):
    """Split an Arrow string column into (first row, UTF-8 bytes, offsets) of about CHUNK_BYTES; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    if len(column) == 0:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = int(np.searchsorted(offsets, offsets[row] + CHUNK_BYTES, side="right")) - 1
        end = min(max(end, row + 1), len(column))
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def bounded_batches(df: DataFrame) -> DataFrame:
    """``df``, with Arrow batches of its session bounded in bytes: 10,000 rows of long texts are too much at once."""
    if df.sparkSession.conf.get(BATCH_BOUND, None) is None:
        df.sparkSession.conf.set(BATCH_BOUND, str(BATCH_BYTES))
    return df


def sliced(batches, rows: int = 1000):
    """Arrow batches of at most so many rows, so that a worker's lists stay small."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def relieved(run):
    """A worker's function over batches that gives freed memory back to the machine when its batches end.

    Workers are used again for other tasks; what an allocator keeps of one stage's arrays would add up with the next's.
    """

    def whole(batches):
        yield from run(batches)
        give_back()

    return whole


def give_back() -> None:
    """Return this process's freed memory to the machine."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only some C libraries have it
        ctypes.CDLL(None).malloc_trim(0)


def settle(spark: SparkSession) -> None:
    """Let the driver drop the plans, shuffles and broadcasts behind a cut, and give freed memory back to the machine.

    Java objects that Python names live until Python collects; Java's heap shrinks, and the files of shuffles that no
    plan needs go, when Java collects.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    give_back()


def lower_ascii(data: np.ndarray) -> np.ndarray:
    out = data.copy()
    out[(out >= 65) & (out <= 90)] += 32
    return out


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words, and the words before each document (one more entry than documents)."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    solid = np.zeros(n + 2, bool)
    solid[1:-1] = ~((data == 32) | ((data >= 9) & (data <= 13)))
    border = np.zeros(n + 1, bool)
    border[offsets[(offsets >= 0) & (offsets <= n)]] = True
    starts = np.flatnonzero(solid[1:-1] & (~solid[:-2] | border[:-1]))
    ends = np.flatnonzero(solid[1:-1] & (~solid[2:] | border[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span, from one pass of prefix sums over the chunk."""
    p, q = _power_tables(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * p[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * q[starts] + (ends - starts).astype(np.uint64) * _MULT[63])


def shingle_hashes(words: np.ndarray, bounds: np.ndarray, k: int) -> list[np.ndarray]:
    """Sorted distinct k-word shingle hashes of each document; with fewer words the whole sequence is one."""
    m = len(words) - k + 1
    if m > 0:
        total = words[:m] * _MULT[0]
        for j in range(1, k):
            total = total + words[j : j + m] * _MULT[j]
        rolled = mix(total)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(rolled[a : b - k + 1]))
        elif b > a:
            out.append(mix(np.array([np.sum(words[a:b] * _MULT[32 : 32 + b - a]) + U64(b - a)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def document_shingles(column, k: int):
    """Per document of an Arrow column: its sorted distinct shingle hashes (ASCII letters in lower case)."""
    for _, data, offsets in text_chunks(column):
        low = lower_ascii(data)
        starts, ends, bounds = word_spans(low, offsets)
        yield from shingle_hashes(span_hashes(low, starts, ends), bounds, k)


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node with an edge to another; component is the smallest node reachable.

    Alternating stars: all larger neighbours move to the smallest neighbour, then all smaller ones do. Each step
    is an aggregation and an equi-join, so a hub is pre-aggregated and its join can be split; the edges of each
    round are cut off through the shared checkpoint folder. Input columns: a, b (long); order and repeats don't
    matter, an empty input gives an empty result.
    """
    e = checkpoint(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        met = large.join(low, "u")
        small = met.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        e = checkpoint(small.distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").bitwiseAND(F.lit((1 << 31) - 1)))).first()
        if tuple(now) == state:
            break
        state = tuple(now)
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
