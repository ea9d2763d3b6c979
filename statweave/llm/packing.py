"""Mixture-controlled packing: deficit round-robin over source queues, planned in closed form.

Every window of ``window`` tokens takes from each source queue its target share; what a queue is owed beyond whole
tokens is its deficit, carried from window to window and from partition to partition. Instead of serving windows
one after another, the plan gives the tokens served up to any output position: within a phase in which the same
queues are alive, the first ``x`` tokens are shared out by halving the set of queues again and again. So a
document's pieces follow from its place in its queue alone, and places come from per-partition running totals plus
a window over (source, partition) totals. When a queue runs dry, a new phase shares its part among the others.

A queue is a source (null and empty are one). The plan names those with 1/1024 of the tokens or more and those with
a weight; all others are dealt by hash to at most 1024 buckets, and a bucket's part is shared among its sources by
the same halving, with numbers that travel with the sources' rows. So each source has its share of every window, and
the driver holds no list of all sources. The last tokens, fewer than a window, are cut into powers of two, which
need no padding. Null texts are empty and give the end token alone; repeated rows and ids are packed as rows of their
own; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, checkpoint, relieved, sliced

SMALLEST_SHARE = 1024
BUCKETS = 1024
#: Weight of all sources together that have none: they come, in proportion to their tokens, after the others.
UNWEIGHTED = 1e-9
#: Rows of a batch that a worker turns into pieces at once.
ROWS = 1000
#: Totals by source and partition that are broadcast; more of them are joined by a shuffle.
BROADCAST_TOTALS = 100_000
PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, source string, ids binary"


class Plan:
    """Tokens that each queue has served at output positions; all numbers are exact integers."""

    def __init__(self, totals: list[int], weights: list[float], window: int):
        self.window, self.total = window, sum(totals)
        left, self.phases, at = list(totals), [], 0
        self.outer: dict[tuple[int, int], list[int]] = {}
        while any(left):
            alive = [i for i, x in enumerate(left) if x]
            w = {i: weights[i] if weights[i] > 0 else 1e-9 for i in alive}
            first = min(alive, key=lambda i: left[i] / w[i])
            turn = left[first] / w[first]
            amount = [0] * len(left)
            for i in alive:
                amount[i] = left[i] if i == first else min(left[i], round(w[i] * turn))
            below = [0]
            for x in amount:
                below.append(below[-1] + x)
            served = [t - x for t, x in zip(totals, left, strict=True)]
            self.phases.append((at, below[-1], below, served))
            at += below[-1]
            left = [x - y for x, y in zip(left, amount, strict=True)]
        # Tail windows: powers of two.
        whole, rest = divmod(self.total, window)
        self.edges = [whole * window]
        size = 1 << max(rest.bit_length() - 1, 0)
        while rest:
            if rest >= size:
                self.edges.append(self.edges[-1] + size)
                rest -= size
            size >>= 1
        self.whole = whole

    def sequence(self, x: int) -> tuple[int, int, int]:
        """The window of an output position, its start and its end."""
        k = x // self.window
        if k < self.whole:
            return k, k * self.window, (k + 1) * self.window
        i = int(np.searchsorted(self.edges, x, side="right")) - 1
        return self.whole + i, self.edges[i], self.edges[i + 1]

    def pieces(self, queue: int, p: int, n: int, path: list[int] = ()):
        """(first token, tokens, window, offset in it) of each piece of n tokens at place p of a source.

        ``path`` has the halvings from the queue down to the source, none if the queue is the source.
        """
        done = 0
        for i, (begin, size, below, gone) in enumerate(self.phases):
            amount, base = below[queue + 1] - below[queue], gone[queue]
            if not amount or turn(path, p) >= base + amount:
                continue
            if (i, queue) not in self.outer:
                self.outer[i, queue] = halvings(below, queue)
            outer = self.outer[i, queue]
            while n and (y := turn(path, p)) < base + amount:
                k, start, end = self.sequence(begin + turn(outer, y - base))
                before, have = served(outer, max(start - begin, 0))
                ahead, will = served(outer, min(end - begin, size))
                (first, had), (last, has) = served(path, base + have), served(path, base + will)
                take = min(n, has - p)
                yield done, take, k, max(begin - start, 0) + (ahead - before) + (last - first) + (p - had)
                done, n, p = done + take, n - take, p + take
            if not n:
                return


def halvings(below: list[int], queue: int) -> list[int]:
    """The halvings of a row of queues that lead to one of them, flat: tokens, tokens of the first half, 1 for the second half."""
    lo, hi, out = 0, len(below) - 1, []
    while hi - lo > 1:
        mid = (lo + hi) // 2
        out += [below[hi] - below[lo], below[mid] - below[lo], int(queue >= mid)]
        lo, hi = (mid, hi) if queue >= mid else (lo, mid)
    return out


def served(path: list[int], x: int) -> tuple[int, int]:
    """Of the first x tokens: those of the queues before the one that the halvings lead to, and its own.

    Halving the queues again and again and giving each half the floor or the rest of its share never takes a
    served token back, and keeps each queue within a few tokens of its exact share.
    """
    before = 0
    for whole, first, second in zip(path[::3], path[1::3], path[2::3], strict=True):
        part = x * first // whole if whole else 0
        before, x = (before + part, x - part) if second else (before, part)
    return before, x


def turn(path: list[int], q: int) -> int:
    """The position at which token q of a queue is served, the inverse of ``served``; the queue must have the token."""
    for i in range(len(path) - 3, -1, -3):
        whole, first, second = path[i : i + 3]
        q = q * whole // (whole - first) if second else -(-(q + 1) * whole // first) - 1
    return q


def _paths(frame: pd.DataFrame) -> pd.DataFrame:
    """The halvings that lead to each source of a bucket."""
    frame = frame.sort_values("source")
    below = [0, *(int(x) for x in frame["n"].cumsum())]
    return pd.DataFrame({"source": frame["source"].to_numpy(), "bucket": frame["bucket"].to_numpy(), "path": [halvings(below, i) for i in range(len(frame))]})


def _encoded(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    def encode(batches):
        from pyspark import TaskContext

        from .word_bpe import load

        bpe, part, run = load(path), TaskContext.get().partitionId(), {}
        tail = np.array([end_id], bpe.dtype)
        for batch in sliced(batches, ROWS):
            blobs, sizes, places = [], [], []
            for source, ids in zip(batch.column(1).to_pylist(), bpe.encode_column(batch.column(2)), strict=True):
                blobs.append(ids.tobytes() + tail.tobytes())
                sizes.append(len(ids) + 1)
                places.append(run.get(source, 0))
                run[source] = places[-1] + sizes[-1]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([part] * len(sizes), pa.int64()), pa.array(places, pa.int64()), pa.array(sizes, pa.int64()), pa.array(blobs, pa.binary())], ["doc_id", "source", "part", "place", "n", "ids"])
        load.cache_clear()  # the tokenizer's tables are as large as all else in a worker

    return docs.mapInArrow(relieved(encode), "doc_id long, source string, part long, place long, n long, ids binary")


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, window: int = 4096, weights: dict[str, float] | None = None) -> DataFrame:
    """Pieces of ``docs`` (doc_id, source, text) in windows of ``window`` tokens; see PIECES for the columns.

    ``weights`` are the target proportions by source, by default the sources' own shares, with which all queues end
    together; sources without one come after the others. ``ids`` of a piece are little-endian unsigned 32-bit numbers.
    """
    docs = bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), F.col("text").cast("string").alias("text"))
    rows = checkpoint(_encoded(docs, tokenizer, end_id))
    totals = checkpoint(rows.groupBy("source", "part").agg(F.sum("n").alias("n")))
    total = totals.agg(F.sum("n")).first()[0] or 0
    if not total:
        return docs.sparkSession.createDataFrame([], PIECES)
    by_source = totals.groupBy("source").agg(F.sum("n").alias("n"))
    asked = {s: float(w) for s, w in (weights or {}).items() if w > 0}
    named = F.col("n") * SMALLEST_SHARE >= total
    if asked:
        named = named | F.col("source").isin(*asked)
    own = by_source.where(named).orderBy("source").collect()  # at most SMALLEST_SHARE rows, and those with a weight
    queues, sizes = [(r["source"], i) for i, r in enumerate(own)], [r["n"] for r in own]
    share = [float(n) if not weights else asked.get(r["source"], UNWEIGHTED * n / total) for r, n in zip(own, sizes, strict=True)]
    sources = docs.sparkSession.createDataFrame(queues, "source string, queue int").withColumn("path", F.lit(None).cast("array<long>"))
    if sum(sizes) < total:
        small = by_source.where(~named).withColumn("bucket", F.pmod(F.xxhash64("source"), F.lit(BUCKETS)).cast("int"))
        parts = small.groupBy("bucket").agg(F.sum("n").alias("n")).orderBy("bucket").collect()  # at most BUCKETS rows
        numbers = docs.sparkSession.createDataFrame([(r["bucket"], len(own) + i) for i, r in enumerate(parts)], "bucket int, queue int")
        paths = small.groupBy("bucket").applyInPandas(_paths, "source string, bucket int, path array<long>")
        sources = sources.unionByName(paths.join(F.broadcast(numbers), "bucket").select("source", "queue", "path"))
        sizes += [r["n"] for r in parts]
        share += [float(r["n"]) if not weights else UNWEIGHTED * r["n"] / total for r in parts]
    plan = Plan(sizes, share, window)

    order = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.withColumn("base", F.coalesce(F.sum("n").over(order), F.lit(0))).join(sources, "source").select("source", "part", "queue", "path", "base")

    if totals.count() <= BROADCAST_TOTALS:
        bases = F.broadcast(bases)

    def cut(batches):
        for batch in sliced(batches, ROWS):
            out: list[list] = [[] for _ in range(8)]
            columns = [batch.column(i).to_pylist() for i in range(7)]
            for doc, source, q, path, place, n, blob in zip(*columns, strict=True):
                ids = np.frombuffer(blob, np.dtype(f"<u{len(blob) // n}")).astype("<u4")
                for start, take, k, offset in plan.pieces(q, place, n, path or ()):
                    for column, x in zip(out, (doc, start, take, n, k, offset, source, ids[start : start + take].tobytes()), strict=True):
                        column.append(x)
            kinds = [pa.int64()] * 6 + [pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], [c.split()[0] for c in PIECES.split(", ")])

    placed = rows.join(bases, ["source", "part"]).select("doc_id", "source", "queue", "path", (F.col("base") + F.col("place")).alias("place"), "n", "ids")
    return placed.mapInArrow(relieved(cut), PIECES)
