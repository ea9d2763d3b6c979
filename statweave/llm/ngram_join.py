"""N-gram Jaccard join by a token-group matrix.

Documents are sets of distinct k-word shingles. Equal sets are one node from the start. A node follows the leader with
which it shares most of its rare tokens; nodes with the same leader are a family. The followers of a large family are
compared with their leader first, one comparison a node, and what links is one part from then on: tokens that only one
part holds drop out. What is left is a matrix of rare tokens and families, with the sizes that a family holds of a token. Pairs of
families that share enough tokens are expanded to the members of the smaller one, and a member queries the other
family only if it shares enough tokens itself. A family is cut to groups of a bounded size; a group keeps the matrix
of its members' tokens over the union of them and is opened only if the query's overlap with the union can reach what
the threshold needs. No link is lost, whatever the families:

* two sets with Jaccard similarity t or more share s tokens among the first ``n - ceil(t n) + s`` of each under any
  one order of all tokens, for any s up to ``ceil(t n)``; the order here is by the count of a token's hash bucket,
  then by hash, and the counts are a table of fixed size whatever the input;
* if the two lie in different parts, each of these tokens is held by two parts;
* a member's overlap with the query is at most the query's overlap with the union;
* of two nodes in different families, one queries the other's; inside a family all but the members of its largest
  part query all, and the members of that part are connected already.

Links of an opened group are reported as a spanning forest, so a group of copies gives as many rows as it has
members, not as many as pairs.

Null or blank texts have the empty set and link with nothing; fewer than k words make one shingle; repeated rows
and repeated ids are rows of their own (a shared id joins its rows under one number, as the result is per id);
other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import bounded_batches, connected_components, document_shingles, mix, parallelism, relieved, settle, sliced

#: Buckets of the token order's count table: 4 bytes each, whatever the input's size.
ORDER_BITS = 21
#: Rare tokens that a query must share with a group: one for each SHARED_PER tokens of a set, SHARED_MOST at most.
SHARED_PER, SHARED_MOST = 64, 16
#: Bits of the map of wanted ids (1 MB).
ID_BITS = 23
#: Shingles in a group's members together; a larger set is a group of its own.
GROUP_TOKENS = 1 << 18
#: Queries of one group that one task compares; more are dealt to further copies of the group.
GROUP_QUERIES = 1024
#: Slices of the count table, each added up in a task of its own.
SLICES = 64


def checkpoint(df: DataFrame) -> DataFrame:
    """The shared checkpoint, after which the driver drops what led to it: the plans here are many and large."""
    out = common.checkpoint(df)
    settle(df.sparkSession)
    return out


def needed(n: int | np.ndarray, num: int, den: int):
    """The least overlap that a set of n tokens has with any set at similarity num/den or more."""
    return -(-n * num // den)


def to_share(n: int) -> int:
    """Rare tokens that a set of n must share with a partner; never more than ``needed``, and growing with n."""
    return max(1, min(SHARED_MOST, n // SHARED_PER))


TO_SHARE = f"greatest(1, least({SHARED_MOST}, n div {SHARED_PER}))"


def _bucket_counts(docs: DataFrame, k: int) -> np.ndarray:
    """Documents per hash bucket of their tokens; partitions send their tables in slices, which are added up."""
    size, slices = 1 << ORDER_BITS, SLICES

    def count(batches):
        table = np.zeros(size, np.int64)
        for batch in sliced(batches):
            sets = list(document_shingles(batch.column(0), k))
            tokens = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            at, often = np.unique((tokens >> np.uint64(64 - ORDER_BITS)).astype(np.int32), return_counts=True)
            table[at] += often
        if table.any():
            step = size // slices
            narrow = next(t for t in (np.uint8, np.uint16, np.uint32, np.int64) if table.max() <= np.iinfo(t).max)
            yield pa.RecordBatch.from_arrays([pa.array(range(slices), pa.int32()), pa.array([table[i * step : (i + 1) * step].astype(narrow).tobytes() for i in range(slices)], pa.binary())], ["slice", "counts"])

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = np.frombuffer(blob, {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.int64}[len(blob) * slices // size]).astype(np.int64)
                total[i] = total.get(i, 0) + part
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], ["slice", "counts"])

    schema = "slice int, counts binary"
    parts = docs.select("text").coalesce(parallelism(docs.sparkSession)).mapInArrow(relieved(count), schema)  # one table a task, however many files
    table = np.zeros(size, np.int64)
    step = size // slices
    for row in parts.repartition(slices, "slice").mapInArrow(add, schema).collect():
        table[row["slice"] * step : (row["slice"] + 1) * step] += np.frombuffer(row["counts"], np.int64)
    return np.minimum(table, 2**32 - 1).astype(np.uint32)


def _described(docs: DataFrame, k: int, num: int, den: int, table) -> DataFrame:
    """Per row: its set's size and 128-bit digest, and once per set and partition the first tokens in the common order."""

    def describe(batches):
        counts = table.value
        seen: set[bytes] = set()
        for batch in sliced(batches):
            sizes, high, low, first = [], [], [], []
            for tokens in document_shingles(batch.column(1), k):
                n = len(tokens)
                a = int(np.bitwise_xor.reduce(mix(tokens + np.uint64(n)))) if n else 0
                b = int(np.sum(mix(tokens ^ np.uint64(0x5851F42D4C957F2D)))) & (2**64 - 1) if n else 0
                sizes.append(n)
                high.append(a - (1 << 64) if a >> 63 else a)
                low.append(b - (1 << 64) if b >> 63 else b)
                key = (a << 64 | b).to_bytes(16, "little")
                if n == 0 or key in seen:
                    first.append(None)
                    continue
                seen.add(key)
                keep = n - needed(n, num, den) + to_share(n)
                often = counts[(tokens >> np.uint64(64 - ORDER_BITS)).astype(np.int64)]
                if keep < n:
                    part = np.argpartition(often, keep - 1)
                    cut = often[part[keep - 1]]
                    inside, edge = np.flatnonzero(often < cut), np.flatnonzero(often == cut)
                    chosen = np.concatenate([inside, edge[: keep - len(inside)]])
                else:
                    chosen = np.arange(n)
                first.append(tokens[chosen].view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(high, pa.int64()), pa.array(low, pa.int64()), pa.array(first, pa.list_(pa.int64()))], ["doc_id", "n", "d1", "d2", "first"])

    return docs.select("doc_id", "text").mapInArrow(relieved(describe), "doc_id long, n long, d1 long, d2 long, first array<bigint>")


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(rep, text) of the wanted documents, and of few others.

    A bitmap of the wanted ids (ID_BITS bits, whatever the input) keeps most other texts from being moved; the join
    with the wanted ids is exact. Texts take less room than their sets of hashes, so these are made where they are
    compared. A partition gives a repeated row once.
    """
    at = F.pmod("rep", F.lit(1 << ID_BITS)) + 1  # the bitmap functions count from 1
    parts = wanted.groupBy(F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")).collect()  # ID_BITS bits at most
    bitmap = np.zeros((1 << ID_BITS) // 8, np.uint8)
    for row in parts:
        lo = (row["bucket"] - 1) * 4096
        bitmap[lo : lo + len(row["bits"])] |= np.frombuffer(row["bits"], np.uint8)[: len(bitmap) - lo]
    ids = docs.sparkSession.sparkContext.broadcast(bitmap)

    def pick(batches):
        seen: set[tuple[int, int]] = set()
        for batch in sliced(batches):
            batch = batch.filter(pc.is_valid(batch.column(0)))
            at = batch.column(0).to_numpy(zero_copy_only=False) & ((1 << ID_BITS) - 1)
            batch = batch.filter(pa.array((ids.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1))
            marks = [(rep, hash(text)) for rep, text in zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True)]
            new = []
            for mark in marks:
                new.append(mark not in seen)
                seen.add(mark)
            yield pa.RecordBatch.from_arrays(batch.filter(pa.array(new, pa.bool_())).columns, ["rep", "text"])

    return docs.select("doc_id", "text").mapInArrow(relieved(pick), "rep long, text string")


def _opened(docs: DataFrame, k: int, queries: DataFrame, members: DataFrame, num: int, den: int) -> DataFrame:
    """Links (a, b) between queries (g, q) and members (g, rep) of the same group, as a forest for each group.

    Rows of a group come together in a task, members first; members (bounded by GROUP_TOKENS) are held, queries
    stream by. A group with many queries is copied, each copy for some of them.
    """
    counts = queries.groupBy("g").agg(F.count("*").alias("asked"))
    copies = F.expr(f"cast(asked div {GROUP_QUERIES} + 1 as int)")
    parts = queries.join(counts, "g").select("g", F.expr(f"pmod(xxhash64(q), asked div {GROUP_QUERIES} + 1)").cast("int").alias("copy"), F.lit(1).alias("kind"), F.col("q").alias("rep"))
    parts = parts.unionByName(members.join(counts, "g").select("g", F.explode(F.sequence(F.lit(0), copies - 1)).alias("copy"), F.lit(0).alias("kind"), "rep"))
    parts = checkpoint(parts)
    shaped = _texts(docs, parts.select("rep").distinct()).join(parts, "rep").select("g", "copy", "kind", F.col("rep").alias("id"), "text")

    def compare(batches):
        group, ids, sets, matrix, root = None, [], [], None, {}

        def find(i: int) -> int:
            while root.setdefault(i, i) != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for batch in sliced(batches, 500):
            g, c, kind, node = (batch.column(i).to_pylist() for i in range(4))
            left, right = [], []
            for at, is_query, i, tokens in zip(zip(g, c, strict=True), kind, node, document_shingles(batch.column(4), k), strict=True):
                if at != group:
                    group, ids, sets, matrix, root = at, [], [], None, {}
                if not is_query:
                    ids.append(i)
                    sets.append(tokens)
                    continue
                if not sets:
                    continue
                if matrix is None:
                    union, column = np.unique(np.concatenate(sets), return_inverse=True)
                    sizes, names = np.array([len(t) for t in sets]), np.array(ids)
                    matrix = (union, column, np.cumsum(sizes) - sizes, sizes, names)
                union, column, starts, sizes, names = matrix
                n = len(tokens)
                place = np.searchsorted(union, tokens)
                place[place == len(union)] = 0
                inside = place[union[place] == tokens]
                if len(inside) < needed(n, num, den):
                    continue  # the bound: no member can reach the similarity
                row = np.zeros(len(union), np.int32)
                row[inside] = 1
                both = np.add.reduceat(row[column], starts)
                for other in names[(den * both >= num * (n + sizes - both)) & (names != i)].tolist():
                    x, y = find(i), find(other)
                    if x != y:
                        root[max(x, y)] = min(x, y)
                        left.append(i)
                        right.append(other)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    dealt = shaped.repartition("g", "copy").sortWithinPartitions("g", "copy", "kind")
    return dealt.mapInArrow(relieved(compare), "a long, b long")


def jaccard_components(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs`` (doc_id, text); links at similarity num/den or more."""
    spark = docs.sparkSession
    docs = bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    table = spark.sparkContext.broadcast(_bucket_counts(docs, k))
    rows = checkpoint(_described(docs, k, num, den, table))
    full = rows.where("n > 0 and doc_id is not null")
    sets = full.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.first("first", ignorenulls=True).alias("first"))
    nodes = full.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"))
    posts = checkpoint(_shared(sets))
    homes = checkpoint(_followed(posts, num, den))

    # In families that are more than one group followers meet their leaders first; what links is a part.
    large = homes.groupBy("leader").agg(F.sum("n").alias("total")).where(f"total > {GROUP_TOKENS}").select("leader")
    pairs = homes.where("leader != rep").join(large, "leader")
    stars = checkpoint(_opened(docs, k, pairs.select(F.col("leader").alias("g"), F.col("rep").alias("q")), pairs.select(F.col("leader").alias("g"), F.col("leader").alias("rep")).distinct(), num, den))
    up = stars.groupBy(F.col("a").alias("rep")).agg(F.min("b").alias("part"))
    over = up.join(up.select(F.col("rep").alias("part"), F.col("part").alias("above")), "part", "left").select("rep", F.coalesce("above", "part").alias("part"))
    homes = checkpoint(homes.join(over, "rep", "left").select("rep", "n", F.col("leader").alias("family"), F.coalesce("part", "rep").alias("part")))

    asked, members = _asked(posts, homes, num, den)
    links = stars.unionByName(_opened(docs, k, asked, members, num, den))
    final = connected_components(links)
    settle(spark)

    # Back to the rows: a digest's node, and the node's component. Components are labelled by nodes, the least ids.
    label = nodes.select("d1", "d2", "rep").join(final.withColumnRenamed("node", "rep"), "rep", "left").select("d1", "d2", F.coalesce("component", "rep").alias("component_id"))
    linked = rows.where("n > 0 and doc_id is not null").select("doc_id", "n", "d1", "d2").join(label, ["d1", "d2"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = rows.where("n = 0 or doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone)


def _shared(sets: DataFrame) -> DataFrame:
    """(rep, n, tokens) of the nodes with first tokens that another node holds too, and these tokens."""
    lists = sets.select("rep", "n", F.explode("first").alias("token"))
    often = lists.groupBy("token").agg(F.count("*").alias("holders")).where("holders > 1").select("token")
    return lists.join(often, "token").groupBy("rep").agg(F.max("n").alias("n"), F.collect_set("token").alias("tokens"))


def _followed(posts: DataFrame, num: int, den: int) -> DataFrame:
    """(rep, n, leader): of a token's holders the one leads whose first tokens are shared most; itself if none does."""
    most = f"n - (n * {num} + {den - 1}) div {den} + {TO_SHARE}"
    lists = posts.select("rep", "n", F.expr(f"size(tokens) / ({most})").alias("common"), F.explode("tokens").alias("token"))
    first = lists.groupBy("token").agg(F.max(F.struct("common", (-F.col("n")).alias("n"), (-F.col("rep")).alias("rep"))).alias("x")).select("token", (-F.col("x.rep")).alias("leader"))
    votes = lists.join(first, "token").groupBy("rep", "leader").agg(F.count("*").alias("shared"), F.max("n").alias("n"))
    best = votes.groupBy("rep").agg(F.max("n").alias("n"), F.max(F.struct("shared", (-F.col("leader")).alias("leader"))).alias("x"))
    return best.select("rep", "n", F.when(F.col("x.shared") >= F.expr(TO_SHARE), -F.col("x.leader")).otherwise(F.col("rep")).alias("leader"))


def _asked(posts: DataFrame, homes: DataFrame, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """Queries (g, q) and members (g, rep) of the groups that may hold links between different parts."""
    cells = posts.select("rep", F.explode("tokens").alias("token")).join(homes, "rep")
    mixed = cells.groupBy("token").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low < high").select("token")
    cells = checkpoint(cells.join(mixed, "token"))
    inside = checkpoint(cells.select("rep", "n", "family", "part").distinct())
    parts = inside.groupBy("family", "part").agg(F.count("*").alias("held"), F.sum("n").alias("total"))
    families = checkpoint(parts.groupBy("family").agg(F.sum("held").alias("held"), F.sum("total").alias("total"), F.count("*").alias("parts"), F.max(F.struct("held", "part")).alias("top")).select("family", "held", "total", "parts", F.col("top.part").alias("top")))

    # Token-group matrix of families: the smaller of two asks, the larger is asked.
    matrix = cells.groupBy("token", "family").agg(F.min("n").alias("least"), F.max("n").alias("most"))
    spread = matrix.groupBy("token").agg(F.count("*").alias("families")).where("families > 1").select("token")
    matrix = checkpoint(matrix.join(spread, "token").join(families.select("family", "held", "parts", "top"), "family"))
    a, b = matrix.alias("a"), matrix.alias("b")
    order = "(a.held < b.held or a.held = b.held and a.family > b.family)"
    sized = f"b.least * {num} <= a.most * {den} and a.least * {num} <= b.most * {den}"
    apart = "not (a.parts = 1 and b.parts = 1 and a.top = b.top)"
    hits = a.join(b, F.expr(f"a.token = b.token and {order} and {sized} and {apart}"))
    hits = hits.select(F.col("a.token").alias("token"), F.col("a.family").alias("family"), F.col("a.least").alias("lower"), F.col("b.family").alias("asked"), F.col("b.least").alias("least"), F.col("b.most").alias("most"), F.when(F.col("b.parts") == 1, F.col("b.top")).alias("only"))
    met = hits.groupBy("family", "asked").agg(F.count("*").alias("shared"), F.min(F.least("lower", "least")).alias("n"))
    met = checkpoint(met.where(f"shared >= {TO_SHARE}").select("family", "asked"))

    # Members of the asking family, each with the tokens that it shares with the asked one.
    near = cells.join(hits.join(met, ["family", "asked"]).drop("lower"), ["family", "token"]).where(f"least * {num} <= n * {den} and n * {num} <= most * {den} and not (part <=> only)")
    near = near.groupBy(F.col("rep").alias("q"), F.col("asked").alias("family")).agg(F.count("*").alias("shared"), F.min(F.least("n", "least")).alias("n"))
    own = inside.join(families.where("parts > 1").select("family", "top"), "family").where("part != top").select(F.col("rep").alias("q"), "family")
    wanted = checkpoint(near.where(f"shared >= {TO_SHARE}").select("q", "family").unionByName(own))

    cut = families.join(wanted.select("family").distinct(), "family").select("family", F.expr(f"cast(total div {GROUP_TOKENS} + 1 as int)").alias("groups"))
    asked = wanted.join(cut, "family").select(F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("i"), "family", "q").select(F.xxhash64("family", "i").alias("g"), "q")
    members = inside.join(cut, "family").select(F.xxhash64("family", F.expr("cast(pmod(xxhash64(rep), groups) as int)")).alias("g"), "rep")
    return asked, members
