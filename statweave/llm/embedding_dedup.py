"""Embedding near-duplicates by dual traversal of cover trees, exact at a cosine threshold.

Equal vectors of a label are one node from the start. On unit vectors a cosine of t is a distance of sqrt(2 - 2t), so
distances obey the triangle inequality: two tree nodes whose centres are further apart than their covering radii and
that distance together hold no pair. The upper levels of a label's tree are built over the whole table, level by level:
a cell with more than a block of vectors is divided among centres from a bounded sample of it, every vector has its
home in the nearest one's cell, and cells know their covering radii. A vector goes on as a visitor into those cells
before its home that may hold a partner, by the covering radius and by the plane between two centres; visitors go down
with the levels, so of two cells that are apart neither's vectors are copied into the other. The number of cells grows
with the vectors, and what a task holds doesn't. In the last cells nested levels with halving radii are built and
traversed in pairs, and the pairs left are compared by their cosine in double precision. A cell that no longer divides
is dealt to blocks, all of which are compared. A block reports counts of links and a spanning forest, never the pairs.

Vectors are scaled by powers of two first, so very large and very small components neither overflow nor vanish.
Vectors that are null, zero, or hold null or non-finite numbers, rows without a label or an id, and vectors of another
length link with nothing; repeated rows are equal vectors, and a repeated id with different vectors is one node that
has the links of all; other columns are ignored; an empty table gives an empty result. How much is pruned depends on
the data: in high dimensions without structure nearly every cell is visited, and a cluster of M vectors that are all
linked takes M * M / 2 comparisons, as their links are counted.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, connected_components

#: Vectors in a cell's block, and so the most that a task's tree holds.
BLOCK = 2048
#: Vectors of a cell that its centres are chosen from, and the most centres.
SAMPLE = 1024
CENTRES = 128
#: Share of a cell's vectors in one of its parts from which on dividing it is given up.
UNDIVIDED = 0.9
#: Rows of a cell that one task divides.
ROWS = 8192
#: Radius below which distances are rounding errors.
POINT = 1e-7
#: Points below which a tree node isn't divided.
LEAF = 24
SLACK = 1e-9


class Node:
    __slots__ = ("centre", "radius", "points", "children")

    def __init__(self, centre: int, radius: float, points: np.ndarray, children: list):
        self.centre, self.radius, self.points, self.children = centre, radius, points, children


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2.0 - 2.0 * (x @ y.T), 0.0))


def cover_tree(x: np.ndarray, points: np.ndarray | None = None, radius: float = 2.0) -> Node:
    """A tree over unit vectors: children's centres are more than half the level's radius apart and cover the node."""
    points = np.arange(len(x)) if points is None else points
    centre = int(points[0])
    far = distances(x[points], x[centre : centre + 1])[:, 0]
    node = Node(centre, float(far.max()) if len(far) else 0.0, points, [])
    if len(points) <= LEAF or node.radius <= POINT:
        return node
    half = min(radius, node.radius) / 2
    owner, near = np.zeros(len(points), np.int64), far.copy()
    centres = [0]
    while near.max() > half:  # farthest first: each new centre is more than half from all before it
        if len(centres) * 4 > len(points) and half < node.radius / 2 + 1:
            rest = np.flatnonzero(near > half)
            if len(rest) * 2 > len(points):  # nearly all points stand alone: no level between is worth keeping
                node.children = [Node(int(p), 0.0, points[i : i + 1], []) for i, p in enumerate(points)]
                return node
        c = int(near.argmax())
        d = distances(x[points], x[points[c] : points[c] + 1])[:, 0]
        closer = d < near
        owner[closer], near = len(centres), np.minimum(near, d)
        owner[c], near[c] = len(centres), 0.0
        centres.append(c)
    for k, c in enumerate(centres):
        own = np.flatnonzero(owner == k)
        own = np.concatenate([[c], own[own != c]])
        node.children.append(cover_tree(x, points[own], half))
    return node


def dual_pairs(a: Node, x: np.ndarray, b: Node, y: np.ndarray, reach: float):
    """Point pairs (indices in x, in y) that the bounds of the two trees leave, in arrays."""
    stack = [(a, b)]
    while stack:
        p, q = stack.pop()
        left, right = p.children or [p], q.children or [q]
        if left == [p] and right == [q]:
            i, j = np.meshgrid(p.points, q.points, indexing="ij")
            yield i.ravel(), j.ravel()
            continue
        lc, rc = np.array([n.centre for n in left]), np.array([n.centre for n in right])
        lr, rr = np.array([n.radius for n in left]), np.array([n.radius for n in right])
        close = distances(x[lc], y[rc]) <= lr[:, None] + rr[None, :] + reach
        single = (lr == 0)[:, None] & (rr == 0)[None, :]
        i, j = np.nonzero(close & single)
        sizes = np.array([len(n.points) for n in left])[i] * np.array([len(n.points) for n in right])[j] if len(i) else np.zeros(0)
        plain = sizes == 1
        if plain.any():
            yield lc[i[plain]], rc[j[plain]]
        for u, v in zip(i[~plain].tolist(), j[~plain].tolist(), strict=True):
            stack.append((Node(left[u].centre, 0.0, left[u].points, []), Node(right[v].centre, 0.0, right[v].points, [])))
        for u, v in zip(*np.nonzero(close & ~single), strict=True):
            stack.append((left[u], right[v]))


def _matrix(blobs: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), np.float64).reshape(len(blobs), -1)


def _units(v: np.ndarray) -> np.ndarray:
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _block_links(cos: float):
    """Counts and forests of the blocks in a sorted stream of members and visitors."""
    reach = float(np.sqrt(2 - 2 * cos)) + 1e-7

    def linked(a, b):
        """Index pairs in two sides (vectors, units, tree) with the cosine reached; a is b inside a block."""
        us, vs = [], []
        for i, j in dual_pairs(a[2], a[1], b[2], b[1], reach):
            if a is b:
                keep = i < j
                swap = j < i
                i, j = np.concatenate([i[keep], j[swap]]), np.concatenate([j[keep], i[swap]])
            for s in range(0, len(i), 1 << 16):
                u, v = i[s : s + (1 << 16)], j[s : s + (1 << 16)]
                dot = np.einsum("ij,ij->i", a[0][u], b[0][v])
                good = dot / (np.sqrt(np.einsum("ij,ij->i", a[0][u], a[0][u])) * np.sqrt(np.einsum("ij,ij->i", b[0][v], b[0][v]))) >= cos
                us.append(u[good])
                vs.append(v[good])
        if not us:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        pairs = np.unique(np.concatenate(us).astype(np.int64) << 32 | np.concatenate(vs).astype(np.int64))
        return pairs >> 32, pairs & 0xFFFFFFFF

    def side(blobs):
        v = _matrix(blobs)
        x = _units(v)
        return v, x, cover_tree(x)

    def report(ids, copies, u, v, other_ids, other_copies):
        n = len(ids)
        every, weight = np.concatenate([ids, other_ids]), np.concatenate([copies, other_copies])
        v = v + n if other_ids is not ids else v
        links = np.bincount(np.concatenate([u, v]), weight[np.concatenate([v, u])], minlength=len(every)).astype(np.int64)
        root = np.arange(len(every))
        while True:
            low = np.minimum(root[u], root[v])
            new = root.copy()
            np.minimum.at(new, u, low)
            np.minimum.at(new, v, low)
            new = np.minimum(new, new[new])
            if (new == root).all():
                break
            root = new
        at = np.flatnonzero(links)
        return pa.RecordBatch.from_arrays([pa.array(every[at]), pa.array(links[at]), pa.array(every[root[at]])], ["rep", "links", "root"])

    def stream(batches):
        group, ids, copies, blobs, tree, waiting = None, [], [], [], None, ([], [], [])

        def members():
            nonlocal tree
            if tree is None and ids:
                tree = (side(blobs), np.array(ids, np.int64), np.array(copies, np.int64))
                u, v = linked(tree[0], tree[0])
                if len(u):
                    yield report(tree[1], tree[2], u, v, tree[1], tree[2])

        def visit():
            if tree is not None and waiting[0]:
                own = side(waiting[2])
                u, v = linked(tree[0], own)
                if len(u):
                    yield report(tree[1], tree[2], u, v, np.array(waiting[0], np.int64), np.array(waiting[1], np.int64))
            for w in waiting:
                w.clear()

        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(6)]
            for cell, block, kind, rep, many, blob in zip(*columns, strict=True):
                at = (cell, block)
                if at != group:
                    yield from members()
                    yield from visit()
                    group, ids, copies, blobs, tree = at, [], [], [], None
                if kind == 0:
                    ids.append(rep)
                    copies.append(many)
                    blobs.append(blob)
                    continue
                yield from members()
                for w, value in zip(waiting, (rep, many, blob), strict=True):
                    w.append(value)
                if len(waiting[0]) >= BLOCK:
                    yield from visit()
        yield from members()
        yield from visit()

    return stream


def _net(frame: pd.DataFrame) -> pd.DataFrame:
    """A cell's centres: half of them farthest first, which keeps them apart, half as they come, which divides evenly."""
    frame = frame.sort_values("rep")
    x = _units(_matrix(frame["vector"].tolist()))
    k = int(min(CENTRES, max(2, -(-int(frame["n"].iloc[0]) // (BLOCK // 2))), len(x)))
    chosen, near = [0], distances(x, x[:1])[:, 0]
    while len(chosen) < k:
        left = np.flatnonzero(near > POINT)
        if not len(left):
            break
        chosen.append(int(near.argmax()) if len(chosen) < (k + 1) // 2 else int(left[0]))
        near = np.minimum(near, distances(x, x[chosen[-1:]])[:, 0])
    return pd.DataFrame({"cell": frame["cell"].iloc[:1].tolist(), "centres": [x[chosen].tobytes()]})


def _by_cell(rows: DataFrame, heads: DataFrame, use, schema: str) -> DataFrame:
    """``use(centres, radii, batch)`` of the rows of each cell, dealt in parts of about ROWS with the cell's head first."""
    parts = heads.select("cell", F.expr(f"cast(n div {ROWS} + 1 as int)").alias("parts"))
    body = rows.join(parts, "cell").select("cell", F.expr("cast(pmod(xxhash64(rep), parts) as int)").alias("part"), "kind", "rep", "copies", "vector", "child", F.lit(None).cast("array<double>").alias("radii"))
    first = heads.join(parts, "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(-1).alias("kind"), F.lit(0).cast("long").alias("rep"), F.lit(0).cast("long").alias("copies"), F.col("centres").alias("vector"), F.lit(0).alias("child"), "radii")

    def stream(batches):
        head = None
        for batch in batches:
            kind = batch.column(2).to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero(kind == -1)).tolist(), len(kind)]
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                if lo < hi and kind[lo] == -1:
                    size = int(batch.column(0)[lo].as_py().split(":")[0])
                    head = (np.frombuffer(batch.column(5)[lo].as_py(), np.float64).reshape(-1, size), batch.column(7)[lo].as_py())
                    lo += 1
                if lo < hi:
                    yield use(*head, batch.slice(lo, hi - lo))

    dealt = first.unionByName(body).repartition("cell", "part").sortWithinPartitions("cell", "part", "kind")
    return dealt.mapInArrow(stream, schema)


def _homes(centres: np.ndarray, radii, batch: pa.RecordBatch) -> pa.RecordBatch:
    d = distances(_units(_matrix(batch.column(5).to_pylist())), centres)
    child = d.argmin(axis=1)
    return pa.RecordBatch.from_arrays([batch.column(0), *(batch.column(i) for i in (2, 3, 4, 5)), pa.array(child, pa.int32()), pa.array(d[np.arange(len(d)), child])], ["cell", "kind", "rep", "copies", "vector", "child", "far"])


def _parts(reach: float):
    def divide(centres: np.ndarray, radii, batch: pa.RecordBatch) -> pa.RecordBatch:
        """Rows of the parts: homes in their own one and as visitors in those before it, visitors in all that may hold a partner."""
        radii = np.array(radii)
        dot = _units(_matrix(batch.column(5).to_pylist())) @ centres.T
        d = np.sqrt(np.maximum(2 - 2 * dot, 0.0))
        home = batch.column(2).to_numpy(zero_copy_only=False) == 0
        child = batch.column(6).to_numpy(zero_copy_only=False)
        nearest = dot.argmax(axis=1)
        # The plane between two centres: a partner on the other side is at least this far away.
        plane = dot.max(axis=1)[:, None] - dot <= reach * distances(centres, centres)[nearest] + SLACK
        ok = (radii[None, :] >= 0) & (d <= radii[None, :] + reach + SLACK) & plane
        ok &= ~home[:, None] | (np.arange(len(centres))[None, :] < child[:, None])
        at, to = np.nonzero(ok)
        own = np.flatnonzero(home)
        at, to, kind = np.concatenate([own, at]), np.concatenate([child[own], to]), np.concatenate([np.zeros(len(own)), np.ones(len(at))])
        picked = batch.take(pa.array(at))
        cells = [f"{c}.{i}" for c, i in zip(picked.column(0).to_pylist(), to.tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(cells, pa.string()), pa.array(kind, pa.int32()), picked.column(3), picked.column(4), picked.column(5)], ["cell", "kind", "rep", "copies", "vector"])

    return divide


def _divided(rows: DataFrame, reach: float) -> DataFrame:
    """Rows (cell, kind, rep, copies, vector) of the last cells of all labels' trees; kind 0 is at home, 1 visits."""
    done = []
    while True:
        big = checkpoint(rows.where("kind = 0").groupBy("cell").agg(F.count("*").alias("n")).where(f"n > {BLOCK}"))
        if big.isEmpty():
            break
        inner = rows.join(big, "cell")
        sample = inner.where("kind = 0").where(F.crc32(F.concat_ws(":", "rep", "cell")) < F.least(F.lit(1.0), F.lit(SAMPLE) / F.col("n")) * 4294967296.0)
        heads = sample.groupBy("cell").applyInPandas(_net, "cell string, centres binary").join(big, "cell")
        heads = checkpoint(heads.withColumn("radii", F.lit(None).cast("array<double>")))
        bare = "cell string, kind int, rep long, copies long, vector binary, child int, far double"
        placed = checkpoint(_by_cell(rows.where("kind = 0").withColumn("child", F.lit(0)), heads, _homes, bare))
        radii = placed.groupBy("cell", "child").agg(F.max("far").alias("radius"), F.count("*").alias("held"))
        table = radii.groupBy("cell").agg(F.map_from_entries(F.collect_list(F.struct("child", "radius"))).alias("known"), F.max("held").alias("most"))  # CENTRES entries at most
        every = F.transform(F.sequence(F.lit(0), F.lit(CENTRES - 1)), lambda i: F.coalesce(F.col("known")[i], F.lit(-1.0)))
        width = F.expr("cast(length(centres) div (8 * cast(substring_index(cell, ':', 1) as int)) as int)")
        heads = checkpoint(heads.drop("radii").join(table, "cell").where(F.col("most") <= UNDIVIDED * F.col("n")).select("cell", "centres", "n", F.slice(every, F.lit(1), width).alias("radii")))
        done.append(rows.join(heads.select("cell"), "cell", "left_anti"))
        visitors = rows.where("kind = 1").withColumn("child", F.lit(-1)).withColumn("far", F.lit(0.0))
        rows = checkpoint(_by_cell(placed.unionByName(visitors.select(*placed.columns)), heads, _parts(reach), "cell string, kind int, rep long, copies long, vector binary"))
    for other in done:
        rows = rows.unionByName(other)
    return rows


def near_duplicates(table: DataFrame, cos: float = 0.98) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row of ``table`` (vec_id, embedding, label)."""
    reach = float(np.sqrt(2 - 2 * cos)) + 1e-7
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("string").alias("label"))
    sound = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("embedding", lambda v: v != 0)
    rows = rows.withColumn("sound", F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & sound, F.lit(False)))
    nodes = rows.where("sound").groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))

    def pack(batches):
        for batch in batches:
            cells, vectors = [], []
            for label, values in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), strict=True):
                v = np.asarray(values, np.float64)
                vectors.append(np.ldexp(v, -int(np.frexp(np.abs(v).max())[1])).tobytes())
                cells.append(f"{len(v)}:{label}:")
            yield pa.RecordBatch.from_arrays([pa.array(cells, pa.string()), pa.array([0] * len(cells), pa.int32()), batch.column(1), batch.column(2), pa.array(vectors, pa.binary())], ["cell", "kind", "rep", "copies", "vector"])

    nodes = checkpoint(nodes.select("label", "rep", "copies", "embedding"))
    placed = _divided(checkpoint(nodes.mapInArrow(pack, "cell string, kind int, rep long, copies long, vector binary")), reach)
    blocks = placed.where("kind = 0").groupBy("cell").agg(F.count("*").alias("n")).select("cell", F.expr(f"cast((n - 1) div {BLOCK} + 1 as int)").alias("blocks"))
    inside = placed.join(blocks, "cell").withColumn("own", F.expr("cast(pmod(xxhash64(rep), blocks) as int)"))
    block = F.when(F.col("kind") == 0, F.sequence(F.lit(0), F.col("own"))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))
    inside = inside.select("cell", F.explode(block).alias("block"), "kind", "own", "rep", "copies", "vector")
    inside = inside.select("cell", "block", F.when((F.col("kind") == 0) & (F.col("block") == F.col("own")), 0).otherwise(1).alias("kind"), "rep", "copies", "vector")
    dealt = inside.repartition("cell", "block").sortWithinPartitions("cell", "block", "kind")
    found = checkpoint(dealt.mapInArrow(_block_links(cos), "rep long, links long, root long"))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    parts = connected_components(found.select(F.col("rep").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "rep")
    names = nodes.join(links, "rep", "left").join(parts, "rep", "left").select("label", "embedding", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    joined = rows.where("sound").join(names, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    apart = rows.where("not sound").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return joined.unionByName(apart).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
