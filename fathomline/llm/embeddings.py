"""Embedding near-dedup by PCA-ordered tiled comparison.

Equal vectors become one class. Unit vectors are rotated to principal axes, ordered by falling energy, and dealt into
tiles by a tree of medians on the leading axes, so that a tile is a small box there. Two tiles whose boxes are too far
apart for the threshold are never compared. In a pair of tiles the leading coordinates are multiplied first; the rest of
a product is at most the product of the two suffix norms, and pairs that cannot reach the threshold any more are
dropped before more coordinates are added. What is left is decided by the full cosine in double precision.

All pairs of tiles whose boxes meet are compared, so that the work can grow with the square of the number of classes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import saved
from .components import connected

#: Rows of a tile at most, coordinates of each stage, rows of the sample for medians, axes of the boxes.
TILE, STAGES, SAMPLE, AXES, STRIP = 8192, (16, 32), 20_000, 8, 1024
SLACK = 1e-9


def _matrix(column) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # no overflow or underflow in the norm
    return x / np.sqrt((x * x).sum(1, keepdims=True))


class Tree:
    """Halves a sample at medians of the widest leading axis until parts are small."""

    def __init__(self, sample: np.ndarray, leaves: int):
        self.nodes: list = []
        self.leaves = 0
        self._grow(sample, max(1, leaves))

    def _grow(self, x: np.ndarray, leaves: int) -> int:
        at = len(self.nodes)
        self.nodes.append(None)
        if leaves > 1 and len(x) > 1:
            axis = int(np.ptp(x, axis=0).argmax())
            cut = float(np.median(x[:, axis]))
            low = x[:, axis] <= cut
            if low.any() and not low.all():
                self.nodes[at] = (axis, cut, self._grow(x[low], leaves // 2), self._grow(x[~low], leaves - leaves // 2))
                return at
        self.nodes[at] = self.leaves
        self.leaves += 1
        return at

    def place(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), np.int64)
        stack = [(0, np.arange(len(x)))]
        while stack:
            at, rows = stack.pop()
            node = self.nodes[at]
            if isinstance(node, int):
                out[rows] = node
                continue
            axis, cut, low, high = node
            side = x[rows, axis] <= cut
            stack += [(low, rows[side]), (high, rows[~side])]
        return out


def linked(a: np.ndarray, b: np.ndarray, rotation: np.ndarray, threshold: float):
    """Rows i of a and j of b (unit vectors) with cosine >= threshold, all of them, in parts of a pair of strips each."""
    ra, rb = a @ rotation, b @ rotation
    rest = lambda r, k: np.sqrt(np.maximum((r[:, k:] ** 2).sum(1), 0))
    d = a.shape[1]
    stages = [k for k in STAGES if k < d]
    for lo in range(0, len(a), STRIP):
        for to in range(0, len(b), STRIP):
            x, y, rx, ry = a[lo : lo + STRIP], b[to : to + STRIP], ra[lo : lo + STRIP], rb[to : to + STRIP]
            i = j = None
            for k in stages:
                sx, sy = rest(rx, k), rest(ry, k)
                if i is None:
                    # the product of suffix norms is one more coordinate
                    bound = np.concatenate([rx[:, :k], sx[:, None]], 1) @ np.concatenate([ry[:, :k], sy[:, None]], 1).T
                    i, j = np.nonzero(bound >= threshold - SLACK)
                else:
                    ok = np.einsum("ij,ij->i", rx[i, :k], ry[j, :k]) + sx[i] * sy[j] >= threshold - SLACK
                    i, j = i[ok], j[ok]
                if len(i) > STRIP * STRIP // 16:
                    i = None
                    break
            if i is None:
                i, j = np.nonzero(x @ y.T >= threshold)
            else:
                ok = np.einsum("ij,ij->i", x[i], y[j]) >= threshold
                i, j = i[ok], j[ok]
            yield i + lo, j + to


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest reachable row of each of n rows that edges i-j join."""
    label = np.arange(n)
    while True:
        before = label.copy()
        least = np.minimum(label[i], label[j])
        np.minimum.at(label, i, least)
        np.minimum.at(label, j, least)
        label = label[label]
        if (label == before).all():
            return label


def link(vectors: DataFrame, threshold: float = 0.95, tile: int = TILE) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of vectors (vec_id, embedding, ...).

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, and vectors of different
    lengths do not link with each other. Repeated vectors are linked. A row without vec_id takes no part and gets
    n_links 0, no component and kept true; rows with equal vec_id count as that many vectors. No rows give no rows.
    """
    x = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    good = F.col("vec_id").isNotNull() & F.coalesce(F.exists("embedding", lambda v: v != 0) & F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))
    keyed = x.select("vec_id", F.when(good, F.xxhash64("embedding")).alias("k1"), F.when(good, F.hash(F.reverse("embedding"))).alias("k2"))
    classes = saved(x.where(good).groupBy(F.xxhash64("embedding").alias("k1"), F.hash(F.reverse("embedding")).alias("k2")).agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"), F.min_by("embedding", "vec_id").alias("embedding")))
    found = [_links(classes.where(F.size("embedding") == r[0]), threshold, tile) for r in classes.groupBy(F.size("embedding").alias("d")).count().orderBy("d").collect()]
    spark = vectors.sparkSession
    if found:
        links, edges = found[0]
        for a, b in found[1:]:
            links, edges = links.unionByName(a), edges.unionByName(b)
    else:
        links, edges = spark.createDataFrame([], "rep long, n long"), spark.createDataFrame([], "a long, b long")
    component = connected(edges)
    per_class = classes.select("k1", "k2", "rep", "weight").join(links.groupBy("rep").agg(F.sum("n").alias("n")), "rep", "left").join(component, F.col("rep") == F.col("node"), "left")
    per_class = per_class.select("k1", "k2", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = keyed.join(per_class, ["k1", "k2"], "left")
    own = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), F.coalesce(F.col("vec_id") == own, F.lit(True)).alias("kept"))


def _links(classes: DataFrame, threshold: float, tile: int) -> tuple[DataFrame, DataFrame]:
    """For classes of one length: (rep, n) counts of other linked vectors in parts, and (a, b) edges that span the links."""
    spark = classes.sparkSession

    def moments(batches):
        total = None
        for b in batches:
            if b.num_rows:
                u = _unit(_matrix(b.column("embedding")))
                total = u.T @ u if total is None else total + u.T @ u
        if total is not None:
            yield pa.record_batch([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], names=["m"])

    n = classes.count()
    parts = classes.select("embedding").coalesce(64).mapInArrow(moments, "m array<double>").toArrow()  # at most 64 matrices
    m = _matrix(parts.column("m")).sum(0)
    d = int(round(len(m) ** 0.5))
    energy, rotation = np.linalg.eigh(m.reshape(d, d))
    rotation = np.ascontiguousarray(rotation[:, np.argsort(-energy, kind="stable")])
    share = min(1.0, SAMPLE / n)
    sample = classes.where(F.pmod(F.xxhash64("rep"), F.lit(1 << 30)) < share * (1 << 30)).select("embedding").toArrow()
    lead = min(AXES, d)
    tree = Tree((_unit(_matrix(sample.column("embedding"))) @ rotation)[:, :lead] if sample.num_rows else np.zeros((0, lead)), -(-n // tile))

    def place(batches):
        for b in batches:
            if b.num_rows:
                y = _unit(_matrix(b.column("embedding"))) @ rotation
                yield pa.record_batch([b.column("rep"), b.column("weight"), b.column("embedding"), pa.array(tree.place(y[:, :lead])), pa.array(y[:, :lead].tolist(), pa.list_(pa.float64()))], names=["rep", "weight", "embedding", "leaf", "lead"])

    placed = saved(classes.select("rep", "weight", "embedding").mapInArrow(place, "rep long, weight long, embedding array<double>, leaf long, lead array<double>"))
    boxes = sorted(placed.groupBy("leaf").agg(F.count("*"), *(f(F.get("lead", F.lit(k))) for k in range(lead) for f in (F.min, F.max))).collect())  # a row for each leaf
    # A leaf that holds more than a tile (as near copies do) is cut by a hash into tiles with the same box.
    many = np.array([-(-box[1] // tile) for box in boxes], np.int64)
    leaf = np.array([box[0] for box in boxes], np.int64)
    low, high = (np.repeat(np.array([box[2 + side :: 2] for box in boxes], float).reshape(len(boxes), lead), many, 0) for side in (0, 1))
    tiles = int(many.sum())
    reach = 2 * (1 - threshold) + 1e-6  # squared distance of unit vectors that just reach the threshold

    def meeting(batches):
        """(pair, tile, side) of all pairs of tiles whose boxes meet, from the first tile of each: a row for each side."""
        for b in batches:
            for p in b.column("id").to_pylist():
                gap = np.maximum(0, np.maximum(low[p:] - high[p], low[p] - high[p:]))
                q = np.flatnonzero((gap * gap).sum(1) <= reach) + p
                pair, other = tiles * p + q, q != p
                yield pa.record_batch([pa.array(np.concatenate([pair, pair[other]])), pa.array(np.concatenate([np.full(len(q), p), q[other]])), pa.array(np.repeat([0, 1], [len(q), int(other.sum())]).astype(np.int32))], names=["pair", "tile", "side"])

    plan = saved(spark.range(tiles, numPartitions=max(1, min(tiles, 1024))).mapInArrow(meeting, "pair long, tile long, side int"))
    first = spark.createDataFrame(pa.table([pa.array(leaf), pa.array(np.cumsum(many) - many), pa.array(many)], names=["leaf", "first", "many"]))
    dealt = placed.join(first, "leaf").withColumn("tile", F.col("first") + F.pmod(F.xxhash64("rep"), F.col("many"))).select("rep", "weight", "embedding", "tile").join(plan, "tile")

    def compare(table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy()
        x, rep, weight = _unit(_matrix(table.column("embedding"))), table.column("rep").to_numpy(), table.column("weight").to_numpy()
        left = np.flatnonzero(side == 0)
        left = left[np.argsort(rep[left])]
        right = np.flatnonzero(side == 1)
        same = not (side == 1).any()
        right = left if same else right[np.argsort(rep[right])]
        order = np.argsort(rep, kind="stable")
        rank = np.empty(len(rep), np.int64)
        rank[order] = np.arange(len(rep))
        n, label = np.zeros(len(x)), np.arange(len(rep))
        for i, j in linked(x[left], x[right], rotation, threshold):
            i, j = left[i], right[j]
            if same:
                i, j = i[i != j], j[i != j]
            n += np.bincount(i, weight[j], len(x))
            if not same:
                n += np.bincount(j, weight[i], len(x))
            label = forest(len(rep), label[rank[i]], label[rank[j]])[label]
        n, root = n.astype(np.int64), rep[order][label][rank]
        some = np.flatnonzero(n > 0)
        return pa.table([pa.array(rep[some]), pa.array(n[some]), pa.array(root[some])], names=["rep", "n", "root"])

    got = saved(dealt.select("pair", "rep", "weight", "embedding", "side").groupBy("pair").applyInArrow(compare, "rep long, n long, root long"))
    return got.select("rep", "n"), got.select(F.col("rep").alias("a"), F.col("root").alias("b"))
