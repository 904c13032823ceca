"""Embedding near-duplicates: an exact metric range join over cells of pivots.

Cosine at least c between unit vectors is a distance of at most r = sqrt(2 - 2c). Every distinct vector
lives in the cell of its nearest pivot and visits each cell before its own that may hold a vector within r:
by the triangle inequality d(x, p) <= d(x, own) + 2r, and by the distance to the plane between the pivots
(d(x, p)^2 - d(x, own)^2) / (2 d(p, own)) <= r. So each pair within r meets exactly once, and each cell is
joined independently: blocks of its own vectors against its visitors, streamed. A cell with more than
``block`` own vectors is split; vectors of a later block visit the earlier ones. A block's visitors are dealt into
runs of about ``VISITORS``, each of which meets a copy of the block in a task of its own. Products are taken in
single precision; whatever they leave within their error of the threshold is decided in double precision.

Equal vectors are one vector with a count, so a common vector is compared once. Counts of links and star
edges of each block leave the cells, never pairs.

Defined results: null and zero vectors and those with null or non-finite components link with nothing;
vectors of different lengths do not link; repeated rows are vectors of their own; null vec_ids name a
class only if it has no other id. Only vec_id and embedding are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.llm.components import components
from loomstone.llm.scratch import cut, discard, join_hot, small_batches

COSINE = 0.9
BLOCK = 8192
#: Bounds of the pivots: the square root of the number of vectors over eight, at most MAX_PIVOTS.
MAX_PIVOTS = 1024
CHUNK = 1024
#: Visitors of a block that one task streams; results do not depend on it.
VISITORS = 1 << 16


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column, all of one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, in double precision (scaled first, so that squares stay finite)."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def visits(u: np.ndarray, pivots: np.ndarray, r: float) -> tuple[np.ndarray, np.ndarray]:
    """The own cell of each unit vector, and which earlier cells it has to visit."""
    d2 = np.maximum(2 - 2 * (u @ pivots.T), 0)
    d = np.sqrt(d2)
    own = d.argmin(axis=1)
    mine = np.arange(len(u))
    slack = 1e-9
    near = d <= d[mine, own][:, None] + 2 * r + slack
    between = np.sqrt(np.maximum(2 - 2 * (pivots @ pivots.T), 0))[own]
    near &= d2 - d2[mine, own][:, None] <= 2 * r * between + slack
    return own, near & (np.arange(len(pivots))[None, :] < own[:, None])


class Block:
    """One block of own vectors; others are matched against it chunk by chunk."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray, raw: np.ndarray, cosine: float, inner: bool = True) -> None:
        """``inner``: whether links among the own vectors count here (in one of the block's copies they do)."""
        self.keys, self.weights, self.raw, self.cosine = keys, weights, raw, cosine
        self.single = unit(raw).astype(np.float32)
        self.margin = np.float32(1e-5 + 2e-7 * raw.shape[1])
        self.links = np.zeros(len(keys), dtype=np.int64)
        self.root = np.arange(len(keys))
        self.edges: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        for at in range(0, len(keys) if inner else 0, CHUNK):
            h, o = self._pairs(raw[at : at + CHUNK])
            np.add.at(self.links, h, self.weights[o + at])
            self._union(h, o)

    def _pairs(self, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        near = self.single @ unit(others).astype(np.float32).T
        h, o = np.divmod(np.flatnonzero(near >= np.float32(self.cosine) - self.margin), near.shape[1])
        unsure = np.flatnonzero(near[h, o] < np.float32(self.cosine) + self.margin)
        if len(unsure):
            drop = np.zeros(len(h), dtype=bool)
            for at in range(0, len(unsure), 65_536):
                i = unsure[at : at + 65_536]
                a, b = self.raw[h[i]].astype(np.float64), others[o[i]].astype(np.float64)
                a, b = a / np.abs(a).max(axis=1, keepdims=True), b / np.abs(b).max(axis=1, keepdims=True)
                cos = (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))
                drop[i] = cos < self.cosine
            h, o = h[~drop], o[~drop]
        return h, o

    def _union(self, h: np.ndarray, o: np.ndarray) -> np.ndarray:
        """Join the own vectors that share a linked one; one own vector for each linked ``o``."""
        if not len(h):
            return np.zeros(0, dtype=np.int64)
        root = self.root[h]
        low = np.full(int(o.max()) + 1, len(self.keys), dtype=np.int64)
        np.minimum.at(low, o, root)
        pairs = np.unique(np.stack([low[o], root], axis=1), axis=0)
        for a, b in pairs[pairs[:, 0] != pairs[:, 1]].tolist():
            while self.root[a] != a:
                a = int(self.root[a])
            while self.root[b] != b:
                b = int(self.root[b])
            self.root[max(a, b)] = min(a, b)
        while not (self.root == self.root[self.root]).all():
            self.root = self.root[self.root]
        return low

    def visit(self, keys: np.ndarray, weights: np.ndarray, others: np.ndarray) -> None:
        for at in range(0, len(keys), CHUNK):
            h, o = self._pairs(others[at : at + CHUNK])
            if len(h):
                np.add.at(self.links, h, weights[o + at])
                seen, place = np.unique(o, return_inverse=True)
                n = np.zeros(len(seen), dtype=np.int64)
                np.add.at(n, place, self.weights[h])
                low = self._union(h, o)
                self.counts.append(np.stack([keys[seen + at], n]))
                self.edges.append(np.stack([keys[seen + at], self.keys[low[seen]]]))

    def result(self) -> pa.RecordBatch:
        """Rows (u, v, n): n links more for u, and an edge from u to v."""
        own = np.stack([self.keys, self.keys[self.root], self.links])
        parts = [own] + [np.stack([e[0], e[1], c[1]]) for e, c in zip(self.edges, self.counts, strict=True)]
        every = np.concatenate(parts, axis=1)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in every], names=["u", "v", "n"])


def _match(batches: Iterator[pa.RecordBatch], cosine: float) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (dim, cell, block, run, visitor): each block's own vectors come before a run of its visitors."""
    name, own, block = None, [], None

    def build() -> Block | None:
        if not own:
            return None
        return Block(*(np.concatenate([x[i] for x in own]) for i in range(3)), cosine, name[3] == 0)

    for batch in batches:
        group = np.stack([batch.column(c).to_numpy() for c in ("dim", "cell", "block", "run")], axis=1)
        visitor = batch.column("visitor").to_numpy(zero_copy_only=False)
        change = np.flatnonzero((group[1:] != group[:-1]).any(axis=1) | (visitor[1:] != visitor[:-1])) + 1
        edges = [0, *change.tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:], strict=False):
            if a == b:
                continue
            this = tuple(group[a])
            if this != name:
                block = block or build()
                if block:
                    yield block.result()
                name, own, block = this, [], None
            part = batch.slice(a, b - a)
            rows = (part.column("key").to_numpy(), part.column("weight").to_numpy(), _matrix(part.column("embedding")))
            if not visitor[a]:
                own.append(rows)
            else:
                block = block or build()
                if block:
                    block.visit(*rows)
    block = block or build()
    if block:
        yield block.result()


def usable(vector):
    """Vectors that may link: finite components, not all zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(vector, lambda x: x != 0)


def near_vectors(rows: DataFrame, cosine: float = COSINE, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row."""
    spark, r = rows.sparkSession, math.sqrt(2 - 2 * cosine)
    small_batches(spark)
    element = rows.schema["embedding"].dataType.elementType.simpleString()
    kind = "float" if element == "float" else "double"
    vectors = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{kind}>").alias("embedding"))
    good = F.coalesce(usable(F.col("embedding")), F.lit(False))
    grouped = vectors.where(good).groupBy("embedding").agg(F.count("*").alias("weight"), F.min("vec_id").alias("least"))
    # Written once, so that the numbers hold.
    distinct = cut(grouped.select(F.monotonically_increasing_id().alias("key"), "weight", "least", F.size("embedding").alias("dim"), "embedding"), "vectors")
    lengths = {x.dim: x.n for x in distinct.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    pivots = {}
    for dim, n in lengths.items():
        few = max(1, min(MAX_PIVOTS, math.isqrt(n) // 8))
        drawn = distinct.where(F.col("dim") == dim).orderBy(F.xxhash64("embedding"), "key").limit(few).select("embedding").collect()
        pivots[dim] = unit(np.array([x.embedding for x in drawn], dtype=np.float64))
    send = spark.sparkContext.broadcast(pivots)  # at most MAX_PIVOTS vectors of each length

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                own, others = visits(unit(_matrix(part.column("embedding"))), send.value[dim], r)
                cells = [np.flatnonzero(x).astype(np.int32).tolist() for x in others]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(own.astype(np.int32)), pa.array(cells, type=pa.list_(pa.int32()))], names=[*part.schema.names, "own", "visits"])

    columns = f"key long, weight long, dim int, embedding array<{kind}>"
    placed = cut(distinct.select("key", "weight", "dim", "embedding").mapInArrow(assign, f"{columns}, own int, visits array<int>"), "vector-cells")
    # Rows of a cell: its own, and its visitors.
    sizes = placed.select("dim", F.col("own").alias("cell"), F.lit(1).alias("own"), F.lit(0).alias("other")).union(placed.select("dim", F.explode("visits"), F.lit(0), F.lit(1)))
    blocks = sizes.groupBy("dim", "cell").agg(F.greatest(F.ceil(F.sum("own") / block), F.lit(1)).cast("int").alias("blocks"), F.ceil(F.count("*") / VISITORS).cast("int").alias("runs"))
    at = F.struct(F.col("own").alias("cell"), F.lit(False).alias("visitor"))
    going = F.transform("visits", lambda c: F.struct(c.alias("cell"), F.lit(True).alias("visitor")))
    dealt = placed.select("*", F.explode(F.concat(F.array(at), going)).alias("at")).select("key", "weight", "dim", "embedding", "at.*").join(blocks, ["dim", "cell"])
    mine = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")
    # Own rows: their block, and as visitors the blocks before it. Visitors of other cells: every block.
    last = F.when(F.col("visitor"), F.col("blocks") - 1).otherwise(mine)
    dealt = dealt.withColumn("mine", mine).withColumn("block", F.explode(F.sequence(F.lit(0), last))).withColumn("visitor", F.col("visitor") | (F.col("block") < F.col("mine")))
    # A visitor belongs to one run of a block's visitors; a block's own rows to each.
    one = F.pmod(F.xxhash64("key", F.lit(1)), F.col("runs")).cast("int")
    dealt = dealt.withColumn("run", F.explode(F.when(F.col("visitor"), F.array(one)).otherwise(F.sequence(F.lit(0), F.col("runs") - 1))))
    matched = (
        dealt.select("dim", "cell", "block", "run", "visitor", "key", "weight", "embedding")
        .repartition("dim", "cell", "block", "run")
        .sortWithinPartitions("dim", "cell", "block", "run", "visitor")
        .mapInArrow(lambda b: _match(b, cosine), "u long, v long, n long")
    )
    matched = cut(matched, "vector-links")
    linked = matched.groupBy(F.col("u").alias("key")).agg((F.sum("n") - 1).alias("n_links"))
    roots = components(matched.where("u <> v").select("u", "v"), "vector-components").withColumnRenamed("node", "key")
    # Many vectors may be one class, and many rows one vector.
    classed = distinct.select("key", "least").join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    named = cut(classed.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n")), "vector-classes")
    known = join_hot(classed.select("key", "root"), named, "root", "n")
    classes = cut(distinct.join(linked, "key").join(known, "key").select("embedding", "weight", "n_links", "component_id"), "vector-labels")
    discard(named, matched, placed, distinct)
    told = join_hot(vectors.where(good), classes, "embedding", "weight").select("vec_id", "n_links", "component_id")
    alone = vectors.where(~good).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return told.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
