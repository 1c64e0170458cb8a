"""Approximate nearest neighbours by a forest of random-projection trees.

A tree halves a sample again and again at the median of a random projection. It is fitted on at most ``SAMPLE_ROWS`` vectors (those of
smallest hash of the id) and has at most ``MOST_LEAVES`` leaves, so the broadcast forest has a fixed bound; every row of the table is
then put into its leaf of each tree. A query walks all trees at once through one priority queue: the node with the best worst margin on its
way from the root comes next, whichever tree it is in, until the leaves reached hold
``SEARCH_SHARE`` times the rows of the table, counted per tree, and ``SEARCH_LEAST`` at least. Their rows are reranked by the exact
Euclidean distance of the original vectors in double precision.

Leaves meet queries in groups of (tree, leaf, chunk, block): rows of a leaf are dealt into chunks and its queries into blocks by
hashes, according to counts of the whole table, so a leaf with very many rows or queries is spread over tasks.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TREES = 6
SAMPLE_ROWS = 16_384
MOST_LEAVES = 512
LEAF_ROWS = 64
SEARCH_SHARE, SEARCH_LEAST = 0.9, 5000
NEIGHBOURS = 10
CHUNK_ROWS = 8192
BLOCK_QUERIES = 2048


@dataclass
class Forest:
    """Trees in one node table: ``normal`` and ``offset`` of inner nodes, ``left`` / ``right`` children, ``leaf`` number or -1."""

    normals: np.ndarray
    offsets: np.ndarray
    left: np.ndarray
    right: np.ndarray
    leaf: np.ndarray
    roots: list[int]

    @property
    def leaves(self) -> int:
        return int(self.leaf.max()) + 1 if len(self.leaf) else 0

    def place(self, vectors: np.ndarray) -> np.ndarray:
        """Leaf numbers (rows x trees)."""
        out = np.zeros((len(vectors), len(self.roots)), np.int64)
        for t, root in enumerate(self.roots):
            node = np.full(len(vectors), root)
            live = np.flatnonzero(self.leaf[node] < 0)
            while len(live):
                at = node[live]
                side = np.einsum("ij,ij->i", vectors[live], self.normals[at]) > self.offsets[at]
                node[live] = np.where(side, self.right[at], self.left[at])
                live = live[self.leaf[node[live]] < 0]
            out[:, t] = self.leaf[node]
        return out

    def search(self, margins: np.ndarray, sizes: np.ndarray, wanted: int) -> list[int]:
        """Leaves for one query, best first, until they hold ``wanted`` rows. ``margins`` are its signed distances to all planes."""
        queue = [(-np.inf, r) for r in self.roots]
        found, rows = [], 0
        while queue and rows < wanted:
            worst, node = heapq.heappop(queue)
            if self.leaf[node] >= 0:
                found.append(int(self.leaf[node]))
                rows += int(sizes[self.leaf[node]])
                continue
            margin = margins[node]
            heapq.heappush(queue, (max(worst, -margin), int(self.right[node])))
            heapq.heappush(queue, (max(worst, margin), int(self.left[node])))
        return found


def grow(sample: np.ndarray, trees: int = TREES, leaf_rows: int = LEAF_ROWS, most_leaves: int = MOST_LEAVES, seed: int = 11) -> Forest:
    """Trees over a sample; of four random directions a node takes that of the widest spread. Equal vectors stay together."""
    rng = np.random.default_rng(seed)
    dim = sample.shape[1]
    normals, offsets, left, right, leaf, roots, leaves = [], [], [], [], [], [], 0
    leaf_rows = max(leaf_rows, -(-len(sample) // most_leaves), 1)

    def node():
        normals.append(np.zeros(dim))
        offsets.append(0.0)
        left.append(-1)
        right.append(-1)
        leaf.append(-1)
        return len(leaf) - 1

    for _ in range(trees):
        roots.append(node())
        stack = [(roots[-1], np.arange(len(sample)))]
        while stack:
            at, rows = stack.pop()
            if len(rows) > leaf_rows:
                directions = rng.normal(size=(dim, 4))
                directions /= np.linalg.norm(directions, axis=0)
                spread = sample[rows] @ directions
                best = int(np.argmax(spread.std(axis=0)))
                values = spread[:, best]
                cut = float(np.median(values))
                side = values > cut
                if side.any() and not side.all():
                    normals[at], offsets[at] = directions[:, best], cut
                    left[at], right[at] = node(), node()
                    stack += [(left[at], rows[~side]), (right[at], rows[side])]
                    continue
            leaf[at], leaves = leaves, leaves + 1
    return Forest(np.array(normals), np.array(offsets), np.array(left), np.array(right), np.array(leaf), roots)


def usable(vectors: Column) -> Column:
    """Vectors that take part: not null or empty, all components finite, not all zero."""
    finite = F.forall(vectors, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vectors.isNotNull() & (F.size(vectors) > 0) & finite & F.exists(vectors, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def train(vectors: DataFrame, trees: int = TREES, rows: int = SAMPLE_ROWS) -> tuple[Forest, int] | None:
    """The forest and the dimension, from at most ``rows`` (id, v) rows of smallest hash; None without rows.

    Vectors of another length than most of the sample take no part.
    """
    sample = vectors.orderBy(F.xxhash64("id"), "id").limit(rows).select("v").toArrow().column("v").combine_chunks()
    lengths = np.array(sample.value_lengths().to_pylist(), np.int64)
    if not len(lengths):
        return None
    values, counts = np.unique(lengths, return_counts=True)
    dim = int(values[np.argmax(counts)])
    return grow(_matrix(sample.filter(pa.array(lengths == dim))), trees), dim


def _leaf_sizes(vectors: DataFrame, forest, leaves: int) -> np.ndarray:
    """Rows of the whole table in every leaf; as many numbers as the forest has leaves reach the driver."""
    def count(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = np.zeros(leaves, np.int64)
        for batch in incoming:
            if len(batch):
                sizes += np.bincount(forest.value.place(_matrix(batch.column(0))).ravel(), minlength=leaves)
        leaf = np.flatnonzero(sizes)
        yield pa.RecordBatch.from_arrays([pa.array(leaf, pa.int64()), pa.array(sizes[leaf], pa.int64())], names=["leaf", "n"])

    out = np.zeros(leaves, np.int64)
    for row in vectors.select("v").mapInArrow(count, "leaf bigint, n bigint").groupBy("leaf").agg(F.sum("n").alias("n")).collect():
        out[row["leaf"]] = row["n"]
    return out


def neighbours(embeddings: DataFrame, queries: DataFrame, k: int = NEIGHBOURS, identity: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score: the k nearest rows found for each query row, its own id left out.

    Ties go to the smaller id. Rows without an id or a usable vector take no part; an id that stands on several rows counts once,
    with its nearest vector as candidate and its least as query. Fewer candidates than k give fewer rows; without any, none. Columns of other
    names are not looked at.
    """
    spark = embeddings.sparkSession
    pick = lambda t: t.select(F.col(identity).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v")).where(
        F.col("id").isNotNull() & usable(F.col("v")))
    rows, asked = pick(embeddings), pick(queries)
    ddl = "query_id bigint, rank int, vec_id bigint, score double"
    trained = train(rows)
    if trained is None:
        return spark.createDataFrame([], ddl)
    forest, dim = trained
    rows, asked = rows.where(F.size("v") == dim), asked.where(F.size("v") == dim).groupBy("id").agg(F.min("v").alias("v"))
    model = spark.sparkContext.broadcast(forest)
    sizes = _leaf_sizes(rows, model, forest.leaves)
    total = int(sizes.sum()) // len(forest.roots)
    wanted = max(SEARCH_LEAST, int(SEARCH_SHARE * total))

    def probe(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in incoming:
            for start in range(0, len(batch), 64):
                part = batch.slice(start, 64)
                margins = _matrix(part.column(1)) @ model.value.normals.T - model.value.offsets
                leaves = [model.value.search(m, sizes, wanted) for m in margins]
                take = pa.array(np.repeat(np.arange(len(part)), [len(x) for x in leaves]))
                yield pa.RecordBatch.from_arrays([part.column(0).take(take), part.column(1).take(take), pa.array([x for y in leaves for x in y], pa.int64())],
                                                 names=["query_id", "q", "leaf"])

    def post(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in incoming:
            if len(batch):
                leaves = model.value.place(_matrix(batch.column(1)))
                take = pa.array(np.repeat(np.arange(len(batch)), leaves.shape[1]))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(leaves.ravel(), pa.int64())],
                                                 names=["vec_id", "v", "leaf"])

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"query_id": [], "vec_id": [], "score": []}
        if left.num_rows and right.num_rows:
            ids = right.column("vec_id").to_numpy()
            x = _matrix(right.column("v").combine_chunks())
            for query, q in zip(left.column("query_id").to_pylist(), _matrix(left.column("q").combine_chunks())):
                gap = x - q
                score = np.sqrt(np.einsum("ij,ij->i", gap, gap))
                own = np.flatnonzero(ids != query)
                best = own[np.lexsort((ids[own], score[own]))] if len(own) <= 4 * k else _least(score, ids, own, k)
                seen: dict[int, float] = {}
                for i in best:
                    seen.setdefault(int(ids[i]), float(score[i]))
                    if len(seen) == k:
                        break
                out["query_id"] += [query] * len(seen)
                out["vec_id"] += seen
                out["score"] += seen.values()
        return pa.table({"query_id": pa.array(out["query_id"], pa.int64()), "vec_id": pa.array(out["vec_id"], pa.int64()),
                         "score": pa.array(out["score"], pa.float64())})

    # chunks of rows by the counted sizes, blocks of queries by their share of these; both tables are as short as the forest
    split = spark.createDataFrame([(i, max(1, -(-int(n) // CHUNK_ROWS))) for i, n in enumerate(sizes)], "leaf bigint, chunks int")
    probes = asked.mapInArrow(probe, "query_id bigint, q array<double>, leaf bigint")
    blocks = asked.mapInArrow(lambda batches: _probed(probe, batches), "leaf bigint, n bigint").groupBy("leaf").agg(
        F.greatest(F.lit(1), F.ceil(F.sum("n") / BLOCK_QUERIES)).cast("int").alias("blocks"))
    split = F.broadcast(split.join(blocks, "leaf"))
    salt = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = probes.join(split, "leaf").withColumn("block", salt("query_id", "blocks")).withColumn("chunk", each("chunks"))
    posted = rows.mapInArrow(post, "vec_id bigint, v array<double>, leaf bigint").join(split, "leaf")
    posted = posted.withColumn("chunk", salt("vec_id", "chunks")).withColumn("block", each("blocks"))
    keys = ["leaf", "chunk", "block"]
    met = left.select(*keys, "query_id", "q").groupBy(*keys).cogroup(posted.select(*keys, "vec_id", "v").groupBy(*keys)).applyInArrow(
        meet, "query_id bigint, vec_id bigint, score double")
    best = met.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _least(score: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> np.ndarray:
    """Candidates in order that hold the k least of different ids, ties included."""
    width = k
    while True:
        edge = np.partition(score[own], min(width, len(own)) - 1)[min(width, len(own)) - 1]
        near = own[score[own] <= edge]
        if len(np.unique(ids[near])) >= k or len(near) == len(own):
            return near[np.lexsort((ids[near], score[near]))]
        width *= 2


def _probed(probe, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Leaf counts of the probes of a task."""
    counts: dict[int, int] = {}
    for batch in probe(batches):
        for leaf, n in zip(*np.unique(batch.column(2).to_numpy(), return_counts=True)):
            counts[int(leaf)] = counts.get(int(leaf), 0) + int(n)
    yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int64()), pa.array(list(counts.values()), pa.int64())], names=["leaf", "n"])
