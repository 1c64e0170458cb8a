"""Hard negatives of anchors: rows of another label that score almost as high as a positive.

Components become integers (``floor(scale * x)``) and a score is an exact integer inner product. Anchors are dealt into blocks and rows into
chunks of bounded size by a hash of their row number, so a frequent label, source or vector never meets in one task. Block and
chunk meet in one task; their int64 tiles, padded with zeros where halves are odd, are multiplied by Strassen's
recursion: seven products of half the size and integer additions, which are exact because arithmetic modulo 2^64 is a ring and every score fits a long.

Two passes of bounded heaps: the positives of an anchor (rows of its label) first, then for each positive the heap of rows in its
window of scores. A task keeps heaps only for its own block; the heaps of several chunks merge by rank.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

POSITIVES, NEGATIVES = 5, 5
WINDOW = (80, 100)
SCALE = 256
BLOCK_ANCHORS, CHUNK_ROWS = 16_384, 8_192
TILE = (256, 2_048)
LEAF = 32
EMPTY = np.iinfo(np.int64).min


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """a @ b of int64 matrices. Odd sides are padded with zeros; a side of at most ``leaf`` ends the recursion."""
    (m, k), n = a.shape, b.shape[1]
    if min(m, k, n) <= leaf:
        return a @ b
    x, y, z = (side + 1 >> 1 for side in (m, k, n))
    if (m, k, n) != (2 * x, 2 * y, 2 * z):
        a = np.pad(a, ((0, 2 * x - m), (0, 2 * y - k)))
        b = np.pad(b.T, ((0, 2 * z - n), (0, 2 * y - k))).T  # columns stay contiguous
    a11, a12, a21, a22 = a[:x, :y], a[:x, y:], a[x:, :y], a[x:, y:]
    b11, b12, b21, b22 = b[:y, :z], b[:y, z:], b[y:, :z], b[y:, z:]
    p1 = strassen(a11 + a22, b11 + b22, leaf)
    p2 = strassen(a21 + a22, b11, leaf)
    p3 = strassen(a11, b12 - b22, leaf)
    p4 = strassen(a22, b21 - b11, leaf)
    p5 = strassen(a11 + a12, b22, leaf)
    p6 = strassen(a21 - a11, b11 + b12, leaf)
    p7 = strassen(a12 - a22, b21 + b22, leaf)
    out = np.empty((2 * x, 2 * z), np.int64)
    out[:x, :z] = p1 + p4 - p5 + p7
    out[:x, z:] = p3 + p5
    out[x:, :z] = p2 + p4
    out[x:, z:] = p1 - p2 + p3 + p6
    return out[:m, :n]


def scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products of integer vectors (one a line); the shorter kind of vector is padded with zeros. Raises if one may not fit a long."""
    if not anchors.size or not rows.size:
        return np.zeros((len(anchors), len(rows)), np.int64)
    width = max(anchors.shape[1], rows.shape[1])
    a, b = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (anchors, rows))
    largest = [max(abs(int(m.min())), abs(int(m.max()))) for m in (a, b)]
    if width * largest[0] * largest[1] >= 1 << 63:
        raise OverflowError("inner products may not fit a 64-bit integer")
    return strassen(a, b.T)


class Heaps:
    """The ``k`` best (score, id) of every slot: higher scores first, then smaller ids. Missing places hold ``EMPTY``."""

    def __init__(self, slots: int, k: int):
        self.k, self.score, self.id = k, np.full((slots, k), EMPTY), np.zeros((slots, k), np.int64)

    def push(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Merges (slot, score, id) entries in any order."""
        used = np.unique(slot)
        if not len(used):
            return
        held = self.score[used] != EMPTY
        slot = np.concatenate([slot, np.repeat(used, held.sum(axis=1))])
        score, ids = np.concatenate([score, self.score[used][held]]), np.concatenate([ids, self.id[used][held]])
        order = np.lexsort((ids, ~score, slot))
        slot, score, ids = slot[order], score[order], ids[order]
        first = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]]))
        place = np.arange(len(slot)) - np.repeat(first, np.diff(np.append(first, len(slot))))
        best = place < self.k
        self.score[used] = EMPTY
        self.score[slot[best], place[best]] = score[best]
        self.id[slot[best], place[best]] = ids[best]

    def entries(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """slot, score and id of all members."""
        slot, place = np.nonzero(self.score != EMPTY)
        return slot, self.score[slot, place], self.id[slot, place]


def push_tile(heaps: Heaps, slots: np.ndarray, score: np.ndarray, allowed: np.ndarray, ids: np.ndarray) -> None:
    """Pushes the entries of a tile (a line for each slot) that may be among the best k; ties at the edge all go in."""
    floor = heaps.score[slots, heaps.k - 1]
    allowed = allowed & (score >= floor[:, None])
    if score.shape[1] > heaps.k:
        open_score = np.where(allowed, score, EMPTY)
        edge = np.partition(open_score, score.shape[1] - heaps.k, axis=1)[:, score.shape[1] - heaps.k]
        allowed &= score >= edge[:, None]
    line, column = np.nonzero(allowed)
    heaps.push(slots[line], score[line, column], ids[column])


def integers(vectors: pa.Array, scale: int) -> np.ndarray:
    """floor(scale * x) of lists of doubles as an int64 matrix, short ones padded with zeros."""
    lengths = np.array(vectors.value_lengths().to_pylist(), np.int64)
    flat = np.floor(scale * vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    if np.abs(flat).max(initial=0) >= 2.0 ** 62:
        raise OverflowError("components do not fit a 64-bit integer")
    out = np.zeros((len(lengths), int(lengths.max(initial=0))), np.int64)
    out[np.arange(out.shape[1])[None, :] < lengths[:, None]] = flat.astype(np.int64)
    return out


def _tiles(n: int, m: int):
    for i in range(0, n, TILE[0]):
        for j in range(0, m, TILE[1]):
            yield slice(i, i + TILE[0]), slice(j, j + TILE[1])


def _side(table: pa.Table, scale: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """id, label and integer vector of the rows of one side, in the order of ids."""
    table = table.sort_by("id").combine_chunks()
    return table.column("id").to_numpy(), table.column("label").to_numpy(), integers(table.column("v").combine_chunks(), scale)


def _positives(anchors: pa.Table, rows: pa.Table, k: int, scale: int) -> pa.Table:
    """Partial heaps of a block and a chunk: the best rows of each anchor's label."""
    keys, own, wanted, a = anchors.column("key").to_numpy(), anchors.column("id").to_numpy(), anchors.column("label").to_numpy(), integers(
        anchors.column("v").combine_chunks(), scale)
    ids, labels, b = _side(rows, scale)
    heaps = Heaps(len(keys), k)
    for label in np.intersect1d(wanted, labels):
        line, column = np.flatnonzero(wanted == label), np.flatnonzero(labels == label)
        for i, j in _tiles(len(line), len(column)):
            push_tile(heaps, line[i], scores(a[line[i]], b[column[j]]), own[line[i]][:, None] != ids[column[j]][None, :], ids[column[j]])
    slot, score, found = heaps.entries()
    return pa.table({"key": keys[slot], "positive_id": found, "positive_score": score})


def _negatives(anchors: pa.Table, rows: pa.Table, k: int, window: tuple[int, int], scale: int) -> pa.Table:
    """Partial heaps of a block and a chunk: for each positive of an anchor the best rows of other labels in its window."""
    keys, own, wanted, a = anchors.column("key").to_numpy(), anchors.column("id").to_numpy(), anchors.column("label").to_numpy(), integers(
        anchors.column("v").combine_chunks(), scale)
    tops = anchors.column("tops").combine_chunks()
    counts = np.array(tops.value_lengths().to_pylist(), np.int64)
    width = int(counts.max(initial=0))
    upper, lower = np.full((len(keys), width), EMPTY), np.zeros((len(keys), width), np.int64)
    held = np.arange(width)[None, :] < counts[:, None]
    flat = tops.flatten().to_numpy()
    upper[held], lower[held] = flat, [-(-window[0] * int(s) // window[1]) for s in flat]
    ids, labels, b = _side(rows, scale)
    heaps = Heaps(len(keys) * width, k)
    for i, j in _tiles(len(keys), len(ids)):
        product = scores(a[i], b[j])
        other = (wanted[i][:, None] != labels[j][None, :]) & (own[i][:, None] != ids[j][None, :])
        for p in range(width):
            lines = np.arange(len(keys))[i] * width + p
            inside = other & (product <= upper[i, p][:, None]) & (product >= lower[i, p][:, None]) & held[i, p][:, None]
            push_tile(heaps, lines, product, inside, ids[j])
    slot, score, found = heaps.entries()
    return pa.table({"key": keys[slot // max(1, width)], "slot": (slot % max(1, width)).astype(np.int32) + np.int32(1), "negative_id": found,
                     "negative_score": score})


def _taking_part(table: DataFrame, identity: str, label: str, vector: str) -> DataFrame:
    named = table.select(F.col(identity).cast("bigint").alias("id"), F.col(label).cast("bigint").alias("label"), F.col(vector).alias("v"))
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return named.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & ~odd)


def mine(rows: DataFrame, anchors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, window: tuple[int, int] = WINDOW,
         scale: int = SCALE, identity: str = "vec_id", label: str = "label", vector: str = "embedding") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score of every anchor's hard negatives.

    Positives are the best rows of the anchor's label, negatives the best ones of other labels with
    ``window[0] * positive_score <= window[1] * negative_score <= window[1] * positive_score``; ties go to the smaller id. Rows that share the anchor's
    id are neither. Rows with a null id, label or vector, or with a null or non-finite component, take no part; shorter vectors are
    padded with zeros, and the empty one scores 0. Repeated rows each take a place, repeated anchors give their result once. Anchors without
    positives, and positives without negatives, give no row; an empty table gives none. Columns of other names are not looked at. Scores
    that cannot be held in 64 bits are an error.
    """
    every = materialize(_taking_part(rows, identity, label, vector).withColumn("row", F.monotonically_increasing_id()), "vectors")
    asked = _taking_part(anchors, identity, label, vector).distinct()
    asked = materialize(asked.withColumn("key", F.monotonically_increasing_id()), "anchors")
    blocks = max(1, -(-asked.count() // BLOCK_ANCHORS))
    chunks = max(1, -(-every.count() // CHUNK_ROWS))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    deal = lambda column, n: F.pmod(F.xxhash64(column), F.lit(n)).cast("int")
    dealt = every.withColumn("chunk", deal("row", chunks)).withColumn("block", each(blocks)).drop("row").groupBy("block", "chunk")

    def meet(left: DataFrame, f, schema: str) -> DataFrame:
        spread = left.withColumn("block", deal("key", blocks)).withColumn("chunk", each(chunks)).groupBy("block", "chunk")
        return spread.cogroup(dealt).applyInArrow(lambda x, y: f(x, y), schema)

    def ranked(found: DataFrame, keys: list[str], score: str, found_id: str, k: int) -> DataFrame:
        order = Window.partitionBy(*keys).orderBy(F.desc(score), found_id)
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    partial = meet(asked, lambda x, y: _positives(x, y, positives, scale), "key bigint, positive_id bigint, positive_score bigint")
    best = materialize(ranked(partial, ["key"], "positive_score", "positive_id", positives).withColumnRenamed("rank", "slot"), "positives")
    tops = best.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("slot", "positive_score"))).alias("tops"))  # at most ``positives`` each
    held = asked.join(tops.select("key", F.col("tops.positive_score").alias("tops")), "key")
    partial = meet(held, lambda x, y: _negatives(x, y, negatives, window, scale), "key bigint, slot int, negative_id bigint, negative_score bigint")
    hard = ranked(partial, ["key", "slot"], "negative_score", "negative_id", negatives)
    named = hard.join(best, ["key", "slot"]).join(asked.select("key", F.col("id").alias("anchor_id")), "key")
    return named.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def relabelled(every: int = 7, labels: int = 10) -> Column:
    """The label of the query's task: moved on by one where the id is divisible by ``every``."""
    return F.when(F.col("vec_id") % every == 0, (F.col("label") + 1) % labels).otherwise(F.col("label"))


def sql(embeddings: str = "embeddings") -> str:
    """The query for DuckDB: all anchors against all rows. Scores below 2^53 are exact in doubles."""
    low, high = WINDOW
    first = lambda keys, score, one: f"row_number() over (partition by {keys} order by {score} desc, {one})"
    return f"""
with used as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: floor({SCALE} * x::double)) as v from {embeddings}
  where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
pairs as (select a.vec_id as anchor_id, b.vec_id as id, a.label = b.label as same, list_dot_product(a.v, b.v)::bigint as score
  from used a join used b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
positives as (select anchor_id, id as positive_id, score as positive_score from pairs where same
  qualify {first('anchor_id', 'score', 'id')} <= {POSITIVES})
select anchor_id, positive_id, {first('anchor_id, positive_id', 'score', 'id')}::int as rank, id as negative_id, positive_score, score as negative_score
from positives join pairs using (anchor_id) where not same and {low} * positive_score <= {high} * score and score <= positive_score
qualify {first('anchor_id, positive_id', 'score', 'id')} <= {NEGATIVES}"""
