"""Near-duplicates by MinHash with sequential Bayesian verification.

A document is the set of its distinct 5-word shingles. Equal sets form a class and only one member of it is compared. A signature of
``HASHES`` minima gives ``BANDS`` band keys, and one bit of every minimum a sketch, in which bits of two sets of similarity J agree
with probability (1 + J) / 2. Classes that share a band are candidates. Their sketches are compared batch by batch, and a pair is
dropped as soon as the posterior probability of the wanted similarity falls below ``MISS``. Survivors are verified exactly on the
full sets of their whole texts, so no wrong link remains; a right one is missed with the probability of no shared band
(``BAND_MISS`` at the wanted similarity, far less above it) or about ``MISS``.

Large groups of near copies are not expanded into all pairs. In each bucket the member that shares most buckets is the hub, and all others
are verified against it. What is left are pairs in different components, at least one of which is not alike its hub; they can be alike only if they share
a shingle that the hub lacks, or if both are much of the hub's set without the same shingles (``_close``). So members meet again
only in buckets of (hub, shingle beyond the hub), and those of different components are looked at. This step is exact. Random edits of one text
share few such shingles, so pairs grow with the rows; only a large group of copies that share text beyond their hub, and are still not
alike, is looked at in all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce
from math import ceil, log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .components import components
from .decontaminate import BROADCAST_BYTES, document_key

SHINGLE = 5
SIMILARITY = (85, 100)
HASHES = 1024
BAND_HASHES = 768
BAND_MISS = 1e-4
BATCHES = (256, 512, 1024)
MISS = 1e-5
SLICE = 512

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def _seeds(n: int, salt: int) -> np.ndarray:
    return np.random.default_rng(salt).integers(0, 1 << 32, n, dtype=np.uint32)


_A, _B, _C = _seeds(HASHES, 1) | 1, _seeds(HASHES, 2), _seeds(HASHES, 3).astype(np.uint64) | 1


@lru_cache
def band_shape(similarity: tuple[int, int] = SIMILARITY) -> tuple[int, int]:
    """Bands and rows: most rows with which ``BAND_HASHES`` minima share no band with a probability of at most ``BAND_MISS``."""
    j = similarity[0] / similarity[1]
    for rows in range(32, 0, -1):
        bands = 1 if j ** rows >= 1 else ceil(log(BAND_MISS) / log(1 - j ** rows))
        if bands * rows <= BAND_HASHES:
            return bands, rows
    raise ValueError(f"a similarity of {j} is too low for {BAND_HASHES} minima")


def mixed(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads 64-bit values."""
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


class _Words(dict):
    """64-bit hash of a word, remembered for a while."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 250_000:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


_words = _Words()


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes of a whole text.

    Words are runs without ASCII white space, A-Z in lower case. Fewer words than ``size`` are one shingle; none give an empty set.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    width = min(size, len(words))
    n = len(words) - width + 1
    total = np.full(n, np.uint64(width))
    for i in range(width):
        total = mixed(total + hashes[i:i + n] * _ODD[i % len(_ODD)])
    return np.unique(total)


def signature(found: np.ndarray, shape: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Band keys (signed 64-bit) and the packed sketch of a non-empty set."""
    n_bands, rows = shape
    values = (mixed(found + np.uint64(77)) >> np.uint64(32)).astype(np.uint32)
    least = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for start in range(0, len(values), SLICE):
        part = values[start:start + SLICE]
        np.minimum(least, (_A[:, None] * part[None, :] + _B[:, None]).min(axis=1), out=least)
    bands = least[:n_bands * rows].reshape(n_bands, rows).astype(np.uint64)
    keys = mixed((mixed(bands + _C[:rows]) * _C[:rows]).sum(axis=1, dtype=np.uint64) + np.arange(n_bands, dtype=np.uint64))
    bits = ((least * np.uint32(0x9E3779B1)) >> np.uint32(31)).astype(np.uint8)
    return keys.view(np.int64), np.packbits(bits).view(">i8").astype(np.int64)


def alike(a: np.ndarray, b: np.ndarray, similarity: tuple[int, int] = SIMILARITY) -> bool:
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return similarity[1] * shared >= similarity[0] * (len(a) + len(b) - shared)


@lru_cache
def mismatch_bounds(batches=BATCHES, similarity: float = SIMILARITY[0] / SIMILARITY[1], miss: float = MISS) -> list[int]:
    """Most differing bits after each batch with which the similarity may still reach the wanted one.

    With a uniform prior on J and m of n bits differing, the posterior is proportional to ((1 - J) / 2)^m ((1 + J) / 2)^(n - m); the bound is the
    largest m that leaves at least ``miss`` above ``similarity``.
    """
    grid = (np.arange(2000) + 0.5) / 2000
    differ, agree = np.log((1 - grid) / 2), np.log((1 + grid) / 2)
    bounds = []
    for n in batches:
        for m in range(n, -1, -1):
            log = m * differ + (n - m) * agree
            weight = np.exp(log - log.max())
            if weight[grid >= similarity].sum() >= miss * weight.sum():
                bounds.append(m)
                break
    return bounds


def _sketches(documents: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """(key, doc_id, n, set_key, bands, sketch) of every document, stored with a row number."""
    shape = band_shape(similarity)

    def run(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in incoming:
            for start in range(0, len(batch), 200):
                part = batch.slice(start, 200)
                sets = [shingles(t.as_py()) for t in part.column(2)]
                signs = [signature(s, shape) if len(s) else (np.zeros(0, np.int64), np.zeros(0, np.int64)) for s in sets]
                digests = [xxhash.xxh3_128_hexdigest(s.tobytes()) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.string()),
                     pa.array([s[0] for s in signs], pa.list_(pa.int64())), pa.array([s[1] for s in signs], pa.list_(pa.int64()))],
                    names=["key", "doc_id", "n", "set_key", "bands", "sketch"])

    rows = documents.select(document_key().alias("key"), F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    found = rows.mapInArrow(run, "key string, doc_id bigint, n bigint, set_key string, bands array<bigint>, sketch array<bigint>")
    return materialize(found.withColumn("row", F.monotonically_increasing_id()), "sketches")


def _near(a: str, b: str, similarity: tuple[int, int]) -> Column:
    """Length bound and the batches of sketch bits, evaluated in order until one fails."""
    low, high = similarity
    n = F.least(f"{a}.n", f"{b}.n") * high >= F.greatest(f"{a}.n", f"{b}.n") * low
    differs = lambda i: F.bit_count(F.col(f"{a}.sketch")[i].bitwiseXOR(F.col(f"{b}.sketch")[i]))
    tests = [n]
    for bits, most in zip(BATCHES, mismatch_bounds(similarity=low / high)):
        tests.append(reduce(lambda x, y: x + y, [differs(i) for i in range(bits // 64)]) <= most)
    return reduce(lambda x, y: x & y, tests)


def _pruned(pairs: DataFrame, classes: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """Pairs (a, b) whose sketches do not rule the similarity out."""
    sides = classes.select("node", "n", "sketch")
    joined = pairs.join(sides.alias("x"), F.col("a") == F.col("x.node"))
    return joined.join(sides.alias("y"), (F.col("b") == F.col("y.node")) & _near("x", "y", similarity)).select("a", "b")


def _with_texts(pairs: DataFrame, classes: DataFrame, documents: DataFrame) -> DataFrame:
    """(a, b, text_a, text_b), rows of one a mostly together. Texts are fetched for the nodes of pairs only."""
    pairs = materialize(pairs, "pairs")
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    wanted = materialize(classes.select("node", "key").join(nodes, "node").select("node", F.col("key").alias("__key")), "wanted")
    wanted = F.broadcast(wanted) if wanted.count() * 128 <= BROADCAST_BYTES else wanted
    texts = documents.select(document_key().alias("__key"), "text").join(wanted, "__key").dropDuplicates(["node"]).select("node", "text")
    texts = materialize(texts, "texts")
    joined = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    return joined.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a").select("a", "b", "text_a", "text_b")


def _verified(pairs: DataFrame, classes: DataFrame, documents: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """Pairs that reach the similarity on the full sets of their texts."""
    def run(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, own = None, None
        for batch in incoming:
            keep = []
            for a, x, y in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3)):
                if a != held:
                    held, own = a, shingles(x.as_py())
                keep.append(alike(own, shingles(y.as_py()), similarity))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return materialize(_with_texts(pairs, classes, documents).mapInArrow(run, "a bigint, b bigint"), "links")


def _beyond_hubs(ends: DataFrame, classes: DataFrame, documents: DataFrame) -> DataFrame:
    """(hub, node, added, more, missing, total): shingles that only the node has, their number, the number only the hub has, the node's set size."""
    def run(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, own = None, None
        for batch in incoming:
            for start in range(0, len(batch), 200):
                part = batch.slice(start, 200)
                added, missing, total = [], [], []
                for a, x, y in zip(part.column(0).to_pylist(), part.column(2), part.column(3)):
                    if a != held:
                        held, own = a, shingles(x.as_py())
                    other = shingles(y.as_py())
                    added.append(np.setdiff1d(other, own, assume_unique=True).view(np.int64))
                    missing.append(len(own) - (len(other) - len(added[-1])))
                    total.append(len(other))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(added, pa.list_(pa.int64())), pa.array([len(x) for x in added], pa.int64()),
                     pa.array(missing, pa.int64()), pa.array(total, pa.int64())], names=["hub", "node", "added", "more", "missing", "total"])

    pairs = ends.select(F.col("hub").alias("a"), F.col("node").alias("b"))
    found = _with_texts(pairs, classes, documents).mapInArrow(run, "hub bigint, node bigint, added array<bigint>, more bigint, missing bigint, total bigint")
    return materialize(found, "beyond-hubs")


def _close(beyond: DataFrame, roots: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """Pairs of different components that may be alike without a common shingle beyond the hub.

    Alike sets of n and n' shingles differ in at most d = (1 - J) / (1 + J) * (n + n') of them. Of what both lack from the hub they can share no more than
    the lesser number, so they share an added shingle unless more + more' + |missing - missing'| <= d. That is looked up for the few
    distinct (more, missing) of a hub first.
    """
    low, high = similarity
    cell = beyond.select("hub", "more", "missing", "total").distinct()
    x, y = cell.alias("x"), cell.alias("y")
    apart = F.col("x.more") + F.col("y.more") + F.abs(F.col("x.missing") - F.col("y.missing"))
    may = apart * (high + low) <= (F.col("x.total") + F.col("y.total")) * (high - low)
    first = ((F.col("x.more") < F.col("y.more")) | ((F.col("x.more") == F.col("y.more")) & (F.col("x.missing") <= F.col("y.missing"))))
    cells = x.join(y, (F.col("x.hub") == F.col("y.hub")) & first & may).select(
        "x.hub", "x.more", "x.missing", F.col("y.more").alias("more_y"), F.col("y.missing").alias("missing_y"))
    placed = beyond.select("hub", "node", "more", "missing").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    other = placed.select("hub", F.col("node").alias("node_y"), F.col("more").alias("more_y"), F.col("missing").alias("missing_y"), F.col("root").alias("root_y"))
    # cells whose members all are of one component meet nobody, so they are left out before their members are joined
    roots_of = lambda t, cols: t.groupBy(*cols).agg(F.min("root").alias("least"), F.max("root").alias("most"))
    left = roots_of(placed, ["hub", "more", "missing"])
    right = left.select("hub", F.col("more").alias("more_y"), F.col("missing").alias("missing_y"), F.col("least").alias("least_y"), F.col("most").alias("most_y"))
    one = (F.col("least") == F.col("most")) & (F.col("least_y") == F.col("most_y")) & (F.col("least") == F.col("least_y"))
    cells = cells.join(left, ["hub", "more", "missing"]).join(right, ["hub", "more_y", "missing_y"]).where(~one).drop("least", "most", "least_y", "most_y")
    met = placed.join(cells, ["hub", "more", "missing"]).join(other, ["hub", "more_y", "missing_y"]).where(
        (F.col("root") != F.col("root_y")) & (F.col("node") != F.col("node_y")))
    return met.select(F.least("node", "node_y").alias("a"), F.greatest("node", "node_y").alias("b")).distinct()


def _met(members: DataFrame, roots: DataFrame, classes: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """Pairs of members of a bucket in different components whose sketches do not rule the similarity out."""
    placed = members.join(roots, "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("root"))
    sides = materialize(placed.join(classes.select("node", "n", "sketch"), "node"), "open-buckets")
    x, y = sides.alias("x"), sides.alias("y")
    found = x.join(y, (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.root") != F.col("y.root")) & _near(
        "x", "y", similarity))
    return found.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()


def _shared(members: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """Members of buckets with at least two nodes (of at least two components)."""
    placed = members.withColumn("root", F.col("node")) if roots is None else members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    ends = placed.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
    return materialize(members.join(ends.select("bucket"), "bucket"), "members")


def linked(members: DataFrame, classes: DataFrame, documents: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """(node, root) of every node that is alike another one of its bucket or of a chain of such nodes."""
    members = _shared(members)
    degree = members.groupBy("node").agg(F.count("*").alias("degree"))
    hubs = members.join(degree, "node").groupBy("bucket").agg(F.max(F.struct("degree", (-F.col("node")).alias("first"))).alias("top"))
    spokes = members.join(hubs, "bucket").select("bucket", (-F.col("top.first")).alias("hub"), "node").where("hub <> node")
    spokes = materialize(spokes, "spokes")
    ends = spokes.select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    roots = materialize(components(_verified(_pruned(ends, classes, similarity), classes, documents, similarity)), "roots")
    placed = spokes.join(roots, "node", "left").select("bucket", F.coalesce("root", "node").alias("root"))
    split = placed.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
    left = materialize(spokes.join(split.select("bucket"), "bucket").select("hub", "node").distinct(), "split-buckets")
    if left.isEmpty():
        return roots
    beyond = _beyond_hubs(left, classes, documents)
    again = beyond.select("hub", "node", F.explode("added").alias("shingle")).select(F.xxhash64("hub", "shingle").alias("bucket"), "node")
    met = _met(_shared(again.distinct(), roots), roots, classes, similarity)
    more = _verified(met.union(_pruned(_close(beyond, roots, similarity), classes, similarity)).distinct(), classes, documents, similarity)
    tied = roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more)
    return materialize(components(tied), "roots")


def groups(documents: DataFrame, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """key, doc_id, n_shingles, group and component_id of every document; linked from ``similarity`` (a fraction) on.

    ``group`` is equal within a group of near-duplicates; ``component_id`` is its least doc_id (nulls aside). Texts without words
    are groups of their own, also several under one id. Repeated rows, null ids and an empty table are allowed; extra columns are not
    looked at.
    """
    rows = _sketches(documents, similarity)
    full = rows.where("n > 0")
    first = full.groupBy("set_key").agg(F.min("row").alias("node"), F.min("doc_id").alias("least"))
    first = materialize(first, "classes")
    classes = full.join(first.select("node"), F.col("row") == F.col("node")).select("node", "key", "n", "bands", "sketch")
    classes = materialize(classes, "class-sketches")
    roots = linked(classes.select(F.explode("bands").alias("bucket"), "node"), classes, documents, similarity)
    named = first.join(roots, "node", "left").select("set_key", "least", F.coalesce("root", "node").alias("group"))
    least = named.groupBy("group").agg(F.min("least").alias("component_id"))
    named = named.join(least, "group").select("set_key", "group", "component_id")
    joined = rows.select("key", "doc_id", "n", "set_key", "row").join(named, "set_key", "left")
    alone = F.col("group").isNull()
    return joined.select("key", "doc_id", F.col("n").alias("n_shingles"), F.when(alone, -1 - F.col("row")).otherwise(F.col("group")).alias("group"),
                         F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def near_duplicates(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept (the document names its group) of every document."""
    return groups(documents).select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def deduplicated(documents: DataFrame, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """One document of each group, that of the least doc_id (then key), with all columns; of repeated rows one stays."""
    found = materialize(groups(documents, similarity), "groups")
    best = found.where("n_shingles > 0").groupBy("group").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("key"))).alias("best"))
    keys = best.select(F.col("best.key").alias("__key"))
    keyed = documents.withColumn("__key", document_key())
    filled = keyed.join(keys, "__key", "left_semi").dropDuplicates(["__key"]).drop("__key")
    blank = found.where("n_shingles = 0").select(F.col("key").alias("__key")).distinct()
    return filled.unionByName(keyed.join(blank, "__key", "left_semi").drop("__key"))


def sql(documents: str = "documents") -> str:
    """The query for DuckDB: all pairs with a common shingle, then components by recursion."""
    low, high = SIMILARITY
    return f"""
with recursive docs as (select row_number() over () as r, doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from {documents}),
sets as (select r, doc_id, case when len(w) = 0 then [] when len(w) < {SHINGLE} then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - {SHINGLE} + 2), lambda i: array_to_string(w[i:i + {SHINGLE - 1}], ' '))) end as s from docs),
flat as (select r, len(s) as n, unnest(s) as g from sets),
pairs as (select a.r as a, b.r as b, a.n as na, b.n as nb, count(*) as shared from flat a join flat b on a.g = b.g and a.r <> b.r group by all),
links as (select a, b from pairs where {high} * shared >= {low} * (na + nb - shared)),
reach(r, t) as (select r, r from sets union select reach.r, links.b from reach join links on links.a = reach.t),
least as (select reach.r, min(s.doc_id) as component_id from reach join sets s on s.r = reach.t group by reach.r)
select doc_id, len(s)::bigint as n_shingles, component_id, doc_id = component_id as kept from sets join least using (r)"""
