"""Token ids packed as one wavelet matrix per shard file.

A wavelet matrix keeps, from the highest bit down, one bit-plane of all ids, stably reordered by the bits above: zeros
first. With rank counts per block of a plane, one file answers ``access`` (id at a position), ``rank`` (how often an id
occurs before a position), ``count`` and ``select`` (position of its k-th occurrence).

File: magic, a JSON header, then blocks. Planes are cut into blocks that are compressed each for itself; the header has
their places and the number of ones before each, so a lookup reads and unpacks one block per plane. Document ends are a section of their own.

Shards follow ascending doc_id: rows are dealt by ranges, a task closes a shard once it has enough ids, and documents are
never cut. Files go to a folder all executors share and are reported by the task; only reported ones are read.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import chain
from operator import attrgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize, shared_folder
from .archives import open_folder
from .bpe import byte_letters
from .segments import Segments, gather

MAGIC = b"WVM1"
BLOCK_BITS = 1 << 17
SHARD_IDS = 2_000_000
END_ID = 1
SLICE_BYTES = 4_000_000  # text that is encoded at once


def build(ids: np.ndarray, width: int | None = None) -> tuple[list[np.ndarray], list[int]]:
    """Bit-planes (as booleans, highest bit first) and the number of zeros of each."""
    ids = np.asarray(ids)
    width = max(1, int(ids.max()).bit_length() if len(ids) else 1) if width is None else width
    ids = ids.astype(np.uint16 if width <= 16 else np.uint32)
    planes, zeros = [], []
    for level in range(width - 1, -1, -1):
        bits = (ids >> level & 1).astype(bool)
        planes.append(bits)
        low = ids[~bits]
        zeros.append(len(low))
        ids = np.concatenate([low, ids[bits]])
    return planes, zeros


def restore(planes: Sequence[np.ndarray], zeros: Sequence[int]) -> np.ndarray:
    """All ids of a matrix, in order: the planes are undone from the lowest."""
    width, size = len(planes), len(planes[0])
    ids = np.zeros(size, np.uint16 if width <= 16 else np.uint32)
    for level, (bits, low) in enumerate(zip(reversed(planes), reversed(zeros))):
        above = np.empty_like(ids)
        above[~bits] = ids[:low]
        above[bits] = ids[low:] | ids.dtype.type(1 << level)
        ids = above
    return ids.astype(np.uint32)


def dump(ids: np.ndarray, doc_ids: Sequence[int | None], ends: np.ndarray) -> bytes:
    """The shard file of some ids; ``ends`` are the ends of the documents in it."""
    planes, zeros = build(ids)
    packer, blocks, table = zstandard.ZstdCompressor(level=1), [], []
    at = 0
    for bits in planes:
        places, ones, before = [], [], 0
        for start in range(0, len(bits), BLOCK_BITS):
            part = bits[start:start + BLOCK_BITS]
            blocks.append(packer.compress(np.packbits(part).tobytes()))
            places.append((at, len(blocks[-1])))
            ones.append(before)
            before += int(part.sum())
            at += len(blocks[-1])
        table.append({"places": places, "ones": ones})
    # The document table: doc_ids and ends, compressed apart. A null id is written as its own flag.
    nulls = np.array([d is None for d in doc_ids], bool)
    docs = packer.compress(np.packbits(nulls).tobytes() + np.array([d or 0 for d in doc_ids], "<i8").tobytes()
                           + np.asarray(ends, "<i8").tobytes())
    header = json.dumps({"ids": len(ids), "docs": len(doc_ids), "width": len(planes), "zeros": zeros, "planes": table,
                         "block_bits": BLOCK_BITS, "doc_place": (at, len(docs))}, separators=(",", ":")).encode()
    return b"".join([MAGIC, len(header).to_bytes(8, "little"), header, *blocks, docs])


class Shard:
    """Reader of one shard file; ``file`` has ``seek`` and ``read``."""

    def __init__(self, file):
        self.file = file
        if self.file.read(4) != MAGIC:
            raise ValueError("no wavelet shard")
        size = int.from_bytes(self.file.read(8), "little")
        self.meta = json.loads(self.file.read(size))
        self.base = 12 + size
        self.size, self.width = self.meta["ids"], self.meta["width"]
        self._held: dict[tuple[int, int], np.ndarray] = {}

    def _section(self, place) -> bytes:
        self.file.seek(self.base + place[0])
        return zstandard.ZstdDecompressor().decompress(self.file.read(place[1]))

    def _block(self, level: int, block: int) -> np.ndarray:
        key = level, block
        if key not in self._held:
            if len(self._held) > 4 * self.width:
                self._held.clear()
            start = block * self.meta["block_bits"]
            count = min(self.meta["block_bits"], self.size - start)
            raw = np.frombuffer(self._section(self.meta["planes"][level]["places"][block]), np.uint8)
            self._held[key] = np.unpackbits(raw, count=count).astype(bool)
        return self._held[key]

    def _ones(self, level: int, position: int) -> int:
        """Ones of a plane before a position."""
        if position == 0:
            return 0
        block, inside = divmod(position - 1, self.meta["block_bits"])
        return self.meta["planes"][level]["ones"][block] + int(self._block(level, block)[:inside + 1].sum())

    def _bit(self, level: int, position: int) -> bool:
        block, inside = divmod(position, self.meta["block_bits"])
        return bool(self._block(level, block)[inside])

    def access(self, position: int) -> int:
        """Id at a position."""
        if not 0 <= position < self.size:
            raise IndexError(position)
        value = 0
        for level in range(self.width):
            bit, ones = self._bit(level, position), self._ones(level, position)
            position = self.meta["zeros"][level] + ones if bit else position - ones
            value = value << 1 | bit
        return value

    def _range(self, token: int, position: int) -> tuple[int, int]:
        """Bounds, in the order below the last plane, of the occurrences before a position."""
        start, end = 0, position
        for level in range(self.width):
            a, b = self._ones(level, start), self._ones(level, end)
            if token >> (self.width - 1 - level) & 1:
                start, end = self.meta["zeros"][level] + a, self.meta["zeros"][level] + b
            else:
                start, end = start - a, end - b
        return start, end

    def rank(self, token: int, position: int | None = None) -> int:
        """Occurrences of an id before a position (all by default)."""
        if token < 0 or token >> self.width:
            return 0
        start, end = self._range(token, self.size if position is None else min(position, self.size))
        return end - start

    count = rank

    def select(self, token: int, k: int) -> int:
        """Position of the k-th occurrence, from 0."""
        if not 0 <= k < self.rank(token):
            raise IndexError(k)
        position = self._range(token, self.size)[0] + k
        for level in range(self.width - 1, -1, -1):
            bit = token >> (self.width - 1 - level) & 1
            position = self._nth(level, position - self.meta["zeros"][level] if bit else position, bool(bit))
        return position

    def _nth(self, level: int, k: int, bit: bool) -> int:
        """Position of the k-th bit of a kind: binary search over the block counts, then inside one block."""
        ones, step = self.meta["planes"][level]["ones"], self.meta["block_bits"]
        before = lambda b: ones[b] if bit else b * step - ones[b]
        low, high = 0, len(ones) - 1
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if before(mid) <= k else (low, mid - 1)
        return low * step + int(np.flatnonzero(self._block(level, low) == bit)[k - before(low)])

    def ids(self) -> np.ndarray:
        """All ids, plane by plane."""
        if self.size == 0:
            return np.zeros(0, np.uint32)
        planes = [np.concatenate([self._block(level, b) for b in range(len(self.meta["planes"][level]["ones"]))])
                  for level in range(self.width)]
        return restore(planes, self.meta["zeros"])

    def documents(self) -> tuple[list[int | None], np.ndarray]:
        """Ids of the documents and their ends in the shard."""
        raw, n = self._section(self.meta["doc_place"]), self.meta["docs"]
        flags = (n + 7) // 8
        nulls = np.unpackbits(np.frombuffer(raw[:flags], np.uint8), count=n)
        docs, ends = np.frombuffer(raw[flags:], "<i8").reshape(2, n)
        return [None if z else int(d) for d, z in zip(docs, nulls)], ends


class WordEncoder:
    """Ids of the tokenizers library for whole texts, by distinct segments.

    Texts are cut at spaces and line feeds: the normalizer (NFC, white space, lower case) and the splitting pattern of this vocabulary
    never join across one. A full stop or comma after plain Latin letters is cut off as well, as the pattern splits there.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.stops = {c: self._plain([c])[0][0] for c in ".,"}
        self.whole = Segments(self._encode)
        self.letters = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
        letters = byte_letters()
        self.spelled = {c: "".join(letters[b] for b in chr(c).encode("utf-8")) for c in range(0x80, 0x100)}

    def _plain(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and lengths of lower-case words of Latin letters, by the library's BPE model.

        The library's other steps leave such words as they are, but for spelling their bytes as letters.
        """
        tokenize, sizes, flat = self.tokenizer.model.tokenize, np.zeros(len(words), np.int64), [np.zeros(0, np.uint32)]
        for at in range(0, len(words), 10_000):
            found = [tokenize(w if w.isascii() else w.translate(self.spelled)) for w in words[at:at + 10_000]]
            sizes[at:at + len(found)] = list(map(len, found))
            flat.append(np.fromiter(map(attrgetter("id"), chain.from_iterable(found)), np.uint32))
        return np.concatenate(flat), sizes

    def _encode(self, segments: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        words: dict[str, int] = {}
        others: dict[str, int] = {}
        places, lasts, stops = [], [], self.stops.get
        for s in segments:
            last = stops(s[-1:])
            stem = s if last is None else s[:-1]
            if stem.isalpha() if stem.isascii() else self.letters.fullmatch(stem):
                places.append(words.setdefault(stem.lower(), len(words)))
                lasts.append(last or 0)
            else:
                places.append(-1 - others.setdefault(s, len(others)))
                lasts.append(0)
        index, stop = np.array(places, np.int64), np.array(lasts, np.uint32)
        ids, sizes = self._words(list(words)) if words else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
        found = self._plain(list(others))
        flat = np.concatenate([ids, np.array([i for f in found for i in f], np.uint32)])
        sizes = np.concatenate([sizes, np.array([len(f) for f in found], np.int64)])
        index = np.where(index < 0, len(words) - 1 - index, index)
        own, stops = sizes[index], stop > 0
        lengths = own + stops
        out, starts = np.zeros(int(lengths.sum()), np.uint32), np.cumsum(lengths) - lengths
        out[gather(starts, own)] = flat[gather((np.cumsum(sizes) - sizes)[index], own)]
        out[(starts + own)[stops]] = stop[stops]
        return out, lengths

    def encode(self, texts: pa.Array | Sequence[str | None]) -> list[np.ndarray]:
        """Ids of every whole text. Arrow cuts the texts and tells equal segments together; only distinct ones are looked up."""
        column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        cut = pc.split_pattern(pc.replace_substring(pc.fill_null(column, ""), "\n", " "), " ")
        coded = cut.flatten().dictionary_encode()
        places = self.whole.places_of(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        return self.whole.take(places[coded.indices.to_numpy()], cut.value_lengths().to_numpy())


def slices(texts: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """Parts of an Arrow column, each of bounded text (at least one row), with the place of their first row."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy().astype(np.int64))
    start = 0
    while start < len(texts):
        before = int(ends[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + size, "right")))
        yield start, texts.slice(start, stop - start)
        start = stop


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def write_shards(documents: DataFrame, path: str, folder: str, end_id: int = END_ID, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Encodes whole texts, each followed by ``end_id``, into shard files; reports (part, number, file, ids, docs).

    Parts are ranges of (doc_id, hash of the text) in order, so repeated ids split too; null ids come first, null texts
    are empty. A shard holds at least ``shard_ids`` ids, but for a part's last, and at most one document more.
    """
    spark = documents.sparkSession
    rows = documents.selectExpr("cast(doc_id as bigint) as doc_id", "text", "xxhash64(text) as tie")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(parts, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    rows = rows.select(F.spark_partition_id().alias("part"), "doc_id", "text")
    names = ["part", "number", "file", "ids", "docs"]

    def run(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, (fs, at) = word_encoder(path), open_folder(folder)
        part, number, held, docs, size, reports = None, 0, [], [], 0, []

        def close():
            nonlocal number, held, docs, size
            file = f"{uuid.uuid4().hex}.wvm"
            ends = np.cumsum([len(h) for h in held])
            fs.create_dir(at, recursive=True)
            with fs.open_output_stream(f"{at}/{file}", compression=None) as sink:
                sink.write(dump(np.concatenate(held), docs, ends))
            reports.append((part, number, file, size, len(docs)))
            number, held, docs, size = number + 1, [], [], 0

        for batch in incoming:
            part = batch.column(0)[0].as_py() if len(batch) else part
            ids = batch.column(1).to_pylist()
            for start, texts in slices(batch.column(2)):
                for i, found in enumerate(encoder.encode(texts)):
                    held.append(np.append(found, np.uint32(end_id)))
                    docs.append(ids[start + i])
                    size += len(held[-1])
                    if size >= shard_ids:
                        close()
        if held:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in reports], t) for i, t in enumerate(
            (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()))], names=names)

    return materialize(rows.mapInArrow(run, "part int, number int, file string, ids bigint, docs bigint"), "wavelet-shards")


def with_starts(shards: DataFrame) -> DataFrame:
    """Adds ``start``: ids in all shards before. Sums run over the parts first, then inside each part."""
    parts = shards.groupBy("part").agg(F.sum("ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.withColumn("inside", F.coalesce(F.sum("ids").over(inside), F.lit(0)))
    return shards.join(parts, "part").withColumn("start", F.col("base") + F.col("inside")).drop("base", "inside")


def read_shards(shards: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files.

    One file is read at a time; ids are hashed as little-endian unsigned 32-bit integers.
    """
    def run(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = open_folder(folder)
        for batch in incoming:
            for file, base in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist()):
                with fs.open_input_file(f"{at}/{file}") as source:
                    shard = Shard(source)
                    ids, (docs, ends) = shard.ids().astype("<u4"), shard.documents()
                starts = np.concatenate([[0], ends[:-1]])
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(starts, ends)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(docs, pa.int64()), pa.array(base + starts, pa.int64()), pa.array(ends - starts, pa.int64()), pa.array(crc, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"])

    files = with_starts(shards).select("file", "start").repartition(max(1, min(shards.count(), 4096)))
    return files.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def documents_through_shards(documents: DataFrame, path: str) -> DataFrame:
    """Writes all documents as wavelet shards and reads the result from the files. An empty table gives no row."""
    folder = f"{shared_folder(documents.sparkSession)}/wavelet-{uuid.uuid4().hex}"
    return read_shards(write_shards(documents, path, folder), folder)
