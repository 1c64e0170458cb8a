"""Byte-level BPE encoding and decoding with batched numpy merge rounds.

Symbols of many words lie in one flat array. A round looks up every neighbouring pair by binary search over the
sorted pair keys, takes in each word the pair of lowest rank, merges its occurrences from the left, and closes the
gaps; words without a known pair drop out. The rounds end when no word is left.

The vocabulary is a file of the tokenizers library (byte-level, no normalizer); its path is a parameter and has to be readable
on the executors. Texts are split at single spaces first: the splitting pattern always cuts there, so each distinct
segment is encoded once per worker (``segments.py``). Texts with other spacing take the pattern over the whole text.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .segments import Segments, gather

# Fixed value: the published splitting pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
ROUND_SYMBOLS = 500_000  # about 50 MB of arrays at once
OTHER_SPACES = tuple(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n")
BATCH_CHARS = 500_000  # texts that a worker has in pieces at once; 4 million took 150 MB more
KEPT_SEGMENTS = 300_000  # about 60 MB in a worker, which keeps them between tasks


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable ones themselves, the others from code point 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    shifted = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(shifted)) for b in range(256)]


class ByteBpe:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, vocab = spec["model"], spec["model"]["vocab"]
        if spec["normalizer"] is not None or spec["pre_tokenizer"]["type"] != "ByteLevel" or model["ignore_merges"]:
            raise ValueError(f"{path} is not a plain byte-level vocabulary")
        letters = byte_letters()
        self.byte_ids = np.array([vocab[c] for c in letters], np.int64)
        pairs = [p if isinstance(p, list) else p.split(" ") for p in model["merges"]]
        left, right = (np.array([vocab[p[i]] for p in pairs], np.int64) for i in (0, 1))
        keys = left << 32 | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order
        self.merged = np.array([vocab["".join(p)] for p in pairs], np.int64)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_pattern = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.pattern = regex.compile(PATTERN)
        to_byte = {c: b for b, c in enumerate(letters)}
        tokens = {i: bytes(to_byte[c] for c in t) for t, i in vocab.items()} | {i: t.encode() for t, i in self.special.items()}
        pieces = [tokens.get(i, b"") for i in range(max(tokens) + 1)]
        self.token_bytes = np.frombuffer(b"".join(pieces), np.uint8)
        self.token_lengths = np.array([len(p) for p in pieces], np.int64)
        self.token_starts = np.cumsum(self.token_lengths) - self.token_lengths
        self.segments = Segments(self._encode_segments, KEPT_SEGMENTS)

    def merge(self, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merges all words at once. ``word`` is the rising word number of each symbol; returns both, merged."""
        done_symbols, done_words = [], []
        none = len(self.keys)
        while len(symbols) > 1:
            pair = symbols[:-1] << 32 | symbols[1:]
            found = np.minimum(np.searchsorted(self.keys, pair), none - 1)
            rank = np.where((self.keys[found] == pair) & (word[:-1] == word[1:]), self.ranks[found], none)
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            sizes = np.diff(np.append(first, len(word)))
            best = np.minimum.reduceat(np.append(rank, none), first)
            live = np.repeat(best < none, sizes)
            done_symbols.append(symbols[~live])
            done_words.append(word[~live])
            hit = np.flatnonzero((rank < none) & (rank == np.repeat(best, sizes)[:-1]))
            if not len(hit):
                symbols = word = symbols[:0]
                break
            follows = np.concatenate([[False], np.diff(hit) == 1])  # overlapping pairs such as "aaa": every second one
            run = np.arange(len(hit)) - np.maximum.accumulate(np.where(follows, 0, np.arange(len(hit))))
            hit = hit[run % 2 == 0]
            symbols = symbols.copy()
            symbols[hit] = self.merged[rank[hit]]
            live[hit + 1] = False
            symbols, word = symbols[live], word[live]
        symbols, word = np.concatenate([*done_symbols, symbols]), np.concatenate([*done_words, word])
        order = np.argsort(word, kind="stable")
        return symbols[order], word[order]

    def encode_words(self, words: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and their number per word, for words that the pattern does not cut any further."""
        ids, lengths, at = [], np.zeros(len(words), np.int64), 0
        while at < len(words):
            batch, size = [], 0
            while at + len(batch) < len(words) and (not batch or size < ROUND_SYMBOLS):
                batch.append(words[at + len(batch)].encode("utf-8"))
                size += len(batch[-1])
            sizes = np.array([len(b) for b in batch], np.int64)
            symbols = self.byte_ids[np.frombuffer(b"".join(batch), np.uint8)]
            merged, word = self.merge(symbols, np.repeat(np.arange(len(batch)), sizes))
            ids.append(merged)
            lengths[at:at + len(batch)] = np.bincount(word, minlength=len(batch))
            at += len(batch)
        return np.concatenate([*ids, np.zeros(0, np.int64)]).astype(np.uint32), lengths

    def _encode_segments(self, segments: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        cut = [self._cut(s) for s in segments]
        words = {w: i for i, w in enumerate(dict.fromkeys(w for c in cut for w in c if isinstance(w, str)))}
        flat, sizes = self.encode_words(list(words))
        flat = np.concatenate([flat, np.array(list(self.special.values()), np.uint32)])
        special = {i: len(words) + k for k, i in enumerate(self.special.values())}
        sizes = np.concatenate([sizes, np.ones(len(special), np.int64)])
        starts = np.cumsum(sizes) - sizes
        index = np.array([words[w] if isinstance(w, str) else special[w] for c in cut for w in c], np.int64)
        owner = np.repeat(np.arange(len(cut)), [len(c) for c in cut])
        lengths = np.bincount(owner, sizes[index], len(cut)).astype(np.int64) if len(index) else np.zeros(len(cut), np.int64)
        return flat[gather(starts[index], sizes[index])], lengths

    def _cut(self, text: str) -> list[str | int]:
        """Words of the pattern; an added token stands as its id."""
        if self.special_pattern is None or "<" not in text:
            return self.pattern.findall(text)
        out, at = [], 0
        for m in self.special_pattern.finditer(text):
            out += self.pattern.findall(text[at:m.start()])
            out.append(self.special[m.group()])
            at = m.end()
        return out + self.pattern.findall(text[at:])

    @staticmethod
    def _spaced(text: str) -> list[str]:
        """Segments, each with the space before it; the whole text where a space has white space beside it."""
        if not text or "  " in text or " \n" in text or "\n " in text or text[0].isspace() or text[-1].isspace():
            return [text] if text else []
        parts = text.split(" ")
        if any(c in text for c in OTHER_SPACES) and any(p[0].isspace() or p[-1].isspace() for p in parts):
            return [text]
        return [parts[0], *map(" ".__add__, parts[1:])]

    def encode(self, texts: Sequence[str | None]) -> list[np.ndarray]:
        """Ids of every whole text; null counts as empty."""
        split = [self._spaced(t or "") for t in texts]
        short = [i for i, s in enumerate(split) if len(s) > 1 or (s and len(s[0]) < 200)]
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(texts)
        if short:
            for i, ids in zip(short, self.segments.ids([split[i] for i in short])):
                out[i] = ids
        for i in set(range(len(texts))).difference(short):
            if split[i]:
                out[i] = self._long(split[i][0])
        return out

    def _long(self, text: str) -> np.ndarray:
        """A text that is one segment: its words go through the store instead."""
        words = [w if isinstance(w, str) else next(t for t, i in self.special.items() if i == w) for w in self._cut(text)]
        return self.segments.ids([words])[0]

    def decode(self, ids: np.ndarray) -> str:
        """Text of the ids; bytes that are no UTF-8 become U+FFFD."""
        ids = np.asarray(ids, np.int64)
        raw = self.token_bytes[gather(self.token_starts[ids], self.token_lengths[ids])]
        return raw.tobytes().decode("utf-8", "replace")


@lru_cache(maxsize=2)
def byte_bpe(path: str) -> ByteBpe:
    """One encoder per worker process; its store of segments outlives a task."""
    return ByteBpe(path)


def batches(texts: pa.Array, chars: int = BATCH_CHARS) -> Iterator[tuple[int, list[str | None]]]:
    """Slices of an Arrow column, each of bounded text (at least one row)."""
    start, held, size = 0, [], 0
    for i, value in enumerate(texts):
        text = value.as_py()
        if held and size + len(text or "") > chars:
            yield start, held
            start, held, size = i, [], 0
        held.append(text)
        size += len(text or "")
    if held:
        yield start, held


def encode_documents(documents: DataFrame, path: str, column: str = "text", ids: str = "token_ids", decoded: str | None = None) -> DataFrame:
    """Adds the token ids of every whole text as an array of integers; null and empty texts have none.

    With ``decoded`` the ids are turned into text again in the same task, which spares a second set of Python workers.

    Narrow and streaming: rows pass in Arrow batches and no row depends on another. Other columns are kept; one
    already named ``ids`` is replaced.
    """
    kept = documents.drop(ids, *([decoded] if decoded else []))
    names = kept.columns

    def run(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path)
        for batch in incoming:
            for start, texts in batches(batch.column(names.index(column))):
                found = bpe.encode(texts)
                offsets = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([*found, np.zeros(0, np.uint32)]).astype(np.int32)))
                back = [pa.array([bpe.decode(f) for f in found], pa.string())] if decoded else []
                yield pa.RecordBatch.from_arrays([*batch.slice(start, len(texts)).columns, lists, *back], names=[*names, ids, *([decoded] if decoded else [])])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return kept.mapInArrow(run, f"{fields}, `{ids}` array<int>" + (f", `{decoded}` string" if decoded else ""))


def decode_documents(documents: DataFrame, path: str, ids: str = "token_ids", column: str = "decoded") -> DataFrame:
    """Adds the text of an array of token ids; null and empty arrays give an empty text."""
    kept = documents.drop(column)
    names = kept.columns

    def run(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path)
        for batch in incoming:
            texts = [bpe.decode(v.values.to_numpy(zero_copy_only=False)) if v.is_valid else "" for v in batch.column(names.index(ids))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*names, column])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return kept.mapInArrow(run, f"{fields}, `{column}` string")


def digests(documents: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document.

    The ids are decoded in the task that made them. Ids are hashed as little-endian unsigned 32-bit integers, null texts as empty ones.
    """
    def run(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path)
        for batch in incoming:
            for start, texts in batches(batch.column(1)):
                found = bpe.encode(texts)
                sizes = pa.array([len(f) for f in found], pa.int64())
                hashed = pa.array([hashlib.sha256(f.astype("<u4").tobytes()).hexdigest() for f in found])
                decoded = pa.array([hashlib.sha256(bpe.decode(f).encode("utf-8")).hexdigest() for f in found])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(texts)), sizes, hashed, decoded],
                                                 names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = documents.selectExpr("cast(doc_id as bigint) as doc_id", "text")
    return rows.mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
