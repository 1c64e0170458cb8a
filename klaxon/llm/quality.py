"""Quality scores of documents by a factorisation machine.

Features are hashed distinct words, structure statistics of the text and its declared length, each statistic as one bin of
fixed edges. The machine adds to a linear model the interactions of all pairs of features through factors of
low rank; by the sum-of-squares identity a score takes time linear in the number of features:
sum over pairs <v_i, v_j> x_i x_j = 1/2 sum over factors ((sum v x)^2 - sum (v x)^2).

It is fitted on a bounded sample of labelled rows (``rows``, those of smallest hash of the id) and broadcast; its size is fixed by
``WORD_BUCKETS`` and ``FACTORS``. Scoring reads every whole text and moves no row.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import batches

WORD_BUCKETS = 1 << 16
FACTORS = 8
SAMPLE_ROWS = 6000
THRESHOLD = 0.7
SHARES = np.array([0.002, 0.01, 0.03, 0.06, 0.1, 0.15, 0.25, 0.4, 0.6, 0.8])
LENGTHS = np.array([0, 2, 4, 6, 9, 14, 25, 60])  # of words, or words per line
SIZES = np.array([3, 5, 10, 20, 50, 100, 200, 500, 1000, 3000, 10_000])
STATISTICS = (
    ("upper", SHARES), ("digit", SHARES), ("mark", SHARES), ("symbol", SHARES), ("pipe", SHARES), ("bang", SHARES),
    ("other", SHARES), ("space", SHARES), ("repeated", SHARES), ("distinct", SHARES), ("same_lines", SHARES),
    ("word_length", LENGTHS), ("line_words", LENGTHS), ("words", SIZES), ("chars", SIZES * 6),
)
STARTS = WORD_BUCKETS + np.cumsum([0, *(len(e) + 1 for _, e in STATISTICS)])
FEATURES = int(STARTS[-1])

_UPPER, _LOWER, _DIGIT = (slice(ord(a), ord(b) + 1) for a, b in ("AZ", "az", "09"))
_MARKS, _SYMBOLS = ([ord(c) for c in s] for s in (".,;:?'\"-()", "#$%&*@^~<>={}[]\\/_+`"))


class _Buckets(dict):
    """Bucket of a word, remembered for a while."""

    def __missing__(self, word: str) -> int:
        if len(self) > 250_000:
            self.clear()
        self[word] = bucket = zlib.crc32(word.encode("utf-8", "surrogatepass")) % WORD_BUCKETS
        return bucket


_buckets = _Buckets()


def statistics(text: str, words: list[str], distinct: int, n_chars: int | None) -> list[float]:
    """Values in the order of ``STATISTICS``; shares of an empty text are 0."""
    counts = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
    total = max(1, int(counts.sum()))
    letters = max(1, int(counts[_UPPER].sum() + counts[_LOWER].sum()))
    lines = text.split("\n")
    n = max(1, len(words))
    return [
        counts[_UPPER].sum() / letters, counts[_DIGIT].sum() / total, counts[_MARKS].sum() / total, counts[_SYMBOLS].sum() / total,
        counts[ord("|")] / total, counts[ord("!")] / total, counts[128:].sum() / total, (counts[32] + counts[10]) / total,
        sum(map(eq, words, words[1:])) / n, distinct / n, 1 - len(set(lines)) / len(lines),
        total / n, n / len(lines), len(words), len(text) if n_chars is None else n_chars,
    ]


def features(texts: Sequence[str | None], n_chars: Sequence[int | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows as flat (indexes, values, lengths). Words weigh 1 / sqrt(distinct words), statistics 1."""
    indexes, values, lengths = [], [], []
    for text, chars in zip(texts, n_chars):
        text = text or ""
        words = text.split()
        distinct = set(words)
        hashed = np.unique(np.fromiter(map(_buckets.__getitem__, distinct), np.int64, len(distinct)))
        found = statistics(text, words, len(distinct), chars)
        bins = [start + np.searchsorted(edges, v) for start, (_, edges), v in zip(STARTS, STATISTICS, found)]
        indexes.append(np.concatenate([hashed, bins]).astype(np.int64))
        values.append(np.concatenate([np.full(len(hashed), 1 / np.sqrt(max(1, len(hashed)))), np.ones(len(bins))]))
        lengths.append(len(indexes[-1]))
    return np.concatenate([*indexes, np.zeros(0, np.int64)]), np.concatenate([*values, np.zeros(0)]), np.array(lengths, np.int64)


@dataclass
class Machine:
    """Bias, linear weights and factors."""

    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def margins(self, indexes: np.ndarray, values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Log-odds of rows; every row has at least one feature."""
        if not len(lengths):
            return np.zeros(0)
        first = np.cumsum(lengths) - lengths
        linear = np.add.reduceat(self.weights[indexes] * values, first)
        weighted = self.factors[indexes] * values[:, None]
        sums, squares = np.add.reduceat(weighted, first), np.add.reduceat(weighted * weighted, first)
        return self.bias + linear + 0.5 * (sums * sums - squares).sum(axis=1)

    def scores(self, *rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(*rows), -40, 40)))


def fit(indexes: np.ndarray, values: np.ndarray, lengths: np.ndarray, labels: np.ndarray, epochs: int = 8, batch: int = 256,
        rate: float = 0.1, decay: float = 1e-4, seed: int = 7) -> Machine:
    """Logistic loss, AdaGrad steps on the features of each batch. Without both labels the score is the share of 1 (1 if there is none)."""
    rng = np.random.default_rng(seed)
    share = float(np.clip(labels.mean() if len(labels) else 1.0, 1e-6, 1 - 1e-6))
    machine = Machine(float(np.log(share / (1 - share))), np.zeros(FEATURES), np.zeros((FEATURES, FACTORS)))
    if len(np.unique(labels)) < 2:
        return machine
    machine.factors = rng.normal(0, 0.02, (FEATURES, FACTORS))
    seen_w, seen_v, seen_b = np.full(FEATURES, 1e-3), np.full((FEATURES, FACTORS), 1e-3), 1e-3
    first = np.cumsum(lengths) - lengths
    for _ in range(epochs):
        order = rng.permutation(len(labels))
        for start in range(0, len(order), batch):
            rows = order[start:start + batch]
            at = np.concatenate([np.arange(first[r], first[r] + lengths[r]) for r in rows])
            owner = np.repeat(np.arange(len(rows)), lengths[rows])
            i, x = indexes[at], values[at]
            error = machine.scores(i, x, lengths[rows]) - labels[rows]
            used, place = np.unique(i, return_inverse=True)
            weighted = machine.factors[i] * x[:, None]
            sums = np.add.reduceat(weighted, np.cumsum(lengths[rows]) - lengths[rows])
            scaled = (error[owner] * x)[:, None] / len(rows)
            slope_v = np.zeros((len(used), FACTORS))
            np.add.at(slope_v, place, scaled * (sums[owner] - weighted))
            slope_w = np.bincount(place, scaled[:, 0], len(used)) + decay * machine.weights[used]
            slope_v += decay * machine.factors[used]
            seen_w[used] += slope_w ** 2
            seen_v[used] += slope_v ** 2
            seen_b += error.mean() ** 2
            machine.weights[used] -= rate * slope_w / np.sqrt(seen_w[used])
            machine.factors[used] -= rate * slope_v / np.sqrt(seen_v[used])
            machine.bias -= rate * error.mean() / np.sqrt(seen_b)
    return machine


def held_out(column: str = "doc_id"):
    """Rows that are never learned from: crc32 of the id as text is 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 4 == 2, F.lit(False))


def _inputs(documents: DataFrame):
    declared = F.col("n_chars").cast("bigint") if "n_chars" in documents.columns else F.lit(None).cast("bigint")
    return [F.col("text"), declared.alias("n_chars")]


def train(documents: DataFrame, labels: DataFrame, label: str = "quality", rows: int = SAMPLE_ROWS) -> Machine:
    """Fits a machine on at most ``rows`` labelled documents that are not held out.

    Null labels are ignored, contradictory ones averaged (0.5 counts as 1), and of several texts under one id the least
    is taken. Only the features of the sample reach the driver.
    """
    marked = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    marked = marked.groupBy("doc_id").agg((F.avg(label) >= 0.5).cast("int").alias("__label"))
    sample = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    found = documents.select("doc_id", *_inputs(documents)).join(F.broadcast(sample), "doc_id")
    found = found.groupBy("doc_id", "__label").agg(F.min(F.struct("text", "n_chars")).alias("row"))
    found = found.select("doc_id", "__label", "row.text", "row.n_chars")

    def run(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in incoming:
            for start, texts in batches(batch.column(2)):
                part = batch.slice(start, len(texts))
                indexes, values, lengths = features(texts, part.column(3).to_pylist())
                offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.ListArray.from_arrays(offsets, pa.array(indexes.astype(np.int32))),
                     pa.ListArray.from_arrays(offsets, pa.array(values.astype(np.float32)))], names=["doc_id", "label", "i", "x"])

    table = found.mapInArrow(run, "doc_id bigint, label int, i array<int>, x array<float>").toArrow().sort_by("doc_id")
    i, x = (table.column(n).combine_chunks() for n in ("i", "x"))
    flat = lambda a, kind: a.flatten().to_numpy(zero_copy_only=False).astype(kind) if len(a) else np.zeros(0, kind)
    lengths = np.array(i.value_lengths().to_pylist(), np.int64)
    return fit(flat(i, np.int64), flat(x, np.float64), lengths, np.array(table.column("label").to_pylist(), np.float64))


def score(documents: DataFrame, machine: Machine, column: str = "score") -> DataFrame:
    """Adds the score of every whole text; null texts count as empty. An existing ``column`` is replaced."""
    kept = documents.drop(column)
    names, width = kept.columns, len(kept.columns)
    model = documents.sparkSession.sparkContext.broadcast(
        Machine(machine.bias, machine.weights.astype(np.float32), machine.factors.astype(np.float32)))

    def run(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in incoming:
            for start, texts in batches(batch.column(names.index("text"))):
                part = batch.slice(start, len(texts))
                found = model.value.scores(*features(texts, part.column(width).to_pylist()))
                yield pa.RecordBatch.from_arrays([*part.columns[:width], pa.array(found.astype(np.float64), pa.float64())],
                                                 names=[*names, column])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    inputs = kept.select("*", _inputs(documents)[1].alias("__declared"))
    return inputs.mapInArrow(run, f"{fields}, `{column}` double")


def quality_of_documents(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted (1 from ``threshold`` on) of every document; an empty table gives no row."""
    wanted = [c for c in ("doc_id", "text", "n_chars") if c in documents.columns]
    scored = score(documents.select(*wanted), train(documents, labels))
    return scored.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out().alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))
