"""Fill-in-the-middle: documents cut into prefix, middle and suffix at line boundaries, and written with sentinels.

The ends of the lines of a text, with 0 before the first, form a boundary set (``boundaries.py``); the two cuts are members
selected by rank, at ranks that a hash of the document's id draws. Prefix, middle and suffix are written as
PSM (prefix, suffix, middle) or SPM (suffix, prefix, middle). The text can be rebuilt from the output and its form.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .boundaries import BoundarySet
from .bpe import batches

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


@dataclass(frozen=True)
class Plan:
    """How documents are transformed: ``rate`` and ``spm`` are per cent of all documents and of the transformed ones."""

    seed: int = 7
    rate: int = 100
    spm: int = 50
    prefix: str = PREFIX
    suffix: str = SUFFIX
    middle: str = MIDDLE

    @property
    def sentinels(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle


@dataclass(frozen=True)
class Infilled:
    """One transformed text; the character counts are None in plain form."""

    n: int
    form: str
    prefix_chars: int | None
    middle_chars: int | None
    output: str


def line_ends(text: str) -> BoundarySet:
    """0 and the end of every line, in code points: a line ends after its line feed, the last one with the text."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.flatnonzero(points == 10) + 1
    if len(points) and (not len(ends) or ends[-1] != len(points)):
        ends = np.append(ends, len(points))
    return BoundarySet(np.concatenate([[0], ends]))


def draws(doc_id: int | None, seed: int) -> list[int]:
    """Four 32-bit numbers of a document; a null id counts as empty text."""
    digits = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digits[i:i + 8], 16) for i in range(0, 32, 8)]


def transform(doc_id: int | None, text: str | None, plan: Plan = Plan()) -> Infilled:
    """Cuts and writes one text. Null texts are empty; empty ones, those with a sentinel and those beyond the rate stay plain."""
    text = text or ""
    ends = line_ends(text)
    n = len(ends) - 1
    h1, h2, h3, h4 = draws(doc_id, plan.seed)
    if not text or any(s in text for s in plan.sentinels) or h3 % 100 >= plan.rate:
        return Infilled(n, "plain", None, None, text)
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    first, second = ends.select(low), ends.select(high)
    prefix, middle, suffix = text[:first], text[first:second], text[second:]
    if h4 % 100 < plan.spm:
        form, output = "spm", f"{plan.suffix}{suffix}{plan.prefix}{prefix}{plan.middle}{middle}"
    else:
        form, output = "psm", f"{plan.prefix}{prefix}{plan.suffix}{suffix}{plan.middle}{middle}"
    return Infilled(n, form, first, second - first, output)


def restore(output: str, form: str, plan: Plan = Plan()) -> str:
    """The text that ``transform`` has written in this form."""
    if form == "plain":
        return output
    head, inner = (plan.prefix, plan.suffix) if form == "psm" else (plan.suffix, plan.prefix)
    first, rest = output[len(head):].split(inner, 1)
    second, middle = rest.split(plan.middle, 1)
    return first + middle + second if form == "psm" else second + middle + first


def _rows(documents: DataFrame, schema: str, names: list[str], row: Callable[[int | None, str | None], tuple], types: list[pa.DataType]) -> DataFrame:
    """Maps ``row`` over (doc_id, text); other columns pass by. Nothing is shuffled, and texts go through in Arrow batches of bounded size."""
    own = documents.columns

    def run(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in incoming:
            ids = batch.column(own.index("doc_id"))
            for start, texts in batches(batch.column(own.index("text"))):
                part = batch.slice(start, len(texts))
                found = [row(i.as_py(), t) for i, t in zip(ids.slice(start, len(texts)), texts)]
                columns = [pa.array([f[k] for f in found], kind) for k, kind in enumerate(types)]
                yield pa.RecordBatch.from_arrays([*part.columns, *columns], names=[*own, *names])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema)
    return documents.mapInArrow(run, f"{fields}, {schema}")


def infilled(documents: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """All rows and columns with ``infill``, ``form``, ``n_units``, ``prefix_chars`` and ``middle_chars``; columns so named are replaced.

    Each row is looked at alone: repeated rows get equal results, and an empty table an empty one.
    """
    names = ["infill", "form", "n_units", "prefix_chars", "middle_chars"]

    def row(doc_id, text):
        found = transform(doc_id, text, plan)
        return found.output, found.form, found.n, found.prefix_chars, found.middle_chars

    return _rows(documents.drop(*names), "infill string, form string, n_units bigint, prefix_chars bigint, middle_chars bigint", names, row,
                 [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()])


def restored(infills: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """Adds ``restored``, the text rebuilt from ``infill`` and ``form``; null outputs give null."""
    rows = infills.drop("restored")
    own = rows.columns

    def run(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in incoming:
            forms = batch.column(own.index("form"))
            for start, outputs in batches(batch.column(own.index("infill"))):
                texts = [None if o is None else restore(o, f.as_py(), plan) for o, f in zip(outputs, forms.slice(start, len(outputs)))]
                yield pa.RecordBatch.from_arrays([*batch.slice(start, len(outputs)).columns, pa.array(texts, pa.string())], names=[*own, "restored"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{fields}, `restored` string")


def digests(documents: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256 and restored_sha256 of every document.

    The text is rebuilt in the task that wrote it, so no output leaves it.
    """
    def row(doc_id, text):
        found = transform(doc_id, text, plan)
        hashed = (hashlib.sha256(t.encode("utf-8")).hexdigest() for t in (found.output, restore(found.output, found.form, plan)))
        return found.n, found.form, found.prefix_chars, found.middle_chars, *hashed

    names = ["n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    rows = _rows(documents.selectExpr("cast(doc_id as bigint) as doc_id", "text"),
                 "n bigint, form string, prefix_chars bigint, middle_chars bigint, output_sha256 string, restored_sha256 string", names, row,
                 [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()])
    return rows.drop("text")


def sql(documents: str = "documents", plan: Plan = Plan()) -> str:
    """The query for DuckDB: units as a list, cut by slices."""
    p, s, m = plan.sentinels
    draw = lambda i: f"('0x' || substr(h, {8 * i + 1}, 8))::ubigint::bigint"
    return f"""
with docs as (select doc_id, coalesce(text, '') as t, sha256('{plan.seed}:' || coalesce(doc_id::varchar, '')) as h from {documents}),
cut as (select *, regexp_extract_all(t, '[^\\n]*\\n|[^\\n]+') as u, {draw(0)} as h1, {draw(1)} as h2, {draw(2)} as h3, {draw(3)} as h4 from docs),
placed as (select *, len(u)::bigint as n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) as a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) as b from cut),
parts as (select *, array_to_string(u[1:a], '') as p, array_to_string(u[a + 1:b], '') as m, array_to_string(u[b + 1:], '') as s,
  case when t = '' or contains(t, '{p}') or contains(t, '{s}') or contains(t, '{m}') or h3 % 100 >= {plan.rate} then 'plain'
    when h4 % 100 < {plan.spm} then 'spm' else 'psm' end as form from placed)
select doc_id, n, form, case when form <> 'plain' then length(p)::bigint end as prefix_chars, case when form <> 'plain' then length(m)::bigint end as middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '{p}' || p || '{s}' || s || '{m}' || m else '{s}' || s || '{p}' || p || '{m}' || m end) as output_sha256,
  sha256(t) as restored_sha256 from parts"""
