import hashlib
import random
import re

import numpy as np
import pytest

from klaxon.llm import infill
from klaxon.llm.boundaries import CHUNK, Array, Bitmap, BoundarySet, Runs, container
from support_llm import documents, rows


@pytest.mark.parametrize("values, kind", [
    (np.array([0, 7, 65_535]), Array), (np.arange(40_000), Runs), (np.arange(0, CHUNK, 2), Bitmap),
    (np.array([3]), Array), (np.arange(CHUNK), Runs), (np.concatenate([np.arange(100, 20_000), [30_000]]), Runs),
])
def test_containers_select_every_member(values, kind):
    found = container(values)
    assert isinstance(found, kind) and found.bytes == min(2 * len(values), 8192, 4 * (1 + int((np.diff(values) != 1).sum())))
    assert [found.select(k) for k in range(len(values))] == values.tolist()


def test_boundary_set_over_several_chunks():
    rnd = random.Random(3)
    sparse = sorted(rnd.sample(range(CHUNK), 50))
    offsets = sparse + list(range(2 * CHUNK - 3, 2 * CHUNK + 500)) + list(range(5 * CHUNK, 6 * CHUNK, 3)) + [9 * CHUNK]
    found = BoundarySet(np.array(offsets))
    assert {type(c) for c in found.containers} == {Array, Bitmap, Runs}
    assert len(found) == len(offsets) and [found.select(k) for k in range(len(found))] == offsets
    assert len(BoundarySet(np.zeros(0))) == 0
    with pytest.raises(IndexError):
        found.select(len(offsets))


def expected(doc_id, text):
    """By lists of lines."""
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    digits = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digits[i:i + 8], 16) for i in (0, 8, 16, 24))
    a, b = sorted((h1 % (len(lines) + 1), h2 % (len(lines) + 1)))
    p, m, s = ("".join(part) for part in (lines[:a], lines[a:b], lines[b:]))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    if not text or re.search("<[PSM]>", text):
        return doc_id, len(lines), "plain", None, None, sha(text), sha(text)
    spm = h4 % 100 < 50
    out = f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"
    return doc_id, len(lines), "spm" if spm else "psm", len(p), len(m), sha(out), sha(text)


def texts():
    rnd = random.Random(11)
    out = [(None, None), (None, "a\nb"), (1, ""), (2, "\n"), (3, "\n\n\n"), (4, "no line feed"), (5, "x\n"), (6, "has <S> inside\nand more"),
           (7, "<P"), (8, "ends with <\nthen >\n<S\n"), (9, "é\n🦆🦆\r\nz q\x0b\n"), (9, "é\n🦆🦆\r\nz q\x0b\n"), (10, "\n" * 70_000 + "tail"),
           (11, "word " * 30_000 + "\n" + "ab\n" * 90_000)]
    return out + [(i, "".join(rnd.choice(["a", "bc", "\n", "\n\n", "é ", "<", "P>"]) for _ in range(rnd.randint(1, 60)))) for i in range(20, 200)]


def test_digests_equal_brute_force(spark):
    found = infill.digests(documents(spark, texts()))
    assert found.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    assert rows(found, *found.columns) == sorted((expected(*t) for t in texts()), key=str)
    assert {r["form"] for r in found.collect()} == {"plain", "psm", "spm"}


def test_rows_keep_their_columns_and_texts_come_back(spark):
    docs = documents(spark, texts()).selectExpr("*", "'old' as form", "1 as infill")
    out = infill.restored(infill.infilled(docs, infill.Plan(seed=1, rate=60, spm=30)), infill.Plan(seed=1, rate=60, spm=30))
    assert [c for c in out.columns if c != "restored"][-5:] == ["infill", "form", "n_units", "prefix_chars", "middle_chars"]
    got = out.select("doc_id", "text", "key", "restored", "form").collect()
    assert len(got) == len(texts()) and all(r["restored"] == (r["text"] or "") and r["key"] == "k" for r in got)
    assert {"plain", "psm", "spm"} == {r["form"] for r in got}
    assert infill.infilled(documents(spark, [])).count() == 0


def test_sentinels_are_parameters():
    plan = infill.Plan(prefix="[[p]]", suffix="[[s]]", middle="[[m]]")
    for i in range(40):
        found = infill.transform(i, "a<P>\nb]]\nc[[\n", plan)
        assert found.form != "plain" and infill.restore(found.output, found.form, plan) == "a<P>\nb]]\nc[[\n"
