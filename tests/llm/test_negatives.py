import math
import random

import numpy as np
import pytest

from klaxon.llm import negatives
from klaxon.llm.shipping import ship
from klaxon.session import local_table
from support_llm import rows

COLUMNS = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


@pytest.mark.parametrize("m, k, n", [(1, 1, 1), (5, 7, 3), (16, 16, 16), (33, 17, 65), (40, 64, 100), (3, 200, 3)])
def test_strassen_is_exact(m, k, n):
    r = np.random.default_rng(m * 100 + n)
    a, b = r.integers(-1 << 28, 1 << 28, (m, k)), r.integers(-1 << 28, 1 << 28, (k, n))
    exact = a.astype(object) @ b.astype(object)
    assert (negatives.strassen(a, b, 4) == exact).all() and (negatives.strassen(a, b) == exact).all()


def test_scores_pad_and_refuse_overflow():
    assert negatives.scores(np.array([[1, 2, 3]]), np.array([[4], [5]])).tolist() == [[4, 5]]
    assert negatives.scores(np.zeros((2, 0), np.int64), np.array([[1]])).tolist() == [[0], [0]]
    with pytest.raises(OverflowError):
        negatives.scores(np.array([[1 << 40]]), np.array([[1 << 40]]))


def test_heaps_merge_in_any_order():
    rnd = random.Random(2)
    entries = [(rnd.randrange(3), rnd.randrange(6), i) for i in range(60)]
    once, parts = negatives.Heaps(4, 5), negatives.Heaps(4, 5)
    once.push(*(np.array(c) for c in zip(*entries)))
    rnd.shuffle(entries)
    for start in range(0, 60, 7):
        parts.push(*(np.array(c) for c in zip(*entries[start:start + 7])))
    assert (once.score == parts.score).all() and (once.id == parts.id).all()
    for slot in range(3):
        assert list(zip(once.score[slot], once.id[slot])) == sorted(((s, i) for x, s, i in entries if x == slot), key=lambda e: (-e[0], e[1]))[:5]
    assert (once.score[3] == negatives.EMPTY).all()


def expected(data, anchor_ids):
    """All anchors against all rows."""
    used = [(i, l, [math.floor(256 * x) for x in v]) for i, l, v in data
            if i is not None and l is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, label, v in {(i, l, tuple(v)) for i, l, v in used if anchor_ids(i)}:
        scored = sorted(((-sum(x * y for x, y in zip(v, w)), i, l) for i, l, w in used if i != a))
        best = [(-s, i) for s, i, l in scored if l == label][:5]
        for ps, p in best:
            inside = [(-s, i) for s, i, l in scored if l != label and 80 * ps <= -100 * s <= 100 * ps][:5]
            out += [(a, p, rank, i, ps, s) for rank, (s, i) in enumerate(inside, 1)]
    return sorted(out, key=str)


def table(spark, data):
    ship(spark)
    rows = [(i, l, v, "s", 1, "k") for i, l, v in data]
    return local_table(spark, rows, "vec_id bigint, label int, embedding array<double>, score string, rank int, key string")


def points(n=400, labels=4, seed=1):
    rnd = random.Random(seed)
    centres = [[rnd.gauss(0, 0.4) for _ in range(9)] for _ in range(labels)]
    data = []
    for i in range(n):
        label = 0 if rnd.random() < 0.4 else rnd.randrange(labels)
        near = centres[rnd.randrange(labels)]
        data.append((i, label, [c + rnd.gauss(0, 0.2) for c in near]))
    same = data[3][2]
    data += [(1000 + i, i % 3, list(same)) for i in range(40)]  # ties
    data += [(2000, None, same), (None, 1, same), (2001, 1, None), (2002, 1, [0.1, None]), (2003, 1, [float("nan")]), (2004, 2, [float("inf"), 1.0]),
             (2005, 0, []), (2006, 1, [0.5, 0.5]), (2007, 9, same), (10, 0, data[10][2][::-1])]
    return data


def test_mined_equal_brute_force(spark, monkeypatch):
    data = points()
    vectors = table(spark, data)
    want = expected(data, lambda i: i % 10 == 0)
    assert len(want) > 300
    assert rows(negatives.mine(vectors, vectors.where("vec_id % 10 = 0")), *COLUMNS) == want
    monkeypatch.setattr(negatives, "BLOCK_ANCHORS", 7)
    monkeypatch.setattr(negatives, "CHUNK_ROWS", 60)
    monkeypatch.setattr(negatives, "TILE", (3, 11))
    assert rows(negatives.mine(vectors, vectors.where("vec_id % 10 = 0")), *COLUMNS) == want


def test_empty_sides_give_nothing(spark):
    vectors = table(spark, points(20))
    assert negatives.mine(vectors, vectors.where("false")).count() == 0
    assert negatives.mine(vectors.where("false"), vectors).count() == 0
    assert negatives.mine(vectors.where("label = 1"), vectors).count() == 0


def test_labels_of_the_query_move(spark):
    got = table(spark, [(7, 9, []), (14, 3, []), (15, 9, []), (21, None, []), (None, 4, [])]).select(negatives.relabelled()).collect()
    assert [r[0] for r in got] == [0, 4, 9, None, 4]
