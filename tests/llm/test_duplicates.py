import hashlib
import random
import re

from klaxon.llm import decontaminate, minhash
from klaxon.llm.components import components
from support_llm import documents, rows

UPPER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def prose(rnd, n):
    return [rnd.choice("abcdefghij") + str(rnd.randint(0, 400)) for _ in range(n)]


def copies(seed=5):
    """Groups of near copies (chains, stars), exact copies, a shared passage, and the odd cases."""
    rnd = random.Random(seed)
    passage, out, next_id = prose(rnd, 40), [], 10
    for size in (1, 2, 3, 30):
        base = prose(rnd, 120)
        for k in range(size):
            words = list(base)
            for _ in range(k % 7):
                words[rnd.randrange(len(words))] = f"edit{rnd.random()}"
            out.append((next_id, " ".join(words)))
            next_id += 1
    chain = prose(rnd, 300)
    for k in range(12):
        out.append((next_id, "  \n".join(chain[k * 4:k * 4 + 250])))
        next_id += 1
    for k in range(20):
        out.append((next_id, " ".join(passage + prose(rnd, 40))))
        next_id += 1
    out += [(5, out[0][1].upper()), (6, out[0][1]), (6, out[0][1]), (None, out[0][1]), (None, None), (3, None), (3, ""), (2, " \t\n"), (8, "one two"),
            (9, "ONE  two"), (1, "one two three four five"), (0, "é É"), (4, "é é")]
    return out


def sets(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)}


def grouped(docs, similarity=(85, 100)):
    """Brute force: group number of each row."""
    found = [sets(t) for _, t in docs]
    group = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            if found[i] and similarity[1] * len(found[i] & found[j]) >= similarity[0] * len(found[i] | found[j]) and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    return found, group


def test_near_duplicates_equal_brute_force(spark):
    data = copies()
    found, group = grouped(data)
    want = []
    for (i, _), s, g in zip(data, found, group):
        ids = [k for (k, _), h in zip(data, group) if h == g and k is not None]
        least = min(ids) if ids else None
        want.append((i, len(s), least, i == least))
    got = rows(minhash.near_duplicates(documents(spark, data)), "doc_id", "n_shingles", "component_id", "kept")
    assert got == sorted(want, key=str)


def test_one_of_each_group_stays(spark):
    data = copies()
    _, group = grouped(data)
    kept = minhash.deduplicated(documents(spark, data))
    assert kept.columns == documents(spark, data[:1]).columns
    got = [(r["doc_id"], r["text"]) for r in kept.collect()]
    by = {}
    for (i, t), g in zip(data, group):
        by.setdefault(g, []).append((i, t))
    assert len(got) == len(by)
    for members in by.values():
        best = min((m for m in members), key=lambda m: (m[0] is None, m[0] or 0))
        assert sum(g in members and g[0] == best[0] for g in got) >= 1
    assert minhash.near_duplicates(documents(spark, []).limit(0)).count() == 0


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (200, 200), (102, 101)] + [(500, 500 + k) for k in range(1, 50)]
    got = dict(tuple(r) for r in components(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100, **{500 + k: 500 for k in range(50)}}


def test_bounds_and_signatures():
    bounds = minhash.mismatch_bounds()
    assert all(0.075 * n < b < 0.25 * n for n, b in zip(minhash.BATCHES, bounds)) and bounds[-1] / 1024 < bounds[0] / 256
    rnd = random.Random(6)
    words = prose(rnd, 4000)
    a, b = minhash.shingles(" ".join(words)), minhash.shingles(" ".join(words[:3900] + prose(rnd, 100)))
    (ka, sa), (kb, sb) = minhash.signature(a, minhash.band_shape()), minhash.signature(b, minhash.band_shape())
    differ = sum(bin(int(x) ^ int(y) & 0xFFFFFFFFFFFFFFFF).count("1") if x >= 0 and y >= 0 else bin((int(x) ^ int(y)) & 0xFFFFFFFFFFFFFFFF).count("1")
                 for x, y in zip(sa, sb))
    assert differ < 90 and (ka == kb).any() and minhash.alike(a, b)


def windows(items):
    out = []
    for i, t in items:
        w = words(t)
        n = min(len(w), 10)
        out += [("" if i is None else str(i), tuple(w[k:k + n])) for k in range(len(w) - n + 1)] if w else []
    return out


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))


def test_windows_equal_brute_force(spark):
    rnd = random.Random(7)
    common = [rnd.choice("abc") for _ in range(60)]
    items = [(10, " ".join(prose(rnd, 25))), (9, " ".join(prose(rnd, 12))), (2, "Short, one!"), (3, "Short, one!"), (4, None), (5, " .. "),
             (6, " ".join(common[:10])), (None, "x1 x2 x3"), (10, "again x9")]
    docs = [(1, "before " + items[0][1] + " after"), (2, " ".join(items[0][1].split()[3:13]).upper()), (3, " ".join(items[0][1].split()[3:12])),
            (4, "a-short...ONE"), (5, None), (6, ""), (7, " ".join(common)), (7, " ".join(common)), (None, "x1 x2 x3 x1 x2 x3 x2"), (8, "x1 x2 é x3"),
            (9, items[1][1] + " " + items[0][1]), (11, "short one " * 500), (12, "a " * 3000), (13, "again x9")]
    want, wins = [], windows(items)
    for i, t in docs:
        w, hit, named = words(t), set(), set()
        for item, win in wins:
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k:k + len(win)]) == win:
                    hit |= set(range(k, k + len(win)))
                    named.add(item)
        want.append((i, len(w), len(hit), len(named), hashlib.sha256(",".join(sorted(named)).encode()).hexdigest(), bool(hit)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    frame = documents(spark, docs)
    columns = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert rows(decontaminate.measure(frame, bench), *columns) == sorted(want, key=str)
    left = decontaminate.clean(frame, bench)
    assert left.columns == frame.columns
    assert rows(left, "doc_id", "text") == sorted([(i, t) for (i, t), w in zip(docs, want) if not w[-1]], key=str)
    assert decontaminate.measure(frame.limit(0), bench).count() == 0
    assert decontaminate.measure(frame, bench.limit(0)).where("contaminated or n_items > 0").count() == 0


def test_large_word_tables_are_joined_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", 0)
    bench = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    got = rows(decontaminate.measure(documents(spark, [(1, "zero one two three"), (2, "one two")]), bench), "doc_id", "n_hit")
    assert got == [(1, 3), (2, 0)]


def family(size, seed=9):
    """Copies of one text with three edits or more each, hardly alike another, some sub-families among them, and truncated copies."""
    rnd = random.Random(seed)
    base, out = prose(rnd, 150), []

    def edited(words, n):
        words = list(words)
        for at in rnd.sample(range(len(words)), n):
            words[at] = f"edit{rnd.random()}"
        return words

    for i in range(size):
        out.append((i, " ".join(edited(base, rnd.randint(3, 4)))))
    for f in range(4):
        child = edited(base, 5)
        out += [(size + 20 * f + k, " ".join(edited(child, k % 4))) for k in range(20)]
    out += [(size + 200 + k, " ".join(base[:60 + 3 * k])) for k in range(25)]
    return out


def test_large_group_of_unlike_copies_is_not_expanded(spark, monkeypatch):
    asked, verified = {}, minhash._verified

    def counting(pairs, *rest):
        asked[size] = asked.get(size, 0) + pairs.count()
        return verified(pairs, *rest)

    monkeypatch.setattr(minhash, "_verified", counting)
    for size in (300,):
        data = family(size)
        got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(documents(spark, data)).collect()}
        _, group = grouped(data)
        least = {g: min(i for (i, _), h in zip(data, group) if h == g) for g in group}
        assert got == {i: least[g] for (i, _), g in zip(data, group)}
        assert len(set(got.values())) > size / 2
    assert asked[300] < 10 * 300


def test_similarity_is_a_parameter(spark):
    data = family(60) + copies()[:40]
    for similarity in ((80, 100),):
        bands, rows_ = minhash.band_shape(similarity)
        assert bands * rows_ <= minhash.BAND_HASHES and (1 - (similarity[0] / similarity[1]) ** rows_) ** bands <= minhash.BAND_MISS
        kept = {r["doc_id"] for r in minhash.deduplicated(documents(spark, data), similarity).collect()}
        _, group = grouped(data, similarity)
        assert kept == {min(i for (i, _), h in zip(data, group) if h == g) for g in group}
    assert minhash.band_shape((85, 100)) == (61, 12)
