import random
import re

import pytest

from klaxon.llm import rules
from support_llm import documents, rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counted(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, by looking at every window."""
    text = text or ""
    words = WORD.findall(text)
    seen, again = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    times = {}
    for w in windows:
        times[w] = times.get(w, 0) + 1
    covered = {p for i, w in enumerate(windows) if times[w] > 1 for p in range(i, i + 8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), again, len(covered)


def texts():
    rnd = random.Random(4)
    prose = lambda n, k=500: " ".join(rnd.choice("the of and w".split()) + str(rnd.randrange(k)) * (rnd.random() < 0.7) for _ in range(n))
    passage = prose(8)
    out = [(None, None), (1, ""), (2, " \n\t\x0b\x0c\r "), (3, "a b c d e f g h"), (4, "a b c d e f g h a b c d e f g h"), (5, "x " * 30), (6, "x " * 9),
           (7, "one\ntwo\none\n\n\n one\none"), (8, "é É ü 🦆🦆 #*$ %&| <>"), (9, passage + " " + prose(20) + " " + passage),
           (10, passage + " " + passage + " " + passage), (11, "\x00 \x1c\x85 a"), (12, "!\n" * 40 + prose(60)), (12, "!\n" * 40 + prose(60)), (13, "line\r\nline\n" * 3)]
    out.append((14, prose(60_000, 10 ** 9) + " " + passage + " x " + passage))
    return out + [(i, prose(rnd.randint(1, 200), 3 + i)) for i in range(20, 60)]


def test_counts_equal_brute_force(spark):
    data = texts()
    found = rules.verdicts(documents(spark, data))
    want = sorted(((i, *counted(t)) for i, t in data), key=str)
    assert rows(found, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words") == want
    for r in found.collect():
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
        assert r["kept"] == (not r["base_failed"] and r["broken"] == "")


def test_each_rule_breaks_alone(spark):
    plain = [f"{w}{i}" for i, w in enumerate(["alpha", "the", "river", "of", "stone", "and"] * 6)]
    plain = [re.sub(r"\d+", "", w) if w[:2] in ("th", "of", "an") else w for w in plain]
    cases = {
        "": " ".join(plain), "word length": " ".join(plain + ["y" * 900]), "symbols": " ".join(plain + ["#", "|", "<a>", "%"]),
        "exclamations": " ".join(plain) + "!" * 12, "stop words": " ".join(f"w{i}" for i in range(40)),
        "repeated lines": "\n".join(["see", "see", "see", "see", " ".join(plain)]),
    }
    found = rules.verdicts(documents(spark, [(i, t) for i, t in enumerate(cases.values())])).orderBy("doc_id").collect()
    assert [r["broken"] for r in found] == list(cases)
    assert [r["kept"] for r in found] == [True] + [False] * 5


def test_tables_of_rules_and_languages(spark):
    table = [rules.Threshold("short", "n_words", "n_lines", 300), rules.Threshold("long", "n_words", "n_lines", None, 500, ("de",))]
    docs = documents(spark, [(1, "a b"), (2, "a b c d e f"), (3, None)]).selectExpr("*", "'x' as broken", "2 as kept")
    got = rules.assessed(docs.withColumn("lang", rules.F.expr("if(doc_id = 2, 'de', null)")), table)
    assert [(r["doc_id"], r["broken"]) for r in got.orderBy("doc_id").collect()] == [(1, ["short"]), (2, ["long"]), (3, [])]
    assert rules.assessed(docs.drop("lang"), ()).where("size(broken) > 0").count() == 0
    assert rules.kept(docs).columns == docs.columns and rules.assessed(documents(spark, [])).count() == 0


@pytest.mark.parametrize("words", [20_000, 40_000])
def test_long_texts_take_one_projection(spark, words):
    plan = rules.verdicts(documents(spark, [(1, "a b " * words)]))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan
    assert rules.verdicts(documents(spark, [(1, "a b " * words)])).first()["n_repeat_words"] == 2 * words
