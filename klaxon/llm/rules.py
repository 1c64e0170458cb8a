"""Quality rules: a table of thresholds compiled into one projection of built-in functions.

A measure is a count over the whole text; a rule bounds one measure per hundred of another. All counts of a document are made in its own
row, so nothing is shuffled and no function of a user runs.

Repeated words are the words inside 8-word windows that stand twice or more in the text. Windows are compared by two-level 64-bit
hashes of their words; two different windows of one text are mistaken for each other with a probability of about n^2 / 2^64 for n words
(1e-11 at 20,000). Only texts in which some hash repeats sort their windows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
SYMBOL = "[#*$%&|<>]"
REPEAT_WORDS = 8
LEAST_WORDS = 20
MOST_REPEATED = 30

# Frequent function words of the four languages of the corpus.
STOP_WORDS = {
    "en": "the of and to a in is that for it was on with as at be by this from or are an he not have".split(),
    "de": "der die und in den von zu das sich mit auf des für ist im dem nicht ein eine als auch es an aus".split(),
    "fr": "de la le et les des en un une du que pour est qui dans par sur il au elle pas ce ne plus".split(),
    "es": "de la que el en y los se del las por un no con para una su al es lo como más este esta".split(),
}


class Threshold(NamedTuple):
    """``100 * measure`` stays between ``least`` and ``most`` times ``per`` (either may be open), in documents of ``langs`` (all if None)."""

    name: str
    measure: str
    per: str
    least: int | None = None
    most: int | None = None
    langs: tuple[str, ...] | None = None


THRESHOLDS = (
    Threshold("word length", "word_chars", "n_words", 200, 1400),
    Threshold("symbols", "n_symbols", "n_words", None, 10),
    Threshold("exclamations", "n_bangs", "n_words", None, 30),
    Threshold("stop words", "n_stop_words", "n_words", 4, None, tuple(STOP_WORDS)),
    Threshold("repeated lines", "n_dup_lines", "n_lines", None, 50),
)


def _repeat_words(windows: Column) -> Column:
    """Words covered by the windows whose (hash, place) pairs, sorted, have an equal neighbour. Each place covers ``REPEAT_WORDS`` words."""
    same = lambda e, j: (F.get(windows, j - 1)["hash"] == e["hash"]) | (F.get(windows, j + 1)["hash"] == e["hash"])
    places = F.sort_array(F.transform(F.filter(windows, same), lambda e: e["place"]))
    state = F.struct(F.lit(-REPEAT_WORDS).alias("last"), F.lit(0).cast("bigint").alias("n"))
    add = lambda s, p: F.struct(p.alias("last"), (s["n"] + F.least(p - s["last"], F.lit(REPEAT_WORDS)).cast("bigint")).alias("n"))
    return F.aggregate(places, state, add)["n"]


def measured(documents: DataFrame) -> DataFrame:
    """Adds the struct ``measures`` (longs) to every row; null texts have none of anything. An existing ``measures`` is replaced.

    n_words, word_chars (code points in words), n_symbols, n_bangs, n_stop_words (of the row's language; without a ``lang`` column or for an
    unknown one, of any), n_lines (with a word), n_dup_lines (lines with a word that equal an earlier one), n_repeat_words.
    """
    rows = documents.drop("measures")
    own = [f"`{c}`" for c in rows.columns]
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD))
    rows = rows.select(*own, text.alias("__text"), F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("__words"), lines.alias("__lines"))
    every = sorted({w for words in STOP_WORDS.values() for w in words})
    known = lambda words: F.size(F.filter("__words", lambda w: F.lower(w).isin(*words)))
    stops = known(every)
    if "lang" in documents.columns:
        stops = reduce(lambda rest, lang: F.when(F.col("lang") == lang, known(STOP_WORDS[lang])).otherwise(rest), STOP_WORDS, stops)
    size = lambda column: F.size(column).cast("bigint")
    rows = rows.select(
        *own, size("__words").alias("__n"), F.transform("__words", lambda w: F.xxhash64(w)).alias("__hashes"),
        F.aggregate("__words", F.lit(0).cast("bigint"), lambda n, w: n + F.length(w)).alias("__chars"), stops.cast("bigint").alias("__stops"),
        F.regexp_count("__text", F.lit(SYMBOL)).cast("bigint").alias("__symbols"),
        F.regexp_count("__text", F.lit("!")).cast("bigint").alias("__bangs"),
        size("__lines").alias("__lines"), (size("__lines") - size(F.array_distinct("__lines"))).alias("__again"))
    # the array of hashes is named several times below, so the optimizer keeps it as a column
    window = lambda i: F.xxhash64(*[F.get("__hashes", i + k) for k in range(REPEAT_WORDS)])
    last = F.size("__hashes") - REPEAT_WORDS
    rows = rows.withColumn("__windows", F.when(last > 0, F.transform(F.sequence(F.lit(0), last), window))).drop("__hashes")
    repeats = F.size(F.array_distinct("__windows")) < F.size("__windows")
    pairs = F.transform("__windows", lambda h, i: F.struct(h.alias("hash"), i.alias("place")))
    rows = rows.withColumn("__windows", F.when(repeats, F.sort_array(pairs)))
    found = F.coalesce(_repeat_words(F.col("__windows")), F.lit(0).cast("bigint"))
    named = {"n_words": "__n", "word_chars": "__chars", "n_symbols": "__symbols", "n_bangs": "__bangs", "n_stop_words": "__stops",
             "n_lines": "__lines", "n_dup_lines": "__again"}
    struct = F.struct(*[F.col(c).alias(name) for name, c in named.items()], found.alias("n_repeat_words"))
    return rows.select(*own, struct.alias("measures"))


def compiled(thresholds: Sequence[Threshold], measures: Column, lang: Column) -> Column:
    """The names of the rules that a row breaks, in the order of the table. A measure per zero breaks nothing."""
    def broken(rule: Threshold) -> Column:
        value, per = 100 * measures[rule.measure], measures[rule.per]
        bounds = [value < rule.least * per] * (rule.least is not None) + [value > rule.most * per] * (rule.most is not None)
        out = reduce(lambda a, b: a | b, bounds, F.lit(False)) & (per > 0)
        return out if rule.langs is None else out & F.coalesce(lang.isin(*rule.langs), F.lit(False))

    names = [F.when(broken(rule), F.lit(rule.name)) for rule in thresholds]
    return F.array_compact(F.array(*names)) if names else F.array().cast("array<string>")


def assessed(documents: DataFrame, thresholds: Sequence[Threshold] = THRESHOLDS) -> DataFrame:
    """All rows and columns with ``measures``, ``broken`` (names of rules), ``base_failed`` and ``kept``; columns so named are replaced.

    ``base_failed``: fewer than ``LEAST_WORDS`` words, or over ``MOST_REPEATED`` per cent repeated words. Rows are never joined or grouped: repeated
    rows, null ids, ties and clashing columns make no difference, and an empty table gives an empty one.
    """
    lang = F.col("lang") if "lang" in documents.columns else F.lit(None).cast("string")
    rows = measured(documents.drop("broken", "base_failed", "kept"))
    m = F.col("measures")
    failed = (m["n_words"] < LEAST_WORDS) | (100 * m["n_repeat_words"] > MOST_REPEATED * m["n_words"])
    rows = rows.withColumns({"broken": compiled(thresholds, m, lang), "base_failed": failed})
    return rows.withColumn("kept", ~F.col("base_failed") & (F.size("broken") == 0))


def verdicts(documents: DataFrame, thresholds: Sequence[Threshold] = THRESHOLDS) -> DataFrame:
    """doc_id, the counts, the broken rules and the verdict of every document."""
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    found = assessed(documents.select("doc_id", "text", *[c for c in ("lang",) if c in documents.columns]), thresholds)
    return found.select(F.col("doc_id").cast("bigint").alias("doc_id"), *[F.col("measures")[c].alias(c) for c in counts],
                        F.array_join("broken", ",").alias("broken"), "base_failed", "kept")


def kept(documents: DataFrame, thresholds: Sequence[Threshold] = THRESHOLDS) -> DataFrame:
    """The documents that pass, with their own columns."""
    return assessed(documents, thresholds).where("kept").select(*[f"`{c}`" for c in documents.columns])


def sql(documents: str = "documents", thresholds: Sequence[Threshold] = THRESHOLDS) -> str:
    """The query for DuckDB: windows as text, counted by grouping."""
    stops = "case " + " ".join(f"when lang = '{k}' then [{', '.join(map(repr, v))}]" for k, v in STOP_WORDS.items())
    stops += " else [" + ", ".join(repr(w) for w in sorted({w for v in STOP_WORDS.values() for w in v})) + "] end"

    def broken(rule: Threshold) -> str:
        bounds = [f"100 * {rule.measure} < {rule.least} * {rule.per}"] * (rule.least is not None)
        bounds += [f"100 * {rule.measure} > {rule.most} * {rule.per}"] * (rule.most is not None)
        langs = "" if rule.langs is None else f" and coalesce(lang in ({', '.join(map(repr, rule.langs))}), false)"
        return f"case when ({' or '.join(bounds) or 'false'}) and {rule.per} > 0{langs} then '{rule.name}' end"

    return f"""
with docs as (select row_number() over () as r, doc_id, lang, coalesce(text, '') as t from {documents}),
cut as (select *, regexp_extract_all(t, '{WORD}') as w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}')) as l from docs),
places as (select r, unnest(list_transform(range(1, len(w) - {REPEAT_WORDS} + 2),
  lambda i: {{'i': i, 'win': array_to_string(w[i:i + {REPEAT_WORDS - 1}], ' ')}})) as p from cut),
windows as (select r, p.i as i, count(*) over (partition by r, p.win) as n from places),
again as (select r, count(distinct p) as n_repeat from (select r, unnest(range(i, i + {REPEAT_WORDS})) as p from windows where n > 1) group by r),
counts as (select r, doc_id, lang, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
  len(regexp_extract_all(t, '{SYMBOL}'))::bigint as n_symbols, len(regexp_extract_all(t, '!'))::bigint as n_bangs,
  len(list_filter(w, lambda x: list_contains({stops}, lower(x))))::bigint as n_stop_words,
  len(l)::bigint as n_lines, (len(l) - len(list_distinct(l)))::bigint as n_dup_lines, coalesce(n_repeat, 0)::bigint as n_repeat_words
  from cut left join again using (r)),
judged as (select *, n_words < {LEAST_WORDS} or 100 * n_repeat_words > {MOST_REPEATED} * n_words as base_failed,
  array_to_string(list_filter([{', '.join(map(broken, thresholds))}], lambda x: x is not null), ',') as broken from counts)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, broken, base_failed, not base_failed and broken = '' as kept from judged"""
