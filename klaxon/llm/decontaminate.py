"""Benchmark windows inside documents, by a prefix-filtered join.

A window of ten consecutive item words occurs in a document only if all of its three-word shingles do. So the shingles of a window are
ordered by rarity in the corpus, and for exact containment the necessary prefix is the single rarest one: places in documents are
joined with it alone. Its offset in the window and the two lengths bound where the window would lie; there all other shingles of the window
have to stand as well, and what fits is verified word by word on the whole text. Only DataFrame functions are used.

Every text is cut into words once. Of its shingles only those that some window holds leave the task; they are counted, joined and compared from
there, and the texts of the few documents with a match are cut again for the verification. The shingles of windows are broadcast
only after their number is checked (``BROADCAST_BYTES``); beyond that Spark shuffles both sides.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

WINDOW_WORDS = 10
SHINGLE = 3
BROADCAST_BYTES = 24 << 20
UPPER, LOWER = ("".join(chr(c) for c in range(ord(a), ord(a) + 26)) for a in "Aa")
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words of a text: A-Z in lower case, then runs of digits, letters and all beyond ASCII; null has none."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def document_key(document: str = "doc_id", text: str = "text") -> Column:
    """Equal for equal (id, text) only; never null."""
    named = F.coalesce(F.col(document).cast("string"), F.lit("-"))
    return F.sha2(F.concat(named, F.lit("|"), F.when(F.col(text).isNull(), "0").otherwise("1"), F.coalesce(F.col(text), F.lit(""))), 256)


def _small(stored: DataFrame) -> DataFrame:
    """Marks a stored table of fixed-width columns for broadcast if it stays below ``BROADCAST_BYTES``."""
    return F.broadcast(stored) if stored.count() * (16 + 8 * len(stored.columns)) <= BROADCAST_BYTES else stored


def _small_texts(stored: DataFrame) -> DataFrame:
    """The same for a table with texts, whose bytes are summed."""
    texts = [F.octet_length(c) for c, kind in stored.dtypes if kind == "string"]
    size = stored.agg(F.sum(reduce(lambda a, b: a + b, texts) + F.lit(64))).first()[0] or 0
    return F.broadcast(stored) if size <= BROADCAST_BYTES else stored


def benchmark_windows(benchmark: DataFrame, size: int = WINDOW_WORDS) -> DataFrame:
    """Distinct (item, window, length): windows as space-joined words. Null ids count as empty; items without words have none."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words_of(F.col("text")).alias("w"))
    items = items.distinct().where(F.size("w") > 0).withColumn("length", F.least(F.size("w"), F.lit(size)))
    starts = F.sequence(F.lit(1), F.size("w") - F.col("length") + 1)
    rows = items.select("item", "length", F.explode(F.transform(starts, lambda i: F.array_join(F.slice("w", i, F.col("length")), " "))).alias("window"))
    return rows.distinct()


def shingles(words: Column, size: int) -> Column:
    """Hashes of all runs of ``size`` words, in order; equal for runs that differ in case only."""
    last = F.size(words) - size
    run = lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(size)])
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), run)).otherwise(F.array().cast("array<bigint>"))


def window_shingles(windows: DataFrame) -> DataFrame:
    """(window, length, offset, shingle) of distinct windows; one shorter than ``SHINGLE`` is a shingle itself."""
    rows = windows.select("window", "length").distinct().withColumn("w", F.split(F.lower("window"), " "))
    found = reduce(lambda rest, n: F.when(F.col("length") == n, shingles(F.col("w"), n)).otherwise(rest), range(1, SHINGLE), shingles(F.col("w"), SHINGLE))
    return rows.select("window", "length", F.posexplode(found).alias("offset", "shingle"))


def places(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """(key, doc_id, n_words, place, shingle): where the shingles of windows stand, and one row with place -1 for every document.

    A text in lower case has the same word borders as with A-Z lowered only, and words that are equal with A-Z lowered stay equal.
    """
    sizes = sorted((r[0] for r in wanted.select(F.least("length", F.lit(SHINGLE))).distinct().collect()), reverse=True)  # of 1 to SHINGLE
    mark = documents.sparkSession.range(1).select(F.lit(0).cast("bigint").alias("shingle"))
    known = _small(materialize(wanted.select("shingle").union(mark).distinct(), "benchmark-shingles"))
    cut = documents.select("key", "doc_id", F.regexp_extract_all(F.lower(F.coalesce(F.col("text"), F.lit(""))), F.lit(WORD), F.lit(0)).alias("w"))
    every = F.concat(F.array(F.lit(0).cast("bigint")), *[shingles(F.col("w"), n) for n in sizes])
    rows = cut.select("key", "doc_id", F.size("w").alias("n_words"), F.posexplode(every).alias("at", "shingle"))
    place, start = F.when(F.col("at") == 0, -1), F.lit(1)
    for n in sizes:
        end = start + F.greatest(F.col("n_words") - n + 1, F.lit(0))
        place, start = place.when(F.col("at") < end, F.col("at") - start), end
    return rows.join(known, "shingle").select("key", "doc_id", "n_words", place.alias("place"), "shingle")


def prefixes(wanted: DataFrame, found: DataFrame) -> DataFrame:
    """One row per window whose shingles all occur: its rarest one (ties: smaller hash), that one's first offset, the window's length and number of shingles."""
    counts = found.groupBy("shingle").agg(F.count("*").alias("n"))
    ranked = wanted.join(counts, "shingle", "left").groupBy("window", "length").agg(
        F.min(F.struct("n", "shingle", "offset")).alias("rarest"), F.min(F.coalesce("n", F.lit(0))).alias("least"), F.count("*").alias("parts"))
    return ranked.where("least > 0").select("window", "length", "parts", "rarest.shingle", "rarest.offset")


def matches(found: DataFrame, wanted: DataFrame, sizes: DataFrame) -> DataFrame:
    """(key, start, length, window) wherever all shingles of a window stand in order.

    The rarest shingle proposes the start, within the bounds that the two lengths set; the others are then looked up at their places.
    """
    first = _small_texts(materialize(prefixes(wanted, found), "benchmark-prefixes"))
    start = F.col("place") - F.col("offset")
    proposed = found.join(first, "shingle").join(sizes, "key").where((start >= 0) & (start + F.col("length") <= F.col("n_words")))
    proposed = proposed.select("key", start.alias("start"), "length", "window", "parts").distinct()
    looked = proposed.join(wanted.select("window", "offset", "shingle"), "window").withColumn("place", F.col("start") + F.col("offset"))
    seen = looked.join(found, ["key", "place", "shingle"], "left_semi").groupBy("key", "start", "length", "window", "parts").agg(F.count("*").alias("n"))
    return seen.where("n = parts").select("key", "start", "length", "window")


def covered(hits: Column) -> Column:
    """Number of words inside any of the (start, length) intervals, which are sorted by start."""
    empty = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))

    def add(state: Column, hit: Column) -> Column:
        end = hit["start"] + hit["length"]
        fresh = F.greatest(F.lit(0), end - F.greatest(state["end"], hit["start"]))
        return F.struct(F.greatest(state["end"], end).alias("end"), (state["n"] + fresh.cast("long")).alias("n"))

    return F.aggregate(hits, empty, add)["n"]


def measure(documents: DataFrame, benchmark: DataFrame, size: int = WINDOW_WORDS) -> DataFrame:
    """doc_id, key, n_words, n_hit, n_items, items_sha256 and contaminated of every document.

    Repeated rows each get their row, with equal results. Nulls and texts without words are clean with 0 words; without
    documents or items every count is 0. Extra columns are not looked at.
    """
    keyed = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").withColumn("key", document_key())
    windows = materialize(benchmark_windows(benchmark, size), "benchmark-windows")
    wanted = materialize(window_shingles(windows), "window-shingles")
    stored = materialize(places(keyed, wanted), "benchmark-places")
    found = materialize(stored.where("place >= 0").select("key", "place", "shingle").distinct(), "places")
    rows = stored.where("place < 0").select("key", "doc_id", "n_words")
    hits = materialize(matches(found, wanted, rows.select("key", "n_words").distinct()), "benchmark-matches")
    # a place holds at most one window of each length, so what is collected is bounded by the text that it is compared with
    gathered = hits.groupBy("key").agg(F.collect_set(F.struct("start", "length", "window")).alias("places"))
    keys = _small_texts(materialize(hits.select("key").distinct(), "benchmark-keys"))
    texts = keyed.join(keys, "key", "left_semi").dropDuplicates(["key"]).join(gathered, "key").select("key", "text", "places")
    # the words are bound once a text, and documents without hits are left out after writing: a filter here would move below the projections
    # and take the cutting of the text into the comparison of every place
    fits = lambda w: lambda c: (F.size(w) >= c["start"] + c["length"]) & (F.array_join(F.slice(w, c["start"] + 1, c["length"]), " ") == c["window"])
    hits = F.flatten(F.transform(F.array(words_of(F.col("text"))), lambda w: F.filter("places", fits(w))))
    verified = texts.select("key", F.array_sort(hits).alias("hits")).select(
        "key", covered(F.col("hits")).alias("n_hit"), F.array_distinct(F.transform("hits", lambda h: h["window"])).alias("windows"))
    verified = materialize(verified, "benchmark-hits").where("n_hit > 0")
    items = verified.select("key", F.explode("windows").alias("window")).join(windows.select("item", "window"), "window").groupBy("key").agg(
        F.collect_set("item").alias("items"))
    named = verified.select("key", "n_hit").join(items, "key")
    result = rows.join(named, "key", "left")
    names = F.coalesce(F.array_join(F.array_sort("items"), ","), F.lit(""))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("bigint")
    return result.select("doc_id", "key", F.col("n_words").cast("bigint").alias("n_words"), n_hit.alias("n_hit"),
                         F.when(F.col("items").isNull(), 0).otherwise(F.size("items")).cast("bigint").alias("n_items"),
                         F.sha2(names, 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def clean(documents: DataFrame, benchmark: DataFrame, size: int = WINDOW_WORDS) -> DataFrame:
    """The documents without any benchmark window; all their columns and copies are kept."""
    dirty = measure(documents, benchmark, size).where("contaminated").select(F.col("key").alias("__key")).distinct()
    return documents.join(dirty, document_key() == F.col("__key"), "left_anti")


def sql(size: int = WINDOW_WORDS, documents: str = "documents") -> str:
    """The columns of the query for DuckDB: every place of every window length is looked up."""
    words = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}')"
    return f"""
with items as (select coalesce(item_id::varchar, '') as item, {words} as w from benchmark),
sized as (select item, w, least(len(w), {size}) as l from items where len(w) > 0),
windows as (select distinct item, l, array_to_string(w[i:i + l - 1], ' ') as win from (select item, w, l, unnest(range(1, len(w) - l + 2)) as i from sized)),
docs as (select row_number() over () as r, doc_id, {words} as w from {documents}),
places as (select r, w, l, unnest(range(1, len(w) - l + 2)) as i from docs, (select distinct l from windows)),
grams as (select r, l, i, array_to_string(w[i:i + l - 1], ' ') as win from places),
hits as (select r, g.l, i, item from grams g join windows using (l, win)),
hit as (select r, count(distinct p) as n from (select r, unnest(range(i, i + l)) as p from hits) group by r),
named as (select r, count(*) as n, string_agg(item, ',' order by item) as items from (select distinct r, item from hits) group by r)
select doc_id, len(w)::bigint as n_words, coalesce(hit.n, 0)::bigint as n_hit, coalesce(named.n, 0)::bigint as n_items,
  sha256(coalesce(named.items, '')) as items_sha256, coalesce(hit.n, 0) > 0 as contaminated
from docs left join hit using (r) left join named using (r)"""
