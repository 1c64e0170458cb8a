"""Secrets in texts: pattern candidates, and a random forest that removes false positives.

A candidate is a run of key characters (letters, digits and ``_ + / -``, with ``=`` at the end only) that has a digit and eight characters or
more, a cloud key id, the body of a private key block, a JSON web token, a password between ``://user:`` and ``@`` (names up to 64 characters), or whatever is assigned to a name such as password or token: the quoted text, or what stands up to white space without
the punctuation at its end, of four characters or more. Unquoted values end before the next ``&name=``. One regular expression finds all of a text; the pieces between them give their places and neighbours. Features are length and
character shares, changes between character classes, the part of the letters that are words of the corpus, the path, and the words beside
it. The forest is trained on at most ``TRAIN_ROWS`` distinct labelled findings, half of them of each label, weighted by what they stand for. If a caller has none, published key formats and named assignments label
the candidates themselves: the forest then generalises these labels, and is measured on findings it has not seen.

Everything is DataFrame, SQL and Spark ML on the JVM. Word counts cover the whole corpus; only the words that occur inside candidates are
counted, and they are broadcast only after a check of their size.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .decontaminate import _small, document_key, words_of

# What a value is assigned to. Lookbehinds are bounded; cheap ones come first.
NAMES = (r"(?:pass(?:word|wd|phrase)|pwd|secret(?:[_-]?key)?|token|(?:api|access|auth|private|signing|encryption)[_-]?key|credentials?)")
_PLAIN, _MORE = r"[^\s\"'<>&]", r"&(?![A-Za-z0-9_]++=)"
KEY_BLOCK, TOKEN = r"PRIVATE KEY-----", r"eyJ[A-Za-z0-9_-]{6,}+\.[A-Za-z0-9_-]{6,}+\.[A-Za-z0-9_-]*+"  # bodies of PEM keys, JSON web tokens
CANDIDATE = (
    r"(?:(?<=" + KEY_BLOCK + r")[^-]++(?:-(?!----)[^-]*+)*+(?=-----END)|(?<![A-Za-z0-9_+/-])" + TOKEN +
    r"|(?<=:)(?<=://[^\s/:@]{1,64}:)[^\s/:@]{3,}+(?=@)"
    r"|(?<![A-Za-z0-9_+/-])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])"
    r"|(?<=[:=][ \t>]{0,4}[\"']?)(?<=(?i:" + NAMES + r")[\"']?[ \t]{0,4}[:=]{1,2}[ \t>]{0,4}[\"']?)(?:"
    r"(?<=\")(?=[^\"\r\n]{4}|(?:[^\"\\\r\n]|\\[^\r\n]){4})(?:[^\"\\\r\n]++|\\[^\r\n])++(?=\")|(?<=')(?=[^'\r\n]{4}|(?:[^'\\\r\n]|\\[^\r\n]){4})(?:[^'\\\r\n]++|\\[^\r\n])++(?=')"
    r"|(?![:=> \t])(?=" + _PLAIN + r"{4})(?:[^\s\"'<>&,;.:)\]}]++|[,;.:)\]}]++(?=" + _PLAIN + r"|" + _MORE + r")|" + _MORE + r")++)"
    r"|(?<![A-Za-z0-9_+/-])(?=[A-Za-z0-9_+/-]{8})[A-Za-z_+/-]*+[0-9][A-Za-z0-9_+/-]*+(?:={1,2}(?![A-Za-z0-9_+/=-]))?)"
)
TRAIN_ROWS, TREES, DEPTH, SEED = 20_000, 24, 6, 5
LEAST_ROWS = 200  # rows of a rarer label are repeated up to here, at the same weight, so that every tree's sample has them
THRESHOLD = 0.5
LEFT_CHARS, RIGHT_CHARS, BLOCK = 48, 24, 256
KNOWN_WORD = 3  # occurrences in the corpus from which a run of letters counts as a word
MASK = "[SECRET]"

# Key formats as their issuers publish them.
FORMATS = (r"(?:AKIA|ASIA)[A-Z0-9]{16}", r"gh[pousr]_[A-Za-z0-9]{36,}", r"glpat-[A-Za-z0-9_-]{20,}", r"sk_live_[A-Za-z0-9]{24,}",
           r"xox[abprs]-[A-Za-z0-9-]{10,}", r"AIza[A-Za-z0-9_-]{35}", r"npm_[A-Za-z0-9]{36}", TOKEN)
NAMED = r"(?i)" + NAMES + r"[\"']?\s*[:=]{1,2}>?\s*[\"']?$"
# Named values that are mixed enough without digits, and what stands for a value in code.
MIXED = r"(?:[a-z]\S*[A-Z]\S*[a-z]\S*[A-Z]|[A-Z]\S*[a-z]\S*[A-Z]\S*[a-z])|^(?=\S*[a-z])(?=\S*[A-Z])(?=\S*[!#$%^*@+/=~?&-])"
CODE = r"^(?:[A-Za-z_][A-Za-z0-9_.]*[(\[{]|[A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)+$|\$[A-Za-z({]|\{\{|[<%(\[{])"
PLACEHOLDER = r"(?i)example|sample|dummy|changeme|placeholder|xxxx|1234567|(.)\1{5}"

FEATURES = ("length", "digits", "upper", "lower", "hex", "marks", "changes", "case_changes", "longest_run", "coverage", "named", "key_word",
            "assigned", "quoted", "in_address", "phone_like", "test_path", "placeholder", "key_block", "address_password")


def candidates(documents: DataFrame, path: str = "source") -> DataFrame:
    """(key, doc_id, path, pos, start, value, left, right) of every candidate; ``start`` counts characters from 0, ``pos`` candidates of the text.

    The work grows with the length of a text, however many candidates it has.
    Null and empty texts have none. ``path`` may be missing or null.
    """
    named = F.coalesce(F.col(path).cast("string"), F.lit("")) if path in documents.columns else F.lit("")
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), named.alias("path"), F.coalesce("text", F.lit("")).alias("text"),
                            document_key().alias("key"))
    rows = rows.withColumn("values", F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0))).where(F.size("values") > 0)
    rows = rows.withColumn("gaps", F.split("text", CANDIDATE, -1)).drop("text")
    n = F.size("values")
    tail = lambda c: F.substring(c, -LEFT_CHARS, LEFT_CHARS)
    rows = rows.select("key", "doc_id", "path", "values", F.slice("gaps", F.lit(1), n).alias("before"), F.slice("gaps", F.lit(2), n).alias("after"))
    rows = rows.withColumn("lengths", F.zip_with("values", "before", lambda v, g: F.length(v) + F.length(g)))
    # what stands before: each round doubles the pieces that a text reaches back over, so no piece is looked at more than a few times
    rows = rows.withColumn("pieces", F.zip_with("before", "values", lambda g, v: tail(F.concat(tail(g), tail(v)))))
    for reach in (1, 2, 4, 8):
        rows = rows.withColumn("pieces", F.zip_with(_earlier("pieces", reach, n), "pieces", lambda a, b: tail(F.concat(a, b))))
    rows = rows.withColumn("ends", _running("lengths"))
    found = F.arrays_zip(
        F.zip_with("ends", "values", lambda e, v: e - F.length(v)).alias("start"), F.col("values").alias("value"),
        F.zip_with(_earlier("pieces", 1, n), "before", lambda p, g: tail(F.concat(p, tail(g)))).alias("left"),
        F.transform("after", lambda g: F.substring(g, 1, RIGHT_CHARS)).alias("right"))
    return rows.select("key", "doc_id", "path", F.posexplode(found).alias("pos", "f")).select(
        "key", "doc_id", "path", "pos", F.col("f.start").alias("start"), F.col("f.value").alias("value"), F.col("f.left").alias("left"), F.col("f.right").alias("right"))


def _earlier(texts: str, by: int, n: Column) -> Column:
    """The array moved by some places, empty texts first."""
    return F.slice(F.concat(F.array_repeat(F.lit(""), by), F.col(texts)), F.lit(1), n)


def _running(lengths: str) -> Column:
    """Running sums of an array, made in blocks: a fold copies its array in each step, so a long one would cost the square of its length."""
    def fold(values: Column) -> Column:
        start = F.struct(F.array().cast("array<int>").alias("ends"), F.lit(0).alias("sum"))
        return F.aggregate(values, start, lambda a, n: F.struct(F.concat(a["ends"], F.array(a["sum"] + n)).alias("ends"), (a["sum"] + n).alias("sum")),
                           lambda a: a["ends"])

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / BLOCK).cast("int")), lambda b: F.slice(lengths, b * BLOCK + 1, F.lit(BLOCK)))
    sums = F.transform(blocks, lambda b: F.struct(fold(b).alias("ends"), F.aggregate(b, F.lit(0), lambda a, n: a + n).alias("sum")))
    totals = fold(F.transform(sums, lambda b: b["sum"]))
    return F.flatten(F.zip_with(sums, totals, lambda b, total: F.transform(b["ends"], lambda e: e + total - b["sum"])))


def _coverage(found: DataFrame, documents: DataFrame) -> DataFrame:
    """(value, coverage): share of a value's characters in runs of three letters or more that are words of the corpus."""
    runs = found.select("value").distinct().select(
        "value", F.explode(F.regexp_extract_all(F.lower("value"), F.lit("[a-z]{3,}"), F.lit(0))).alias("word"))
    runs = materialize(runs, "secret-runs")
    vocabulary = _small(materialize(runs.select("word").distinct(), "secret-words"))
    counts = documents.select(F.explode(words_of(F.col("text"))).alias("word")).join(vocabulary, "word", "left_semi")
    known = counts.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= KNOWN_WORD)
    covered = runs.join(known, "word").groupBy("value").agg(F.sum(F.length("word")).alias("letters"))
    return covered.select("value", (F.col("letters") / F.length("value")).alias("coverage"))


def described(found: DataFrame, documents: DataFrame) -> DataFrame:
    """Adds the columns of ``FEATURES`` to candidates."""
    size = F.length("value").cast("double")
    share = lambda pattern: F.regexp_count("value", F.lit(pattern)) / size
    flag = lambda column: column.cast("double")
    changes = r"(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])"
    columns = {
        "length": F.least(size, F.lit(200.0)), "digits": share("[0-9]"), "upper": share("[A-Z]"), "lower": share("[a-z]"),
        "hex": share("[0-9a-f]"), "marks": share("[^A-Za-z0-9]"), "changes": share(changes), "case_changes": share(r"(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])"),
        "longest_run": F.coalesce(F.array_max(F.transform(F.regexp_extract_all("value", F.lit("[A-Za-z]+"), F.lit(0)), F.length)), F.lit(0)) / size,
        "coverage": F.coalesce(F.col("coverage"), F.lit(0.0)), "named": flag(F.col("left").rlike(NAMED)),
        "key_word": flag(F.col("left").rlike(r"(?i)(?:pass|pwd|secret|token|key|auth|credential|bearer)")),
        "assigned": flag(F.col("left").rlike(r"[:=]\s*[\"']?$")), "quoted": flag(F.col("left").rlike("[\"']$") & F.col("right").rlike("^[\"']")),
        "in_address": flag(F.col("left").rlike(r"(?:://\S*|[@.])$") | F.col("right").rlike(r"^(?:@|\.[a-z])")),
        "phone_like": flag(F.col("value").rlike("^[0-9+/-]+$")), "test_path": flag(F.col("path").rlike(r"(?i)test|example|sample|mock|fixture|doc")),
        "placeholder": flag(F.col("value").rlike(PLACEHOLDER)), "key_block": flag(F.col("left").rlike(KEY_BLOCK + "$")),
        "address_password": flag(_address_password()),
    }
    joined = found.join(_coverage(found, documents), "value", "left")
    return joined.select("key", "doc_id", "path", "pos", "start", "value", "left", "right", *(columns[n].cast("double").alias(n) for n in FEATURES))


def _address_password() -> Column:
    """Whether a value stands between ``://user:`` and ``@``; of a long name only the end is seen."""
    return F.col("left").rlike(r"(?:://|^)[^\s/:@]+:$") & F.col("right").startswith("@") & ~F.col("value").rlike("[/:@]")


def format_label() -> Column:
    """1 for values in a published format, bodies of private keys, passwords in addresses, and named assignments of a value of mixed
    characters, but not for placeholders."""
    published = F.col("value").rlike("^(?:" + "|".join(FORMATS) + ")$")
    mixed = (F.col("value").rlike("[0-9]") & F.col("value").rlike("[A-Za-z]")) | F.col("value").rlike(MIXED)
    assigned = F.col("left").rlike(NAMED) & mixed & F.col("value").rlike(r"^\S{8,}$") & ~F.col("value").rlike(CODE)
    return ((published | assigned | F.col("left").rlike(KEY_BLOCK + "$") | _address_password()) & ~F.col("value").rlike(PLACEHOLDER)).cast("double")


@dataclass
class Filter:
    """A trained forest, or the one label all training rows had."""

    model: object
    only: float | None = None

    def score(self, rows: DataFrame, column: str = "score") -> DataFrame:
        """Adds the probability of a secret."""
        if self.model is None:
            return rows.withColumn(column, F.lit(self.only))
        ready = VectorAssembler(inputCols=list(FEATURES), outputCol="__x").transform(rows)
        scored = self.model.setFeaturesCol("__x").setProbabilityCol("__p").setPredictionCol("__y").setRawPredictionCol("__r").transform(ready)
        return scored.withColumn(column, vector_to_array("__p")[1]).drop("__x", "__p", "__y", "__r")


def training_rows(findings: DataFrame, label: str = "label", rows: int = TRAIN_ROWS) -> tuple[DataFrame, list[float]]:
    """``FEATURES``, label and weight of the rows to learn from, and the labels of all findings; null labels are ignored.

    Copies of a finding (value, neighbours, features and label) count once. Of each label at most half of ``rows`` are taken, those of smallest hash;
    their weights add up to the label's distinct findings, so a rare label is always learned from and shares stay as they are.
    """
    key = F.xxhash64("value", "left", "right")
    kept = findings.where(F.col(label).isNotNull()).select(key.alias("key"), *FEATURES, F.col(label).cast("double").alias("label")).distinct()
    kept = materialize(kept, "secret-findings")
    counts = {r["label"]: r["n"] for r in kept.groupBy("label").agg(F.count("*").alias("n")).collect()}
    parts = []
    for value, n in sorted(counts.items()):
        taken = min(n, max(1, rows // 2))
        times = max(1, -(-min(LEAST_ROWS, rows // 2) // taken))
        part = kept.where(F.col("label") == value).orderBy("key", *FEATURES).limit(taken)
        part = part.withColumn("weight", F.lit(n / taken / times)).withColumn("time", F.explode(F.sequence(F.lit(1), F.lit(times))))
        parts.append(part.select(*FEATURES, "label", "weight"))
    return (reduce(DataFrame.unionByName, parts) if parts else kept.withColumn("weight", F.lit(1.0))), sorted(counts)


def train(findings: DataFrame, label: str = "label", rows: int = TRAIN_ROWS) -> Filter:
    """A forest from the ``training_rows`` of labelled findings.

    If all findings, not only those taken, have one label, that label is the answer; without any, nothing is a secret.
    """
    kept, labels = training_rows(findings, label, rows)
    if len(labels) < 2:
        return Filter(None, labels[0] if labels else 0.0)
    ready = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(materialize(kept, "secret-training"))
    return Filter(RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, labelCol="label", weightCol="weight").fit(ready))


def scan(documents: DataFrame, labelled: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Every candidate with its score: key, doc_id, pos, start, value, score and secret.

    ``labelled`` are findings with ``doc_id``, ``start`` and ``label`` (0 or 1) by which candidates are labelled; without them
    ``format_label`` does. Repeated rows have their findings each; an empty table gives none.
    """
    rows = materialize(described(materialize(candidates(documents), "secret-candidates"), documents), "secret-features")
    if labelled is None:
        marked = rows.withColumn("label", format_label())
    else:
        marks = labelled.groupBy("doc_id", "start").agg(F.max("label").alias("label"))
        marked = rows.join(marks, ["doc_id", "start"])
    scored = train(marked).score(rows)
    return scored.select("key", "doc_id", "pos", "start", "value", "score", (F.col("score") >= threshold).alias("secret"))


def findings(documents: DataFrame) -> DataFrame:
    """doc_id, start, length, value_sha256, score and secret of every candidate; the value itself is not shown."""
    return scan(documents).select("doc_id", "start", F.length("value").alias("length"), F.sha2("value", 256).alias("value_sha256"),
                                  F.round("score", 6).alias("score"), "secret")


def redacted(documents: DataFrame, mask: str = MASK) -> DataFrame:
    """All documents with their columns; secrets in the text are replaced and n_chars, if present, is counted anew for such texts."""
    marks = scan(documents).groupBy(F.col("key").alias("__key")).agg(
        F.max("secret").alias("any"), F.array_sort(F.collect_set(F.struct("pos", "secret"))).alias("__marks")).where("any").drop("any")
    joined = documents.withColumn("__key", document_key()).join(marks, "__key", "left")
    # the text is cut where the candidates are, and joined again once
    masked = F.when(F.col("__marks").isNotNull(), F.zip_with(
        F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0)), "__marks", lambda v, m: F.when(m["secret"], F.lit(mask)).otherwise(v)))
    gaps = F.when(F.col("__marks").isNotNull(), F.split("text", CANDIDATE, -1))
    out = joined.withColumn("__masked", masked).withColumn("__gaps", gaps)
    whole = F.array_join(F.zip_with("__gaps", "__masked", lambda g, v: F.concat(g, F.coalesce(v, F.lit("")))), "")
    out = out.withColumn("__text", F.when(F.col("__marks").isNull(), F.col("text")).otherwise(whole))
    columns = {"text": F.col("__text")}
    if "n_chars" in documents.columns:
        kind = dict(documents.dtypes)["n_chars"]
        columns["n_chars"] = F.when(F.col("__marks").isNull(), F.col("n_chars")).otherwise(F.length("__text").cast(kind))
    return out.select(*(columns.get(c, F.col(c)).alias(c) for c in documents.columns))
