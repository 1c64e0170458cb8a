"""Small tables for the training-data operators, with nulls, blanks, ties, repeats and an extra column."""

from klaxon.llm.shipping import ship
from klaxon.session import local_table

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, key string"


def documents(spark, rows):
    """(doc_id, text) pairs as documents; ``key`` clashes with a name that operators use inside."""
    ship(spark)
    return local_table(spark, [(i, t, "en", "src", None if t is None else len(t), "k") for i, t in rows], DOCS)


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)
