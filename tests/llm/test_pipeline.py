import os

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from compare import compare, connect
from klaxon.llm import quality, secrets
from klaxon.session import materialize
from test_duplicates import grouped, windows, words

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="sample tables are not here")


def test_stages_equal_brute_force(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, state = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, FOLDER), "test-stage")
        assert docs.columns == columns
        state[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    start = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    scored = quality.quality_of_documents(spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet"))
    good = {r["doc_id"] for r in scored.where("predicted = 1").collect()}
    first = [(i, t) for i, t in start if i in good]
    assert state["quality classifier"] == dict(first)
    _, group = grouped(first, (80, 100))
    alone = {min(i for (i, _), h in zip(first, group) if h == g) for g in group}
    assert set(state["minhash near-dedup"]) == alone
    wins = {w for _, w in windows([(r["item_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()])}
    sizes = {len(w) for w in wins}
    dirty = {i for i in alone for w in [words(dict(first)[i])] if any(tuple(w[k:k + n]) in wins for n in sizes for k in range(len(w)))}
    assert set(state["benchmark decontamination"]) == alone - dirty
    assert set(state["secret scans"]) == alone - dirty
    found = secrets.scan(spark.createDataFrame(sorted(state["benchmark decontamination"].items()), "doc_id long, text string"))
    assert not any(r["value"] in state["secret scans"][r["doc_id"]] for r in found.where("secret").collect())


def test_pipeline_end_to_end(spark):
    rows = entry.queries()["pipeline"](spark, FOLDER)
    assert rows.where("not round_trip").count() == 0 and rows.count() > 50


@pytest.mark.parametrize("name", sorted(n for n in entry.oracle_sql() if n.startswith("op")))
def test_query_equals_sql(spark, name):
    frame = entry.queries()[name](spark, FOLDER).toPandas()
    assert compare(frame, connect(FOLDER).execute(entry.oracle_sql()[name]).df()) is None
