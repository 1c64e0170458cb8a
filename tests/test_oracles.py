"""A sample of catalog queries against their SQL; tests/compare.py runs them all."""

import os

import pytest

import __spark_entry__ as entry
from compare import compare, connect

FOLDER = "/root/testdata/sf0.001"
SAMPLE = ("src_json_decode", "coerce_string", "expression_push", "win_max", "incidents", "match_labels", "cfg_apply_changes",
          "notify_repeat")


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="sample tables are not here")
@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, name):
    frame = entry.queries()[name](spark, FOLDER).toPandas()
    assert compare(frame, connect(FOLDER).execute(entry.oracle_sql()[name]).df()) is None
