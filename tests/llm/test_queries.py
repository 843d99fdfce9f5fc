"""The registered queries of the subpackage: SQL where there is some, rows and
columns where there is none."""

import pytest

import __spark_entry__ as E
from pulsegrid.llm import queries as L
from tests.oracle_check import compare

KEYS = sorted(k for k in E.queries() if k == "pipeline" or k in L.queries())


@pytest.mark.parametrize("key", sorted(L.oracle_sql()))
def test_matches_oracle(spark, sf001, key):
    res = compare(spark, sf001, [key])[key]
    assert res["match"], res


@pytest.mark.parametrize("key", [k for k in KEYS if k not in L.oracle_sql()])
def test_runs(spark, sf001, key):
    rows = E.queries()[key](spark, sf001).collect()
    assert rows
    if "doc_id" in rows[0] and key != "pipeline":
        assert len({r.doc_id for r in rows}) == spark.read.parquet(f"{sf001}/documents.parquet").count()
