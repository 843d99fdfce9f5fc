"""Every registered query of the engine equals its SQL oracle (DuckDB) on the
test tables."""

import pytest

import __spark_entry__ as E
from pulsegrid.plans import catalog, oracle
from tests.oracle_check import compare

KEYS = sorted(catalog.queries())


def test_every_key_has_an_oracle():
    assert set(oracle.oracle_sql()) == set(catalog.queries())


def test_entry_registers_them():
    assert set(KEYS) <= set(E.queries()) and set(E.oracle_sql()) <= set(E.queries())


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["server_id", "start_ping_at", "last_ping_at", "uptime_ratio",
                          "doc_count"]
    assert df.count() > 0


@pytest.mark.parametrize("key", KEYS)
def test_matches_oracle_sf0001(spark, sf001, key):
    res = compare(spark, sf001, [key])[key]
    assert res["match"], res


@pytest.mark.parametrize("key,rows", [
    ("uptime_report", 150), ("uptime_report_capped", 10000), ("uptime_daily", 4006),
    ("heartbeat_latest", 150), ("heartbeat_decode", 7800), ("status_upsert", 1500),
    ("list_servers", 100), ("monitored_set", 992), ("import_rows", 1700),
    ("probe_requests", 82350), ("mail_ready", 100),
])
def test_known_counts_sf001(spark, sf01, key, rows):
    assert E.queries()[key](spark, sf01).count() == rows
