"""Every query on the smallest tables, against its SQL where it has one."""

import os

import pytest

from cuelattice.plans import catalogue

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = ("videos", "ocr_results", "tracks", "cues", "llm_cache", "documents", "eval_items", "mix_targets")
needs_data = pytest.mark.skipif(not os.path.exists(f"{DATA}/videos.parquet"), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"create view {name} as select * from '{DATA}/{name}.parquet'")
    return connection


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(map(repr, frame.astype(object).where(frame.notna(), None).itertuples(index=False, name=None)))


@needs_data
@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    got = catalogue.QUERIES[name](spark, DATA).toPandas()
    if name not in catalogue.ORACLES:
        assert len(got)
        return
    want = duck.execute(catalogue.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


@needs_data
def test_stream_and_batch_agree(spark):
    batch = catalogue.QUERIES["track_events"](spark, DATA).drop("event_no").toPandas()
    assert len(batch) and rows(batch) == rows(catalogue.QUERIES["stream_track_events"](spark, DATA).toPandas())


@needs_data
def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@needs_data
def test_plans_read_only_what_they_need(spark):
    plan = catalogue.QUERIES["run_counters"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "timestamp_s" not in plan
    plan = catalogue.QUERIES["time_codes"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "source_text" not in plan and "PushedFilters: [IsNotNull(start_s)]" in plan
