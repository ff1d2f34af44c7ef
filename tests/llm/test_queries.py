"""Queries that SQL can express, against their SQL."""

import os

import pytest

from cuelattice.llm import queries
from tests.test_catalogue import DATA, duck, needs_data, rows  # noqa: F401


@needs_data
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query(spark, duck, name):  # noqa: F811
    for folder in (DATA, DATA.replace("sf0.001", "sf0.01")):
        if os.path.exists(f"{folder}/documents.parquet"):
            duck.execute(f"create or replace view documents as select * from '{folder}/documents.parquet'")
            got, want = queries.QUERIES[name](spark, folder).toPandas(), duck.execute(queries.ORACLES[name]).df()
            assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want) and len(got)
