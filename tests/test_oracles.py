"""Every registered query of the engine that SQL can express, against DuckDB on the driver's smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

import gustfield.plans.anomaly_fields  # noqa: F401  registers its queries
import gustfield.plans.catalogue_documents  # noqa: F401
import gustfield.plans.comparisons  # noqa: F401
import gustfield.plans.degrees  # noqa: F401
import gustfield.plans.fields  # noqa: F401
import gustfield.plans.point_fields  # noqa: F401
import gustfield.plans.stations  # noqa: F401
from gustfield.plans.catalogue import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def rows(df):
    cell = lambda x: "~" if pd.isna(x) else repr(round(float(x), 6) + 0.0) if isinstance(x, float) else str(x)
    return sorted(tuple(map(cell, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
