"""Every query with SQL against DuckDB on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from kinelake.plans import registry

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    return con


def rows(frame: pd.DataFrame) -> list[tuple]:
    columns = sorted(frame.columns)
    clean = frame[columns].astype(object).where(frame[columns].notna(), None)
    return sorted((tuple(round(v, 4) if isinstance(v, float) else v for v in r) for r in clean.values.tolist()), key=str)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    ours, theirs = registry.queries()[name](spark, FOLDER).toPandas(), duck.sql(registry.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    assert registry.queries()[name](spark, FOLDER).count() > 0


def test_stream_equals_batch(spark):
    q = registry.queries()
    pairs = {(r.request_id, r.worker_id) for r in q["broker_stream"](spark, FOLDER).collect()}
    assert pairs == {(r.request_id, r.worker_id) for r in q["broker_dispatch"](spark, FOLDER).collect() if r.worker_id is not None}
