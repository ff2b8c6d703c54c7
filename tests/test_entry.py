"""Every query of the engine against its SQL at the smallest scale."""

import os

import duckdb
import pytest

from tablescout import workload

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(str(r[i]) for i in order) for r in data])


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", list(workload.queries()))
def test_query_against_sql(spark, duck, name):
    got = workload.queries()[name](spark, SF)
    want = duck.execute(workload.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert rows(got.columns, got.collect()) == rows(columns, want.fetchall())


def test_entry_imports_without_the_subpackage(spark, monkeypatch):
    import __spark_entry__ as entry

    monkeypatch.setattr(entry, "_llm", lambda: None)
    monkeypatch.setattr(entry, "_pipeline", lambda: None)
    assert set(entry.queries()) == set(workload.queries()) == set(entry.oracle_sql())
    assert entry.entry(spark).limit(1).count() == 1
