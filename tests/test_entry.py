import inspect

import pytest

import __spark_entry__ as contract

SF = "/root/testdata/sf0.001"


def test_every_statement_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert len(contract.queries()) >= 100
    assert all(callable(build) and len(inspect.signature(build).parameters) == 2 for build in contract.queries().values())


def test_flagship(spark):
    assert contract.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["a1_quality_stats", "d6_score_anchors", "j4_shared_vocabulary", "f18_signature"])
def test_statement_agrees(spark, name):
    duckdb = pytest.importorskip("duckdb")
    from metreur.views import TABLES

    db = duckdb.connect()
    for table in TABLES:
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    result = db.execute(contract.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    rows = contract.queries()[name](spark, SF).select(*columns).collect()
    rounded = lambda r: tuple(round(x, 9) if isinstance(x, float) else x for x in r)
    assert sorted(map(str, map(rounded, rows))) == sorted(map(str, map(rounded, result.fetchall())))
