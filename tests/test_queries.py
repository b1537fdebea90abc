"""Every registered query runs, and gives what its SQL gives on the same tables."""

import duckdb
import pytest

from quorumlake.plans import catalogue, deltas, details, storage  # noqa: F401  the others register their queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if value is None or value != value:
        return None
    return float(value) if isinstance(value, (int, float)) and not isinstance(value, bool) else str(value)


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{sf_dir}/{name}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, sf_dir, db, name):
    found = catalogue.QUERIES[name](spark, sf_dir)
    columns = sorted(found.columns)
    rows = [tuple(plain(r[c]) for c in columns) for r in found.collect()]
    if name not in catalogue.SQL:
        assert rows
        return
    cursor = db.execute(catalogue.SQL[name])
    names = [x[0] for x in cursor.description]
    assert sorted(names) == columns
    want = [tuple(plain(dict(zip(names, r, strict=True))[c]) for c in columns) for r in cursor.fetchall()]
    assert sorted(rows, key=str) == sorted(want, key=str)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["request", "span", "digest"]


def test_packed_records_encode_once(spark, sf_dir):
    plan = catalogue.QUERIES["H16_packed_records"](spark, sf_dir)._jdf.queryExecution()
    assert plan.analyzed().toString().count("to_json") <= 2
    assert plan.optimizedPlan().toString().count("to_json") <= 2
