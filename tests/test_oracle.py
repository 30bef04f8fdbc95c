"""Every registered query against its SQL twin."""

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = (
    "region nation customer supplier part orders lineitem events documents"
    " embeddings pages benchmark labels conversations"
).split()

QUERIES = entry.queries()
ORACLE = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(
            f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')"
        )
    return con


def canonical(frame):
    columns = sorted(frame.columns)
    return columns, frame[columns].sort_values(columns).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, duck, sf_dir, name):
    got = QUERIES[name](spark, sf_dir).toPandas()
    if name not in ORACLE:
        assert len(got) > 0
        return
    columns, got = canonical(got)
    expected_columns, expected = canonical(duck.execute(ORACLE[name]).df())
    assert columns == expected_columns
    assert len(got) == len(expected)
    for column in columns:
        same = (got[column] == expected[column]) | (
            got[column].isna() & expected[column].isna()
        )
        assert same.all(), column


def test_every_twin_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


def test_flagship_query(spark):
    result = entry.entry(spark)
    assert result.count() == 395
