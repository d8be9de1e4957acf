import pytest
from oracle import connect, duck_rows, spark_rows

from hintspark.queries import registered

SF = "/root/testdata/sf0.001"
QUERIES = registered()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", [n for n, (_, sql) in QUERIES.items() if sql])
def test_equals_its_sql(spark, con, name):
    query, sql = QUERIES[name]
    assert spark_rows(query(spark, SF)) == duck_rows(con, sql)


@pytest.mark.parametrize("name", [n for n, (_, sql) in QUERIES.items() if not sql])
def test_without_sql_gives_rows(spark, name):
    assert QUERIES[name][0](spark, SF).head(1)


def test_entry_and_names(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
