"""Every query against its SQL, on the driver's tables."""

import os

import duckdb
import pytest
from fieldloom.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def test_every_query_has_sql_or_says_why():
    assert set(catalog.ORACLE_SQL) <= set(catalog.QUERIES)
    assert set(catalog.QUERIES) - set(catalog.ORACLE_SQL) <= {"balanced_logistic_cv", "perceptron_cv"}


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, sf_dir, duck, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    found = sorted(map(repr, (tuple(r) for r in df.select(*columns).collect())))
    result = duck.execute(catalog.ORACLE_SQL[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert found == sorted(repr(tuple(r[i] for i in order)) for r in result.fetchall())
