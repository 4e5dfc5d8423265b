"""Every registered query outside the language-model part against DuckDB over the same tables."""

import pytest

from quern.plans import catalog
from tests.compare import SF, connect, duck_rows, spark_rows


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, con, name):
    df = catalog.queries()[name](spark, SF)
    got = spark_rows(df)
    if name in catalog.oracle_sql():
        assert got == duck_rows(con, catalog.oracle_sql()[name])
    else:
        assert df.columns and got == spark_rows(catalog.queries()[name](spark, SF))
