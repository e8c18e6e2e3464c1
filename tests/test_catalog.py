"""Every query of the catalog runs; those with SQL equal it."""

import pytest
from oracle import check

from subtide.plans import catalog

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, name):
    df = catalog.queries()[name](spark, FOLDER)
    sql = catalog.oracle_sql().get(name)
    if sql:
        check(df, sql, FOLDER)
    else:
        assert df.count() > 0
