import pytest

import oracle
from saltmarsh.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_against_sql(name, spark):
    df = catalog.queries()[name](spark, SF)
    sql = catalog.oracle_sql().get(name)
    if sql:
        oracle.same(df, SF, sql)
    else:
        assert df.count() > 0
