"""Every registered query of the plans against its SQL, on the smallest tables."""

import pytest
from compare import both

from claimspark.plans import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(spark, name):
    got, names, want, columns = both(spark, SF, QUERIES[name], ORACLE_SQL[name])
    assert names == columns
    assert len(got) == len(want)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() >= 0
