"""Every registered query with an SQL twin gives the same rows as DuckDB."""

import pytest

from plyweave.plans import registry

from .compare import duck, spark_rows

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracle(spark, name):
    got = spark_rows(registry.QUERIES[name](spark, SF))
    assert got == duck(registry.ORACLES[name], SF) and len(got[1]) > 0


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0
