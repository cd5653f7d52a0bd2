import pytest

from marlstone.plans import registry

from .oracle import duck, rows

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_matches_duckdb(spark, name):
    got = registry.QUERIES[name](spark, SF).toPandas()
    want = duck(registry.ORACLES[name], SF)
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0
