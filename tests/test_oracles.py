"""Every registered query of the library proper against DuckDB on the smallest tables."""

import pytest

from lexigrain.plans import cohesion, corpus, registry, structure, tables
from tests.duck import connect, rows_of_duck, rows_of_spark

SF = "/root/testdata/sf0.001"
QUERIES = registry.QUERIES | tables.QUERIES | structure.QUERIES | corpus.QUERIES | cohesion.QUERIES
ORACLE = registry.ORACLE_SQL | tables.ORACLE_SQL | structure.ORACLE_SQL | corpus.ORACLE_SQL | cohesion.ORACLE_SQL


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_duckdb(spark, duck, name):
    assert rows_of_spark(QUERIES[name](spark, SF)) == rows_of_duck(duck, ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs_over_its_table(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
