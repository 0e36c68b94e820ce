import pytest

from quarry.operators.bm25 import query_terms
from quarry.queries import ORACLE, QUERIES, WORDS_QUERY
from tests.oracle import SMALL, same


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_duckdb(spark, name):
    same(spark, QUERIES[name], ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, name):
    df = QUERIES[name](spark, SMALL)
    assert len(df.columns) == len(set(df.columns))
    df.collect()


def test_the_oracle_asks_for_the_same_terms(spark):
    assert query_terms(spark, WORDS_QUERY) == {"hatr": 2, "licens": 1, "ver": 1, "hatr_hatr": 1, "hatr_licens": 1, "licens_ver": 1}


def test_entry_points_without_and_with_llm(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() >= 0
    assert set(ORACLE) <= set(e.oracle_sql()) <= set(e.queries())
