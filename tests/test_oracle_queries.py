"""Every registered query with an oracle equals DuckDB on the same tables (sf0.001)."""
import pytest

from penalytics.plans.registry import all_queries
from tests.conftest import SF_SMALL
from tests.oracle_harness import compare

ORACLE = sorted(n for n, q in all_queries().items() if q.oracle is not None)


@pytest.mark.parametrize("name", ORACLE)
def test_query_matches_duckdb(spark, name):
    q = all_queries()[name]
    ok, msg = compare(spark, SF_SMALL, name, q.build, q.oracle)
    assert ok, msg


def test_entry_contract(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() > 0
    assert set(E.oracle_sql()) <= set(E.queries())
    # every oracle-less query of the analytics is a model or model-scoring query
    for name, query in all_queries().items():
        assert query.oracle or name.startswith(("model_", "consensus_", "cv_", "stream_model_")), name
