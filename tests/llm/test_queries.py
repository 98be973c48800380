"""Queries with SQL equal DuckDB; all of them run, also on empty tables, with stable schemas."""
import pytest

from penalytics.llm.queries import ORACLES, QUERIES
from penalytics.sources.tables import TABLES, table_path
from tests.oracle_harness import compare


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_duckdb(spark, small, name):
    ok, message = compare(spark, small, name, QUERIES[name], ORACLES[name])
    assert ok, message


@pytest.fixture(scope="module")
def empty_dir(spark, small, tmp_path_factory):
    folder = tmp_path_factory.mktemp("empty")
    for name in TABLES:
        if name in ("documents", "pages", "benchmark", "labels", "conversations"):
            spark.read.parquet(table_path(small, name)).limit(0).write.parquet(table_path(str(folder), name))
    return str(folder)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, small, empty_dir, name):
    found = QUERIES[name](spark, empty_dir)
    rows = found.collect()
    if name == "op8_chat_format":
        assert [r["conv_id"] for r in rows] == [-1]
    else:
        assert rows == []


def test_registered_in_the_entry():
    import __spark_entry__ as entry
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())
    assert set(ORACLES) <= set(entry.oracle_sql())
