import pytest

from tests.conftest import SF_SMALL


@pytest.fixture(scope="session")
def small():
    return SF_SMALL


@pytest.fixture(scope="session")
def docs_of(spark):
    """documents with given (doc_id, text) rows; extra columns carry clashing names."""

    def make(rows, lang="en"):
        schema = ("doc_id long, text string, lang string, source string, n_chars long, score double, kept boolean, "
                  "key string, id long, hash long, fp long")
        return spark.createDataFrame([(i, t, lang, "s", len(t or ""), 0.5, False, "k", 1, 2, 3) for i, t in rows], schema)

    return make
