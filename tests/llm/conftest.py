import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table from (doc_id, text) pairs, or longer rows with more columns."""

    def make(rows, more=""):
        return spark.createDataFrame(rows, "doc_id long, text string" + more)

    return make
