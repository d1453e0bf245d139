import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from (id, text) pairs, with further columns whose names clash with results."""

    def make(rows):
        kind = "doc_id long, text string, n_words string, score string, spans string, row string, s string, id string"
        return spark.createDataFrame([(i, t, "x", "x", "x", "x", "x", "x") for i, t in rows], kind)

    return make
