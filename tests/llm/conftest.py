import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra string"


@pytest.fixture(scope="session")
def frame(spark):
    """Documents from (doc_id, text) pairs, with all columns of the table and one more."""
    def make(rows):
        return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), "x") for i, t in rows], SCHEMA)
    return make
