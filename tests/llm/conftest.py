import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table of (doc_id, text) pairs, dealt over a few partitions, with a clashing extra column."""
    def make(rows, parts=3):
        df = spark.createDataFrame([(i, t, None, "s", None if t is None else len(t)) for i, t in rows], DOCS)
        return df.repartition(parts)
    return make
