import pytest

TEXT = "doc_id long, text string, lang string, source string, n_chars long, score double, word string, cid long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents of (doc_id, text), with further columns whose names clash with the operators' own."""

    def make(rows):
        return spark.createDataFrame([(i, t, "en", "s", len(t) if t else None, 1.0, "w", 7) for i, t in rows], TEXT)

    return make
