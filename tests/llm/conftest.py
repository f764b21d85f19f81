import pytest


@pytest.fixture
def docs(spark):
    """A table of documents with clashing extra columns, from (doc_id, text[, source]) rows."""

    def make(rows):
        full = [(i, t, "en", s[0] if s else "a", None if t is None else len(t), "x", 1) for i, t, *s in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, score string, size int")

    return make
