import pytest


@pytest.fixture
def docs_of(spark):
    """A documents table from (doc_id, text, lang) rows, with a column whose name an operator also uses."""

    def make(rows, extra=()):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "src", len(r[1]) if r[1] else 0, 1.0) for r in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, score double")

    return make
