import pytest

DOCS = "doc_id long, text string, score string, component_id string, spans string, n_chars long, source string"


@pytest.fixture
def docs_of(spark):
    """Documents with extra columns whose names clash with what the operators make."""

    def make(rows):
        return spark.createDataFrame([(i, t, "x", "y", "z", len(t or ""), "s") for i, t in rows], DOCS)

    return make
