import pytest

from seriesforge.llm._frames import prepare

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def lab(spark):
    return prepare(spark)


@pytest.fixture(scope="session")
def make_docs(lab):
    """(doc_id, text) pairs -> documents with clashing extra columns."""
    def make(rows):
        full = [(i, t, ["en", "de", None][k % 3], ["a", None][k % 2], len(t or ""), "x", k, 0.5, k) for k, (i, t) in enumerate(rows)]
        return lab.createDataFrame(full, DOCUMENTS + ", th string, start int, score double, row long")
    return make


def key(row):
    return tuple((x is None, x) for x in row)
