import pytest

from skywake.llm.common import ship


@pytest.fixture(scope="session")
def llm(spark):
    ship(spark)
    return spark


@pytest.fixture(scope="session")
def documents(llm):
    """documents with a column whose name clashes with the operators' own."""

    def build(rows):
        full = [(doc_id, text, "en", "a", None, "x") for doc_id, text in rows]
        return llm.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, score string")

    return build
