import pytest

WORDS = [f"w{k}" for k in range(400)]


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table from (doc_id, text) pairs, with the other columns filled in and one more."""

    def make(rows, lang="en", source="s"):
        full = [(i, t, lang, source, len(t) if t is not None else None, "x") for i, t in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, kept string")

    return make
