import pytest


@pytest.fixture
def documents(spark):
    """A documents table from (doc_id, text) pairs."""

    def make(rows):
        full = [(i, t, "en", "src0", len(t or "")) for i, t in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long")

    return make


@pytest.fixture
def awkward():
    """Null, empty, blank, tiny, repeated and long texts, and a null id."""
    long = " ".join(f"w{i % 977}x{i}" for i in range(20000))
    return [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "same text here " * 40), (6, "same text here " * 40), (7, long), (8, "é ß 漢字 🙂 " * 30), (9, "-" * 500), (None, "no id " * 60)]
