import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """Rows with nulls in every column, empty and very long texts, ties and repeated rows."""

    def make(*rows):
        return spark.createDataFrame([(i, t, lang, src, len(t) if t else 0) for i, t, lang, src in rows], DOCS)

    return make


@pytest.fixture
def odd(documents):
    words = "the quick brown fox jumps over the lazy dog and runs away from all of them again "
    return documents(
        (1, words * 3, "en", "a"), (2, words * 3, "en", "a"), (2, words * 3, "en", "a"), (3, None, "en", "a"), (4, "", None, None), (None, "no id here " * 4, "fr", "b"),
        (5, " \n\t ", "en", None), (6, "one two", "en", "b"), (7, "long " * 60_000, "en", "b"), (8, words * 2 + "entirely different ending of this text", None, "a"),
    )
