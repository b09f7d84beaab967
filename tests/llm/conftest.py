import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """A documents table from (doc_id, text, lang) rows."""

    def build(rows):
        return spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], SCHEMA)

    return build


@pytest.fixture(scope="session")
def odd(make):
    """Nulls, empty and long texts, repeated rows, multi-byte characters."""
    passage = " ".join(f"w{k}" for k in range(60))
    return make([
        (1, None, "en"), (2, "", None), (3, "  \n\t", "en"), (4, passage, "en"), (4, passage, "en"), (5, "x " + passage + " y é", "fr"),
        (None, "null id " + passage, "en"), (7, "1234 56 !!", "en"), (8, "ab" * 6000, "de"), (9, "日本 語 " * 50, "de"), (10, "the end", "en"),
    ])


@pytest.fixture(scope="session")
def empty(make):
    return make([(1, "x", "en")]).where("doc_id < 0")
