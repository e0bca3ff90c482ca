import pytest

#: Names that operators use inside, as extra columns of the input.
CLASHING = "size string, rank string, cell string, digest string, set_id string, a string, b string, score string, predicted string, turns string, _locator2 string, n string"


@pytest.fixture(scope="session")
def documents(spark):
    """A frame of documents from (doc_id, text[, lang[, source]]), with extra columns."""

    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", 0, *["x"] * 12) for r in rows]
        return spark.createDataFrame(full, f"doc_id long, text string, lang string, source string, n_chars long, {CLASHING}")

    return make
