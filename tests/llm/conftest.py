import pytest


@pytest.fixture
def docs(spark):
    """Builds a documents table with the awkward rows added: nulls, blanks, a very long text, repeated rows, a clashing extra column."""

    def make(rows, extra=True):
        odd = [(901, None), (902, ""), (903, " \n\t "), (904, "solo"), (905, "long " * 20_000 + "end"), (906, "twin text of a few words here"), (906, "twin text of a few words here"), (None, "row without an id")]
        rows = [(i, t, "xx", "s", 0, f"src{(i or 0) % 3}") for i, t in [*rows, *(odd if extra else [])]]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, part string, n_tokens long, source string").repartition(3)

    return make
