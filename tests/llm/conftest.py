import pytest

from boardwalk.llm.ship import ship

DDL = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Documents of (doc_id, text) pairs, with the other columns of the table and some of clashing names."""
    ship(spark)

    def build(pairs):
        rows = [(i, t, "en", "s", len(t or ""), 1, [0], "x") for i, t in pairs]
        return spark.createDataFrame(rows, DDL + ", n int, signs array<int>, component string")

    return build
