import pytest


@pytest.fixture
def docs(spark):
    """Builds a documents table with nulls, repeats and columns of clashing names."""

    def build(rows, columns="doc_id long, text string"):
        return spark.createDataFrame(rows, columns)

    return build
