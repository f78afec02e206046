import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    def make(rows, schema=DOC):
        full = [tuple(r) + (None,) * (5 - len(r)) for r in rows] if schema == DOC else rows
        return spark.createDataFrame(full, schema)

    return make


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOC)
