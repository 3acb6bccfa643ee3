import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def make_docs(spark):
    """Documents from texts (or (id, text) pairs), over several partitions."""

    def make(rows, partitions=3):
        rows = [r if isinstance(r, tuple) else (k, r) for k, r in enumerate(rows)]
        return spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in rows], DOCS).repartition(partitions)

    return make
