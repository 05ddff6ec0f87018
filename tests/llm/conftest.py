import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def corpus(spark):
    """A table like ``documents`` from (doc_id, text) or (doc_id, text, source), with columns that clash."""

    def make(rows, extra=True):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, SCHEMA)
        if extra:  # names that the operators use themselves
            df = df.selectExpr("*", "'x' as size", "'x' as digest", "'x' as node", "'x' as n", "'x' as score", "'x' as found")
        return df

    return make
