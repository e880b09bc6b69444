"""Small tables that every operator meets: nulls, empty texts, repeated rows, clashing names."""

import pytest

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside; as extra columns they must do no harm.
CLASHES = ("row", "fp", "tie", "nth", "component_id", "length", "task", "score", "label", "id", "_spans", "_base",
           "_new", "_keep", "segment", "runs", "found", "key", "n")


def make_docs(spark, rows, clashes=True):
    """``rows``: (doc_id, text) pairs."""
    full = [(i, t, "en", None, None if t is None else len(t)) for i, t in rows]
    df = spark.createDataFrame(full, DOC_SCHEMA)
    if clashes:
        from pyspark.sql import functions as F

        df = df.withColumns({c: F.lit("clash") for c in CLASHES})
    return df


@pytest.fixture
def docs(spark):
    return lambda rows, clashes=True: make_docs(spark, rows, clashes)
