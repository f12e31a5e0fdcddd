import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and white texts, repeated rows, ties, a very long text, and columns with clashing names."""
    from plain import ODD
    return spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string, n_chars long, n_tokens string, uid string, a string, kept boolean")


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").cache()
