import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, h string, score string"


@pytest.fixture(scope="session")
def docs(spark):
    """Make a documents table with extra columns whose names clash with internal ones."""

    def make(rows):
        return spark.createDataFrame([(i, t, "en", "s", None, "x", "y", "z") for i, t in rows], DOCS)

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Null id, null, empty and blank texts, a repeated row, equal texts, a long text."""
    long = " ".join(f"word{k % 700} thing{k}" for k in range(12_000))
    return [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (4, "one"), (5, "same text in two rows, really"),
            (6, "same text in two rows, really"), (None, "no id at all here"), (7, long), (8, "Ünïcode ñ 日本語 \U0001f600 text"), (9, "ab " * 90)]
