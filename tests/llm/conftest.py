"""Fixtures of the text operators' tests."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

from conftest_helpers import SCHEMA  # noqa: E402


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls in every column, empty and long texts, repeated rows, clashing extra columns."""
    long = " ".join(f"word{i % 7919}" for i in range(60_000))
    rows = [
        (1, "alpha beta gamma delta epsilon zeta", "en", "b", 3),
        (1, "alpha beta gamma delta epsilon zeta", "en", "b", 3),
        (2, "alpha  beta gamma\tdelta epsilon\nzeta", "en", None, 3),
        (3, None, "de", "a", None),
        (4, "", None, "a", 0),
        (5, " \n\t\x0b\x0c\r ", "de", "c", 7),
        (None, "alpha beta gamma delta epsilon zeta", "en", "b", 3),
        (None, None, None, None, None),
        (6, long, "en", "b", len(long)),
        (7, "x", "fr", "b", 1),
        (8, "12345 !!! ???", "fr", "\U0001f600", 1),
        (-9, "grüße aus köln <|endoftext|> ende\n\nzwei  leer", "de", "￮", 1),
    ]
    frame = spark.createDataFrame(rows, SCHEMA)
    extra = {c: frame["doc_id"] for c in ("h", "key", "size", "kept", "row", "cell", "weight", "copies", "fp", "skey")}
    return frame.withColumns(extra)


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)
