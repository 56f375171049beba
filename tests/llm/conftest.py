import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty and very long texts, ties and repeated rows, a further column of a clashing name."""
    base = "one two three four five six seven.\nalpha beta gamma delta.\nthe end of it all.\nand more of it."
    rows = [
        (1, base, "en", "a", 5),
        (1, base, "en", "a", 5),
        (2, base, "en", None, 5),
        (3, None, "en", "a", None),
        (4, "", None, "b", 0),
        (5, " \n\t ", "de", "b", 0),
        (6, "123 456 !!", None, None, 1),
        (None, base, "fr", "c", 1),
        (7, "word " * 30_000, "en", "c", 1),
        (8, "a\n\nb  c\n" * 40, "en", "c", 1),
        (9, base + "\nunlike line here.", "de", "é", 1),
        (10, "x", "en", "a", 1),
    ]
    return spark.createDataFrame([(*r, r[4]) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, n_lines long")


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
