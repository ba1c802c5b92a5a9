import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
from helpers import sentences  # noqa: E402

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint, key bigint, f string, size string, h string, votes string, rank int, n int"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents of (id, text) or (id, text, source), with further columns whose names operators use inside."""
    def make(rows):
        return spark.createDataFrame(
            [(r[0], r[1], "en", r[2] if len(r) > 2 else "a", None, 7, "x", "y", "z", "v", 1, 2) for r in rows], COLUMNS)

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and blank texts, repeated rows, one id with two texts, a very long text, a null id."""
    long = sentences(99, 30_000)
    return [(1, None), (2, ""), (3, " \n\t\x0b "), (4, "one"), (4, "one"), (4, "two words"), (None, "no id here"), (None, "no id here"),
            (5, long), (6, sentences(5, 120)), (7, sentences(5, 120)), (8, sentences(6, 300))]
