import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

from brute import ODD  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row int, number string, _row string, host string, print int"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from texts (or (doc_id, text, lang, source)), with extra columns whose names clash with inner ones."""

    def build(texts, partitions=3):
        rows = []
        for k, t in enumerate(texts):
            i, text, lang, source = t if isinstance(t, tuple) else (k, t, "en", f"s{k % 3}")
            rows.append((i, text, lang, source, None if text is None else len(text), k, "n", "r", "h", k))
        return spark.createDataFrame(rows, SCHEMA).repartition(partitions)

    return build


@pytest.fixture(scope="session")
def odd(make):
    """Odd texts, a repeated row, a null doc_id, null lang and source."""
    rows = [(k, t, "en", "s") for k, t in enumerate(ODD)]
    return make([*rows, rows[5], (None, "no id here", None, None), (None, None, None, None)]).cache()


@pytest.fixture(scope="session")
def nothing(make):
    return make([], 1)
