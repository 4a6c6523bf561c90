import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark():
    from loamstone.session import build_session

    return build_session(4, shuffle_partitions=4, memory="4g")


#: Texts with nulls, empties, spaces, repeats, copies, a long one, and characters of several bytes.
_LONG = " ".join(f"word{i % 997} über{i % 89}" for i in range(6000))
TEXTS = [
    None, "", "   ", "one", "one two", "Same text here, twice over and over again.", "Same text here, twice over and over again.", "a\tb\nc\x0bd\x0ce\rf  g",
    "spam " * 400, _LONG, _LONG[:9000], "x" + _LONG[1000:4000], "é" * 900, "é" * 700, "line\nline\nline\nother\n\n", _LONG,
]


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with every odd case; also a repeated row, a null id, null sources and clashing extra columns."""
    rows = [(i, t, "en", None if i % 5 == 0 else f"src{i % 2}", len(t or ""), f"k{i}") for i, t in enumerate(TEXTS)]
    rows += [rows[5], (None, "no id but a text of some words", None, "src0", None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, rules string").repartition(3)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
