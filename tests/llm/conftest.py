import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from conftest_llm import prose  # noqa: E402


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and long texts, ties, repeated rows."""
    base = prose(1)
    return [(1, base, "en"), (2, base, "en"), (2, base, "en"), (3, None, "en"), (4, "", None), (5, "  \n ", "de"), (None, base, "en"),
            (None, None, None), (6, prose(2, 30_000), "fr"), (7, base.replace("w", "W", 1), "en"), (8, "kurz", "de"), (8, prose(9), "de"),
            (9, "é" * 60 + prose(1, 20), None), (10, "é" * 60 + prose(1, 20) + " end", None)]


@pytest.fixture(scope="session")
def llm(spark):
    from runwise.llm.common import prepare
    prepare(spark)
    return spark
