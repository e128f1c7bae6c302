import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tests"))

from logspark.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return build_session("tests")


@pytest.fixture()
def lines_of(spark):
    """A line table from ``{file_id: [raw, ...]}``."""

    def build(files):
        rows = [(f, n, raw) for f, raws in files.items() for n, raw in enumerate(raws, 1)]
        return spark.createDataFrame(rows, "file_id long, line_no long, raw string")

    return build
