import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from gazetta.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    found = build_session("tests", cores="8", **{"spark.sql.shuffle.partitions": "8", "spark.ui.showConsoleProgress": "false"})
    found.sparkContext.setLogLevel("ERROR")
    yield found
    found.stop()
