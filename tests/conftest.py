import json
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from veristrand.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(2, "veristrand-tests", **{
        "spark.sql.shuffle.partitions": "2",
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoint")),
        "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
    })
    yield session
    session.stop()


@pytest.fixture
def write_jsonl():
    def write(directory, name, rows):
        directory.mkdir(parents=True, exist_ok=True)
        (directory / (name + ".jsonl")).write_text("".join(json.dumps(row) + "\n" for row in rows))

    return write
