import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = tmp_path_factory.mktemp("shared")
    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{shared}").config("spark.sql.warehouse.dir", f"{shared}/warehouse").config("spark.driver.memory", "4g").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def make_db(tmp_path):
    """Writes {collection: {file: text}} and returns the root."""

    def make(files: dict[str, dict[str, str]]) -> str:
        for name, members in files.items():
            for rel, text in members.items():
                at = tmp_path / name / rel
                at.parent.mkdir(parents=True, exist_ok=True)
                at.write_bytes(text.encode())
        return str(tmp_path)

    return make
