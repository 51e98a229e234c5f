import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from logweave.schema import LINE_SCHEMA  # noqa: E402
from logweave.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, memory="4g")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    if session.conf.get("spark.checkpoint.dir", None) is None:
        session.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="logweave-test-"))
    return session


@pytest.fixture(scope="session")
def lines_of(spark):
    """Lines DataFrame from {source name: text}, spread over several partitions."""

    def make(texts: dict[str, str]):
        rows = [
            (f"/logs/{name}", name, 0, i, line)
            for name, text in texts.items()
            for i, line in enumerate(text.split("\n"))
        ]
        return spark.createDataFrame(rows, LINE_SCHEMA).repartition(3)

    return make
