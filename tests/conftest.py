import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from leafwise.operators.ordered import CHUNK_BITS_CONF  # noqa: E402
from leafwise.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    folder = tmp_path_factory.mktemp("checkpoint")
    session = build_session(
        "leafwise-tests",
        "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.driver.memory": "4g",
            "spark.checkpoint.dir": str(folder),
            "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def tiny_chunks(spark):
    """Chunks of four positions: every path across chunks is taken."""
    spark.conf.set(CHUNK_BITS_CONF, "2")
    yield
    spark.conf.unset(CHUNK_BITS_CONF)


def rows_of(df):
    return [tuple(r) for r in df.collect()]
