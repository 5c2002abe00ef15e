"""One local session for the whole run; an empty run is an error."""

from __future__ import annotations

import pytest

from textassay.session import build


def pytest_collection_modifyitems(items):
    if not items:
        raise pytest.UsageError("no tests selected; an empty run is not a pass")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build(
        "textassay-tests",
        **{
            "spark.master": "local[8]",
            "spark.ui.enabled": "false",
            "spark.sql.shuffle.partitions": "8",
            "spark.driver.memory": "8g",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoints")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
