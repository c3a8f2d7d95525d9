from __future__ import annotations

import pytest


@pytest.fixture(scope="session")
def spark():
    from tilmark.session import local_session

    session = local_session(4, app="tests", driver_memory="3g", **{"spark.sql.shuffle.partitions": "4", "spark.sql.adaptive.coalescePartitions.enabled": "true"})
    yield session
    session.stop()
