import sys
from datetime import timedelta
from pathlib import Path

import pytest
from fixed_time import NOW

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from skywake.session import local_session

    return local_session(shuffle_partitions=4)


@pytest.fixture(scope="session")
def live_rows(spark):
    """Build a live table from partial rows; what is left out is null."""
    from skywake.schemas import LIVE

    def build(rows):
        full = []
        for number, row in enumerate(rows):
            filled = {"icao24": f"a{number:05d}", "on_ground": False, "ingested_at": NOW, **row}
            full.append(tuple(filled.get(name) for name in LIVE.fieldNames()))
        return spark.createDataFrame(full, LIVE)

    return build


@pytest.fixture(scope="session")
def run_rows(spark):
    from skywake.schemas import RUNS

    def build(rows):
        full = []
        for number, row in enumerate(rows):
            filled = {"id": number, "run_at": NOW, "status": "success", **row}
            full.append(tuple(filled.get(name) for name in RUNS.fieldNames()))
        return spark.createDataFrame(full, RUNS)

    return build


@pytest.fixture
def ago():
    return lambda **kwargs: NOW - timedelta(**kwargs)
