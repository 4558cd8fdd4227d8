import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ["PYTHONPATH"] = os.pathsep.join([sys.path[0], os.environ.get("PYTHONPATH", "")])


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "3g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make_log(spark):
    """(case, path, waits in days) triples as an event log."""
    from flowloom.schema import DAY_MS, LOG_SCHEMA

    start = 1_767_225_600_000  # 2026-01-01

    def make(cases):
        rows = []
        for case, path, waits in cases:
            at = start
            for i, activity in enumerate(path):
                rows.append((len(rows), case, activity, int(at), f"{activity}-owner", "complete", None))
                at += (waits[i] if i < len(waits) else 1) * DAY_MS
        return spark.createDataFrame(rows, LOG_SCHEMA)

    return make
