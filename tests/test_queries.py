"""Every registered query against its SQL."""

import oracle
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as registry

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return oracle.connect(SF_DIR)


def test_every_query_has_its_sql():
    assert set(registry._ping_queries()) == set(registry._ping_oracles())


def test_flagship_query(spark):
    rows = registry.entry(spark).collect()
    assert len(rows) == 6 and all(r["total_exposure_time"] >= 30 for r in rows)


@pytest.mark.parametrize("name", sorted(registry._ping_queries()))
def test_query(spark, connection, name):
    frame = registry._ping_queries()[name](spark, SF_DIR)
    expected, missing, extra = oracle.differences(frame, connection, registry._ping_oracles()[name])
    assert not missing and not extra


def test_a_longer_table(spark, tmp_path):
    """Eighty days: nothing in the queries or their SQL stops at a fixed day."""
    events = spark.read.parquet(f"{SF_DIR}/events.parquet").withColumn(
        "ts", F.expr("ts + make_dt_interval(cast((event_id % 3) * 25 AS int))")
    )
    events.coalesce(1).write.parquet(str(tmp_path / "spark"))
    part = next((tmp_path / "spark").glob("part-*"))
    part.rename(tmp_path / "events.parquet")
    connection = oracle.connect(str(tmp_path))
    for name in ("case_age", "daily_reach", "exposure_cascade", "cascade_over_edges", "geo_events_by_day"):
        frame = registry._ping_queries()[name](spark, str(tmp_path))
        expected, missing, extra = oracle.differences(frame, connection, registry._ping_oracles()[name])
        assert expected and not missing and not extra, name
