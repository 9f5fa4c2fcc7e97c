import datetime

import pytest
from helpers import DAY, at, ping, pings
from pyspark.sql import functions as F

from pingtrace.functions.geo import CellGrid
from pingtrace.operators.cohorts import drop_ids, keep_ids
from pingtrace.sources import results, staging
from pingtrace.sources.pings import PING_SCHEMA, day_slice, normalise_pings, read_parquet, read_pings, write_pings

NEXT = DAY + datetime.timedelta(days=1)


@pytest.fixture
def table(spark, tmp_path):
    rows = [ping(str(i), (40.0 + i, -3.7), f"{i:02}:00:00", DAY + datetime.timedelta(days=i % 3)) for i in range(12)]
    path = str(tmp_path / "pings")
    write_pings(pings(spark, rows), path)
    return path, sorted(rows)


def _rows(df):
    return sorted(tuple(r) for r in df.select("id", "latitude", "longitude", "ts", "iso_date").collect())


def test_round_trip_by_day(spark, table):
    path, rows = table
    assert _rows(read_pings(spark, path, timestamp="ts")) == rows


def test_reading_some_days_prunes_folders(spark, table):
    path, rows = table
    some = read_pings(spark, path, days=("2024-01-01", "2024-01-02"), timestamp="ts")
    assert _rows(some) == [r for r in rows if r[4] <= NEXT]
    one = day_slice(read_pings(spark, path, timestamp="ts"), NEXT)
    assert _rows(one) == [r for r in rows if r[4] == NEXT]
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "iso_date" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_reading_listed_partitions_keeps_the_day(spark, table):
    path, rows = table
    listed = read_pings(spark, path, partitions=[f"{path}/iso_date=2024-01-02"], timestamp="ts")
    assert _rows(listed) == [r for r in rows if r[4] == NEXT]
    assert "iso_date" in read_parquet(spark, path, f"{path}/iso_date=2024-01-03").columns


def test_normalising(spark):
    raw = spark.createDataFrame(
        [
            (1, "40.5", -3.0, "2024-01-01 10:00:00", "2024-01-01"),
            (2, "40.5", -3.0, "not a time", "2024-01-01"),
            (3, "north", -3.0, "2024-01-01 10:00:00", "2024-01-01"),
            (4, None, -3.0, "2024-01-01 10:00:00", "2024-01-01"),
            (None, "40.5", -3.0, "2024-01-01 10:00:00", "2024-01-01"),
            (5, "40.5", float("nan"), "2024-01-01 10:00:00", "2024-01-01"),
        ],
        "who bigint, lat string, lon double, moment string, date string",
    )
    found = normalise_pings(raw, id="who", latitude="lat", longitude="lon", timestamp="moment", day="date")
    (row,) = found.collect()
    assert tuple(row) == ("1", 40.5, -3.0, at("10:00:00"), DAY)
    assert [f.dataType.simpleString() for f in found.schema] == ["string", "double", "double", "timestamp_ntz", "date"]


def test_normalising_numbers_and_days_from_times(spark):
    raw = spark.createDataFrame([("p", 1.0, 2.0, 1704103200)], "id string, latitude double, longitude double, timestamp bigint")
    (row,) = normalise_pings(raw, day=None).collect()
    assert row["ts"] == at("10:00:00") and row["iso_date"] == DAY


def test_result_tables_round_trip(spark, tmp_path):
    daily = spark.createDataFrame([(1, 5), (0, 3)], results.DAILY_SCHEMA)
    results.write_daily_counts(daily, str(tmp_path / "daily"))
    assert [tuple(r) for r in results.read_daily_counts(spark, str(tmp_path / "daily")).collect()] == [(0, 3), (1, 5)]
    assert len(list((tmp_path / "daily").glob("*.csv"))) == 1
    geo = spark.createDataFrame([(2, 40.25, -3.5, 7), (1, 40.0, -3.5, 2)], "day int, latitude double, longitude double, tot_evts bigint")
    results.write_geo_totals(geo, str(tmp_path / "geo"))
    assert sorted(tuple(r) for r in results.read_geo_totals(spark, str(tmp_path / "geo")).collect()) == [
        (40.0, -3.5, 2),
        (40.25, -3.5, 7),
    ]
    results.write_geo_totals_by_day(geo, str(tmp_path / "by_day"))
    assert spark.read.parquet(str(tmp_path / "by_day")).where("day = 2").count() == 1
    results.write_lines(spark.createDataFrame([("a,b",)], "line string"), str(tmp_path / "lines"))
    assert spark.read.text(str(tmp_path / "lines")).first()[0] == "a,b"


def test_staging_keeps_schema_and_rows(spark):
    rows = pings(spark, [ping("p", (1.0, 2.0), "10:00:00")])
    for partition_by in ((), ("iso_date",)):
        copy = staging.staged(rows, "test", partition_by)
        assert sorted(copy.columns) == sorted(rows.columns)
        assert _rows(copy) == _rows(rows)
        assert _rows(staging.staged(rows.limit(0), "test", partition_by)) == []


def test_broadcast_is_asked_for_only_below_the_limit(spark):
    def hinted(df):
        return "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()

    small = spark.range(10).select(F.col("id").cast("string"))
    assert hinted(staging.broadcast_if_small(small, max_rows=10))
    assert not hinted(staging.broadcast_if_small(small, max_rows=9))


@pytest.mark.parametrize("limit", [0, 100])
def test_cohorts_of_any_size(spark, limit, monkeypatch):
    from pingtrace.operators import cohorts

    monkeypatch.setattr(cohorts, "broadcast_if_small", lambda df: staging.broadcast_if_small(df, limit))
    table = pings(spark, [ping(n, (1.0, 2.0), "10:00:00") for n in "aabc"] + [(None, 1.0, 2.0, at("10:00:00"), DAY)])
    cohort = spark.createDataFrame([("a",), ("a",), (None,)], "id string")
    assert sorted(r["id"] for r in keep_ids(table, cohort).collect()) == ["a", "a"]
    assert sorted(r["id"] for r in drop_ids(table, cohort).collect()) == ["b", "c"]
    assert drop_ids(table, cohort.limit(0)).count() == 4


def test_impossible_positions_and_unreadable_values_are_left_out(spark):
    infinite = float("inf")
    rows = [("a", 10.0, 20.0, "2024-01-01 10:00:00", "2024-01-01"), ("b", 91.0, 0.0, "2024-01-01 10:00:00", "2024-01-01"),
            ("c", 200.0, 0.0, "2024-01-01 10:00:00", "2024-01-01"), ("d", infinite, 0.0, "2024-01-01 10:00:00", "2024-01-01"),
            ("e", 0.0, 1e6, "2024-01-01 10:00:00", "2024-01-01"), ("f", float("nan"), 0.0, "2024-01-01 10:00:00", "2024-01-01"),
            ("g", 90.0, -180.0, "2024-01-01 10:00:00", "2024-01-01"), ("h", 1.0, 1.0, "no time", "2024-01-01"),
            ("i", 1.0, 1.0, "2024-01-01 10:00:00", "no day")]
    frame = spark.createDataFrame(rows, "id string, latitude double, longitude double, timestamp string, iso_date string")
    found = normalise_pings(frame)
    assert sorted(r["id"] for r in found.collect()) == ["a", "g"]
    assert found.schema.simpleString() == PING_SCHEMA.simpleString()


def test_a_position_beyond_the_pole_is_copied_once(spark):
    frame = spark.createDataFrame([(lat, 0.0) for lat in (40.0, 91.0, 200.0, -500.0)], "latitude double, longitude double")
    counts = CellGrid(10.0).with_reached_cells(frame, "latitude", "longitude").groupBy("latitude").count().collect()
    assert max(r["count"] for r in counts if abs(r["latitude"]) < 90) <= 9
