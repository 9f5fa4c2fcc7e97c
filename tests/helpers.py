"""Small tables written by hand, and plain-Python forms of the operators."""

from __future__ import annotations

import datetime
import math

from pyspark.sql import DataFrame, SparkSession

EARTH_RADIUS_M = 6_371_000.0
DAY = datetime.date(2024, 1, 1)
STAY_SCHEMA = (
    "track_position_counter int, id string, latitude double, longitude double, "
    "start_position_time timestamp_ntz, tot_evts bigint, end_position_time timestamp_ntz, iso_date date"
)
PING_SCHEMA = "id string, latitude double, longitude double, ts timestamp_ntz, iso_date date"


def at(text: str, day: datetime.date = DAY) -> datetime.datetime:
    return datetime.datetime.combine(day, datetime.time.fromisoformat(text))


def ping(id, place, time, day=DAY):
    lat, lon = place
    return (id, float(lat), float(lon), at(time, day), day)


def stay(counter, id, place, start, end, day=DAY):
    lat, lon = place
    return (counter, id, float(lat), float(lon), at(start, day), 2, at(end, day), day)


def pings(spark: SparkSession, rows) -> DataFrame:
    return spark.createDataFrame(rows, PING_SCHEMA)


def stays(spark: SparkSession, rows) -> DataFrame:
    return spark.createDataFrame(rows, STAY_SCHEMA)


def ids(spark: SparkSession, names) -> DataFrame:
    return spark.createDataFrame([(n,) for n in names], "id string")


def metres(lat1, lon1, lat2, lon2) -> float:
    lat1, lon1, lat2, lon2 = map(math.radians, (lat1, lon1, lat2, lon2))
    h = math.sin((lat2 - lat1) / 2) ** 2
    h += math.cos(lat1) * math.cos(lat2) * math.sin((lon2 - lon1) / 2) ** 2
    return 2 * EARTH_RADIUS_M * math.asin(min(1.0, math.sqrt(h)))


def runs(rows) -> list[tuple]:
    """(id, day, number, latitude, longitude, pings, start, end) of each stay."""
    found = []
    last = None
    for id, lat, lon, ts, day in sorted(rows, key=lambda r: (r[0], r[4], r[3], r[1], r[2])):
        if last is not None and last[:2] == [id, day] and last[3:5] == [lat, lon]:
            last[5] += 1
            last[7] = ts
            continue
        number = last[2] + 1 if last is not None and last[:2] == [id, day] else 1
        last = [id, day, number, lat, lon, 1, ts, ts]
        found.append(last)
    return sorted(tuple(r) for r in found)


def collected_runs(df: DataFrame) -> list[tuple]:
    return sorted(
        tuple(r)
        for r in df.select(
            "id",
            "iso_date",
            "track_position_counter",
            "latitude",
            "longitude",
            "tot_evts",
            "start_position_time",
            "end_position_time",
        ).collect()
    )
