"""Reading, normalising, slicing and writing ping tables."""

from __future__ import annotations

import datetime
import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pingtrace.functions.geo import EARTH_RADIUS_M, number
from pingtrace.functions.hilbert import with_hilbert

PING_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("latitude", T.DoubleType()),
        T.StructField("longitude", T.DoubleType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("iso_date", T.DateType()),
    ]
)


def read_parquet(spark: SparkSession, base_path: str, *partitions: str) -> DataFrame:
    """Read a whole Parquet table, or only the given partition folders of it.

    The partition column stays in the result either way.
    """
    if partitions:
        return spark.read.option("basePath", base_path).parquet(*partitions)
    return spark.read.parquet(base_path)


def normalise_pings(
    df: DataFrame,
    id: str = "id",
    latitude: str = "latitude",
    longitude: str = "longitude",
    timestamp: str = "timestamp",
    day: str | None = "iso_date",
) -> DataFrame:
    """Bring any ping-like frame to (id, latitude, longitude, ts, iso_date).

    Times may be timestamps, with or without zone, numbers of seconds, or text;
    they become timestamps without zone, those with one as the session's clock
    shows them. What cannot be read as a time, day or number counts as missing.
    Rows without id, time, day or position are left out, for they can be placed
    nowhere, and so are positions that are not finite or beyond 90 degrees of
    latitude or 180 of longitude. Without a day column (`day=None`) the day is
    the date of the time.
    """
    kind = df.schema[timestamp].dataType
    ts = F.col(timestamp)
    if not isinstance(kind, (T.StringType, T.TimestampType, T.TimestampNTZType)):
        ts = ts.try_cast("timestamp")
    ts = ts.try_cast("timestamp_ntz")
    out = df.select(
        F.col(id).cast("string").alias("id"),
        F.col(latitude).try_cast("double").alias("latitude"),
        F.col(longitude).try_cast("double").alias("longitude"),
        ts.alias("ts"),
        (F.to_date(ts) if day is None else F.col(day).try_cast("date")).alias("iso_date"),
    )
    # NaN is above every number and fails this too.
    placed = F.col("latitude").between(-90, 90) & F.col("longitude").between(-180, 180)
    return out.na.drop(subset=["id", "latitude", "longitude", "ts", "iso_date"]).where(placed)


def _as_date(day: str | datetime.date) -> Column:
    return F.lit(str(day)).cast("date")


def day_slice(pings: DataFrame, day: str | datetime.date) -> DataFrame:
    """The pings of one day. On a table partitioned by day, only that folder is read."""
    return pings.where(F.col("iso_date") == _as_date(day))


def read_pings(
    spark: SparkSession,
    path: str,
    days: tuple[str, str] | None = None,
    partitions: Iterable[str] = (),
    **columns: str | None,
) -> DataFrame:
    """Read a ping table, optionally only some of its days.

    `days` is an inclusive (first, last) range, met by partition pruning from
    the table's root. `partitions` lists partition folders to read instead.
    Further keywords name columns, as in `normalise_pings`.
    """
    raw = read_parquet(spark, path, *partitions)
    pings = normalise_pings(raw, **columns)
    if days is not None:
        pings = pings.where(F.col("iso_date").between(_as_date(days[0]), _as_date(days[1])))
    return pings


def write_pings(pings: DataFrame, path: str, mode: str = "error") -> None:
    """Write pings as Parquet, one folder per day, without piling a day into one task."""
    pings.hint("rebalance", "iso_date").write.mode(mode).partitionBy("iso_date").parquet(path)


def write_pings_by_place(pings: DataFrame, path: str, mode: str = "error") -> None:
    """Write pings as Parquet, one folder per day, in the order of a Hilbert curve within each.

    Every file holds a compact area, and so does every page of it, so their statistics let
    readers who ask for an area (`near_boxes`) pass over the others. Pings at one place
    may be spread over several files: a place with a great part of a day's pings is not
    written by one task.
    """
    placed = with_hilbert(pings, "latitude", "longitude")
    spread = placed.repartitionByRange("iso_date", "hilbert", F.xxhash64("id", "ts"))
    laid = spread.sortWithinPartitions("iso_date", "hilbert").drop("hilbert")
    laid.write.mode(mode).partitionBy("iso_date").parquet(path)


def near_boxes(places: DataFrame, metres: float, most: int = 32) -> str:
    """A condition in SQL that holds for all positions within `metres` of `places`: up to some `most` boxes.

    It compares latitude and longitude with literals, so file readers can use it on their
    statistics. Boxes are those of the occupied tiles of a grid over the extent; a few
    numbers for each come to the driver.
    """
    extent = [
        F.min("latitude").alias("south"),
        F.max("latitude").alias("north"),
        F.min("longitude").alias("west"),
        F.max("longitude").alias("east"),
    ]
    whole = places.agg(*extent).first()
    if whole["south"] is None:
        return "false"
    side = max(1, math.isqrt(most))
    tall = max((whole["north"] - whole["south"]) / side, 1e-9)
    wide = max((whole["east"] - whole["west"]) / side, 1e-9)
    tile = [
        F.expr(f"least({side - 1}, floor((latitude - {number(whole['south'])}) / {number(tall)})) AS row"),
        F.expr(f"least({side - 1}, floor((longitude - {number(whole['west'])}) / {number(wide)})) AS col"),
    ]
    boxes = places.groupBy(*tile).agg(*extent).collect()
    reach = math.degrees(metres / EARTH_RADIUS_M) * (1 + 1e-6)
    tests = []
    for box in boxes:
        south, north = box["south"] - reach, box["north"] + reach
        within = f"latitude BETWEEN {number(south)} AND {number(north)}"
        # Towards a pole a degree of longitude shrinks; next to one all longitudes are near.
        steepest = max(abs(south), abs(north))
        if steepest < 89.9:
            across = math.degrees(math.asin(min(1.0, math.sin(math.radians(reach)) / math.cos(math.radians(steepest)))))
            west, east = box["west"] - across, box["east"] + across
            if west >= -180 and east <= 180:  # else it reaches across the 180 degree meridian
                within += f" AND longitude BETWEEN {number(west)} AND {number(east)}"
        tests.append(f"({within})")
    return " OR ".join(tests)
