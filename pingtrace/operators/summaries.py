"""Counts by day and coordinate, and a two-dimensional histogram."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pingtrace.functions.bins import bin_index, bin_start
from pingtrace.functions.geo import haversine_m, number

BINS = 10
# Longest run of copies made by one row before the copies are dealt out.
REPEAT_CHUNK = 10_000


def day_counts(pings: DataFrame) -> DataFrame:
    """(iso_date, n): pings per day."""
    return pings.groupBy("iso_date").agg(F.count("*").alias("n"))


def with_distance_from(pings: DataFrame, latitude: float, longitude: float) -> DataFrame:
    """Add each ping's distance in metres from a point."""
    here = haversine_m(number(latitude), number(longitude), "latitude", "longitude")
    return pings.selectExpr("*", f"{here} AS distance")


def geo_event_totals(stays: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Pings per coordinate, (latitude, longitude, tot_evts), from stays.

    `by` names columns to keep apart, such as the day.
    """
    placed = stays.na.drop(subset=["latitude", "longitude"])
    return placed.groupBy(*by, "latitude", "longitude").agg(F.sum("tot_evts").alias("tot_evts"))


def ping_totals(pings: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """`geo_event_totals` of the stays of these pings, without building the stays.

    The ping counts of the stays at a coordinate add up to its pings.
    """
    placed = pings.na.drop(subset=["latitude", "longitude"])
    return placed.groupBy(*by, "latitude", "longitude").agg(F.count("*").alias("tot_evts"))


_EXTENT = {
    "lat_low": "min(latitude)",
    "lat_high": "max(latitude)",
    "lon_low": "min(longitude)",
    "lon_high": "max(longitude)",
}


def _extent(totals: DataFrame) -> DataFrame:
    """One row with the extent of the coordinates.

    All columns of `totals` take part, so that this and the bins are worked out from one and
    the same shuffle of it: Spark reuses an exchange only for equal plans below.
    """
    bounds = [F.expr(f"{value} AS {name}") for name, value in _EXTENT.items()]
    return totals.agg(*bounds, F.expr("sum(tot_evts) AS all_events")).where("all_events IS NOT NULL")


def _binned(totals: DataFrame, extent: DataFrame, bins: int) -> DataFrame:
    # An aggregate without keys: exactly one row.
    return totals.crossJoin(F.broadcast(extent)).selectExpr(
        "*",
        f"{bin_index('latitude', 'lat_low', 'lat_high', bins)} AS lat_bin",
        f"{bin_index('longitude', 'lon_low', 'lon_high', bins)} AS lon_bin",
    )


def _edges(bins: int) -> list[str]:
    return [
        f"{bin_start('lat_bin', 'lat_low', 'lat_high', bins)} AS lat_edge",
        f"{bin_start('lon_bin', 'lon_low', 'lon_high', bins)} AS lon_edge",
    ]


def bin_edges(totals: DataFrame, bins: int = BINS) -> DataFrame:
    """Add the equal-width bin of each latitude and longitude, and the bin's left edge."""
    binned = _binned(totals, _extent(totals), bins)
    return binned.selectExpr(*totals.columns, "lat_bin", "lon_bin", *_edges(bins))


def grid_histogram(totals: DataFrame, bins: int = BINS) -> DataFrame:
    """Events per cell of a `bins` by `bins` grid over the extent of the coordinates.

    Cells without events are in the result with 0. What `totals` is made of is read once.
    """
    extent = _extent(totals)
    # At most bins * bins rows, as the grid has.
    filled = _binned(totals, extent, bins).groupBy("lat_bin", "lon_bin").agg(F.expr("sum(tot_evts) AS n_events"))
    every_bin = f"explode(sequence(0, {bins - 1}))"
    cells = extent.selectExpr("*", f"{every_bin} AS lat_bin").selectExpr("*", f"{every_bin} AS lon_bin")
    return cells.join(F.broadcast(filled), ["lat_bin", "lon_bin"], "left").selectExpr(
        "lat_bin", "lon_bin", *_edges(bins), "coalesce(n_events, 0L) AS n_events"
    )


def repeat_by_count(totals: DataFrame, count: str = "tot_evts", tasks: int | None = None) -> DataFrame:
    """Each row as many times as its count says; rows without a positive count go.

    A row is first cut into chunks, which are dealt out to `tasks` tasks (the
    session's shuffle partitions by default) before they are spread out, so that
    a coordinate with a great part of all events is not written by one task.
    """
    if tasks is None:
        tasks = int(totals.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunks = f"explode(sequence(0L, floor(({count} - 1) / {REPEAT_CHUNK}))) AS chunk"
    copies = f"explode(sequence(1L, least({count} - chunk * {REPEAT_CHUNK}, {REPEAT_CHUNK}L))) AS copy"
    return (
        totals.where(f"{count} > 0")
        .selectExpr("*", chunks)
        .repartition(tasks, *totals.columns, "chunk")
        .selectExpr("* EXCEPT (chunk)", copies)
        .drop("copy")
    )
