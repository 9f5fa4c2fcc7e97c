"""The whole job: from a ping table to the two result tables."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession

from pingtrace.operators.sampling import balanced_sample, unit_points
from pingtrace.plans.tracing import (
    cohort_geo_totals,
    daily_reach,
    exposure_cascade,
    lasting_stays_by_day,
)
from pingtrace.sources.pings import day_slice, read_pings
from pingtrace.sources.results import all_or_nothing, write_daily_counts, write_geo_totals
from pingtrace.sources.staging import StageScope, staged


def spread(
    pings: DataFrame, start: datetime.date, days: int = 15, people: int = 100, first_point: int = 1
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Start from people spread over the first day's area and follow exposures for `days` days.

    Gives the people reached (id, first_day, hop), their number by day
    (day, total_infected) and the cohort's pings per coordinate
    (latitude, longitude, tot_evts).
    """
    last = start + datetime.timedelta(days=days - 1)
    within = pings.where(f"iso_date BETWEEN date '{start}' AND date '{last}'")
    points = unit_points(pings.sparkSession, people, first_point)
    seeds = staged(balanced_sample(day_slice(pings, start), points), "seeds")
    reached = exposure_cascade(lasting_stays_by_day(within), seeds, start, days)
    return reached, daily_reach(reached, days - 1), cohort_geo_totals(within, reached, start)


def run(
    spark: SparkSession,
    ping_path: str,
    result_path: str,
    start: datetime.date,
    days: int = 15,
    people: int = 100,
    mode: str = "error",
    **columns: str | None,
) -> None:
    """Read a ping table and write `daily_infected.csv` and `daily_geoloc_evts.csv` folders.

    Both appear under `result_path` together or not at all, and the tables staged on the
    way are deleted. Further keywords name the columns of the ping table, as in
    `normalise_pings`.
    """
    last = start + datetime.timedelta(days=days - 1)
    pings = read_pings(spark, ping_path, days=(str(start), str(last)), **columns)
    with StageScope(spark), all_or_nothing(spark, result_path, mode) as folder:
        _, daily, totals = spread(pings, start, days, people)
        write_daily_counts(daily, f"{folder}/daily_infected.csv")
        write_geo_totals(totals, f"{folder}/daily_geoloc_evts.csv")
