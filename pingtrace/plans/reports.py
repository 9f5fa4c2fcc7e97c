"""Several reports on one cascade."""

from __future__ import annotations

import datetime
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pingtrace.plans.tracing import cohort_geo_totals, daily_reach, exposure_cascade, lasting_stays_by_day
from pingtrace.sources.staging import StageScope, staged


class CascadeReports(StageScope):
    """The cascade from `seeds` and the tables made of it, each worked out once, when first asked for.

    Used as a context manager: what it staged is deleted at the end, so write the
    reports before.

        with CascadeReports(pings, seeds, start) as reports:
            write_daily_counts(reports.daily_reach(), daily_path)
            write_geo_totals(reports.geo_totals(), totals_path)

    Days run from `start`; the last is `days - 1` days later, or that of the last ping.
    """

    def __init__(self, pings: DataFrame, seeds: DataFrame, start: datetime.date, days: int | None = None):
        super().__init__(pings.sparkSession)
        within = pings.where(f"iso_date >= date '{start}'")
        if days is not None:
            within = within.where(f"iso_date <= date '{start + datetime.timedelta(days=days - 1)}'")
        self._pings, self._seeds, self.start, self._days = within, seeds, start, days

    def _open(self) -> CascadeReports:
        if not self.is_open:
            raise RuntimeError("ask for reports within the `with` block that they belong to")
        return self

    @cached_property
    def last_day(self) -> int:
        if self._days is not None:
            return self._days - 1
        last = self._pings.agg(F.max("iso_date")).first()[0]
        return 0 if last is None else (last - self.start).days

    @cached_property
    def reached(self) -> DataFrame:
        """(id, first_day, hop)"""
        with self._open():
            stays = lasting_stays_by_day(self._pings)
            return exposure_cascade(stays, staged(self._seeds, "seeds"), self.start, self._days)

    @cached_property
    def _geo_by_day(self) -> DataFrame:
        with self._open():
            return staged(cohort_geo_totals(self._pings, self.reached, self.start, by_day=True), "geo-by-day")

    def daily_reach(self) -> DataFrame:
        """(day, total_infected)"""
        return daily_reach(self.reached, self.last_day)

    def geo_totals(self, by_day: bool = False) -> DataFrame:
        """(latitude, longitude, tot_evts), or the same by `day`."""
        if by_day:
            return self._geo_by_day
        return self._geo_by_day.groupBy("latitude", "longitude").agg(F.sum("tot_evts").alias("tot_evts"))
