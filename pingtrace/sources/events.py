"""A ping table and a case table derived from a table of user events.

Every user has a fixed place, metres from its neighbours', at each of several
sites; the type of an event says at which site it happened.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Site number of each event type; types not listed are at site 4.
DAILY_SITES = {"click": 0, "error": 1, "purchase": 2, "signup": 3}
# Two sites only, so that people stay longer in one place.
WEEKLY_SITES = {"click": 0, "error": 0, "view": 0}

INDEX_CASES_UNTIL = "2024-01-01 06:00:00"


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def _site(sites: dict[str, int], otherwise: int) -> Column:
    site = None
    for event_type, number in sites.items():
        here = F.col("event_type") == event_type
        site = F.when(here, F.lit(number)) if site is None else site.when(here, F.lit(number))
    return site.otherwise(F.lit(otherwise))


def _place(events: DataFrame, site: Column, day: Column) -> DataFrame:
    k = site
    return events.select(
        F.col("user_id").cast("string").alias("id"),
        (F.lit(40.0) + k * F.lit(0.01) + (F.col("user_id") % 20) * F.lit(0.00003)).alias("latitude"),
        (F.lit(-3.7) + k * F.lit(0.01) + (F.col("user_id") % 7) * F.lit(0.00003)).alias("longitude"),
        F.col("ts"),
        day.alias("iso_date"),
    )


def daily_pings(spark: SparkSession, sf_dir: str, day: str | None = None) -> DataFrame:
    """Pings at five sites, with calendar days. One `day` is filtered in the file scan."""
    events = read_events(spark, sf_dir)
    if day is not None:
        first = F.lit(day).cast("timestamp_ntz")
        events = events.where((F.col("ts") >= first) & (F.col("ts") < first + F.expr("INTERVAL 1 DAY")))
    return _place(events, _site(DAILY_SITES, 4), F.to_date("ts"))


def weekly_pings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pings at two sites, with the Monday of the week in place of the day."""
    week = F.to_date(F.date_trunc("week", F.col("ts")))
    return _place(read_events(spark, sf_dir), _site(WEEKLY_SITES, 1), week)


def index_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id) of the people who signed up in the first hours: the starting cohort."""
    early = (F.col("event_type") == "signup") & (F.col("ts") < F.lit(INDEX_CASES_UNTIL).cast("timestamp_ntz"))
    return read_events(spark, sf_dir).where(early).select(F.col("user_id").cast("string").alias("id")).distinct()


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, onset_date): each person's first sign-up as the day of onset."""
    signups = read_events(spark, sf_dir).where(F.col("event_type") == "signup")
    return signups.groupBy(F.col("user_id").cast("string").alias("id")).agg(
        F.min(F.to_date("ts")).alias("onset_date")
    )
