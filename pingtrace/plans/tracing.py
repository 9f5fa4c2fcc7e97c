"""Contact tracing over whole ping tables: exposure of a cohort, and its spread by day."""

from __future__ import annotations

import datetime
import math
from collections.abc import Callable

from pyspark.sql import DataFrame, DataFrameReader
from pyspark.sql import functions as F

from pingtrace.functions.geo import CellGrid, near_cube, number
from pingtrace.functions.times import whole_seconds
from pingtrace.operators.contacts import (
    BLOCK_ROWS,
    EXPOSURE_DISTANCE_M,
    SHARED_SECONDS,
    close_contacts,
    contact_edges,
    near_pairs,
    with_length,
)
from pingtrace.operators.exposure import EXPOSURE_MINUTES, exposed_session, exposed_total
from pingtrace.operators.stays import cohort_stays, stays
from pingtrace.operators.summaries import ping_totals
from pingtrace.sources.pings import near_boxes
from pingtrace.sources.staging import broadcast_if_small, folder_exists, new_folder, staged

# Stays of a day from which people who were at one place with others are settled first, without pairs.
LARGE_DAY = 40_000
# Spans to look for people reached nearby, in parts of the least exposure, with the most copies of a stay.
SPAN_STEPS = 4
SPAN_SECONDS = 1_800
MOST_SPANS = 400
# Stays of a day whose copies to all cells in reach may be broadcast.
SMALL_DAY = 10_000
REACHED_SCHEMA = "id string, first_day int, hop int"
# People reached, handed on from one of their days to the next: `since` is the day of the hand-over.
_HANDED_ON = "id string, hop int, first_day int, since int"


def lasting_stays_by_day(pings: DataFrame) -> DataFrame:
    """Stays of at least one second, written out by day for reading day by day."""
    return staged(with_length(stays(pings)), "stays-by-day", partition_by=("iso_date",))


def all_contact_edges(
    pings: DataFrame, metres: float = EXPOSURE_DISTANCE_M, min_minutes: float = 0.0
) -> DataFrame:
    """Everyone's time together per day, from pings."""
    return contact_edges(staged(with_length(stays(pings)), "stays"), metres, min_minutes)


def cohort_contacts(
    pings: DataFrame, cohort: DataFrame, overlapping: bool = True, most_boxes: int | None = None
) -> DataFrame:
    """Close contacts of a cohort with everyone else, from pings.

    The cohort's stays come first; of the others only person-days with a ping in
    a grid cell within reach of these are shuffled into stays, whole, so that
    their stays keep their numbers.

    On a table written by place (`write_pings_by_place`) `most_boxes` lets the search for
    these person-days pass over files without pings near the cohort: by about as
    many boxes around its stays, from two small jobs.
    """
    members = staged(cohort.select("id").distinct(), "cohort")
    mine = cohort_stays(pings, members)
    mine = staged(with_length(mine) if overlapping else mine, "cohort-stays")
    grid = CellGrid(EXPOSURE_DISTANCE_M)
    reach = grid.with_reached_cells(mine, "latitude", "longitude").select("iso_date", "cy", "cx").distinct()
    reach = staged(reach, "cohort-cells")
    searched = pings if most_boxes is None else pings.where(near_boxes(mine, EXPOSURE_DISTANCE_M, most_boxes))
    homes = grid.with_home_cell(searched.select("id", "iso_date", "latitude", "longitude"), "latitude", "longitude")
    near = homes.join(broadcast_if_small(reach), ["iso_date", "cy", "cx"], "left_semi")
    near = staged(near.select("id", "iso_date").distinct(), "near-person-days")
    others = stays(pings.join(broadcast_if_small(near), ["id", "iso_date"], "left_semi"))
    others = staged(with_length(others) if overlapping else others, "near-stays")
    return close_contacts(mine, others, members, together=overlapping)


def cohort_exposure(
    pings: DataFrame,
    cohort: DataFrame,
    min_minutes: float = EXPOSURE_MINUTES,
    continuous: bool = False,
    literal: bool = False,
    most_boxes: int | None = None,
) -> DataFrame:
    """People exposed to the cohort: (iso_date, id, total_exposure_seconds) per contact.

    `continuous` asks for one unbroken session of that length.
    """
    contacts = cohort_contacts(pings, cohort, most_boxes=most_boxes)
    if continuous:
        return exposed_session(contacts, min_minutes, literal)
    return exposed_total(contacts, min_minutes)


def exposure_cascade(
    stays: DataFrame,
    seeds: DataFrame,
    start: datetime.date,
    days: int | None = None,
    min_minutes: float = EXPOSURE_MINUTES,
    metres: float = EXPOSURE_DISTANCE_M,
    block_rows: int = BLOCK_ROWS,
    large_day: int = LARGE_DAY,
) -> DataFrame:
    """Who is reached from the seeds by exposures in time order: (id, first_day, hop).

    Seeds are reached on day 0, which is `start`. On each later day everyone
    joins who spends at least `min_minutes` near one person reached on an earlier
    day; `hop` is the smallest number of such steps among their contacts of that
    first day. `days` ends the search after that many days.

    `stays` should be a table, best by day (`lasting_stays_by_day`): every day
    reads its own part. A day gets from earlier ones only the people reached who
    are there on it, and hands them and its newcomers on to the next day on which each
    of them has a stay; nobody is looked at on days without them. Only reached people are
    compared, with the others. Each day writes once, so a lost executor costs at
    most the work of one day.
    """
    min_seconds = min_minutes * 60
    # As many rows as there are days.
    later = stays.where(f"iso_date > date '{start}'")
    sizes = {row["iso_date"]: row["count"] for row in later.groupBy("iso_date").count().collect()}

    def newcomers(date: datetime.date, state: DataFrame) -> DataFrame:
        present = with_length(stays.where(f"iso_date = date '{date}'"))
        marked = present.join(state.select("id", "hop"), "id", "left")
        crowds, small, large = sizes[date] > block_rows, sizes[date] <= SMALL_DAY, sizes[date] > large_day
        if large:
            marked, plain, others = _unsettled(marked, min_seconds, metres)
        else:
            # Used on both sides, so a large marked day is written once.
            marked = staged(marked, "cascade-day") if crowds else marked
            others = marked.where("hop IS NULL")
        pairs = near_pairs(
            marked.where("hop IS NOT NULL"),
            others,
            metres,
            overlapping=True,
            condition="(b_hop IS NULL OR a_hop + 1 < b_hop)",
            block_rows=block_rows if crowds else None,
            left_columns=("hop",),
            small_left=small,
            right_columns=("hop",),
            tasks=int(stays.sparkSession.conf.get("spark.sql.shuffle.partitions")) if crowds and not small else None,
        )
        exposed = (
            pairs.groupBy("iso_date", "a_id", "a_hop", "b_id")
            .agg(F.expr(f"sum({SHARED_SECONDS}) AS seconds"))
            .where(f"seconds >= {number(min_seconds)}")
            .selectExpr("iso_date", "b_id AS id", "a_hop + 1 AS hop")
        )
        exposed = exposed.unionByName(plain) if large else exposed
        return exposed.groupBy("iso_date", "id").agg(F.expr("min(hop) AS hop"))

    return _day_by_day(seeds, start, sorted(sizes), days, with_length(later), newcomers)


def _unsettled(marked: DataFrame, min_seconds: float, metres: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of a day's stays, with the `hop` of people reached: all, `_plain_exposures`, and the stays of the others still to compare.

    Everything is staged. The others come with the hop found, if any. Not compared are those
    found at the lowest hop that there can be, and those who do not have the time: shared
    time adds up to at most one's own, if no reached person is at two places at once.
    """
    start, end = whole_seconds("start_position_time"), whole_seconds("end_position_time")
    timed = marked.selectExpr(
        "*",
        f"sum({end} - {start}) OVER (PARTITION BY iso_date, id) AS own_seconds",
        f"lag({end}) OVER (PARTITION BY iso_date, id ORDER BY {start}, {end}) > {start} AS twice",
    )
    marked = staged(timed, "cascade-day")
    plain = staged(_plain_exposures(marked, min_seconds, metres), "cascade-plain")
    day = marked.where("hop IS NOT NULL").selectExpr("min(hop) AS lowest", "coalesce(bool_or(twice), false) AS twice").first()
    others = marked.where("hop IS NULL").drop("hop").join(plain.select("id", "hop"), "id", "left")
    others = others.where(f"hop IS NULL OR hop > {(day['lowest'] or 0) + 1}")
    if not day["twice"]:
        others = others.where(f"own_seconds >= {number(min_seconds)}")
    return marked, plain, staged(others, "cascade-others")


def _plain_exposures(marked: DataFrame, min_seconds: float, metres: float) -> DataFrame:
    """(iso_date, id, hop) of people who need no comparison of pairs to be found exposed.

    Two who stay in one cube (`near_cube`) through one whole span of `min_seconds` are exposed to
    each other, so the lowest hop of each cube and span tells for all who are there. That grows
    with the stays. The hop is one of those possible, not always the lowest, and exposures in parts,
    across cubes or between spans are not found here.
    """
    span = max(math.ceil(min_seconds), SPAN_SECONDS)
    step = span // SPAN_STEPS
    start, end = whole_seconds("start_position_time"), whole_seconds("end_position_time")
    first, last = f"ceil({start} / {step})", f"floor(({end} - {span}) / {step})"
    spans = f"explode(sequence({first}, least({last}, {first} + {MOST_SPANS - 1}))) AS span"
    there = marked.where(f"{first} <= {last}").selectExpr(
        "iso_date", "id", "hop", *near_cube("latitude", "longitude", metres), spans
    )
    place = ["iso_date", "kx", "ky", "kz", "span"]
    lowest = there.where("hop IS NOT NULL").groupBy(*place).agg(F.expr("min(hop) + 1 AS hop"))
    met = there.where("hop IS NULL").drop("hop").join(lowest, place)
    return met.groupBy("iso_date", "id").agg(F.expr("min(hop) AS hop"))


def cascade_over_edges(
    edges: DataFrame,
    seeds: DataFrame,
    start: datetime.date,
    days: int | None = None,
    min_minutes: float = EXPOSURE_MINUTES,
) -> DataFrame:
    """`exposure_cascade` along a given table of daily contact edges.

    For many seed sets over the same days, where the edges of all people are
    worth building once. Keep the edges partitioned by day (`edges_by_day`).
    """
    enough = f"round(total_exposure_time * 60) >= {number(min_minutes * 60)}"
    later = edges.where(f"iso_date > date '{start}' AND {enough}")
    dates = sorted(row["iso_date"] for row in later.select("iso_date").distinct().collect())

    def newcomers(date: datetime.date, state: DataFrame) -> DataFrame:
        return (
            later.where(f"iso_date = date '{date}'")
            .selectExpr("iso_date", "i1 AS source", "i2 AS id")
            .join(state.selectExpr("id AS source", "hop"), "source")
            .groupBy("iso_date", "id")
            .agg(F.expr("min(hop) + 1 AS hop"))
            .join(state.select("id"), "id", "left_anti")
        )

    return _day_by_day(seeds, start, dates, days, later.selectExpr("i1 AS id", "iso_date"), newcomers)


def edges_by_day(edges: DataFrame) -> DataFrame:
    """Edges that go both ways alike, as `contact_edges` gives them, written out by day for reading day by day.

    One way of each is written, and both are read.
    """
    one_way = staged(edges.where("i1 < i2"), "edges-by-day", ("iso_date",))
    ways = "inline(array(struct(i1, i2), struct(i2 AS i1, i1 AS i2)))"
    return one_way.selectExpr("iso_date", ways, "total_exposure_time")


def following_days(present: DataFrame) -> DataFrame:
    """(id, iso_date, next_day): each day of a person and the person's next one, staged by day.

    A person has at most one row per day here, however busy.
    """
    in_order = "lead(iso_date) OVER (PARTITION BY id ORDER BY iso_date) AS next_day"
    days = present.select("id", "iso_date").distinct().selectExpr("id", in_order, "iso_date")
    return staged(days, "following-days", ("iso_date",))


def _day_by_day(
    seeds: DataFrame,
    start: datetime.date,
    dates: list[datetime.date],
    days: int | None,
    present: DataFrame,
    newcomers: Callable[[datetime.date, DataFrame], DataFrame],
) -> DataFrame:
    """Add each date's newcomers to the people reached before.

    `present` has (id, iso_date) of whoever can take part on a date, and
    `newcomers(date, state)` finds (iso_date, id, hop) outside the state, which are the reached
    people of that date. Each date's state lies in a folder of its own. Days are taken from
    the data, not written into the expressions, so that Spark compiles them once for all dates.
    """
    spark = seeds.sparkSession
    folder = new_folder(spark, "cascade")
    calendar = following_days(present)

    def table() -> DataFrameReader:
        return spark.read.schema(f"{_HANDED_ON}, next_day date")

    def hand_on(people: DataFrame) -> None:
        people.write.mode("append").partitionBy("next_day").parquet(folder)

    first = calendar.groupBy("id").agg(F.min("iso_date").alias("next_day"))
    known = seeds.where("id IS NOT NULL").select("id").distinct()
    hand_on(known.join(first, "id", "left").selectExpr("id", "0 AS hop", "0 AS first_day", "0 AS since", "next_day"))
    for date in dates:
        day = (date - start).days
        if days is not None and day >= days:
            break
        here = f"{folder}/next_day={date}"
        if not folder_exists(spark, here):
            continue
        state = table().option("basePath", folder).parquet(here)
        on = f"datediff(iso_date, date '{start}')"
        found = newcomers(date, state).selectExpr("id", "hop", f"{on} AS first_day", f"{on} AS since")
        people = state.selectExpr("id", "hop", "first_day", f"datediff(next_day, date '{start}') AS since").unionAll(found)
        follow = calendar.where(f"iso_date = date '{date}'").select("id", "next_day")
        hand_on(people.join(follow, "id", "left"))
    # Everyone stands once with the day of joining; the other rows hand them on.
    return table().parquet(folder).where("since = first_day").select("id", "first_day", "hop")


def daily_reach(reached: DataFrame, last_day: int) -> DataFrame:
    """(day, total_infected): people reached up to each day from 0 to `last_day`."""
    newcomers = reached.groupBy(F.expr("first_day AS day")).agg(F.expr("count(DISTINCT id) AS n"))
    calendar = reached.sparkSession.range(0, last_day + 1).selectExpr("cast(id AS int) AS day")
    # One row per day from here on.
    return calendar.join(newcomers, "day", "left").selectExpr(
        "day", "sum(coalesce(n, 0L)) OVER (ORDER BY day) AS total_infected"
    )


def cohort_geo_totals(
    pings: DataFrame, reached: DataFrame, start: datetime.date, by_day: bool = False
) -> DataFrame:
    """Pings per coordinate of the cohort as it stood before each day's newcomers.

    On day 0 the cohort is the seeds; on a later day, everyone reached earlier.
    With `by_day` the totals are kept apart by `day`.
    """
    members = (
        pings.where(f"iso_date >= date '{start}'")
        .selectExpr("id", "latitude", "longitude", f"datediff(iso_date, date '{start}') AS day")
        .join(reached.select("id", "first_day"), "id")
        .where("day > first_day OR (day = 0 AND first_day = 0)")
    )
    return ping_totals(members, by=("day",) if by_day else ())
