"""From pings to stays: runs of unchanged position of one person on one day."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pingtrace.functions.times import micros
from pingtrace.operators.cohorts import keep_ids
from pingtrace.sources.staging import broadcast_if_small, staged

PERSON_DAY = ["id", "iso_date"]
STAY_COLUMNS = [
    "track_position_counter",
    "id",
    "latitude",
    "longitude",
    "start_position_time",
    "tot_evts",
    "end_position_time",
    "iso_date",
]

# A person-day with more pings than this is worked on by several tasks.
SPLIT_ABOVE = 5_000_000
# Sampled pings by which a person-day of that size is known.
PROBE_PINGS = 1_000


def stays(pings: DataFrame, split_above: int | None = SPLIT_ABOVE) -> DataFrame:
    """Compress pings into numbered stays.

    A stay starts at a person's first ping of a day and at every ping whose
    position differs from the one before it; `track_position_counter` numbers
    the stays of a person-day from 1. Pings at the same time are taken in order
    of their position.

    One shuffle by person and day, one sort. Person-days of about `split_above`
    pings or more, found by a sample of the rows, are taken apart from the others
    and cut into time slices that are worked on separately and then joined up;
    None leaves out the sample. The result does not depend on it. Pings without
    time come first, ordered by their position.
    """
    if split_above is not None:
        busy = _busy_person_days(pings, split_above, "ts")
        if busy is not None:
            others = pings.join(busy, PERSON_DAY, "left_anti")
            return _plain_stays(others).unionByName(_stays_of_slices(pings, busy))
    return _plain_stays(pings)


def cohort_stays(pings: DataFrame, cohort: DataFrame, split_above: int | None = SPLIT_ABOVE) -> DataFrame:
    """Stays of the people in `cohort`; the others' pings are not shuffled."""
    return stays(keep_ids(pings, cohort), split_above)


def stay_sequence(stays: DataFrame, split_above: int | None = SPLIT_ABOVE) -> DataFrame:
    """Number stays per person-day by start time, for stays that come without numbers.

    Person-days with more than `split_above` stays are numbered slice by slice of
    their time, each from the number of stays in the slices before it.
    """
    stays = stays.drop("track_position_counter")
    busy = None if split_above is None else _busy_person_days(stays, split_above, "start_position_time")
    if busy is None:
        return _numbered(stays, PERSON_DAY, "0")
    others = _numbered(stays.join(busy, PERSON_DAY, "left_anti"), PERSON_DAY, "0")
    sliced = stays.join(busy, PERSON_DAY).selectExpr(
        *[c for c in STAY_COLUMNS if c != "track_position_counter"],
        f"{_slice_of('start_position_time')} AS slice",
    )
    in_order = "(PARTITION BY id, iso_date ORDER BY slice)"
    starts = (
        sliced.groupBy(*PERSON_DAY, "slice")
        .agg(F.expr("count(*) AS n"))
        .selectExpr(*PERSON_DAY, "slice", f"sum(n) OVER {in_order} - n AS before")
    )
    parts = sliced.join(starts, [*PERSON_DAY, "slice"])
    return others.unionByName(_numbered(parts, [*PERSON_DAY, "slice"], "before"))


def _numbered(stays: DataFrame, group: list[str], before: str) -> DataFrame:
    by_start = f"(PARTITION BY {', '.join(group)} ORDER BY start_position_time, latitude, longitude)"
    number = f"cast({before} + row_number() OVER {by_start} AS int) AS track_position_counter"
    return stays.selectExpr("*", number).select(*STAY_COLUMNS)


def _plain_stays(pings: DataFrame) -> DataFrame:
    weighted = _one_zero(pings).selectExpr("*", "1L AS n")
    return _runs(weighted, PERSON_DAY).select(*STAY_COLUMNS)


def _one_zero(pings: DataFrame) -> DataFrame:
    """The columns of stays, with -0.0 as 0.0: equal places must also sort as equal."""
    return pings.selectExpr("id", "iso_date", "latitude + 0D AS latitude", "longitude + 0D AS longitude", "ts")


def _runs(pings: DataFrame, group: list[str]) -> DataFrame:
    """Runs of equal position within each group of weighted pings (`n` copies each)."""
    in_time = f"(PARTITION BY {', '.join(group)} ORDER BY ts, latitude, longitude"
    # The first of a group has moved, also where it has no position.
    unmoved = (
        f"lag(n) OVER {in_time}) IS NOT NULL AND "
        f"lag(latitude) OVER {in_time}) <=> latitude AND lag(longitude) OVER {in_time}) <=> longitude"
    )
    so_far = f"{in_time} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    numbered = pings.selectExpr("*", f"if({unmoved}, 0, 1) AS moved").selectExpr(
        "*", f"cast(sum(moved) OVER {so_far} AS int) AS track_position_counter"
    )
    return _collapse(numbered, group, "ts", "ts", "n")


def _collapse(rows: DataFrame, group: list[str], start: str, end: str, n: str) -> DataFrame:
    return rows.groupBy(*group, "track_position_counter", "latitude", "longitude").agg(
        F.expr(f"min({start}) AS start_position_time"),
        F.expr(f"sum({n}) AS tot_evts"),
        F.expr(f"max({end}) AS end_position_time"),
    )


def _busy_person_days(rows: DataFrame, split_above: int, time: str) -> DataFrame | None:
    """Person-days near or above the limit, with their time span and number of slices; None if none.

    A sample tells which; rows without person or day stay with the others. Written
    out, since several parts of a plan must read the same spans.
    """
    share = min(1.0, PROBE_PINGS / split_above)
    probe = rows.select(*PERSON_DAY).na.drop()
    probe = probe.sample(share, seed=1) if share < 1 else probe
    counts = probe.groupBy(*PERSON_DAY).agg(F.expr("count(*) AS n")).where(f"n > {split_above * share}")
    if counts.isEmpty():
        return None
    counts = staged(counts, "busy-probe")
    spans = (
        rows.join(broadcast_if_small(counts), PERSON_DAY)
        .groupBy(*PERSON_DAY)
        .agg(
            F.expr(f"min({micros(time)}) AS first"),
            F.expr(f"max({micros(time)}) AS last"),
            F.expr(f"ceil(count(*) * 4 / {split_above}) AS slices"),
        )
    )
    return broadcast_if_small(staged(spans, "busy"))


def _slice_of(time: str) -> str:
    """Slice number from 0; rows without time are a slice of their own before it, as they sort first."""
    return f"coalesce(floor(({micros(time)} - first) * slices / (last - first + 1)), -1L)"


def _stays_of_slices(pings: DataFrame, busy: DataFrame) -> DataFrame:
    """`stays` of the busy person-days, cut into slices of time.

    Copies of a ping are counted before the shuffle. The runs of each slice are
    found alone; then one row per slice (its number of runs, first and last
    position) tells how the numbering goes on and whether a run crosses the cut.
    """
    sliced = (
        _one_zero(pings)
        .join(busy, PERSON_DAY)
        .groupBy(*PERSON_DAY, "latitude", "longitude", "ts", F.expr(f"{_slice_of('ts')} AS slice"))
        .agg(F.expr("count(*) AS n"))
    )
    runs = _runs(sliced, [*PERSON_DAY, "slice"])

    place = "struct(latitude, longitude)"
    ends = runs.groupBy(*PERSON_DAY, "slice").agg(
        F.expr("max(track_position_counter) AS runs"),
        F.expr(f"min_by({place}, track_position_counter) AS head"),
        F.expr(f"max_by({place}, track_position_counter) AS tail"),
    )
    in_order = "(PARTITION BY id, iso_date ORDER BY slice)"
    starts = ends.selectExpr(
        "*", f"cast(lag(runs) OVER {in_order} IS NOT NULL AND lag(tail) OVER {in_order} <=> head AS int) AS goes_on"
    ).selectExpr(*PERSON_DAY, "slice", f"sum(runs - goes_on) OVER {in_order} - runs AS before")
    renumbered = runs.join(starts, [*PERSON_DAY, "slice"]).withColumn(
        "track_position_counter", F.expr("cast(track_position_counter + before AS int)")
    )
    whole = _collapse(renumbered, PERSON_DAY, "start_position_time", "end_position_time", "tot_evts")
    return whole.select(*STAY_COLUMNS)
