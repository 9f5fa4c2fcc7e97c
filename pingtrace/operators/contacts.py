"""Pairs of stays that were near each other."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pingtrace.functions.geo import CellGrid, haversine_m, is_within, number, unit_vector
from pingtrace.functions.times import overlap_seconds, whole_seconds
from pingtrace.operators.cohorts import drop_ids
from pingtrace.sources.staging import broadcast_if_small, staged

EXPOSURE_DISTANCE_M = 10.0

# Rows of one side that meet in one task under one join key; more are split.
# Just under the number of rows of one key that a sort-merge join keeps as an array.
BLOCK_ROWS = 4_000
PROBE_FRACTION = 0.01
# Rows of one side in a cell from which all that its people share is worked out in one place.
MEETING_FROM = 200
# Rows of one side in a block there, and comparisons in a task, so that what a task finds fits its memory.
MEETING_ROWS = 2_000
MEETING_WORK = 4_000_000
# Stays of a person, next to each other in their numbers, that come there in one row.
RUN_STAYS = 64
# Columns that contacts of one pair and day have in common, with which they need no further shuffle.
TOGETHER = ["pair", "meeting"]
# Work of one more copy of a row, in comparisons of two times.
COPY_COST = 300
DAY_SECONDS = 86_400
# Crowded keys (some 60 bytes each) up to which their table is broadcast.
BROADCAST_KEYS = 1_000_000
MOST_TASKS = 50_000

_SIDE = [
    "id",
    "latitude",
    "longitude",
    "start_position_time",
    "end_position_time",
    "track_position_counter",
]
_DISTANCE = haversine_m("a_latitude", "a_longitude", "b_latitude", "b_longitude")
SHARED_SECONDS = "(least(a_end, b_end) - greatest(a_start, b_start))"
# Beyond any time in seconds; `least` and `greatest` pass over a time that is null.
_ALWAYS = "4000000000000000000L"


def with_length(stays: DataFrame) -> DataFrame:
    """Stays that last at least one whole second; the others overlap with nothing."""
    return stays.where(f"{whole_seconds('start_position_time')} < {whole_seconds('end_position_time')}")


def near_pairs(
    left: DataFrame,
    right: DataFrame,
    metres: float = EXPOSURE_DISTANCE_M,
    overlapping: bool = False,
    condition: str | None = None,
    block_rows: int | None = BLOCK_ROWS,
    probe_fraction: float = PROBE_FRACTION,
    left_columns: tuple[str, ...] = (),
    small_left: bool = False,
    right_columns: tuple[str, ...] = (),
    tasks: int | None = None,
) -> DataFrame:
    """All pairs of a `left` and a `right` stay of one day within `metres`.

    The result has the columns of both sides, prefixed `a_` and `b_`, with
    `iso_date` and `distance`. The join is an equi-join on day and grid cell:
    each right stay is in one cell, each left stay (take the smaller side) is
    copied to the few cells within reach, so no pair is met twice.

    With `overlapping`, only pairs that share at least one whole second are
    wanted.

    Cells that hold more than about `block_rows` rows of a side on a day are found
    from a sample of `probe_fraction` of both sides and joined on their own. If
    time matters, they are cut along time, so that stays at different hours do
    not meet. Where there are still more rows together, so that the pairs are
    wanted, they are split into blocks of `block_rows` by `block_rows`. The probe
    is a job over both inputs, so these should be tables or staged;
    `block_rows=None` leaves it out. The sample decides only who does the work,
    not what is found.

    `small_left` asks for a broadcast of the left side, copies included; the caller has
    counted it.

    `tasks` deals the cells that are not crowded out to so many tasks, for rows that are few
    bytes and much work, which would else be put together by their size.

    `condition` is a further test, in SQL, on the prefixed columns. Columns besides those
    of a stay come along when named in `left_columns` and `right_columns`.
    """
    grid = CellGrid(metres)
    a = grid.with_reached_cells(_side(left, "a_", left_columns), "a_latitude", "a_longitude")
    b = grid.with_home_cell(_side(right, "b_", right_columns), "b_latitude", "b_longitude")
    keys = ["iso_date", "cy", "cx"]
    tests = [f"{_DISTANCE} <= {number(metres)}"]
    if condition is not None:
        tests.insert(0, condition)
    if overlapping:
        tests.insert(0, f"{SHARED_SECONDS} > 0")

    def pairs(one: DataFrame, other: DataFrame, keys: list[str], tasks: int | None = tasks) -> DataFrame:
        if small_left:
            one = F.broadcast(one)
        elif tasks is not None:
            one, other = one.repartition(tasks, *keys).hint("merge"), other.repartition(tasks, *keys)
        found = one.join(other, keys).where(" AND ".join(tests))
        return found.selectExpr("iso_date", *own_columns, f"{_DISTANCE} AS distance")

    own_columns = [c for side in (a, b) for c in side.columns if c not in keys]
    crowded = None if block_rows is None else _crowded_keys(a, b, keys, block_rows, probe_fraction)
    if crowded is None:
        return pairs(a, b, keys)
    elsewhere = pairs(a.join(crowded, keys, "left_anti"), b.join(crowded, keys, "left_anti"), keys)
    a, b = a.join(crowded, keys), b.join(crowded, keys)
    if overlapping:
        a, b = _in_slots(a, "a_"), _in_slots(b, "b_")
        keys = [*keys, "slot", "comer"]
        crowded = _crowded_keys(a, b, keys, block_rows, probe_fraction)
        if crowded is None:
            return elsewhere.unionByName(pairs(a, b, keys))
        a, b = a.join(crowded, keys, "left"), b.join(crowded, keys, "left")
    a, b = _in_blocks(a, "a_", "b_"), _in_blocks(b, "b_", "a_")
    keys = [*keys, "a_block", "b_block"]
    # Few bytes, much work: partitions by number, not by size, and no broadcast.
    blocks = crowded.selectExpr("sum(a_blocks * b_blocks)").first()[0]
    least = int(crowded.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    many = max(least, min(blocks, MOST_TASKS))
    there = pairs(a.repartition(many, *keys).hint("merge"), b.repartition(many, *keys), keys, None)
    return elsewhere.unionByName(there)


def _side(stays: DataFrame, prefix: str, more: tuple[str, ...] = ()) -> DataFrame:
    return stays.selectExpr(
        "iso_date",
        *[f"{c} AS {prefix}{c}" for c in [*_SIDE, *more]],
        f"{whole_seconds('start_position_time')} AS {prefix}start",
        f"{whole_seconds('end_position_time')} AS {prefix}end",
    )


def near_pairs_together(
    left: DataFrame,
    right: DataFrame,
    metres: float = EXPOSURE_DISTANCE_M,
    condition: str | None = None,
    crowded_from: int | None = MEETING_FROM,
    block_rows: int = MEETING_ROWS,
    probe_fraction: float = PROBE_FRACTION,
) -> DataFrame:
    """`near_pairs` that share time, those of one pair of people and day in one task.

    The result has two columns more (TOGETHER), the same for all rows of a pair and day. Where
    many meet it is partitioned by `meeting`, so windows and totals that have both among
    their keys shuffle the stays, not the pairs, of which there are many more.

    Crowded cells are found from a sample. People who reach one come to it with all their
    stays of the day (a copy for every such cell), in blocks by id, and two people meet in
    the first crowded cell that both reach, with all that they share anywhere. There they are
    compared as people first, in rows of up to RUN_STAYS stays, and stay by stay only where they
    meet. People without one in common meet in the other cells, as in `near_pairs`.
    """
    grid = CellGrid(metres)
    one, other = _side(left, "a_"), _side(right, "b_")
    columns = ["iso_date", *[c for side in (one, other) for c in side.columns if c != "iso_date"]]
    a = grid.with_reached_cells(one, "a_latitude", "a_longitude")
    b = grid.with_home_cell(other, "b_latitude", "b_longitude")
    keys = ["iso_date", "cy", "cx"]
    tests = [f"{SHARED_SECONDS} > 0", *([] if condition is None else [condition]), f"{_DISTANCE} <= {number(metres)}"]
    columns.append(f"{_DISTANCE} AS distance")
    pair, by_pair = "xxhash64(a_id, b_id) AS pair", "xxhash64(iso_date, a_id, b_id) AS meeting"

    crowded = None
    if crowded_from is not None:
        crowded = _crowded_keys(a, b, keys, block_rows, probe_fraction, crowded_from)
    if crowded is None:
        return a.join(b, keys).where(" AND ".join(tests)).selectExpr(*columns, "0L AS pair", "0L AS meeting")

    def spots(side: DataFrame, name: str) -> DataFrame:
        met = side.join(crowded, keys).groupBy("iso_date", f"{name}_id")
        return staged(met.agg(F.expr(f"array_sort(collect_set(spot)) AS {name}_spots")), f"{name}-spots")

    a_spots, b_spots = spots(a, "a"), spots(b, "b")
    a = a.join(crowded, keys, "left_anti").join(a_spots, ["iso_date", "a_id"], "left")
    b = b.join(crowded, keys, "left_anti").join(b_spots, ["iso_date", "b_id"], "left")
    apart = ["NOT coalesce(arrays_overlap(a_spots, b_spots), false)"]
    elsewhere = a.join(b, keys).where(" AND ".join(tests + apart)).selectExpr(*columns, pair, by_pair)

    def at_spots(side: DataFrame, spots: DataFrame, own: str, far: str) -> DataFrame:
        person = ["iso_date", f"{own}_id"]
        stay = [c for c in side.columns if c not in person]
        vector = unit_vector(f"{own}_latitude", f"{own}_longitude", f"{own}_")
        runs = (
            side.join(spots, person)
            .selectExpr("*", *vector, f"floor({own}_track_position_counter / {RUN_STAYS}) AS run")
            .groupBy(*person, "run")
            .agg(
                F.expr(f"collect_list(struct({', '.join(stay)}, {own}_x, {own}_y, {own}_z)) AS {own}_stays"),
                F.expr(f"min(coalesce({own}_start, -{_ALWAYS})) AS {own}_from"),
                F.expr(f"max(coalesce({own}_end, {_ALWAYS})) AS {own}_to"),
                F.expr(f"first({own}_spots) AS {own}_spots"),
            )
        )
        there = runs.drop("run").selectExpr("*", f"explode({own}_spots) AS spot")
        there = there.join(crowded.drop(*keys), "spot").selectExpr(
            "* EXCEPT (a_blocks, b_blocks, slot_seconds, a_rows, b_rows)",
            f"pmod(xxhash64({own}_id), {own}_blocks) AS {own}_block",
            f"explode(sequence(0L, {far}_blocks - 1)) AS {far}_block",
        )
        place = ["spot", "a_block", "b_block"]
        more = [f"{c} AS {own}_at_{c}" for c in place]
        if own == "a":
            more.append("iso_date")
        else:
            more.append("slice(b_spots, 1, cast(array_position(b_spots, spot) AS int) - 1) AS b_before")
        return there.selectExpr(f"* EXCEPT (iso_date, {', '.join(place)})", *more, f"xxhash64({', '.join(place)}) AS meeting")

    # Not as keys of the join, which would then be shuffled by all of them.
    same = " | ".join(f"(a_at_{c} - b_at_{c})" for c in ("spot", "a_block", "b_block"))
    first = (
        "CASE size(b_before) WHEN 0 THEN true WHEN 1 THEN NOT array_contains(a_spots, b_before[0]) "
        "ELSE NOT arrays_overlap(a_spots, b_before) END"
    )
    work = crowded.selectExpr(
        "sum(a_blocks * b_blocks) AS blocks", f"sum(a_rows * b_rows) / {number(probe_fraction**2 * MEETING_WORK)} AS tasks"
    ).first()
    tasks = max(
        int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")),
        min(work["blocks"], int(work["tasks"]), MOST_TASKS),
    )
    a = at_spots(one, a_spots, "a", "b").repartition(tasks, "meeting").hint("merge")
    b = at_spots(other, b_spots, "b", "a").repartition(tasks, "meeting")
    # People first, then one's stays, then both: most that come together share no time, or are at another place.
    people = a.join(b, "meeting").where(f"({same}) = 0 AND a_from < b_to AND b_from < a_to AND {first}")
    shared = ["iso_date", "a_id", "b_id", pair, "meeting"]
    stays_of_a = people.selectExpr(*shared, "b_from", "b_to", "b_stays", "inline(a_stays)").where(
        "coalesce(a_start < b_to, true) AND coalesce(b_from < a_end, true)"
    )
    there = (
        stays_of_a.selectExpr("* EXCEPT (b_from, b_to, b_stays)", "inline(b_stays)")
        .where(" AND ".join([tests[0], is_within("a_", "b_", metres, _DISTANCE), *tests[1:-1]]))
        .selectExpr(*columns, "pair", "meeting")
    )
    return there.unionByName(elsewhere.repartition(tasks, "meeting"))


def _crowded_keys(
    a: DataFrame, b: DataFrame, keys: list[str], block_rows: int, fraction: float, crowded_from: int | None = None
) -> DataFrame | None:
    """Keys with more than `block_rows` rows on a side; None if there are none.

    With `crowded_from`, keys with more rows than that, numbered (`spot`) and with the sampled rows.

    With the number of blocks to cut each side into, and the width of time slots
    that keeps copies and comparisons in balance: with n rows of mean length m in
    a day, slots of w seconds make m / w copies of a row, each new arrival is
    compared with some n * w / day rows too many. Written out once, since both
    sides must read the same numbers.
    """
    per_block = number(block_rows * fraction)
    rows = a.selectExpr(*keys, "1 AS of_a", "a_end - a_start AS length").unionAll(
        b.selectExpr(*keys, "0 AS of_a", "b_end - b_start AS length")
    )
    if fraction < 1:
        rows = rows.sample(fraction, seed=7)
    counts = rows.groupBy(*keys).agg(
        F.expr("sum(of_a) AS a_rows"),
        F.expr("sum(1 - of_a) AS b_rows"),
        F.expr("avg(length) AS length"),
    )
    width = f"sqrt({COPY_COST * DAY_SECONDS}D * length * {number(fraction)} / (a_rows + b_rows))"
    least, more = per_block, []
    if crowded_from is not None:
        least = number(crowded_from * fraction)
        more = ["monotonically_increasing_id() AS spot", "a_rows", "b_rows"]
    crowded = counts.where(f"greatest(a_rows, b_rows) > {least}").selectExpr(
        *keys,
        *more,
        *[f"greatest(1L, ceil({side}_rows / {per_block})) AS {side}_blocks" for side in "ab"],
        f"greatest(1L, cast({width} AS bigint)) AS slot_seconds",
    )
    table = staged(crowded, "crowded")
    return None if table.isEmpty() else broadcast_if_small(table, BROADCAST_KEYS)


def _in_slots(side: DataFrame, prefix: str) -> DataFrame:
    """Copy rows to the time slots in which they can meet others.

    An overlap begins when the later of two stays begins, so a pair meets in the
    slot of that beginning only: under `comer` 'a' when the left stay begins in
    the slot and the right one is there, under 'b' when the right one begins and
    the left one has been there from an earlier slot.
    """
    first, last = f"floor({prefix}start / slot_seconds)", f"floor({prefix}end / slot_seconds)"
    begins = f"array(struct({first} AS slot, '{prefix[0]}' AS comer))"
    other = "a" if prefix == "b_" else "b"
    since = first if prefix == "b_" else f"{first} + 1"
    there = (
        f"if({since} > {last}, array(), "
        f"transform(sequence({since}, {last}), s -> struct(s AS slot, '{other}' AS comer)))"
    )
    return side.selectExpr(
        "* EXCEPT (a_blocks, b_blocks, slot_seconds)", f"inline(concat({begins}, {there}))"
    )


def _in_blocks(side: DataFrame, own: str, other: str) -> DataFrame:
    """Give each row one block of its own side and a copy for each block of the other."""
    drawn = f"pmod(xxhash64({own}id, {own}track_position_counter), coalesce({own}blocks, 1L))"
    copies = f"explode(sequence(0L, coalesce({other}blocks, 1L) - 1))"
    return side.selectExpr(
        "* EXCEPT (a_blocks, b_blocks, slot_seconds)", f"{drawn} AS {own}block", f"{copies} AS {other}block"
    )


def _as_contacts(pairs: DataFrame, together: bool = False) -> DataFrame:
    def position(side: str) -> str:
        return f"struct({side}latitude AS latitude, {side}longitude AS longitude)"

    def time(side: str) -> str:
        start, end = f"{side}start_position_time", f"{side}end_position_time"
        return f"struct({start} AS start_position_time, {end} AS end_position_time)"

    shared = overlap_seconds(
        "a_start_position_time",
        "a_end_position_time",
        "b_start_position_time",
        "b_end_position_time",
        seconds=("a_start", "a_end", "b_start", "b_end"),
    )
    return pairs.selectExpr(
        "a_id AS i1",
        "b_id AS i2",
        f"{position('a_')} AS i1_position",
        "a_track_position_counter AS track_position_counter_i1",
        "b_track_position_counter AS track_position_counter_i2",
        f"{position('b_')} AS i2_position",
        "distance",
        f"{time('a_')} AS i1_time",
        f"{time('b_')} AS i2_time",
        f"{shared} / 60D AS exposure_time",
        "iso_date",
        *(TOGETHER if together else []),
    )


def close_contacts(
    cohort_stays: DataFrame,
    stays: DataFrame,
    cohort: DataFrame,
    metres: float = EXPOSURE_DISTANCE_M,
    overlapping: bool = False,
    block_rows: int | None = BLOCK_ROWS,
    probe_fraction: float = PROBE_FRACTION,
    together: bool = False,
) -> DataFrame:
    """Cohort stays (i1) against the stays of people outside the cohort (i2) on the same day.

    `exposure_time` is the shared time in minutes. Pairs that were at a place at
    different times are in the result with 0 minutes, unless `overlapping` asks
    only for those that share time, which is much less work. `together` does so too, and brings
    the contacts of each pair and day together, with the columns TOGETHER, for windows and totals.
    """
    others = drop_ids(stays, cohort)
    if together:
        cohort_stays, others = with_length(cohort_stays), with_length(others)
        return _as_contacts(near_pairs_together(cohort_stays, others, metres, "a_id != b_id"), together=True)
    if overlapping:
        cohort_stays, others = with_length(cohort_stays), with_length(others)
    pairs = near_pairs(
        cohort_stays, others, metres, overlapping, "a_id != b_id", block_rows, probe_fraction
    )
    return _as_contacts(pairs)


def contact_edges(
    stays: DataFrame,
    metres: float = EXPOSURE_DISTANCE_M,
    min_minutes: float = 0.0,
    block_rows: int | None = BLOCK_ROWS,
    probe_fraction: float = PROBE_FRACTION,
) -> DataFrame:
    """Everyone's time together: (iso_date, i1, i2, total_exposure_time), both ways round.

    Each pair is searched and added up once, then mirrored. Pairs below
    `min_minutes` are left out.
    """
    lasting = with_length(stays)
    most = BLOCK_ROWS if block_rows is None else block_rows
    pairs = near_pairs_together(
        lasting,
        lasting,
        metres,
        "a_id < b_id",
        None if block_rows is None else min(MEETING_FROM, most),
        min(MEETING_ROWS, most),
        probe_fraction,
    )
    totals = (
        pairs.groupBy(*TOGETHER, "iso_date", "a_id", "b_id")
        .agg(F.expr(f"sum({SHARED_SECONDS}) AS seconds"))
        .where(f"seconds >= {number(min_minutes * 60)}")
    )
    ways = "inline(array(struct(a_id AS i1, b_id AS i2), struct(b_id AS i1, a_id AS i2)))"
    return totals.selectExpr("iso_date", ways, "seconds / 60D AS total_exposure_time")
