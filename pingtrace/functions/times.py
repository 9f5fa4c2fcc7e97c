"""Whole-second interval arithmetic, as Spark SQL expressions."""

from __future__ import annotations


def whole_seconds(time: str) -> str:
    """Seconds since the epoch, fractions cut off."""
    return f"unix_timestamp({time})"


def micros(time: str) -> str:
    """Microseconds on the same scale as `whole_seconds`."""
    fraction = f"cast((extract(SECOND FROM {time}) % 1) * 1000000 AS bigint)"
    return f"({whole_seconds(time)} * 1000000 + {fraction})"


def overlap_seconds(
    start1: str, end1: str, start2: str, end2: str, seconds: tuple[str, str, str, str] | None = None
) -> str:
    """Shared whole seconds of two closed intervals, 0 when they are disjoint.

    `seconds` names the whole seconds of the four times where they are at hand: to work them out
    costs more than all else here.
    """
    s1, e1, s2, e2 = seconds or map(whole_seconds, (start1, end1, start2, end2))
    # As of `least` and `greatest` of the times, which pass over nulls.
    earlier_end = f"if({end1} <= {end2} OR {end2} IS NULL, {e1}, {e2})"
    later_start = f"if({start1} >= {start2} OR {start2} IS NULL, {s1}, {s2})"
    return f"(CASE WHEN {end1} < {start2} OR {end2} < {start1} THEN 0L ELSE {earlier_end} - {later_start} END)"
