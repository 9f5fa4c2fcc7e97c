"""Places of regular-expression matches in a text, with Spark's own functions.

`split` gives what lies between the matches and `regexp_extract_all` the matches;
running sums of their lengths are the positions, in code points, end exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 128
MATCHES = "array<struct<start:bigint,end:bigint,text:string,before:string,after:string>>"
CONTEXT = 40  # code points on either side of a match that count as near


def _running(values: Column) -> Column:
    """For an array<bigint>, the sum before each entry. In blocks, so that long arrays are not copied per entry."""

    def block_sums(block: Column) -> Column:
        empty = F.struct(F.lit(0).cast("bigint").alias("total"), F.array().cast("array<bigint>").alias("sums"))
        return F.aggregate(
            block,
            empty,
            lambda acc, x: F.struct(
                (acc["total"] + x).alias("total"), F.array_append(acc["sums"], acc["total"]).alias("sums")
            ),
        )

    blocks = F.transform(
        F.sequence(F.lit(0), F.greatest(F.ceil(F.size(values) / BLOCK).cast("int") - 1, F.lit(0))),
        lambda b: block_sums(F.slice(values, b * BLOCK + 1, BLOCK)),
    )
    empty = F.struct(F.lit(0).cast("bigint").alias("total"), F.array().cast("array<bigint>").alias("sums"))
    return F.aggregate(
        blocks,
        empty,
        lambda acc, block: F.struct(
            (acc["total"] + block["total"]).alias("total"),
            F.concat(acc["sums"], F.transform(block["sums"], lambda s: s + acc["total"])).alias("sums"),
        ),
    )["sums"]


def _lengths(parts: Column) -> Column:
    return F.transform(parts, lambda p: F.length(p).cast("bigint"))


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """Leftmost non-overlapping matches of a pattern that matches no empty text, with the text on both sides of each.

    With a `group` that looks ahead from the match's beginning, that group is what is given as text and by its
    end, and only the match itself is passed over, so texts may overlap.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    parts = F.arrays_zip(
        (F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found).alias("text"),
        F.slice(gaps, F.lit(1), F.size(found)).alias("gap"),
        F.slice(gaps, F.lit(2), F.size(found)).alias("next_gap"),
        _running(_lengths(found)).alias("found_before"),
        _running(_lengths(gaps)).alias("gap_before"),
    )
    parts = F.filter(parts, lambda p: p["text"].isNotNull())

    def place(p: Column) -> Column:
        start = p["found_before"] + p["gap_before"] + F.length(p["gap"])
        return F.struct(
            start.alias("start"),
            (start + F.length(p["text"])).alias("end"),
            p["text"].alias("text"),
            F.right(p["gap"], F.lit(CONTEXT)).alias("before"),
            F.left(p["next_gap"], F.lit(CONTEXT)).alias("after"),
        )

    return F.transform(parts, place)


def none() -> Column:
    return F.array().cast(MATCHES)


def joined(spans: Column) -> Column:
    """kind:start:end of an array of structs (start, rank, end, kind, ...), by start and rank."""
    return F.array_join(
        F.transform(
            F.array_sort(spans),
            lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )
