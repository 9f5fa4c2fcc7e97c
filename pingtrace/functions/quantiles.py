"""Exact interpolated quantiles of large columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pingtrace.functions.geo import number

# Bits of a value's image that each pass settles, from the highest on: 64 in all.
DIGITS = (16, 16, 16, 16)
_FRACTION = 1 << 52
_LARGEST = 0x7FFF_FFFF_FFFF_FFFF


def with_image(df: DataFrame, value: str, image: str = "image") -> DataFrame:
    """Add a 64-bit integer in the order of a double column: its exponent and fraction bits, with its sign.

    Equal doubles (0 and -0 too) have equal images, others different ones; NaN comes last,
    as in Spark's own order. Only exact arithmetic is used: dividing by a power of two.
    """
    size = f"abs({value})"
    # The logarithm may be off by one next to a power of two; the comparison settles it.
    settled = "cast(_guess - if(pow(2D, _guess) > _size, 1, 0) + if(pow(2D, _guess + 1) <= _size, 1, 0) AS int)"
    normal = (
        f"(_exponent + 1023L) * {_FRACTION}L + cast((_size / pow(2D, _exponent) - 1D) * {float(_FRACTION)!r}D AS bigint)"
    )
    tiny = f"cast(_size * {2.0**537!r}D * {2.0**537!r}D AS bigint)"
    return (
        df.selectExpr("*", f"if(isnan({value}), 0D, {size}) AS _size")
        .selectExpr("*", f"_size >= {2.0**-1022!r}D AND _size < double('Infinity') AS _normal")
        .selectExpr("*", "if(_normal, least(1023, greatest(-1022, cast(floor(log2(_size)) AS int))), 0) AS _guess")
        .selectExpr("*", f"if(_normal, least(1023, greatest(-1022, {settled})), 0) AS _exponent")
        .selectExpr(
            "*",
            f"CASE WHEN isnan({value}) THEN {_LARGEST}L WHEN _normal THEN {normal} "
            f"WHEN _size = 0D THEN 0L WHEN _size < 1D THEN {tiny} ELSE {2047 * _FRACTION}L END AS _bits",
        )
        .selectExpr(
            "* EXCEPT (_size, _normal, _guess, _exponent, _bits)",
            f"if({value} < 0D AND NOT isnan({value}), -_bits, _bits) AS {image}",
        )
    )


def exact_quantiles(
    df: DataFrame,
    columns: list[str],
    fractions: list[float],
    digits: tuple[int, ...] = DIGITS,
) -> DataFrame:
    """(axis, fraction, quantile): linearly interpolated quantiles of several columns.

    Radix selection on the values' 64-bit images. A pass counts the values that share the
    higher digits of the wanted rank by their next digit, and goes on with the digit that holds
    the rank: after len(digits) passes over the data its value stands alone. Counts are
    partial in every task; a pass has at most 2**digit rows for each column and fraction
    after the shuffle, the last one too, however the values lie. Nothing is sorted and no set of values
    is held anywhere, unlike in the built-in exact percentile.
    """
    if sum(digits) != 64:
        raise ValueError("the digits must have 64 bits together")
    pairs = ", ".join(f"struct('{c}' AS axis, cast({c} AS double) AS v)" for c in columns)
    values = df.selectExpr(f"inline(array({pairs}))").where("v IS NOT NULL")
    shares = ", ".join(number(f) for f in fractions)
    left, brackets = 64, None
    wanted = ["axis", "fraction", "rank", "weight", "below", "beyond"]
    for bits in digits:
        left -= bits
        # Arithmetic shift: digits above are the same within a bracket, so this orders them all.
        digit = f"shiftright(image, {left}) AS digit"
        measures = [F.expr("count(*) AS n"), F.expr("min(v) AS v"), F.expr("max(v) AS top")]
        if brackets is None:
            counts = with_image(values, "v").groupBy("axis", F.expr(digit)).agg(*measures)
            # As many rows as columns, with a copy for each fraction.
            totals = counts.groupBy("axis").agg(F.sum("n").alias("total")).selectExpr(
                "*", f"explode(array({shares})) AS fraction"
            )
            ranks = totals.selectExpr(
                "axis",
                "fraction",
                "floor(fraction * (total - 1)) AS rank",
                "fraction * (total - 1) - floor(fraction * (total - 1)) AS weight",
                "0L AS below",
                "cast(NULL AS double) AS beyond",
            )
            counts = counts.join(F.broadcast(ranks), "axis")
        else:
            # The brackets are len(columns) * len(fractions) rows, whatever the data.
            # Images are in the order of the values, so the values of a digit are those from its least to its
            # greatest; only they need an image.
            held = brackets.selectExpr(*wanted, "v AS _least", "top AS _greatest")
            inside = values.join(F.broadcast(held), "axis").where("v >= _least AND v <= _greatest")
            counts = with_image(inside, "v").groupBy(*wanted, F.expr(digit)).agg(*measures)
        brackets = _holding_rank(counts)
    above = "if(below + n > rank + 1, v, coalesce(beyond, v))"
    return brackets.selectExpr("axis", "fraction", f"v + if(weight > 0D, ({above} - v) * weight, 0D) AS quantile")


def _holding_rank(counts: DataFrame) -> DataFrame:
    """The digit of each bracket in which the wanted rank falls.

    `below` becomes the number of values before it, `beyond` the smallest value after it.
    """
    in_order = "(PARTITION BY axis, fraction ORDER BY digit)"
    return (
        counts.selectExpr(
            "*",
            f"below + sum(n) OVER {in_order} AS up_to",
            f"coalesce(lead(v) OVER {in_order}, beyond) AS next",
        )
        .where("up_to > rank AND up_to - n <= rank")
        .selectExpr(
            "axis", "fraction", "rank", "weight", "up_to - n AS below", "next AS beyond", "v", "top", "n"
        )
    )
