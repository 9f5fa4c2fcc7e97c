"""Equal-width bins, as Spark SQL expressions."""

from __future__ import annotations


def bin_start(index: str, low: str, high: str, bins: int) -> str:
    """Left edge of a bin."""
    return f"({low} + ({index}) * (({high} - {low}) / {bins}D))"


def bin_index(value: str, low: str, high: str, bins: int) -> str:
    """0-based bin of `value`: the last bin whose left edge is not above it.

    The maximum falls into the last bin, and everything into bin 0 when
    low = high. The division gives the bin up to one rounding step, which the
    comparison with the edges themselves then settles.
    """
    guess = f"floor(({value} - {low}) / (({high} - {low}) / {bins}D))"
    settled = (
        f"CASE WHEN {value} < {bin_start(guess, low, high, bins)} THEN {guess} - 1 "
        f"WHEN {value} >= {bin_start(f'{guess} + 1', low, high, bins)} THEN {guess} + 1 ELSE {guess} END"
    )
    return f"cast(CASE WHEN {high} > {low} THEN greatest(0L, least({settled}, {bins - 1}L)) ELSE 0L END AS int)"
