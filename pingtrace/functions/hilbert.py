"""Places in the order of a Hilbert curve, as Spark SQL expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame

BITS = 16


def with_hilbert(df: DataFrame, latitude: str, longitude: str, name: str = "hilbert", bits: int = BITS) -> DataFrame:
    """Add the number of each position along a curve that fills the map in 4**bits steps.

    Positions next to each other along the curve are next to each other on the map, so a range of
    numbers is a compact area. Positions outside the map count as on its edge.
    """
    last = (1 << bits) - 1

    def step(value: str, low: float, span: float) -> str:
        return f"cast(greatest(0D, least({last}D, floor(({value} - {low}D) / {span}D * {last + 1}D))) AS bigint)"

    walked = df.selectExpr(
        "*", f"{step(longitude, -180.0, 360.0)} AS _hx", f"{step(latitude, -90.0, 180.0)} AS _hy", f"0L AS {name}"
    )
    # One quarter of what is left at a time, from the whole map down: which quarter it is,
    # and how the curve is turned within it.
    for level in range(bits - 1, -1, -1):
        side = 1 << level
        walked = walked.selectExpr(
            "* EXCEPT (_hx, _hy)", "_hx AS _x", "_hy AS _y", f"(_hx & {side}L) > 0 AS _east", f"(_hy & {side}L) > 0 AS _north"
        ).selectExpr(
            f"* EXCEPT (_x, _y, _east, _north, {name})",
            f"{name} + {side * side}L * CASE WHEN NOT _east AND NOT _north THEN 0L WHEN NOT _east THEN 1L "
            f"WHEN _north THEN 2L ELSE 3L END AS {name}",
            f"CASE WHEN _north THEN _x WHEN _east THEN {last}L - _y ELSE _y END AS _hx",
            f"CASE WHEN _north THEN _y WHEN _east THEN {last}L - _x ELSE _x END AS _hy",
        )
    return walked.drop("_hx", "_hy")
