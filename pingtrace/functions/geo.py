"""Distances and grid cells on the sphere, as Spark SQL expressions.

The helpers take names of columns (or other SQL expressions) and give SQL text,
to be used in `expr`, `selectExpr` and `where`.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame

EARTH_RADIUS_M = 6_371_000.0
HALF_CIRCUMFERENCE_M = math.pi * EARTH_RADIUS_M

# Widens every search window a little, so that rounding in the cell arithmetic
# can only add a candidate (the exact distance test follows), never lose one.
_MARGIN = 1 + 1e-6


def number(value: float) -> str:
    """A double literal in SQL."""
    return f"{float(value)!r}D"


def rounded(value: str, digits: int) -> str:
    """`round(value, digits)` of a double, by arithmetic unless it is large or next to a tie.

    `round` goes through decimal text. A whole number divided by a power of ten is the double
    nearest to that decimal, which is what `round` gives.
    """
    scale = number(10.0**digits)
    scaled = f"({value} * {scale})"
    off_tie = f"abs({scaled} - floor({scaled}) - 0.5D) > 1e-6D"
    return f"if(abs({scaled}) < 1e9D AND {off_tie}, floor({scaled} + 0.5D) / {scale}, round({value}, {digits}))"


def haversine_m(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    """Great-circle distance in metres between two points given in degrees."""
    # asin of anything above 1 is NaN; antipodal points can round up to there.
    return (
        f"({number(2 * EARTH_RADIUS_M)} * asin(least(1D, sqrt("
        f"pow(sin(radians({lat2} - {lat1}) / 2), 2D) + "
        f"cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2D)))))"
    )


def unit_vector(latitude: str, longitude: str, prefix: str) -> list[str]:
    """The three coordinates of a point on the unit sphere, named `x`, `y`, `z` after `prefix`."""
    lat, lon = f"radians({latitude})", f"radians({longitude})"
    return [
        f"cos({lat}) * cos({lon}) AS {prefix}x",
        f"cos({lat}) * sin({lon}) AS {prefix}y",
        f"sin({lat}) AS {prefix}z",
    ]


def may_be_within(one: str, other: str, metres: float) -> str:
    """A cheap test on two `unit_vector`s: false only for points further apart than `metres`."""
    return f"{_squared_chord(one, other)} <= {number((_chord(metres) * _MARGIN + 1e-12) ** 2)}"


def is_within(one: str, other: str, metres: float, distance: str) -> str:
    """Whether `distance` is at most `metres`; from two `unit_vector`s alone unless they leave it open."""
    surely = max(0.0, _chord(metres) / _MARGIN - 1e-12) ** 2
    return (
        f"{may_be_within(one, other, metres)} AND "
        f"({_squared_chord(one, other)} < {number(surely)} OR {distance} <= {number(metres)})"
    )


def _chord(metres: float) -> float:
    return 2 * math.sin(min(metres / EARTH_RADIUS_M, math.pi) / 2)


def _squared_chord(one: str, other: str) -> str:
    return "(" + " + ".join(f"({one}{c} - {other}{c}) * ({one}{c} - {other}{c})" for c in "xyz") + ")"


def near_cube(latitude: str, longitude: str, metres: float) -> list[str]:
    """Keys `kx`, `ky`, `kz` that only points within `metres` of each other share; far from all such points do.

    Null or NaN positions and those beyond 90 or 180 degrees have null keys.
    """
    # The diagonal of a cube is sqrt(3) times its side, which leaves more room than rounding needs.
    side = math.sin(min(metres / EARTH_RADIUS_M, math.pi) / 2)
    on_earth = f"abs({latitude}) <= 90D AND abs({longitude}) <= 180D"
    vector = [part.rsplit(" AS ", 1) for part in unit_vector(latitude, longitude, "k")]
    return [f"if({on_earth}, floor(({value}) / {number(side)}), NULL) AS {name}" for value, name in vector]


def rescale(value: str, low: str, high: str, unit_range=(-1.0, 1.0), digits: int = 7) -> str:
    """Map `value` from `unit_range` linearly onto [low, high], rounded."""
    start, end = unit_range
    share = f"({value} - {number(start)}) / {number(end - start)}"
    return f"round({low} + ({high} - {low}) * ({share}), {digits})"


class CellGrid:
    """Latitude rows, each cut into its own whole number of longitude columns.

    Rows are `2 * metres` high and columns at least that wide, measured at the
    poleward edge of their row, so cells keep about the same size everywhere and
    a circle of `metres` touches at most two rows and a few columns, also next to
    a pole and across the 180 degree meridian. Every point has exactly one home
    cell: two points within `metres` meet in exactly one cell when one of them
    is copied to all cells its circle touches.
    """

    def __init__(self, metres: float):
        if not metres > 0:
            raise ValueError("metres must be positive")
        self.metres = float(metres)
        self.height = math.degrees(2 * self.metres / EARTH_RADIUS_M)

    def _row(self, latitude: str) -> str:
        return f"floor(({latitude}) / {number(self.height)})"

    def _columns(self, row: str) -> str:
        """Number of columns in a row, from the cosine of its poleward edge."""
        height = number(self.height)
        poleward = f"least(90D, greatest(abs({row} * {height}), abs(({row} + 1) * {height})))"
        return f"greatest(1L, floor(cos(radians({poleward})) * {number(360.0 / self.height)}))"

    @staticmethod
    def _column(longitude: str) -> str:
        return f"floor(({longitude} + 180D) * _columns / 360D)"

    def with_home_cell(self, df: DataFrame, latitude: str, longitude: str) -> DataFrame:
        """Add `cy`, `cx`: the one cell each point lies in."""
        return (
            df.selectExpr("*", f"{self._row(latitude)} AS cy")
            .selectExpr("*", f"{self._columns('cy')} AS _columns")
            .selectExpr("* EXCEPT (_columns)", f"pmod({self._column(longitude)}, _columns) AS cx")
        )

    def with_reached_cells(
        self, df: DataFrame, latitude: str, longitude: str, radius: str | None = None
    ) -> DataFrame:
        """One row per cell touched by the circle around each point.

        `radius` (metres, at most the grid's own) defaults to the grid's.
        """
        angle = f"({radius or number(self.metres)} / {number(EARTH_RADIUS_M)})"
        reach_lat = f"degrees({angle}) * {number(_MARGIN)}"
        # A circle that holds a pole spans all longitudes.
        reach_lon = (
            f"CASE WHEN abs({latitude}) + {reach_lat} >= 90D THEN 180D ELSE "
            f"degrees(asin(least(1D, sin({angle}) / cos(radians({latitude}))))) * {number(_MARGIN)} END"
        )
        first_row = self._row(f"greatest(-90D, {latitude} - {reach_lat})")
        last_row = self._row(f"least(90D, {latitude} + {reach_lat})")
        # Beyond the poles (no such place, but it may be asked) the last row alone.
        rows = f"sequence(least({first_row}, {last_row}), {last_row})"
        first, last = self._column(f"({longitude} - _reach)"), self._column(f"({longitude} + _reach)")
        # Two explodes instead of a nested transform keep this inside codegen.
        return (
            df.selectExpr("*", f"{reach_lon} AS _reach", f"explode({rows}) AS cy")
            .selectExpr("*", f"{self._columns('cy')} AS _columns")
            .selectExpr("*", f"explode(sequence({first}, least({last}, {first} + _columns - 1))) AS _cx")
            .selectExpr("* EXCEPT (_reach, _columns, _cx)", "pmod(_cx, _columns) AS cx")
        )


class CubeGrid:
    """Cubes around the earth's surface in levels, each with half the side of the one before.

    Cubes know no poles and no meridian. The block of a point at a level is the cube
    that it lies in with the 26 around it, as far as they touch the surface.
    """

    LEVELS = 25  # sides from the earth's diameter down to less than a metre
    key = ["level", "kx", "ky", "kz"]
    every_level = f"sequence(0, {LEVELS - 1})"

    @staticmethod
    def _side(level: str) -> str:
        """Side of a cube, in radii of the earth."""
        return f"pow(2D, 1 - {level})"

    def _with_vector(self, df: DataFrame, latitude: str, longitude: str) -> DataFrame:
        lat, lon = f"radians({latitude})", f"radians({longitude})"
        return df.selectExpr("*", f"cos({lat}) * cos({lon}) AS _x", f"cos({lat}) * sin({lon}) AS _y", f"sin({lat}) AS _z")

    def with_cubes(self, df: DataFrame, latitude: str, longitude: str, levels: str) -> DataFrame:
        """One row for each of `levels` (an array), with the cube that the point lies in."""
        keys = [f"cast(floor((_{c} + 1D) / {self._side('level')}) AS int) AS k{c}" for c in "xyz"]
        spread = self._with_vector(df, latitude, longitude).selectExpr("*", f"explode({levels}) AS level")
        return spread.selectExpr("* EXCEPT (_x, _y, _z)", *keys)

    def with_blocks(self, df: DataFrame, latitude: str, longitude: str, levels: str) -> DataFrame:
        """One row for each cube of the point's blocks at `levels` (an array; column `level` is replaced)."""
        own = df.drop("level") if "level" in df.columns else df
        chosen = f"explode({levels}) AS level"
        spread = self._with_vector(df, latitude, longitude).selectExpr(
            *own.columns, "_x", "_y", "_z", chosen
        )
        for c in "xyz":
            here = f"cast(floor((_{c} + 1D) / {self._side('level')}) AS int)"
            spread = spread.selectExpr("*", f"explode(sequence({here} - 1, {here} + 1)) AS k{c}")
        centre = " + ".join(f"pow((k{c} + 0.5D) * {self._side('level')} - 1D, 2D)" for c in "xyz")
        touches = f"abs(sqrt({centre}) - 1D) <= {number(math.sqrt(3) / 2 * _MARGIN)} * {self._side('level')} + 1e-12D"
        return spread.where(touches).drop("_x", "_y", "_z")

    def block_reach_m(self, level: str) -> str:
        """Metres within which everything in a block at `level` lies; everything for a null level."""
        chord = f"{number(2 * math.sqrt(3) * _MARGIN)} * {self._side(level)}"
        arc = f"{number(2 * EARTH_RADIUS_M)} * asin(least(1D, {chord} / 2D))"
        return f"coalesce({arc} * {number(1 + 1e-9)} + 1e-6D, {number(HALF_CIRCUMFERENCE_M * (1 + 1e-9))})"

    @staticmethod
    def level_around(level: str) -> str:
        """The level whose blocks hold all that is within `block_reach_m` of a point."""
        # A block reaches at least one side from its point, and 2 * sqrt(3) is below 4.
        return f"greatest(coalesce({level}, 0) - 2, 0)"
