"""Picking people spread evenly over an area."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pingtrace.functions.geo import CubeGrid, haversine_m, number, rescale
from pingtrace.functions.quantiles import exact_quantiles
from pingtrace.sources.pings import day_slice
from pingtrace.sources.staging import broadcast_if_small, staged

POINT_SCHEMA = T.StructType(
    [
        T.StructField("point_id", T.IntegerType()),
        T.StructField("x", T.DoubleType()),
        T.StructField("y", T.DoubleType()),
    ]
)
# Steps of the two-dimensional golden-ratio (R2) sequence.
R2_STEP_X, R2_STEP_Y = 0.7548776662466927, 0.5698402909980532

# Candidates that a point asks for at first, and how many times more whenever all are taken.
FIRST_ASK, ASK_AGAIN = 8, 4


def plane_minmax(pings: DataFrame, day: str | None = None) -> DataFrame:
    """One row with the bounding box of all pings, or of one day's."""
    return _of_day(pings, day).agg(
        F.expr("min(latitude) AS min_lat"),
        F.expr("max(latitude) AS max_lat"),
        F.expr("min(longitude) AS min_lon"),
        F.expr("max(longitude) AS max_lon"),
    )


def plane_percentile(
    pings: DataFrame,
    low: float = 0.35,
    high: float = 0.65,
    day: str | None = None,
    approximate: bool = False,
) -> DataFrame:
    """One row with the box between two quantiles of latitude and of longitude.

    The quantiles are exact and interpolated. `approximate` takes Spark's sketch
    instead: one pass, and actual values rather than interpolated ones.
    """
    chosen = _of_day(pings, day).select("latitude", "longitude")
    edges = [("min_lat", "latitude", low), ("max_lat", "latitude", high)]
    edges += [("min_lon", "longitude", low), ("max_lon", "longitude", high)]
    if approximate:
        sketch = "percentile_approx({}, {}, 100000) AS {}"
        return chosen.agg(*[F.expr(sketch.format(axis, number(f), name)) for name, axis, f in edges])
    quantiles = exact_quantiles(chosen, ["latitude", "longitude"], [low, high])
    chosen_edge = "max(quantile) FILTER (WHERE axis = '{}' AND fraction = {}) AS {}"
    return quantiles.agg(*[F.expr(chosen_edge.format(axis, number(f), name)) for name, axis, f in edges])


def _of_day(pings: DataFrame, day: str | None) -> DataFrame:
    return pings if day is None else day_slice(pings, day)


def unit_points(spark: SparkSession, n: int = 100, start: int = 1) -> DataFrame:
    """`n` evenly spread points (point_id, x, y) in [-1, 1) x [-1, 1).

    Taken from place `start` on of a fixed low-discrepancy sequence.
    """

    def coordinate(step: float) -> str:
        turn = f"((id + {start - 1}) * {number(step)})"
        return f"2D * ({turn} - floor({turn})) - 1D"

    return spark.range(1, n + 1).selectExpr(
        "cast(id AS int) AS point_id", f"{coordinate(R2_STEP_X)} AS x", f"{coordinate(R2_STEP_Y)} AS y"
    )


def points_from_rows(spark: SparkSession, rows: Iterable[tuple[int, float, float]]) -> DataFrame:
    """A points table from literal (point_id, x, y) rows, checked against its schema."""
    return spark.createDataFrame(list(rows), POINT_SCHEMA, verifySchema=True)


def first_points(points: DataFrame, n: int) -> DataFrame:
    """The first `n` points or picks by number."""
    return points.where(f"point_id <= {n}")


def target_points(points: DataFrame, plane: DataFrame, unit_range=(-1.0, 1.0)) -> DataFrame:
    """(point_id, rand_lat, rand_lon): unit points stretched over the plane.

    `plane` is a single row by construction.
    """
    return points.crossJoin(F.broadcast(plane)).selectExpr(
        "point_id",
        f"{rescale('y', 'min_lat', 'max_lat', unit_range)} AS rand_lat",
        f"{rescale('x', 'min_lon', 'max_lon', unit_range)} AS rand_lon",
    )


def nearest_candidates(pings: DataFrame, targets: DataFrame, k: int | None = None) -> DataFrame:
    """The `k` people nearest to each target: (point_id, nearest_rank, id, distance).

    A person is as near as their nearest ping; equal distances go by id. `k` is
    the number of targets by default: in a pick without repeats, at most that
    many people can be taken before a target's turn.
    """
    search = NearestPeople(pings, targets)
    k = search.n_targets if k is None else k
    return search.nearest(search.targets.selectExpr("point_id", f"{k} AS k"))


class NearestPeople:
    """Search for the people nearest to targets, in rings that widen until they hold enough.

    Around each target lie nested blocks of cubes, each block with twice the side of the one
    before. One position of every person is counted into the blocks, once: the smallest block
    with at least k people tells how far the k-th nearest is at most. Only pings in
    cubes within that reach are measured.
    """

    def __init__(self, pings: DataFrame, targets: DataFrame):
        self.people = pings.where("id != ''").select("id", "latitude", "longitude")
        self.targets = staged(targets.select("point_id", "rand_lat", "rand_lon"), "targets")
        self.n_targets = self.targets.count()
        self._rings = staged(self._count_rings(), "rings")

    def _count_rings(self) -> DataFrame:
        """(point_id, level, people): people with their one position in each block around a target."""
        grid = CubeGrid()
        # Both coordinates follow the same smallest hash, so they are of one ping.
        first = "xxhash64(latitude, longitude)"
        anchors = self.people.groupBy("id").agg(
            F.expr(f"min_by(latitude, {first}) AS latitude"), F.expr(f"min_by(longitude, {first}) AS longitude")
        )
        blocks = grid.with_blocks(self.targets, "rand_lat", "rand_lon", grid.every_level)
        cubes = grid.with_cubes(anchors, "latitude", "longitude", grid.every_level)
        held = cubes.join(broadcast_if_small(blocks.select("point_id", *grid.key)), grid.key)
        return held.groupBy("point_id", "level").agg(F.count("*").alias("people"))

    def nearest(self, asks: DataFrame) -> DataFrame:
        """The nearest people of each point in `asks` (point_id, k), as many as it asks for."""
        grid = CubeGrid()
        enough = asks.join(self._rings, "point_id", "left").groupBy("point_id", "k").agg(
            F.expr("max(level) FILTER (WHERE people >= k) AS ring")
        )
        circles = self.targets.join(enough, "point_id").selectExpr(
            "point_id",
            "k",
            "rand_lat",
            "rand_lon",
            f"{grid.block_reach_m('ring')} AS radius",
            f"{grid.level_around('ring')} AS level",
        )
        circles = staged(circles, "circles")
        # As many as there are levels.
        levels = sorted(r["level"] for r in circles.select("level").distinct().collect())
        reached = grid.with_blocks(circles, "rand_lat", "rand_lon", "array(level)")
        distance = haversine_m("rand_lat", "rand_lon", "latitude", "longitude")
        # Of the pings in cubes within reach, each place of a person is measured once.
        cubes = grid.with_cubes(self.people, "latitude", "longitude", f"array({', '.join(map(str, levels)) or 'cast(NULL AS int)'})")
        places = cubes.join(broadcast_if_small(reached.select(*grid.key).distinct()), grid.key, "left_semi").distinct()
        near = (
            places.join(broadcast_if_small(reached), grid.key)
            .where(f"{distance} <= radius")
            .groupBy("point_id", "k", "id")
            .agg(F.expr(f"min({distance}) AS distance"))
        )
        by_distance = "row_number() OVER (PARTITION BY point_id ORDER BY distance, id) AS nearest_rank"
        ranked = near.selectExpr("point_id", by_distance, "id", "distance", "k").where("nearest_rank <= k")
        return ranked.drop("k")


def _picks_in_turn(candidates: DataFrame) -> DataFrame:
    """(point_id, id, passed): each point's first candidate that no earlier point has, null if there is none.

    `passed` is the number of candidates that were taken. The points go one after the
    other, so their candidates pass through one task: a few for each point, whatever the
    number of pings. It holds the people taken, at most one for each point.
    """

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        taken, point, found, passed = set(), None, None, 0
        rows = ([], [], [])

        def settle() -> None:
            for column, value in zip(rows, (point, found, passed), strict=True):
                column.append(value)

        for batch in batches:
            for asking, person in zip(batch.column("point_id").to_pylist(), batch.column("id").to_pylist(), strict=True):
                if asking != point:
                    if point is not None:
                        settle()
                    point, found, passed = asking, None, 0
                if found is None and person in taken:
                    passed += 1
                elif found is None:
                    found = person
                    taken.add(person)
        if point is not None:
            settle()
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, (pa.int32(), pa.string(), pa.int32()), strict=True)],
                                         ["point_id", "id", "passed"])

    in_order = candidates.selectExpr("cast(point_id AS int) AS point_id", "nearest_rank", "id")
    in_order = in_order.repartition(1).sortWithinPartitions("point_id", "nearest_rank").select("point_id", "id")
    return in_order.mapInArrow(pick, "point_id int, id string, passed int")


def pick_without_repeats(candidates: DataFrame) -> DataFrame:
    """(point_id, id): in order of the points, the nearest person not yet picked.

    Points whose candidates are all taken get none.
    """
    return _picks_in_turn(candidates).where("id IS NOT NULL").select("point_id", "id")


def spread_picks(pings: DataFrame, targets: DataFrame) -> DataFrame:
    """(point_id, id): `pick_without_repeats` among all people, asking for candidates as they are needed.

    Every point asks for a few people. Points that find all of theirs taken by earlier ones ask
    for more, and the turns are taken anew, until nobody is left without.
    """
    search = NearestPeople(pings, targets)
    asked = search.targets.selectExpr("point_id", f"{min(FIRST_ASK, max(search.n_targets, 1))} AS k")
    lists = staged(search.nearest(asked).drop("distance"), "candidates")
    while True:
        picks = staged(_picks_in_turn(lists), "picks")
        # Nobody can be passed over by more points than there are, and nobody is left behind the last one.
        short = picks.where("id IS NULL").join(asked, "point_id").where(f"passed >= k AND k < {search.n_targets}")
        more = staged(short.selectExpr("point_id", f"least(k * {ASK_AGAIN}, {search.n_targets}) AS k"), "asks")
        if more.isEmpty():
            return picks.where("id IS NOT NULL").select("point_id", "id")
        asked = staged(asked.join(more, "point_id", "left_anti").unionByName(more), "asked")
        longer = search.nearest(more).drop("distance")
        lists = staged(lists.join(more, "point_id", "left_anti").unionByName(longer), "candidates")


def balanced_sample(pings: DataFrame, points: DataFrame, plane: DataFrame | None = None) -> DataFrame:
    """(point_id, id): a person for each unit point spread over the middle of the pings.

    The plane is the 35 to 65 percent box of the pings unless given.
    """
    box = plane_percentile(pings) if plane is None else plane
    return spread_picks(pings, target_points(points, box))
