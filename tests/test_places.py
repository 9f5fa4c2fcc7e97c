"""Hilbert order, tables written by place, and searches that pass over their files."""

import random

import numpy as np
import pytest
from helpers import DAY, ids, metres, ping, pings
from pyspark.sql import functions as F

from pingtrace.functions.hilbert import with_hilbert
from pingtrace.plans import tracing
from pingtrace.sources import events
from pingtrace.sources.pings import near_boxes, read_pings, write_pings, write_pings_by_place

SF_DIR = "/root/testdata/sf0.01"


@pytest.mark.parametrize("bits", [1, 2, 4])
def test_the_curve_visits_every_square_once_and_moves_by_one(spark, bits):
    n = 1 << bits
    rows = [((y + 0.5) / n * 180 - 90, (x + 0.5) / n * 360 - 180, x, y) for x in range(n) for y in range(n)]
    frame = spark.createDataFrame(rows, "latitude double, longitude double, x int, y int")
    order = {r["hilbert"]: (r["x"], r["y"]) for r in with_hilbert(frame, "latitude", "longitude", bits=bits).collect()}
    assert sorted(order) == list(range(n * n))
    for k in range(n * n - 1):
        (a, b), (c, d) = order[k], order[k + 1]
        assert abs(a - c) + abs(b - d) == 1


def test_places_on_and_beyond_the_edge(spark):
    frame = spark.createDataFrame([(90.0, 180.0), (-90.0, -180.0), (500.0, -999.0)], "latitude double, longitude double")
    found = [r["hilbert"] for r in with_hilbert(frame, "latitude", "longitude").collect()]
    assert all(0 <= h < 4**16 for h in found) and found[1] == 0


def _people(n=400):
    rng = random.Random(5)
    towns = [(40 + rng.uniform(-3, 3), -3.7 + rng.uniform(-3, 3)) for _ in range(12)]
    rows = []
    for i in range(n):
        lat, lon = towns[i % 12]
        place = (lat + rng.uniform(-2e-4, 2e-4), lon + rng.uniform(-2e-4, 2e-4))
        rows += [ping(str(i), place, f"{h:02}:{m:02}:00", DAY) for h in range(9, 13) for m in (0, 30)]
    return rows


def _rows_scanned(frame) -> int:
    """Rows that left the file scans of a query, after their statistics were used."""
    frame.collect()
    plan = frame._jdf.queryExecution().executedPlan()
    total = 0
    leaves = plan.collectLeaves()
    for k in range(leaves.size()):
        leaf = leaves.apply(k)
        metric = leaf.metrics().get("numOutputRows")
        if metric.isDefined():
            total += metric.get().value()
    return total


def test_a_search_passes_over_files_elsewhere(spark, tmp_path):
    rows = _people()
    path = str(tmp_path / "by-place")
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        write_pings_by_place(pings(spark, rows), path)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    table = read_pings(spark, path, timestamp="ts")
    assert sorted(map(tuple, table.collect())) == sorted(rows)
    cohort = table.where("id IN ('0', '12')")
    test = near_boxes(cohort, 10.0)
    near = table.where(test)
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    plan = near._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    pushed = plan.split("PushedFilters: [")[1].split("]")[0]
    assert "GreaterThanOrEqual(latitude" in pushed and "LessThanOrEqual(longitude" in pushed
    with_rows = table.select(F.input_file_name().alias("file")).distinct().count()
    files = near.select(F.input_file_name().alias("file")).distinct().count()
    assert files <= max(2, with_rows // 3) and with_rows >= 6
    flat = spark.read.parquet(path).where(test).select("id")
    assert _rows_scanned(flat) < len(rows) / 2
    here = [(r[1], r[2]) for r in rows if r[0] in ("0", "12")]
    for r in rows:
        if any(metres(r[1], r[2], *p) <= 10 for p in here):
            assert r[0] in {x["id"] for x in near.select("id").distinct().collect()}


def test_boxes_hold_all_that_is_near(spark):
    rng = random.Random(6)
    places = [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(40)]
    places += [(0.0, 179.99999), (0.0, -179.99999), (89.9999, 10.0), (-90.0, 0.0), (60.0, 20.0)]
    frame = spark.createDataFrame(places, "latitude double, longitude double")
    near = []
    for lat, lon in places:
        for _ in range(20):
            north, east = rng.gauss(0, 5000), rng.gauss(0, 5000)
            y = max(-90.0, min(90.0, lat + north / 111_194.9))
            x = lon + east / (111_194.9 * max(np.cos(np.radians(lat)), 1e-6))
            x = (x + 180) % 360 - 180
            if metres(lat, lon, y, x) <= 10_000:
                near.append((y, float(x)))
    for most in (1, 9, 64):
        test = near_boxes(frame, 10_000.0, most)
        inside = spark.createDataFrame(near, "latitude double, longitude double").where(test)
        assert len(near) > 300 and inside.count() == len(near)
    assert near_boxes(frame.limit(0), 10.0) == "false"


def test_exposure_is_the_same_with_boxes(spark, tmp_path):
    table = events.daily_pings(spark, SF_DIR)
    cohort = ids(spark, [str(i) for i in range(5)])
    plain = sorted(map(tuple, tracing.cohort_exposure(table, cohort).collect()))
    for write, name in ((write_pings, "by-day"), (write_pings_by_place, "by-place")):
        write(table, str(tmp_path / name))
        stored = read_pings(spark, str(tmp_path / name), timestamp="ts")
        for most in (None, 1, 32):
            found = tracing.cohort_exposure(stored, cohort, most_boxes=most)
            assert sorted(map(tuple, found.collect())) == plain
    assert plain
    assert tracing.cohort_exposure(table, ids(spark, []), most_boxes=4).collect() == []
