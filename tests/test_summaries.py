import random

import numpy as np
import pytest
from helpers import metres, ping, pings

from pingtrace.operators import summaries
from pingtrace.operators.stays import stays

SCHEMA = "latitude double, longitude double, tot_evts bigint"


def _totals(spark, seed, n=300):
    rng = random.Random(seed)
    # Decimal steps put many values right on the edges of bins.
    rows = [(round(40 + rng.randrange(11) / 10, 1), round(rng.uniform(-4, -3), 2), rng.randrange(1, 9)) for _ in range(n)]
    return rows, spark.createDataFrame(rows, SCHEMA)


def _bins(values):
    edges = [min(values) + k * ((max(values) - min(values)) / 10) for k in range(10)]
    return np.digitize(values, edges) - 1, edges


def test_bins_follow_their_left_edges(spark):
    rows, totals = _totals(spark, 1)
    bins, edges = _bins([r[0] for r in rows])
    expected = sorted((r[0], int(b), edges[b]) for r, b in zip(rows, bins))
    found = summaries.bin_edges(totals).select("latitude", "lat_bin", "lat_edge")
    assert sorted(tuple(r) for r in found.collect()) == expected


def test_histogram_counts_every_event(spark):
    rows, totals = _totals(spark, 2)
    histogram = summaries.grid_histogram(totals).collect()
    assert len(histogram) == 100
    y, _ = _bins([r[0] for r in rows])
    x, _ = _bins([r[1] for r in rows])
    expected = np.zeros((10, 10), int)
    for (_, _, n), i, j in zip(rows, y, x):
        expected[i, j] += n
    assert {(r["lat_bin"], r["lon_bin"]): r["n_events"] for r in histogram} == {
        (i, j): expected[i, j] for i in range(10) for j in range(10)
    }


def test_histogram_reads_its_table_once(spark, tmp_path):
    rows, totals = _totals(spark, 4)
    totals.write.parquet(str(tmp_path / "totals"))
    counted = spark.read.parquet(str(tmp_path / "totals")).groupBy("latitude", "longitude").agg({"tot_evts": "sum"})
    counted = counted.withColumnRenamed("sum(tot_evts)", "tot_evts")
    histogram = summaries.grid_histogram(counted)
    assert sum(r["n_events"] for r in histogram.collect()) == sum(r[2] for r in rows)
    plan = histogram._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("FileScan parquet") == 1 and "ReusedExchange" in plan


def test_one_value_and_the_maximum(spark):
    totals = spark.createDataFrame([(40.0, -4.0, 2), (40.0, -3.0, 5)], SCHEMA)
    found = {(r["lat_bin"], r["lon_bin"]): r["n_events"] for r in summaries.grid_histogram(totals).collect()}
    assert found[0, 0] == 2 and found[0, 9] == 5 and sum(found.values()) == 7
    assert summaries.grid_histogram(totals.limit(0)).count() == 0


def test_repeat_by_count(spark, monkeypatch):
    monkeypatch.setattr(summaries, "REPEAT_CHUNK", 7)
    totals = spark.createDataFrame([(1.0, 1.0, 50), (2.0, 2.0, 7), (3.0, 3.0, 1), (4.0, 4.0, 0)], SCHEMA)
    repeated = summaries.repeat_by_count(totals)
    counts = {r["latitude"]: r["count"] for r in repeated.groupBy("latitude").count().collect()}
    assert counts == {1.0: 50, 2.0: 7, 3.0: 1}
    assert repeated.columns == totals.columns


def test_totals_of_stays_are_totals_of_pings(spark):
    rng = random.Random(3)
    rows = [ping(str(rng.randrange(3)), (rng.choice([1.0, 2.0]), 1.0), f"10:00:{i:02}") for i in range(60)]
    table = pings(spark, rows)
    by_stays = sorted(tuple(r) for r in summaries.geo_event_totals(stays(table)).collect())
    by_pings = sorted(tuple(r) for r in summaries.ping_totals(table).collect())
    assert by_stays == by_pings and sum(r[2] for r in by_pings) == 60


def test_distance(spark):
    table = pings(spark, [ping("p", (41.0, 2.0), "10:00:00"), ping("q", (-40.0, 176.3), "10:00:00")])
    found = {r["id"]: r["distance"] for r in summaries.with_distance_from(table, 40.0, -3.7).collect()}
    assert found["p"] == pytest.approx(metres(40.0, -3.7, 41.0, 2.0))
    assert found["q"] == pytest.approx(np.pi * 6_371_000)
