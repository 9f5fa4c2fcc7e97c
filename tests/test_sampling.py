import random
import string

import numpy as np
import pytest
from helpers import metres, ping, pings

from pingtrace.functions import quantiles
from pingtrace.functions.quantiles import exact_quantiles, with_image
from pingtrace.operators import sampling


@pytest.mark.parametrize("digits", [(16, 16, 16, 16), (20, 30, 14), (64,), (1, 7, 50, 6)])
def test_quantiles_are_those_of_numpy(spark, digits):
    rng = random.Random(len(digits))
    for values in (
        [rng.gauss(40, 1) for _ in range(501)],
        [rng.choice([1.0, 2.0, 5.0]) for _ in range(200)],
        [7.0] * 50,
        [1.0, 2.0],
        [3.0],
        [0.0, -0.0, 1e-12, 1.0, 1e9, -5.0, 2.0],
        [1e12, *(40 + rng.random() for _ in range(300))],
        [5e-324, 2.2e-308, -1e-310, 1.7e308, -1.7e308, 0.0, 2.0**-1022, 1.0],
    ):
        table = spark.createDataFrame([(v, -v) for v in values], "up double, down double")
        fractions = [0.0, 0.35, 0.5, 0.65, 1.0]
        found = exact_quantiles(table, ["up", "down"], fractions, digits).collect()
        got = {(r["axis"], r["fraction"]): r["quantile"] for r in found}
        assert len(got) == len(found) == 10
        for f in fractions:
            assert got["up", f] == pytest.approx(np.percentile(values, 100 * f), rel=1e-12, abs=1e-9)
            assert got["down", f] == pytest.approx(np.percentile([-v for v in values], 100 * f), rel=1e-12, abs=1e-9)


def test_images_are_in_the_order_of_the_values(spark):
    rng = random.Random(7)
    values = [s * m * 2.0**e for s in (1, -1) for e in range(-1074, 1024, 3) for m in (1.0, 1.5, 1 + rng.random())]
    edges = [2.0**e for e in range(-1074, 1024)]
    values += edges + [np.nextafter(x, 0) for x in edges] + [np.nextafter(x, np.inf) for x in edges[:-1]]
    values += [0.0, -0.0, float("inf"), float("-inf"), float("nan")]
    table = spark.createDataFrame([(float(v),) for v in values], "v double")
    got = [r["image"] for r in with_image(table, "v").collect()]
    bits = np.array(values).view(np.int64)
    expected = np.where(bits < 0, -(bits & 0x7FFF_FFFF_FFFF_FFFF), bits)
    expected[np.isnan(values)] = 0x7FFF_FFFF_FFFF_FFFF
    assert got == expected.tolist()


def test_rows_of_the_last_pass_are_bounded(spark, monkeypatch):
    """An outlier neither adds passes nor leaves more to count in the last one."""
    rng = random.Random(8)
    values = [40 + rng.random() for _ in range(5000)] + [1e12]
    seen = []
    whole = quantiles._holding_rank
    monkeypatch.setattr(quantiles, "_holding_rank", lambda counts: seen.append(counts.count()) or whole(counts))
    table = spark.createDataFrame([(v,) for v in values], "v double")
    found = exact_quantiles(table, ["v"], [0.5]).first()["quantile"]
    assert found == pytest.approx(np.percentile(values, 50), rel=1e-15)
    assert len(seen) == 4 and seen[2] <= 10 and seen[3] == 1


def _people(seed, people, n, box=0.02):
    rng = random.Random(seed)
    names = ["".join(rng.choices(string.ascii_lowercase, k=5)) for _ in range(people)]
    rows = []
    for _ in range(n):
        # One person has half of all pings.
        name = names[0] if rng.random() < 0.5 else rng.choice(names)
        place = (40 + rng.uniform(-box, box), -3.7 + rng.uniform(-box, box))
        rows.append(ping(name, place, "10:00:00"))
    return rows


def _ranking(rows, lat, lon, k):
    nearest = {}
    for r in rows:
        d = metres(lat, lon, r[1], r[2])
        nearest[r[0]] = min(d, nearest.get(r[0], d))
    return sorted((d, name) for name, d in nearest.items())[:k]


def _targets(spark, points):
    return spark.createDataFrame(points, "point_id int, rand_lat double, rand_lon double")


@pytest.mark.parametrize("people, k", [(40, None), (40, 3), (3, None), (200, 1)])
def test_nearest_people(spark, people, k):
    rows = _people(people, people, 400)
    rng = random.Random(3)
    points = [(i, 40 + rng.uniform(-0.03, 0.03), -3.7 + rng.uniform(-0.03, 0.03)) for i in range(1, 8)]
    points.append((8, -33.0, 151.0))
    table = pings(spark, rows + [ping("", (40, -3.7), "10:00:00")])
    found = sampling.nearest_candidates(table, _targets(spark, points), k).collect()
    got = {(r["point_id"], r["nearest_rank"]): (r["distance"], r["id"]) for r in found}
    assert len(got) == len(found)
    expected = {
        (i, rank): pair
        for i, lat, lon in points
        for rank, pair in enumerate(_ranking(rows, lat, lon, k or len(points)), 1)
    }
    assert {key: name for key, (_, name) in got.items()} == {key: name for key, (_, name) in expected.items()}
    assert all(got[key][0] == pytest.approx(d, abs=1e-4) for key, (d, _) in expected.items())


def test_rings_hold_enough_wherever_the_target_is(spark):
    rng = random.Random(12)
    names = [f"p{i:03}" for i in range(300)]
    rows = [ping(n, (rng.gauss(0, 1) ** 3 * 10, rng.uniform(-180, 180)), "10:00:00") for n in names]
    rows += [ping(n, (89.99 - i * 1e-3, i * 40.0 - 170), "10:00:00") for i, n in enumerate(names[:9])]
    rows += [ping(n, (0.001 * i, 180 - 0.001 * i), "10:00:00") for i, n in enumerate(names[20:40])]
    points = [(1, 0.0, 179.9999), (2, 0.0, -179.9999), (3, 90.0, 0.0), (4, -90.0, 10.0), (5, 45.0, 45.0), (6, 0.0, 0.0)]
    for k in (1, 7, 60):
        found = sampling.nearest_candidates(pings(spark, rows), _targets(spark, points), k).collect()
        got = {(r["point_id"], r["nearest_rank"]): r["distance"] for r in found}
        for i, lat, lon in points:
            for rank, (d, _) in enumerate(_ranking(rows, lat, lon, k), 1):
                assert got[i, rank] == pytest.approx(d, abs=1e-3)


def test_two_thousand_points_ask_for_few_people(spark, monkeypatch):
    """People in villages, so that points far from each other want the same ones."""
    rng = random.Random(21)
    villages = [(40 + rng.uniform(-1, 1), -3.7 + rng.uniform(-1, 1)) for _ in range(60)]
    rows = []
    for i in range(6000):
        lat, lon = villages[int(rng.paretovariate(1)) % 60]
        rows.append(ping(f"p{i:04}", (lat + rng.gauss(0, 0.02), lon + rng.gauss(0, 0.02)), "10:00:00"))
    n = 2000
    points = [(i, 40 + rng.uniform(-1, 1), -3.7 + rng.uniform(-1, 1)) for i in range(1, n + 1)]
    asked, whole = [], sampling._picks_in_turn
    monkeypatch.setattr(sampling, "_picks_in_turn", lambda lists: asked.append(lists.count()) or whole(lists))
    found = {r["point_id"]: r["id"] for r in sampling.spread_picks(pings(spark, rows), _targets(spark, points)).collect()}
    lat, lon = np.radians([r[1] for r in rows]), np.radians([r[2] for r in rows])
    free = np.ones(len(rows), dtype=bool)
    for i, y, x in points:
        h = np.sin((lat - np.radians(y)) / 2) ** 2 + np.cos(lat) * np.cos(np.radians(y)) * np.sin((lon - np.radians(x)) / 2) ** 2
        best = int(np.argmin(np.where(free, h, 9)))
        free[best] = False
        assert found[i] == rows[best][0], i
    assert max(asked) < n * n / 10


def test_picks_take_turns_without_repeats(spark):
    rows = _people(4, 30, 200)
    points = [(i, 40.0 + i * 1e-4, -3.7) for i in range(1, 11)]
    candidates = sampling.nearest_candidates(pings(spark, rows), _targets(spark, points))
    found = {r["point_id"]: r["id"] for r in sampling.pick_without_repeats(candidates).collect()}
    taken = []
    for i, lat, lon in points:
        taken.append(next(name for _, name in _ranking(rows, lat, lon, 99) if name not in taken))
    assert [found[i] for i, *_ in points] == taken


def test_fewer_people_than_points(spark):
    rows = [ping(name, (40.0, -3.7), "10:00:00") for name in "abc"]
    sample = sampling.balanced_sample(pings(spark, rows), sampling.unit_points(spark, 5))
    assert sorted(r["id"] for r in sample.collect()) == ["a", "b", "c"]
    assert sampling.first_points(sample, 2).count() == 2


def test_no_pings_no_picks(spark):
    sample = sampling.balanced_sample(pings(spark, []), sampling.unit_points(spark, 5))
    assert sample.count() == 0


def test_planes(spark):
    import datetime

    rows = _people(6, 5, 101)
    late = datetime.date(2024, 1, 2)
    table = pings(spark, rows + [ping("z", (70.0, 70.0), "10:00:00", late)])
    lats, lons = [r[1] for r in rows], [r[2] for r in rows]
    assert tuple(sampling.plane_minmax(table, "2024-01-01").first()) == (min(lats), max(lats), min(lons), max(lons))
    assert sampling.plane_minmax(table).first()["max_lat"] == 70.0
    box = sampling.plane_percentile(table, day="2024-01-01").first()
    expected = [*np.percentile(lats, [35, 65]), *np.percentile(lons, [35, 65])]
    assert list(box) == pytest.approx(expected, abs=1e-9)
    rough = sampling.plane_percentile(table, day="2024-01-01", approximate=True).first()
    assert list(rough) == pytest.approx(expected, abs=1e-3)


def test_unit_points_and_targets(spark):
    points = sampling.unit_points(spark, 50)
    rows = {r["point_id"]: (r["x"], r["y"]) for r in points.collect()}
    assert sorted(rows) == list(range(1, 51))
    assert rows[1] == pytest.approx((2 * 0.7548776662466927 - 1, 2 * 0.5698402909980532 - 1))
    later = {r["point_id"]: (r["x"], r["y"]) for r in sampling.unit_points(spark, 5, start=11).collect()}
    assert later[1] == rows[11]
    plane = spark.createDataFrame([(0.0, 10.0, 100.0, 200.0)], "min_lat double, max_lat double, min_lon double, max_lon double")
    literal = sampling.points_from_rows(spark, [(1, -1.0, 1.0), (2, 0.0, 0.5)])
    found = sorted(tuple(r) for r in sampling.target_points(literal, plane).collect())
    assert found == [(1, 10.0, 100.0), (2, 7.5, 150.0)]
    unit = sorted(tuple(r) for r in sampling.target_points(literal, plane, unit_range=(0, 1)).collect())
    assert unit[1] == (2, 5.0, 100.0)


def test_points_are_checked_against_their_schema(spark):
    with pytest.raises(Exception):
        sampling.points_from_rows(spark, [("one", 0.0, 0.0)])


def test_many_picks_equal_the_turns_one_by_one(spark):
    rng = random.Random(9)
    wanted = {i: rng.sample(range(2500), 12) for i in range(1, 2001)}
    rows = [(i, rank, str(p)) for i, people in wanted.items() for rank, p in enumerate(people, 1)]
    table = spark.createDataFrame(rows, "point_id int, nearest_rank int, id string")
    taken, expected = set(), {}
    for i, people in wanted.items():
        for p in people:
            if p not in taken:
                taken.add(p)
                expected[i] = str(p)
                break
    assert {r["point_id"]: r["id"] for r in sampling.pick_without_repeats(table).collect()} == expected


def test_later_passes_take_images_of_values_in_question_only(spark, monkeypatch):
    asked, whole = [], quantiles.with_image
    monkeypatch.setattr(quantiles, "with_image", lambda df, *names: asked.append(df) or whole(df, *names))
    frame = spark.range(1000).selectExpr("if(id < 990, id + 0.5D, if(id < 995, double('NaN'), -0D)) AS v")
    (found,) = quantiles.exact_quantiles(frame, ["v"], [0.5]).collect()
    assert found.quantile == 495.0
    assert asked[0].count() == 1000 and asked[-1].count() <= 2
