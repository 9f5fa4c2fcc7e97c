import datetime
import math
import random

import pytest
from helpers import DAY, ids, metres, stay, stays

from pingtrace.functions.geo import haversine_m, is_within, number, rounded, unit_vector
from pingtrace.functions.times import overlap_seconds, whole_seconds
from pingtrace.operators.contacts import (
    close_contacts,
    contact_edges,
    near_pairs,
    near_pairs_together,
    with_length,
)
from pingtrace.operators.exposure import contact_flags, session_labels, session_totals

A, NEAR, FAR = (40.0, -3.7), (40.00005, -3.7), (40.0002, -3.7)


def _pairs(df):
    return sorted((r["a_id"], r["b_id"]) for r in df.select("a_id", "b_id").collect())


def _brute(left, right, reach):
    return sorted((a[1], b[1]) for a in left for b in right if metres(a[2], a[3], b[2], b[3]) <= reach)


def _cluster(rng, lat, lon, spread, n, label):
    rows = []
    for i in range(n):
        y = max(-90.0, min(90.0, lat + rng.uniform(-spread, spread)))
        x = lon + rng.uniform(-spread, spread) / max(0.02, abs(math.cos(math.radians(y))))
        x = (x + 180) % 360 - 180
        rows.append(stay(i, f"{label}{i}", (y, x), "10:00:00", "11:00:00"))
    return rows


@pytest.mark.parametrize("reach", [10.0, 250.0])
def test_cell_join_finds_the_pairs_of_the_plain_join(spark, reach):
    rng = random.Random(int(reach))
    spread = 4 * reach / 111_000
    left, right = [], []
    for k, lat in enumerate((0.0, 40.0, -60.0, 80.0, -85.0, 89.9, 90.0, -90.0)):
        for lon in (0.0, -3.7, 180.0, -180.0):
            left += _cluster(rng, lat, lon, spread, 12, f"a{k}{lon}-")
            right += _cluster(rng, lat, lon, spread, 12, f"b{k}{lon}-")
    expected = _brute(left, right, reach)
    found = near_pairs(stays(spark, left), stays(spark, right), reach)
    assert len(expected) > 500
    assert _pairs(found) == expected


def test_across_a_pole_all_longitudes_are_near(spark):
    left = [stay(1, "p", (89.99997, 10.0), "10:00:00", "11:00:00")]
    right = [stay(1, f"q{x}", (89.99998, float(x)), "10:00:00", "11:00:00") for x in range(-180, 181, 15)]
    assert _pairs(near_pairs(stays(spark, left), stays(spark, right))) == _brute(left, right, 10.0)


def test_across_the_180_degree_meridian(spark):
    left = [stay(1, "p", (0.0, 179.99999), "10:00:00", "11:00:00")]
    right = [stay(1, "q", (0.0, -179.99999), "10:00:00", "11:00:00")]
    (row,) = near_pairs(stays(spark, left), stays(spark, right)).collect()
    assert row["distance"] == pytest.approx(2.224, abs=0.01)


def test_reach_of_a_continent_and_of_the_globe(spark):
    rng = random.Random(5)
    left = [stay(i, f"a{i}", (rng.uniform(-90, 90), rng.uniform(-180, 180)), "10:00:00", "11:00:00") for i in range(40)]
    right = [stay(i, f"b{i}", (rng.uniform(-90, 90), rng.uniform(-180, 180)), "10:00:00", "11:00:00") for i in range(40)]
    for reach in (3e6, 9e6, 1.5e7, 2.1e7):
        found = near_pairs(stays(spark, left), stays(spark, right), reach)
        assert _pairs(found) == _brute(left, right, reach)


def _timed(rng, n, label):
    rows = []
    for i in range(n):
        place = (40.0 + rng.choice([0, 0, 0, 0.00006, 0.0002]), -3.7 + rng.choice([0, 0.0001]))
        start = rng.randrange(80_000)
        end = start + rng.choice([0, 1, 600, 30_000])
        clock = [f"{s // 3600:02}:{s // 60 % 60:02}:{s % 60:02}" for s in (start, min(end, 86_399))]
        rows.append(stay(i, f"{label}{i}", place, *clock))
    return rows


def _brute_overlaps(left, right):
    found = []
    for a in left:
        for b in right:
            shared = (min(a[6], b[6]) - max(a[4], b[4])).total_seconds()
            if shared > 0 and metres(a[2], a[3], b[2], b[3]) <= 10:
                found.append((a[1], b[1]))
    return sorted(found)


@pytest.mark.parametrize("block_rows", [None, 3, 17, 10_000])
def test_overlapping_pairs_and_crowded_keys(spark, block_rows):
    rng = random.Random(9)
    left, right = _timed(rng, 90, "a"), _timed(rng, 130, "b")
    found = near_pairs(
        stays(spark, left), stays(spark, right), overlapping=True, block_rows=block_rows, probe_fraction=1.0
    )
    assert _pairs(found) == _brute_overlaps(left, right)
    all_pairs = near_pairs(stays(spark, left), stays(spark, right), block_rows=block_rows, probe_fraction=1.0)
    assert _pairs(all_pairs) == _brute(left, right, 10.0)


def test_crowded_keys_with_a_sampled_probe(spark):
    rng = random.Random(10)
    left, right = _timed(rng, 90, "a"), _timed(rng, 130, "b")
    found = near_pairs(
        stays(spark, left), stays(spark, right), overlapping=True, block_rows=5, probe_fraction=0.4
    )
    assert _pairs(found) == _brute_overlaps(left, right)


def _minutes(spark, first, second, **options):
    rows = [stay(1, "p", A, *first), stay(1, "q", NEAR, *second)]
    table = stays(spark, rows)
    contacts = close_contacts(table.where("id = 'p'"), table, ids(spark, ["p"]), **options)
    return [r["exposure_time"] for r in contacts.collect()]


def test_shared_time(spark):
    assert _minutes(spark, ("10:00:00", "11:00:00"), ("10:20:00", "10:50:00")) == [30.0]


def test_touching_and_disjoint_stays_share_nothing(spark):
    assert _minutes(spark, ("10:00:00", "11:00:00"), ("11:00:00", "12:00:00")) == [0.0]
    assert _minutes(spark, ("10:00:00", "11:00:00"), ("15:00:00", "16:00:00")) == [0.0]
    assert _minutes(spark, ("10:00:00", "11:00:00"), ("11:00:00", "12:00:00"), overlapping=True) == []


def test_seconds_are_cut_before_subtracting(spark):
    times = ("10:00:00.900", "10:30:00.100")
    assert _minutes(spark, times, times) == [30.0]
    assert _minutes(spark, times, times, overlapping=True) == [30.0]


def test_contact_columns_and_who_is_left_out(spark):
    rows = [
        stay(1, "p", A, "10:00:00", "11:00:00"),
        stay(1, "q", NEAR, "10:00:00", "11:00:00"),
        stay(1, "r", FAR, "10:00:00", "11:00:00"),
        stay(1, "s", NEAR, "10:00:00", "11:00:00"),
    ]
    table = stays(spark, rows)
    cohort = ids(spark, ["p", "s", None])
    contacts = close_contacts(table.join(cohort, "id", "left_semi"), table, cohort)
    assert sorted((r["i1"], r["i2"]) for r in contacts.collect()) == [("p", "q"), ("s", "q")]
    assert contacts.columns == [
        "i1",
        "i2",
        "i1_position",
        "track_position_counter_i1",
        "track_position_counter_i2",
        "i2_position",
        "distance",
        "i1_time",
        "i2_time",
        "exposure_time",
        "iso_date",
    ]
    assert contacts.schema["i1_position"].dataType.names == ["latitude", "longitude"]


def test_people_on_different_days_do_not_meet(spark):
    rows = [
        stay(1, "p", A, "10:00:00", "11:00:00"),
        stay(1, "q", A, "10:00:00", "11:00:00", DAY + datetime.timedelta(days=1)),
    ]
    assert contact_edges(stays(spark, rows)).count() == 0


def test_edges_are_symmetric_and_add_up(spark):
    rng = random.Random(11)
    rows = _timed(rng, 120, "p")
    edges = contact_edges(stays(spark, rows)).collect()
    found = {(r["i1"], r["i2"]): r["total_exposure_time"] for r in edges}
    assert len(found) == len(edges) > 50
    assert all(found[b, a] == minutes for (a, b), minutes in found.items())
    expected = [pair for pair in _brute_overlaps(rows, rows) if pair[0] != pair[1]]
    assert sorted(found) == expected
    split = contact_edges(stays(spark, rows), block_rows=4, probe_fraction=1.0).collect()
    assert {(r["i1"], r["i2"]): r["total_exposure_time"] for r in split} == found
    enough = contact_edges(stays(spark, rows), min_minutes=10).collect()
    assert {(r["i1"], r["i2"]) for r in enough} == {p for p, minutes in found.items() if minutes >= 10}


def test_contact_join_is_an_equi_join(spark):
    table = with_length(stays(spark, _timed(random.Random(1), 5, "p")))
    plan = contact_edges(table, block_rows=None)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def _wanderers(rng, n, label):
    """Stays of people who move between far and near places, one after the other."""
    rows = []
    for i in range(n):
        end = 0
        for counter in range(1, rng.randrange(2, 7)):
            start = end + rng.choice([0, 60, 9_000])
            end = start + rng.choice([1, 600, 7_000])
            place = (40.0 + rng.choice([0, 0.00005, 0.00011, 0.01]), -3.7 + rng.choice([0, 0.0001, 0.02]))
            clock = [f"{s // 3600:02}:{s // 60 % 60:02}:{s % 60:02}" for s in (start, end)]
            rows.append(stay(counter, f"{label}{i}", place, *clock))
    return rows


@pytest.mark.parametrize("crowded_from, block_rows", [(None, 9), (1, 4), (20, 9), (40, 1000), (10_000, 9)])
def test_pairs_found_together_are_those_found_apart(spark, crowded_from, block_rows):
    rng = random.Random(12)
    left, right = _wanderers(rng, 40, "a"), _wanderers(rng, 60, "b")
    left.append(stay(1, None, A, "10:00:00", "11:00:00"))
    tables = stays(spark, left), stays(spark, right)
    found = near_pairs_together(
        *tables, condition="a_id != b_id", crowded_from=crowded_from, block_rows=block_rows, probe_fraction=1.0
    )
    shown = ["a_id", "a_track_position_counter", "b_id", "b_track_position_counter"]
    plain = near_pairs(*tables, overlapping=True, condition="a_id != b_id")
    expected = sorted(tuple(r) for r in plain.select(*shown).collect())
    assert len(expected) > 500
    assert sorted(tuple(r) for r in found.select(*shown).collect()) == expected
    # All rows of a pair have the same keys.
    assert found.select("a_id", "b_id", "pair", "meeting").distinct().count() == len({(p[0], p[2]) for p in expected})


def test_crowds_shuffle_stays_not_contacts(spark):
    """Sessions and totals of a crowd are worked out where its stays meet."""
    rows = [stay(1, f"p{i}", A, "10:00:00", "11:00:00") for i in range(60_000)]
    table = stays(spark, rows).cache()
    contacts = close_contacts(table.where("id < 'p1'"), table, table.where("id < 'p1'").select("id"), together=True)
    sessions = session_totals(session_labels(contact_flags(contacts)))
    edges = contact_edges(table)
    for frame in (sessions, edges):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        above_join = plan[: plan.index("SortMergeJoin")]
        assert "Exchange" not in above_join


def _busy(rng, n, label):
    """Stays of people with up to 150 of them a day, some at a place of many."""
    rows = []
    for i in range(n):
        end = 0
        for counter in range(1, rng.choice([2, 70, 150])):
            start = end + rng.choice([0, 30, 400])
            end = start + rng.choice([1, 60, 300])
            place = (40.0 + rng.choice([0, 0.00005, 0.00009, 0.01]), -3.7)
            clock = [f"{s // 3600:02}:{s // 60 % 60:02}:{s % 60:02}" for s in (start, end)]
            rows.append(stay(counter, f"{label}{i}", place, *clock))
    return rows


def test_people_meet_before_their_stays_do(spark):
    """F1-F6: a crowd is compared as people, in rows of many stays, which are taken apart where two meet."""
    rng = random.Random(13)
    left, right = _busy(rng, 8, "a"), _busy(rng, 12, "b")
    open_end = stay(1, "a-open", A, "00:10:00", "00:11:00")
    left.append((*open_end[:6], None, open_end[7]))
    tables = stays(spark, left), stays(spark, right)
    shown = ["a_id", "a_track_position_counter", "b_id", "b_track_position_counter", "distance"]
    plain = near_pairs(*tables, overlapping=True, condition="a_id != b_id", block_rows=None)
    expected = sorted(tuple(r) for r in plain.select(*shown).collect())
    assert len(expected) > 500 and "a-open" in {r[0] for r in expected}
    for crowded_from, block_rows in ((1, 40), (20, 1000)):
        found = near_pairs_together(
            *tables, condition="a_id != b_id", crowded_from=crowded_from, block_rows=block_rows, probe_fraction=1.0
        )
        assert sorted(tuple(r) for r in found.select(*shown).collect()) == expected
    plan = found._jdf.queryExecution().executedPlan().toString()
    above_join = plan[: plan.index("SortMergeJoin")]
    assert "inline(a_stays" in above_join and "inline(b_stays" in above_join


@pytest.mark.parametrize("reach", [1e-3, 10.0, 5e6, 3e7])
def test_vectors_decide_as_the_distance_does(spark, reach):
    rng = random.Random(14)
    rows = []
    for _ in range(3_000):
        lat, lon = rng.choice([0.0, 40.0, 89.9999, -75.0]), rng.choice([0.0, -3.7, 179.99999])
        away = math.degrees(reach / 6_371_000) * rng.choice([0, 0.5, 1 - 1e-7, 1, 1 + 1e-7, 1 + 1e-5, 2])
        rows.append((lat, lon, max(-90.0, min(90.0, lat - away)), lon + rng.choice([0, away])))
    distance = haversine_m("a_lat", "a_lon", "b_lat", "b_lon")
    table = spark.createDataFrame(rows, "a_lat double, a_lon double, b_lat double, b_lon double")
    table = table.selectExpr("*", *unit_vector("a_lat", "a_lon", "a_"), *unit_vector("b_lat", "b_lon", "b_"))
    tested = table.selectExpr(f"{distance} <= {number(reach)} AS plain", f"{is_within('a_', 'b_', reach, distance)} AS quick")
    assert tested.where("coalesce(plain, false) != coalesce(quick, false)").count() == 0
    assert 0 < tested.where("plain").count()


def test_rounded_is_round(spark):
    rng = random.Random(15)
    rows = [rng.uniform(-1, 1) * 10.0 ** rng.randrange(-8, 14) for _ in range(5_000)]
    rows += [(10 * k + 5) / 1e7 for k in range(2_000)] + [k / 60 for k in range(5_000)]
    rows += [float("nan"), float("inf"), float("-inf"), -0.0, 1e300, -5e-7, None]
    table = spark.createDataFrame([(x,) for x in rows], "x double")
    assert table.where(f"NOT (({rounded('x', 6)}) <=> round(x, 6))").count() == 0


def test_shared_seconds_from_seconds_at_hand(spark):
    times = [None, *(datetime.datetime(2024, 1, 1, 10, 0, s, u) for s in (1, 2, 3) for u in (0, 400_000))]
    table = spark.createDataFrame([(t,) for t in times], "t timestamp_ntz")
    names = ("s1", "e1", "s2", "e2")
    rows = table.selectExpr("t AS s1")
    for name in names[1:]:
        rows = rows.crossJoin(table.selectExpr(f"t AS {name}"))
    rows = rows.selectExpr("*", *[f"{whole_seconds(n)} AS {n}_whole" for n in names])
    plain = (
        "(CASE WHEN e1 < s2 OR e2 < s1 THEN 0L "
        f"ELSE {whole_seconds('least(e1, e2)')} - {whole_seconds('greatest(s1, s2)')} END)"
    )
    quick = overlap_seconds(*names, seconds=tuple(f"{n}_whole" for n in names))
    assert rows.where(f"NOT ({plain} <=> {quick}) OR NOT ({plain} <=> {overlap_seconds(*names)})").count() == 0
