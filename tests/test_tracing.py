import datetime
import random
from pathlib import Path

import pytest
from helpers import DAY, ids, ping, pings

from pingtrace.functions.geo import haversine_m, near_cube
from pingtrace.operators.contacts import close_contacts, contact_edges
from pingtrace.operators.exposure import contact_flags, session_labels, session_totals
from pingtrace.operators.stays import stays
from pingtrace.operators.summaries import geo_event_totals
from pingtrace.plans import job, reports, tracing
from pingtrace.sources import events, results
from pingtrace.sources.pings import write_pings
from pingtrace.sources.staging import StageScope, folder_exists, new_folder, shared_folder, staged

SF_DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def lasting(spark):
    return tracing.lasting_stays_by_day(events.daily_pings(spark, SF_DIR))


@pytest.fixture(scope="module")
def edges(spark, lasting):
    return staged(contact_edges(lasting), "edges", ("iso_date",))


def test_known_counts(spark, lasting, edges):
    assert lasting.count() == 1075
    total = edges.selectExpr("sum(total_exposure_time)", "count_if(total_exposure_time >= 30)", "count(*)").first()
    assert total[0] == pytest.approx(135777.667, abs=0.001)
    assert tuple(total)[1:] == (538, 604)


def test_known_cascade(spark, lasting, edges):
    seeds = ids(spark, ["0", "1", "2"])
    reached = tracing.exposure_cascade(lasting, seeds, DAY, days=15)
    counts = [r["total_infected"] for r in tracing.daily_reach(reached, 14).orderBy("day").collect()]
    assert counts == [3, 3, 5, 5, 5, 6, 6, 6, 7, 7, 7, 9, 9, 9, 10]
    along = tracing.cascade_over_edges(edges, seeds, DAY, days=15)
    assert sorted(map(tuple, along.collect())) == sorted(map(tuple, reached.collect()))
    # More seeds reach nobody later.
    more = tracing.exposure_cascade(lasting, ids(spark, ["0", "1", "2", "7", "8"]), DAY, days=8)
    first = {r["id"]: r["first_day"] for r in reached.collect() if r["first_day"] < 8}
    sooner = {r["id"]: r["first_day"] for r in more.collect()}
    assert all(sooner[id] <= day for id, day in first.items())


def test_nobody_is_reached_from_nobody(spark, lasting):
    assert tracing.exposure_cascade(lasting, ids(spark, []), DAY, days=3).count() == 0
    assert tracing.exposure_cascade(lasting, ids(spark, ["nobody", None, "nobody"]), DAY, days=3).count() == 1


def test_known_sessions(spark):
    table = staged(stays(events.weekly_pings(spark, SF_DIR)), "weekly")
    cohort = ids(spark, [str(i) for i in range(10)])
    contacts = close_contacts(table.join(cohort, "id", "left_semi"), table, cohort, overlapping=True)
    flags = staged(contact_flags(contacts), "flags")
    assert flags.count() == 1785 and flags.where("consecutive_close = 1").count() == 1025
    assert session_totals(session_labels(flags)).count() == 1652
    assert session_totals(session_labels(flags, literal=True)).count() == 1691


def test_a_chain_works_forwards_in_time_only(spark):
    def together(people, latitude, day):
        date = DAY + datetime.timedelta(days=day)
        return [ping(id, (latitude, -3.7), time, date) for id in people for time in ("10:00:00", "11:00:00")]

    rows = together("qt", 40.0, 0) + together("pq", 40.0, 1) + together("rs", 40.1, 1) + together("qr", 40.0, 2)
    table = staged(stays(pings(spark, rows)), "chain")
    expected = {("p", 0, 0), ("q", 1, 1), ("r", 2, 2)}
    for block_rows in (1, 10_000):
        reached = tracing.exposure_cascade(table, ids(spark, ["p"]), DAY, block_rows=block_rows)
        assert {tuple(r) for r in reached.collect()} == expected


def test_geo_totals_of_the_cohort_of_each_day(spark, lasting):
    rng = random.Random(1)
    rows = [
        ping(str(rng.randrange(6)), (float(rng.randrange(3)), 1.0), f"10:{i % 60:02}:00", DAY + datetime.timedelta(days=i % 4))
        for i in range(300)
    ]
    table = pings(spark, rows)
    reached = spark.createDataFrame([("0", 0, 0), ("1", 1, 1), ("2", 3, 1)], tracing.REACHED_SCHEMA)
    found = tracing.cohort_geo_totals(table, reached, DAY, by_day=True).collect()
    first_day = {"0": 0, "1": 1, "2": 3}
    expected = []
    for day in range(4):
        date = DAY + datetime.timedelta(days=day)
        members = [id for id, d in first_day.items() if d < day or (day == 0 and d == 0)]
        names = ", ".join(f"'{m}'" for m in members)
        part = stays(table.where(f"iso_date = '{date}' AND id IN ({names})"))
        expected += [(day, *r) for r in geo_event_totals(part).collect()]
    assert sorted(map(tuple, found)) == sorted(expected)


def test_whole_job_from_files_to_files(spark, tmp_path):
    write_pings(events.daily_pings(spark, SF_DIR), str(tmp_path / "pings"))
    job.run(spark, str(tmp_path / "pings"), str(tmp_path / "out"), DAY, days=4, people=5, timestamp="ts")
    daily = results.read_daily_counts(spark, str(tmp_path / "out" / "daily_infected.csv")).collect()
    assert [r["day"] for r in daily] == [0, 1, 2, 3]
    counts = [r["total_infected"] for r in daily]
    assert counts[0] == 5 and counts == sorted(counts)
    totals = results.read_geo_totals(spark, str(tmp_path / "out" / "daily_geoloc_evts.csv"))
    reached, _, _ = job.spread(events.daily_pings(spark, SF_DIR), DAY, days=4, people=5)
    first_day = {r["id"]: r["first_day"] for r in reached.collect()}
    expected = 0
    for r in events.daily_pings(spark, SF_DIR).select("id", "iso_date").collect():
        day = (r["iso_date"] - DAY).days
        if day < 4 and r["id"] in first_day:
            expected += first_day[r["id"]] < day or day == first_day[r["id"]] == 0
    assert totals.selectExpr("sum(tot_evts)").first()[0] == expected > 0


def _staged_now(spark):
    root = Path(shared_folder(spark).removeprefix("file:")) / "pingtrace"
    return {p.name for p in root.iterdir()} if root.exists() else set()


def test_reports_share_one_cascade_and_leave_nothing(spark, monkeypatch):
    runs, whole = [], reports.exposure_cascade
    monkeypatch.setattr(reports, "exposure_cascade", lambda *a: runs.append(1) or whole(*a))
    pings = events.daily_pings(spark, SF_DIR)
    seeds = ids(spark, ["0", "1", "2"])
    before = _staged_now(spark)
    with reports.CascadeReports(pings, seeds, DAY, days=15) as made:
        counts = [r["total_infected"] for r in made.daily_reach().orderBy("day").collect()]
        totals = sorted(map(tuple, made.geo_totals().collect()))
        by_day = made.geo_totals(by_day=True).collect()
        reached = made.reached.collect()
        assert len(_staged_now(spark) - before) == 1
    assert _staged_now(spark) == before and len(runs) == 1
    assert counts == [3, 3, 5, 5, 5, 6, 6, 6, 7, 7, 7, 9, 9, 9, 10]
    again = spark.createDataFrame(reached, tracing.REACHED_SCHEMA)
    within = pings.where(f"iso_date < date '{DAY + datetime.timedelta(days=15)}'")
    assert totals == sorted(map(tuple, tracing.cohort_geo_totals(within, again, DAY).collect()))
    assert sum(r["tot_evts"] for r in by_day) == sum(t[2] for t in totals)
    with pytest.raises(RuntimeError):
        reports.CascadeReports(pings, seeds, DAY).daily_reach()


def test_scopes_nest_and_end(spark):
    with StageScope(spark) as outer:
        mine = staged(spark.range(3), "mine")
        with StageScope(spark) as inner:
            assert new_folder(spark, "x").startswith(inner.folder)
            staged(spark.range(2), "theirs")
            assert folder_exists(spark, inner.folder)
        assert not folder_exists(spark, inner.folder)
        assert mine.count() == 3 and new_folder(spark, "x").startswith(outer.folder)
    assert not folder_exists(spark, outer.folder)
    assert "scope-" not in new_folder(spark, "x")


def test_a_job_that_fails_leaves_no_result(spark, tmp_path, monkeypatch):
    write_pings(events.daily_pings(spark, SF_DIR), str(tmp_path / "pings"))
    out = tmp_path / "out"

    def fails(totals, path, mode="error"):
        results.write_lines(spark.createDataFrame([("half",)], "line string"), path)
        raise OSError("disk full")

    before = _staged_now(spark)
    run = {"timestamp": "ts", "days": 2, "people": 3}
    with monkeypatch.context() as patch:
        patch.setattr(job, "write_geo_totals", fails)
        with pytest.raises(OSError, match="disk full"):
            job.run(spark, str(tmp_path / "pings"), str(out), DAY, **run)
    assert [p.name for p in tmp_path.iterdir()] == ["pings"] and _staged_now(spark) == before
    job.run(spark, str(tmp_path / "pings"), str(out), DAY, **run)
    held = sorted(p.name for p in out.iterdir())
    assert held == ["daily_geoloc_evts.csv", "daily_infected.csv"]
    with pytest.raises(FileExistsError):
        job.run(spark, str(tmp_path / "pings"), str(out), DAY, **run)
    with monkeypatch.context() as patch:
        patch.setattr(job, "write_geo_totals", fails)
        with pytest.raises(OSError):
            job.run(spark, str(tmp_path / "pings"), str(out), DAY, mode="overwrite", **run)
    assert sorted(p.name for p in out.iterdir()) == held
    assert results.read_daily_counts(spark, str(out / "daily_infected.csv")).count() == 2
    job.run(spark, str(tmp_path / "pings"), str(out), DAY, mode="overwrite", **(run | {"days": 3}))
    assert results.read_daily_counts(spark, str(out / "daily_infected.csv")).count() == 3
    assert sorted(p.name for p in tmp_path.iterdir()) == ["out", "pings"]


def test_people_absent_for_days_are_handed_on(spark):
    """Someone reached is seen again only after days away, and reaches others then."""

    def together(people, latitude, day, hour=10):
        date = DAY + datetime.timedelta(days=day)
        return [ping(id, (latitude, -3.7), f"{h}:00:00", date) for id in people for h in (hour, hour + 1)]

    rows = together("pq", 40.0, 1) + together("xy", 40.0, 2) + together("qr", 41.0, 7)
    rows += together("rs", 40.0, 8) + together("ps", 42.0, 8, hour=12)
    table = staged(stays(pings(spark, rows)), "away")
    for block_rows in (1, 10_000):
        reached = tracing.exposure_cascade(table, ids(spark, ["p"]), DAY, block_rows=block_rows)
        assert {tuple(r) for r in reached.collect()} == {("p", 0, 0), ("q", 1, 1), ("r", 7, 2), ("s", 8, 1)}
        edges = staged(contact_edges(table), "edges", ("iso_date",))
        along = tracing.cascade_over_edges(edges, ids(spark, ["p", None]), DAY)
        assert sorted(map(tuple, along.collect())) == sorted(map(tuple, reached.collect()))


def test_large_days_give_the_same_as_edges(spark):
    """People in parts, across cubes, between spans and over several hops, with null ids and stays that come twice."""
    rng = random.Random(5)
    rows = []
    for day in range(4):
        date = DAY + datetime.timedelta(days=day)
        for person in [None, *map(str, range(70))]:
            for _ in range(rng.randrange(3)):
                place = (40.0 + rng.randrange(12) * 0.00003, -3.7 + rng.randrange(4) * 0.00003)
                begin = rng.randrange(0, 600)
                for minute in (begin, begin + rng.choice((5, 12, 29, 30, 31, 36, 45, 90, 400))):
                    rows.append(ping(person, place, f"{minute // 60:02}:{minute % 60:02}:{rng.randrange(60):02}", date))
    once = tracing.with_length(stays(pings(spark, rows)))
    for table in (staged(once, "once"), staged(once.unionAll(once.where("id IN ('3', '4', '20')")), "twice")):
        seeds = ids(spark, ["0", "1"])
        edges = staged(contact_edges(table), "edges")
        expected = sorted(map(str, tracing.cascade_over_edges(edges, seeds, DAY).collect()))
        assert len({r.split("hop=")[1] for r in expected}) > 2
        for block_rows in (1, 4000):
            found = tracing.exposure_cascade(table, seeds, DAY, block_rows=block_rows, large_day=0)
            assert sorted(map(str, found.collect())) == expected


def test_crowds_at_one_place_are_settled_without_pairs(spark, monkeypatch):
    compared, plain = [], tracing.near_pairs

    def counting(left, right, *args, **kwargs):
        compared.append(sorted(r["id"] for r in right.select("id").distinct().collect()))
        return plain(left, right, *args, **kwargs)

    monkeypatch.setattr(tracing, "near_pairs", counting)
    date = DAY + datetime.timedelta(days=1)
    rows = [ping(f"p{i}", (40.0, -3.7), time, date) for i in range(40) for time in ("10:00:00", "12:00:00")]
    rows += [ping("beside", (40.00007, -3.7), time, date) for time in ("10:00:00", "12:00:00")]
    rows += [ping("short", (40.0, -3.7), time, date) for time in ("10:00:00", "10:20:00")]
    table = staged(stays(pings(spark, rows)), "crowd")
    reached = tracing.exposure_cascade(table, ids(spark, ["p0", "p1"]), DAY, large_day=0)
    assert sorted((r["id"], r["hop"]) for r in reached.collect()) == sorted(
        [("p0", 0), ("p1", 0), ("beside", 1), *((f"p{i}", 1) for i in range(2, 40))]
    )
    assert compared == [["beside"]]


def test_near_cubes_hold_only_what_is_near(spark):
    rng = random.Random(2)
    rows = [(lat, lon) for lat0, lon0 in ((40, -3.7), (89.9999, 7), (-89.99995, 179.9999), (0, 180))
            for lat, lon in ((lat0 + rng.uniform(-1e-4, 1e-4), lon0 + rng.uniform(-1e-4, 1e-4)) for _ in range(150))]
    rows += [(float("nan"), 1.0), (None, 1.0), (1.0, None), (95.0, 1.0), (1.0, 200.0)]
    points = spark.createDataFrame(rows, "lat double, lon double").selectExpr("*", *near_cube("lat", "lon", 10.0))
    assert points.where("kx IS NULL OR ky IS NULL OR kz IS NULL").count() >= 5
    points = staged(points, "cubes")
    a, b = (points.selectExpr("kx", "ky", "kz", f"lat AS {s}_lat", f"lon AS {s}_lon") for s in "ab")
    met = a.join(b, ["kx", "ky", "kz"]).selectExpr(f"{haversine_m('a_lat', 'a_lon', 'b_lat', 'b_lon')} AS d")
    most, many = met.selectExpr("max(d)", "count(*)").first()
    assert most <= 10.0 and many > 1000


def test_edges_by_day_hold_one_way_and_give_both(spark, edges):
    by_day = tracing.edges_by_day(edges)
    assert sorted(map(str, by_day.select(*edges.columns).collect())) == sorted(map(str, edges.collect()))
    written = spark.read.parquet(*by_day.inputFiles())
    assert written.count() * 2 == edges.count()
