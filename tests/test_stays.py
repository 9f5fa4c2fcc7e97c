import datetime
import random

from helpers import DAY, at, collected_runs, ids, ping, pings, runs

from pingtrace.operators import stays as stays_module
from pingtrace.operators.stays import cohort_stays, stay_sequence, stays

A, B = (40.0, -3.7), (40.1, -3.7)


def test_return_to_a_place_is_a_new_stay(spark):
    rows = [ping("p", A, "10:00:00"), ping("p", A, "10:10:00"), ping("p", B, "10:20:00"), ping("p", A, "10:30:00")]
    found = collected_runs(stays(pings(spark, rows)))
    assert [(r[2], r[3], r[5]) for r in found] == [(1, 40.0, 2), (2, 40.1, 1), (3, 40.0, 1)]
    assert found[0][6:] == (at("10:00:00"), at("10:10:00"))


def test_single_ping_has_no_length(spark):
    ((*_, n, start, end),) = collected_runs(stays(pings(spark, [ping("p", A, "10:00:00")])))
    assert n == 1 and start == end


def test_stays_end_at_midnight(spark):
    next_day = DAY + datetime.timedelta(days=1)
    rows = [ping("p", A, "23:50:00"), ping("p", A, "00:10:00", next_day)]
    found = collected_runs(stays(pings(spark, rows)))
    assert [(r[1], r[2]) for r in found] == [(DAY, 1), (next_day, 1)]


def test_pings_at_the_same_time_go_by_position(spark):
    rows = [ping("p", B, "10:00:00"), ping("p", A, "10:00:00"), ping("p", A, "10:00:00"), ping("p", B, "10:01:00")]
    found = collected_runs(stays(pings(spark, rows)))
    assert [(r[2], r[3], r[5]) for r in found] == [(1, 40.0, 2), (2, 40.1, 2)]


def _random_pings(seed, people=6, n=600):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        # Half of all pings are of one person, and many are exact copies.
        id = "0" if rng.random() < 0.5 else str(rng.randrange(people))
        day = DAY + datetime.timedelta(days=rng.randrange(2))
        second = rng.choice([rng.randrange(86400), 3600 * rng.randrange(24)])
        time = (datetime.datetime.min + datetime.timedelta(seconds=second, microseconds=rng.randrange(3))).time()
        rows.append(ping(id, rng.choice([A, B]), time.isoformat(), day))
    return rows


def test_matches_brute_force(spark):
    rows = _random_pings(1)
    assert collected_runs(stays(pings(spark, rows))) == runs(rows)


def test_busy_person_days_are_cut_and_joined_up_again(spark):
    for seed, limit in ((2, 1), (3, 7), (4, 40)):
        rows = _random_pings(seed)
        assert collected_runs(stays(pings(spark, rows), split_above=limit)) == runs(rows)


def test_a_stay_over_several_slices_is_one_stay(spark):
    rows = [ping("p", A, f"{h:02}:00:00") for h in range(24)] + [ping("p", B, "23:59:59")]
    found = collected_runs(stays(pings(spark, rows), split_above=2))
    assert [(r[2], r[5]) for r in found] == [(1, 24), (2, 1)]


def test_copies_of_one_ping_are_one_stay(spark):
    rows = [ping("p", A, "10:00:00")] * 50
    ((*_, n, start, end),) = collected_runs(stays(pings(spark, rows), split_above=5))
    assert n == 50 and start == end


def test_sequence_numbers_match(spark):
    table = stays(pings(spark, _random_pings(5)))
    for limit in (None, 1, 9, 1000):
        assert collected_runs(stay_sequence(table.drop("track_position_counter"), limit)) == collected_runs(table)


def test_cohort_of_none_one_and_unknown_ids(spark):
    rows = [ping("p", A, "10:00:00"), ping("q", A, "10:00:00")]
    table = pings(spark, rows)
    assert collected_runs(cohort_stays(table, ids(spark, []))) == []
    assert collected_runs(cohort_stays(table, ids(spark, ["p", "p", "x", None]))) == runs(rows[:1])


def test_plain_plan_shuffles_and_sorts_once(spark):
    rows = spark.range(1000).selectExpr(
        "cast(id % 7 AS string) AS id",
        "cast(id % 3 AS double) AS latitude",
        "0D AS longitude",
        "timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 0, id) AS ts",
        "date'2024-01-01' AS iso_date",
    )
    plan = stays(rows, split_above=None)._jdf.queryExecution().executedPlan().toString()
    initial = plan.split("Initial Plan")[-1]
    assert initial.count("Exchange hashpartitioning") == 1
    assert initial.count("Sort [") == 1


def _odd_pings():
    """Null times and positions, NaN, both zeros, and equal times, of a busy and some other people."""
    rng = random.Random(11)
    values = [0.0, -0.0, 40.0, float("nan"), None]
    rows = []
    for k in range(300):
        time = None if rng.random() < 0.2 else at(f"{rng.randrange(4):02}:00:{rng.randrange(60):02}")
        id = rng.choice(["p", "p", "q", None])
        rows.append((id, rng.choice(values), rng.choice(values), time, DAY if k % 50 else None))
    return rows


def _as_text(frame):
    return sorted(str(tuple(r)).replace("-0.0", "0.0") for r in frame.collect())


def test_the_limit_for_splitting_does_not_change_the_result(spark):
    rows = _odd_pings()
    plain = stays(pings(spark, rows), split_above=None)
    expected = _as_text(plain)
    assert sum(r["tot_evts"] for r in plain.collect()) == len(rows)
    for limit in (1, 7, 100, 10_000):
        assert _as_text(stays(pings(spark, rows), split_above=limit)) == expected


def test_the_limit_does_not_change_the_sequence(spark):
    table = stays(pings(spark, _odd_pings()), split_above=None).drop("track_position_counter")
    distinct = table.dropDuplicates(["id", "iso_date", "start_position_time", "latitude", "longitude"])
    distinct.cache()
    expected = _as_text(stay_sequence(distinct, None))
    for limit in (1, 7, 10_000):
        assert _as_text(stay_sequence(distinct, limit)) == expected
    distinct.unpersist()


def test_a_sampled_probe_finds_the_busy_person_day(spark, monkeypatch):
    monkeypatch.setattr(stays_module, "PROBE_PINGS", 20)
    rows = _random_pings(6)
    assert collected_runs(stays(pings(spark, rows), split_above=100)) == runs(rows)
