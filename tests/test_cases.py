import datetime

import pytest

from pingtrace.operators import cases

# Share of deaths and recoveries that are over by a day.
DEATHS_BY = {3: 0.0, 4: 0.00680, 6: 0.02041, 7: 0.06122, 15: 0.38776, 25: 0.79592, 30: 1.0}
RECOVERIES_BY = {6: 0.0, 7: 0.00833, 9: 0.025, 15: 0.24423, 35: 0.975, 40: 1.0}


def _table(spark, onsets):
    return spark.createDataFrame(onsets, "id string, onset_date date")


def test_curve(spark):
    rows = {r["days"]: r for r in cases.case_curve(spark).collect()}
    assert sorted(rows) == list(range(1, 41))
    for day, share in DEATHS_BY.items():
        assert rows[day]["death_hazard"] == pytest.approx(0.05 * share, abs=1e-6)
    for day, share in RECOVERIES_BY.items():
        assert rows[day]["recovery_hazard"] == pytest.approx(share, abs=1e-5)
    left = 1.0
    for day in range(1, 41):
        row = rows[day]
        assert row["deaths"] == pytest.approx(left * row["death_hazard"])
        left *= (1 - row["death_hazard"]) * (1 - row["recovery_hazard"])
        assert row["active"] == pytest.approx(left)
    assert sum(r["deaths"] + r["recoveries"] for r in rows.values()) == pytest.approx(1.0)


def test_age_starts_at_one(spark):
    day = datetime.date(2024, 1, 30)
    late = day + datetime.timedelta(days=3)
    found = cases.case_age(_table(spark, [("p", day), ("q", late)]), datetime.date(2024, 2, 1)).collect()
    assert sorted((r["id"], r["report_date"].isoformat(), r["days"]) for r in found) == [
        ("p", "2024-01-30", 1),
        ("p", "2024-01-31", 2),
        ("p", "2024-02-01", 3),
    ]


def test_outlook_adds_up_to_the_cases(spark):
    first = datetime.date(2024, 1, 1)
    onsets = [(str(i), first + datetime.timedelta(days=i % 5)) for i in range(23)]
    rows = cases.case_outlook(_table(spark, onsets)).collect()
    assert len(rows) == 44
    assert sum(r["deaths"] + r["recoveries"] for r in rows) == pytest.approx(23)
    assert {r["report_date"]: r["active"] for r in rows}[first] == pytest.approx(5.0)
