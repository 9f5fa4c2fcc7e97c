"""Age of cases and their expected course."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pingtrace.functions.geo import number

# Fixed values: (first day, number of days, weight of the whole block) of the
# waiting times until death and until recovery.
DEATH_BLOCKS = [(4, 3, 0.025), (7, 19, 0.95), (26, 5, 0.25)]
RECOVERY_BLOCKS = [(7, 3, 0.025), (10, 26, 0.95), (36, 5, 0.025)]
DEATH_PROBABILITY = 0.05
LAST_CASE_DAY = 40


def case_age(cases: DataFrame, until: datetime.date | str) -> DataFrame:
    """(id, report_date, days) for each day from onset to `until`; onset is day 1.

    Cases with an onset after `until` have no row.
    """
    last = f"date '{until}'"
    return (
        cases.where(f"onset_date <= {last}")
        .selectExpr("id", "onset_date", f"explode(sequence(onset_date, {last})) AS report_date")
        .selectExpr("id", "report_date", "datediff(report_date, onset_date) + 1 AS days")
    )


def _share_by(days: str, blocks: list[tuple[int, int, float]]) -> str:
    """Share of the waiting times that are over by this day."""
    total = sum(weight for _, _, weight in blocks)
    parts = [
        f"greatest(0, least({length}, {days} - {first - 1})) * {number(weight / length / total)}"
        for first, length, weight in blocks
    ]
    return f"least(1D, {' + '.join(parts)})"


def case_curve(spark: SparkSession) -> DataFrame:
    """Expected state of one case on each day since onset, 40 rows.

    `death_hazard` and `recovery_hazard` are the chances on the day itself.
    Each day death is drawn first, then recovery for who is left.
    """
    # A single window group on purpose: one row per day of a case's life.
    up_to = Window.orderBy("days").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        spark.range(1, LAST_CASE_DAY + 1)
        .selectExpr(
            "cast(id AS int) AS days",
            f"{_share_by('id', DEATH_BLOCKS)} * {number(DEATH_PROBABILITY)} AS death_hazard",
            f"{_share_by('id', RECOVERY_BLOCKS)} AS recovery_hazard",
        )
        .withColumn("active", F.product(F.expr("(1D - death_hazard) * (1D - recovery_hazard)")).over(up_to))
        .selectExpr("*", "coalesce(lag(active) OVER (ORDER BY days), 1D) AS before")
        .selectExpr(
            "* EXCEPT (before)",
            "before * death_hazard AS deaths",
            "before * (1D - death_hazard) * recovery_hazard AS recoveries",
        )
    )


def case_outlook(cases: DataFrame) -> DataFrame:
    """Expected (active, deaths, recoveries) by date over the life of all cases.

    Cases are counted by onset before the curve is applied, so the join sees one
    row per onset date instead of one per case.
    """
    onsets = cases.groupBy("onset_date").agg(F.expr("count(*) AS new_cases"))
    curve = F.broadcast(case_curve(cases.sparkSession))
    by_age = onsets.selectExpr("*", f"explode(sequence(1, {LAST_CASE_DAY})) AS days").join(curve, "days")
    return by_age.groupBy(F.expr("date_add(onset_date, days - 1) AS report_date")).agg(
        *[F.expr(f"sum(new_cases * {c}) AS {c}") for c in ("active", "deaths", "recoveries")]
    )
