"""Quality rules whose cutoffs are set by risk control on labelled documents.

A rule rejects a document when a ratio of counts reaches the rule's cutoff in the
document's stratum (the language). Labelled documents are dealt into two halves. One half
designs: a rule takes part if some cutoff of it catches enough bad documents for its price in good
ones, and a level of it is as severe as few good documents reach it. A document is as severe as its
most severe level, so one threshold on severity gives a cutoff for every rule, and lower
thresholds reject less. The other half holds out: thresholds are tried from the most severe
on, as long as the exact (Clopper-Pearson) upper bound on the share of good documents that the rules
reject together is at most RISK. The doubt is divided by the number of strata (Bonferroni); within
one, rejections only grow along the sequence, so it ends at the first bound that fails and
needs no further correction. Of the thresholds that hold, the one is taken that catches most
bad documents, a falsely rejected good one counting as PRICE of them.

So with a chance of 1 - DOUBT no stratum loses more than RISK of its good documents
to all rules together. A stratum with few labels, or none, rejects nothing beyond the base rules.
Counts are grouped and cutoffs chosen by stratum in Spark, and joined to the documents; any
number of strata will do.

Defined results: null or empty text has no words and fails the base rules; a null
language is a stratum of its own; labels of unknown documents, null labels and
labels other than 0 and 1 are left out; a document labelled twice counts with both.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pingtrace.llm.inputs import fold, table
from pingtrace.llm.text_stats import with_counts
from pingtrace.sources.staging import broadcast_if_small, staged

MIN_WORDS = 20
MOST_REPEATED = 30  # percent of the words
RISK = 0.01
DOUBT = 0.05
PRICE = 20
LEVELS = 200
NEVER = 2.0  # severity of a level that rejects nobody

#: Ratios between 0 and 1, by the names of their counts.
RATIOS = {
    "symbols": ("n_symbols", "word_chars"),
    "duplicate_lines": ("n_dup_lines", "n_lines"),
    "repeated_words": ("n_repeat_words", "n_words"),
    "adjacent_words": ("n_adjacent", "n_words"),
    "upper_case": ("n_upper", "n_letters"),
    "marks": ("n_marks", "word_chars"),
    "digits": ("n_digits", "word_chars"),
    "long_words": ("n_long_words", "n_words"),
}
COUNTS_OF_RATIOS = {c for counts in RATIOS.values() for c in counts}


def upper_bound(failures: int, n: int, doubt: float) -> float:
    """Clopper-Pearson: the largest rate at which so few failures have a chance of `doubt`."""
    if n == 0 or failures >= n:
        return 1.0

    def chance(rate: float) -> float:
        """P(X <= failures), added up from the largest term."""
        log_term = (
            math.lgamma(n + 1)
            - math.lgamma(failures + 1)
            - math.lgamma(n - failures + 1)
            + failures * math.log(rate)
            + (n - failures) * math.log1p(-rate)
        )
        total, part, odds = 0.0, 1.0, (1 - rate) / rate
        for k in range(failures, -1, -1):
            total += part
            part *= k / (n - k + 1) * odds
            if part < total * 1e-17:
                break
        return math.exp(log_term) * total

    low, high = failures / n, 1.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if chance(middle) > doubt else (low, middle)
    return high


def severities(good: list[int], bad: list[int]) -> list[float]:
    """Severity of each level of a rule: the share of good documents at it or above. NEVER for a rule without use."""
    n, total_bad = sum(good), sum(bad)
    found, best, rejected, caught = [NEVER] * len(good), 0.0, 0, 0
    for level in range(len(good) - 1, 0, -1):
        rejected += good[level]
        caught += bad[level]
        found[level] = (rejected + 1) / (n + 1)
        best = max(best, caught / max(total_bad, 1) - PRICE * rejected / max(n, 1))
    return found if best > 0 else [NEVER] * len(good)


def choose_threshold(severity: list[float], good: list[int], bad: list[int], doubt: float) -> float | None:
    """The severity up to which documents are rejected; ascending severities with their documents."""
    n, total_bad = sum(good), sum(bad)
    best, threshold, rejected, caught = 0.0, None, 0, 0
    for value, of_good, of_bad in zip(severity, good, bad, strict=True):
        rejected += of_good
        caught += of_bad
        if value >= NEVER or upper_bound(rejected, n, doubt) > RISK:
            break
        gain = caught / max(total_bad, 1) - PRICE * rejected / n
        if gain > best:
            best, threshold = gain, value
    return threshold


def level(rule: str) -> Column:
    part, whole = RATIOS[rule]
    ratio = F.col(part) / F.greatest(F.col(whole), F.lit(1))
    return F.least(F.floor(ratio * LEVELS), F.lit(LEVELS)).cast("int")


def _designs(held: DataFrame) -> DataFrame:
    """(stratum, severity): for each stratum the severities of all levels, by rule."""

    def design(rows: pd.DataFrame) -> pd.DataFrame:
        whole = []
        for rule in range(len(RATIOS)):
            good, bad = [0] * (LEVELS + 1), [0] * (LEVELS + 1)
            for r in rows[rows["rule"] == rule].itertuples():
                good[r.level], bad[r.level] = r.good, r.n - r.good
            whole.append(severities(good, bad))
        return pd.DataFrame({"stratum": [rows["stratum"].iloc[0]], "severity": [whole]})

    counts = (
        held.select("stratum", "good", F.posexplode("levels").alias("rule", "level"))
        .groupBy("stratum", "rule", "level")
        .agg(F.sum("good").alias("good"), F.count("*").alias("n"))
    )
    return counts.groupBy("stratum").applyInPandas(design, "stratum string, severity array<array<double>>")


def learn_cutoffs(stats: DataFrame, labels: DataFrame, stratum: str = "lang") -> DataFrame:
    """(stratum, cuts): for each stratum that rejects, every rule's lowest level that is rejected, staged."""
    known = labels.select("doc_id", F.col("quality").cast("int").alias("good")).where(F.col("good").isin(0, 1))
    levels = F.array(*[level(r) for r in RATIOS]).alias("levels")
    held = stats.select("doc_id", F.col(stratum).cast("string").alias("stratum"), levels).join(known, "doc_id")
    held = staged(held.withColumn("half", fold("doc_id", 2)), "quality-held")
    designs = staged(_designs(held.where("half = 0")), "quality-designs")
    doubt = DOUBT / max(held.select("stratum").distinct().count(), 1)

    severity = F.array_min(F.transform("levels", lambda x, i: F.col("severity")[i][x]))
    tested = (
        held.where("half = 1")
        .join(broadcast_if_small(designs).withColumnRenamed("stratum", "of"), F.col("stratum").eqNullSafe(F.col("of")))
        .groupBy("stratum", severity.alias("value"))
        .agg(F.sum("good").alias("good"), F.count("*").alias("n"))
    )

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("value")
        good = rows["good"].tolist()
        bad = (rows["n"] - rows["good"]).tolist()
        found = choose_threshold(rows["value"].tolist(), good, bad, doubt)
        out = pd.DataFrame({"stratum": [rows["stratum"].iloc[0]], "threshold": [found]})
        return out[out["threshold"].notna()]

    chosen = tested.groupBy("stratum").applyInPandas(choose, "stratum string, threshold double")
    lowest = F.transform(
        "severity",
        lambda by_level: F.array_min(
            F.transform(by_level, lambda x, i: F.when(x <= F.col("threshold"), i).otherwise(LEVELS + 1))
        ),
    )
    chosen = chosen.withColumnRenamed("stratum", "of")
    cuts = designs.join(chosen, F.col("stratum").eqNullSafe(F.col("of"))).select("stratum", lowest.alias("cuts"))
    return staged(cuts, "quality-cuts")


def rejected() -> Column:
    """Whether any rule's level reaches its cut (column `cuts`, null where nothing is rejected)."""
    fails = [level(r) >= F.col("cuts")[i] for i, r in enumerate(RATIOS)]
    return F.coalesce(F.array_max(F.array(*fails)), F.lit(False))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def apply_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, lang, all counts, base_failed and kept of every row.

    The texts are read once: their counts are staged, then used twice.
    """
    stats = staged(with_counts(docs, ("doc_id", "lang")), "quality-rules")
    cuts = broadcast_if_small(learn_cutoffs(stats, labels)).withColumnRenamed("stratum", "of")
    judged = stats.withColumn("base_failed", base_failed())
    judged = judged.join(cuts, F.col("lang").cast("string").eqNullSafe(F.col("of")), "left")
    return judged.withColumn("kept", ~(F.col("base_failed") | rejected())).drop("of", "cuts")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = apply_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )
