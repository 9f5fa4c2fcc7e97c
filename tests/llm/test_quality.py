import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from text_fixtures import SF_DIR, documents, odd_rows

from pingtrace.llm.quality_classifier import Model, fit, op9_quality_classifier, pool_adjacent_violators, score_quality
from pingtrace.llm.inputs import fold
from pingtrace.llm.quality_rules import (
    COUNTS_OF_RATIOS,
    NEVER,
    RISK,
    apply_rules,
    choose_threshold,
    learn_cutoffs,
    op10_quality_rules,
    rejected,
    severities,
    upper_bound,
)
from pingtrace.llm.text_stats import with_counts

WORDS = ["a ", "bb ", "the ", "É", "#", "$|", "\n", "same line\n", "x y z w v u t s r ", "<>", " ", "😀 ", "1", "UP "]


def plain(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed by their definitions."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    windows = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
    times = Counter(windows)
    repeated = {k + j for k, w in enumerate(windows) if times[w] > 1 for j in range(8)}
    failed = len(words) < 20 or 100 * len(repeated) > 30 * len(words)
    symbols = sum(c in "#*$%&|<>" for c in text)
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(repeated), failed


def base(frame):
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    return Counter(map(tuple, frame.select(columns).collect()))


def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")


def test_base_counts(spark):
    rows = odd_rows(WORDS, 400, most=60)
    judged = apply_rules(documents(spark, rows), no_labels(spark))
    assert base(judged) == Counter((i, *plain(t)) for i, t in rows)
    assert judged.where("kept = base_failed").isEmpty()  # without labels only the base rules reject


def test_rules_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]
    assert base(op10_quality_rules(spark, SF_DIR)) == Counter((i, *plain(t)) for i, t in rows)


def test_upper_bound():
    assert upper_bound(0, 100, 0.05) == pytest.approx(1 - 0.05 ** (1 / 100), rel=1e-9)
    assert upper_bound(3, 3, 0.05) == 1 and upper_bound(0, 0, 0.05) == 1
    for failures, n in ((1, 10), (7, 500), (40, 60)):
        p, term, total = upper_bound(failures, n, 0.01), 0.0, 0.0
        for k in range(failures + 1):
            term = 1.0
            for j in range(k):
                term *= (n - j) / (j + 1)
            total += term * p**k * (1 - p) ** (n - k)
        assert total == pytest.approx(0.01, rel=1e-6)


def test_severities_and_threshold():
    good, bad = [0] * 201, [0] * 201
    good[3], bad[90], bad[3] = 5000, 40, 10
    found = severities(good, bad)
    assert found[0] == NEVER and found[3] == 1 and found[4] == found[200] == 1 / 5001
    assert severities(good, [0] * 201) == [NEVER] * 201 == severities(good, good)
    assert choose_threshold([0.0, 0.5, NEVER], [0, 5000, 0], [40, 0, 10], 0.001) == 0.0
    assert choose_threshold([0.0, 0.1], [400, 4600], [40, 10], 0.001) is None  # too many good ones
    assert choose_threshold([0.0, 0.1], [0, 300], [40, 10], 0.001) is None  # too few to prove it
    assert choose_threshold([], [], [], 0.001) is None


def junk(k):
    return " ".join(f"w{(k * 37 + j) % 900}{'###' if k % 4 == 0 else ''}" for j in range(40))


@pytest.fixture(scope="module")
def marked(spark):
    rows = [(k, junk(k)) for k in range(4000)]
    labels = [(k, int(k % 4 != 0), 0) for k in range(4000)] + [(None, 1, 0), (1, None, None), (10**9, 0, 0), (2, 5, 0)]
    return rows, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_risk_control_catches_junk_and_keeps_good(spark, marked):
    rows, labels = marked
    for r in apply_rules(documents(spark, rows), labels).collect():
        assert r.kept == (r.doc_id % 4 != 0)


def test_small_holdouts_keep_documents(spark, marked):
    rows, labels = marked
    judged = apply_rules(documents(spark, rows), labels.where("doc_id < 200"))
    assert judged.where("kept = base_failed").isEmpty()


def test_joint_risk_of_a_hundred_strata(spark):
    """All rules together reject at most RISK of the good documents to come, in every stratum."""
    strata, labelled, fresh = 100, 4000, 20_000
    rows = spark.range(strata * (labelled + fresh)).selectExpr(
        "id AS doc_id",
        f"concat('l', id % {strata}) AS lang",
        f"id < {strata * labelled} AS known",
        "pmod(xxhash64(id, 'bad'), 4) = 0 AS junk",
        "pmod(xxhash64(id, 'a'), 100000) / 1e5 AS a",
        "pmod(xxhash64(id, 'b'), 100000) / 1e5 AS b",
    )
    # Two rules whose levels have tails of their own, and do not go together.
    stats = rows.selectExpr(
        "doc_id",
        "lang",
        "known",
        "junk",
        "1000L AS word_chars",
        "1000L AS n_words",
        "cast(if(junk AND a < 0.4, 890 - 400 * b, 900 * pow(a, 60)) AS bigint) AS n_symbols",
        "cast(if(junk AND a > 0.4, 890 - 400 * b, 900 * pow(b, 60)) AS bigint) AS n_repeat_words",
        *[f"0L AS {c}" for c in sorted(COUNTS_OF_RATIOS - {"word_chars", "n_words", "n_symbols", "n_repeat_words"})],
    )
    labels = stats.where("known").selectExpr("doc_id", "cast(NOT junk AS int) AS quality", "0 AS toxic")
    cuts = learn_cutoffs(stats, labels)
    n_cut = cuts.count()
    assert n_cut >= strata / 2  # some cannot prove any cut at so many tests
    judged = stats.where("NOT known").join(cuts, stats.lang == cuts.stratum).withColumn("gone", rejected())
    rates = (
        judged.selectExpr("lang", "if(junk, NULL, cast(gone AS int)) AS good", "if(junk, cast(gone AS int), NULL) AS bad")
        .groupBy("lang")
        .agg(F.avg("good").alias("good"), F.avg("bad").alias("bad"))
    ).collect()
    assert len(rates) == n_cut
    assert all(r.good <= RISK for r in rates) and all(r.bad > 0.2 for r in rates)


def test_strata_without_labels_reject_nothing(spark, marked):
    rows, labels = marked
    frame = documents(spark, rows)
    elsewhere = frame.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "xx").otherwise("yy"))
    judged = apply_rules(elsewhere, labels.where("doc_id % 2 = 0"))
    assert judged.where("lang = 'yy' AND kept = base_failed").isEmpty()
    assert not judged.where("lang = 'xx' AND NOT kept AND NOT base_failed").isEmpty()


def test_few_good_documents_of_the_query_are_lost(spark):
    sf_dir = "/root/testdata/sf0.1"
    known = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1")
    good = op10_quality_rules(spark, sf_dir).join(known, "doc_id")
    lost = good.where("NOT kept AND NOT base_failed").count()
    assert lost <= RISK * good.count()


def test_isotonic():
    chance = np.random.default_rng(1)
    x, y = chance.random(300), chance.integers(0, 2, 300).astype(float)
    at, height = pool_adjacent_violators(x, y)
    assert (np.diff(at) > 0).all() and (np.diff(height) > 0).all()
    # Largest of all means from some place on, smallest over places up to it: the isotonic fit.
    order = np.argsort(x)
    ys = y[order]
    want = [max(min(ys[i : j + 1].mean() for j in range(k, 300)) for i in range(k + 1)) for k in range(0, 300, 50)]
    pools = np.searchsorted(at, x[order][::50])
    for k, w in enumerate(want):
        assert min(abs(height[max(pools[k] - 1, 0)] - w), abs(height[min(pools[k], len(height) - 1)] - w)) < 1e-9


def test_classifier_learns(spark, marked):
    rows, labels = marked
    held = fold("doc_id", 4) == 2
    scored = score_quality(documents(spark, rows), labels, held).collect()
    assert np.mean([(r.score >= 0.7) == (r.doc_id % 4 != 0) for r in scored]) > 0.99


def test_normal_equations_do_not_depend_on_partitions(spark, marked):
    rows, labels = marked
    frame = documents(spark, rows, extra=False)
    held = fold("doc_id", 4) == 2
    one, many = (fit(with_counts(frame.repartition(n)), labels, held) for n in (1, 7))
    assert isinstance(one, Model) and np.allclose(one.solution, many.solution, rtol=1e-4, atol=1e-6)


def test_classifier_on_odd_rows(spark, marked):
    rows, labels = marked
    odd = [(None if i is None else i + 10_000, t) for i, t in odd_rows(WORDS, 50)]
    held = fold("doc_id", 4) == 2
    scored = score_quality(documents(spark, rows + odd), labels, held).collect()
    assert len(scored) == len(rows) + len(odd) and all(0 <= r.score <= 1 for r in scored)
    none = score_quality(documents(spark, odd), no_labels(spark), held).collect()
    assert {r.score for r in none} == {0.5}
    assert {r.score for r in score_quality(documents(spark, rows), labels.where("quality = 1"), held).collect()} == {1.0}
    assert score_quality(documents(spark, []), labels, held).collect() == []
    assert apply_rules(documents(spark, []), labels).collect() == []


def test_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.1"
    known = spark.read.parquet(f"{sf_dir}/labels.parquet")
    found = op9_quality_classifier(spark, sf_dir).where("held_out").join(known, "doc_id").toPandas()
    assert (found.predicted == found.quality).mean() >= 0.96
