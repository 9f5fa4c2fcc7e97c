import random

import numpy as np
import pytest
from text_fixtures import SF_DIR, documents, odd_rows

from pingtrace.llm import decontamination
from pingtrace.llm.decontamination import LEAST_SCORE, align, clean, contaminated, op1_benchmark_decontamination


def plain_score(a, b):
    """Smith-Waterman, cell by cell."""
    rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            rows[i + 1][j + 1] = max(0, rows[i][j] + (2 if x == y else -1), rows[i][j + 1] - 1, rows[i + 1][j] - 1)
    return max(map(max, rows))


def test_align():
    chance = random.Random(1)
    for _ in range(200):
        a, b = ([chance.randint(1, 4) for _ in range(chance.randint(1, n))] for n in (12, 15))
        assert align(np.array(a, np.uint64), np.array([b], np.uint64))[0][0] == plain_score(a, b)


def benchmark(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")


@pytest.fixture(scope="module")
def tables(spark):
    chance = random.Random(3)
    vocabulary = [f"w{k}" for k in range(400)]
    items = [" ".join(chance.choices(vocabulary, k=chance.randint(20, 60))) for _ in range(20)]
    items += ["two words", None, "  ", "single", items[0]]
    rows = [(k, " ".join(chance.choices(vocabulary, k=200))) for k in range(100)]
    for k in range(60):  # one in six words replaced, dropped or doubled
        words = chance.choice(items[:20]).split()
        for _ in range(len(words) // 6):
            at = chance.randrange(len(words))
            words[at : at + 1] = chance.choice([["other"], [], [words[at], "more"]])
        rows.append((1000 + k, rows[k][1] + " " + " ".join(words).upper() + " " + rows[k + 1][1]))
    return rows + odd_rows(["x ", "y "], 20) + [(5000, "here are Two  words indeed"), (5001, None)], items


def test_against_alignment_of_everything(spark, tables):
    rows, items = tables
    got = {(r.doc_id, r.item_id): r.score for r in contaminated(documents(spark, rows), benchmark(spark, items)).collect()}
    split = [(i, (t or "").lower().split()) for i, t in rows]
    for item_id, item in enumerate(items):
        words = (item or "").split()
        for doc_id, text in split:
            if not words or not text or doc_id is None or len(text) > 500:
                continue
            if doc_id % 10 and doc_id < 1000:  # a tenth of those without a passage
                continue
            score = plain_score(words, text) / (2 * len(words)) if set(words) & set(text) else 0
            if score >= LEAST_SCORE and len(words) >= 2:
                assert got[(doc_id, item_id)] == pytest.approx(score)
            elif len(words) >= 20:
                assert (doc_id, item_id) not in got


def edited(chance, words, share, kinds):
    """A copy in which such a share of the words is replaced or dropped, or has a word put in before it."""
    result = []
    for k, word in enumerate(words):
        kind = chance.choice(kinds) if chance.random() < share else "keep"
        result += {"keep": [word], "replace": [f"r{k}"], "drop": [], "insert": [f"i{k}", word]}[kind]
    return result


def test_single_edited_copies(spark):
    """Each item stands in one document only, in an edited form: found just where the full alignment accepts it."""
    chance = random.Random(11)
    vocabulary = [f"w{k}" for k in range(3000)]
    items, rows = [], []
    kinds = (["replace"], ["insert"], ["drop"], ["replace", "insert", "drop"])
    for size in (40, 40, 25, 15, 6, 5, 3, 2):
        for share in (0.15, 0.2, 0.25):
            for kind in kinds:
                words = chance.choices(vocabulary, k=size)
                rows.append((len(items), " ".join(chance.choices(vocabulary, k=50) + edited(chance, words, share, kind))))
                items.append(" ".join(words))
    for step in (3, 4, 5):  # every so many words replaced
        words = chance.choices(vocabulary, k=40)
        rows.append((len(items), " ".join(w if k % step else f"r{k}" for k, w in enumerate(words))))
        items.append(" ".join(words))
    for most in (12, 28, 31, 33):  # words put in between almost all
        words = chance.choices(vocabulary, k=40)
        rows.append((len(items), " ".join(f"i{k} {w}" if 0 < k <= most else w for k, w in enumerate(words))))
        items.append(" ".join(words))
    found = {(r.doc_id, r.item_id): r for r in contaminated(documents(spark, rows), benchmark(spark, items)).collect()}
    qualifying = 0
    for k, text in rows:
        item = items[k].split()
        score = plain_score(item, text.split()) / (2 * len(item))
        qualifying += score >= LEAST_SCORE
        assert ((k, k) in found) == (score >= LEAST_SCORE)
        if score >= LEAST_SCORE:
            row = found[(k, k)]
            assert row.score == pytest.approx(score)
            passage = text.split()[row.first_word : row.end_word]
            assert passage[0] in item and passage[-1] in item
            assert plain_score(item, passage) / (2 * len(item)) == pytest.approx(score)
    assert qualifying > 60


def test_blocks_do_not_matter(spark, tables, monkeypatch):
    rows, items = tables
    frame, table = documents(spark, rows), benchmark(spark, items)
    whole = sorted(map(str, contaminated(frame, table).collect()))
    monkeypatch.setattr(decontamination, "BLOCK_GRAMS", 100)
    assert sorted(map(str, contaminated(frame, table).collect())) == whole


def test_clean(spark, tables):
    rows, items = tables
    frame, table = documents(spark, rows), benchmark(spark, items)
    found = {r.doc_id for r in contaminated(frame, table).collect()}
    kept = clean(frame, table)
    assert kept.columns == frame.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == sorted(
        (i is None, i or 0) for i, _ in rows if i not in found
    )
    assert {1000 + k for k in range(60)} <= found and not found & set(range(100))


def test_query_finds_whole_copies(spark):
    def flat(text):
        return f" {' '.join((text or '').lower().split())} "

    items = [(r.item_id, flat(r.text)) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    docs = [(r.doc_id, flat(r.text)) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]
    copies = {(d, i) for d, text in docs for i, item in items if item in text}
    got = {(r.doc_id, r.item_id): r.score for r in op1_benchmark_decontamination(spark, SF_DIR).collect()}
    assert copies and all(got[c] == 1 for c in copies)


def test_empty_tables(spark, tables):
    rows, items = tables
    assert contaminated(documents(spark, []), benchmark(spark, items)).collect() == []
    assert contaminated(documents(spark, rows), benchmark(spark, [])).collect() == []
    assert clean(documents(spark, rows), benchmark(spark, [])).count() == len(rows)
