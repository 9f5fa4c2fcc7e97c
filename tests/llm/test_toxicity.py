import random
from collections import Counter

import numpy as np
import pytest
from text_fixtures import SF_DIR, documents, odd_rows

from pingtrace.llm import toxicity
from pingtrace.llm.toxicity import DECAY, MOST_GAP, THRESHOLD, features, held_out, kernel, letters, op5_toxicity, score_toxicity

INSULTS = ["blockhead", "nitwit", "dunderpate"]
SYLLABLES = ["an", "or", "the", "ing", "ble", "sh", "ou", "re", "st", "ea"]


def clean_word(chance):
    return "".join(chance.choices(SYLLABLES, k=chance.randint(1, 4)))


@pytest.fixture(scope="module")
def rows():
    chance = random.Random(5)
    found = []
    for k in range(900):
        words = [clean_word(chance) for _ in range(60)]
        if k % 5 == 0:
            for _ in range(3):
                words.insert(chance.randrange(60), chance.choice(INSULTS))
        found.append((k, " ".join(words)))
    return found


def labels(spark, rows):
    table = [(i, 1, int(any(w in t for w in INSULTS))) for i, t in rows] + [(None, 0, 1), (5, None, None), (10**9, 1, 1), (6, 1, 7)]
    return spark.createDataFrame(table, "doc_id long, quality int, toxic int")


def plain_kernel(a, b):
    """Sum over equal triples of letters, gaps allowed, divided by the words' own measure."""

    def triples(word):
        found = Counter()
        for i in range(len(word)):
            for j in range(i + 1, min(i + 1 + MOST_GAP, len(word))):
                for k in range(j + 1, min(j + 1 + MOST_GAP, len(word))):
                    found[word[i] + word[j] + word[k]] += DECAY ** (k - i)
        return found

    def measure(word):
        n, total = len(word), 0.0
        for i in range(n):
            for j in range(i + 1, min(i + 1 + MOST_GAP, n)):
                for k in range(j + 1, min(j + 1 + MOST_GAP, n)):
                    total += DECAY ** (2 * (k - i))
        return max(total, 1e-9) ** 0.5

    x, y = triples(a), triples(b)
    return sum(v * y[t] for t, v in x.items()) / measure(a) / measure(b)


def test_kernel():
    words = ["idiot", "idxiot", "iidiot", "abc", "acb", "ab", "banana", "thereof"]
    got = kernel(features(words), features(words))
    want = [[plain_kernel(a, b) for b in words] for a in words]
    assert np.allclose(got, want)


def test_words():
    codes, bounds, rows = letters(["A-b c", "", "i d i o t ok", "x y", "été　ça"])
    words = ["".join(chr(97 + c) if c < 26 else "?" for c in codes[b:e]) for b, e in zip(bounds[:-1], bounds[1:], strict=True)]
    assert words == ["ab", "c", "idiot", "ok", "x", "y", "?t?", "?a"]
    assert rows.tolist() == [0, 0, 2, 2, 3, 3, 4, 4]


def test_learns_and_tolerates(spark, rows):
    frame = documents(spark, rows)
    fold = held_out()
    scorer = toxicity.train(frame, labels(spark, rows), fold)
    judged = score_toxicity(frame, labels(spark, rows), fold).collect()
    held = {r.doc_id for r in frame.where(fold).collect()}
    texts = dict(rows)
    assert held and all(
        (r.score >= THRESHOLD) == any(w in texts[r.doc_id] for w in INSULTS) for r in judged if r.doc_id in held
    )
    odd = ["you nit-wit", "n i t w i t", "nittwit you", "blockkhead", "block*head", "the ou shing"]
    assert (scorer.chances(scorer.margins(odd)) >= THRESHOLD).tolist() == [True] * 5 + [False]


@pytest.mark.parametrize("share", [0.01, 0.02])
def test_flipped_labels(spark, rows, share):
    """Wrong labels, and a clean document that quotes every insult, take none of them away."""
    chance = random.Random(9)
    quoting = [(10_000 + k, " ".join(INSULTS) + " the ou shing anor") for k in range(3)]
    table = [(i, 1, int(any(w in t for w in INSULTS)) ^ (chance.random() < share)) for i, t in rows]
    known = spark.createDataFrame(table + [(i, 1, 0) for i, _ in quoting], "doc_id long, quality int, toxic int")
    fold = held_out()
    scorer = toxicity.train(documents(spark, rows + quoting), known, fold)
    assert (scorer.chances(scorer.margins([*INSULTS, "the ou shing"])) >= THRESHOLD).tolist() == [True] * 3 + [False]
    scores = scorer.chances(scorer.margins([t for _, t in rows]))
    assert np.mean((scores >= THRESHOLD) == [any(w in t for w in INSULTS) for _, t in rows]) > 0.98


def test_odd_texts_score(spark, rows):
    odd = odd_rows(["a ", "nitwit ", "é ", "!"], 50)
    scored = score_toxicity(documents(spark, rows + [(None if i is None else i + 10_000, t) for i, t in odd]),
                            labels(spark, rows), held_out()).collect()
    assert len(scored) == len(rows) + len(odd) and all(0 <= r.score <= 1 for r in scored)


def test_without_labels(spark, rows):
    frame = documents(spark, rows[:5])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.score for r in score_toxicity(frame, none, held_out()).collect()] == [0.0] * 5
    assert score_toxicity(documents(spark, []), labels(spark, rows), held_out()).collect() == []
    assert toxicity.keep_clean(frame, none).count() == 5


def test_query(spark):
    frame = op5_toxicity(spark, SF_DIR)
    assert frame.columns == ["doc_id", "held_out", "score", "predicted"]
    found = frame.collect()
    assert len(found) == 200 and all(r.predicted == (r.score >= 0.7) for r in found)


def test_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.1"
    known = spark.read.parquet(f"{sf_dir}/labels.parquet")
    found = op5_toxicity(spark, sf_dir).where("held_out").join(known, "doc_id").toPandas()
    right = (found.predicted == found.toxic).mean()
    assert right >= 0.95 and found[found.toxic == 1].predicted.mean() >= 0.8
