import hashlib
import random
import tracemalloc
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from text_fixtures import SF_DIR, documents, odd_rows

from pingtrace.llm import suffix_dedup
from pingtrace.llm.suffix_dedup import _in_suffix_order, dedup, op6_suffix_dedup

WORDS = ["ab", "ba", "a", "é", " ", "abba", "bb", "\n", "the end of it", "😀"]


def plain(rows, length, keep_first=False):
    raw = [(t or "").encode() for _, t in rows]
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is not None, rows[k][0] or 0))
    times, first = Counter(), {}
    for k in order:
        for at in range(len(raw[k]) - length + 1):
            window = raw[k][at : at + length]
            times[window] += 1
            first.setdefault(window, (k, at))
    result = Counter()
    for k, text in enumerate(raw):
        gone = bytearray(len(text))
        for at in range(len(text) - length + 1):
            window = text[at : at + length]
            if times[window] > 1 and not (keep_first and first[window] == (k, at)):
                gone[at : at + length] = b"\1" * length
        kept = bytes(b for b, g in zip(text, gone, strict=True) if not g)
        spans = sum(g and not (at and gone[at - 1]) for at, g in enumerate(gone))
        result[(rows[k][0], len(text), len(text) - len(kept), spans, hashlib.sha256(kept).hexdigest())] += 1
    return result


def digest(frame):
    return Counter(
        (r.doc_id, r.n_bytes, r.n_bytes - len(r.kept), len(r.spans), hashlib.sha256(r.kept).hexdigest())
        for r in frame.collect()
    )


@pytest.mark.parametrize("most_contexts", [10_000, 2])
@pytest.mark.parametrize("keep_first", [False, True])
def test_small_windows(spark, keep_first, most_contexts):
    rows = odd_rows(WORDS, 200, most=25)
    if keep_first:  # rows equal in id and text have no order
        rows = list(dict(enumerate(dict.fromkeys(r for r in rows if r[0] is not None))).values())
        rows = list({i: (i, t) for i, t in rows}.values())
    frame = documents(spark, rows)
    got = digest(dedup(frame, length=20, gram=8, keep_first=keep_first, most_contexts=most_contexts))
    assert got == plain(rows, 20, keep_first)


@pytest.mark.parametrize("bits", [7, 9])
def test_texts_longer_than_the_place_bits(spark, monkeypatch, bits):
    """Places of a text that do not fit beside the hashes: pieces give the same."""
    monkeypatch.setattr(suffix_dedup, "_PLACE_BITS", bits)
    chance = random.Random(bits)
    middle = "".join(chance.choices("abcdefgh é", k=600))
    rows = [(1, "x" + middle + "yz" * 90), (2, middle[50:500]), (3, "q" * 400), (4, middle[:130] + "w" + middle[300:420]), (5, None)]
    got = digest(dedup(documents(spark, rows), length=40, gram=8))
    assert got == plain(rows, 40)


def test_a_very_long_text(spark):
    chance = random.Random(5)
    noise = "".join(chance.choices("abcdefghijklmnopqrstuvwxyz ", k=2_000_000))
    rows = [(1, noise + noise[1_000_000:1_000_500] + "!" + noise[:300]), (2, noise[5000:5399]), (3, noise[77_000:77_450])]
    found = {r.doc_id: (r.n_bytes, [(s.begin, s.end) for s in r.spans]) for r in dedup(documents(spark, rows)).collect()}
    assert found[1][1] == [(77_000, 77_450), (1_000_000, 1_000_500), (2_000_000, 2_000_500)]
    assert found[2] == (399, []) and found[3] == (450, [(0, 450)])


def test_ids_of_any_type(spark):
    rows = [(1, "ab" * 40), (2, "ab" * 40), (None, "c")]
    frame = documents(spark, rows)
    for kind in ("string", "smallint", "decimal(10,0)", "date"):
        typed = frame.withColumn("doc_id", F.expr("date '2024-01-01' + cast(doc_id AS int)") if kind == "date" else F.col("doc_id").cast(kind))
        assert sorted(len(r.kept) for r in dedup(typed, length=20, gram=8).collect()) == [0, 0, 1]


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]
    assert Counter(map(tuple, op6_suffix_dedup(spark, SF_DIR).collect())) == plain(rows, 400)


@pytest.mark.parametrize("keep_first", [False, True])
def test_an_anchor_of_many_contexts_takes_memory_by_their_bytes(spark, keep_first):
    """Each task holds an anchor's contexts at once, so little more than their bytes may be held with them."""
    chance, gram = np.random.default_rng(4), b"-" * 64
    # Neighbours have no letter in common, so what they share ends where it is meant to.
    around = [chance.integers(97 + 13 * (k % 2), 110 + 13 * (k % 2), 672, dtype=np.uint8).tobytes() for k in range(3000)]
    contexts = [a[:336] + gram + a[336:] for a in around]
    for k in range(0, 1000, 2):  # 400 bytes in common with the next, from the k-th byte on
        at = k % 337
        contexts[k] = contexts[k][:at] + contexts[k + 1][at : at + 400] + contexts[k][at + 400 :]
    judge = {}

    class Laid:
        """Stands for the rows of one task."""

        def __getattr__(self, name):
            return lambda *a, **k: self

        def mapInArrow(self, function, schema):
            judge["bundles"] = function

    _in_suffix_order(Laid(), 400, keep_first)
    rows = [
        {"anchor": 1, "h1": k, "h2": k, "low": 10, "place": 346, "single": True, "bytes": c} for k, c in enumerate(contexts)
    ]
    batch = suffix_dedup.pa.RecordBatch.from_pylist(rows)
    tracemalloc.start()
    found = [r for part in judge["bundles"](iter([batch])) for r in part.to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    want = [(k, 10 + k // 2 * 2 % 337, 410 + k // 2 * 2 % 337) for k in range(1000) if k % 2 or not keep_first]
    assert [(r["h1"], r["begin"], r["end"]) for r in found] == want
    assert peak < 15 * sum(map(len, contexts))


def test_empty_table(spark):
    assert dedup(documents(spark, [])).collect() == []
