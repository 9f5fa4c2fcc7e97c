import random
import re
from collections import Counter, defaultdict

import numpy as np
import oracle
import pytest
from text_fixtures import SF_DIR, documents, odd_rows

from pingtrace.llm import phrases
from pingtrace.llm.phrases import Mining, collocations

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
WORDS = ["new ", "York ", "york, ", "city ", "a ", "b\t", "c. ", "d", "New  ", "\n", "é ", "ÄB ", "\x0b", "x\xa0y ", "漢 ", "; ", "--"]


def counts(rows, most):
    """f by language and word tuple."""
    f = defaultdict(Counter)
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            for n in range(1, most + 1):
                for i in range(len(words) - n + 1):
                    f["und" if lang is None else lang][tuple(words[i : i + n])] += 1
    return f


def plain(rows, mining):
    found = []
    for lang, f in counts(rows, mining.most).items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        candidates = {p: c for p, c in f.items() if len(p) >= mining.least and c >= mining.min_count}
        ranked = []
        for p, a in candidates.items():
            if any(
                len(q) > len(p) and 100 * c >= mining.share * a and any(q[i : i + len(p)] == p for i in range(len(q)))
                for q, c in candidates.items()
            ):
                continue
            score, k = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            ranked.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(ranked)[: mining.top]):
            found.append((lang, rank + 1, phrase.decode(), -a, left, right, n, -score))
    return sorted(found)


@pytest.fixture(scope="module")
def rows():
    return odd_rows(WORDS, 150, seed=3, most=60)


@pytest.mark.parametrize(
    "mining", [Mining(), Mining(min_count=3, top=20), Mining(min_count=2, least=2, most=5, share=70), Mining(least=3, most=4), Mining(least=2, most=2)]
)
def test_equals_counting_every_place(spark, rows, mining):
    frame = documents(spark, rows)
    langs = [(r.text, r.lang) for r in frame.select("text", "lang").collect()]
    got = [tuple(r) for r in collocations(frame, mining).collect()]
    assert sorted(got) == plain(langs, mining)
    assert got and any(g[0] == "und" for g in got)


def test_many_words_fill_a_small_bitmap(spark, monkeypatch):
    """Wrong bits let more phrases through to the count, and change nothing."""
    monkeypatch.setattr(phrases, "MAP_BITS", 8)
    monkeypatch.setattr(phrases, "GATHER_BYTES", 50)
    chance = random.Random(4)
    rows = [(k, " ".join(f"w{int(chance.paretovariate(0.5)) % 900}" for _ in range(300))) for k in range(40)]
    frame = documents(spark, rows)
    langs = [(r.text, r.lang) for r in frame.select("text", "lang").collect()]
    assert sorted(tuple(r) for r in collocations(frame, Mining(min_count=4)).collect()) == plain(langs, Mining(min_count=4))


def test_chunks_own_every_place_once():
    chance = random.Random(1)
    texts = ["".join(chance.choices(WORDS, k=chance.randint(0, 80))) for _ in range(60)]
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    offsets = np.cumsum([0, *map(len, raw)])
    for window in (1, 2, 4):
        chunks, last, row = phrases.parse_chunks(data, offsets, window)
        seen = defaultdict(Counter)
        for chunk, ends, r in zip(chunks.to_pylist(), last.tolist(), row.tolist(), strict=True):
            words = chunk.split(" ")
            for n in range(1, window + 2):
                for i in range(len(words) - (0 if ends else window)):
                    if i + n <= len(words):
                        seen[r][tuple(words[i : i + n])] += 1
        want = {r: counts([(t, "x")], window + 1)["x"] for r, t in enumerate(texts)}
        assert {r: c for r, c in want.items() if c} == dict(seen)
    assert not all(phrases.parse_chunks(data, offsets, 2)[1])


def test_products_beyond_64_bits(spark):
    levels = [
        spark.createDataFrame([("x", "a", 4 * 10**12), ("x", "b", 3 * 10**12 + 1)], "lang string, phrase string, f long"),
        spark.createDataFrame([("x", "a b", 2 * 10**12 + 7)], "lang string, phrase string, f long"),
    ]
    row = phrases.scored(levels, Mining(most=2)).first()
    assert row.score == 10**6 * (2 * 10**12 + 7) ** 2 // (4 * 10**12 * (3 * 10**12 + 1))


def test_query_equals_its_sql(spark):
    sf_dir = SF_DIR.replace("0.001", "0.01")
    found = phrases.op12_phrase_collocations(spark, sf_dir)
    expected, missing, extra = oracle.differences(found, oracle.connect(sf_dir), phrases.ORACLE_SQL)
    assert expected and not missing and not extra


def test_empty_table(spark):
    assert collocations(documents(spark, [])).collect() == []
    assert collocations(documents(spark, [(1, None), (2, " "), (3, "..")])).collect() == []
