import math
import random

import numpy as np
import oracle
import pytest
from text_fixtures import SF_DIR

from pingtrace.llm import bit_sliced_topk as topk

WIDTH = 6


def frame(spark, rows):
    """vec_id and embedding, with columns of clashing names."""
    made = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    return made.selectExpr("*", *[f"'x' as {c}" for c in "id v part place score rank ids width cut low slices".split()])


def plain(rows, queries, k):
    """(query_id, rank, id, score) of every query, by scoring all rows."""
    whole = []
    for i, v in rows:
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            whole.append((i, [max(-topk.LARGEST, min(topk.LARGEST, math.floor(256 * x))) for x in v]))
    found = []
    for q, w in whole:
        if not queries(q):
            continue
        scored = [(sum(a * b for a, b in zip(v, w, strict=False)), i) for i, v in whole if i is None or i != q]
        scored.sort(key=lambda x: (-x[0], x[1] is None, x[1] or 0))
        found += [(q, n + 1, i, s) for n, (s, i) in enumerate(scored[:k])]
    return sorted(found, key=str)


def rows_of(seed, n, spread=1.0):
    chance = random.Random(seed)
    rows = [(i, [chance.gauss(0, spread) for _ in range(WIDTH)]) for i in range(n)]
    rows += [(2000 + i, rows[i % 7][1]) for i in range(60)]  # one vector many times: ties
    return rows + [
        rows[0],  # a repeated query
        (None, rows[10][1]),
        (None, rows[10][1]),
        (5000, None),
        (5010, []),
        (5020, [1.0, None, 2.0]),
        (5030, [float("nan")] * WIDTH),
        (5040, [float("inf")] * WIDTH),
        (5050, [1.5, -2.0]),
        (5060, [0.0] * WIDTH),
        (5070, [1e300, -1e300, 1e-300, 0.0, 0.0, 0.0]),
        (-10, [-3.0] * WIDTH),
    ]


@pytest.mark.parametrize(("n", "k", "cells", "asked", "spread"), [(700, 5, 1 << 22, 1 << 21, 1.0), (300, 3, 64, 60, 40.0), (12, 90, 64, 60, 0.01)])
def test_equals_scoring_all_rows(spark, monkeypatch, n, k, cells, asked, spread):
    monkeypatch.setattr(topk, "BLOCK_CELLS", cells)
    monkeypatch.setattr(topk, "QUERY_CELLS", asked)
    rows = rows_of(n, n, spread)
    vectors = frame(spark, rows)
    found = topk.search(topk.build_index(vectors), vectors.where("vec_id % 10 = 0"), k)
    assert sorted(map(tuple, found.collect()), key=str) == plain(rows, lambda q: q is not None and q % 10 == 0, k)


def test_slices_add_up():
    chance = np.random.default_rng(5)
    vectors = chance.integers(-900, 900, (150, 9))
    low, cut, slices = topk.slice_block(vectors)
    query = topk.Query(1, chance.integers(-300, 300, 9))
    score = query.coarse(slices)
    bits = np.stack([np.unpackbits(s.view(np.uint8), bitorder="little")[:150] for s in score]).astype(np.int64)
    coarse = (bits << np.arange(len(score))[:, None]).sum(0)
    part = (vectors - low) >> cut
    part = np.where(query.negative, (1 << slices.shape[1]) - 1 - part, part)
    assert (coarse == part @ query.size).all()
    rows = topk._as_words(np.ones(150, np.uint8))
    for k in (1, 5, 150):
        assert topk.kth_highest(score, rows, k) == np.sort(coarse)[-k]
    assert topk.kth_highest(score, rows, 151) is None
    for bound in (-5, 0, int(np.median(coarse)), int(coarse.max()), int(coarse.max()) + 1, 1 << 40):
        assert topk._count(topk.at_least(score, rows, bound)) == (coarse >= bound).sum()


def test_few_rows_are_resolved_exactly():
    """The slices leave little to score: the method is not a scan beside an index."""
    chance = np.random.default_rng(6)
    vectors = np.floor(256 * chance.normal(0, 0.125, (20_000, 64))).astype(np.int64)
    low, cut, slices = topk.slice_block(vectors)
    import pyarrow as pa

    block = topk.Block(pa.array(range(20_000), pa.int64()), 64, cut, low.tobytes(), vectors.astype(np.int32).tobytes(), slices.tobytes())
    for i in range(5):
        assert len(block.candidates(topk.Query(i, vectors[i]), 5, None)) < 1000


def test_query_equals_its_sql(spark):
    found = topk.op13_bit_sliced_topk(spark, SF_DIR)
    expected, missing, extra = oracle.differences(found, oracle.connect(SF_DIR), topk.ORACLE_SQL)
    assert expected and not missing and not extra


def test_empty_table(spark):
    vectors = frame(spark, [])
    assert topk.search(topk.build_index(vectors), vectors).collect() == []
    some = frame(spark, [(1, [1.0])])
    assert topk.search(topk.build_index(vectors), some).collect() == []
    assert topk.search(topk.build_index(some), some).collect() == []
