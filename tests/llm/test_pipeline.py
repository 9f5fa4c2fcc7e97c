"""Each stage of the pipeline against a plain version of its decision, on what its predecessor kept."""

import re

import duckdb
import pytest
from test_decontamination import plain_score
from test_jaccard_join import plain as plain_groups
from test_secret_scan import plain as plain_secrets

import corpus_pipeline
from pingtrace.llm import mixing, toxicity
from pingtrace.llm.decontamination import LEAST_SCORE
from pingtrace.llm.secret_scan import MASK
from pingtrace.sources.staging import staged

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kept(spark):
    frames = [spark.read.parquet(f"{SF_DIR}/documents.parquet")]
    for _, stage in corpus_pipeline.STAGES:
        frames.append(staged(stage(spark, frames[-1], SF_DIR), "test-stage"))
    return frames


def rows(frame):
    return {r.doc_id: r for r in frame.collect()}


def test_columns(kept):
    assert all(f.columns == kept[0].columns for f in kept[:-1])


def test_toxicity(spark, kept):
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    scores = toxicity.score_toxicity(kept[0], labels, toxicity.held_out()).collect()
    assert set(rows(kept[1])) == {r.doc_id for r in scores if r.score < toxicity.THRESHOLD}


def test_near_copies(kept):
    before = [(r.doc_id, r.text) for r in kept[1].collect()]
    _, groups, _ = plain_groups(before, 5, 80)
    assert set(rows(kept[2])) == {min(before[k][0] for k in g) for g in groups}


def test_contamination(spark, kept):
    items = [r.text.lower().split() for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    after = rows(kept[3])
    for doc_id, row in rows(kept[2]).items():
        words = (row.text or "").lower().split()
        near = [i for i in items if len(set(zip(i, i[1:], strict=False)) & set(zip(words, words[1:], strict=False))) * 4 > len(i)]
        assert (doc_id in after) == all(plain_score(i, words) / (2 * len(i)) < LEAST_SCORE for i in near)


def test_secrets(kept):
    before, after = rows(kept[3]), rows(kept[4])
    assert set(before) == set(after)
    for doc_id, row in after.items():
        found = sum(plain_secrets(before[doc_id].text)[:3])
        assert (MASK in row.text) == bool(found) and len(row.text) == row.n_chars
        if not found:
            assert row == before[doc_id]
        assert not re.search("AKIA[A-Z0-9]{16}|[0-9a-f]{24}", row.text)


def test_mix(spark, kept):
    connection = duckdb.connect()
    documents = kept[4].toPandas()  # noqa: F841
    connection.register("documents", documents)
    want = sorted(connection.sql(mixing.ORACLE_SQL).fetchall())
    columns = ["doc_id", "domain", "lang", "source", "n_tokens", "epochs"]
    assert sorted(map(tuple, kept[5].select(columns).collect())) == want


def test_run(spark, kept):
    got = corpus_pipeline.run(spark, SF_DIR)
    assert sorted(map(str, got.collect())) == sorted(map(str, kept[5].collect()))


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, SF_DIR), "test-stage")
    assert docs.collect() == []
