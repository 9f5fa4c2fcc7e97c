import public_tokenizers
import pytest
from text_fixtures import SF_DIR, documents, odd_rows
from tokenizers import Tokenizer

from pingtrace.llm.token_counts import count_tokens, op4_token_counts

PATH = public_tokenizers.path("word_bpe_49k.json")
WORDS = ["it's", " we'll", "THE ", "éÉ", "ΑΣ ", "ΟΔΟΣ", "12 ", "½", "aaaa", "!!", " ", "\n", "\x1c", "\x85", "漢字", "😀",
         "<|endoftext|>", "<|startoftext|>", "<|", "İ", "é", "ﬁ", "_", "'S"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_counts_equal_the_library(spark, library):
    rows = odd_rows(WORDS, 400)
    got = sorted(map(tuple, count_tokens(documents(spark, rows), PATH).collect()), key=str)
    texts = [t or "" for _, t in rows]
    sizes = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    want = sorted(((i, len((t or "").encode()), n) for (i, t), n in zip(rows, sizes, strict=True)), key=str)
    assert got == want


def test_query(spark, library):
    frame = op4_token_counts(spark, SF_DIR)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    for r in frame.collect():
        n = len(library.encode(texts[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_tokens, r.over_limit) == (n, n > 2048)


def test_empty_table(spark):
    assert count_tokens(documents(spark, []), PATH).collect() == []
