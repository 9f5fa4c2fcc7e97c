"""Token counts by rank-synchronous merging of ragged arrays.

Pre-tokens of a batch lie end to end in one array of symbol ids. In every round
each pre-token finds its lowest-ranked adjacent pair and all its occurrences of
that pair are merged at once; a pre-token without a known pair is finished and
its surviving symbols are its count. A merge always makes a symbol whose own
merges come later in the list, so this ends in the same symbols as one merge at
a time.

Defined results: null or empty text has 0 bytes and 0 tokens; repeated rows are
counted each; a null id stays null; other columns of the input are not read.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pingtrace.llm.arrays import portions, utf8
from pingtrace.llm.inputs import table

TOKEN_LIMIT = 2048
KNOWN_WORDS = 600_000
_NEVER = np.int64(1) << 40


def _byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    symbols, spare = {b: chr(b) for b in printable}, 256
    for b in range(256):
        if b not in symbols:
            symbols[b] = chr(spare)
            spare += 1
    return [symbols[b] for b in range(256)]


class Vocabulary:
    """Merge table of a word-end BPE vocabulary file, as arrays small enough to ship to every worker."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        ids, end = model["vocab"], model["end_of_word_suffix"] or ""
        self.pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.width = max(ids.values()) + 1
        self.inner = np.array([ids[s] for s in _byte_symbols()], np.int64)
        self.last = np.array([ids[s + end] for s in _byte_symbols()], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([ids[a] * self.width + ids[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.made = np.array([ids[a + b] for a, b in pairs], np.int64)

    def pair_ranks(self, symbols: np.ndarray, ends: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Rank of the pair that begins at each of `places`; `ends` are the last symbols of the sequences."""
        last = np.zeros(len(symbols) + 1, dtype=bool)
        last[ends] = True
        key = symbols[places] * self.width + symbols[np.minimum(places + 1, len(symbols) - 1)]
        found = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[found] == key) & ~last[places], self.ranks[found], _NEVER)


def merged_lengths(symbols: np.ndarray, sizes: np.ndarray, vocabulary: Vocabulary) -> np.ndarray:
    """Number of symbols left of each sequence; `sizes` are the sequences' lengths in `symbols`."""
    left = sizes.copy()
    alive = np.flatnonzero(sizes > 1)
    symbols = symbols[np.repeat(sizes > 1, sizes)]
    rank = vocabulary.pair_ranks(symbols, np.cumsum(left[alive]) - 1, np.arange(len(symbols)))
    while len(alive):
        lengths = left[alive]
        starts = np.cumsum(lengths) - lengths
        best = np.minimum.reduceat(rank, starts)
        # Of a run of overlapping occurrences (a a a), every second one is merged, from the left.
        places = np.flatnonzero((rank == np.repeat(best, lengths)) & (rank != _NEVER))
        fresh = np.ones(len(places), dtype=bool)
        fresh[1:] = places[1:] != places[:-1] + 1
        run_start = np.maximum.accumulate(np.where(fresh, np.arange(len(places)), 0))
        places = places[(np.arange(len(places)) - run_start) % 2 == 0]
        owner = np.repeat(np.arange(len(alive)), lengths)
        left[alive] -= np.bincount(owner[places], minlength=len(alive))
        going = (best != _NEVER) & (left[alive] > 1)
        keep = going[owner]
        symbols[places] = vocabulary.made[rank[places]]
        touched = np.zeros(len(symbols), dtype=bool)
        touched[places] = True
        touched[np.maximum(places - 1, 0)] = True
        # A dropped right half may stand before another merge; its left neighbour is `places` itself.
        keep[places + 1] = False
        symbols, rank, touched = symbols[keep], rank[keep], touched[keep]
        alive = alive[going]
        again = np.flatnonzero(touched)
        rank[again] = vocabulary.pair_ranks(symbols, np.cumsum(left[alive]) - 1, again)
    return left


class Counter:
    """Counts tokens of texts; remembers the counts of words it has met.

    No pre-token contains white space, so a word between white space is looked up
    whole, and only new words are cut into pre-tokens and merged.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        # White space by Unicode property, as the vocabulary's own library has it.
        self.find = regex.compile(vocabulary.pattern.replace(r"\s", r"\t-\r\x85\p{Z}")).findall
        self.special = regex.compile("|".join(regex.escape(s) for s in vocabulary.special) or r"(?!)")
        # Python's split() also takes these four as white space.
        self.separators = regex.compile(r"[\x1c-\x1f]")
        self.known: dict[str, int] = {}

    def words(self, text: str) -> tuple[list[str], int]:
        """Words of the normalised text, and the number of special tokens between them."""
        parts = self.special.split(text) if "<" in text else [text]
        words: list[str] = []
        for part in parts:
            if not part.isascii():
                # Lower case is taken by single characters: no final form of sigma.
                part = unicodedata.normalize("NFC", part).replace("Σ", "σ")
            part = part.lower()
            words += self.find(part) if self.separators.search(part) else part.split()
        return words, len(parts) - 1

    def learn(self, words: list[str]) -> None:
        pieces = [[w] if w.isascii() and w.isalpha() else self.find(w) for w in words]
        raw = [p.encode() for found in pieces for p in found]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        data = np.frombuffer(b"".join(raw), np.uint8)
        symbols = self.vocabulary.inner[data]
        ends = np.cumsum(sizes) - 1
        symbols[ends] = self.vocabulary.last[data[ends]]
        total = np.concatenate([[0], np.cumsum(merged_lengths(symbols, sizes, self.vocabulary))])
        bounds = np.concatenate([[0], np.cumsum([len(found) for found in pieces])]).astype(np.int64)
        self.known.update(zip(words, np.diff(total[bounds]).tolist(), strict=True))

    def count(self, texts: list[str]) -> list[int]:
        if len(self.known) > KNOWN_WORDS:
            self.known = {}
        found = [self.words(t) for t in texts]
        new = set().union(*(words for words, _ in found)) - self.known.keys()
        if new:
            self.learn(list(new))
        known = self.known.__getitem__
        return [sum(map(known, words)) + specials for words, specials in found]


def count_tokens(
    docs: DataFrame, vocabulary_path: str, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """`key`, n_bytes and n_tokens of every row. One pass, no shuffle; the vocabulary has a fixed size."""
    vocabulary = Vocabulary(vocabulary_path)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(vocabulary)
        for batch in batches:
            for part in portions(batch, text):
                _, offsets = utf8(part.column(text))
                texts = [t or "" for t in part.column(text).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(key), pa.array(np.diff(offsets)), pa.array(counter.count(texts), pa.int64())],
                    [key, "n_bytes", "n_tokens"],
                )

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(count, f"{key} {kind}, n_bytes bigint, n_tokens bigint")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    counted = count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)
