"""Benchmark decontamination: rare n-gram seeds find candidates, alignment decides.

1. Every n-gram of words of the test items is counted in the corpus: in how many
   documents it occurs. Partitions count on their own and the counts are summed.
2. An alignment that scores LEAST_SCORE holds at least `hits` of its item's n-grams
   whole, however its edits lie (`_needs`). So all n-grams that occur are seeds but
   for the `hits` - 1 most frequent: an alignment cannot do with those alone.
3. Every document is searched for the seeds. A seed with so many n-grams of its item
   around it, as far as an alignment can reach, is a candidate place, and the words
   within that reach are aligned with the item's words by Smith-Waterman (match 2,
   mismatch and gap -1), which scores copies with replaced, dropped or inserted
   words. The score is the alignment's share of the item's own, so 1 is a whole
   copy. No alignment of LEAST_SCORE is missed.

The items travel to the tasks in blocks of at most BLOCK_GRAMS n-grams, so the
corpus is passed over once per block and step; nothing of the documents comes to
the driver, and no document is shuffled.

Defined results: words are lower-cased (A-Z) runs without ASCII white space; null
and blank items match nothing; equal items are aligned each; null and empty documents
match nothing; repeated rows and null ids are judged each. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pingtrace.llm.arrays import LOWER, gram_hashes, portions, utf8, word_hashes
from pingtrace.llm.inputs import table

BLOCK_GRAMS = 500_000
LEAST_SCORE = 0.6
MATCH, MISS, GAP = 2, -1, -1
_CELLS = 2_000_000


def _needs(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of items of so many words: the words of an n-gram, how many n-grams an alignment of LEAST_SCORE
    holds at least, and how many words it can insert.

    m matched words and e edits score 2m - e, and e edits leave at most e + 1 runs, so m - e - 1
    pairs of neighbours. Items for which that may be none are sought by single words.
    """
    least = np.ceil(LEAST_SCORE * MATCH * sizes - 1e-9).astype(np.int64)
    pairs = least - sizes - 1
    return np.where(pairs > 0, 2, 1), np.where(pairs > 0, pairs, -(-least // MATCH)), MATCH * sizes - least


def _grams(words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text and place of every n-gram."""
    sizes = np.diff(bounds)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    wanted = _needs(sizes)[0][owner]
    hashes, texts, places = [], [], []
    for n in (1, 2):
        grams = gram_hashes(words, n)
        at = np.flatnonzero((wanted[: len(grams)] == n) & (owner[: len(grams)] == owner[n - 1 :][: len(grams)]))
        hashes.append(grams[at])
        texts.append(owner[at])
        places.append(at - bounds[owner[at]])
    return np.concatenate(hashes), np.concatenate(texts), np.concatenate(places)


@dataclass
class Block:
    """Some test items: their ids, words, and n-grams sorted by hash, with which of them are seeds."""

    ids: list
    words: np.ndarray
    bounds: np.ndarray
    grams: np.ndarray
    item: np.ndarray
    place: np.ndarray
    seed: np.ndarray

    @staticmethod
    def of(ids: list, texts: list[str | None]) -> Block:
        data, offsets = utf8(pa.array(texts, pa.string()))
        words, bounds = word_hashes(LOWER[data], offsets)
        grams, item, place = _grams(words, bounds)
        order = np.argsort(grams, kind="stable")
        return Block(ids, words, bounds, grams[order], item[order], place[order], np.ones(len(order), dtype=bool))

    def lengths(self) -> list[int]:
        """Word counts of the n-grams."""
        sizes = np.diff(self.bounds)
        return sorted(set(_needs(sizes[sizes > 0])[0].tolist()))


def blocks(items: DataFrame, item_id: str = "item_id", text: str = "text") -> list[Block]:
    """The test items in blocks of bounded size; the table itself is read row by row."""
    found, ids, texts, held = [], [], [], 0
    for row in items.select(item_id, text).orderBy(item_id).toLocalIterator():
        size = len((row[1] or "").split())
        if ids and held + size > BLOCK_GRAMS:
            found.append(Block.of(ids, texts))
            ids, texts, held = [], [], 0
        ids.append(row[0])
        texts.append(row[1])
        held += size
    return [*found, Block.of(ids, texts)] if ids else found


def _hits(words: np.ndarray, bounds: np.ndarray, grams: np.ndarray, lengths: list[int]):
    """Places in the words of a batch where a known n-gram begins, and the range of its entries in `grams`."""
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    places, lows, highs = [], [], []
    for n in lengths:
        hashes = gram_hashes(words, n)
        low = np.searchsorted(grams, hashes)
        at = np.flatnonzero(grams[np.minimum(low, len(grams) - 1)] == hashes) if len(grams) else np.zeros(0, np.int64)
        at = at[owner[at] == owner[at + n - 1]]
        places.append(at)
        lows.append(low[at])
        highs.append(np.searchsorted(grams, hashes[at], side="right"))
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), owner
    return np.concatenate(places), np.concatenate(lows), np.concatenate(highs), owner


def rare_seeds(docs: DataFrame, block: Block) -> Block:
    """The block with only the n-grams that occur; seeds are all but each item's most frequent, by number of documents."""
    distinct, place = np.unique(block.grams, return_inverse=True)
    lengths = block.lengths()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(distinct), np.int64)
        for batch in batches:
            for part in portions(batch):
                data, offsets = utf8(part.column("text"))
                words, bounds = word_hashes(LOWER[data], offsets)
                at, low, _, owner = _hits(words, bounds, distinct, lengths)
                once = np.unique(owner[at] * len(distinct) + low) % max(len(distinct), 1)
                total += np.bincount(once, minlength=len(distinct))
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["gram", "n"])

    # At most as many rows as the block has n-grams.
    counted = docs.select("text").mapInArrow(count, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))
    frequency = np.zeros(len(distinct), np.int64)
    for row in counted.collect():
        frequency[row["gram"]] = row["n"]
    mine = frequency[place]
    order = np.lexsort((-mine, block.item))
    sizes = np.bincount(block.item, minlength=len(block.ids))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order)) - (np.cumsum(sizes) - sizes)[block.item[order]]
    seed = rank >= (_needs(np.diff(block.bounds))[1] - 1)[block.item]
    keep = mine > 0
    return Block(block.ids, block.words, block.bounds, block.grams[keep], block.item[keep], block.place[keep], seed[keep])


def align(item: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best Smith-Waterman score of an item with each row of words (0: no word), and where it ends.

    A row of the table at a time for all places together; a gap along the row is a
    running maximum, since its cost is linear.
    """
    n, width = places.shape
    slope = np.arange(width + 1) * -GAP
    before = np.zeros((n, width + 1), np.int64)
    best, end = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for word in item:
        here = np.zeros_like(before)
        here[:, 1:] = before[:, :-1] + np.where(places == word, MATCH, MISS)
        here = np.maximum(np.maximum(here, before + GAP), 0)
        here[:, 0] = 0
        here = np.maximum.accumulate(here + slope, axis=1) - slope
        top = here.argmax(1)
        value = here[np.arange(n), top]
        better = value > best
        best, end = np.where(better, value, best), np.where(better, top, end)
        before = here
    return best, end


def _entries(at, low, high, keep) -> tuple[np.ndarray, np.ndarray]:
    """Entry of the block and place in the words of all hits that `keep` of these two chooses; some at a time."""
    found = []
    for some in np.split(np.arange(len(at)), np.flatnonzero(np.diff(np.cumsum(high - low) // _CELLS)) + 1):
        times = high[some] - low[some]
        entries = np.repeat(low[some] - (np.cumsum(times) - times), times) + np.arange(times.sum())
        places = np.repeat(at[some], times)
        chosen = keep(entries, places)
        found.append((entries[chosen], places[chosen]))
    return np.concatenate([e for e, _ in found]), np.concatenate([p for _, p in found])


def _candidates(at, low, high, owner, bounds, block: Block):
    """(item, document, first word and end of the window) of every candidate place, merged where they are near."""
    n_docs, n_words = len(bounds) - 1, len(owner)
    all_sizes = np.diff(block.bounds)
    _, hits, inserted = _needs(all_sizes)
    seeds, seed_at = _entries(at, low, high, lambda e, p: block.seed[e])
    pairs = np.unique(block.item[seeds] * n_docs + owner[seed_at])
    entries, places = _entries(at, low, high, lambda e, p: np.isin(block.item[e] * n_docs + owner[p], pairs))
    # A document's word counts once for an item, so `hits` of them in reach of each other are what an alignment holds.
    known = np.unique(block.item[entries] * n_words + places)
    item, place = np.divmod(known, n_words)
    last = np.arange(len(known)) + hits[item] - 1
    whole = last < len(known)
    last = np.minimum(last, max(len(known) - 1, 0))
    whole &= (item[last] == item) & (owner[place[last]] == owner[place])
    whole &= place[last] - place < (all_sizes + inserted)[item]
    within = np.zeros(len(known) + 1, np.int64)
    np.add.at(within, np.flatnonzero(whole), 1)
    np.add.at(within, last[whole] + 1, -1)
    good = np.cumsum(within)[np.searchsorted(known, block.item[seeds] * n_words + seed_at)] > 0
    item, place, at = block.item[seeds[good]], block.place[seeds[good]], seed_at[good]
    doc, sizes, slack = owner[at], all_sizes[item], inserted[item]
    begin = np.maximum(at - place - slack, bounds[doc])
    end = np.minimum(at - place + sizes + slack, bounds[doc + 1])
    order = np.lexsort((begin, item))
    item, doc, begin, end = item[order], doc[order], begin[order], end[order]
    # Windows that begin in the same stretch of two items' length are one, so none grows beyond five.
    stretch = begin // (2 * all_sizes[item])
    fresh = np.ones(len(item), dtype=bool)
    fresh[1:] = (item[1:] != item[:-1]) | (doc[1:] != doc[:-1]) | (stretch[1:] != stretch[:-1])
    group = np.cumsum(fresh) - 1
    first = np.flatnonzero(fresh)
    last = np.zeros(len(first), np.int64)
    np.maximum.at(last, group, end)
    return item[first], doc[first], begin[first], last


def _matches(words, bounds, block: Block):
    """(document, item, score, first word, end word) of the aligned candidates of a batch, best place per pair."""
    at, low, high, owner = _hits(words, bounds, block.grams, block.lengths())
    if not len(at):
        return []
    item, doc, begin, end = _candidates(at, low, high, owner, bounds, block)
    found: dict[tuple[int, int], tuple[float, int, int]] = {}
    for i in np.unique(item):
        mine = np.flatnonzero(item == i)
        target = block.words[block.bounds[i] : block.bounds[i + 1]]
        step = max(1, _CELLS // int((end[mine] - begin[mine]).max()))
        for k in range(0, len(mine), step):
            some = mine[k : k + step]
            width = int((end[some] - begin[some]).max())
            index = begin[some, None] + np.arange(width)
            places = np.where(index < end[some, None], words[np.minimum(index, len(words) - 1)], np.uint64(0))
            score, stop = align(target, places)
            score = score / (MATCH * len(target))
            for s, d, b, e in zip(score.tolist(), doc[some].tolist(), begin[some].tolist(), stop.tolist(), strict=True):
                if s >= LEAST_SCORE and s > found.get((d, int(i)), (0.0,))[0]:
                    found[(d, int(i))] = (s, b, b + e)
    result = []
    for (d, i), (s, b, e) in sorted(found.items()):
        # Backwards from its end, the alignment ends where it began.
        _, back = align(block.words[block.bounds[i] : block.bounds[i + 1]][::-1], words[b:e][::-1][None])
        result.append((d, i, s, e - int(back[0]) - int(bounds[d]), e - int(bounds[d])))
    return result


def _seeded(docs: DataFrame, items: DataFrame) -> list[Block]:
    return [rare_seeds(docs, block) for block in blocks(items)]


def contaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id") -> DataFrame:
    """(`key`, item_id, score, first_word, end_word) of every document and item that align.

    `score` is at least LEAST_SCORE; words are counted from 0 and the end is exclusive.
    """
    id_kind = items.schema["item_id"].dataType.simpleString()
    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, item_id {id_kind}, score double, first_word bigint, end_word bigint"
    parts = []
    for block in _seeded(docs, items):

        def search(batches: Iterator[pa.RecordBatch], block: Block = block) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in portions(batch):
                    data, offsets = utf8(part.column("text"))
                    found = _matches(*word_hashes(LOWER[data], offsets), block)
                    ids = part.column(key).take(pa.array([f[0] for f in found], pa.int64()))
                    items_ = pa.array([block.ids[f[1]] for f in found])
                    rest = [pa.array([f[k] for f in found], t) for k, t in ((2, pa.float64()), (3, pa.int64()), (4, pa.int64()))]
                    names = [key, "item_id", "score", "first_word", "end_word"]
                    if found:
                        yield pa.RecordBatch.from_arrays([ids, items_, *rest], names)

        parts.append(docs.select(key, "text").mapInArrow(search, schema))
    if not parts:
        return docs.sparkSession.createDataFrame([], schema)
    result = parts[0]
    for part in parts[1:]:
        result = result.union(part)
    return result


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Rows of `docs` that align with no test item, with all their columns and no shuffle."""
    seeded = _seeded(docs, items)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch):
                data, offsets = utf8(part.column("text"))
                words, bounds = word_hashes(LOWER[data], offsets)
                good = np.ones(part.num_rows, dtype=bool)
                for block in seeded:
                    good[[f[0] for f in _matches(words, bounds, block)]] = False
                yield part.filter(pa.array(good))

    return docs.mapInArrow(keep, docs.schema)


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
