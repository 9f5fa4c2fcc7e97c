"""Phrase collocation mining over a prefix-free parse.

Every piece of a text (between punctuation or line ends) is a sequence of words. A
window of `most - 1` words whose hash falls on a trigger ends a chunk there and begins the
next one, so chunks overlap by that window and equal stretches of text are cut alike
wherever they stand. The distinct chunks form a dictionary with the number of times
each was parsed. A chunk owns the phrases that begin before its closing window (the last chunk of
a piece owns all of its own), so every phrase of up to `most` words lies whole in the one
chunk that owns it, and is counted there once, times the chunk's frequency.

Phrases are counted by length, shortest first. A phrase cannot be frequent unless the two
phrases one word shorter within it are: these are looked up in a bitmap of fixed size that
has every frequent phrase's bit. A wrong bit costs work, never a result: what passes is
counted by its text.

A candidate has the score of its worst cut in two: floor(10**6 * a * a / (l * r)), in exact
decimal arithmetic of 38 digits. Candidates go if a longer candidate that holds them has at
least `share` percent of their occurrences.

Defined results: words are runs without space and tab, lower-cased (A-Z). Null, empty and blank
texts have no words; a null language is `und`. Rows count each, whatever their ids. Ties in
score go to more occurrences, then to the smaller text in byte order; equal cuts to the
shorter first part. Only `text` and `lang` are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pingtrace.llm.arrays import LOWER, as_array, gram_hashes, hash_prefix, mix, portions, range_hash, row_of, utf8
from pingtrace.llm.inputs import table
from pingtrace.sources.staging import staged

TRIGGER = 8  # one window in so many ends a chunk
GATHER_BYTES = 4 << 20  # of chunks whose phrases are added up before they leave the task
MAP_BITS = 25
RANK_PARTS = 32
_U = np.uint64

_BREAK = np.zeros(256, dtype=bool)
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x09, 0x20]] = True


@dataclass(frozen=True)
class Mining:
    least: int = 2  # words of a candidate
    most: int = 3
    min_count: int = 10
    share: int = 50
    top: int = 2000


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of every word, and whether it begins a piece."""
    inside = ~(_BREAK[data] | _SPACE[data])
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    breaks = np.cumsum(_BREAK[data])[starts] if len(starts) else np.zeros(0, np.int64)
    row = row_of(offsets, starts)
    first = np.ones(len(starts), dtype=bool)
    first[1:] = (np.diff(row) > 0) | (np.diff(breaks) > 0)
    return starts, stops, first


def _strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Byte ranges (which may overlap) as a string array."""
    sizes = ends - starts
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(sizes, out=offsets[1:])
    gathered = data[np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], sizes)]
    buffers = [None, pa.py_buffer(offsets), pa.py_buffer(gathered)]
    return pa.Array.from_buffers(pa.large_string(), len(starts), buffers).cast(pa.string())


def parse_chunks(data: np.ndarray, offsets: np.ndarray, window: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Chunks of all texts with single spaces between words, whether each ends its piece, and its row."""
    lowered = LOWER[data]
    starts, stops, first = _words(lowered, offsets)
    n = len(starts)
    if not n:
        return pa.array([], pa.string()), np.zeros(0, dtype=bool), np.zeros(0, np.int64)
    # Words end to end, each followed by a space.
    sizes = stops - starts + 1
    place = np.zeros(n + 1, np.int64)
    np.cumsum(sizes, out=place[1:])
    source = np.arange(place[-1]) + np.repeat(starts - place[:-1], sizes)
    source[place[1:] - 1] = 0
    compact = lowered[source]
    compact[place[1:] - 1] = 0x20

    piece_starts = np.flatnonzero(first)
    piece_end = np.repeat(np.append(piece_starts[1:], n), np.diff(np.append(piece_starts, n)))
    words = range_hash(hash_prefix(compact), place[:-1], place[1:] - 1)
    cut = first.copy()
    grams = gram_hashes(words, window)
    at = np.flatnonzero(grams % _U(TRIGGER) == 0)
    cut[at[at + window <= piece_end[at]]] = True
    begin = np.flatnonzero(cut)
    following = np.append(begin[1:], n)
    last = following == piece_end[begin]
    end = np.where(last, following, following + window)
    return _strings(compact, place[begin], place[end] - 1), last, row_of(offsets, starts[begin])


def chunk_dictionary(docs: DataFrame, window: int, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, chunk, last and times of all distinct chunks, staged."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch):
                chunks, last, row = parse_chunks(*utf8(part.column("text")), window)
                langs = as_array(part.column("lang")).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([langs, chunks, pa.array(last)], ["lang", "chunk", "last"])

    taken = docs.select(F.col(text).alias("text"), F.coalesce(F.col(lang), F.lit("und")).alias("lang"))
    parsed = taken.mapInArrow(parse, "lang string, chunk string, last boolean")
    return staged(parsed.groupBy("lang", "chunk", "last").agg(F.count("*").alias("times")), "phrases-chunks")


def _lang_hashes(langs: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Code and hash of each row's language, and the languages by code."""
    coded = langs.dictionary_encode()
    hashes = [int.from_bytes(blake2b(x.encode(), digest_size=8).digest(), "little") for x in coded.dictionary.to_pylist()]
    codes = np.asarray(coded.indices).astype(np.int64)
    return codes, np.array(hashes, np.uint64)[codes], coded.dictionary


def _spaced_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the words of rows that have single spaces between them."""
    space = np.flatnonzero(data == 0x20)
    starts = np.sort(np.concatenate([offsets[:-1], space + 1]))
    ends = np.sort(np.concatenate([offsets[1:], space]))
    return starts, ends


def _bit(grams: np.ndarray, langs: np.ndarray) -> np.ndarray:
    return (mix(grams ^ langs) >> _U(64 - MAP_BITS)).astype(np.int64)


def _bitmap(phrases: DataFrame, n: int) -> np.ndarray:
    """A bit for each of `phrases` (of n words). 2**(MAP_BITS - 6) numbers at most reach the driver."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("phrase"))
            words = range_hash(hash_prefix(data), *_spaced_words(data, offsets))
            grams = gram_hashes(words, n)[::n] if len(words) else words
            place = np.unique(_bit(grams, _lang_hashes(as_array(batch.column("lang")))[1]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(place >> 6), pa.array((_U(1) << (place & 63).astype(np.uint64)).view(np.int64))], ["word", "bit"]
            )

    marked = phrases.select("lang", "phrase").mapInArrow(places, "word bigint, bit bigint")
    found = marked.groupBy("word").agg(F.expr("bit_or(bit)").alias("bits")).toArrow()
    bitmap = np.zeros(1 << (MAP_BITS - 6), np.int64)
    bitmap[np.asarray(found["word"])] = np.asarray(found["bits"])
    return bitmap.view(np.uint64)


def _phrase_counts(dictionary: DataFrame, n: int, window: int, frequent: np.ndarray | None) -> DataFrame:
    """lang, phrase and f of the phrases of n words whose shorter phrases are in the bitmap `frequent`."""

    def held(place: np.ndarray) -> np.ndarray:
        return (frequent[place >> 6] >> (place & 63).astype(np.uint64)) & _U(1) == 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered, size = [], 0
        for batch in batches:
            gathered.append(batch)
            size += batch.column("chunk").nbytes
            if size > GATHER_BYTES:
                yield added(gathered)
                gathered, size = [], 0
        if gathered:
            yield added(gathered)

    def added(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(parts).combine_chunks()
        data, offsets = utf8(rows["chunk"])
        starts, ends = _spaced_words(data, offsets)
        bounds = np.searchsorted(starts, offsets)
        bounds[-1] = len(starts)
        lengths = np.diff(bounds)
        owned = lengths - np.where(np.asarray(rows["last"]), 0, window)
        row = np.repeat(np.arange(len(lengths)), lengths)
        rank = np.arange(len(starts)) - bounds[row]
        at = np.flatnonzero((rank < owned[row]) & (rank + n <= lengths[row]))
        codes, hashes, langs = _lang_hashes(rows["lang"].combine_chunks())
        if frequent is not None and len(at):
            words = range_hash(hash_prefix(data), starts, ends)
            shorter = gram_hashes(words, n - 1)
            at = at[held(_bit(shorter[at], hashes[row[at]]))]
            at = at[held(_bit(shorter[at + 1], hashes[row[at]]))]
        phrases = _strings(data, starts[at], ends[at + n - 1]).dictionary_encode()
        times = np.asarray(rows["times"])[row[at]]
        key = np.asarray(phrases.indices).astype(np.int64) * max(len(langs), 1) + codes[row[at]]
        order = np.argsort(key, kind="stable")
        key, times = key[order], times[order]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        total = np.add.reduceat(times, first) if len(first) else times
        code = key[first]
        return pa.RecordBatch.from_arrays(
            [
                langs.take(pa.array(code % max(len(langs), 1))),
                phrases.dictionary.take(pa.array(code // max(len(langs), 1))),
                pa.array(total.astype(np.int64)),
            ],
            ["lang", "phrase", "f"],
        )

    found = dictionary.mapInArrow(count, "lang string, phrase string, f bigint")
    return found.groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def frequent_phrases(docs: DataFrame, mining: Mining, text: str = "text", lang: str = "lang") -> tuple[list[DataFrame], DataFrame]:
    """Tables (lang, phrase, f) of the frequent phrases of 1, 2, ... `most` words, and (lang, n) with all words."""
    window = mining.most - 1
    dictionary = chunk_dictionary(docs, window, text, lang)
    words = staged(_phrase_counts(dictionary, 1, window, None), "phrases-1")
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    levels = [words.where(F.col("f") >= mining.min_count)]
    for n in range(2, mining.most + 1):
        counted = _phrase_counts(dictionary, n, window, _bitmap(levels[-1], n - 1))
        levels.append(staged(counted.where(F.col("f") >= mining.min_count), f"phrases-{n}"))
    return levels, totals


def _parts(n: int, size: int):
    """Array of all runs of `size` of the n words in column `w`."""
    return F.array(*[F.array_join(F.slice("w", k + 1, size), " ") for k in range(n - size + 1)])


def scored(levels: list[DataFrame], mining: Mining) -> DataFrame:
    """lang, phrase, words, a, l, r and score of every candidate, by its worst cut."""
    parts = levels[0]
    for level in levels[1:-1]:
        parts = parts.union(level)
    cuts = None
    for n in range(mining.least, mining.most + 1):
        split = levels[n - 1].withColumn("w", F.split("phrase", " "))
        cut = F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(k).alias("k"),
                        F.array_join(F.slice("w", 1, k), " ").alias("left"),
                        F.array_join(F.slice("w", k + 1, n - k), " ").alias("right"),
                    )
                    for k in range(1, n)
                ]
            )
        )
        one = split.select("lang", "phrase", F.lit(n).alias("words"), F.col("f").alias("a"), cut.alias("c"))
        cuts = one if cuts is None else cuts.union(one)
    cuts = cuts.select("lang", "phrase", "words", "a", "c.*")
    left = parts.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l"))
    right = parts.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r"))
    big = {c: F.col(c).cast("decimal(20,0)") for c in "alr"}
    found = cuts.join(left, ["lang", "left"]).join(right, ["lang", "right"])
    found = found.withColumns({f"_{c}": x for c, x in big.items()})
    score = F.expr("(_a * _a * cast(1000000 as decimal(7,0))) div (_l * _r)")
    worst = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("worst")
    return found.groupBy("lang", "phrase", "words", "a").agg(worst).select(
        "lang", "phrase", "words", "a", "worst.l", "worst.r", "worst.score"
    )


def collocations(docs: DataFrame, mining: Mining = Mining(), text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's best phrases."""
    levels, totals = frequent_phrases(docs, mining, text, lang)
    candidates = staged(scored(levels, mining), "phrases-scored")
    longer = None
    for n in range(mining.least + 1, mining.most + 1):
        for size in range(mining.least, n):
            inside = levels[n - 1].withColumn("w", F.split("phrase", " "))
            inside = inside.select("lang", F.explode(_parts(n, size)).alias("phrase"), "f")
            longer = inside if longer is None else longer.union(inside)
    if longer is not None:
        longer = longer.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
        candidates = candidates.join(longer, ["lang", "phrase"], "left").where(
            F.col("longer").isNull() | (100 * F.col("longer") < mining.share * F.col("a"))
        )
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # First within parts of a language, so that no task sorts all of it.
    salted = candidates.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS)))
    within = F.row_number().over(Window.partitionBy("lang", "part").orderBy(*best))
    head = salted.withColumn("rank", within).where(F.col("rank") <= mining.top)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("bigint")
    ranked = head.withColumn("rank", rank).where(F.col("rank") <= mining.top)
    return ranked.join(F.broadcast(totals) if totals.count() <= mining.top else totals, "lang").select(
        "lang", "rank", "phrase", "a", "l", "r", "n", "score"
    )


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


#: The same by unnesting every place of every text.
ORACLE_SQL = """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents
),
worded AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
placed AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM worded),
grams AS (
  SELECT lang, w[i] AS w1, CASE WHEN i < len(w) THEN w[i + 1] END AS w2,
         CASE WHEN i + 1 < len(w) THEN w[i + 2] END AS w3 FROM placed
),
one AS (SELECT lang, w1, count(*) AS f FROM grams GROUP BY ALL),
two AS (SELECT lang, w1, w2, count(*) AS f FROM grams WHERE w2 IS NOT NULL GROUP BY ALL),
three AS (SELECT lang, w1, w2, w3, count(*) AS f FROM grams WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
totals AS (SELECT lang, sum(f) AS n FROM one GROUP BY lang),
cuts AS (
  SELECT t.lang, t.w1 || ' ' || t.w2 AS phrase, 1 AS k, t.f AS a, x.f AS l, y.f AS r
  FROM two t JOIN one x ON x.lang = t.lang AND x.w1 = t.w1 JOIN one y ON y.lang = t.lang AND y.w1 = t.w2
  WHERE t.f >= 10 AND NOT EXISTS (
    SELECT 1 FROM three z WHERE z.lang = t.lang AND 100 * z.f >= 50 * t.f
      AND ((z.w1 = t.w1 AND z.w2 = t.w2) OR (z.w2 = t.w1 AND z.w3 = t.w2)))
  UNION ALL
  SELECT t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3, 1, t.f, x.f, y.f
  FROM three t JOIN one x ON x.lang = t.lang AND x.w1 = t.w1
  JOIN two y ON y.lang = t.lang AND y.w1 = t.w2 AND y.w2 = t.w3
  UNION ALL
  SELECT t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3, 2, t.f, x.f, y.f
  FROM three t JOIN two x ON x.lang = t.lang AND x.w1 = t.w1 AND x.w2 = t.w2
  JOIN one y ON y.lang = t.lang AND y.w1 = t.w3
),
scored AS (
  SELECT *, (cast(a AS hugeint) * a * 1000000) // (cast(l AS hugeint) * r) AS score FROM cuts
),
worst AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS place FROM worst
)
SELECT r.lang, r.place AS rank, r.phrase, r.a, r.l, r.r, cast(t.n AS bigint) AS n, cast(r.score AS bigint) AS score
FROM ranked r JOIN totals t ON t.lang = r.lang WHERE r.place <= 2000
"""
