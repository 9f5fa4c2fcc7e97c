"""Counts over whole texts, for rules and for the quality classifier.

Words are runs of anything but ASCII white space. Null counts as empty; an empty
text has zeros throughout. Equal lines and equal runs of words are found by
64-bit hashes within one text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pingtrace.llm.arrays import (
    WHITE,
    gram_hashes,
    hash_prefix,
    mix,
    per_row,
    portions,
    range_hash,
    row_of,
    utf8,
    word_ranges,
)

WINDOW = 8
COUNTS = (
    "n_bytes n_chars n_words word_chars n_symbols n_dup_lines n_repeat_words n_lines n_distinct_words "
    "n_adjacent n_upper n_letters n_digits n_marks n_stops n_long_words"
).split()

_SYMBOLS = np.zeros(256, dtype=bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_LETTER = _UPPER.copy()
_LETTER[97:123] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True
_MARKS = np.zeros(256, dtype=bool)
_MARKS[list(b"!?@=_~^{}[]()/\\+\"'`;:")] = True
_STOPS = np.zeros(256, dtype=bool)
_STOPS[list(b".,")] = True
_LONG_WORD = 20


def _repeats(owner: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each entry: is it the first of its (owner, hash), and how many are equal to it."""
    key = mix(hashes + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, first, inverse, count = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
    is_first = np.zeros(len(key), dtype=bool)
    is_first[first] = True
    return is_first, count[inverse]


def counts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The counts named in COUNTS, one entry per text."""
    n = len(offsets) - 1
    lead = (data & 0xC0) != 0x80
    white = WHITE[data]
    starts, ends = word_ranges(data, offsets)
    sums = hash_prefix(data)
    words = range_hash(sums, starts, ends)
    owner = row_of(offsets, starts)
    bounds = np.searchsorted(starts, offsets)

    new_lines = np.flatnonzero(data == 10)
    line_starts = np.union1d(offsets[:-1], new_lines + 1)
    line_starts = line_starts[line_starts < len(data)]
    line_ends = np.append(line_starts[1:], len(data))
    # A line ends before its line feed, or where its text ends.
    line_ends = np.where(data[line_ends - 1] == 10, line_ends - 1, line_ends) if len(data) else line_ends
    worded = np.searchsorted(starts, line_starts) < np.searchsorted(starts, line_ends)
    line_starts, line_ends = line_starts[worded], line_ends[worded]
    line_owner = row_of(offsets, line_starts)
    first_line, _ = _repeats(line_owner, range_hash(sums, line_starts, line_ends))

    first_word, _ = _repeats(owner, words)
    adjacent = np.zeros(len(words), dtype=bool)
    adjacent[1:] = (words[1:] == words[:-1]) & (owner[1:] == owner[:-1])

    grams = gram_hashes(words, WINDOW)
    whole = np.flatnonzero(owner[: len(grams)] == owner[WINDOW - 1 :][: len(grams)])
    _, times = _repeats(owner[whole], grams[whole])
    again = whole[times > 1]
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, again, 1)
    np.add.at(edge, again + WINDOW, -1)
    repeated = np.cumsum(edge)[:-1] > 0

    return {
        "n_bytes": np.diff(offsets),
        "n_chars": per_row(offsets, lead),
        "n_words": np.diff(bounds),
        "word_chars": per_row(offsets, lead & ~white),
        "n_symbols": per_row(offsets, _SYMBOLS[data]),
        "n_dup_lines": np.bincount(line_owner[~first_line], minlength=n),
        "n_repeat_words": per_row(bounds, repeated),
        "n_lines": np.bincount(line_owner, minlength=n),
        "n_distinct_words": per_row(bounds, first_word),
        "n_adjacent": per_row(bounds, adjacent),
        "n_upper": per_row(offsets, _UPPER[data]),
        "n_letters": per_row(offsets, _LETTER[data]),
        "n_digits": per_row(offsets, _DIGIT[data]),
        "n_marks": per_row(offsets, _MARKS[data]),
        "n_stops": per_row(offsets, _STOPS[data]),
        "n_long_words": per_row(bounds, ends - starts > _LONG_WORD),
    }


def with_counts(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """Columns `keep` and all of COUNTS as bigint, a row per row of `docs`; one pass, no shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch, text):
                found = counts(*utf8(part.column(text)))
                yield pa.RecordBatch.from_arrays(
                    [part.column(c) for c in keep] + [pa.array(found[c], pa.int64()) for c in COUNTS],
                    [*keep, *COUNTS],
                )

    kept = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    schema = kept + ", " + ", ".join(f"{c} bigint" for c in COUNTS)
    return docs.select(*keep, text).mapInArrow(count, schema)
