"""Removal of byte strings of at least LENGTH that occur more than once, by suffix order.

A string of LENGTH bytes is a window. Every window names an anchor: of the
GRAM-byte strings in it, the one of smallest hash (leftmost first). Equal windows
name equal anchors at the same place, so only places with equal anchors are ever
compared, and a text has an anchor for some 170 windows on average. The windows of
an anchor are consecutive; the bytes that they span are its context.

1. Anchors are met by the hash of their bytes. An anchor met once has no repeated
   window. A context met again with equal content is repeated as a whole; copies
   however many are counted by partial aggregation and never brought together.
2. Where contexts of one anchor differ, one document of each content hands it
   over, and the contexts are put in suffix order from the anchor on, and in the order of
   what they have before it, read backwards. Windows of LENGTH equal bytes have their
   anchor at the same place, and on either side of it are neighbours there as far as they
   reach, so ranks by both sides bring them together. For such a run the longest
   previous factor of a window reaches LENGTH if there is a previous or next
   smaller position in the run, that is for all but the run's smallest position:
   these are the later copies. `keep_first` removes them; otherwise every window
   of a run of two or more goes.
3. Anchors with more than MOST_CONTEXTS different contexts are not brought together:
   their windows are met by hash, one row each, and counted.

Overlapping windows are judged on the input and their union is removed.

Defined results: null counts as empty text; texts shorter than LENGTH lose nothing;
repeated rows are copies of each other, whatever their ids. With `keep_first` the
first is the row of the smallest id, nulls before all, then by a hash of the text;
rows equal in id and text have no order and lose or keep alike. Extra columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from pingtrace.llm.arrays import hash_prefix, mix, portions, range_hash, row_of, utf8
from pingtrace.llm.inputs import table
from pingtrace.sources.staging import staged

LENGTH = 400
GRAM = 64
MOST_CONTEXTS = 16_384
BUNDLE_BYTES = 1 << 20
_PLACE_BITS = 28
_U = np.uint64


def _sliding_argmin(keys: np.ndarray, width: int) -> np.ndarray:
    """Smallest of every `width` consecutive keys: block-wise prefix and suffix minima."""
    blocks = -(-len(keys) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(keys)] = keys
    padded = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(keys) - width + 1
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, gram: int):
    """Of every anchor: text, hash, hash of its context, place, and first and last window, all from the text's start.

    Places have _PLACE_BITS beside the hashes. What is longer is worked through in pieces that
    overlap by length - 1 bytes, so every window lies in one piece and names the same anchor; an
    anchor next to a cut may have two contexts.
    """
    most = 1 << _PLACE_BITS
    if len(data) <= most:
        return _anchors_of_piece(data, offsets, length, gram)
    found = []
    for start in range(0, len(data), most - length + 1):
        piece = data[start : start + most]
        inside = np.clip(offsets - start, 0, len(piece))
        text, anchor, content, *places = _anchors_of_piece(piece, inside, length, gram)
        shift = inside[text] + start - offsets[text]
        found.append((text, anchor, content, *(p + shift for p in places)))
    return tuple(np.concatenate(column) for column in zip(*found, strict=True))


def _anchors_of_piece(data: np.ndarray, offsets: np.ndarray, length: int, gram: int):
    empty = np.zeros(0, np.int64)
    if len(data) < length:
        return empty, empty.astype(np.uint64), empty.astype(np.uint64), empty, empty, empty
    sums = hash_prefix(data)
    at = np.arange(len(data) - gram + 1)
    grams = range_hash(sums, at, at + gram)
    keys = (grams >> _U(_PLACE_BITS) << _U(_PLACE_BITS)) | at.astype(np.uint64)
    place = (_sliding_argmin(keys, length - gram + 1) & _U((1 << _PLACE_BITS) - 1)).astype(np.int64)
    ends = np.repeat(offsets[1:], np.diff(offsets))[: len(place)]
    windows = np.flatnonzero(ends - np.arange(len(place)) >= length)
    place = place[windows]
    fresh = np.ones(len(windows), dtype=bool)
    fresh[1:] = (place[1:] != place[:-1]) | (windows[1:] != windows[:-1] + 1)
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(windows)) - 1 if len(first) else first
    low, high, place = windows[first], windows[last], place[first]
    text = row_of(offsets, low)
    content = mix(range_hash(sums, low, high + length) + (place - low).astype(np.uint64))
    base = offsets[text]
    return text, grams[place], content, place - base, low - base, high - base


def _ordered(texts: list[bytes], groups: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Order of `texts` within their groups, and how many first bytes each has in common with the one before (-1: another group)."""
    order = sorted(range(len(texts)), key=lambda k: (groups[k], texts[k]))
    width = max(map(len, texts), default=0) + 1
    table = np.frombuffer(b"".join(texts[k].ljust(width, b"\0") for k in order), np.uint8).reshape(-1, width)
    sizes, of = np.array([len(texts[k]) for k in order], np.int64), np.array([groups[k] for k in order])
    differ = table[1:] != table[:-1]
    differ[:, -1] = True
    common = np.minimum(differ.argmax(axis=1), np.minimum(sizes[1:], sizes[:-1]))
    return np.array(order, np.int64), np.concatenate([[-1], np.where(of[1:] == of[:-1], common, -1)])


def repeated_windows(
    contexts: list[bytes], groups: list[int], places: list[int], length: int, keep_first: bool
) -> tuple[np.ndarray, np.ndarray]:
    """(context, window) of the windows to remove; contexts come in the order of their documents.

    `groups` tells the anchors apart, `places` is where in its context each has its anchor. Memory follows
    the bytes of the contexts, at some ten bytes for each.
    """
    place = np.array(places, np.int64)
    ahead = np.array([len(c) for c in contexts], np.int64) - place
    on = _ordered([c[p:] for c, p in zip(contexts, places, strict=True)], groups)
    back = _ordered([c[:p][::-1] for c, p in zip(contexts, places, strict=True)], groups)
    gone = np.zeros((len(contexts), int((place + ahead).max(initial=length)) - length + 1), dtype=bool)
    rank_on, rank_back = np.empty_like(place), np.empty_like(place)
    for before in range(int(place.max(initial=-1)) + 1):
        # Windows that begin so many bytes before the anchor: equal if the bytes on either side are.
        here = np.flatnonzero((place >= before) & (ahead >= length - before))
        if len(here) < 2:
            continue
        for rank, (order, common), reach in ((rank_on, on, length - before), (rank_back, back, before)):
            rank[order] = np.cumsum(common < reach)
        key = rank_on[here] << 32 | rank_back[here]
        # Suffix order of the windows; equal ones stay in order of their documents, the smallest first.
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        has_earlier = np.concatenate([[False], same])
        has_later = np.concatenate([same, [False]])
        found = here[order[has_earlier if keep_first else has_earlier | has_later]]
        gone[found, place[found] - before] = True
    return np.nonzero(gone)


def _intervals(owner: np.ndarray, window: np.ndarray, length: int):
    """(owner, begin, end) of the unions of windows; input by owner and window."""
    fresh = np.ones(len(owner), dtype=bool)
    fresh[1:] = (owner[1:] != owner[:-1]) | (window[1:] - window[:-1] > length)
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(owner)) - 1 if len(first) else first
    return owner[first], window[first], window[last] + length


def _identity(key: str) -> list[Column]:
    """Two hashes that name a row: equal only for rows of equal id and text."""
    return [F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), F.col(key).cast("string"), "text").alias("h2")]


def _anchor_rows(docs: DataFrame, key: str, length: int, gram: int) -> DataFrame:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch):
                text, anchor, content, place, low, high = anchors(*utf8(part.column("text")), length, gram)
                taken = [part.column(c).take(pa.array(text)) for c in ("order", "h1", "h2")]
                found = [anchor.view(np.int64), content.view(np.int64), low, high, place]
                yield pa.RecordBatch.from_arrays(
                    taken + [pa.array(x, pa.int64()) for x in found],
                    ["order", "h1", "h2", "anchor", "content", "low", "high", "place"],
                )

    kind = docs.schema[key].dataType.simpleString()
    named = docs.select("text", F.col(key).alias("order"), *_identity(key))
    longs = "h1 bigint, h2 bigint, anchor bigint, content bigint, low bigint, high bigint, place bigint"
    return named.mapInArrow(rows, f"order {kind}, {longs}")


def _contexts(docs: DataFrame, chosen: DataFrame, key: str, length: int) -> DataFrame:
    """`chosen` rows with the bytes of their contexts."""
    kind = chosen.schema["order"].dataType.simpleString()
    lists = chosen.groupBy("h1", "h2").agg(
        F.collect_list(F.struct("order", "anchor", "content", "low", "high", "place", "single")).alias("wanted")
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch):
                rows = []
                for h1, h2, text, wanted in zip(*(part.column(c).to_pylist() for c in ("h1", "h2", "text", "wanted")), strict=True):
                    raw = (text or "").encode()
                    rows += [
                        {"h1": h1, "h2": h2, **w, "bytes": raw[w["low"] : w["high"] + length]}
                        for w in {(w["anchor"], w["low"]): w for w in wanted}.values()
                    ]
                yield pa.RecordBatch.from_pylist(rows, schema=out)

    out = pa.schema(
        [("h1", pa.int64()), ("h2", pa.int64()), ("order", to_arrow_type(chosen.schema["order"].dataType)), ("anchor", pa.int64()), ("content", pa.int64()),
         ("low", pa.int64()), ("high", pa.int64()), ("place", pa.int64()), ("single", pa.bool_()), ("bytes", pa.binary())]
    )
    texts = docs.select("text", *_identity(key)).join(lists, ["h1", "h2"]).select("h1", "h2", "text", "wanted")
    schema = f"h1 bigint, h2 bigint, order {kind}, anchor bigint, content bigint, low bigint, high bigint, place bigint, single boolean, bytes binary"
    return texts.mapInArrow(cut, schema)


def _in_suffix_order(contexts: DataFrame, length: int, keep_first: bool) -> DataFrame:
    """(h1, h2, begin, end) to remove, from contexts of anchors with few enough of them."""
    columns = ["anchor", "h1", "h2", "low", "place", "single", "bytes"]

    def judge(rows: list[dict]) -> pa.RecordBatch:
        contexts, groups, places = zip(*((r["bytes"], r["anchor"], r["place"] - r["low"]) for r in rows), strict=True)
        owner, window = repeated_windows(contexts, groups, places, length, keep_first)
        owner, begin, end = _intervals(owner, window, length)
        kept = [k for k, o in enumerate(owner.tolist()) if keep_first or rows[o]["single"]]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([rows[owner[k]]["h1"] for k in kept], pa.int64()),
                pa.array([rows[owner[k]]["h2"] for k in kept], pa.int64()),
                pa.array([rows[owner[k]]["low"] + int(begin[k]) for k in kept], pa.int64()),
                pa.array([rows[owner[k]]["low"] + int(end[k]) for k in kept], pa.int64()),
            ],
            ["h1", "h2", "begin", "end"],
        )

    def bundles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Whole anchors until a bundle is full; the rows come sorted by anchor.
        rows, held, anchor = [], 0, None
        for batch in batches:
            for row in batch.to_pylist():
                if row["anchor"] != anchor and held >= BUNDLE_BYTES:
                    yield judge(rows)
                    rows, held = [], 0
                anchor = row["anchor"]
                rows.append(row)
                held += len(row["bytes"])
        if rows:
            yield judge(rows)

    laid = contexts.repartition("anchor").sortWithinPartitions("anchor", F.col("order").asc_nulls_first(), "h1", "h2", "low")
    return laid.select(*columns).mapInArrow(bundles, "h1 bigint, h2 bigint, begin bigint, end bigint")


def _by_window_hash(contexts: DataFrame, length: int, keep_first: bool) -> DataFrame:
    """The same for anchors with very many contexts: one row per window, met by hash."""
    kind = contexts.schema["order"].dataType.simpleString()

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch, "bytes"):
                raw = part.column("bytes").to_pylist()
                data = np.frombuffer(b"".join(raw), np.uint8)
                sizes = np.array([len(r) for r in raw])
                n_windows = sizes - length + 1
                owner = np.repeat(np.arange(len(raw)), n_windows)
                window = np.arange(len(owner)) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows)
                at = (np.cumsum(sizes) - sizes)[owner] + window
                names = ["h1", "h2", "order", "anchor", "single", "low"]
                taken = [part.column(c).take(pa.array(owner)) for c in names]
                found = range_hash(hash_prefix(data), at, at + length).view(np.int64)
                start = np.asarray(taken[-1]) + window
                yield pa.RecordBatch.from_arrays(
                    [*taken[:-1], pa.array(found), pa.array(start)], [*names[:-1], "window", "start"]
                )

    rows = contexts.mapInArrow(
        windows, f"h1 bigint, h2 bigint, order {kind}, anchor bigint, single boolean, window bigint, start bigint"
    )
    place = F.struct(F.col("order").isNotNull(), "order", "h1", "h2", "start")
    runs = rows.groupBy("anchor", "window").agg(F.count("*").alias("n"), F.min(place).alias("first"))
    met = rows.join(runs.where("n > 1"), ["anchor", "window"])
    gone = place > F.col("first") if keep_first else F.col("single")
    return met.where(gone).select("h1", "h2", F.col("start").alias("begin"), (F.col("start") + length).alias("end"))


def removals(
    docs: DataFrame,
    key: str = "doc_id",
    length: int = LENGTH,
    gram: int = GRAM,
    keep_first: bool = False,
    most_contexts: int = MOST_CONTEXTS,
) -> DataFrame:
    """(h1, h2, begin, end): byte ranges to remove, possibly overlapping, by the rows' identity."""
    met = _anchor_rows(docs, key, length, gram)
    often = met.groupBy("anchor").agg(F.count("*").alias("met")).where("met > 1")
    rows = staged(met.join(often, "anchor", "left_semi"), "suffix-anchors")

    place = F.struct(F.col("order").isNotNull(), "order", "h1", "h2", "low", "high", "place")
    contents = rows.groupBy("anchor", "content").agg(F.count("*").alias("n"), F.min(place).alias("first"))
    contents = staged(contents, "suffix-contents")
    kinds = contents.groupBy("anchor").agg(F.count("*").alias("kinds"), F.min("n").alias("least"))

    again = rows.join(contents.where("n > 1"), ["anchor", "content"])
    again = again.where(place > F.col("first")) if keep_first else again
    whole = again.select("h1", "h2", F.col("low").alias("begin"), (F.col("high") + length).alias("end"))

    differ = F.col("kinds") > 1 if keep_first else (F.col("kinds") > 1) & (F.col("least") == 1)
    chosen = contents.join(kinds.where(differ), "anchor").select(
        "anchor", "content", "kinds", (F.col("n") == 1).alias("single"), *[F.col(f"first.{c}") for c in ("order", "h1", "h2", "low", "high", "place")]
    )
    few = _contexts(docs, chosen.where(F.col("kinds") <= most_contexts), key, length)
    found = whole.union(_in_suffix_order(few, length, keep_first))
    crowded = chosen.where(F.col("kinds") > most_contexts)
    if not crowded.isEmpty():
        found = found.union(_by_window_hash(_contexts(docs, crowded, key, length), length, keep_first))
    return found


def dedup(docs: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """`key`, `n_bytes`, `kept` (the remaining bytes) and `spans` (removed byte ranges, ascending, apart) of every row."""
    found = removals(docs, key, **options).groupBy("h1", "h2").agg(F.collect_list(F.struct("begin", "end")).alias("cut"))
    kind = docs.schema[key].dataType.simpleString()

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch):
                kept, spans, sizes = [], [], []
                for text, cut in zip(part.column("text").to_pylist(), part.column("cut").to_pylist(), strict=True):
                    raw, merged = (text or "").encode(), []
                    for begin, end in sorted((c["begin"], c["end"]) for c in cut or ()):
                        if merged and begin <= merged[-1][1]:
                            merged[-1][1] = max(merged[-1][1], end)
                        else:
                            merged.append([begin, end])
                    edges = [0, *(x for m in merged for x in m), len(raw)]
                    kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
                    spans.append([{"begin": b, "end": e} for b, e in merged])
                    sizes.append(len(raw))
                span = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
                yield pa.RecordBatch.from_arrays(
                    [part.column(key), pa.array(sizes, pa.int64()), pa.array(kept, pa.binary()), pa.array(spans, span)],
                    [key, "n_bytes", "kept", "spans"],
                )

    whole = docs.select(key, "text", *_identity(key)).join(found, ["h1", "h2"], "left").select(key, "text", "cut")
    schema = f"`{key}` {kind}, n_bytes bigint, kept binary, spans array<struct<begin:bigint,end:bigint>>"
    return whole.mapInArrow(remove, schema)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup(table(spark, sf_dir, "documents"))
    return kept.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.length("kept")).cast("bigint").alias("n_removed"),
        F.size("spans").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
