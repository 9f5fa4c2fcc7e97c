"""Alignment of the tokens of two tokenizers over the bytes of a text.

Tokenizer A reads a space and the text, B reads the text and puts the space before it
itself. Both token sequences tile the same bytes. With the tokens as rows and bytes as columns,
A times B transposed has the number of shared bytes for every pair of tokens
that overlap. Where a row of that product begins behind the columns of the row before, both
sequences have a token end, and a group ends. Matrices of groups by token ids give, in a second
product, how often each pair of ids stands in one group. The matrices are CSR arrays,
multiplied row by row (see csr.py).

A space between two characters other than white space begins a token of either tokenizer
(no piece of B has a space after another character), so texts are cut there, and tokens,
overlaps, groups and pairs are worked out once for every different stretch that a task meets.

How many documents hold a pair is counted over the corpus: every document is staged with its
distinct pairs, once per document, which are counted by sum, so texts are tokenized once. The table of pairs is bounded by the vocabularies, not the corpus; up to
PAIRS_AT_ONCE pairs (counted) go to every task, beyond that the documents' pairs are
joined with it by shuffle.

Defined results: texts that are null, empty, or whose tokens' bytes differ from the space and
the text (such as those with U+2581) have no tokens: zeros and an empty digest, and no share in
the counts. Special tokens' strings are plain text. Repeated rows and null ids count as
documents of their own. Extra columns are not read.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pingtrace.llm.arrays import portions
from pingtrace.llm.csr import Csr, bounds_of, from_entries, product, ragged
from pingtrace.llm.inputs import table
from pingtrace.llm.token_counts import _byte_symbols
from pingtrace.sources.staging import staged

PAIRS_AT_ONCE = 3_000_000
KNOWN_BYTES = 160_000_000  # about, of what a task remembers of the pieces met
COUNTS_HELD = 2_000_000
#: A space between characters that no tokenizer takes for white space.
CUT = re.compile(r"(?<=[^\s\u180e\u200b\ufeff]) (?=[^\s\u180e\u200b\ufeff])")
PLAIN = re.compile(r"[!-~\u00a1-\u024f]+").fullmatch
#: How byte-level vocabularies of this kind cut texts before merging: a fixed value of the format.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Tokenizers:
    """Contents of both tokenizer files, which travel to the tasks; they are opened there.

    A's library takes long for a short piece. Pieces of printable Latin characters, of which no
    version of Unicode has another opinion, go through the faster library for the same vocabulary,
    if its merges come in the order of the ids that they make; there both do the same.
    """

    def __init__(self, path_a: str, path_b: str):
        with open(path_a, encoding="utf-8") as file:
            self.file_a = file.read()
        with open(path_b, "rb") as file:
            self.file_b = file.read()
        import sentencepiece

        self.width_b = sentencepiece.SentencePieceProcessor(model_proto=self.file_b).get_piece_size()

    def open(self) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks side by side
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(self.file_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=self.file_b)
        model = json.loads(self.file_a)["model"]
        byte_of = {s: b for b, s in enumerate(_byte_symbols())}
        # Special tokens are outside this vocabulary or never met.
        of_a = {i: bytes(byte_of[c] for c in s) for s, i in model["vocab"].items() if all(c in byte_of for c in s)}
        self.bytes_a = ByteTable([of_a.get(i, b"") for i in range(max(of_a) + 1)])
        pieces = [self.b.id_to_piece(i) for i in range(self.width_b)]
        self.bytes_b = ByteTable(
            [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        )
        self.separable = not any("▁" in p.lstrip("▁") for p in pieces)
        self.fast = None
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        made = [model["vocab"][a + b] for a, b in pairs]
        if made == sorted(set(made)) and json.loads(self.file_a)["normalizer"] is None:
            import tiktoken

            ranks = {raw: i for i, raw in of_a.items() if i <= made[-1]}
            self.fast = tiktoken.Encoding("a", pat_str=WORD_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def pieces(self, text: str) -> list[str]:
        """The text without the spaces that it is cut at."""
        return CUT.split(text) if self.separable else [text]

    def _encode_a(self, pieces: list[str]) -> list[list[int]]:
        found = [self.fast.encode_ordinary(" " + p) if self.fast and PLAIN(p) else None for p in pieces]
        slow = [k for k, ids in enumerate(found) if ids is None]
        for k, e in zip(slow, self.a.encode_batch([" " + pieces[k] for k in slow], add_special_tokens=False), strict=True):
            found[k] = e.ids
        return found

    def encode(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of A and their number in each piece after a space, and those of B; none where the bytes differ."""
        raw = [(" " + p).encode() for p in pieces]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        data = np.frombuffer(b"".join(raw), np.uint8)
        sides, whole = [], np.ones(len(pieces), dtype=bool)
        for lists, table in ((self._encode_a(pieces), self.bytes_a), (self.b.encode(pieces, num_threads=1), self.bytes_b)):
            counts = np.fromiter(map(len, lists), np.int64, len(lists))
            ids = np.fromiter(chain.from_iterable(lists), np.int64, int(counts.sum()))
            sides.append((ids, counts))
            whole &= table.spells(ids, counts, data, sizes)
        kept = []
        for ids, counts in sides:
            kept += [ids[np.repeat(whole, counts)], np.where(whole, counts, 0)]
        return tuple(kept)


class ByteTable:
    """The bytes of every token."""

    def __init__(self, tokens: list[bytes]):
        self.sizes = np.array([len(t) for t in tokens], np.int64)
        self.starts = bounds_of(self.sizes)[:-1]
        self.data = np.frombuffer(b"".join(tokens), np.uint8)

    def spells(self, ids: np.ndarray, counts: np.ndarray, data: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Whether the tokens of each piece spell its bytes; pieces lie end to end in `data`."""
        per_token = bounds_of(self.sizes[ids])
        ends = bounds_of(counts)
        fits = per_token[ends[1:]] - per_token[ends[:-1]] == sizes
        some = np.repeat(fits, counts)
        spelt = self.data[ragged(self.starts[ids[some]], self.sizes[ids[some]])]
        same = bounds_of(spelt == data[np.repeat(fits, sizes)])
        ends = bounds_of(sizes[fits])
        fits[fits] = same[ends[1:]] - same[ends[:-1]] == sizes[fits]
        return fits


def tiling(sizes: np.ndarray) -> Csr:
    """Tokens by bytes, for tokens of these lengths end to end."""
    n = int(sizes.sum())
    return Csr(bounds_of(sizes), np.arange(n), np.ones(n, np.int64), n)


def groups_of(overlap: Csr) -> tuple[np.ndarray, np.ndarray]:
    """Group of every token of A and of B, from the matrix of shared bytes."""
    first, last = overlap.columns[overlap.bounds[:-1]], overlap.columns[overlap.bounds[1:] - 1]
    fresh = np.ones(overlap.rows, dtype=bool)
    fresh[1:] = first[1:] > last[:-1]
    group_a = np.cumsum(fresh) - 1
    back = overlap.transposed()
    return group_a, group_a[back.columns[back.bounds[:-1]]]


class Grown:
    """An array that is added to, with room to spare."""

    def __init__(self, dtype=np.int64):
        self.room, self.n = np.zeros(1024, dtype), 0

    def add(self, values: np.ndarray) -> None:
        if self.n + len(values) > len(self.room):
            room = np.zeros(2 * (self.n + len(values)), self.room.dtype)
            room[: self.n] = self.room[: self.n]
            self.room = room
        self.room[self.n : self.n + len(values)] = values
        self.n += len(values)

    @property
    def values(self) -> np.ndarray:
        return self.room[: self.n]


class Ragged:
    """Rows of several sizes, one after the other."""

    def __init__(self, n_columns: int = 1):
        self.ends, self.columns = Grown(), [Grown() for _ in range(n_columns)]
        self.ends.add(np.zeros(1, np.int64))

    def add(self, sizes: np.ndarray, *columns: np.ndarray) -> None:
        self.ends.add(self.ends.values[-1] + np.cumsum(sizes))
        for grown, values in zip(self.columns, columns, strict=True):
            grown.add(values)

    def sizes(self) -> np.ndarray:
        return np.diff(self.ends.values)

    def places(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sizes of these rows, and the places of their entries."""
        starts = self.ends.values[rows]
        sizes = self.ends.values[rows + 1] - starts
        return sizes, ragged(starts, sizes)


class PairTable:
    """Documents of each pair of ids, and whether that is the most for its id of A."""

    def __init__(self, pairs: np.ndarray, docs: np.ndarray, best: np.ndarray):
        order = np.argsort(pairs)
        self.pairs, self.docs, self.best = pairs[order], docs[order], best[order]

    def of(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.pairs, pairs)
        return self.docs[at], self.best[at].astype(np.int64)


class Lexicon:
    """What the pieces met so far come to; `keep` names what is asked for: pairs, digests, tokens."""

    def __init__(self, tokenizers: Tokenizers, keep: tuple[str, ...]):
        self.tokenizers, self.keep = tokenizers, keep
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.bytes = 0
        self.n_a, self.n_b, self.n_groups, self.n_links = Grown(), Grown(), Grown(), Grown()
        self.digests: list[str] = []
        self.a, self.b = Ragged(2), Ragged(2)  # id, group within the piece
        self.overlaps = Ragged(3)  # token of A, token of B within the piece, shared bytes
        self.pairs = Ragged(2)  # pair of ids, links

    def numbers(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the pieces of all texts, and where each text's begin."""
        if self.bytes > KNOWN_BYTES:
            self.clear()
        cut = [self.tokenizers.pieces(t) if t else [] for t in texts]
        flat = list(chain.from_iterable(cut))
        new = list(set(flat).difference(self.known))
        if new:
            self.learn(new)
        found = np.fromiter(map(self.known.__getitem__, flat), np.int64, len(flat))
        return found, bounds_of(np.array([len(pieces) for pieces in cut], np.int64))

    def learn(self, pieces: list[str]) -> None:
        a, sizes_a, b, sizes_b = self.tokenizers.encode(pieces)
        n, ends_a, ends_b = len(pieces), bounds_of(sizes_a), bounds_of(sizes_b)
        rows = tiling(self.tokenizers.bytes_a.sizes[a])
        overlap = product(rows, tiling(self.tokenizers.bytes_b.sizes[b]).transposed())
        group_a, group_b = groups_of(overlap)
        n_groups = int(group_a[-1]) + 1 if len(a) else 0
        piece_a, piece_b = np.repeat(np.arange(n), sizes_a), np.repeat(np.arange(n), sizes_b)
        whole = sizes_a > 0
        first_group, groups = np.zeros(n, np.int64), np.zeros(n, np.int64)
        first_group[whole] = group_a[ends_a[:-1][whole]]
        groups[whole] = group_a[ends_a[1:][whole] - 1] + 1 - first_group[whole]

        # Ids of A within a piece by groups, times groups by ids of B.
        width = self.tokenizers.width_b
        held, row = np.unique((piece_a << 32) | a, return_inverse=True)
        left = from_entries(row, group_a, np.ones(len(a), np.int64), len(held), max(n_groups, 1))
        links = product(left, from_entries(group_b, b, np.ones(len(b), np.int64), max(n_groups, 1), width))
        owner = held[links.row_of_entry()]
        pairs, piece = (owner & 0xFFFFFFFF) * width + links.columns, owner >> 32

        self.n_a.add(sizes_a)
        self.n_b.add(sizes_b)
        self.n_groups.add(groups)
        self.n_links.add(_sums(piece, links.values, n))
        if "pairs" in self.keep:
            self.pairs.add(np.bincount(piece, minlength=n), pairs, links.values)
        if "tokens" in self.keep:
            token = overlap.row_of_entry()
            self.a.add(sizes_a, a, group_a - first_group[piece_a])
            self.b.add(sizes_b, b, group_b - first_group[piece_b])
            shared = np.bincount(piece_a[token], minlength=n)
            of = piece_a[token]
            self.overlaps.add(shared, token - ends_a[of], overlap.columns - ends_b[of], overlap.values)
        if "digests" in self.keep:
            self.digests += _digests(a, group_a, b, group_b, n_groups, bounds_of(groups))
        start = len(self.known)
        self.known.update(zip(pieces, range(start, start + n), strict=True))
        per_token = {"pairs": 16, "digests": 12, "tokens": 80}
        self.bytes += sum(map(len, pieces)) + 250 * n + len(a) * sum(per_token[k] for k in self.keep)


_DIGITS: list[ByteTable] = []


def _digests(a: np.ndarray, group_a: np.ndarray, b: np.ndarray, group_b: np.ndarray, n_groups: int, bounds: np.ndarray) -> list[str]:
    """The groups of every piece as text; `bounds` has where the pieces' groups begin."""
    most = max(int(a.max(initial=0)), int(b.max(initial=0))) + 1
    if not _DIGITS or len(_DIGITS[-1].sizes) < most:
        _DIGITS.append(ByteTable([f"{i},".encode() for i in range(max(most, 1 << 16))]))
    digits = _DIGITS[-1]
    a_at, b_at = (bounds_of(np.bincount(g, minlength=n_groups)) for g in (group_a, group_b))
    # The tokens of A and then of B, group by group, each with a sign behind it.
    ids = np.zeros(len(a) + len(b), np.int64)
    ids[np.arange(len(a)) + b_at[group_a]] = a
    ids[np.arange(len(b)) + a_at[group_b + 1]] = b
    sizes = digits.sizes[ids]
    written = digits.data[ragged(digits.starts[ids], sizes)]
    ends = bounds_of(sizes)
    written[ends[a_at[1:] + b_at[:-1]] - 1] = ord("|")
    written[ends[a_at[1:] + b_at[1:]] - 1] = ord(";")
    whole = written.tobytes().decode("ascii")
    places = ends[(a_at + b_at)[bounds]].tolist()
    return [whole[i : j - 1] if j > i else "" for i, j in zip(places, places[1:], strict=False)]


def _sums(owner: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, np.int64)
    np.add.at(out, owner, values)
    return out


class Texts:
    """The pieces of a portion of texts; pieces of texts whose bytes differ are left out."""

    def __init__(self, lexicon: Lexicon, texts: list[str | None]):
        self.lexicon = lexicon
        number, bounds = lexicon.numbers([t or "" for t in texts])
        text = np.repeat(np.arange(len(texts)), np.diff(bounds))
        whole = np.ones(len(texts), dtype=bool)
        whole[text[lexicon.n_a.values[number] == 0]] = False
        keep = whole[text]
        self.number, self.text = number[keep], text[keep]
        self.bounds = bounds_of(np.bincount(self.text, minlength=len(texts)))
        self.n = len(texts)

    def total(self, per_piece: np.ndarray) -> np.ndarray:
        sums = bounds_of(per_piece[self.number])
        return sums[self.bounds[1:]] - sums[self.bounds[:-1]]

    def document_pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, pair, links) of the distinct pairs of every text."""
        pieces = len(self.lexicon.known)
        key, times = np.unique(self.text * pieces + self.number, return_counts=True)
        text, number = key // max(pieces, 1), key % max(pieces, 1)
        sizes, at = self.lexicon.pairs.places(number)
        pair, links = (c.values[at] for c in self.lexicon.pairs.columns)
        links = links * np.repeat(times, sizes)
        found, inverse = np.unique((np.repeat(text, sizes) << 33) | pair, return_inverse=True)
        return found >> 33, found & ((1 << 33) - 1), _sums(inverse, links, len(found))


def _mapped(docs: DataFrame, schema: str, rows: Callable, tokenizers: Tokenizers, keep: tuple[str, ...]) -> DataFrame:
    """`rows(batch, texts)` of every portion of `docs` (with the column `text`), as columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizers.open()
        lexicon = Lexicon(tokenizers, keep)
        for batch in batches:
            for part in portions(batch, "text"):
                found = rows(part, Texts(lexicon, part.column("text").to_pylist()))
                yield pa.RecordBatch.from_arrays(list(found.values()), list(found))

    return docs.mapInArrow(run, schema)


def _taken(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).alias("id"), F.col(text).alias("text"))


def _lists(bounds: np.ndarray, per_piece: np.ndarray, values: np.ndarray) -> pa.Array:
    """The values of all pieces as one list for each text; `bounds` are the texts' in pieces."""
    ends = bounds_of(per_piece)[bounds]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))


def aligned(docs: DataFrame, tokenizers: Tokenizers, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The whole alignment of every row: ids and groups of the tokens of both, and all overlaps.

    `a_groups` and `b_groups` number the groups from 0; an overlap has the places of its
    tokens and the bytes that they share.
    """

    def rows(part: pa.RecordBatch, texts: Texts) -> dict:
        lexicon, out = texts.lexicon, {key: part.column("id")}
        before = {}  # what stands before each piece in its text
        for name, per_piece in (("groups", lexicon.n_groups.values), ("a", lexicon.n_a.values), ("b", lexicon.n_b.values)):
            sums = bounds_of(per_piece[texts.number])
            before[name] = sums[:-1] - sums[texts.bounds[texts.text]]
        for name, tokens in (("a", lexicon.a), ("b", lexicon.b)):
            sizes, at = tokens.places(texts.number)
            ids, groups = (c.values[at] for c in tokens.columns)
            out[f"{name}_ids"] = _lists(texts.bounds, sizes, ids)
            out[f"{name}_groups"] = _lists(texts.bounds, sizes, groups + np.repeat(before["groups"], sizes))
        sizes, at = lexicon.overlaps.places(texts.number)
        a, b, shared = (c.values[at] for c in lexicon.overlaps.columns)
        out["overlap_a"] = _lists(texts.bounds, sizes, a + np.repeat(before["a"], sizes))
        out["overlap_b"] = _lists(texts.bounds, sizes, b + np.repeat(before["b"], sizes))
        out["overlap_bytes"] = _lists(texts.bounds, sizes, shared)
        return out

    kind = docs.schema[key].dataType.simpleString()
    names = "a_ids a_groups b_ids b_groups overlap_a overlap_b overlap_bytes".split()
    schema = ", ".join([f"`{key}` {kind}", *[f"{n} array<bigint>" for n in names]])
    return _mapped(_taken(docs, key, text), schema, rows, tokenizers, ("tokens",))


def pair_counts(docs: DataFrame, tokenizers: Tokenizers, text: str = "text") -> DataFrame:
    """a, b, docs and best of every pair of ids that a document has linked, staged.

    `docs` counts the documents; `best` tells that no pair of the same id of A has more.
    """

    def rows(part: pa.RecordBatch, texts: Texts) -> dict:
        owner, pair, _ = texts.document_pairs()
        return {"pairs": _lists(np.arange(texts.n + 1), np.bincount(owner, minlength=texts.n), pair)}

    documents = docs.select(F.col(text).alias("text"))
    return _count_pairs(_mapped(documents, "pairs array<bigint>", rows, tokenizers, ("pairs",)), tokenizers.width_b)


def _count_pairs(documents: DataFrame, width: int) -> DataFrame:
    """`pair_counts` from the distinct pairs (column `pairs`) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch.column("pairs").flatten().to_numpy())
            size += len(held[-1])
            if size > COUNTS_HELD:
                yield added(held)
                held, size = [], 0
        if held:
            yield added(held)

    def added(held: list[np.ndarray]) -> pa.RecordBatch:
        pairs, count = np.unique(np.concatenate(held), return_counts=True)
        columns = [pairs // width, pairs % width, count.astype(np.int64)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["a", "b", "docs"])

    mapped = documents.select("pairs").mapInArrow(run, "a bigint, b bigint, docs bigint")
    pairs = staged(mapped.groupBy("a", "b").agg(F.sum("docs").alias("docs")), "alignment-counts")
    most = pairs.groupBy("a").agg(F.max("docs").alias("most"))
    return staged(pairs.join(most, "a").select("a", "b", "docs", (F.col("docs") == F.col("most")).alias("best")), "alignment-pairs")


_COUNTS = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string"
_RESULT = "n_a n_b n_groups n_links n_best count_sum groups_sha256".split()


def _counts(texts: Texts) -> dict:
    lexicon = texts.lexicon
    digests, numbers, bounds = lexicon.digests, texts.number.tolist(), texts.bounds.tolist()
    written = [";".join([digests[k] for k in numbers[i:j]]) for i, j in zip(bounds[:-1], bounds[1:], strict=True)]
    return {
        "n_a": pa.array(texts.total(lexicon.n_a.values)),
        "n_b": pa.array(texts.total(lexicon.n_b.values)),
        "n_groups": pa.array(texts.total(lexicon.n_groups.values)),
        "n_links": pa.array(texts.total(lexicon.n_links.values)),
        "groups_sha256": pa.array([sha256(w.encode()).hexdigest() if w else "" for w in written]),
    }


def _documents(docs: DataFrame, tokenizers: Tokenizers, key: str, text: str) -> DataFrame:
    """Every row's numbers and digest, with its distinct pairs and their links, staged."""

    def rows(part: pa.RecordBatch, texts: Texts) -> dict:
        owner, pair, links = texts.document_pairs()
        sizes, each = np.bincount(owner, minlength=texts.n), np.arange(texts.n + 1)
        return {"id": part.column("id"), "row": part.column("row")} | _counts(texts) | {
            name: _lists(each, sizes, values) for name, values in (("pairs", pair), ("links", links))
        }

    kind = docs.schema[key].dataType.simpleString()
    schema = f"id {kind}, row bigint, {_COUNTS}, pairs array<bigint>, links array<bigint>"
    numbered = _taken(docs, key, text).withColumn("row", F.monotonically_increasing_id())
    return staged(_mapped(numbered, schema, rows, tokenizers, ("pairs", "digests")), "alignment-documents")


def link_summary(docs: DataFrame, tokenizers: Tokenizers, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key`, numbers of tokens, groups and links, what the corpus's counts make of the links, and the digest."""
    found = _documents(docs, tokenizers, key, text)
    pairs = _count_pairs(found, tokenizers.width_b)
    if pairs.count() > PAIRS_AT_ONCE:
        return _summary_by_shuffle(found, pairs, tokenizers.width_b, key)
    got = pairs.toArrow()
    a, b, count, best = (np.asarray(got[c].combine_chunks().to_numpy(zero_copy_only=False)) for c in ("a", "b", "docs", "best"))
    counted = PairTable(a * tokenizers.width_b + b, count, best)

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, links = batch.column("pairs"), batch.column("links").flatten().to_numpy()
            docs_of, best_of = counted.of(lists.flatten().to_numpy())
            ends = bounds_of(lists.value_lengths().to_numpy(zero_copy_only=False))
            sums = [np.diff(bounds_of(links * of)[ends]) for of in (best_of, docs_of)]
            kept = batch.drop_columns(["pairs", "links"])
            yield pa.RecordBatch.from_arrays([*kept.columns, *map(pa.array, sums)], [*kept.schema.names, "n_best", "count_sum"])

    kind = docs.schema[key].dataType.simpleString()
    summed = found.mapInArrow(look_up, f"id {kind}, row bigint, {_COUNTS}, n_best bigint, count_sum bigint")
    # In the order of the table, as one map over it would give them.
    return summed.orderBy("row").select(F.col("id").alias(key), *_RESULT)


def _summary_by_shuffle(found: DataFrame, pairs: DataFrame, width: int, key: str) -> DataFrame:
    """The same where the table of pairs is too large to be sent: every document's pairs meet it in a join."""
    pairs = pairs.select((F.col("a") * width + F.col("b")).alias("pairs"), "docs", "best")
    linked = found.select("row", F.explode(F.arrays_zip("pairs", "links")).alias("p")).select("row", "p.*")
    sums = linked.join(pairs, "pairs").groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("n_best"),
        F.sum(F.col("links") * F.col("docs")).alias("count_sum"),
    )
    return found.join(sums, "row", "left").fillna(0, ["n_best", "count_sum"]).select(F.col("id").alias(key), *_RESULT)


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path
    return link_summary(
        table(spark, sf_dir, "documents"), Tokenizers(path("byte_bpe_50k.json"), path("piece_bpe_32k.model"))
    )
