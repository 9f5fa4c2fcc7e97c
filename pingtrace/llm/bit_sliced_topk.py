"""Exact top-k inner-product search over a bit-sliced index.

Vectors are made integers (floor of `SCALE` times each component). The index holds
blocks of rows; in a block every component, less its smallest value there, is cut to its
leading bits and stored as bit slices, one bitmap over the rows for each bit. For
a query, slices of equal weight are added by carry-save adders, 64 rows to a machine
word (slices of negative weights are complemented), which leaves the slices of a coarse
score. Walking these from the most significant one down finds the k-th highest coarse
score. The bits cut off bound every exact score from both sides, so a second
walk leaves only the rows that can still be among the k highest, or beat those of
earlier blocks; they are scored in exact integers.

Queries go in passes of bounded size against the staged index: a pass ships its queries,
every task keeps the k best of its blocks for each of them, and only those are shuffled.

Defined results: a vector that is null or holds a null, NaN or infinite component takes no
part, neither as query nor as candidate. Components are limited to +-2**24 after scaling, so
that sums stay in 64 bits. A shorter vector counts as followed by zeros; an empty one scores 0.
A query's own row is every row with its id; a null id is nobody's own and comes after all
others among ties. Repeated candidates are each found; repeated queries are each answered.
Ids are integers. Extra columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from pingtrace.llm.inputs import table
from pingtrace.sources.staging import new_folder, staged

SCALE = 256
LARGEST = 1 << 24  # of a scaled component
PLANES = 7  # leading bits of a component that have a slice
BLOCK_CELLS = 1 << 22  # components in a block of the index
QUERY_CELLS = 1 << 21  # components of the queries in a pass
K = 5
EVERY = 50  # of the vectors, one in so many is a query

INDEX_SCHEMA = "ids array<bigint>, width int, cut int, low binary, vectors binary, slices binary"


def whole_numbers(vectors: DataFrame, key: str, vector: str, scale: int = SCALE) -> DataFrame:
    """(id, v): vectors that take part, as integers."""
    x = f"`{vector}`"
    finite = F.expr(f"forall({x}, x -> x is not null and abs(cast(x as double)) < cast('Infinity' as double))")
    scaled = F.expr(
        f"transform({x}, x -> cast(floor(greatest(least({scale} * cast(x as double), {LARGEST}D), -{LARGEST}D)) as int))"
    )
    # NaN is above infinity in Spark's order, so the bound leaves it out.
    return vectors.where(F.col(vector).isNotNull() & finite).select(
        F.col(key).cast("bigint").alias("id"), scaled.alias("v")
    )


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column as rows of equal length, zeros after the end of shorter ones."""
    sizes = np.asarray(column.value_lengths()).astype(np.int64)
    flat = np.asarray(column.flatten()).astype(np.int64)
    out = np.zeros((len(sizes), width), np.int64)
    starts = np.cumsum(sizes) - sizes
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(starts, sizes)] = flat
    return out


def _as_words(bits: np.ndarray) -> np.ndarray:
    """Truth values (last axis: rows) as uint64 words, 64 rows each."""
    rows = bits.shape[-1]
    padded = np.zeros((*bits.shape[:-1], -(-rows // 64) * 64), np.uint8)
    padded[..., :rows] = bits
    return np.packbits(padded, axis=-1, bitorder="little").view(np.uint64)


def slice_block(vectors: np.ndarray) -> tuple[np.ndarray, int, np.ndarray]:
    """Smallest value of each component, bits cut off, and slices (component, bit, word) of a block."""
    low = vectors.min(axis=0) if vectors.size else np.zeros(vectors.shape[1], np.int64)
    above = vectors - low
    bits = int(above.max(initial=0)).bit_length()
    cut = max(bits - PLANES, 0)
    coarse = (above >> cut).T
    planes = bits - cut
    slices = np.stack([_as_words((coarse >> b) & 1) for b in range(planes)], axis=1) if planes else (
        np.zeros((vectors.shape[1], 0, -(-len(vectors) // 64)), np.uint64)
    )
    return low, cut, slices


def build_index(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The staged index of all vectors that take part; one row is a block."""
    whole = staged(whole_numbers(vectors, key, vector), "topk-vectors")
    shape = whole.agg(F.count("*").alias("rows"), F.max(F.size("v")).alias("width")).first()
    width = max(shape["width"] or 0, 1)
    block_rows = max(64, BLOCK_CELLS // width)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, block_rows - count)
                batch = batch.slice(part.num_rows)
                held.append(part)
                count += part.num_rows
                if count == block_rows:
                    yield block(held)
                    held, count = [], 0
        if held:
            yield block(held)

    def block(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(parts).combine_chunks()
        matrix = _matrix(rows["v"].combine_chunks(), width)
        low, cut, slices = slice_block(matrix)
        ids = rows["id"].to_pylist()
        return pa.RecordBatch.from_arrays(
            [
                pa.array([ids], pa.list_(pa.int64())),
                pa.array([width], pa.int32()),
                pa.array([cut], pa.int32()),
                pa.array([low.tobytes()], pa.binary()),
                pa.array([matrix.astype(np.int32).tobytes()], pa.binary()),
                pa.array([slices.tobytes()], pa.binary()),
            ],
            ["ids", "width", "cut", "low", "vectors", "slices"],
        )

    tasks = max(vectors.sparkSession.sparkContext.defaultParallelism, -(-shape["rows"] // block_rows))
    return staged(whole.repartition(tasks).mapInArrow(blocks, INDEX_SCHEMA), "topk-index")


class Query:
    """Weights of a query, and which slices stand for which power of two in its score."""

    def __init__(self, query_id: int | None, weights: np.ndarray):
        self.id, self.weights, self.size = query_id, weights, np.abs(weights)
        self.total = int(self.size.sum())
        self.negative = weights < 0
        bits = int(self.size.max(initial=0)).bit_length()
        self.owners = [np.flatnonzero((self.size >> c) & 1) for c in range(bits)]

    def coarse(self, slices: np.ndarray) -> list[np.ndarray]:
        """Slices of the coarse score of every row, least significant first."""
        planes, levels = slices.shape[1], {}
        flip = np.where(self.negative, np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0))[:, None]
        for c, owner in enumerate(self.owners):
            for b in range(planes):
                levels.setdefault(b + c, []).append(slices[owner, b] ^ flip[owner])
        found, level, top = [], 0, max(levels, default=-1)
        while level <= top:
            parts = levels.pop(level, [])
            stack = np.concatenate(parts) if parts else np.zeros((0, slices.shape[2]), np.uint64)
            while len(stack) > 1:
                stack, carry = _add(stack)
                levels.setdefault(level + 1, []).append(carry)
                top = max(top, level + 1)
            found.append(stack[0] if len(stack) else np.zeros(slices.shape[2], np.uint64))
            level += 1
        return found


def _add(stack: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One round of adders over bitmaps of equal weight: their sums and carries."""
    if len(stack) == 2:
        return stack[:1] ^ stack[1:], stack[:1] & stack[1:]
    n = len(stack) // 3
    a, b, c = stack[:n], stack[n : 2 * n], stack[2 * n : 3 * n]
    either = a ^ b
    return np.concatenate([either ^ c, stack[3 * n :]]), (a & b) | (c & either)


def _count(bitmap: np.ndarray) -> int:
    return int(np.bitwise_count(bitmap).sum())


def kth_highest(score: list[np.ndarray], rows: np.ndarray, k: int) -> int | None:
    """k-th highest score among `rows` (a bitmap), by the slices from the most significant one down."""
    if _count(rows) < k:
        return None
    tied, above, value = rows, 0, 0
    for p in range(len(score) - 1, -1, -1):
        ones = tied & score[p]
        n = _count(ones)
        if above + n >= k:
            tied, value = ones, value | (1 << p)
        else:
            above += n
            tied = tied & ~score[p]
    return value


def at_least(score: list[np.ndarray], rows: np.ndarray, bound: int) -> np.ndarray:
    """Those of `rows` whose score is `bound` or more."""
    if bound <= 0:
        return rows
    if bound >> len(score):
        return np.zeros_like(rows)
    more, tied = np.zeros_like(rows), rows
    for p in range(len(score) - 1, -1, -1):
        if bound >> p & 1:
            tied = tied & score[p]
        else:
            more |= tied & score[p]
            tied = tied & ~score[p]
    return more | tied


class Block:
    def __init__(self, ids: pa.Array, width: int, cut: int, low: bytes, vectors: bytes, slices: bytes):
        self.none = np.asarray(ids.is_null())
        self.ids = np.asarray(ids.fill_null(0))
        self.cut, self.low = cut, np.frombuffer(low, np.int64)
        self.vectors = np.frombuffer(vectors, np.int32).reshape(len(self.ids), width)
        words = -(-len(self.ids) // 64)
        self.slices = np.frombuffer(slices, np.uint64).reshape(width, -1, words)
        self.rows = _as_words(np.ones(len(self.ids), np.uint8))

    def others(self, query: Query) -> np.ndarray:
        """Rows but the query's own, as a bitmap."""
        if query.id is None:
            return self.rows
        own = (self.ids == query.id) & ~self.none
        return self.rows & ~_as_words(own) if own.any() else self.rows

    def candidates(self, query: Query, k: int, known: int | None) -> np.ndarray:
        """Rows that can be among the k highest of the block and reach the score `known`."""
        rows = self.others(query)
        score = query.coarse(self.slices)
        planes = self.slices.shape[1]
        # exact = start + 2**cut * coarse + rest, with rest in [least, least + (2**cut - 1) * total].
        flipped = int(query.size[query.negative].sum())
        step = 1 << self.cut
        start = int(query.weights @ self.low) - step * ((1 << planes) - 1) * flipped
        least, spread = -(step - 1) * flipped, (step - 1) * query.total
        bound = 0
        kth = kth_highest(score, rows, k)
        if kth is not None:
            bound = kth - spread // step
        if known is not None:
            bound = max(bound, -((start + least + spread - known) // step))
        hits = at_least(score, rows, bound)
        return np.flatnonzero(np.unpackbits(hits.view(np.uint8), bitorder="little"))


class Best:
    """The k best (score, id) so far."""

    def __init__(self, k: int):
        self.k = k
        self.score, self.id, self.none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def known(self) -> int | None:
        return int(self.score[-1]) if len(self.score) == self.k else None

    def take(self, score: np.ndarray, ids: np.ndarray, none: np.ndarray) -> None:
        score, ids, none = (
            np.concatenate(x) for x in ((self.score, score), (self.id, ids), (self.none, none))
        )
        order = np.lexsort((ids, none, -score))[: self.k]
        self.score, self.id, self.none = score[order], ids[order], none[order]


def _pass(index: DataFrame, queries: pa.Table, number: int, k: int) -> DataFrame:
    """The k best of every task for each of `queries`."""
    ids, vectors = queries["id"].to_pylist(), queries["v"].combine_chunks()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, best = None, [Best(k) for _ in ids]
        for batch in batches:
            for row in range(batch.num_rows):
                block = Block(batch.column("ids")[row].values, *(batch.column(c)[row].as_py() for c in (
                    "width", "cut", "low", "vectors", "slices")))
                if asked is None:
                    # A component beyond the index's width meets only zeros.
                    width = max(block.vectors.shape[1], int(np.asarray(vectors.value_lengths()).max()))
                    weights = _matrix(vectors, width)[:, : block.vectors.shape[1]]
                    asked = [Query(i, w) for i, w in zip(ids, weights, strict=True)]
                for query, found in zip(asked, best, strict=True):
                    rows = block.candidates(query, k, found.known())
                    if len(rows):
                        exact = block.vectors[rows].astype(np.int64) @ query.weights
                        found.take(exact, block.ids[rows], block.none[rows])
        for place, (query_id, found) in enumerate(zip(ids, best, strict=True)):
            n = len(found.score)
            if n:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([number] * n, pa.int64()),
                        pa.array([place] * n, pa.int64()),
                        pa.array([query_id] * n, pa.int64()),
                        pa.array(found.id, mask=found.none),
                        pa.array(found.score),
                    ],
                    ["part", "place", "query_id", "id", "score"],
                )

    return index.mapInArrow(search, "part bigint, place bigint, query_id bigint, id bigint, score bigint")


def search(
    index: DataFrame, queries: DataFrame, k: int = K, key: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """query_id, rank, id and score of each query's k highest rows of the index."""
    spark = index.sparkSession
    whole = whole_numbers(queries, key, vector)
    shape = whole.agg(F.count("*").alias("rows"), F.max(F.size("v")).alias("width")).first()
    parts = max(1, -(-shape["rows"] * max(shape["width"] or 0, 1) // QUERY_CELLS))
    # Dealt by row, not by id: a repeated id must not fill one pass.
    part = F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(parts))
    dealt = staged(whole.withColumn("part", part), "topk-queries")
    path = new_folder(spark, "topk-found")
    found_schema = "part bigint, place bigint, query_id bigint, id bigint, score bigint"
    spark.createDataFrame([], found_schema).write.parquet(path)
    for number in range(parts):
        asked = dealt.where(F.col("part") == number).select("id", "v").toArrow()
        if asked.num_rows:
            _pass(index, asked, number, k).write.mode("append").parquet(path)
    order = Window.partitionBy("part", "place").orderBy(F.desc("score"), F.col("id").asc_nulls_last())
    ranked = spark.read.schema(found_schema).parquet(path).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "id", "score")


def op13_bit_sliced_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    found = search(build_index(vectors), vectors.where(F.col("vec_id") % EVERY == 0))
    return found.withColumnRenamed("id", "vec_id")


#: The same by scoring every row for every query.
ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x AS double)) AS bigint)) AS q
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
),
scored AS (
  SELECT a.vec_id AS query_id, b.vec_id, cast(coalesce(list_sum(list_transform(
    range(1, least(len(a.q), len(b.q)) + 1), lambda i: a.q[i] * b.q[i])), 0) AS bigint) AS score
  FROM v a JOIN v b ON a.vec_id IS DISTINCT FROM b.vec_id
  WHERE a.vec_id % 50 = 0
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id NULLS LAST) AS place FROM scored
)
SELECT query_id, cast(place AS integer) AS rank, vec_id, score FROM ranked WHERE place <= 5
"""
