"""Similarity join on word n-grams: documents whose sets of n-grams have a Jaccard index of at least a bound.

Equal sets are one class (a 64-bit hash of the set, with its size). Classes are
laid out in bands of set size; a tile takes a band and the next, as far as sizes
in it can be similar enough. The symmetric difference of two similar sets is
bounded by the tile's sizes, so when the range of n-gram hashes is cut into more
parts than that bound, similar sets agree in the remaining number of whole parts.
A tile is therefore divided by (part, content of the part), and only classes that
meet there are compared. Parts without n-grams tell nothing; a set leaves them out
if it has fewer of them than parts must agree, since then another part agrees too.

1. each class with the smallest one that it meets in any division, and with the
   smallest in its smallest division (at most two pairs per class, however large
   a division is);
2. within divisions that then still hold several components, as few pairs as would
   join those components whose classes may be similar: at most one less than there are
   components;
3. within divisions that even then hold several components, all classes that may be
   similar to one of another component come with their arrays and are compared, until
   their components are joined. Only links that join two of them leave the group. Divisions are
   taken in up to MOST_ROUNDS rounds, so that not all copies of arrays are on disk at once.

Divisions of over TILE_ROWS classes (or ARRAY_BYTES of arrays) are cut into blocks, and each pair of
blocks is a group of its own in steps 2 and 3. So no step makes more rows than the divisions
have classes, times the blocks.

Whether two classes may be similar is told by hashed signatures of two bits per n-gram or more (of
different lengths, the longer is folded): every bit of one that the other lacks is
an n-gram the other lacks, which bounds the overlap from above. Pairs
that pass are decided by intersecting the sorted n-gram arrays. No pair of
similar classes is lost, nor are copies expanded into pairs.

Defined results: words are lower-cased (A-Z) runs without ASCII white space; a
text with fewer than n words is one n-gram; null, empty and blank texts have no
n-gram, link with nothing and are their own component. Rows with the same text
link whatever their ids; the component is the smallest id that is not null.
Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pingtrace.llm.arrays import LOWER, gram_hashes, mix, portions, utf8, word_hashes
from pingtrace.llm.components import components, merged
from pingtrace.llm.inputs import fresh_names, table
from pingtrace.sources.staging import release, staged

LEAST_BITS, MOST_BITS = 1024, 1 << 16
SLACK = 0.18  # parts beyond the bound, as a share of it, for parts without n-grams
TILE_ROWS = 1024
ARRAY_BYTES = 1 << 25  # of n-gram arrays in a block
ARRAY_ROWS = 256
MOST_ROUNDS = 8
TILE_BITS = 8  # of a division's key, for the number of its tile
BROADCAST_ROWS = 200_000
_U = np.uint64
_SHORT = 0xA0761D6478BD642F


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> list[np.ndarray]:
    """Sorted distinct n-gram hashes of every text."""
    words, bounds = word_hashes(LOWER[data], offsets)
    grams = gram_hashes(words, n)
    sets = []
    for begin, end in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if end - begin >= n:
            sets.append(np.unique(grams[begin : end - n + 1]))
        elif end > begin:
            whole = np.array([_SHORT * (end - begin) % (1 << 64)], np.uint64)
            for w in range(begin, end):
                whole = mix(whole + words[w : w + 1])
            sets.append(whole)
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


def set_hash(grams: np.ndarray) -> int:
    """Class of a set: equal for equal sets."""
    total = (int(mix(grams).sum(dtype=np.uint64)) + len(grams) * _SHORT) % (1 << 64)
    return int(mix(np.array([total], np.uint64)).view(np.int64)[0])


def signature(grams: np.ndarray) -> bytes:
    n_bits = min(max(LEAST_BITS, 2 << len(grams).bit_length()), MOST_BITS)
    bits = np.zeros(n_bits, np.uint8)
    bits[(grams & _U(n_bits - 1)).astype(np.int64)] = 1
    return np.packbits(bits).tobytes()


@dataclass(frozen=True)
class Similarity:
    """Sets of n-grams are similar if 100 * intersection >= percent * union."""

    n: int
    percent: int

    def holds(self, both, a, b):
        return both * (100 + self.percent) >= self.percent * (a + b)

    def band_edges(self, most: int) -> list[int]:
        """Smallest size of each band; neighbours only can be similar across bands."""
        edges = [1]
        while edges[-1] <= most:
            edges.append(max(edges[-1] + 1, -(-edges[-1] * 10_000 // self.percent**2)))
        return edges

    def tiles(self, size: int) -> list[tuple[int, int, int]]:
        """(tile, number of parts, parts that similar sets agree in) of each tile of a set of this size."""
        edges = self.band_edges(size)
        home = len(edges) - 2
        found = []
        for band in (home - 1, home):
            if band < 0:
                continue
            top = -(-edges[band] * 10_000 // self.percent**2)
            most = max(edges[band] + 1, top) - 1  # largest set of the band
            largest = most * 100 // self.percent
            if size <= largest:
                bound = (most + largest) * (100 - self.percent) // (100 + self.percent)
                agree = 5 + int(bound * SLACK)
                found.append((band, bound + agree, agree))
        return found

    def block_rows(self, tile_rows: int) -> list[int]:
        """Classes in a block, by the tile's number: `tile_rows`, or as many as have ARRAY_BYTES of arrays."""
        edges = self.band_edges(ARRAY_BYTES)
        most = [(edges[min(t + 2, len(edges) - 1)] - 1) * 8 for t in range(1 << TILE_BITS)]
        return [min(tile_rows, max(1, ARRAY_BYTES // size)) for size in most]

    def keys(self, grams: np.ndarray) -> np.ndarray:
        """The divisions of all tiles that a set belongs to."""
        spread, keys = mix(grams), []
        sums = np.concatenate([[_U(0)], np.cumsum(spread, dtype=np.uint64)])
        high = grams >> _U(32)
        for tile, parts, agree in self.tiles(len(grams)):
            starts = (np.arange(parts + 1, dtype=np.uint64) << _U(32)) // _U(parts)
            at = np.searchsorted(high, starts)
            held = np.diff(at)
            content = (sums[at[1:]] - sums[at[:-1]]) + held.astype(np.uint64) * _U(_SHORT)
            place = np.arange(parts, dtype=np.uint64) + _U(tile << 40)
            found = mix(content ^ mix(place)) >> _U(TILE_BITS) << _U(TILE_BITS)
            found |= _U(min(tile, (1 << TILE_BITS) - 1))
            keys.append(found[held > 0] if (held == 0).sum() < agree else found)
        return np.concatenate(keys)


def _parse(docs: DataFrame, key: str, similarity: Similarity, columns, schema: str) -> DataFrame:
    """`columns(ids, sets)` of every portion of the texts."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch):
                sets = shingle_sets(*utf8(part.column("text")), similarity.n)
                yield pa.RecordBatch.from_pydict(columns(part.column(key), sets))

    return docs.select(key, "text").mapInArrow(parse, schema)


def _classes(docs: DataFrame, key: str, similarity: Similarity) -> DataFrame:
    kind = docs.schema[key].dataType.simpleString()
    return _parse(
        docs,
        key,
        similarity,
        lambda ids, sets: {
            key: ids,
            "size": pa.array([len(s) for s in sets], pa.int64()),
            "class": pa.array([set_hash(s) for s in sets], pa.int64()),
            "bits": pa.array([signature(s) for s in sets], pa.binary()),
        },
        f"`{key}` {kind}, size bigint, class bigint, bits binary",
    )


def _division_rows(docs: DataFrame, key: str, similarity: Similarity) -> DataFrame:
    def rows(_, sets):
        held = [s for s in sets if len(s)]
        keys = [similarity.keys(s) for s in held]
        owner = np.repeat(np.array([set_hash(s) for s in held], np.int64), [len(k) for k in keys])
        flat = np.concatenate(keys).view(np.int64) if keys else np.zeros(0, np.int64)
        return {"division": pa.array(flat), "class": pa.array(owner)}

    return _parse(docs, key, similarity, rows, "division bigint, class bigint")


def _arrays(docs: DataFrame, key: str, similarity: Similarity) -> DataFrame:
    return _parse(
        docs,
        key,
        similarity,
        lambda _, sets: {
            "class": pa.array([set_hash(s) for s in sets], pa.int64()),
            "grams": pa.array([s.tobytes() for s in sets], pa.binary()),
        },
        "class bigint, grams binary",
    )


def _overlap_bound(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Most n-grams that sets with these signatures (uint64 words, last axis) can share."""
    only_a = np.bitwise_count(a & ~b).sum(-1, dtype=np.int64)
    only_b = np.bitwise_count(b & ~a).sum(-1, dtype=np.int64)
    return np.minimum(size_a - only_a, size_b - only_b)


def _folded(signatures: list[bytes], n_bytes: int) -> np.ndarray:
    """Signatures as rows of uint64 words, all folded to one length."""
    rows = [
        raw if len(raw) == n_bytes else np.bitwise_or.reduce(np.frombuffer(raw, np.uint8).reshape(-1, n_bytes)).tobytes()
        for raw in signatures
    ]
    return np.frombuffer(b"".join(rows), np.uint64).reshape(-1, n_bytes // 8)


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """While rows with whole arrays go to Python: few of them at once, whatever the arrays' sizes."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, ARRAY_ROWS)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _side(frame: DataFrame, name: str) -> DataFrame:
    return frame.select(*[F.col(c).alias(name if c == "class" else f"{c}_{name}") for c in frame.columns])


def linked(pairs: DataFrame, sets: DataFrame, arrays: DataFrame, similarity: Similarity) -> DataFrame:
    """Those pairs (a, b) of classes that are similar, staged: signatures first, then the arrays."""

    def may_be(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = np.asarray(batch.column("size_a")), np.asarray(batch.column("size_b"))
            bits_a, bits_b = batch.column("bits_a").to_pylist(), batch.column("bits_b").to_pylist()
            n_bytes = np.array([min(len(x), len(y)) for x, y in zip(bits_a, bits_b, strict=True)], np.int64)
            good = np.zeros(batch.num_rows, dtype=bool)
            for n in np.unique(n_bytes).tolist():
                at = np.flatnonzero(n_bytes == n)
                x, y = (_folded([bits[k] for k in at], n) for bits in (bits_a, bits_b))
                good[at] = similarity.holds(_overlap_bound(x, y, a[at], b[at]), a[at], b[at])
            yield batch.select(["a", "b"]).filter(pa.array(good))

    def are(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("grams_a"), batch.column("grams_b"), strict=True):
                a, b = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(bool(similarity.holds(both, len(a), len(b))))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    marked = pairs.join(_side(sets, "a"), "a").join(_side(sets, "b"), "b")
    passed = marked.select("a", "b", "size_a", "size_b", "bits_a", "bits_b").mapInArrow(may_be, "a bigint, b bigint")
    passed = staged(passed, "jaccard-passed")
    exact = passed.join(_side(arrays, "a"), "a").join(_side(arrays, "b"), "b")
    exact = exact.select("a", "b", "grams_a", "grams_b").mapInArrow(are, "a bigint, b bigint")
    with _small_batches(pairs.sparkSession):
        return staged(exact, "jaccard-links")


class _Parts:
    """The components of a group, as far as they are not joined yet."""

    def __init__(self, component: np.ndarray):
        self.of = np.unique(component, return_inverse=True)[1]
        self.left = int(self.of.max(initial=-1)) + 1

    def join(self, i: int, j: int) -> None:
        self.of[self.of == self.of[j]] = self.of[i]
        self.left -= 1


def _hits(group: pa.Table, parts: _Parts, similarity: Similarity) -> Iterator[tuple[int, np.ndarray]]:
    """Rows of one block, each with those of the other that it may be similar to, in a part not its own."""
    size, block = np.asarray(group["size"]), np.asarray(group["block"])
    raw = group["bits"].to_pylist()
    bits = _folded(raw, min(map(len, raw)))
    block_a, block_b = group["block_a"][0].as_py(), group["block_b"][0].as_py()
    first, second = np.flatnonzero(block == block_a), np.flatnonzero(block == block_b)
    for at, i in enumerate(first.tolist()):
        if parts.left < 2:
            return
        others = second[at + 1 :] if block_a == block_b else second
        others = others[parts.of[others] != parts.of[i]]
        most = _overlap_bound(bits[i], bits[others], size[i], size[others])
        yield i, others[similarity.holds(most, size[i], size[others])]


GROUP = ["division", "block_a", "block_b"]


def _possible_links(tiles: DataFrame, similarity: Similarity) -> DataFrame:
    """Pairs (a, b) within each group that would join all components that may be similar: a forest."""

    def compare(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        classes, parts, found = np.asarray(group["class"]), _Parts(np.asarray(group["component"])), []
        for i, hits in _hits(group, parts, similarity):
            for j in hits.tolist():
                if parts.of[i] != parts.of[j]:
                    parts.join(i, j)
                    found.append(sorted((classes[i], classes[j])))
        pairs = np.array(found, np.int64).reshape(-1, 2)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    return tiles.groupBy(*GROUP).applyInArrow(compare, "a bigint, b bigint")


def _in_question(tiles: DataFrame, similarity: Similarity) -> DataFrame:
    """Rows of `tiles` without bits, of classes that may be similar to one of another component in their group."""
    schema = "division bigint, block_a int, block_b int, block int, class bigint, component bigint, size bigint"

    def compare(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        parts, keep = _Parts(np.asarray(group["component"])), np.zeros(len(group), dtype=bool)
        for i, hits in _hits(group, parts, similarity):
            keep[hits] = True
            keep[i] |= len(hits) > 0
        return group.select([*GROUP, "block", "class", "component", "size"]).filter(pa.array(keep))

    return tiles.groupBy(*GROUP).applyInArrow(compare, schema)


def _joining_links(tiles: DataFrame, similarity: Similarity) -> DataFrame:
    """Links (a, b) that join the components of each group, found by their arrays."""

    def compare(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        classes, parts, found = np.asarray(group["class"]), _Parts(np.asarray(group["component"])), []
        grams = [np.frombuffer(x.as_buffer(), np.uint64) for x in group["grams"]]
        group = group.append_column("bits", pa.array([signature(x) for x in grams], pa.binary()))
        for i, hits in _hits(group, parts, similarity):
            for j in hits.tolist():
                if parts.of[i] != parts.of[j]:
                    both = len(np.intersect1d(grams[i], grams[j], assume_unique=True))
                    if similarity.holds(both, len(grams[i]), len(grams[j])):
                        parts.join(i, j)
                        found.append((classes[i], classes[j]))
        pairs = np.array(found, np.int64).reshape(-1, 2)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    return tiles.groupBy(*GROUP).applyInArrow(compare, "a bigint, b bigint")


def _joined_in_rounds(asked: DataFrame, sets: DataFrame, arrays: DataFrame, similarity: Similarity) -> DataFrame | None:
    """`_joining_links` of `asked`, whose rows take their arrays along; None if there are no rows.

    A class is asked for in many groups, each with a copy of its array. So whole groups are taken in
    as many rounds as the copies have times the bytes of all arrays (MOST_ROUNDS at most), and each round's shuffle
    files are let go before the next.
    """
    copies, stored = asked.agg(F.sum("size")).first()[0], sets.agg(F.sum("size")).first()[0]
    if copies is None:
        return None
    rounds, found = min(MOST_ROUNDS, -(-copies // stored)), None
    for turn in range(rounds):
        part = asked.where(F.pmod(F.xxhash64(*GROUP), F.lit(rounds)) == turn)
        few = part.count() <= BROADCAST_ROWS
        whole = arrays.join(F.broadcast(part) if few else part, "class")
        with _small_batches(asked.sparkSession):
            links = staged(_joining_links(whole, similarity), "jaccard-joining")
        found = links if found is None else found.union(links)
        release(asked.sparkSession)
    return found


def _blocks(members: DataFrame, similarity: Similarity, tile_rows: int) -> DataFrame:
    """Rows of `members`, each once for every pair of blocks that its block is in."""
    sizes = F.array(*[F.lit(rows) for rows in similarity.block_rows(tile_rows)])
    tile = F.col("division").bitwiseAND((1 << TILE_BITS) - 1).cast("int")
    count = F.ceil(F.col("n") / F.element_at(sizes, tile + 1)).cast("int")
    block = F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int")
    own = members.withColumn("blocks", count).withColumn("block", block)
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    return own.withColumn("_other", other).select(
        "division",
        "class",
        "component",
        "size",
        "bits",
        "block",
        F.least("block", "_other").alias("block_a"),
        F.greatest("block", "_other").alias("block_b"),
    )


def _mixed_divisions(
    members: DataFrame, known: DataFrame, sets: DataFrame, similarity: Similarity, tile_rows: int, among: DataFrame | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Divisions with several components (of `among`, if given), the pairs of those with two classes, the rows of the others.

    Of divisions with the same classes one is enough.
    """
    if among is not None:
        members = members.join(among.select("division"), "division", "left_semi")
    named = members.select("division", "class").join(known.withColumnRenamed("node", "class"), "class", "left")
    named = named.withColumn("component", F.coalesce("component", "class"))
    named = staged(named, "jaccard-named")
    mixed = named.groupBy("division").agg(
        F.min("component").alias("c0"),
        F.max("component").alias("c1"),
        F.count("*").alias("n"),
        F.sum(F.shiftright("class", 20)).alias("total"),
        F.min("class").alias("k0"),
        F.max("class").alias("k1"),
        F.expr("bit_xor(class)").alias("x"),
    )
    mixed = mixed.where("c0 <> c1").groupBy("n", "total", "k0", "k1", "x").agg(F.min("division").alias("division"))
    mixed = staged(mixed, "jaccard-mixed")
    tiles = named.join(mixed.where("n > 2").select("division", "n"), "division").join(sets, "class")
    twos = mixed.where("n = 2").select(F.col("k0").alias("a"), F.col("k1").alias("b"))
    return mixed, twos, _blocks(tiles, similarity, tile_rows)


def similar_components(
    docs: DataFrame, similarity: Similarity, key: str = "doc_id", tile_rows: int = TILE_ROWS
) -> DataFrame:
    """`key`, size, class, group and component of every row of `docs`.

    The group names the connected classes (null without n-grams), the component
    is the smallest id in the group.
    """
    rows = staged(_classes(docs, key, similarity), "jaccard-rows")
    sets = rows.where("size > 0").groupBy("class").agg(F.first("size").alias("size"), F.first("bits").alias("bits"))

    divided = _division_rows(docs, key, similarity).repartition("division")
    shared = divided.groupBy("division").agg(
        F.min("class").alias("low"), F.max("class").alias("high"), F.count("*").alias("held")
    )
    members = divided.join(shared.where("low <> high").select("division", "low", "held"), "division")
    members = staged(members.distinct(), "jaccard-members")
    release(docs.sparkSession)

    involved = staged(members.select("class").distinct(), "jaccard-involved")
    # A class whose ids are all null is found by the null id.
    met = rows.join(involved, "class", "left_semi").groupBy("class").agg(F.min(key).alias("_id"))
    met = staged(met.select("_id").distinct(), "jaccard-ids")
    sets = staged(sets.join(involved, "class", "left_semi"), "jaccard-sets")
    wanted = F.broadcast(met) if met.count() <= BROADCAST_ROWS else met
    texts = docs.select(key, "text").join(wanted, F.col(key).eqNullSafe(F.col("_id")), "left_semi")
    arrays = _arrays(texts, key, similarity).join(involved, "class", "left_semi").dropDuplicates(["class"])
    arrays = staged(arrays, "jaccard-arrays")

    near = members.where("low <> class").groupBy(F.col("class").alias("b")).agg(
        F.array_distinct(F.array(F.min("low"), F.min_by("low", F.struct("held", "low")))).alias("a")
    )
    near = staged(near.select(F.explode("a").alias("a"), "b"), "jaccard-pairs")
    links = linked(near, sets, arrays, similarity)

    release(docs.sparkSession)
    known = components(links)
    mixed, twos, tiles = _mixed_divisions(members, known, sets, similarity, tile_rows)
    rest = _possible_links(tiles, similarity).union(twos).distinct()
    rest = staged(rest.join(near, ["a", "b"], "left_anti"), "jaccard-rest")
    if not rest.isEmpty():
        known = merged(known, linked(rest, sets, arrays, similarity))
        mixed, _, tiles = _mixed_divisions(members, known, sets, similarity, tile_rows, mixed)
        asked = staged(_in_question(tiles, similarity), "jaccard-asked")
        release(docs.sparkSession)
        joining = _joined_in_rounds(asked, sets, arrays, similarity)
        if joining is not None and not joining.isEmpty():
            known = merged(known, joining)

    classes = rows.where("size > 0").groupBy("class").agg(F.min(key).alias("lowest"))
    classes = classes.join(known.withColumnRenamed("node", "class"), "class", "left")
    classes = classes.select("class", F.coalesce("component", "class").alias("group"), "lowest")
    lowest = classes.groupBy("group").agg(F.min("lowest").alias("component"))
    labels = staged(classes.join(lowest, "group").select("class", "group", "component"), "jaccard-labels")
    full = rows.select(key, "size", "class").where("size > 0").join(labels, "class")
    empty = rows.where("size = 0").select(
        key, "size", "class", F.lit(None).cast("bigint").alias("group"), F.col(key).alias("component")
    )
    return full.select(key, "size", "class", "group", "component").union(empty)


def keep_first(docs: DataFrame, similarity: Similarity, key: str = "doc_id") -> DataFrame:
    """One row of each component, with all columns: that of the smallest id, ids before null.

    Rows without n-grams stay; columns may have any names. Among rows of one id the smallest class is taken,
    and of rows equal in id and class any one.
    """
    found = staged(similar_components(docs, similarity, key).where("size > 0"), "jaccard-found")
    of, gone, own = fresh_names(docs, "id", "dropped", "class")
    entry = F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("_id"), F.col("class").alias("_class"))
    first = found.groupBy("group").agg(F.min(entry).alias("first"))
    kept_one = F.col(key).eqNullSafe(F.col("first._id")) & (F.col("class") == F.col("first._class"))
    beside = found.join(first, "group").where(~kept_one)
    drop = staged(beside.select(F.col(key).alias(of), F.col("class").alias(gone)).distinct(), "jaccard-dropped")
    drop = F.broadcast(drop) if drop.count() <= BROADCAST_ROWS else drop

    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch):
                classes = [set_hash(s) for s in shingle_sets(*utf8(part.column("text")), similarity.n)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(classes, pa.int64())], [*part.schema.names, own])

    marked = docs.mapInArrow(classify, T.StructType([*docs.schema.fields, T.StructField(own, T.LongType())]))
    kept = marked.join(drop, F.col(key).eqNullSafe(F.col(of)) & (F.col(own) == F.col(gone)), "left_anti")
    if not found.groupBy(key, "class").count().where("count > 1").isEmpty():
        # Rows equal in id and class: one of each stays, and every row without n-grams.
        blank = set_hash(np.zeros(0, np.uint64))
        empty = kept.where(F.col(own) == blank)
        kept = kept.where(F.col(own) != blank).dropDuplicates([key, own]).union(empty)
    return kept.drop(own)


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = similar_components(table(spark, sf_dir, "documents"), Similarity(n=3, percent=90))
    return found.select("doc_id", F.col("size").alias("n_shingles"), F.col("component").alias("component_id"))


#: The same by meeting documents on every n-gram and following links to the smallest id.
ORACLE_SQL = """
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents
),
sets AS (
  SELECT doc_id, CASE WHEN len(w) > 2 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i:i + 2]))
                      WHEN len(w) > 0 THEN [w] ELSE [] END AS grams
  FROM split
),
held AS (SELECT doc_id, len(grams) AS n, unnest(grams) AS gram FROM sets),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM held a JOIN held b ON a.gram = b.gram AND a.doc_id <> b.doc_id
  WHERE 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
),
reached AS (
  SELECT doc_id, doc_id AS other FROM sets
  UNION
  SELECT r.doc_id, l.y FROM reached r JOIN links l ON l.x = r.other
)
SELECT s.doc_id, cast(len(s.grams) AS bigint) AS n_shingles, min(r.other) AS component_id
FROM sets s JOIN reached r ON r.doc_id = s.doc_id GROUP BY s.doc_id, s.grams
"""
