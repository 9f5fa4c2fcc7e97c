"""Toxicity: a support vector machine with a gap-weighted subsequence kernel.

Kernel. Two words are alike by the triples of letters they share in order, gaps
allowed: an occurrence of a triple at i < j < k with both gaps at most MOST_GAP
weighs DECAY ** (k - i), and the kernel is the inner product of these weights,
divided by the words' lengths in the same measure. Inserted or gapped letters
cost weight, not the match.

Nystroem. A few hundred words are landmarks; a word becomes its kernel values with
them, whitened by the landmarks' own kernel matrix, and a linear machine is trained
on that. The kernel is an inner product over triples, so the machine folds back
into one weight per triple: scoring a text reads nine table entries per letter.

Training sentences. A sentence of a clean document is clean. Of a toxic document
one does not know which sentence is; a sentence is taken as toxic if it holds a
witness, a word that stands in many more different surroundings in toxic documents
than chance would put there, and whose odds of being there are at least WITNESS_ODDS
times those of all words (surroundings, because copies repeat a whole passage). So a
few wrongly labelled or quoting clean documents do not take a witness away. A sentence
scores as its highest word does, so the machine is trained on the witnesses against
the clean sentences' words, and twice more against those clean words that then score
highest. A text scores as its highest sentence. All training is on single words:
what is toxic only as several ordinary words together is not learnt.

Training rows: labelled rows outside the held-out fold, at most MOST_DOCUMENTS of
either label by a hash of the id, and at most MOST_WORDS words of either side.
Everything else covers all documents and whole texts.

Words: lower-cased; characters other than letters and digits are dropped, so that
a word broken by signs is whole; three or more single letters in a row are one word.

Defined results: null and empty texts and texts without words of three letters get
the lowest score; without usable labels of both kinds every score is 0; labels that
are null or neither 0 nor 1 are left out. Labels, language, source and id never
enter a score.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pingtrace.llm.arrays import portions
from pingtrace.llm.inputs import fold, table
from pingtrace.sources.staging import staged

MOST_DOCUMENTS = 8_000
MOST_WORDS = 3_000
LANDMARKS = 256
DECAY = 0.6
MOST_GAP = 3
ALPHABET = 64
THRESHOLD = 0.7
WITNESS_ODDS = 10
SEED = 29
LOWEST = -4.0

_BLANK, _OUT = 255, 254
_SIGNS = re.compile(r"[^\w\s]|_")
_PORTION = 1 << 19


def _letter_code(c: int) -> int:
    """Class of a character: letters and digits 0..ALPHABET-1, white space, or dropped."""
    if chr(c).isspace():
        return _BLANK
    if not chr(c).isalnum():
        return _OUT
    return c - 97 if 97 <= c < 123 else 26 + c % (ALPHABET - 26)


_NEAR = 0x250
_CODES = np.array([_letter_code(c) for c in range(_NEAR)], np.uint8)


def letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letter classes of all words end to end, where each word begins (and the end), and each word's text."""
    points = np.frombuffer("\n".join(t.lower().replace("\n", " ") for t in texts).encode("utf-32-le"), np.uint32)
    codes = _CODES[np.minimum(points, _NEAR - 1)]
    wide = np.flatnonzero(points >= _NEAR)
    if len(wide):
        different, which = np.unique(points[wide], return_inverse=True)
        codes[wide] = np.array([_letter_code(c) for c in different.tolist()], np.uint8)[which]
    text_end = points == 10
    kept = codes != _OUT
    codes, text_end = codes[kept], text_end[kept]
    blank = codes == _BLANK
    row = np.cumsum(text_end)
    before = np.ones(len(codes), dtype=bool)
    before[1:] = blank[:-1]
    starts = np.flatnonzero(~blank & before)
    after = np.ones(len(codes), dtype=bool)
    after[:-1] = blank[1:]
    sizes = np.flatnonzero(~blank & after) + 1 - starts
    rows = row[starts]
    # Three or more single letters in a row are written as one word.
    single = sizes == 1
    joins = np.zeros(len(starts), dtype=bool)
    joins[1:] = single[1:] & single[:-1] & (rows[1:] == rows[:-1])
    group = np.cumsum(~joins) - 1
    in_group = np.bincount(group) if len(group) else np.zeros(0, np.int64)
    head = ~joins | ((in_group[group] < 3) if len(group) else joins)
    sizes = np.add.reduceat(sizes, np.flatnonzero(head)) if len(sizes) else sizes
    bounds = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    return codes[~blank], bounds, rows[head]


def triples(codes: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """For every pair of gaps: the places where a triple fits in its word, the triples, and their weight."""
    last = np.repeat(bounds[1:], np.diff(bounds)) - 1
    place = np.arange(len(codes))
    wide = codes.astype(np.int32)
    for first in range(1, MOST_GAP + 1):
        for second in range(1, MOST_GAP + 1):
            reach = first + second
            at = place[: max(len(codes) - reach, 0)][place[reach:] <= last[: max(len(codes) - reach, 0)]]
            yield at, (wide[at] * ALPHABET + wide[at + first]) * ALPHABET + wide[at + reach], DECAY**reach


def _lengths_squared(most: int) -> np.ndarray:
    """Squared measure of a word of n letters: the sum of its triples' squared weights."""
    total = np.zeros(most + 1)
    for first in range(1, MOST_GAP + 1):
        for second in range(1, MOST_GAP + 1):
            reach = first + second
            total += np.maximum(np.arange(most + 1) - reach, 0) * DECAY ** (2 * reach)
    return np.maximum(total, 1e-9)


def word_scores(codes: np.ndarray, bounds: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Sum of the triples' weights of every word, divided by the word's measure; no triple: 0."""
    per_letter = np.zeros(len(codes) + 1)
    for at, triple, decay in triples(codes, bounds):
        per_letter[at] += weights[triple] * decay
    sizes = np.diff(bounds)
    sums = np.add.reduceat(per_letter, bounds[:-1]) if len(sizes) else np.zeros(0)
    known = _lengths_squared(256)
    return sums / np.sqrt(np.where(sizes <= 256, known[np.minimum(sizes, 256)], known[256] * sizes / 256))


def features(words: list[str]):
    """Rows of triple weights (dense over the triples that occur), and those triples."""
    codes, bounds, _ = letters(words)
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    rows, columns, values = [], [], []
    for at, triple, decay in triples(codes, bounds):
        rows.append(owner[at])
        columns.append(triple)
        values.append(np.full(len(at), decay))
    rows, columns, values = map(np.concatenate, (rows, columns, values))
    measure = np.sqrt(_lengths_squared(int(np.diff(bounds).max(initial=0))))[np.diff(bounds)]
    return rows, columns, values / measure[rows], len(bounds) - 1


def kernel(a, b) -> np.ndarray:
    """Kernel matrix of two sets of words, as `features` gives them."""
    used, place = np.unique(b[1], return_inverse=True)
    right = np.zeros((b[3], len(used)))
    np.add.at(right, (b[0], place), b[2])
    found = np.minimum(np.searchsorted(used, a[1]), max(len(used) - 1, 0))
    hit = used[found] == a[1] if len(used) else np.zeros(0, dtype=bool)
    left = np.zeros((a[3], len(used)))
    np.add.at(left, (a[0][hit], found[hit]), a[2][hit])
    return left @ right.T


def linear_machine(x: np.ndarray, y: np.ndarray, cost: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Hinge-loss machine by dual coordinate ascent; the last column of x should be constant."""
    random = np.random.default_rng(SEED)
    w, alpha, squared = np.zeros(x.shape[1]), np.zeros(len(x)), np.maximum((x * x).sum(1), 1e-12)
    for _ in range(rounds):
        moved = 0.0
        for i in random.permutation(len(x)):
            new = min(max(alpha[i] + (1 - y[i] * (x[i] @ w)) / squared[i], 0.0), cost[i])
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w


def fold_back(positive: list[str], negative: list[str]) -> tuple[np.ndarray, float]:
    """Train on words of both sides; a weight per triple, and the constant."""
    random = np.random.default_rng(SEED)
    half = LANDMARKS // 2
    marks = [side[i] for side in (positive, negative) for i in random.permutation(len(side))[:half]]
    landmarks = features(marks)
    values, vectors = np.linalg.eigh(kernel(landmarks, landmarks))
    good = values > 1e-6 * values.max()
    whiten = vectors[:, good] / np.sqrt(values[good])
    points = kernel(features(positive + negative), landmarks) @ whiten
    points = np.hstack([points, np.ones((len(points), 1))])
    y = np.concatenate([np.ones(len(positive)), -np.ones(len(negative))])
    cost = np.where(y > 0, 10.0 * max(1.0, len(negative) / max(len(positive), 1)) ** 0.5, 10.0)
    solution = linear_machine(points, y, cost)
    by_landmark = whiten @ solution[:-1]
    weights = np.zeros(ALPHABET**3)
    np.add.at(weights, landmarks[1], landmarks[2] * by_landmark[landmarks[0]])
    return weights.astype(np.float32), float(solution[-1])


def _words_of(training: DataFrame) -> DataFrame:
    """(word, around, label) of every word of the training texts, once per document and surroundings."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch, "text", _PORTION):
                found, labels = [], []
                for text, label in zip(part.column("text").to_pylist(), part.column("label").to_pylist(), strict=True):
                    row = _SIGNS.sub("", (text or "").lower()).split()
                    near = zip(row, ["", *row], [*row[1:], ""], strict=False)
                    mine = {(w, crc32(f"{p} {n}".encode())) for w, p, n in near if 3 <= len(w) <= 40}
                    found += mine
                    labels += [label] * len(mine)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([w for w, _ in found], pa.string()),
                        pa.array([c for _, c in found], pa.int64()),
                        pa.array(labels, pa.int64()),
                    ],
                    ["word", "around", "label"],
                )

    return training.select("text", "label").mapInArrow(words, "word string, around bigint, label bigint")


def _evidence(training: DataFrame) -> DataFrame:
    """word, numbers of its different surroundings in toxic and in clean documents."""
    words = _words_of(training).select("word", "around", "label").distinct()
    return words.groupBy("word").agg(F.sum("label").alias("toxic"), F.sum(1 - F.col("label")).alias("clean"))


def chance_of(toxic: int, clean: int, share: float) -> float:
    """P(X >= toxic) of toxic + clean draws that are toxic with chance `share`, where `toxic` is above the mean."""
    n = toxic + clean
    log_term = math.lgamma(n + 1) - math.lgamma(toxic + 1) - math.lgamma(clean + 1)
    log_term += toxic * math.log(share) + clean * math.log1p(-share)
    total, part = 0.0, 1.0
    for k in range(toxic, n + 1):
        total += part
        part *= (n - k) / (k + 1) * share / (1 - share)
        if part < total * 1e-12:
            break
    return math.exp(min(log_term + math.log(total), 0.0))


class Scorer:
    def __init__(self, weights: np.ndarray, constant: float, slope: float = 1.0, shift: float = 0.0):
        self.weights, self.constant, self.slope, self.shift = weights, constant, slope, shift

    def margins(self, texts: list[str]) -> np.ndarray:
        """Of each text, the highest word's margin."""
        codes, bounds, rows = letters(texts)
        result = np.full(len(texts), LOWEST)
        fits = np.diff(bounds) >= 3
        scores = word_scores(codes, bounds, self.weights)[fits] + self.constant
        np.maximum.at(result, rows[fits], scores)
        return np.maximum(result, LOWEST)

    def chances(self, margins: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margins + self.shift, -30, 30)))


def _margins(docs: DataFrame, scorer: Scorer, keep: tuple[str, ...], finish=None) -> DataFrame:
    """Columns `keep` and `margin` (or what `finish` makes of it), one row per row."""
    finish = finish or (lambda m: m)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch, "text", _PORTION):
                texts = [t or "" for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(c) for c in keep] + [pa.array(finish(scorer.margins(texts)), pa.float64())],
                    [*keep, "margin"],
                )

    kept = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)
    columns = list(dict.fromkeys([*keep, "text"]))
    return docs.select(*columns).mapInArrow(score, kept + "margin double")


def separate(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift that put the best cut between the classes at THRESHOLD."""
    order = np.argsort(margins)
    m, y = margins[order], labels[order]
    wrong = np.concatenate([[0], np.cumsum(y)]) + np.concatenate([np.cumsum((1 - y)[::-1])[::-1], [0]])
    edges = np.concatenate([[m[0] - 1], (m[1:] + m[:-1]) / 2, [m[-1] + 1]])
    gaps = np.concatenate([[0], np.diff(m), [0]])
    best = np.flatnonzero(wrong == wrong.min())
    cut = edges[best[np.argmax(gaps[best])]]
    slope = 4.0
    return slope, float(np.log(THRESHOLD / (1 - THRESHOLD)) - slope * cut)


def train(docs: DataFrame, labels: DataFrame, held_out) -> Scorer | None:
    usable = labels.where(F.col("toxic").isin(0, 1) & ~held_out).select(
        "doc_id", F.col("toxic").cast("long").alias("label")
    )
    sizes = {r["label"]: r["count"] for r in usable.groupBy("label").count().collect()}
    if len(sizes) < 2:
        return None
    order = F.pmod(F.xxhash64(F.lit(SEED), "doc_id"), F.lit(1_000_000))
    share = {k: min(1.0, MOST_DOCUMENTS / n) * 1_000_000 for k, n in sizes.items()}
    usable = usable.where(order < F.when(F.col("label") == 1, share[1]).otherwise(share[0]))
    # Labels of the sample are few, so they are sent to the texts once counted.
    if sum(min(n, MOST_DOCUMENTS) for n in sizes.values()) <= 4 * MOST_DOCUMENTS:
        usable = F.broadcast(usable)
    training = staged(docs.select("doc_id", "text").join(usable, "doc_id"), "toxic-training")
    evidence = staged(_evidence(training), "toxic-words")

    toxic_share = training.agg(F.avg("label")).first()[0]
    totals = evidence.agg(F.count("*"), F.sum("toxic"), F.sum("clean")).first()
    n_words = totals[0]
    if toxic_share is None or not n_words:
        return None
    share = min(max(toxic_share, totals[1] / (totals[1] + totals[2])), 0.9)
    odds = WITNESS_ODDS * share / (1 - share)
    apart = (F.col("toxic") >= 2) & (F.col("toxic") + 0.5 >= odds * (F.col("clean") + 0.5))
    # Words by their counts, which are few; chance alone would make less than a tenth of a word a witness.
    kinds = evidence.where(apart).groupBy("toxic", "clean").count().collect()
    beyond = [(r["toxic"], r["clean"]) for r in kinds if chance_of(r["toxic"], r["clean"], share) * 10 * n_words < 1]
    chosen = beyond or [(r["toxic"], r["clean"]) for r in kinds]  # with few labels the best words stand in
    pairs = docs.sparkSession.createDataFrame(chosen, "toxic bigint, clean bigint")
    witnesses = evidence.join(F.broadcast(pairs), ["toxic", "clean"])
    positive = [r["word"] for r in witnesses.orderBy(F.desc("toxic"), "word").limit(MOST_WORDS).collect()]
    clean = evidence.where(F.col("clean") > 0).join(F.broadcast(pairs), ["toxic", "clean"], "left_anti")
    clean = clean.select("word", F.col("word").alias("text"))
    by_hash = clean.orderBy(F.xxhash64("word"), "word").limit(MOST_WORDS).collect()
    negative = [r["word"] for r in by_hash]
    if not positive or not negative:
        return None
    scorer = Scorer(*fold_back(positive, negative))
    for _ in range(2):
        hardest = _margins(clean, scorer, ("word",)).orderBy(F.desc("margin"), "word").limit(MOST_WORDS // 3)
        negative = list(dict.fromkeys(negative + [r["word"] for r in hardest.collect()]))
        scorer = Scorer(*fold_back(positive, negative))
    # Only margins and labels of the sampled documents come back.
    judged = _margins(training, scorer, ("label",)).toPandas()
    scorer.slope, scorer.shift = separate(judged["margin"].to_numpy(), judged["label"].to_numpy(np.float64))
    return scorer


def score_toxicity(docs: DataFrame, labels: DataFrame, held_out, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns `keep` and `score` of every row of `docs`, whose labelled rows outside the fold are learnt from."""
    scorer = train(docs, labels, held_out)
    if scorer is None:
        return docs.select(*keep, F.lit(0.0).alias("score"))
    return _margins(docs, scorer, keep, scorer.chances).withColumnRenamed("margin", "score")


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of `docs` that score below THRESHOLD, with all their columns and no shuffle."""
    scorer = train(docs, labels, held_out())
    if scorer is None:
        return docs

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch, "text", _PORTION):
                texts = [t or "" for t in part.column("text").to_pylist()]
                yield part.filter(pa.array(scorer.chances(scorer.margins(texts)) < THRESHOLD))

    return docs.mapInArrow(keep, docs.schema)


def held_out():
    return F.coalesce(fold("doc_id", 3) == 1, F.lit(False))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = score_toxicity(docs, labels, held_out())
    return scored.select(
        "doc_id",
        held_out().alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
