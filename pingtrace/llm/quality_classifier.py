"""Quality classifier: random Fourier features, ridge regression, isotonic calibration.

Statistics of the whole text are standardised and mapped by a seeded random
matrix to cosines whose inner products approximate a Gaussian kernel. Each
partition of the training rows adds up its part of the normal equations; the
parts are summed by Spark and only the FEATURES x FEATURES system comes to the
driver. A second part of the labelled rows calibrates the ridge score by isotonic
regression (pool adjacent violators), interpolated between the pools.

Training rows: labelled rows outside the held-out fold. Above MOST_TRAINING of
them a hash of the id chooses a share of about that many; everything else covers
all documents. Labels, language, source and id never enter a score.

Defined results: null and empty texts have zero statistics and are scored like
any other; without usable labels every score is 0.5, with labels of one class
only it is that class; labels that are null or neither 0 nor 1 are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pingtrace.llm.inputs import fold, table
from pingtrace.llm.text_stats import COUNTS, with_counts
from pingtrace.sources.staging import staged

MOST_TRAINING = 40_000
FEATURES = 96
RIDGE = 1e-3
WIDTH = 3.0
SEED = 17
CALIBRATION_SHARE = 4  # one in so many training rows calibrates
THRESHOLD = 0.7
_SLOPE = 0.02  # share of the raw score in the result, so that equal pools keep its order


def statistics(c: dict[str, np.ndarray]) -> np.ndarray:
    """One row of ratios and logarithms per text, from its counts."""

    def share(part: str, whole: str) -> np.ndarray:
        return c[part] / np.maximum(c[whole], 1)

    return np.stack(
        [
            np.log1p(c["n_words"]),
            np.log1p(share("word_chars", "n_words")),
            np.sqrt(share("n_symbols", "word_chars")),
            np.sqrt(share("n_dup_lines", "n_lines")),
            np.sqrt(share("n_repeat_words", "n_words")),
            share("n_distinct_words", "n_words"),
            np.sqrt(share("n_adjacent", "n_words")),
            np.sqrt(share("n_upper", "n_letters")),
            np.sqrt(share("n_digits", "word_chars")),
            np.sqrt(share("n_marks", "word_chars")),
            np.sqrt(share("n_stops", "n_words")),
            np.sqrt(share("n_long_words", "n_words")),
            np.log1p(share("n_words", "n_lines")),
            share("n_letters", "n_bytes"),
        ],
        axis=1,
    )


class Cosines:
    """The seeded feature map, for standardised statistics."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray):
        random = np.random.default_rng(SEED)
        self.mean, self.scale = mean, scale
        self.weights = random.standard_normal((len(mean), FEATURES - 1)) / WIDTH
        self.phases = random.uniform(0, 2 * np.pi, FEATURES - 1)

    def __call__(self, stats: np.ndarray) -> np.ndarray:
        waves = np.cos(((stats - self.mean) / self.scale) @ self.weights + self.phases)
        return np.hstack([waves * np.sqrt(2 / (FEATURES - 1)), np.ones((len(stats), 1))])


def _columns(batch: pa.RecordBatch) -> np.ndarray:
    return statistics({c: np.asarray(batch.column(c), dtype=np.float64) for c in COUNTS})


def _sums(training: DataFrame, parts) -> np.ndarray:
    """Sum over all rows of the vectors that `parts(stats, labels)` makes of each partition's rows."""

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = parts(_columns(batch), np.asarray(batch.column("_label"), dtype=np.float64))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["i", "v"])

    summed = training.select(*COUNTS, "_label").mapInArrow(add_up, "i bigint, v double")
    rows = summed.groupBy("i").agg(F.sum("v").alias("v")).collect()
    result = np.zeros(len(rows))
    for row in rows:
        result[row["i"]] = row["v"]
    return result


def pool_adjacent_violators(scores: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the isotonic fit: mean score and mean label of every pool, both rising."""
    order = np.argsort(scores, kind="stable")
    pools: list[list[float]] = []  # sum of scores, sum of labels, size
    for s, y in zip(scores[order].tolist(), labels[order].tolist(), strict=True):
        pools.append([s, y, 1.0])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            top = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], top, strict=True)]
    return np.array([p[0] / p[2] for p in pools]), np.array([p[1] / p[2] for p in pools])


class Model:
    def __init__(self, cosines: Cosines, solution: np.ndarray, knots: tuple[np.ndarray, np.ndarray] | None):
        self.cosines, self.solution, self.knots = cosines, solution, knots

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(self.cosines(stats) @ self.solution, -1, 2)

    def score(self, stats: np.ndarray) -> np.ndarray:
        raw = self.raw(stats)
        calibrated = np.interp(raw, *self.knots) if self.knots else np.clip(raw, 0, 1)
        return np.clip((1 - _SLOPE) * calibrated + _SLOPE * (raw + 1) / 3, 0, 1)


def fit(stats: DataFrame, labels: DataFrame, held_out, doc_id: str = "doc_id") -> Model | float:
    """A model, or the constant score where the labels allow no more. `stats` should be staged."""
    usable = labels.where(F.col("quality").isin(0, 1) & ~held_out).select(
        doc_id, F.col("quality").cast("double").alias("_label")
    )
    share = min(1.0, MOST_TRAINING / max(usable.count(), 1))
    order = F.pmod(F.xxhash64(F.lit(SEED), doc_id), F.lit(1_000_000))
    sample = stats.join(usable.where(order < int(share * 1_000_000)), doc_id)
    part = F.pmod(F.xxhash64(F.lit(SEED + 1), doc_id), F.lit(CALIBRATION_SHARE))
    sample = staged(sample.withColumn("_part", part), "quality-training")
    training = sample.where("_part > 0")

    moments = _sums(training, lambda x, y: np.concatenate([[len(y), y.sum()], x.sum(0), (x * x).sum(0)]))
    if not len(moments) or moments[1] in (0, moments[0]):
        return 0.5 if not len(moments) else moments[1] / moments[0]
    n, width = moments[0], (len(moments) - 2) // 2
    mean = moments[2 : 2 + width] / n
    scale = np.sqrt(np.maximum(moments[2 + width :] / n - mean**2, 1e-6))
    cosines = Cosines(mean, scale)

    def equations(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        z = cosines(x)
        return np.concatenate([(z.T @ z).ravel(), z.T @ y])

    summed = _sums(training, equations)
    left, right = summed[: FEATURES**2].reshape(FEATURES, FEATURES), summed[FEATURES**2 :]
    model = Model(cosines, np.linalg.solve(left + RIDGE * n * np.eye(FEATURES), right), None)
    held = sample.where("_part = 0").select(*COUNTS, "_label").toPandas()
    if len(held):
        stats_held = statistics({c: held[c].to_numpy(np.float64) for c in COUNTS})
        model.knots = pool_adjacent_violators(model.raw(stats_held), held["_label"].to_numpy())
    return model


def score_quality(docs: DataFrame, labels: DataFrame, held_out) -> DataFrame:
    """doc_id and score of every row; the texts are read once, their counts staged."""
    stats = staged(with_counts(docs, ("doc_id",)), "quality-stats")
    model = fit(stats, labels, held_out)
    if not isinstance(model, Model):
        return stats.select("doc_id", F.lit(float(model)).alias("score"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(model.score(_columns(batch)), pa.float64())],
                ["doc_id", "score"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return stats.mapInArrow(score, f"doc_id {kind}, score double")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(fold("doc_id", 4) == 2, F.lit(False))
    scored = score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), held_out)
    return scored.select(
        "doc_id",
        held_out.alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
