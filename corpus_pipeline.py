"""From documents to a training mix: the stages of the text operators, one after the other.

Every stage but the last returns the columns of its documents. A stage is judged
on what its predecessor kept; nothing else is limited or sampled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pingtrace.llm import decontamination, jaccard_join, mixing, secret_scan, toxicity
from pingtrace.llm.inputs import fresh_names, table
from pingtrace.sources.staging import staged

#: The toxicity classifier is trained, which SQL cannot express.
ORACLE_SQL = None

NEAR = jaccard_join.Similarity(n=5, percent=80)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones among them, does not predict as toxic."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by five-word n-grams at 0.8 the document of the smallest id; rows without id stay."""
    return jaccard_join.keep_first(docs, NEAR)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that align with no test item."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked; n_chars follows where a text has changed. Columns may have any names."""
    (before,) = fresh_names(docs, "before")
    masked = secret_scan.redact(docs.withColumn(before, F.col("text")))
    changed = ~F.col("text").eqNullSafe(F.col(before))
    n_chars = F.when(changed, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return masked.withColumn("n_chars", n_chars).select(*docs.columns)


def choose_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the mix, with domain, n_tokens and epochs."""
    return mixing.mix(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("secret scans", mask_secrets),
    ("mixing sources to target weights", choose_mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each stage's result is written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
