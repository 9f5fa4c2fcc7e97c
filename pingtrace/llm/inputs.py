"""The documents as the operators take them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: str, modulus: int):
    """Remainder of the CRC-32 of the id as text."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(modulus))


def fresh_names(docs: DataFrame, *labels: str) -> list[str]:
    """A name for each label that no column of `docs` has."""
    taken = {c.lower() for c in docs.columns}
    names = []
    for label in labels:
        name = f"_own_{label}"
        while name in taken:
            name += "_"
        taken.add(name)
        names.append(name)
    return names
