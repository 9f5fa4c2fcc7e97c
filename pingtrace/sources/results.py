"""Writing result tables to, and reading them from, any file system Spark knows."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from pingtrace.sources.staging import delete_folder, folder_exists, rename_folder

DAILY_SCHEMA = T.StructType(
    [T.StructField("day", T.IntegerType()), T.StructField("total_infected", T.LongType())]
)
GEO_SCHEMA = T.StructType(
    [
        T.StructField("latitude", T.DoubleType()),
        T.StructField("longitude", T.DoubleType()),
        T.StructField("tot_evts", T.LongType()),
    ]
)


@contextmanager
def all_or_nothing(spark: SparkSession, path: str, mode: str = "error") -> Iterator[str]:
    """Write several tables, of which either all or none are to stand under `path`.

    Gives a folder beside `path` to write to. At the end of the block it takes the
    place of `path` in one rename; after a failure it is deleted and `path` is as it was.
    `mode` is `error` (there must be nothing under `path`) or `overwrite`. On stores without a
    rename in one step, readers should wait for the end of the block.
    """
    if mode not in ("error", "overwrite"):
        raise ValueError(f"mode is error or overwrite, not {mode}")
    place = path.rstrip("/")
    if mode == "error" and folder_exists(spark, place):
        raise FileExistsError(place)
    mark = uuid.uuid4().hex
    beside, before = f"{place}.writing-{mark}", f"{place}.before-{mark}"
    try:
        yield beside
        replaced = folder_exists(spark, place)
        if replaced:
            if mode == "error":
                raise FileExistsError(place)
            rename_folder(spark, place, before)
        try:
            rename_folder(spark, beside, place)
        except BaseException:
            if replaced:
                rename_folder(spark, before, place)
            raise
    except BaseException:
        delete_folder(spark, beside)
        raise
    if replaced:
        delete_folder(spark, before)


def write_daily_counts(daily: DataFrame, path: str, mode: str = "error") -> None:
    """Write (day, total_infected) as one CSV file: it has one row per day."""
    daily.select("day", "total_infected").orderBy("day").coalesce(1).write.mode(mode).csv(path, header=True)


def write_geo_totals(totals: DataFrame, path: str, mode: str = "error") -> None:
    """Write coordinate totals as CSV parts, in coordinate order over all parts."""
    columns = [f.name for f in GEO_SCHEMA]
    totals.select(*columns).orderBy("latitude", "longitude").write.mode(mode).csv(path, header=True)


def write_geo_totals_by_day(totals: DataFrame, path: str, mode: str = "error") -> None:
    """Write (day, latitude, longitude, tot_evts) as Parquet, one folder per day."""
    totals.hint("rebalance", "day").write.mode(mode).partitionBy("day").parquet(path)


def write_lines(lines: DataFrame, path: str, mode: str = "error") -> None:
    """Write a single text column as text files."""
    lines.write.mode(mode).text(path)


def read_daily_counts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(DAILY_SCHEMA).csv(path, header=True)


def read_geo_totals(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(GEO_SCHEMA).csv(path, header=True)
