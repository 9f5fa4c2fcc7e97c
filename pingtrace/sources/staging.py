"""Tables written between the steps of a pipeline, who owns them, and size-checked broadcasts."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from contextvars import ContextVar, Token

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROWS = 200_000

_local_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder named by `spark.checkpoint.dir`.

    Only a local session may go without one: it then gets a temporary folder,
    since its driver and executors share a machine.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not re.match(r"local($|\[)", context.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _local_folders:
        _local_folders[context.applicationId] = tempfile.mkdtemp(prefix="pingtrace-")
    return _local_folders[context.applicationId]


class StageScope:
    """Owns every table staged within it, and deletes them at its end.

    Used as a context manager. Whatever is computed from tables staged within must be
    written or collected before the end. Scopes nest; the innermost owns. One scope may be
    entered again while it is open.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folder = f"{shared_folder(spark)}/pingtrace/scope-{uuid.uuid4().hex}"
        self._tokens: list[Token] = []

    @property
    def is_open(self) -> bool:
        return bool(self._tokens)

    def __enter__(self):
        self._tokens.append(_scope.set(self))
        return self

    def __exit__(self, *failure) -> None:
        _scope.reset(self._tokens.pop())
        if not self._tokens:
            delete_folder(self.spark, self.folder)


_scope: ContextVar[StageScope | None] = ContextVar("scope", default=None)


def _hadoop_path(spark: SparkSession, path: str):
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()), found


def folder_exists(spark: SparkSession, path: str) -> bool:
    files, found = _hadoop_path(spark, path)
    return files.exists(found)


def delete_folder(spark: SparkSession, path: str) -> None:
    files, found = _hadoop_path(spark, path)
    files.delete(found, True)


def rename_folder(spark: SparkSession, path: str, to: str) -> None:
    files, found = _hadoop_path(spark, path)
    if not files.rename(found, _hadoop_path(spark, to)[1]):
        raise OSError(f"could not rename {path} to {to}")


def new_folder(spark: SparkSession, label: str) -> str:
    """A folder for one staged table: in the current scope, or else left to the cluster's clean-up."""
    scope = _scope.get()
    owner = scope.folder if scope is not None else f"{shared_folder(spark)}/pingtrace"
    return f"{owner}/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write `df` as Parquet to the shared folder and read it back.

    The result no longer depends on the work before it, survives lost
    executors, prunes columns and partitions, and has a size Spark knows
    when it chooses join strategies.
    """
    path = new_folder(df.sparkSession, label)
    if partition_by:
        df.hint("rebalance", *partition_by).write.partitionBy(*partition_by).parquet(path)
    else:
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files of finished steps whose results are staged.

    Spark deletes them once the driver's garbage is collected, which on a small heap may be
    long after; a job of many steps would keep the files of all of them on the executors' disks.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Ask for a broadcast of `df` after counting that it has at most `max_rows` rows.

    A larger frame is returned without the request, so Spark shuffles it (and
    splits skewed partitions of the other side).
    """
    if df.count() <= max_rows:
        return F.broadcast(df)
    return df
