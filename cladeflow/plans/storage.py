"""Cutting the lineage of iterative plans, and files of intermediate results, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import os
import uuid
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession

#: Spark then deletes the shuffle files of a query as soon as it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_written: list[str] = []
_folders: dict[int, tuple[DataFrame, str]] = {}


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where that is unset, a folder below the warehouse, but on one machine only."""
    held = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if held:
        return held
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return os.path.join(spark.conf.get("spark.sql.warehouse.dir"), "_checkpoints")


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder for files that a lazy result still reads; they are deleted when the driver ends."""
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    _written.append(path)
    return path


@atexit.register
def _clear() -> None:
    for path in _written:
        _delete(path)


def _delete(path: str) -> None:
    """Files that this driver cannot reach by their address stay, for the folder's owner to clear."""
    from pyarrow import ArrowException, fs

    try:
        files, place = fs.FileSystem.from_uri(path if urlsplit(path).scheme else os.path.abspath(path))
        files.delete_dir(place)
    except (OSError, ArrowException):
        pass


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` as Parquet in the shared folder. The plan that follows begins with these files and their size; Spark's own checkpoints keep
    the estimate of the plan before them, and where rounds join what they stored, the product of such estimates gets twice as many
    digits with every join, until the driver is out of memory."""
    spark, path = df.sparkSession, scratch(df.sparkSession)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    _folders[id(out)] = out, path
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes the files of ``checkpointed`` tables that no later step reads."""
    for df in tables:
        _, path = _folders.pop(id(df))
        _written.remove(path)
        _delete(path)
