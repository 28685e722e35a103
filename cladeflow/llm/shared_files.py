"""Intermediate tables in the folder that driver and executors share, and their removal; columns by name."""

from __future__ import annotations

import os
import uuid
from urllib.parse import urlsplit

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spark then deletes the shuffle files of a query as soon as it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where that is unset, a folder below the warehouse, but on one machine only."""
    held = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if held:
        return held
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return os.path.join(spark.conf.get("spark.sql.warehouse.dir"), "_checkpoints")


class Tables:
    """Intermediate tables of one operator, as Parquet: they outlive lost executors and the lineage before them.

    ``drop`` deletes what no later step reads; what the operator's lazy result still reads stays in the shared
    folder, as checkpoints do.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folders: dict[int, tuple[DataFrame, str]] = {}

    def store(self, df: DataFrame) -> DataFrame:
        folder = f"{shared_folder(self.spark)}/{uuid.uuid4().hex}.parquet"
        before = self.spark.conf.get(CLEANUP, None)
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.parquet(folder)
        finally:
            self.spark.conf.unset(CLEANUP) if before is None else self.spark.conf.set(CLEANUP, before)
        out = self.spark.read.schema(df.schema).parquet(folder)
        self.folders[id(out)] = out, folder
        return out

    def drop(self, *tables: DataFrame) -> None:
        for df in tables:
            _, folder = self.folders.pop(id(df))
            _delete(folder)

    def drop_all(self, keep: tuple[DataFrame, ...] = ()) -> None:
        kept = {id(df) for df in keep}
        self.drop(*[df for key, (df, _) in self.folders.items() if key not in kept])


def _delete(folder: str) -> None:
    """Files that this driver cannot reach by their address stay, for the folder's owner to clear."""
    from pyarrow import ArrowException, fs

    try:
        files, path = fs.FileSystem.from_uri(folder if urlsplit(folder).scheme else os.path.abspath(folder))
        files.delete_dir(path)
    except (OSError, ArrowException):
        pass


def columns(names: list[str]) -> list[Column]:
    """Columns by their whole names, which may hold dots."""
    return [F.col("`" + n.replace("`", "``") + "`") for n in names]
