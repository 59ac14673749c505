"""Intermediates: frames written to the folder that all executors share, and deleted when nothing reads them."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder only where it is unset and all runs in one process."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if shared:
        return shared
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError(f"set spark.checkpoint.dir to a folder that all executors of {master} share: intermediates are written there")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="newsquery-core-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return f"file://{_own[0]}"


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, paths: list[str]) -> DataFrame:
    """``df`` written and read back, which cuts its lineage; the path joins ``paths``."""
    paths.append(new_folder(df.sparkSession, name))
    df.write.parquet(paths[-1])
    return df.sparkSession.read.schema(df.schema).parquet(paths[-1])


def delete(spark: SparkSession, paths: list[str]) -> None:
    """Deletes the files of ``paths`` and empties it."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    paths.clear()
