"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; where it is unset (tests, local runs) a folder of our own.

    Only a local-mode session gets a folder made for it: on a cluster a machine-local
    folder would be invisible to the other executors, so there an unset folder is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if spark.sparkContext.master.partition("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = os.path.join(tempfile.gettempdir(), "checkpoints", f"taleweave-{spark.sparkContext.applicationId}")
    return f"file://{folder}"


_made: list[str] = []


def new_folder(spark: SparkSession, name: str) -> str:
    _made.append(f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}")
    return _made[-1]


def clear(spark: SparkSession) -> int:
    """Deletes the folders that this session made so far; call it when their results are written."""
    n = 0
    while _made:
        path = spark._jvm.org.apache.hadoop.fs.Path(_made.pop())
        n += bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))
    return n


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read again.

    Cuts the lineage, lets several consumers share one computation, survives lost
    executors, and gives the optimizer the table's true size when it decides on a broadcast.
    """
    spark = df.sparkSession
    folder = new_folder(spark, name)
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)
