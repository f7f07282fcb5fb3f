"""The folder that driver and executors share, and tables that are made once in it."""

from __future__ import annotations

import hashlib
import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where that is unset and the master is local, a local folder of the application."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return "file://" + os.path.join(tempfile.gettempdir(), "ledgerloom", spark.sparkContext.applicationId)


def hadoop_path(spark: SparkSession, uri: str):
    """A Hadoop path and its file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def stamp(spark: SparkSession, uri: str) -> str:
    """Length and time of the last change of a file or of the files right in a folder: another stamp is another table."""
    path, fs = hadoop_path(spark, uri)
    return ",".join(sorted(f"{s.getPath().getName()}:{s.getLen()}:{s.getModificationTime()}" for s in fs.listStatus(path)))


def materialized(spark: SparkSession, name: str, inputs: list[str], build: Callable[[], DataFrame], partition_by: tuple[str, ...] = ()) -> DataFrame:
    """What ``build`` gives, written once for the application and the state of its inputs, and read back, so that filters reach files."""
    key = hashlib.sha256("|".join([name, *(f"{i}={stamp(spark, i)}" for i in inputs)]).encode()).hexdigest()[:24]
    uri = f"{shared_folder(spark)}/{name}-{spark.sparkContext.applicationId}-{key}"
    path, fs = hadoop_path(spark, f"{uri}/_SUCCESS")
    if not fs.exists(path):
        writer = build().write.mode("overwrite")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(uri)
    return spark.read.parquet(uri)


def materialized_rows(rows: DataFrame, label: str) -> DataFrame:
    """The same rows, written once to the shared folder and read back: what follows reads them more than once, and lost executors never
    replay what came before."""
    spark = rows.sparkSession
    uri = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    rows.write.parquet(uri)
    return spark.read.schema(rows.schema).parquet(uri)
