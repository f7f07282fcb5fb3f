"""Shared folder, written intermediate tables, byte access and connected components."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or a local one where that is unset and the master is local (tests)."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "checkpoints", spark.sparkContext.applicationId)
    return base.rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """The same rows, written once to the shared folder and read back, so that lost executors never replay what came before."""
    spark, path = df.sparkSession, new_folder(df.sparkSession, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def release(spark: SparkSession, *done: DataFrame) -> None:
    """Deletes tables of ``written`` that nothing will read again, and lets Spark drop the shuffles of finished queries, which it does when
    the driver's garbage is collected."""
    for df in done:
        path = spark._jvm.org.apache.hadoop.fs.Path(df.written_to)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    gc.collect()
    spark._jvm.System.gc()


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """A file system and the path in it, for file://, hdfs://, s3:// and other URIs, and for plain local paths."""
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def byte_values(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column, null as empty."""
    return [b or b"" for b in column.cast(pa.large_binary()).to_pylist()]


def signed(hash64: int) -> int:
    return hash64 - (1 << 64) if hash64 >= 1 << 63 else hash64


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Columns node, component (the smallest node reachable) for every node of ``edges`` (columns a, b, both long).

    Alternates the large-star and small-star steps of Kiveris et al. (2014). Each step is an aggregation with a map-side part
    and an equi-join that skew handling can split; every round is written to the shared folder. Self loops are allowed.
    """
    spark = edges.sparkSession
    proper = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    current = written(proper.distinct(), "cc")
    before = None
    for _ in range(rounds):
        last = current
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large, "cc")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        current = written(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "cc")
        release(spark, last, large)
        state = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    roots = current.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    return roots.unionByName(current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
