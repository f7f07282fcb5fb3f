"""Capture checkpoints: keyed rows of which the latest version counts."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

KEY = ("extractor", "resource", "partition")
SCHEMA = "extractor string, resource string, partition string, position long, cursor string, ordinal long, mtime_ms double, state string, updated_at string"


def upsert(rows: DataFrame, path: str) -> None:
    """Adds versions of checkpoints. A row needs its key, and a position or ordinal that is not negative; else the write fails."""
    bad = F.lit(False)
    for k in KEY[:2]:
        bad = bad | F.col(k).isNull() | (F.col(k) == "")
    bad = bad | F.coalesce(F.col("position") < 0, F.lit(False)) | F.coalesce(F.col("ordinal") < 0, F.lit(False)) | (F.col("state").isNotNull() & F.try_parse_json("state").isNull())
    told = F.raise_error(F.concat(F.lit("invalid checkpoint: "), F.to_json(F.struct(*KEY)))).cast("string")
    checked = rows.withColumn("extractor", F.when(bad, told).otherwise(F.col("extractor")))
    checked.withColumn("version", F.lit(time.time_ns())).write.mode("append").parquet(path)


def current(spark: SparkSession, path: str) -> DataFrame:
    """The latest version of each checkpoint."""
    rows = spark.read.parquet(path)
    names = [c for c in rows.columns if c not in (*KEY, "version")]
    return rows.groupBy(*KEY).agg(F.max_by(F.struct(*names), "version").alias("r")).select(*KEY, "r.*")


def get(spark: SparkSession, path: str, extractor: str, resource: str, partition: str = "") -> dict | None:
    row = current(spark, path).where((F.col("extractor") == extractor) & (F.col("resource") == resource) & (F.col("partition") == partition)).first()
    return row.asDict() if row else None


def page(checkpoints: DataFrame, extractor: str, after: tuple[str, str] | None = None, limit: int = 100) -> tuple[list, tuple[str, str] | None]:
    """Checkpoints of an extractor by (resource, partition) after a key, and the key to go on from, if there are more: one row over the
    limit is read to know."""
    rows = checkpoints.where(F.col("extractor") == extractor)
    if after is not None:
        rows = rows.where((F.col("resource") >= after[0]) & ((F.col("resource") > after[0]) | (F.col("partition") > after[1])))
    found = rows.orderBy("resource", "partition").limit(limit + 1).collect()
    return found[:limit], (found[limit - 1].resource, found[limit - 1].partition) if len(found) > limit else None


def of_legacy_rows(rows: DataFrame) -> DataFrame:
    """The checkpoint that each (extractor, resource, partition) of rows without checkpoints would have: its furthest position, then ordinal, then
    place in the ledger. Rows without a position come last."""
    order = Window.partitionBy(*KEY).orderBy(F.col("position").isNotNull().desc(), F.desc_nulls_last("position"), F.desc_nulls_last("ordinal"), F.desc("seq"))
    return rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
