"""Logical turns: one row for the physical observations of a turn."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .normalize import LOGICAL_ID
from .topology import in_text_order


def logical_turns(observations: DataFrame) -> DataFrame:
    """Rows (provider, logical_turn_id, observation_kind, id, occurred_ts, observed_ts, ...) collapsed by (provider, logical_turn_id).

    Only valid ids of original or inherited rows collapse; the others stay as they are. The row that stands for a turn is the first by
    kind (original, unknown, inherited), observed time and id; observed_ts becomes the latest, raw_observation_count their number.
    """
    valid = F.col("logical_turn_id").rlike(LOGICAL_ID) & F.col("observation_kind").isin("original", "inherited")
    rows = observations.withColumns({"observed_ts": F.coalesce("observed_ts", "occurred_ts"), "_keyed": F.coalesce(valid, F.lit(False))})
    names = [c for c in rows.columns if c != "_keyed"]
    rank = F.when(F.col("observation_kind") == "original", 0).when(F.col("observation_kind") == "inherited", 2).otherwise(1)
    keyed = rows.where("_keyed").groupBy("provider", "logical_turn_id").agg(
        F.min_by(F.struct(*names), F.struct(rank, F.col("observed_ts"), in_text_order(F.col("id")))).alias("r"),
        F.max("observed_ts").alias("latest"),
        F.count("*").alias("raw_observation_count"),
        F.bool_and(F.col("observation_kind") == "inherited").alias("inherited_only"),
    )
    keyed = keyed.select(*[F.col("latest" if c == "observed_ts" else f"r.{c}").alias(c) for c in names], "raw_observation_count", "inherited_only")
    alone = rows.where("not _keyed").select(*names, F.lit(1).cast("long").alias("raw_observation_count"), F.lit(False).alias("inherited_only"))
    return keyed.unionByName(alone)


def turn_counters(turns: DataFrame) -> DataFrame:
    """raw, logical, collapsed and inherited-only counts of ``logical_turns``."""
    raw = F.coalesce(F.sum("raw_observation_count"), F.lit(0))
    return turns.agg(raw.alias("raw"), F.count("*").alias("logical"), (raw - F.count("*")).alias("collapsed"), F.coalesce(F.sum(F.when(F.col("inherited_only"), F.col("raw_observation_count"))), F.lit(0)).alias("inherited_only"))


def first_with_ties(rows: DataFrame, n: int, ts: str = "ts") -> DataFrame:
    """The ``n`` earliest rows and all others of the last one's time: a group of equal times is never split."""
    last = rows.select(ts).orderBy(ts).limit(n).agg(F.max(ts).alias("_last"))
    return rows.join(F.broadcast(last), rows[ts] <= F.col("_last")).drop("_last")
