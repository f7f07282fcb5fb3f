"""From a ledger to ranked clusters of logical turns: the stages of a context query, each one DataFrame to the next."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import membership_of, role_of, type_of_key
from ..sources.workspace import materialized_rows
from . import clusters, normalize, topology, turns

UNSCOPED = "unscoped"


def observations(rows: DataFrame, since: Column, until: Column, project_key: str | None = None) -> DataFrame:
    """Atoms (error null) that occurred in [since, until), and errors of rows of that time.

    What counts is when a turn occurred: rows that were captured later are taken in, whatever their own time; rows from before ``since`` are
    not looked at.
    """
    rows = normalize.rebased(rows, project_key) if project_key else rows
    atoms = normalize.normalized(rows.where(F.col("ts") >= since))
    at = F.try_to_timestamp(F.col("occurred_at"))
    out = atoms.withColumns({"ts": at, "observed_ts": F.try_to_timestamp(F.coalesce("observed_at", "occurred_at"))})
    return out.where((F.col("ts") >= since) & (F.col("ts") < until))


def logical(atoms: DataFrame) -> DataFrame:
    """One row for each logical turn, with what the later stages read of its conversation and project."""
    c = F.col("conversation")
    flat = atoms.where("error is null").select(
        "*", F.col("ts").alias("occurred_ts"), *[c[k].alias(k) for k in ("provider", "logical_turn_id", "observation_kind", "root_thread_id", "thread_id", "initiator")],
        F.col("project.key").alias("project_key"), F.col("project.canonical_root").alias("canonical_root"),
    )
    out = turns.logical_turns(flat)
    told = lambda k: F.when(F.length(k) > 0, F.col(k))
    owner = F.coalesce(told("root_thread_id"), told("thread_id"), F.when(F.length(c["session_id"]) > 0, c["session_id"]))
    return out.withColumns({"owner": F.when(owner.isNotNull(), F.concat_ws("\0", "provider", owner)), "scope": F.coalesce("project_key", F.lit(UNSCOPED)), "raw": F.col("raw_observation_count")})


def artifact_key(a: Column) -> Column:
    return F.concat_ws(":", a["provider"], a["type"], a["id"])


def bridge(rows: DataFrame, *more: str) -> DataFrame:
    """One row for each artifact of an atom: id, ts, project, key, type, membership, ref (and further columns)."""
    out = rows.select("id", "ts", F.col("scope").alias("project"), *more, F.explode("artifacts").alias("ref")).withColumn("key", artifact_key(F.col("ref")))
    out = out.dropDuplicates(["id", "key", *more]) if more else out.dropDuplicates(["id", "key"])
    return out.withColumns({"type": F.col("ref.type"), "artifact": F.col("key"), "membership": membership_of(F.col("ref.type"))})


def joined(rows: DataFrame, window_hours: float) -> tuple[DataFrame, DataFrame]:
    """``rows`` with ``cluster`` (the least id of it), and the links of each cluster. Both read one forest, written once."""
    forest = topology.constrained_forest(rows.select("id", "ts", F.col("scope").alias("project"), "owner"), bridge(rows), window_hours)
    forest = materialized_rows(forest, "forest")
    members = rows.join(forest.select("id", F.col("component").alias("cluster")), "id")
    return members, forest.where(F.size("links") > 0).select(F.col("component").alias("cluster"), "links")


def loop_rows(members: DataFrame) -> DataFrame:
    """What open loops are told by."""
    talk = F.filter("artifacts", lambda a: a["type"] == "conversation")
    return members.select(
        "cluster", "id", "ts", "occurred_at", "initiator", F.when(F.size(talk) > 0, artifact_key(talk[0])).alias("conversation"),
        F.exists("actors", lambda a: a["role"] == "user").alias("is_user"), "input", "output", F.col("delta.artifact_id").alias("delta_of"),
        F.array_distinct(F.transform(F.filter("artifacts", lambda a: a["type"] == "file"), lambda a: a["id"])).alias("files"),
        F.coalesce("hints", F.array().cast("array<string>")).alias("hints"),
    )


@dataclass
class Derived:
    """What is told of clusters: signals (one row each), loops, anchors, labels."""

    signals: DataFrame
    loops: DataFrame
    anchors: DataFrame
    labels: DataFrame


def derived(members: DataFrame, until: Column, hint_key: str | None = None, now: Column | None = None) -> Derived:
    arts = bridge(members, "cluster")
    anchors = clusters.top_anchors(arts).withColumn("type", type_of_key(F.col("artifact")))
    loops = clusters.open_loops(loop_rows(members))
    verbs = members.select("cluster", "id", "ts", F.coalesce("verb", "kind").alias("verb"))
    hinted = arts.where(F.col("key") == hint_key) if hint_key else arts.where(F.lit(False))
    signals = clusters.with_context_signals(clusters.rank_signals(members, until, now=now), loops, anchors, hinted)
    ids = members.groupBy("cluster").agg(clusters.cluster_id(F.collect_list("id")).alias("cluster_id"))
    return Derived(signals.join(ids, "cluster"), loops, anchors, clusters.labels(anchors, verbs))


def kept_links(links: DataFrame, members: DataFrame) -> DataFrame:
    """cluster, from, to, keys of links between members, without those that scopes and sessions alone make."""
    rows = links.select("cluster", F.explode(topology.without_redundant(F.col("links"), lambda k: role_of(type_of_key(k)))).alias("l")).select("cluster", "l.*")
    ids = members.select("id")
    return rows.join(ids.withColumnRenamed("id", "from"), "from", "left_semi").join(ids.withColumnRenamed("id", "to"), "to", "left_semi").select("cluster", "from", "to", "keys")


