"""Discovery groups: identity, routes, counts, representatives, order of members and digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .topology import STRETCH_US, in_text_order, micros

NUL = "\0"


def json_text(value: Column) -> Column:
    """A string as JSON writes it: quotes, backslashes and control characters escaped, all else as it is."""
    whole = F.to_json(F.struct(value.alias("v")))
    quoted = F.substring(whole, 6, F.length(whole) - 6)
    return F.when(value.isNull(), "null").otherwise(quoted)


def group_id(kind: str, key: Column) -> Column:
    """Stable id of a group: a hash of its key as a JSON string."""
    return F.concat(F.lit(f"grp_{kind}_"), F.substring(F.sha2(json_text(key), 256), 1, 16))


def identities(atoms: DataFrame, cluster: str = "cluster") -> DataFrame:
    """Adds project_group, project_quality, thread_group, thread_quality, and provider and root_thread of the thread that was taken.

    ``atoms``: cluster, project_key, provider, session_id, root_thread_id. An atom without a project is grouped by its cluster alone. Its
    thread is told by the root thread, else by the session (a fallback); an atom that tells none takes the only thread that the others of
    its cluster tell, else the cluster stands for it.
    """
    some = lambda c: F.when(F.length(c) > 0, F.col(c))
    project, provider, root, session = some("project_key"), some("provider"), some("root_thread_id"), some("session_id")
    part = F.coalesce(project, F.concat(F.lit("fallback-project:"), F.col(cluster)))
    told = F.when(root.isNotNull(), F.concat_ws(NUL, F.lit("thread"), part, provider, F.lit("root"), root)).when(session.isNotNull(), F.concat_ws(NUL, F.lit("thread"), part, provider, F.lit("session"), session))
    explicit = F.when(
        provider.isNotNull() & told.isNotNull(),
        F.struct(told.alias("key"), F.when(root.isNotNull() & project.isNotNull(), "canonical").otherwise("fallback").alias("quality"), provider.alias("provider"), root.alias("root"), project.alias("project")),
    )
    rows = atoms.withColumn("_told", explicit)
    sole = rows.where("_told is not null").groupBy(cluster).agg(F.min("_told").alias("_one"), F.min("_told.key").alias("_lo"), F.max("_told.key").alias("_hi"))
    rows = rows.join(sole.where("_lo = _hi").select(cluster, "_one"), cluster, "left")
    alone = F.struct(
        F.concat_ws(NUL, F.lit("thread-fallback"), part, F.col(cluster)).alias("key"), F.lit("fallback").alias("quality"), F.lit(None).cast("string").alias("provider"),
        F.lit(None).cast("string").alias("root"), project.alias("project"),
    )
    rows = rows.withColumn("_thread", F.coalesce("_told", "_one", alone))
    return rows.withColumns({
        "project_group": F.when(project.isNotNull(), F.concat(F.lit("project" + NUL), project)).otherwise(F.concat(F.lit("project-fallback" + NUL), F.col(cluster))),
        "project_quality": F.when(project.isNotNull(), "canonical").otherwise("fallback"),
        "thread_group": F.col("_thread.key"), "thread_quality": F.col("_thread.quality"), "thread_provider": F.col("_thread.provider"), "root_thread": F.col("_thread.root"),
        "thread_project": F.col("_thread.project"),
    }).drop("_told", "_one", "_thread")


def routes(atoms: DataFrame, key: str = "group_key") -> DataFrame:
    """group, canonical_root: the one absolute root that all atoms of the group which tell a root agree on, if it is also that of every
    atom's project; else null."""
    root = F.when(F.length("canonical_root") > 0, F.col("canonical_root"))
    plain = F.when(root == "/", root).otherwise(F.rtrim(root, F.lit("/")))
    agreed = (F.countDistinct("_root") == 1) & F.bool_and(F.coalesce(F.col("_root").startswith("/"), F.lit(True)))
    return (
        atoms.withColumn("_root", plain).groupBy(key)
        .agg(F.when(agreed, F.min("_root")).alias("r"), F.min("project_key").alias("lo"), F.max("project_key").alias("hi"), F.bool_and(F.col("project_key").isNotNull()).alias("all"))
        .select(key, F.when(F.col("all") & (F.col("lo") == F.col("hi")) & (F.col("lo") == F.concat(F.lit("local:workspace:"), "r")), F.col("r")).alias("canonical_root"))
    )


def discovery_groups(atoms: DataFrame, key: str = "group_key") -> DataFrame:
    """Turns, raw observations, collapsed ones, threads, turns by app and time range of each group."""
    apps = atoms.groupBy(key, "app").agg(F.count("*").alias("n")).groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("app", "n")))).alias("by_app"))
    counts = atoms.groupBy(key).agg(
        F.count("*").alias("turns"), F.sum("raw").alias("raw_observations"), (F.sum("raw") - F.count("*")).alias("collapsed"),
        F.countDistinct("thread").alias("threads"), F.min("ts").alias("ts_from"), F.max("ts").alias("ts_to"),
    )
    return counts.join(apps, key)


def representatives(atoms: DataFrame, limit: int = 3, key: str = "group_key") -> DataFrame:
    """group, id, place: the newest atom of each app, newest first, then the newest overall, up to ``limit``.

    Both choices are the first rows of a window, of which each task passes on ``limit`` a group at most.
    """
    newest = [F.desc("ts"), in_text_order(F.col("id"))]
    rows = atoms.select(key, "id", "ts", "app")
    lead = rows.withColumn("n", F.row_number().over(Window.partitionBy(key, "app").orderBy(*newest))).where("n = 1").drop("n")
    lead = lead.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy(*newest))).where(F.col("n") <= limit)
    first = rows.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy(*newest))).where(F.col("n") <= limit)
    both = lead.select(key, "id", "ts", F.lit(0).alias("kind")).unionByName(first.select(key, "id", "ts", F.lit(1).alias("kind")))
    both = both.groupBy(key, "id").agg(F.min("kind").alias("kind"), F.max("ts").alias("ts"))
    return both.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy("kind", *newest))).where(F.col("place") <= limit).select(key, "id", "place")


def member_order(atoms: DataFrame, limit: int = 3, key: str = "group_key") -> DataFrame:
    """``atoms`` with ``place`` (representatives first, the rest newest first) and ``representative``.

    The rest of a group is counted by days first, so that only atoms of one day are sorted together.
    """
    chosen = representatives(atoms, limit, key).select(key, "id", F.col("place").alias("_pick"))
    rows = atoms.join(chosen, [key, "id"], "left").withColumns({"representative": F.col("_pick").isNotNull(), "_day": F.floor(micros(F.col("ts")) / F.lit(STRETCH_US)).cast("long")})
    days = rows.groupBy(key, "_day").agg(F.sum(F.col("_pick").isNull().cast("int")).alias("_c"), F.count("_pick").alias("_p"))
    whole = Window.partitionBy(key)
    newer = whole.orderBy(F.desc("_day")).rowsBetween(Window.unboundedPreceding, -1)
    days = days.withColumn("_start", F.coalesce(F.sum("_c").over(newer), F.lit(0)) + F.sum("_p").over(whole)).drop("_c", "_p")
    line = Window.partitionBy(key, "_day", "representative").orderBy(F.desc("ts"), in_text_order(F.col("id")))
    rows = rows.withColumn("_n", F.row_number().over(line)).join(days, [key, "_day"])
    return rows.withColumn("place", F.coalesce("_pick", F.col("_n") + F.col("_start")).cast("int")).drop("_pick", "_day", "_n", "_start")
