"""Aggregates of clusters: ids, breakdowns, anchors, labels, open loops, rank, truncation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..functions.paths import id_tail, role_of
from .topology import in_text_order, micros

RECENT_HOURS = 1
#: What the verbs of actions are called in labels, how sure each kind of open loop is, types that mark work on code, and
#: the age up to which the work of a single source counts as the caller's own.
VERBS = {"message": "discussion about", "commit": "work on", "edit": "edits to", "edits": "edits to", "apply_patch": "edits to", "read": "reading", "write": "edits to", "search": "search in", "run": "commands in", "open": "open"}
CONFIDENCE = {"ends_with_question": "high", "unresolved_assistant_q": "medium", "contains_todo": "high", "explicit_followup": "medium"}
CODE_TYPES = ("repo", "file", "commit")
OWN_WORK_US = 300_000_000
#: The keys of the order of clusters, best first: the last is the id.
ORDER = ("own_recent", "hint", "recent", "open_loop", "size", "median_age")


def cluster_id(ids: Column) -> Column:
    return F.concat(F.lit("ctx_"), F.substring(F.sha2(F.concat(F.lit("1"), F.array_join(F.array_sort(ids), ",")), 256), 1, 8))


def source_breakdown(atoms: DataFrame, key: str = "cluster") -> DataFrame:
    """cluster, breakdown: map of apps to atoms."""
    counts = atoms.groupBy(key, "app").agg(F.count("*").alias("n"))
    return counts.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("app", "n")))).alias("breakdown"))


def top_anchors(bridge: DataFrame, key: str = "cluster", n: int = 3) -> DataFrame:
    """The artifacts in most atoms of each cluster, without those of scope and session; ties by key. A column ``ref`` gives each the first
    of its values (by ts and id) that is there."""
    first = [F.min_by("ref", F.struct("ts", "id")).alias("ref")] if "ref" in bridge.columns else []
    counts = bridge.where(~role_of(F.col("type")).isin("scope", "session")).groupBy(key, "artifact").agg(F.countDistinct("id").alias("atoms"), *first)
    w = Window.partitionBy(key).orderBy(F.desc("atoms"), "artifact")
    return counts.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def labels(anchors: DataFrame, verbs: DataFrame, key: str = "cluster") -> DataFrame:
    """cluster, label: the verb of most atoms (first seen of equals) and the name of the top artifact, if two atoms have it."""
    top = verbs.where(F.length("verb") > 0).groupBy(key, "verb").agg(F.count("*").alias("n"), F.min(F.struct("ts", "id")).alias("first"))
    top = top.groupBy(key).agg(F.min_by("verb", F.struct(-F.col("n"), F.col("first"))).alias("verb"))
    words = F.coalesce(F.create_map(*[F.lit(x) for kv in VERBS.items() for x in kv])[F.lower("verb")], F.lit("work on"))
    own = F.col("ref.label") if "ref" in anchors.columns else F.lit(None).cast("string")
    tail = id_tail(F.col("ref.id") if "ref" in anchors.columns else F.col("artifact"))
    name = F.when(F.length(own) > 0, own).otherwise(F.when(tail != "", tail))
    named = anchors.where("place = 1 and atoms >= 2").withColumn("name", name).where("name is not null")
    return named.join(top, key, "left").select(key, F.concat_ws(" ", words, "name").alias("label"))


def open_loops(members: DataFrame, key: str = "cluster", question: str = "?") -> DataFrame:
    """cluster, id, kind, text, confidence, resolved_by: the open loops of each cluster, and the first later atom of it that closes each.

    ``members``: cluster, id, ts, occurred_at, initiator, conversation (key, or null), is_user, input, output, delta_of (artifact id), files
    (artifact ids), hints. A question of the user is closed by its own answer, or by a later atom of the conversation that ends with no
    question; one of the assistant by a later user's atom of it that says something; a mark to do by a later change of one of the files.
    Promises stay open. Atoms of agents and systems open none.
    """
    blank = lambda c: text.trimmed(F.coalesce(F.col(c), F.lit(""))) == ""
    ends = lambda c: F.endswith(text.trimmed(F.coalesce(F.col(c), F.lit(""))), F.lit(question))
    order = ["ts", in_text_order(F.col("occurred_at")), in_text_order(F.col("id"))]
    rows = members.withColumns({"_settles": ~(ends("input") | ends("output")), "_says": F.col("is_user") & ~(blank("input") & blank("output")), "_answered": ~blank("output")})
    later = Window.partitionBy(key, "conversation").orderBy(*order).rowsBetween(1, Window.unboundedFollowing)
    first = lambda cond: F.when(F.col("conversation").isNotNull(), F.first(F.when(cond, F.col("id")), ignorenulls=True).over(later))
    rows = rows.withColumns({"_q": F.when(F.col("_answered"), F.col("id")).otherwise(first(F.col("_settles"))), "_aq": first(F.col("_says"))})
    own = ~F.coalesce(F.col("initiator").isin("agent", "system"), F.lit(False))
    found = rows.where(own & (F.size("hints") > 0)).select(key, "id", "ts", "occurred_at", "files", "_q", "_aq", "input", "output", F.explode("hints").alias("kind"))
    found = found.where(F.col("kind").isin(*CONFIDENCE)).withColumn("text", text.hint_text(F.col("kind"), F.col("input"), F.col("output"), question)).where("text is not null")
    # A mark to do meets the changes of its files in one time line a file; the change that comes with the mark is before it.
    marks = found.where("kind = 'contains_todo'").select(key, "id", "ts", "occurred_at", F.explode("files").alias("artifact"), F.lit(1).alias("mark"))
    changes = members.where("delta_of is not null").select(key, "id", "ts", "occurred_at", F.col("delta_of").alias("artifact"), F.lit(0).alias("mark"))
    line = Window.partitionBy(key, "artifact").orderBy(*order, "mark").rowsBetween(1, Window.unboundedFollowing)
    change = F.struct("ts", "occurred_at", F.col("id").alias("by"))
    closed = marks.unionByName(changes).withColumn("c", F.first(F.when(F.col("mark") == 0, change), ignorenulls=True).over(line)).where("mark = 1 and c is not null")
    closed = closed.groupBy(key, "id").agg(F.min_by("c.by", F.struct("c.ts", in_text_order(F.col("c.occurred_at")), in_text_order(F.col("c.by")))).alias("_todo"))
    by = F.when(F.col("kind") == "ends_with_question", F.col("_q")).when(F.col("kind") == "unresolved_assistant_q", F.col("_aq")).when(F.col("kind") == "contains_todo", F.col("_todo"))
    sure = F.create_map(*[F.lit(x) for kv in CONFIDENCE.items() for x in kv])[F.col("kind")]
    out = found.join(closed, [key, "id"], "left")
    return out.select(key, "id", "ts", "kind", "text", sure.alias("confidence"), by.alias("resolved_by"))


def rank_signals(atoms: DataFrame, until: Column, key: str = "cluster", now: Column | None = None, more: tuple[Column, ...] = ()) -> DataFrame:
    """size, median age (microseconds before ``until``), recency (an hour, both ends closed), density, breadth, whether git is among the
    apps, and whether all is recent work of a single one (of five minutes before ``now``; false where that is not given); ``more`` aggregates
    come along."""
    age = micros(until) - micros(F.col("ts"))
    apps = F.countDistinct("app")
    own = F.lit(False) if now is None else (apps == 1) & (micros(now) - F.max(micros(F.col("ts"))) <= OWN_WORK_US)
    return atoms.groupBy(key).agg(
        F.count("*").alias("size"),
        F.percentile(age.cast("double"), 0.5).alias("median_age"),
        F.bool_or((age >= 0) & (age <= RECENT_HOURS * 3_600_000_000)).alias("recent"),
        (F.count("*") >= 5).alias("dense"),
        (apps >= 3).alias("cross_tool"),
        F.bool_or(F.col("app") == "git").alias("has_git"),
        own.alias("own_recent"),
        F.min("id").alias("first_id"),
        *more,
    )


def with_context_signals(signals: DataFrame, loops: DataFrame, anchors: DataFrame, hinted: DataFrame, key: str = "cluster") -> DataFrame:
    """Adds open_loop (one is unresolved), code_anchor and hint (the cluster is in ``hinted``)."""
    unresolved = loops.where("resolved_by is null").select(key).distinct().withColumn("open_loop", F.lit(True))
    code = anchors.where(F.col("type").isin(*CODE_TYPES)).select(key).distinct().withColumn("_code", F.lit(True))
    told = hinted.select(key).distinct().withColumn("hint", F.lit(True))
    out = signals.join(unresolved, key, "left").join(code, key, "left").join(told, key, "left").na.fill(False, ["open_loop", "_code", "hint"])
    return out.withColumn("code_anchor", F.col("_code") | F.col("has_git") | F.col("cross_tool")).drop("_code")


def reasons(prefix: str = "") -> Column:
    """The signals of a cluster that hold, by name."""
    named = (("recent", "recent_activity"), ("hint", "matches_artifact_hint"), ("open_loop", "has_unresolved_open_loop"), ("code_anchor", "code_session_anchor"), ("dense", "dense"), ("cross_tool", "cross_tool"))
    return F.array_compact(F.array(*[F.when(F.col(prefix + c), n) for c, n in named]))


def best_first(signals: DataFrame, tie: str = "cluster") -> list[Column]:
    """The order of clusters: not only the caller's own recent work, then matching the hint, recent, open, larger, younger, by id. Signals
    that are no columns count as false."""
    have = set(signals.columns)
    order = [F.asc("own_recent") if "own_recent" in have else None, *(F.desc(c) if c in have else None for c in ORDER[1:5]), F.asc("median_age"), F.asc(tie)]
    return [c for c in order if c is not None]


def ranked(signals: DataFrame, tie: str = "cluster") -> DataFrame:
    """Adds ``rank``, 1 for the best cluster.

    Clusters are counted by their signals, size and age in days first; only clusters alike in all of these are sorted together, and what
    is numbered in one task are those counts.
    """
    have = set(signals.columns)
    alike = [c for c in ORDER[:5] if c in have]
    rows = signals.withColumn("_day", F.floor(F.col("median_age") / F.lit(86_400_000_000.0)).cast("long"))
    order = [F.asc(c) if c == "own_recent" else F.desc(c) for c in alike] + [F.asc("_day")]
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(*alike, "_day").agg(F.count("*").alias("_c")).withColumn("_start", F.coalesce(F.sum("_c").over(before), F.lit(0))).drop("_c")
    within = Window.partitionBy(*alike, "_day").orderBy("median_age", tie)
    out = rows.join(starts, [*alike, "_day"]).withColumn("rank", (F.row_number().over(within) + F.col("_start")).cast("int"))
    return out.select(*signals.columns, "rank")


def truncated(members: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` atoms of clusters from best to worst, newest first within each (columns rank, ts, id)."""
    return members.orderBy("rank", F.desc("ts"), in_text_order(F.col("id")).desc()).limit(limit)


def first_resolver(rows: DataFrame, key: list[str], is_hint: Column, resolves: Column, order: list[str], id_: str = "id") -> DataFrame:
    """Hints with the first later row of their key that resolves one, or null."""
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(1, Window.unboundedFollowing)
    return rows.withColumn("resolver", F.first(F.when(resolves, F.col(id_)), ignorenulls=True).over(w)).where(is_hint)
