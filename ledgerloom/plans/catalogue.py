"""Registered queries over the driver's tables, with their SQL for an independent engine.

The events table stands for a ledger: event_id is the id and append sequence, event_type the app, user_id the lineage owner, props the
metadata; sources of all families are derived from event_id.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import paths, text
from ..operators import clusters, groups, topology, turns
from ..sources import ledger as L
from ..sources import workspace
from . import normalization, surface

T0, T1 = datetime(2024, 1, 5), datetime(2024, 1, 12)
GAP_HOURS = 4.0


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger of the events table, ingested and written once for the application, so that every query reads its columns."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.get_json_object("props", "$.k").cast("bigint")
    m = F.col("event_id") % 5
    user = F.col("user_id").cast("string")
    source = (
        F.when(m == 0, F.concat(F.lit("fs:/home/u"), user, F.lit("/.claude/projects/p"), (F.col("user_id") % 4).cast("string"), F.lit("/"), "event_type", F.lit(".jsonl/")))
        .when(m == 1, F.concat(F.lit("fs:C:\\Users\\U"), user, F.lit("\\.codex\\sessions\\"), "event_type", F.lit(".jsonl")))
        .when(m == 2, F.concat(F.lit("git:/work/r"), (F.col("user_id") % 6).cast("string")))
        .when(m == 3, F.lit("api:granola")).otherwise(F.concat(F.lit("app:"), "event_type"))
    )
    meta = (
        F.when(k % 4 == 0, F.concat(F.lit('{"project_key": "local:workspace:/work/r'), (k % 6).cast("string"), F.lit('", "surface": "fs"}')))
        .when(k % 4 == 1, F.concat(F.lit('{"canonical_root": "/work/r'), (k % 6).cast("string"), F.lit('", "session_id": "s'), (k % 7).cast("string"), F.lit('"}')))
        .when(k % 4 == 2, F.concat(F.lit('{"repo_root": "/work/r'), (k % 6).cast("string"), F.lit('/./src/../lib", "session_id": '), (k % 7).cast("string"), F.lit(', "surface": "coord"}')))
        .otherwise(F.lit('{"project_key": null, "session_id": "s1"}'))
    )
    out = e.select(F.col("event_id").cast("string").alias("id"), F.col("event_id").alias("seq"), source.alias("source"), "ts", "user_id", "event_type", "value", k.alias("k"), meta.alias("metadata"))
    return workspace.materialized(spark, "ledger", [f"{sf_dir}/events.parquet"], lambda: L.ingested(out), ("app",))


LEDGER_SQL = r"""ledger AS (SELECT CAST(event_id AS VARCHAR) AS id, event_id AS seq, ts, user_id, event_type, value, k,
  CASE event_id % 5 WHEN 0 THEN 'fs:/home/u' || user_id || '/.claude/projects/p' || (user_id % 4) || '/' || event_type || '.jsonl/'
    WHEN 1 THEN 'fs:C:\Users\U' || user_id || '\.codex\sessions\' || event_type || '.jsonl'
    WHEN 2 THEN 'git:/work/r' || (user_id % 6) WHEN 3 THEN 'api:granola' ELSE 'app:' || event_type END AS source,
  CASE event_id % 5 WHEN 0 THEN 'fs:/home/u' || user_id || '/.claude/projects/p' || (user_id % 4) || '/' || event_type || '.jsonl'
    WHEN 1 THEN lower('fs:C:/Users/U' || user_id || '/.codex/sessions/' || event_type || '.jsonl')
    WHEN 2 THEN 'git:/work/r' || (user_id % 6) END AS source_key,
  CASE event_id % 5 WHEN 0 THEN 2 WHEN 1 THEN 4 WHEN 2 THEN 8 WHEN 3 THEN 16 ELSE 0 END AS family_mask,
  CASE k % 4 WHEN 0 THEN 'fs' WHEN 2 THEN 'coord' END AS surface,
  CASE WHEN k % 4 = 1 THEN 's' || (k % 7) WHEN k % 4 = 3 THEN 's1' END AS session_id
  FROM (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events))"""
BASE = ("id", "seq", "source", "ts", "event_type")
COLS = ", ".join(BASE)


def _q(sql: str) -> str:
    return f"WITH {LEDGER_SQL} {sql}"


def atoms(spark, sf_dir) -> DataFrame:
    """Atoms for graphs: id, ts, app, project, owner."""
    rows = ledger(spark, sf_dir)
    return rows.select("id", "ts", F.col("event_type").alias("app"), F.concat(F.lit("local:workspace:/work/r"), (F.col("user_id") % 6).cast("string")).alias("project"), F.col("user_id").cast("string").alias("owner"), "user_id", "k")


ATOMS_SQL = LEDGER_SQL + ", atoms AS (SELECT id, ts, event_type AS app, 'local:workspace:/work/r' || (user_id % 6) AS project, CAST(user_id AS VARCHAR) AS owner, user_id, k FROM ledger)"


def bridge(spark, sf_dir) -> DataFrame:
    """Artifacts of atoms: a file each, a task for every third, a repo for every second."""
    a = atoms(spark, sf_dir)
    n = F.col("id").cast("bigint")
    arts = F.array_compact(F.array(
        F.concat(F.lit("local_fs:file:r::src/f"), (F.col("k") % 40).cast("string"), F.lit(".py")),
        F.when(n % 3 == 0, F.concat(F.lit("tracker:task:T-"), (n % 400).cast("string"))),
        F.when(n % 2 == 0, F.concat(F.lit("git:repo:"), "project")),
    ))
    out = a.select("id", "ts", "project", "owner", "app", F.explode(arts).alias("artifact"))
    kind = paths.type_of_key(F.col("artifact"))
    return out.select("*", kind.alias("type"), F.col("artifact").alias("key"), paths.membership_of(kind).alias("membership"))


BRIDGE_SQL = ATOMS_SQL + """, bridge AS (
  SELECT id, ts, project, owner, app, 'local_fs:file:r::src/f' || (k % 40) || '.py' AS artifact, 'file' AS type, 'weak' AS membership FROM atoms
  UNION ALL SELECT id, ts, project, owner, app, 'tracker:task:T-' || (CAST(id AS BIGINT) % 400), 'task', 'strong' FROM atoms WHERE CAST(id AS BIGINT) % 3 = 0
  UNION ALL SELECT id, ts, project, owner, app, 'git:repo:' || project, 'repo', 'none' FROM atoms WHERE CAST(id AS BIGINT) % 2 = 0)"""

COMPONENTS_SQL = ATOMS_SQL + """, marked AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w <= 14400000000 THEN 0 ELSE 1 END AS far FROM atoms
  WINDOW w AS (PARTITION BY user_id ORDER BY ts, id)), comp AS (SELECT * EXCLUDE (far), user_id || ':' || CAST(sum(far) OVER (PARTITION BY user_id ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cluster FROM marked)"""


def components(spark, sf_dir) -> DataFrame:
    c = topology.gap_components(atoms(spark, sf_dir), ["user_id"], GAP_HOURS)
    return c.withColumn("cluster", F.concat_ws(":", F.col("user_id").cast("string"), F.col("component").cast("string"))).drop("component")


UNTIL = "timestamp_ntz'2024-01-30 00:00:00'"
SIGNALS_SQL = """signals AS (SELECT cluster, count(*) AS size, median(epoch_us(TIMESTAMP '2024-01-30') - epoch_us(ts)) AS median_age,
  bool_or(epoch_us(TIMESTAMP '2024-01-30') - epoch_us(ts) BETWEEN 0 AND 3600000000) AS recent, count(*) >= 5 AS dense, count(DISTINCT app) >= 3 AS cross_tool, false AS has_git, false AS own_recent, min(id) AS first_id FROM comp GROUP BY cluster)"""


def signals(spark, sf_dir) -> DataFrame:
    return clusters.rank_signals(components(spark, sf_dir), F.expr(UNTIL))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gap-bounded lineage clusters with size, app breakdown, time range and median age, ranked."""
    facts = (text.iso_millis(F.min("ts")).alias("ts_from"), text.iso_millis(F.max("ts")).alias("ts_to"), clusters.cluster_id(F.collect_list("id")).alias("cluster_id"))
    ranked = clusters.ranked(clusters.rank_signals(components(spark, sf_dir), F.expr(UNTIL), more=facts))
    return ranked.select("cluster", "cluster_id", "rank", "size", "median_age", "recent", "dense", "cross_tool", "ts_from", "ts_to")


ISO = "strftime(%s, '%%Y-%%m-%%dT%%H:%%M:%%S.%%gZ')"


def _turn_rows(spark, sf_dir) -> DataFrame:
    e = ledger(spark, sf_dir)
    return e.select(F.lit("codex").alias("provider"), F.when(F.col("k") % 5 != 4, F.concat(F.lit("t"), F.col("user_id").cast("string"), F.lit("-"), (F.col("k") % 9).cast("string"))).alias("logical_turn_id"), F.when(F.col("seq") % 3 == 0, "original").when(F.col("seq") % 3 == 1, "inherited").otherwise("unknown").alias("observation_kind"), "id", F.col("ts").alias("occurred_ts"), F.col("ts").alias("observed_ts"))


TURNS_SQL = LEDGER_SQL + """, obs AS (SELECT CASE WHEN k % 5 <> 4 THEN 't' || user_id || '-' || (k % 9) END AS turn, CASE seq % 3 WHEN 0 THEN 'original' WHEN 1 THEN 'inherited' ELSE 'unknown' END AS kind, id, ts FROM ledger),
 turns AS (SELECT turn AS logical_turn_id, arg_min(id, (CASE kind WHEN 'original' THEN 0 ELSE 2 END, ts, id)) AS id, max(ts) AS observed_ts, count(*) AS raw_observation_count, bool_and(kind = 'inherited') AS inherited_only FROM obs WHERE turn IS NOT NULL AND kind <> 'unknown' GROUP BY turn
  UNION ALL SELECT turn, id, ts, 1, false FROM obs WHERE turn IS NULL OR kind = 'unknown')"""


def _group_atoms(spark, sf_dir) -> DataFrame:
    a = atoms(spark, sf_dir)
    return a.select(F.concat(F.lit("project:"), "project").alias("group_key"), "id", "ts", "app", F.col("owner").alias("thread"), (F.col("k") % 3 + 1).alias("raw"))


GROUPS_SQL = ATOMS_SQL + ", g AS (SELECT 'project:' || project AS group_key, id, ts, app, owner AS thread, k % 3 + 1 AS raw FROM atoms)"
MEMBERS_SQL = GROUPS_SQL + """, lead AS (SELECT *, row_number() OVER (PARTITION BY group_key, app ORDER BY ts DESC, id) = 1 AS first FROM g),
 pick AS (SELECT *, row_number() OVER (PARTITION BY group_key ORDER BY first DESC, ts DESC, id) AS p FROM lead)"""


def _pairs(spark, sf_dir) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    w = Window.partitionBy("conv_id").orderBy("turn")
    nxt = c.select("conv_id", "turn", "role", "text", F.lead("role").over(w).alias("next_role"), F.lead("text").over(w).alias("next_text"))
    return nxt.where("role = 'user' and next_role = 'assistant'").select("conv_id", "turn", F.concat(F.lit("USER: "), "text", F.lit("\n\nASSISTANT: "), "next_text").alias("content"))


PAIRS_SQL = """nxt AS (SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
 pairs AS (SELECT conv_id, turn, text AS u, next_text AS a FROM nxt WHERE role = 'user' AND next_role = 'assistant')"""


def _catalogue() -> dict:
    """name: (query of spark and folder, SQL or None)."""
    q: dict = {}
    led = ledger
    scan = lambda **kw: lambda s, d: L.Scan(**kw).run(led(s, d)).select(*BASE)
    every = lambda cond: lambda s, d: led(s, d).where(cond() if callable(cond) else cond).select(*BASE)
    page = "ORDER BY ts DESC, id DESC LIMIT 1000"
    at = "TIMESTAMP '2024-01-12'"
    q["ledger_newest_page"] = scan(), _q(f"SELECT {COLS} FROM ledger {page}")
    q["ledger_keyset_before"] = scan(before=(T1, "5000")), _q(f"SELECT {COLS} FROM ledger WHERE (ts, id) < ({at}, '5000') {page}")
    q["ledger_keyset_after_asc"] = scan(after=(T0, "0"), ascending=True), _q(f"SELECT {COLS} FROM ledger WHERE (ts, id) > (TIMESTAMP '2024-01-05', '0') ORDER BY ts, id LIMIT 1000")
    q["ledger_time_range"] = every(L.Scan(since=T0, until=T1).predicate), _q(f"SELECT {COLS} FROM ledger WHERE ts >= TIMESTAMP '2024-01-05' AND ts < {at}")
    q["source_exact"] = every(L.Scan(source="fs:c:/users/u8/.codex/sessions/view.jsonl/").predicate), _q(f"SELECT {COLS} FROM ledger WHERE source_key = 'fs:c:/users/u8/.codex/sessions/view.jsonl'")
    q["source_prefix"] = every(L.Scan(source_prefixes=("fs:/home/u1", "fs:C:\\users\\u2")).predicate), _q(f"SELECT {COLS} FROM ledger WHERE source_key LIKE 'fs:/home/u1/%' OR source_key LIKE 'fs:c:/users/u2/%'")
    q["source_prefix_raw"] = every(L.Scan(source_prefixes=("app:",)).predicate), _q(f"SELECT {COLS} FROM ledger WHERE starts_with(source, 'app:')")
    q["family_mask"] = every(L.Scan(family="codex").predicate), _q(f"SELECT {COLS} FROM ledger WHERE family_mask & 4 <> 0")
    q["metadata_match"] = every(L.Scan(metadata={"session_id": "s3"}).predicate), _q(f"SELECT {COLS} FROM ledger WHERE session_id = 's3'")
    q["metadata_in_list"] = every(L.Scan(metadata={"session_id": ["s1", "s5"]}).predicate), _q(f"SELECT {COLS} FROM ledger WHERE session_id IN ('s1', 's5')")
    q["surface_exclude"] = every(L.Scan(exclude_surfaces=("fs", "coord")).predicate), _q(f"SELECT {COLS} FROM ledger WHERE coalesce(surface, '') NOT IN ('fs', 'coord')")
    q["project_precedence"] = every(L.Scan(project=("local:workspace:/work/r2", ("/work/r2",))).predicate), _q(f"SELECT {COLS} FROM ledger WHERE k % 4 IN (0, 1, 2) AND k % 6 = 2")
    q["text_search"] = (lambda s, d: s.read.parquet(f"{d}/documents.parquet").where(text.contains_folded(F.col("text"), "THE ON")).select("doc_id", "lang", "n_chars")), "SELECT doc_id, lang, n_chars FROM documents WHERE contains(lower(text), 'the on')"
    q["count"] = (lambda s, d: led(s, d).agg(F.count("*").alias("n"))), _q("SELECT count(*) AS n FROM ledger")
    q["watermark_max_seq"] = (lambda s, d: L.current_sequence(led(s, d), ("git:",))), _q("SELECT coalesce(max(seq), 0) AS seq FROM ledger WHERE starts_with(source, 'git:')")
    q["append_order_since"] = (lambda s, d: L.since_sequence(led(s, d), 500, ("git:", "api:")).select(*BASE)), _q(f"SELECT {COLS} FROM ledger WHERE seq >= 500 AND (starts_with(source, 'git:') OR starts_with(source, 'api:')) ORDER BY seq LIMIT 1000")
    ids = ["7", "3", "7", "absent", "42", "11"]
    q["multi_get_ordered"] = (lambda s, d: L.multi_get(led(s, d), ids).select("pos", *BASE)), _q(f"SELECT pos, {COLS} FROM ledger JOIN (SELECT CAST(unnest(range(6)) AS INTEGER) AS pos, unnest(['7', '3', '7', 'absent', '42', '11']) AS want) ON id = want")
    q["missing_ids"] = (lambda s, d: s.sql("SELECT explode(array('7','absent','42','gone')) AS id").join(led(s, d).select("id"), "id", "left_anti")), _q("SELECT want AS id FROM (SELECT unnest(['7', 'absent', '42', 'gone']) AS want) WHERE want NOT IN (SELECT id FROM ledger)")
    keyed = lambda s, d: led(s, d).select(L.dedupe_id(F.concat("event_type", F.lit("/"), F.col("k").cast("string"))).alias("id"), "seq", "k")
    q["dedupe_ids"] = (lambda s, d: L.new_rows(keyed(s, d).drop("k"), keyed(s, d).where("k < 30").select("id"))), _q("SELECT 'dedupe:v1:' || sha256('ledgerloom:event-dedupe:v1' || chr(0) || event_type || '/' || k) AS id, min(seq) AS seq FROM ledger WHERE (event_type, k) NOT IN (SELECT event_type, k FROM ledger WHERE k < 30) GROUP BY event_type, k")
    q["source_normalize"] = (lambda s, d: led(s, d).select("id", "source_key", "family_mask", paths.source_app(F.col("source")).alias("app"))), _q("SELECT id, source_key, family_mask, CASE family_mask WHEN 2 THEN 'claude_code' WHEN 4 THEN 'codex' WHEN 8 THEN 'git' WHEN 16 THEN 'granola' END AS app FROM ledger")
    q["path_dot_segments"] = (lambda s, d: led(s, d).where("has_repo_root").select("id", paths.dot_free(F.col("m_repo_root")).alias("path"))), _q("SELECT id, '/work/r' || (k % 6) || '/lib' AS path FROM ledger WHERE k % 4 = 2")
    q["canonical_timestamp"] = (lambda s, d: led(s, d).select("id", text.iso_millis(F.col("ts")).alias("ts_text"))), _q(f"SELECT id, {ISO % 'ts'} AS ts_text FROM ledger")

    q["adjacent_edges"] = (lambda s, d: topology.adjacent(atoms(s, d), ["user_id"], GAP_HOURS)), f"WITH {ATOMS_SQL} SELECT user_id, prev AS from_id, id AS to_id, gap AS gap_us FROM (SELECT user_id, id, lag(id) OVER w AS prev, epoch_us(ts) - lag(epoch_us(ts)) OVER w AS gap FROM atoms WINDOW w AS (PARTITION BY user_id ORDER BY ts, id)) WHERE gap <= 14400000000"
    q["artifact_candidates"] = (lambda s, d: topology.adjacent(bridge(s, d).where("membership <> 'none'"), ["project", "key"], GAP_HOURS)), f"WITH {BRIDGE_SQL} SELECT project, artifact AS key, prev AS from_id, id AS to_id, gap AS gap_us FROM (SELECT project, artifact, id, lag(id) OVER w AS prev, epoch_us(ts) - lag(epoch_us(ts)) OVER w AS gap FROM bridge WHERE membership <> 'none' WINDOW w AS (PARTITION BY project, artifact ORDER BY ts, id)) WHERE gap <= 14400000000"
    q["gap_components"] = (lambda s, d: components(s, d).select("id", "cluster")), f"WITH {COMPONENTS_SQL} SELECT id, cluster FROM comp"
    q["constrained_forest"] = (lambda s, d: topology.constrained_forest(atoms(s, d), bridge(s, d), GAP_HOURS)), None
    q["cluster_id_hash"] = (lambda s, d: components(s, d).groupBy("cluster").agg(clusters.cluster_id(F.collect_list("id")).alias("cluster_id"))), f"WITH {COMPONENTS_SQL} SELECT cluster, 'ctx_' || substr(sha256('1' || string_agg(id, ',' ORDER BY id)), 1, 8) AS cluster_id FROM comp GROUP BY cluster"
    q["source_breakdown"] = (lambda s, d: components(s, d).groupBy("cluster", "app").agg(F.count("*").alias("n"))), f"WITH {COMPONENTS_SQL} SELECT cluster, app, count(*) AS n FROM comp GROUP BY cluster, app"
    q["breakdown_map"] = (lambda s, d: clusters.source_breakdown(components(s, d)).select("cluster", F.to_json("breakdown").alias("breakdown"))), f"WITH {COMPONENTS_SQL} SELECT cluster, '{{' || string_agg('\"' || app || '\":' || n, ',' ORDER BY app) || '}}' AS breakdown FROM (SELECT cluster, app, count(*) AS n FROM comp GROUP BY cluster, app) GROUP BY cluster"
    q["time_range_text"] = (lambda s, d: components(s, d).groupBy("cluster").agg(F.min_by(text.iso_millis(F.col("ts")), "ts").alias("ts_from"), F.max_by(text.iso_millis(F.col("ts")), "ts").alias("ts_to"))), f"WITH {COMPONENTS_SQL} SELECT cluster, {ISO % 'min(ts)'} AS ts_from, {ISO % 'max(ts)'} AS ts_to FROM comp GROUP BY cluster"
    named = lambda s, d: bridge(s, d).withColumn("cluster", F.concat_ws("/", "project", "app"))
    q["top3_anchor"] = (lambda s, d: clusters.top_anchors(named(s, d))), f"WITH {BRIDGE_SQL} SELECT * FROM (SELECT cluster, artifact, atoms, CAST(row_number() OVER (PARTITION BY cluster ORDER BY atoms DESC, artifact) AS INTEGER) AS place FROM (SELECT project || '/' || app AS cluster, artifact, count(DISTINCT id) AS atoms FROM bridge WHERE type NOT IN ('repo', 'conversation') GROUP BY ALL)) WHERE place <= 3"
    q["verb_mode"] = (lambda s, d: clusters.labels(clusters.top_anchors(named(s, d)), atoms(s, d).select(F.concat_ws("/", "project", "app").alias("cluster"), "id", "ts", F.when(F.col("k") % 3 == 0, "message").when(F.col("k") % 3 == 1, "edit").otherwise("other").alias("verb")))), f"WITH {BRIDGE_SQL}, top AS (SELECT cluster, artifact FROM (SELECT cluster, artifact, row_number() OVER (PARTITION BY cluster ORDER BY atoms DESC, artifact) AS place, atoms FROM (SELECT project || '/' || app AS cluster, artifact, count(DISTINCT id) AS atoms FROM bridge WHERE type <> 'repo' GROUP BY ALL)) WHERE place = 1 AND atoms >= 2), verbs AS (SELECT project || '/' || app AS cluster, CASE k % 3 WHEN 0 THEN 'discussion about' WHEN 1 THEN 'edits to' ELSE 'work on' END AS verb, count(*) AS n, min((ts, id)) AS first FROM atoms GROUP BY ALL), best AS (SELECT cluster, verb, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, first) AS p FROM verbs) SELECT cluster, verb || ' ' || regexp_extract(artifact, '[^/:]*$') AS label FROM top JOIN best USING (cluster) WHERE p = 1"
    q["median_age"] = (lambda s, d: signals(s, d).select("cluster", "median_age")), f"WITH {COMPONENTS_SQL}, {SIGNALS_SQL} SELECT cluster, CAST(median_age AS DOUBLE) AS median_age FROM signals"
    q["rank_signals"] = (lambda s, d: signals(s, d).drop("median_age")), f"WITH {COMPONENTS_SQL}, {SIGNALS_SQL} SELECT * EXCLUDE (median_age) FROM signals"
    order = "recent DESC, size DESC, median_age, cluster"
    q["cluster_rank"] = (lambda s, d: clusters.ranked(signals(s, d)).select("cluster", "size", "rank")), f"WITH {COMPONENTS_SQL}, {SIGNALS_SQL} SELECT cluster, size, CAST(row_number() OVER (ORDER BY {order}) AS INTEGER) AS rank FROM signals"
    q["cluster_overview"] = flagship, f"WITH {COMPONENTS_SQL}, {SIGNALS_SQL}, facts AS (SELECT cluster, 'ctx_' || substr(sha256('1' || string_agg(id, ',' ORDER BY id)), 1, 8) AS cluster_id, {ISO % 'min(ts)'} AS ts_from, {ISO % 'max(ts)'} AS ts_to FROM comp GROUP BY cluster) SELECT cluster, cluster_id, CAST(row_number() OVER (ORDER BY {order}) AS INTEGER) AS rank, size, CAST(median_age AS DOUBLE) AS median_age, recent, dense, cross_tool, ts_from, ts_to FROM signals JOIN facts USING (cluster)"
    q["atom_budget_truncate"] = (lambda s, d: clusters.truncated(components(s, d).join(clusters.ranked(signals(s, d)).select("cluster", "rank"), "cluster"), 500).select("id", "cluster", "rank")), f"WITH {COMPONENTS_SQL}, {SIGNALS_SQL}, r AS (SELECT cluster, CAST(row_number() OVER (ORDER BY {order}) AS INTEGER) AS rank FROM signals) SELECT id, cluster, rank FROM comp JOIN r USING (cluster) ORDER BY rank, ts DESC, id DESC LIMIT 500"
    q["semi_artifact_hint"] = (lambda s, d: components(s, d).join(components(s, d).join(bridge(s, d).where("artifact = 'tracker:task:T-9'").select("id"), "id", "left_semi").select("cluster").distinct(), "cluster", "left_semi").select("id", "cluster")), f"WITH {COMPONENTS_SQL} SELECT id, cluster FROM comp WHERE cluster IN (SELECT cluster FROM comp WHERE CAST(id AS BIGINT) % 3 = 0 AND CAST(id AS BIGINT) % 400 = 9)"
    q["hint_first_resolver"] = (lambda s, d: clusters.first_resolver(atoms(s, d), ["user_id"], F.col("app") == "error", F.col("app") == "purchase", ["ts", "id"]).select("id", "resolver")), f"WITH {ATOMS_SQL} SELECT id, resolver FROM (SELECT id, app, first_value(CASE WHEN app = 'purchase' THEN id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS resolver FROM atoms) WHERE app = 'error'"
    q["logical_turns"] = (lambda s, d: turns.logical_turns(_turn_rows(s, d)).select("logical_turn_id", "id", "observed_ts", "raw_observation_count", "inherited_only")), f"WITH {TURNS_SQL} SELECT * FROM turns"
    q["logical_turn_counters"] = (lambda s, d: turns.turn_counters(turns.logical_turns(_turn_rows(s, d)))), f"WITH {TURNS_SQL} SELECT CAST(sum(raw_observation_count) AS BIGINT) AS raw, count(*) AS logical, CAST(sum(raw_observation_count) - count(*) AS BIGINT) AS collapsed, CAST(coalesce(sum(raw_observation_count) FILTER (inherited_only), 0) AS BIGINT) AS inherited_only FROM turns"
    q["discovery_groups"] = (lambda s, d: groups.discovery_groups(_group_atoms(s, d)).withColumn("by_app", F.to_json("by_app")).withColumn("group_id", groups.group_id("project", F.col("group_key")))), f"WITH {GROUPS_SQL} SELECT group_key, count(*) AS turns, CAST(sum(raw) AS BIGINT) AS raw_observations, CAST(sum(raw) - count(*) AS BIGINT) AS collapsed, count(DISTINCT thread) AS threads, min(ts) AS ts_from, max(ts) AS ts_to, any_value(by_app) AS by_app, 'grp_project_' || substr(sha256('\"' || group_key || '\"'), 1, 16) AS group_id FROM g JOIN (SELECT group_key, '{{' || string_agg('\"' || app || '\":' || n, ',' ORDER BY app) || '}}' AS by_app FROM (SELECT group_key, app, count(*) AS n FROM g GROUP BY ALL) GROUP BY group_key) USING (group_key) GROUP BY group_key"
    q["representatives"] = (lambda s, d: groups.representatives(_group_atoms(s, d)).select("group_key", "id", "place")), f"WITH {MEMBERS_SQL} SELECT group_key, id, CAST(p AS INTEGER) AS place FROM pick WHERE p <= 3"
    q["member_order"] = (lambda s, d: groups.member_order(_group_atoms(s, d)).select("group_key", "id", "place")), f"WITH {MEMBERS_SQL} SELECT group_key, id, CAST(row_number() OVER (PARTITION BY group_key ORDER BY p <= 3 DESC, CASE WHEN p <= 3 THEN p END, ts DESC, id) AS INTEGER) AS place FROM pick"
    q["mru_per_source"] = (lambda s, d: led(s, d).groupBy("source").agg(F.max_by("id", F.struct("ts", "id")).alias("id"), F.max("ts").alias("ts"))), _q("SELECT source, arg_max(id, (ts, id)) AS id, max(ts) AS ts FROM ledger GROUP BY source")
    poll = lambda: Window.orderBy("ts")
    q["new_turns_poll"] = (lambda s, d: turns.first_with_ties(led(s, d).where(F.col("ts") > F.lit(T1)), 20).withColumn("place", F.rank().over(poll())).select("id", "ts", "place")), _q(f"SELECT id, ts, CAST(place AS INTEGER) AS place FROM (SELECT id, ts, rank() OVER (ORDER BY ts) AS place FROM ledger WHERE ts > {at}) WHERE place <= 20")
    q["union_dedupe_poll"] = (lambda s, d: led(s, d).where(L.Scan(source_prefixes=("git:", "api:granola")).predicate() | (F.col("event_type") == "error")).where(F.col("ts") > F.lit(T1)).select("id", "ts")), _q(f"SELECT DISTINCT id, ts FROM (SELECT id, ts FROM ledger WHERE starts_with(source, 'git:') UNION ALL SELECT id, ts FROM ledger WHERE source = 'api:granola' UNION ALL SELECT id, ts FROM ledger WHERE event_type = 'error') WHERE ts > {at}")
    ck = lambda: Window.partitionBy("user_id", "event_type").orderBy(F.col("k").isNotNull().desc(), F.desc("k"), F.desc("seq"))
    q["checkpoint_rank"] = (lambda s, d: led(s, d).withColumn("n", F.row_number().over(ck())).where("n = 1").select("user_id", "event_type", "k", "seq")), _q("SELECT user_id, event_type, k, seq FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY k IS NOT NULL DESC, k DESC, seq DESC) AS n FROM ledger) WHERE n = 1")
    q["superseded_latest"] = (lambda s, d: led(s, d).join(led(s, d).where("k % 10 = 0").select((F.col("seq") + 1).alias("seq")), "seq", "left_anti").groupBy("user_id").agg(F.max_by("id", F.struct("ts", "id")).alias("id"))), _q("SELECT user_id, arg_max(id, (ts, id)) AS id FROM ledger WHERE seq NOT IN (SELECT seq + 1 FROM ledger WHERE k % 10 = 0) GROUP BY user_id")
    q["tool_call_last_result"] = (lambda s, d: led(s, d).where("event_type = 'click'").join(led(s, d).where("event_type = 'error'").groupBy("user_id", "k").agg(F.max_by("id", "seq").alias("result")), ["user_id", "k"], "left").select("id", "result")), _q("SELECT c.id, r.result FROM (SELECT * FROM ledger WHERE event_type = 'click') c LEFT JOIN (SELECT user_id, k, arg_max(id, seq) AS result FROM ledger WHERE event_type = 'error' GROUP BY ALL) r USING (user_id, k)")
    q["turn_pair_extract"] = (lambda s, d: _pairs(s, d).select("conv_id", "turn", text.turn_pair(F.col("content"))[0].alias("input"), text.turn_pair(F.col("content"))[1].alias("output"))), f"WITH {PAIRS_SQL} SELECT conv_id, turn, u AS input, a AS output FROM pairs"
    q["open_loop_hints"] = (lambda s, d: _pairs(s, d).select("conv_id", "turn", F.concat_ws(",", text.open_loop_hints(*text.turn_pair(F.col("content")), question=".")).alias("hints"))), f"WITH {PAIRS_SQL} SELECT conv_id, turn, concat_ws(',', CASE WHEN regexp_matches(u, '\\.\\s*$') THEN 'ends_with_question' END, CASE WHEN regexp_matches(a, '\\.\\s*$') THEN 'unresolved_assistant_q' END) AS hints FROM pairs"
    q["initiator"] = (lambda s, d: _pairs(s, d).select("conv_id", "turn", text.initiator(F.when(F.col("turn") % 3 == 0, F.concat(F.lit(" \n<system-reminder>"), "content")).otherwise(F.col("content"))).alias("initiator"))), f"WITH {PAIRS_SQL} SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'system' ELSE 'human' END AS initiator FROM pairs"
    uuid = lambda: F.concat_ws("-", F.substring(F.lpad(F.lower(F.hex(F.col("seq") * 1000003 + 1700000000000)), 12, "0"), 1, 8), F.substring(F.lpad(F.lower(F.hex(F.col("seq") * 1000003 + 1700000000000)), 12, "0"), 9, 4), F.lit("7abc"), F.lit("9def"), F.lit("0123456789ab"))
    q["uuid7_time"] = (lambda s, d: led(s, d).select("id", text.uuid7_millis(uuid()).alias("ms"))), _q("SELECT id, seq * 1000003 + 1700000000000 AS ms FROM ledger")
    q["head_tail_clip"] = (lambda s, d: components(s, d).groupBy("user_id").agg(F.array_sort(F.collect_list(F.col("id").cast("bigint"))).alias("a")).select("user_id", F.array_join(text.head_tail(F.col("a"), 5), ",").alias("ids"))), f"WITH {ATOMS_SQL} SELECT user_id, array_to_string(CASE WHEN len(a) > 5 THEN list_concat(a[1:2], a[-3:]) ELSE a END, ',') AS ids FROM (SELECT user_id, list(CAST(id AS BIGINT) ORDER BY CAST(id AS BIGINT)) AS a FROM atoms GROUP BY user_id)"
    q["role_lookup"] = (lambda s, d: bridge(s, d).select("id", "artifact", "membership", paths.role_of(F.col("type")).alias("role"))), f"WITH {BRIDGE_SQL} SELECT id, artifact, membership, CASE type WHEN 'repo' THEN 'scope' ELSE 'work' END AS role FROM bridge"
    q["label_tail"] = (lambda s, d: bridge(s, d).select("id", "artifact", paths.id_tail(F.col("artifact")).alias("tail"))), f"WITH {BRIDGE_SQL} SELECT id, artifact, regexp_extract(artifact, '[^/:]*$') AS tail FROM bridge"
    q["credential_scrub"] = (lambda s, d: s.read.parquet(f"{d}/pages.parquet").select("page_id", paths.scrub_credentials(F.regexp_replace("url", "^(https?://)", "$1user:pw@")).alias("url"))), "SELECT page_id, url FROM pages"
    q["payload_hash"] = (lambda s, d: s.read.parquet(f"{d}/documents.parquet").select("doc_id", F.sha2("text", 256).alias("hash"), F.octet_length("text").cast("bigint").alias("n_bytes"))), "SELECT doc_id, sha256(text) AS hash, CAST(strlen(text) AS BIGINT) AS n_bytes FROM documents"
    q["clip_payload"] = (lambda s, d: s.read.parquet(f"{d}/documents.parquet").select("doc_id", text.clip_bytes(F.col("text"), 2000).alias("clip"))), None
    q |= normalization.catalogue(_pairs, PAIRS_SQL)
    q |= surface.catalogue(ledger, atoms, _pairs, _turn_rows, components, PAIRS_SQL, LEDGER_SQL, ATOMS_SQL, COMPONENTS_SQL)
    return q


def queries() -> dict:
    return {k: v[0] for k, v in _catalogue().items()}


def oracle_sql() -> dict:
    return {k: v[1] for k, v in _catalogue().items() if v[1] is not None}
