"""Registered queries of capture, hydration, discovery and open loops over the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import clusters, context, groups, normalize
from ..sources import ledger as L
from ..sources import workspace
from ..streaming import capture
from ..tools import current_runs, without_stale_signals

ISO = "strftime(%s, '%%Y-%%m-%%dT%%H:%%M:%%S.%%gZ')"


def signals(spark, ledger):
    """Every tenth row stands for a manifest of a run (of the user's note, naming two rows after it, each third superseding one), every other
    one for a derived signal."""
    n = F.col("seq")
    manifest = n % 10 == 0
    body = F.to_json(F.struct(
        F.concat(F.lit("note"), (F.col("user_id") % 40).cast("string")).alias("note_id"), F.lit("1").alias("extractor_version"), F.concat(F.lit("run"), n.cast("string")).alias("extraction_run_id"),
        text.iso_millis(F.col("ts")).alias("completed_at"), F.when(n % 30 == 0, F.concat(F.lit("run"), (n - 20).cast("string"))).alias("supersedes"),
        F.when(n % 70 != 0, F.array((n + 1).cast("string"), (n + 2).cast("string"))).alias("signal_atom_ids"),
    ))
    return ledger.select("id", "ts", F.when(manifest, "derived:granola-signals-index").otherwise("derived:granola-signals").alias("source"), F.when(manifest, body).otherwise("{}").alias("metadata"))


RUNS_SQL = """manifests AS (SELECT 'note' || (user_id % 40) AS note_id, 'run' || seq AS extraction_run_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') AS completed_at,
   CASE WHEN seq % 30 = 0 THEN 'run' || (seq - 20) END AS supersedes, seq FROM ledger WHERE seq % 10 = 0 AND seq % 70 <> 0),
 runs AS (SELECT note_id, arg_max(extraction_run_id, (completed_at, extraction_run_id)) AS extraction_run_id, arg_max(seq, (completed_at, extraction_run_id)) AS seq
   FROM manifests WHERE extraction_run_id NOT IN (SELECT supersedes FROM manifests WHERE supersedes IS NOT NULL) GROUP BY note_id)"""


def loop_members(pairs):
    """Turns of conversations as members of clusters: those of the system open no loops, every fourth one has no answer yet."""
    n = F.col("turn")
    got = text.turn_pair(F.col("content"))
    none = F.lit(None).cast("string")
    rows = pairs.select("conv_id", "turn", got[0].alias("input"), F.when(n % 8 != 4, got[1]).alias("output"))
    return rows.select(
        F.col("conv_id").cast("string").alias("cluster"), F.format_string("%d-%04d", "conv_id", "turn").alias("id"), F.timestamp_seconds(F.col("turn")).alias("ts"), F.lit("").alias("occurred_at"),
        F.when(n % 6 == 2, "system").otherwise("human").alias("initiator"), F.concat(F.lit("c"), (F.floor(F.col("turn") / 4)).cast("string")).alias("conversation"), (n % 4 == 0).alias("is_user"),
        "input", "output", none.alias("delta_of"), F.array().cast("array<string>").alias("files"), text.open_loop_hints(F.col("input"), F.col("output"), ".").alias("hints"),
    )


LOOPS_SQL = """m AS (SELECT CAST(conv_id AS VARCHAR) AS cluster, conv_id || '-' || lpad(CAST(turn AS VARCHAR), 4, '0') AS id, turn, 'c' || (turn // 4) AS talk, u AS input,
   CASE WHEN turn % 8 <> 4 THEN a END AS output, turn % 6 = 2 AS of_system, turn % 4 = 0 AS is_user FROM pairs),
 aq AS (SELECT x.id, min(y.id) AS by FROM m x JOIN m y ON x.cluster = y.cluster AND x.talk = y.talk AND y.turn > x.turn AND y.is_user GROUP BY x.id),
 loops AS (SELECT cluster, id, 'ends_with_question' AS kind, trim(regexp_extract(trim(input), '([^.]*\\.)$', 1), ' ' || chr(10)) AS text, 'high' AS confidence, CASE WHEN output IS NOT NULL THEN id END AS resolved_by FROM m WHERE NOT of_system
   UNION ALL SELECT cluster, m.id, 'unresolved_assistant_q', trim(regexp_extract(trim(output), '([^.]*\\.)$', 1), ' ' || chr(10)), 'medium', aq.by FROM m LEFT JOIN aq USING (id) WHERE NOT of_system AND output IS NOT NULL)"""


def identity_atoms(atoms):
    """Atoms of clusters (a user's, by days): some without project, root thread, session or all."""
    k = F.col("k")
    return atoms.select(
        "id", "ts", "app", F.concat_ws(":", F.col("user_id").cast("string"), F.date_format("ts", "dd")).alias("cluster"), F.when(k % 5 != 0, F.col("project")).alias("project_key"),
        F.when(k % 5 != 0, F.regexp_replace("project", "^local:workspace:", "")).alias("canonical_root"), F.when(k % 7 != 0, F.lit("codex")).alias("provider"),
        F.when(k % 3 == 0, F.concat(F.lit("s"), (F.col("user_id") % 9).cast("string"))).alias("session_id"), F.when(k % 3 == 1, F.concat(F.lit("t"), (F.col("user_id") % 4).cast("string"))).alias("root_thread_id"),
        (k % 3 + 1).alias("raw"),
    )


IDENTITY_SQL = """ia AS (SELECT id, ts, app, user_id || ':' || strftime(ts, '%d') AS cluster, CASE WHEN k % 5 <> 0 THEN project END AS pk, CASE WHEN k % 7 <> 0 THEN 'codex' END AS pv,
   CASE WHEN k % 3 = 0 THEN 's' || (user_id % 9) END AS sid, CASE WHEN k % 3 = 1 THEN 't' || (user_id % 4) END AS root, k % 3 + 1 AS raw FROM atoms),
 told AS (SELECT *, coalesce(pk, 'fallback-project:' || cluster) AS part, CASE WHEN pv IS NOT NULL AND root IS NOT NULL THEN concat_ws(chr(0), 'thread', coalesce(pk, 'fallback-project:' || cluster), pv, 'root', root)
   WHEN pv IS NOT NULL AND sid IS NOT NULL THEN concat_ws(chr(0), 'thread', coalesce(pk, 'fallback-project:' || cluster), pv, 'session', sid) END AS own FROM ia),
 sole AS (SELECT cluster, min(own) AS one FROM told WHERE own IS NOT NULL GROUP BY cluster HAVING count(DISTINCT own) = 1),
 ident AS (SELECT id, ts, app, raw, cluster, pk, CASE WHEN pk IS NOT NULL THEN 'project' || chr(0) || pk ELSE 'project-fallback' || chr(0) || cluster END AS project_group,
   coalesce(own, one, concat_ws(chr(0), 'thread-fallback', part, cluster)) AS thread_group FROM told LEFT JOIN sole USING (cluster))"""


def files_of_documents(spark, sf_dir):
    """Arguments of tools made of documents: a patch, a path by key, and a text that names none."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("lang", F.lit("x")).alias("lang"))
    n = F.col("doc_id").cast("string")
    patch = F.concat(F.lit("*** Begin\n*** Update File: src/"), "lang", F.lit(".py\n+x\n*** Move to: src/"), n, F.lit(".py\n*** Add File: src/"), "lang", F.lit(".py"))
    keyed = F.concat(F.lit('{"cmd": "x", "file_path": "/w/'), n, F.lit('", "path" : "/w/'), "lang", F.lit('"}'))
    return d.select("doc_id", text.named_files(F.when(F.col("doc_id") % 3 == 0, patch).when(F.col("doc_id") % 3 == 1, keyed).otherwise("none")).alias("files"))


def captured(spark, sf_dir, ledger):
    """Rows sent to capture: some with naive or offset timestamps, of sources that are not allowed, or of no good shape."""
    n = F.col("seq")
    naive = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS")
    east = F.concat(F.date_format(F.col("ts") + F.expr("interval 2 hours"), "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("+02:00"))
    stamp = F.when(n % 4 == 0, naive).when(n % 4 == 1, F.concat(naive, F.lit("Z"))).when(n % 4 == 2, east).otherwise(F.when(n % 20 == 3, "soon").otherwise(F.concat(naive, F.lit("+00"))))
    return ledger.select("id", "seq", "source", stamp.alias("timestamp"), F.when(n % 9 != 0, "c").alias("content"), F.when(n % 11 == 0, "[1]").otherwise(F.col("metadata")).alias("metadata"))


ALLOWED = {"app": ["view", "click"], "fs": ["/home/u1", "c:/users/u2"], "git": ["/work/r1", "/work/r2/"], "api": []}
GATE_SQL = """CASE WHEN seq % 9 = 0 OR seq % 11 = 0 THEN 'malformed_event'
   WHEN source LIKE 'app:%' AND event_type NOT IN ('view', 'click') THEN 'unknown_app' WHEN source LIKE 'api:%' THEN 'unknown_api'
   WHEN source LIKE 'git:%' AND source NOT IN ('git:/work/r1', 'git:/work/r2') THEN 'unknown_repo'
   WHEN source LIKE 'fs:%' AND NOT (source LIKE 'fs:/home/u1/%' OR lower(replace(source, '\\', '/')) LIKE 'fs:c:/users/u2/%') THEN 'unknown_path'
   WHEN seq % 20 = 3 THEN 'invalid_timestamp' END"""


def catalogue(ledger, atoms, pairs, turn_rows, components, pairs_sql: str, ledger_sql: str, atoms_sql: str, components_sql: str) -> dict:
    q: dict = {}
    led = lambda sql: f"WITH {ledger_sql} {sql}"
    docs = lambda s, d: s.read.parquet(f"{d}/documents.parquet")

    def coord(s, d):
        return ledger(s, d).withColumn("source", F.regexp_replace("source", "^app:", "coord:"))

    q["coord_since"] = (lambda s, d: L.since_sequence(coord(s, d), 300, ("coord:",)).select("id", "seq", "source")), led("SELECT id, seq, replace(source, 'app:', 'coord:') AS source FROM ledger WHERE seq >= 300 AND source LIKE 'app:%' ORDER BY seq LIMIT 1000")
    q["coord_watermark"] = (lambda s, d: L.current_sequence(coord(s, d), ("coord:",))), led("SELECT coalesce(max(seq), 0) AS seq FROM ledger WHERE source LIKE 'app:%'")

    def appended(s, d):
        """Two batches that overlap, appended to a written ledger; the first of each id stays, and numbers go on."""
        rows = ledger(s, d).select(L.dedupe_id(F.concat("event_type", F.lit("/"), (F.col("seq") % 700).cast("string"))).alias("id"), "seq", "source", "ts", F.lit("c").alias("content"), "metadata")
        book = L.WrittenLedger(s, f"{workspace.shared_folder(s)}/append-{workspace.uuid.uuid4().hex}")
        book.append(rows.where("seq < 600"))
        book.append(rows.where("seq >= 400 and seq < 900"))
        return book.read().select("id", "seq", "source")

    q["ledger_append"] = appended, led("""SELECT id, seq, source FROM (SELECT 'dedupe:v1:' || sha256('ledgerloom:event-dedupe:v1' || chr(0) || event_type || '/' || (seq % 700)) AS id, arg_min(source, seq) AS source,
      CAST(row_number() OVER (ORDER BY CASE WHEN min(seq) < 600 THEN 0 ELSE 1 END, min(seq)) AS BIGINT) AS seq FROM ledger WHERE seq < 900 GROUP BY event_type, seq % 700)""")
    q["capture_gate"] = (lambda s, d: capture.gate(captured(s, d, ledger(s, d)), ALLOWED).select("id", "reject_reason")), led(f"SELECT id, {GATE_SQL} AS reject_reason FROM ledger")
    q["captured_timestamps"] = (lambda s, d: captured(s, d, ledger(s, d)).select("id", text.iso_millis(text.captured_instant(F.col("timestamp"))).alias("ts_text"), text.has_tz_mark(F.col("timestamp")).alias("marked"))), led(f"SELECT id, CASE WHEN seq % 20 <> 3 THEN {ISO % 'ts'} END AS ts_text, seq % 4 <> 0 AND seq % 20 <> 3 AS marked FROM ledger")
    q["legacy_timestamps"] = (lambda s, d: L.canonical_times(captured(s, d, ledger(s, d)).where("seq % 20 <> 3")).select("id", "timestamp")), led(f"SELECT id, {ISO % 'ts'} AS timestamp FROM ledger WHERE seq % 20 <> 3")
    q["extractor_policy"] = (lambda s, d: capture.files_only(ledger(s, d).select("id", "source"), ["/home/u3", "C:\\Users\\U4"], ["/home/u5/.claude/projects/p1/view.jsonl"]).select("id", "reject_reason")), led("SELECT id, CASE WHEN source LIKE 'fs:/home/u3/%' OR source LIKE 'fs:C:\\Users\\U4\\%' OR source_key = 'fs:/home/u5/.claude/projects/p1/view.jsonl' THEN NULL ELSE 'unknown_path' END AS reject_reason FROM ledger")
    q["source_dispatch"] = (lambda s, d: ledger(s, d).select("id", normalize.dispatch(F.regexp_replace("source", "/$", "")).alias("adapter"))), led("SELECT id, CASE WHEN source LIKE 'fs:/home%' THEN 'claude_code' WHEN source LIKE 'fs:C:%' THEN 'codex' WHEN source LIKE 'git:%' THEN 'git' WHEN source LIKE 'api:%' THEN 'granola' END AS adapter FROM ledger")
    q["search_default_surfaces"] = (lambda s, d: ledger(s, d).where(L.Scan(exclude_surfaces=("fs", "coord"), metadata={"source": ["git:/work/r1", "git:/work/r3"]}, metadata_keys=L.SEARCH_KEYS).predicate()).select("id", "source")), led("SELECT id, source FROM ledger WHERE coalesce(surface, '') NOT IN ('fs', 'coord') AND source IN ('git:/work/r1', 'git:/work/r3')")
    q["fresh_observations"] = (lambda s, d: turn_rows(s, d).where(~F.col("observation_kind").eqNullSafe("inherited")).select("id")), led("SELECT id FROM ledger WHERE seq % 3 <> 1")
    q["occurrence_window"] = (
        lambda s, d: ledger(s, d).withColumn("occurred", F.col("ts") - F.expr("interval 3 hours") * (F.col("k") % 3)).where("ts >= timestamp_ntz'2024-01-05' and occurred >= timestamp_ntz'2024-01-05' and occurred < timestamp_ntz'2024-01-09'").select("id", "occurred"),
        led("SELECT id, occurred FROM (SELECT id, ts, ts - (k % 3) * INTERVAL 3 HOUR AS occurred FROM ledger) WHERE ts >= TIMESTAMP '2024-01-05' AND occurred >= TIMESTAMP '2024-01-05' AND occurred < TIMESTAMP '2024-01-09'"),
    )
    token = lambda: F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("t "), F.col("doc_id").cast("string"))).when(F.col("doc_id") % 4 == 1, F.repeat(F.lit("x"), (F.col("doc_id") % 600).cast("int"))).when(F.col("doc_id") % 4 == 2, F.concat(F.lit("t\t"), F.col("doc_id").cast("string"))).otherwise(F.concat(F.lit("t-é-"), F.col("doc_id").cast("string")))
    q["logical_turn_ids"] = (lambda s, d: docs(s, d).select("doc_id", token().rlike(normalize.LOGICAL_ID).alias("valid"))), "SELECT doc_id, CASE doc_id % 4 WHEN 1 THEN doc_id % 600 BETWEEN 1 AND 512 WHEN 3 THEN true ELSE false END AS valid FROM documents"
    q["current_signal_runs"] = (lambda s, d: current_runs(signals(s, ledger(s, d))).select("note_id", "extraction_run_id", F.array_join("signal_ids", ",").alias("signal_ids"))), led(f", {RUNS_SQL} SELECT note_id, extraction_run_id, (seq + 1) || ',' || (seq + 2) AS signal_ids FROM runs").replace(") , manifests", "), manifests")
    q["current_signals"] = (lambda s, d: without_stale_signals(signals(s, ledger(s, d)), signals(s, ledger(s, d))).select("id", "source")), led(f", {RUNS_SQL} SELECT id, CASE WHEN seq % 10 = 0 THEN 'derived:granola-signals-index' ELSE 'derived:granola-signals' END AS source FROM ledger WHERE seq % 10 = 0 OR seq IN (SELECT seq + 1 FROM runs UNION SELECT seq + 2 FROM runs)").replace(") , manifests", "), manifests")
    q["open_loops"] = (lambda s, d: clusters.open_loops(loop_members(pairs(s, d)), question=".").select("cluster", "id", "kind", "text", "confidence", "resolved_by")), f"WITH {pairs_sql}, {LOOPS_SQL} SELECT * FROM loops"
    ident = lambda s, d: groups.identities(identity_atoms(atoms(s, d)))
    q["group_identities"] = (lambda s, d: ident(s, d).select("id", groups.group_id("project", F.col("project_group")).alias("project_id"), groups.group_id("thread", F.col("thread_group")).alias("thread_id"), "project_quality")), f"WITH {atoms_sql}, {IDENTITY_SQL} SELECT id, 'grp_project_' || substr(sha256('\"' || replace(project_group, chr(0), '\\u0000') || '\"'), 1, 16) AS project_id, 'grp_thread_' || substr(sha256('\"' || replace(thread_group, chr(0), '\\u0000') || '\"'), 1, 16) AS thread_id, CASE WHEN pk IS NULL THEN 'fallback' ELSE 'canonical' END AS project_quality FROM ident"
    q["thread_groups"] = (
        lambda s, d: groups.discovery_groups(ident(s, d).withColumns({"group_key": F.col("project_group"), "thread": F.col("thread_group")})).select("group_key", "turns", "raw_observations", "threads", "ts_to").orderBy(F.desc("ts_to"), "group_key"),
        f"WITH {atoms_sql}, {IDENTITY_SQL} SELECT project_group AS group_key, count(*) AS turns, CAST(sum(raw) AS BIGINT) AS raw_observations, count(DISTINCT thread_group) AS threads, max(ts) AS ts_to FROM ident GROUP BY project_group",
    )
    q["group_routes"] = (
        lambda s, d: groups.routes(identity_atoms(atoms(s, d)).withColumns({"group_key": F.col("cluster"), "canonical_root": F.concat("canonical_root", F.when(F.col("raw") == 2, "/").otherwise(""))})),
        f"WITH {atoms_sql}, {IDENTITY_SQL} SELECT cluster AS group_key, CASE WHEN bool_and(pk IS NOT NULL) AND count(DISTINCT pk) = 1 THEN replace(min(pk), 'local:workspace:', '') END AS canonical_root FROM ia GROUP BY cluster",
    )
    q["group_ids_escape"] = (
        lambda s, d: docs(s, d).select("doc_id", groups.group_id("project", F.concat(F.lit('C:\\w "'), F.col("lang"), F.lit('"\n\té'))).alias("group_id")),
        "SELECT doc_id, 'grp_project_' || substr(sha256('\"C:\\\\w \\\"' || lang || '\\\"\\n\\té\"'), 1, 16) AS group_id FROM documents",
    )
    until = "timestamp_ntz'2024-01-30'"
    q["own_recent_work"] = (
        lambda s, d: clusters.rank_signals(components(s, d), F.expr(until), now=F.expr("timestamp_ntz'2024-01-20 00:02:00'")).select("cluster", "own_recent", "recent"),
        f"WITH {components_sql} SELECT cluster, count(DISTINCT app) = 1 AND epoch_us(TIMESTAMP '2024-01-20 00:02:00') - max(epoch_us(ts)) <= 300000000 AS own_recent, bool_or(epoch_us(TIMESTAMP '2024-01-30') - epoch_us(ts) BETWEEN 0 AND 3600000000) AS recent FROM comp GROUP BY cluster",
    )

    def all_keys(s, d):
        c = components(s, d)
        rows = clusters.rank_signals(c, F.expr(until), now=F.expr("timestamp_ntz'2024-01-20'")).withColumns({"hint": F.col("first_id").cast("long") % 3 == 0, "open_loop": F.col("first_id").cast("long") % 2 == 0})
        return clusters.ranked(rows).select("cluster", "rank")

    q["cluster_rank_all_keys"] = all_keys, f"""WITH {components_sql}, s AS (SELECT cluster, count(*) AS size, median(epoch_us(TIMESTAMP '2024-01-30') - epoch_us(ts)) AS age, bool_or(epoch_us(TIMESTAMP '2024-01-30') - epoch_us(ts) BETWEEN 0 AND 3600000000) AS recent,
      count(DISTINCT app) = 1 AND epoch_us(TIMESTAMP '2024-01-20') - max(epoch_us(ts)) <= 300000000 AS own, CAST(min(id) AS BIGINT) % 3 = 0 AS hint, CAST(min(id) AS BIGINT) % 2 = 0 AS loop FROM comp GROUP BY cluster)
      SELECT cluster, CAST(row_number() OVER (ORDER BY own, hint DESC, recent DESC, loop DESC, size DESC, age, cluster) AS INTEGER) AS rank FROM s"""
    q["named_files"] = (lambda s, d: files_of_documents(s, d).select("doc_id", F.array_join("files", ",").alias("files"))), "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'src/' || coalesce(lang, 'x') || '.py,src/' || doc_id || '.py' WHEN 1 THEN '/w/' || doc_id || ',/w/' || coalesce(lang, 'x') ELSE '' END AS files FROM documents"
    q["cut_with_note"] = (lambda s, d: docs(s, d).select("doc_id", text.cut_with_note(F.col("text"), 800).alias("cut"))), "SELECT doc_id, CASE WHEN length(text) > 800 THEN substr(text, 1, 800) || chr(10) || '[…truncated; ' || (length(text) - 800) || ' chars dropped]' ELSE text END AS cut FROM documents"
    q["descriptors"] = (
        lambda s, d: ledger(s, d).select("id", F.when(F.octet_length("source") <= 30, F.col("source")).alias("source"), F.octet_length("source").cast("long").alias("source_bytes"), F.octet_length("metadata").cast("long").alias("metadata_bytes")),
        led("SELECT id, CASE WHEN strlen(source) <= 30 THEN source END AS source, CAST(strlen(source) AS BIGINT) AS source_bytes, CAST(CASE k % 4 WHEN 0 THEN 60 WHEN 1 THEN 50 WHEN 2 THEN 75 ELSE 41 END AS BIGINT) AS metadata_bytes FROM ledger"),
    )
    q["stored_bytes"] = (lambda s, d: ledger(s, d).agg(F.sum(F.octet_length("source")).alias("n_bytes"), F.count("*").alias("n"))), led("SELECT CAST(sum(strlen(source)) AS BIGINT) AS n_bytes, count(*) AS n FROM ledger")
    q["logical_candidates"] = (lambda s, d: turn_rows(s, d).select(F.countDistinct(F.when((F.col("observation_kind") == "original") & F.col("logical_turn_id").isNotNull(), F.col("logical_turn_id")).when(~((F.col("observation_kind") == "inherited") & F.col("logical_turn_id").isNotNull()), F.concat(F.lit("raw"), "id"))).alias("n"))), led("SELECT count(DISTINCT CASE WHEN seq % 3 = 0 AND k % 5 <> 4 THEN 't' || user_id || '-' || (k % 9) WHEN NOT (seq % 3 = 1 AND k % 5 <> 4) THEN 'raw' || id END) AS n FROM ledger")
    q["tool_histogram"] = (
        lambda s, d: clusters.source_breakdown(ledger(s, d).select(F.col("user_id").alias("cluster"), F.col("event_type").alias("app"))).select("cluster", F.to_json("breakdown").alias("calls")),
        led("SELECT cluster, '{' || string_agg('\"' || app || '\":' || n, ',' ORDER BY app) || '}' AS calls FROM (SELECT user_id AS cluster, event_type AS app, count(*) AS n FROM ledger GROUP BY ALL) GROUP BY cluster"),
    )
    q["ordered_distinct"] = (lambda s, d: ledger(s, d).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("seq", "event_type"))).alias("a")).select("user_id", F.array_join(F.array_distinct("a.event_type"), ",").alias("types"))), led("SELECT user_id, string_agg(event_type, ',' ORDER BY first) AS types FROM (SELECT user_id, event_type, min(seq) AS first FROM ledger GROUP BY ALL) GROUP BY user_id")
    q["newest_first"] = (lambda s, d: L.multi_get(ledger(s, d), list(dict.fromkeys(["7", "3", "7", "42", "11"]))).orderBy(F.desc("ts"), "pos").select("id", "ts")), led("SELECT id, ts FROM ledger WHERE id IN ('7', '3', '42', '11')")
    q["page_and_one"] = (lambda s, d: L.Scan(limit=51).run(ledger(s, d)).select("id", "ts")), led("SELECT id, ts FROM ledger ORDER BY ts DESC, id DESC LIMIT 51")
    q["fork_projects"] = (lambda s, d: context.logical(_storm(s)).groupBy("scope").agg(F.count("*").alias("turns"), F.sum("raw").alias("raw"))), "SELECT * FROM (VALUES ('local:workspace:/w/a', 6, 20), ('local:workspace:/w/b', 6, 18)) t(scope, turns, raw)"
    return q


def _storm(spark):
    """Turns of two projects, each with copies that forks have inherited; the counts are known."""
    n = F.col("id")
    copy, turn = F.floor(n / 12), n % 12
    at = F.date_format(F.timestamp_seconds(F.lit(1_750_000_000) + turn * 60), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    root = F.when(turn % 2 == 0, "/w/a").otherwise("/w/b")
    meta = F.to_json(F.struct(
        F.concat(F.lit("s"), copy.cast("string")).alias("session_id"), F.concat(F.lit("turn"), turn.cast("string")).alias("logical_turn_id"), at.alias("occurred_at"), root.alias("repo_root"),
        F.when(copy == 0, "original").otherwise("inherited").alias("observation_kind"),
    ))
    rows = spark.range(36).unionByName(spark.range(36, 37)).unionByName(spark.range(48, 49)).select(
        n.cast("string").alias("id"), F.lit("fs:/h/.codex/sessions/x.jsonl").alias("source"), at.alias("timestamp"), F.lit("USER: q\n\nASSISTANT: a").alias("content"), meta.alias("metadata"),
        F.timestamp_seconds(F.lit(1_750_000_000) + turn * 60).alias("ts"),
    )
    return context.observations(rows, F.lit("2025-01-01").cast("timestamp"), F.lit("2026-01-01").cast("timestamp"))

