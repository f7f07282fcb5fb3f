"""Queries of the normalization adapters: ledger rows are made from documents (commits), pages (notes) and conversations (turns)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import normalize

AT = "2024-01-05T00:00:00.000Z"


def _row(identifier, source, content, metadata) -> list:
    return [identifier.alias("id"), source.alias("source"), F.lit(AT).alias("timestamp"), content.alias("content"), F.to_json(metadata).alias("metadata")]


def commit_rows(spark, sf_dir) -> DataFrame:
    """A commit a document: a quarter with an ssh remote, a quarter with a canonical root, a tenth without a sha."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "lang", F.octet_length("text").alias("n"))
    n, ident = F.col("doc_id"), F.col("doc_id").cast("string")
    sha, root = F.sha2(ident, 256), F.concat(F.lit("/work/r"), (n % 6).cast("string"))
    meta = F.struct(
        F.when(n % 10 != 0, sha).alias("sha"), F.concat(F.lit("b"), (n % 3).cast("string")).alias("branch"), F.col("n").alias("additions"),
        F.when(n % 4 == 1, "git@GitHub.com:Org/r1.git").alias("origin_url"), F.when(n % 4 == 2, "/work/c1").alias("canonical_root"),
        F.array(F.concat(root, F.lit("/src/../lib/f"), (n % 7).cast("string"), F.lit(".py")), F.lit("/else/x.py")).alias("files_referenced"),
    )
    content = F.concat(F.lit("COMMIT "), sha, F.lit(": change in "), F.coalesce("lang", F.lit("?")), F.lit("\n\n"), "text", F.lit("\n\n--- DIFF ---\n+"), ident)
    return d.select(*_row(ident, F.concat(F.lit("git:"), root), content, meta))


def note_rows(spark, sf_dir) -> DataFrame:
    """A meeting note a page; every second is a transcript, every seventh has no id."""
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    n, ident = F.col("page_id"), F.col("page_id").cast("string")
    meta = F.struct(
        F.when(n % 7 != 0, F.concat(F.lit("n"), ident)).alias("note_id"), F.when(n % 2 == 0, "transcript").alias("granola_atom_type"), F.col("url").alias("web_url"),
        F.when(n % 3 == 0, "Plan").alias("title"), F.array(F.struct(F.concat(F.lit("Ann"), ident).alias("name")), F.struct(F.lit("").alias("name")), F.struct(F.lit("Bo").alias("name"))).alias("attendees"),
    )
    return p.select(*_row(ident, F.lit("api:granola"), F.coalesce("html", F.lit("")), meta))


def turn_rows(pairs: DataFrame) -> DataFrame:
    """A turn a pair of user and assistant messages; every tenth conversation has no session id."""
    n = F.col("conv_id")
    meta = F.struct(
        F.when(n % 10 != 0, F.concat(F.lit("s"), n.cast("string"))).alias("session_id"), F.col("turn").alias("turn_index"), F.when(n % 3 == 0, "agent").alias("initiator"),
        (F.col("turn") % 4 == 1).alias("had_tool_use"), F.concat(F.lit("/work/r"), (n % 6).cast("string")).alias("repo_root"), F.when(n % 5 == 0, "").alias("project_key"),
    )
    return pairs.select(*_row(F.concat_ws("-", n.cast("string"), F.col("turn").cast("string")), F.lit("fs:/home/u/.claude/projects/p/x.jsonl"), F.col("content"), meta))


def _flat(atoms: DataFrame) -> DataFrame:
    """Atoms with their nested columns joined to texts."""
    return atoms.select(
        "id", "app", "surface", "verb", "input", "output", "turn_index", "error", F.array_join("artifacts.id", " | ").alias("artifact_ids"), F.array_join("artifacts.label", " | ").alias("labels"),
        F.concat_ws(",", F.transform("actors", lambda a: F.concat_ws("/", a["role"], a["name"], a["provider"]))).alias("actors"),
        F.col("project.key").alias("project_key"), F.col("delta.detail").alias("detail"), F.concat_ws(",", F.transform(F.map_entries("ambient"), lambda e: F.concat_ws("=", e["key"], e["value"]))).alias("ambient"), "raw_payload_hash",
    )


COMMITS_SQL = """d AS (SELECT CAST(doc_id AS VARCHAR) AS id, doc_id, coalesce(text, '') AS text, coalesce(lang, '?') AS lang, strlen(text) AS n, sha256(CAST(doc_id AS VARCHAR)) AS sha, '/work/r' || (doc_id % 6) AS root FROM documents),
 k AS (SELECT *, CASE doc_id % 4 WHEN 1 THEN 'https://github.com/Org/r1' WHEN 2 THEN '/work/c1' ELSE 'local:' || root END AS scope, CASE WHEN doc_id % 10 <> 0 THEN sha END AS own, rtrim(text, chr(10)) AS body, 'change in ' || lang AS subject,
   CASE WHEN doc_id % 4 = 2 THEN 'workspace:' ELSE '' END || CASE doc_id % 4 WHEN 1 THEN 'https://github.com/Org/r1' WHEN 2 THEN '/work/c1' ELSE 'local:' || root END AS sid, 'lib/f' || (doc_id % 7) || '.py' AS rel FROM d),
 commits AS (SELECT id, 'git' AS app, 'commit' AS surface, 'committed' AS verb, subject || CASE WHEN body <> '' THEN chr(10) || chr(10) || body ELSE '' END AS input, '+' || id AS output, CAST(NULL AS BIGINT) AS turn_index,
   CASE WHEN own IS NULL THEN 'git: missing metadata.sha' END AS error,
   concat_ws(' | ', scope, sid || '::' || own, sid || '::b' || (doc_id % 3), CASE WHEN doc_id % 4 = 2 THEN 'abs:' || root || '/' || rel ELSE sid || '::' || rel END, 'abs:/else/x.py') AS artifact_ids,
   concat_ws(' | ', CASE doc_id % 4 WHEN 1 THEN 'r1' WHEN 2 THEN 'c1' ELSE 'r' || (doc_id % 6) END, substr(own, 1, 7), 'b' || (doc_id % 3), CASE WHEN doc_id % 4 = 2 THEN 'f' || (doc_id % 7) || '.py' ELSE rel END, 'x.py') AS labels,
   'user/' AS actors, 'local:workspace:' || CASE WHEN doc_id % 4 = 2 THEN '/work/c1' ELSE root END AS project_key, '+' || n AS detail,
   concat_ws(',', 'additions=' || n, CASE WHEN doc_id % 4 = 1 THEN 'git_alias=https://github.com/Org/r1' END) AS ambient,
   sha256('COMMIT ' || sha || ': ' || subject || chr(10) || chr(10) || text || chr(10) || chr(10) || '--- DIFF ---' || chr(10) || '+' || id) AS raw_payload_hash FROM k)"""
NOTES_SQL = """notes AS (SELECT CAST(page_id AS VARCHAR) AS id, 'granola' AS app, CASE WHEN page_id % 2 = 0 THEN 'transcript' ELSE 'note' END AS surface, CASE WHEN page_id % 2 = 0 THEN 'transcribed' ELSE 'summarized' END AS verb,
   CAST(NULL AS VARCHAR) AS input, coalesce(html, '') AS output, CAST(NULL AS BIGINT) AS turn_index, CASE WHEN page_id % 7 = 0 THEN 'granola: missing metadata.note_id' END AS error,
   CASE WHEN page_id % 7 <> 0 THEN 'granola:n' || page_id ELSE '' END AS artifact_ids, CASE WHEN page_id % 3 = 0 THEN 'Plan' ELSE 'Untitled Granola note' END AS labels, 'participant/Ann' || page_id || ',participant/Bo' AS actors,
   CAST(NULL AS VARCHAR) AS project_key, CAST(NULL AS VARCHAR) AS detail, '' AS ambient, sha256(coalesce(html, '')) AS raw_payload_hash FROM pages)"""


def turns_sql(pairs_sql: str) -> str:
    return pairs_sql + """, turns AS (SELECT conv_id || '-' || turn AS id, 'claude_code' AS app, 'jsonl' AS surface, CAST(NULL AS VARCHAR) AS verb, u AS input, a AS output, CAST(turn AS BIGINT) AS turn_index,
   CASE WHEN conv_id % 10 = 0 THEN 'claude-code: missing metadata.session_id' END AS error, concat_ws(' | ', CASE WHEN conv_id % 10 <> 0 THEN 'claude_code:s' || conv_id END, 'local:/work/r' || (conv_id % 6)) AS artifact_ids,
   concat_ws(' | ', CASE WHEN conv_id % 10 <> 0 THEN 's' || conv_id END, 'r' || (conv_id % 6)) AS labels, CASE WHEN conv_id % 3 = 0 THEN 'agent' ELSE 'user' END || ',assistant/anthropic' AS actors,
   CASE WHEN conv_id % 5 <> 0 THEN 'local:workspace:/work/r' || (conv_id % 6) END AS project_key, CAST(NULL AS VARCHAR) AS detail, CASE WHEN turn % 4 = 1 THEN 'had_tool_use=true' ELSE '' END AS ambient,
   sha256('USER: ' || u || chr(10) || chr(10) || 'ASSISTANT: ' || a) AS raw_payload_hash FROM pairs)"""


def catalogue(pairs, pairs_sql: str) -> dict:
    """name: (query, SQL). ``pairs`` reads the turn pairs of conversations, as ``pairs_sql`` does."""
    turns = turns_sql(pairs_sql)
    rows = lambda s, d: commit_rows(s, d).unionByName(note_rows(s, d)).unionByName(turn_rows(pairs(s, d)))
    parts = "SELECT * FROM commits UNION ALL SELECT * FROM notes UNION ALL SELECT * FROM turns"
    whole = f"WITH {COMMITS_SQL}, {NOTES_SQL}, {turns}"
    return {
        "normalize_commits": ((lambda s, d: _flat(normalize.commits(commit_rows(s, d)))), f"WITH {COMMITS_SQL} SELECT * FROM commits"),
        "normalize_notes": ((lambda s, d: _flat(normalize.notes(note_rows(s, d)))), f"WITH {NOTES_SQL} SELECT * FROM notes"),
        "normalize_turns": ((lambda s, d: _flat(normalize.claude_turns(turn_rows(pairs(s, d))))), f"WITH {turns} SELECT * FROM turns"),
        "normalize_ledger": ((lambda s, d: _flat(normalize.normalized(rows(s, d)))), f"{whole} {parts}"),
        "normalization_errors": ((lambda s, d: normalize.errors(normalize.normalized(rows(s, d)))), f"{whole} SELECT error, count(*) AS n FROM ({parts}) WHERE error IS NOT NULL GROUP BY error"),
    }
