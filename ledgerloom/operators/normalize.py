"""Normalization: ledger rows of a source family become atoms of one nested schema, as column expressions.

The metadata is parsed once a row; its members, then what is derived from them, are columns of one projection after another, so that no
expression contains another one twice.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths, text
from ..sources.ledger import has_key, json_string

ACTOR = "struct<role:string,name:string,model:string,provider:string>"
ARTIFACT = "struct<type:string,provider:string,id:string,label:string,locator:string>"
CONVERSATION = (
    "struct<provider:string,session_id:string,turn_index:bigint,logical_turn_id:string,parent_logical_turn_id:string,thread_id:string,root_thread_id:string,parent_thread_id:string,"
    "thread_kind:string,agent_path:string,agent_depth:int,initiator:string,observation_kind:string>"
)
#: Tokens that may stand for a logical turn.
LOGICAL_ID = rf"\A[^{text.SPACE}\p{{Cntrl}}]{{1,512}}\z"
META = "metadata"
#: String members of the metadata that adapters read, and those of records in it.
MEMBERS = (
    "session_id", "repo_root", "canonical_root", "project_key", "cwd", "occurred_at", "observed_at", "initiator", "model", "branch", "cli_version", "permission_mode", "sha", "origin_url",
    "author", "parent_sha", "note_id", "granola_atom_type", "title", "web_url", "created_at", "updated_at", "composer_id", "workspace_id", "logical_turn_id", "parent_logical_turn_id",
    "thread_id", "root_thread_id", "parent_thread_id", "agent_path", "thread_kind", "observation_kind",
)
INNER = ("git_state.origin_url", "git.origin_url", "git.branch", "codex.model", "codex.model_provider", "codex.cli_version", "codex.source", "codex.reasoning_effort", "codex.approval_policy", "codex.sandbox_policy_type")
NUMBERS = ("turn_index", "agent_depth", "files_changed", "additions", "deletions")


def _variant(path: str, kind: str = "variant") -> Column:
    return F.try_variant_get("_v", f"$.{path}", kind)


def _is(variant: Column, kind: str) -> Column:
    return F.schema_of_variant(variant) == kind


def prepared(rows: DataFrame) -> DataFrame:
    """Rows with their metadata's members: strings as s_<name>, numbers as they are written as n_<name>, presence of the project's fields."""
    rows = rows.withColumns({"_v": F.try_parse_json(META), "_keys": F.json_object_keys(META)})
    members = {f"s_{p.replace('.', '_')}" if "." in p else f"s_{p}": F.when(_is(_variant(p), "STRING"), _variant(p, "string")) for p in (*MEMBERS, *INNER)}
    for n in NUMBERS:
        kind = F.schema_of_variant(_variant(n))
        members[f"n_{n}"] = F.when(kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL"), _variant(n, "string"))
    members |= {f"has_{k}": F.coalesce(F.array_contains("_keys", k), F.lit(False)) for k in ("project_key", "canonical_root")}
    members["used_tool"] = F.when(_is(_variant("had_tool_use"), "BOOLEAN") & _variant("had_tool_use", "boolean"), "true")
    members["listed"] = _strings("files_referenced")
    return rows.withColumns(members)


def _strings(path: str) -> Column:
    """The strings of a JSON array, other elements left out; null if it is none."""
    only = F.filter(_variant(path, "array<variant>"), lambda v: _is(v, "STRING"))
    return F.transform(only, lambda v: F.variant_get(v, "$", "string"))


def _s(name: str) -> Column:
    return F.col(f"s_{name}")


def _lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def _actor(role, name=None, model=None, provider=None) -> Column:
    return F.struct(_lit(role).alias("role"), _lit(name).alias("name"), _lit(model).alias("model"), _lit(provider).alias("provider")).cast(ACTOR)


def artifact(kind, provider, identifier, label, locator=None) -> Column:
    parts = zip((kind, provider, identifier, label, locator), ("type", "provider", "id", "label", "locator"), strict=True)
    return F.struct(*[_lit(x).alias(n) for x, n in parts]).cast(ARTIFACT)


def with_remote(rows: DataFrame, origin: str, out: str) -> DataFrame:
    """Adds the comparable form of a remote: https for ssh forms (git@host:path), host in lower case, no ``.git`` and no trailing slashes."""
    c = F.col
    plain = lambda x: F.when(F.lower(x).endswith(".git"), F.substring(x, F.lit(1), F.length(x) - 4)).otherwise(x)
    rows = rows.withColumn("_whole", F.trim(origin))
    rows = rows.withColumns({"_after": F.substring("_whole", 5, 1 << 20), "_bare": F.rtrim(plain(c("_whole")), F.lit("/"))})
    rows = rows.withColumns({"_colon": F.instr("_after", ":"), "_scheme": F.instr("_bare", "://")})
    rows = rows.withColumns({"_path": F.regexp_replace(F.substring(c("_after"), c("_colon") + 1, F.length("_after")), "/$", ""), "_rest": F.substring(c("_bare"), c("_scheme") + 3, F.length("_bare"))})
    rows = rows.withColumns({"_path": F.rtrim(plain(c("_path")), F.lit("/")), "_slash": F.instr("_rest", "/"), "_ssh": (F.lower(F.substring("_whole", 1, 4)) == "git@") & (c("_colon") > 1) & (F.length("_path") > 0)})
    head = F.when(c("_bare").rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://"), F.when(c("_slash") > 0, c("_scheme") + 1 + c("_slash")).otherwise(F.length("_bare"))).otherwise(0)
    rows = rows.withColumns({"_head": head, "_from_ssh": F.concat(F.lit("https://"), F.lower(F.substring(c("_after"), F.lit(1), c("_colon") - 1)), F.lit("/"), "_path")})
    url = F.when(c("_ssh"), plain(c("_from_ssh"))).otherwise(F.concat(F.lower(F.substring(c("_bare"), F.lit(1), c("_head"))), F.substring(c("_bare"), c("_head") + 1, F.length("_bare"))))
    return rows.withColumn(out, url).drop("_whole", "_after", "_bare", "_colon", "_scheme", "_path", "_rest", "_slash", "_ssh", "_head", "_from_ssh")


def remote_provider(url: Column) -> Column:
    """The hosting service of a normalized remote."""
    host = F.regexp_extract(url, r"^[a-z][a-z0-9+.\-]*://(?:[^/@]*@)?([^/:]+)", 1)
    chosen = F.lit("git")
    for domain in ("bitbucket.org", "gitlab.com", "github.com"):
        chosen = F.when((host == domain) | host.endswith("." + domain), domain.split(".")[0]).otherwise(chosen)
    return chosen


def _last_segment(path: Column, pattern: str = r"/([^/]+)/?$") -> Column:
    return F.when(path.rlike(pattern), F.regexp_extract(path, pattern, 1)).otherwise(path)


def scoped(rows: DataFrame, origin: str, root: str) -> DataFrame:
    """Adds git_alias (the remote's form), scope (the artifact of the workspace where there is one, else of the repository), scope_id and
    base, the root for files."""
    canonical, local, url = _s("canonical_root"), F.col(root), F.col("git_alias")
    rows = with_remote(rows, origin, "git_alias")
    workspace = artifact("workspace", "local", canonical, _last_segment(canonical), canonical)
    remote = artifact("repo", remote_provider(url), url, _last_segment(url, r"/([^/]+)$"), local)
    own = artifact("repo", "local", F.concat(F.lit("local:"), local), _last_segment(local), local)
    scope = F.when(canonical.isNotNull(), workspace).when(local.isNotNull(), F.when(F.length(origin) > 0, remote).otherwise(own))
    rows = rows.withColumns({"scope": scope, "base": F.coalesce(canonical, local)})
    return rows.withColumn("scope_id", F.when(canonical.isNotNull(), F.concat(F.lit("workspace:"), canonical)).otherwise(F.col("scope.id")))


def with_files(rows: DataFrame, listed: str, out: str) -> DataFrame:
    """Adds file artifacts for an array of paths: by the path from ``base`` within ``scope_id``, or by their own path where they are outside
    or there is no root."""
    slashed = lambda p: F.when(p.rlike(r"[^/]/+\z"), F.lit("/")).otherwise(F.lit(""))
    rows = rows.withColumns({"_f": F.transform(listed, lambda p: F.struct(p.alias("path"), paths.dot_free(p).alias("full"), slashed(p).alias("end"))), "_root": F.rtrim(paths.dot_free(F.col("base")), F.lit("/"))})
    under = lambda f: F.when(f == F.col("_root"), F.lit("")).when(f.startswith(F.concat("_root", F.lit("/"))), F.substring(f, F.length("_root") + 2, F.length(f)))
    rows = rows.withColumn("_f", F.transform("_f", lambda x: F.struct(x["path"].alias("path"), F.concat(x["full"], x["end"]).alias("full"), F.when(F.col("scope_id").isNotNull(), under(x["full"])).alias("inside"))))

    def made(x: Column) -> Column:
        inside = x["inside"].isNotNull()
        name = F.when(inside, x["inside"]).otherwise(F.substring_index(F.rtrim(x["full"], F.lit("/")), "/", -1))
        return artifact("file", "local_fs", F.when(inside, F.concat("scope_id", F.lit("::"), x["inside"])).otherwise(F.concat(F.lit("abs:"), x["full"])), name, x["path"])

    return rows.withColumn(out, F.coalesce(F.transform("_f", made), F.array().cast(f"array<{ARTIFACT}>"))).drop("_f", "_root")


def project_ref(observed: Column) -> Column:
    """The project: an explicit key, else a canonical root, else the observed one. A field that is there but unusable gives no project."""
    prefixed = lambda root: F.when(F.length(root) > 0, F.concat(F.lit("local:workspace:"), root))
    key = F.when(F.col("has_project_key"), F.when(F.length("s_project_key") > 0, _s("project_key"))).when(F.col("has_canonical_root"), prefixed(_s("canonical_root"))).otherwise(prefixed(observed))
    return F.when(key.isNotNull(), F.struct(key.alias("key"), _s("canonical_root").alias("canonical_root"), observed.alias("observed_root")))


def conversation(provider: str, session: Column, defaults: dict | None = None) -> Column:
    """The conversation of a turn. Values outside their sets, ids that are no tokens and depths that are no whole numbers are left out; a
    root thread is its own root. ``defaults`` stand in for members that are not there."""
    given = defaults or {}
    value = lambda k: F.coalesce(_s(k), given[k]) if k in given else _s(k)
    one_of = lambda k, *names: F.when(value(k).isin(*names), value(k))
    token = lambda k: F.when(value(k).rlike(LOGICAL_ID), value(k))
    depth = F.when(F.col("n_agent_depth").rlike(r"^\d+(?:\.0+)?$"), F.col("n_agent_depth").cast("double").cast("int"))
    kind = one_of("thread_kind", "root", "subagent", "unknown")
    parts = {
        "provider": F.lit(provider), "session_id": session, "turn_index": F.col("n_turn_index"), "logical_turn_id": token("logical_turn_id"),
        "parent_logical_turn_id": token("parent_logical_turn_id"), "thread_id": value("thread_id"),
        "root_thread_id": F.coalesce(value("root_thread_id"), F.when(kind == "root", F.coalesce(value("thread_id"), session))), "parent_thread_id": value("parent_thread_id"),
        "thread_kind": kind, "agent_path": value("agent_path"), "agent_depth": depth, "initiator": one_of("initiator", "human", "agent", "system", "unknown"),
        "observation_kind": one_of("observation_kind", "original", "inherited", "unknown"),
    }
    return F.struct(*[v.alias(k) for k, v in parts.items()]).cast(CONVERSATION)


def user_actor() -> Column:
    return _actor(F.when(_s("initiator").isin("agent", "system", "unknown"), _s("initiator")).otherwise("user"))


def _ambient(**parts: Column) -> Column:
    """The parts that are not null; null if there are none."""
    pairs = F.filter(F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in parts.items()]), lambda p: p["value"].isNotNull())
    return F.when(F.size(pairs) > 0, F.map_from_entries(pairs))


SHAPE = {
    "surface": "string", "occurred_at": "string", "observed_at": "string", "actors": f"array<{ACTOR}>", "kind": "string", "verb": "string", "input": "string",
    "output": "string", "artifacts": f"array<{ARTIFACT}>", "ambient": "map<string,string>", "visible": "array<string>", "delta": "struct<artifact_id:string,kind:string,detail:string>",
    "session_id": "string", "turn_index": "bigint", "conversation": CONVERSATION, "project": "struct<key:string,canonical_root:string,observed_root:string>", "hints": "array<string>",
}


def _atom(rows: DataFrame, app: str, version: str, error: Column, **columns: Column) -> DataFrame:
    made = [columns.get(n, F.lit(None)).cast(t).alias(n) for n, t in SHAPE.items()]
    return rows.select("id", F.lit(app).alias("app"), F.col("source").alias("raw_pointer"), *made, F.sha2("content", 256).alias("raw_payload_hash"), F.lit(version).alias("extractor_version"), error.alias("error"))


#: The envelope of a commit.
COMMIT = r"\ACOMMIT [^:]+: ([^\n\r\u2028\u2029]*?)\n\n([\s\S]*?)--- DIFF ---\n([\s\S]*)\z"


def commits(rows: DataFrame) -> DataFrame:
    """Atoms of commits (sources ``git:``). Content without the envelope gives empty texts; no sha gives ``error``."""
    c = F.col
    rows = prepared(rows).withColumns({"_subject": F.regexp_extract("content", COMMIT, 1), "_body": F.regexp_replace(F.regexp_extract("content", COMMIT, 2), r"\n+\z", ""), "_root_dir": F.coalesce(_s("repo_root"), F.regexp_extract("source", r"^git:([\s\S]*)\z", 1))})
    rows = with_files(scoped(rows, "s_origin_url", "_root_dir"), "listed", "files").withColumn("_own", F.concat("scope_id", F.lit("::"), "s_sha"))
    branch = F.when(_s("branch").isNotNull(), artifact("branch", "git", F.concat("scope_id", F.lit("::"), "s_branch"), _s("branch")))
    artifacts = F.array_compact(F.array(c("scope"), artifact("commit", "git", c("_own"), F.substring("s_sha", 1, 7), _s("sha")), branch))
    detail = F.concat_ws(", ", F.concat("n_files_changed", F.lit(" files changed")), F.concat(F.lit("+"), "n_additions"), F.concat(F.lit("-"), "n_deletions"))
    return _atom(
        rows, "git", "git@2", F.when(_s("sha").isNull(), "git: missing metadata.sha"), surface=F.lit("commit"), occurred_at=c("timestamp"), kind=F.lit("commit"), verb=F.lit("committed"),
        actors=F.array(_actor("user", F.coalesce("s_author", F.lit("")))), input=F.when(c("_body") != "", F.concat("_subject", F.lit("\n\n"), "_body")).otherwise(c("_subject")), output=F.regexp_extract("content", COMMIT, 3),
        artifacts=F.concat(artifacts, "files"), project=project_ref(c("_root_dir")),
        ambient=_ambient(parent_sha=_s("parent_sha"), files_changed=c("n_files_changed"), additions=c("n_additions"), deletions=c("n_deletions"), git_alias=c("git_alias")),
        delta=F.struct(c("_own").alias("artifact_id"), F.lit("commit").alias("kind"), F.when(detail != "", detail).alias("detail")),
    )


def notes(rows: DataFrame) -> DataFrame:
    """Atoms of meeting notes (source ``api:granola``); no note id gives ``error``."""
    rows = prepared(rows)
    note, kind = _s("note_id"), F.coalesce("s_granola_atom_type", F.lit("note"))
    name = lambda v: F.when(_is(v, "STRING"), F.variant_get(v, "$", "string")).otherwise(F.when(_is(F.try_variant_get(v, "$.name", "variant"), "STRING"), F.try_variant_get(v, "$.name", "string")))
    people = F.filter(F.transform(_variant("attendees", "array<variant>"), name), lambda n: F.length(n) > 0)
    return _atom(
        rows, "granola", "granola@1", F.when(note.isNull(), "granola: missing metadata.note_id"), surface=kind, occurred_at=F.col("timestamp"), kind=F.lit("meeting_note"),
        verb=F.when(kind == "transcript", "transcribed").otherwise("summarized"), output=F.col("content"),
        actors=F.coalesce(F.transform(people, lambda n: _actor("participant", n)), F.array().cast(f"array<{ACTOR}>")),
        artifacts=F.array(artifact("meeting_note", "granola", F.concat(F.lit("granola:"), note), F.coalesce("s_title", F.lit("Untitled Granola note")), _s("web_url"))),
        ambient=_ambient(created_at=_s("created_at"), updated_at=_s("updated_at")),
    )


def _turns(rows: DataFrame) -> DataFrame:
    """Rows with the envelope of a pair, and its texts."""
    rows = prepared(rows.where(F.col("content").rlike(text.PAIR)))
    return rows.withColumns({"_user": F.regexp_extract("content", text.PAIR, 1), "_assistant": F.regexp_extract("content", text.PAIR, 2)})


def _talk(provider: str, session: Column) -> Column:
    return artifact("conversation", provider, F.concat(F.lit(f"{provider}:"), session), session)


def claude_turns(rows: DataFrame) -> DataFrame:
    """Atoms of turn pairs of Claude session files; rows without the envelope go, no session id gives ``error``."""
    c, session = F.col, _s("session_id")
    rows = with_files(scoped(_turns(rows), "s_git_state_origin_url", "s_repo_root"), "listed", "files")
    return _atom(
        rows, "claude_code", "claude-code@1", F.when(session.isNull(), "claude-code: missing metadata.session_id"), surface=F.lit("jsonl"),
        occurred_at=F.coalesce("s_occurred_at", "timestamp"), observed_at=_s("observed_at"), kind=F.lit("message"), input=c("_user"), output=c("_assistant"),
        actors=F.array(user_actor(), _actor("assistant", model=_s("model"), provider="anthropic")), conversation=conversation("claude_code", session),
        artifacts=F.concat(F.array_compact(F.array(_talk("claude_code", session), c("scope"))), "files"), session_id=session, turn_index=c("n_turn_index"), project=project_ref(_s("repo_root")),
        ambient=_ambient(had_tool_use=c("used_tool"), branch=_s("branch"), cli_version=_s("cli_version"), permission_mode=_s("permission_mode"), git_alias=c("git_alias")),
        hints=text.open_loop_hints(c("_user"), c("_assistant")),
    )


def codex_turns(rows: DataFrame) -> DataFrame:
    """Atoms of turn pairs of Codex session files; rows without the envelope go, no session id gives ``error``."""
    c, session = F.col, _s("session_id")
    rows = _turns(rows).withColumn("_root_dir", F.coalesce("s_repo_root", "s_cwd"))
    rows = with_files(scoped(rows, "s_git_origin_url", "_root_dir"), "listed", "files")
    return _atom(
        rows, "codex", "codex@2", F.when(session.isNull(), "codex: missing metadata.session_id"), surface=F.lit("jsonl"), kind=F.lit("message"), input=c("_user"), output=c("_assistant"),
        occurred_at=F.coalesce("s_occurred_at", "timestamp"), observed_at=_s("observed_at"), conversation=conversation("codex", session),
        actors=F.array(user_actor(), _actor("assistant", model=_s("codex_model"), provider=F.coalesce("s_codex_model_provider", F.lit("openai")))),
        artifacts=F.concat(F.array_compact(F.array(_talk("codex", session), c("scope"))), "files"), session_id=session, turn_index=c("n_turn_index"), project=project_ref(c("_root_dir")),
        ambient=_ambient(
            had_tool_use=c("used_tool"), cli_version=_s("codex_cli_version"), codex_source=_s("codex_source"), reasoning_effort=_s("codex_reasoning_effort"),
            approval_policy=_s("codex_approval_policy"), sandbox_policy_type=_s("codex_sandbox_policy_type"), branch=_s("git_branch"), git_alias=c("git_alias"),
        ),
        hints=text.open_loop_hints(c("_user"), c("_assistant")),
    )


def cursor_turns(rows: DataFrame) -> DataFrame:
    """Atoms of turn pairs of the composer's database; rows without the envelope go, no composer id gives ``error``.

    The composer stands for thread and root where these are not told. Files have no root; attached ones are only visible.
    """
    c, none = F.col, F.array().cast("array<string>")
    path = lambda v: F.when(_is(F.try_variant_get(v, "$.path", "variant"), "STRING"), F.try_variant_get(v, "$.path", "string"))
    referenced = F.array_compact(F.transform(_variant("context.referenced_files", "array<variant>"), path))
    rows = _turns(rows).withColumns({
        "_composer": F.coalesce("s_composer_id", "s_session_id"), "_named": F.concat(F.coalesce(referenced, none), F.coalesce(_strings("context.deleted_files"), none)),
        "_visible": _strings("context.attached_files"), "scope_id": F.lit(None).cast("string"), "base": F.lit(None).cast("string"),
    })
    rows = with_files(rows, "_named", "files")
    return _atom(
        rows, "cursor", "cursor@2", F.when(c("_composer").isNull(), "cursor: missing metadata.composer_id"), surface=F.lit("composer"), occurred_at=c("timestamp"),
        kind=F.lit("message"), input=c("_user"), output=c("_assistant"), actors=F.array(user_actor(), _actor("assistant", provider="cursor")),
        artifacts=F.concat(F.array(_talk("cursor", c("_composer"))), "files"), session_id=c("_composer"), turn_index=c("n_turn_index"),
        conversation=conversation("cursor", c("_composer"), {"thread_id": c("_composer"), "root_thread_id": c("_composer"), "thread_kind": F.lit("root")}),
        visible=F.when(F.size("_visible") > 0, c("_visible")), ambient=_ambient(workspace_id=_s("workspace_id")), project=project_ref(_s("repo_root")),
        hints=text.open_loop_hints(c("_user"), c("_assistant")),
    )


@dataclass(frozen=True)
class SourceAdapter:
    """How the rows of a family become atoms: the sources that it takes (a pattern), in what version, by what projection."""

    name: str
    version: str
    sources: str
    project: Callable[[DataFrame], DataFrame]


#: The sources that each adapter takes. The first that takes a source has it.
ADAPTERS = (
    SourceAdapter("claude_code", "claude-code@1", r"^fs:.*[\\/]\.claude[\\/]projects[\\/].*\.jsonl\z", claude_turns),
    SourceAdapter("codex", "codex@2", r"^fs:.*[\\/]\.codex[\\/]sessions[\\/].*\.jsonl\z", codex_turns),
    SourceAdapter("cursor", "cursor@2", r"^fs:.*/Cursor/User/globalStorage/state\.vscdb\z", cursor_turns),
    SourceAdapter("git", "git@2", r"^git:", commits),
    SourceAdapter("granola", "granola@1", r"^api:granola\z", notes),
)


def checked(adapters: tuple[SourceAdapter, ...]) -> tuple[SourceAdapter, ...]:
    """The adapters, if their names are given and unique."""
    names = [a.name for a in adapters]
    if any(not n for n in names) or len(set(names)) < len(names):
        raise ValueError("adapters need names of their own")
    return adapters


def dispatch(source: Column, adapters: tuple[SourceAdapter, ...] = ADAPTERS) -> Column:
    """The name of the first adapter that takes a source, or null."""
    out = F.lit(None).cast("string")
    for a in reversed(checked(adapters)):
        out = F.when(source.rlike(a.sources), a.name).otherwise(out)
    return out


def normalized(rows: DataFrame, adapters: tuple[SourceAdapter, ...] = ADAPTERS) -> DataFrame:
    """Atoms of a ledger (id, source, timestamp text, content, metadata JSON) by source; rows of other sources go.

    The parts are disjoint; over a written ledger each reads the files of its own family only.
    """
    by_app = "app" in rows.columns
    tagged = rows.select("id", "source", "timestamp", "content", META, *(["app"] if by_app else []), dispatch(F.col("source"), adapters).alias("_adapter"))
    own = lambda a: tagged.where(F.col("app") == a.name) if by_app and a in ADAPTERS else tagged
    return reduce(DataFrame.unionByName, [a.project(own(a).where(F.col("_adapter") == a.name).drop("_adapter", "app")) for a in adapters])


def rebased(rows: DataFrame, project_key: str) -> DataFrame:
    """Rows with a ``repo_root`` but neither a project key nor a canonical root, put into a local project: what a query of that project has
    admitted by its root is one project with the rest. Other rows stay as they are."""
    prefix = "local:workspace:"
    root = project_key.removeprefix(prefix)
    if not project_key.startswith(prefix) or not root:
        return rows
    observed = json_string(F.col(META), "repo_root")
    old = observed.isNotNull() & ~has_key(F.col(META), "project_key") & ~has_key(F.col(META), "canonical_root")
    own = F.to_json(F.struct(F.lit(project_key).alias("project_key"), F.lit(root).alias("canonical_root"), observed.alias("observed_root")))
    body = F.rtrim(F.col(META))
    return rows.withColumn(META, F.when(old, F.concat(F.substring(body, F.lit(1), F.length(body) - 1), F.lit(","), F.substring(own, F.lit(2), F.length(own)))).otherwise(F.col(META)))


def with_instants(atoms: DataFrame) -> DataFrame:
    """Atoms without errors with ts (of occurrence; those without one go) and observed_ts."""
    out = atoms.where("error is null").withColumns({"ts": text.query_instant(F.col("occurred_at")), "observed_ts": text.query_instant(F.coalesce("observed_at", "occurred_at"))})
    return out.where("ts is not null")


def errors(atoms: DataFrame) -> DataFrame:
    """Rows that could not be normalized, counted by message."""
    return atoms.where("error is not null").groupBy("error").agg(F.count("*").alias("n"))


def error_warnings(counts: list[tuple[str, int]]) -> list[str]:
    return [f"{message} ({n}× events skipped)" if n > 1 else f"{message} (1 event skipped)" for message, n in counts]
