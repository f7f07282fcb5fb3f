"""The query surface: search, clusters, groups, hydration, newest sources and new turns over one ledger.

Every tool is a plan over the ledger with a bounded answer: what comes to the driver is a page of rows, the retained clusters (500 atoms at
most) or a few counts. Scans are not bounded; answers are, in rows and in bytes, and say so in coded warnings.
"""

from __future__ import annotations

import json
import posixpath
import re
import time as clock
from collections.abc import Callable
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import cursors, wire
from .functions import text
from .messages import told
from .operators import clusters, context, groups, normalize
from .sources import ledger as L
from .sources.workspace import materialized_rows

#: Limits of answers.
SEARCH_DEFAULT, SEARCH_MOST, CLUSTER_DEFAULT, CLUSTER_MOST, IDS_MOST, SOURCES_MOST, TURNS_MOST, WAIT_DEFAULT, WAIT_MOST = 10, 50, 20, 500, 50, 8, 20, 30, 60
LOOKBACK_HOURS, EXPANDED_HOURS, ID_CAPS, RESERVE = 4, 24, (200, 50, 25, 12, 6, 3, 1), 1024
#: Sources of derived signals and of the manifests of the runs that made them.
SIGNALS, MANIFESTS = "derived:granola-signals", "derived:granola-signals-index"
ISO = re.compile(r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}")
FORM = "%Y-%m-%dT%H:%M:%S.%f"


def instant(value: str) -> datetime:
    """The instant of a bound; without an offset it is in UTC, the zone of the session."""
    at = datetime.fromisoformat(value)
    return at.replace(tzinfo=UTC) if at.tzinfo is None else at.astimezone(UTC)


def iso(at: datetime) -> str:
    return at.strftime(FORM)[:23] + "Z"


def has_tz(value: str) -> bool:
    return re.search(r"(?:Z|[+-]\d{2}(?::?\d{2})?)\Z", value) is not None


def clamp(value: int | None, default: int, most: int) -> int:
    return default if value is None else min(max(1, int(value // 1)), most)


def from_events(rows: DataFrame) -> DataFrame:
    """A ledger of rows (id, source, timestamp, content, metadata): with instants, canonical timestamps, numbers of append and the columns
    that scans filter on. Rows whose timestamp cannot be read go."""
    at = rows.withColumn("ts", text.captured_instant(F.col("timestamp"))).where("ts is not null").withColumn("timestamp", text.iso_millis(F.col("ts")))
    if "seq" not in rows.columns:
        at = at.withColumn("seq", F.monotonically_increasing_id())
    return L.ingested(at)


def current_runs(ledger: DataFrame) -> DataFrame:
    """note_id, extraction_run_id, signal_ids of the current manifest of each note: the latest (by completion, then run) that none supersedes.
    Manifests without all of their members do not count."""
    body = F.try_parse_json("metadata")
    rows = ledger.where(F.col("source") == MANIFESTS).withColumn("_v", body)
    member = lambda k: F.when(F.schema_of_variant(F.try_variant_get("_v", f"$.{k}", "variant")) == "STRING", F.try_variant_get("_v", f"$.{k}", "string"))
    needed = ("note_id", "extractor_version", "extraction_run_id", "completed_at")
    rows = rows.select(*[member(k).alias(k) for k in (*needed, "supersedes")], F.try_variant_get("_v", "$.signal_atom_ids", "array<variant>").alias("_ids"))
    whole = F.forall("_ids", lambda v: F.schema_of_variant(v) == "STRING")
    rows = rows.where(whole).select("*", F.transform("_ids", lambda v: F.variant_get(v, "$", "string")).alias("signal_ids")).drop("_ids")
    for k in needed:
        rows = rows.where(F.length(k) > 0)
    stale = rows.where("supersedes is not null").select(F.col("supersedes").alias("extraction_run_id")).distinct()
    live = rows.join(stale, "extraction_run_id", "left_anti")
    newest = live.groupBy("note_id").agg(F.max_by(F.struct("extraction_run_id", "signal_ids"), F.struct("completed_at", "extraction_run_id")).alias("m"))
    return newest.select("note_id", "m.*")


def without_stale_signals(rows: DataFrame, ledger: DataFrame) -> DataFrame:
    """``rows`` without the derived signals that no current run names."""
    named = current_runs(ledger).select(F.explode("signal_ids").alias("id")).distinct()
    derived = rows.where(F.col("source") == SIGNALS).join(named, "id", "left_semi").select(*rows.columns)
    return rows.where(~F.col("source").eqNullSafe(SIGNALS)).unionByName(derived)


def wants_signals(source: str | None, prefix: str | None, metadata: dict) -> bool:
    """Whether a search may give derived signals, so that stale ones have to go."""
    if source == SIGNALS or prefix is not None and (SIGNALS.startswith(prefix) or prefix.startswith(SIGNALS)):
        return True
    named = metadata.get("source")
    listed = named if isinstance(named, (list, tuple)) else [named]
    return SIGNALS in listed or "signal_type" in metadata or "canonical_subject" in metadata


@dataclass(frozen=True)
class Project:
    path: str
    key: str
    roots: tuple[str, ...]


class ContextTools:
    """Tools over a ledger (see ``from_events``).

    ``home`` is where the apps keep their files; ``resolve`` gives the canonical root of an existing path (by default the path itself);
    ``now`` and ``sleep`` are the clock.
    """

    def __init__(self, ledger: DataFrame, home: str = "/home/user", resolve: Callable[[str], str] = lambda p: p, now: Callable[[], datetime] = lambda: datetime.now(UTC), sleep: Callable[[float], None] = clock.sleep):
        self.ledger, self.home, self.resolve, self.now, self.sleep = ledger, home.rstrip("/"), resolve, now, sleep
        self.visible = ledger.where(~F.coalesce("m_surface", F.lit("")).isin("fs"))

    # Arguments -------------------------------------------------------------------------------------------------------------------------
    def prefixes(self) -> dict[str, str]:
        """The sources of each app, by their beginning."""
        return {
            "cursor": f"fs:{self.home}/Library/Application Support/Cursor/", "claude_code": f"fs:{self.home}/.claude/projects/", "codex": f"fs:{self.home}/.codex/sessions/",
            "git": "git:", "granola": "api:granola",
        }

    def project(self, tool: str, repo_path: str | None) -> Project | None:
        """The project of a path: its key, and up to three roots by which rows from before keys are told."""
        if repo_path is None:
            return None
        if not repo_path.startswith("/"):
            raise ValueError(f"{tool}: repo_path must be absolute")
        path = posixpath.normpath(repo_path)
        root = self.resolve(path)
        key = f"local:workspace:{root}"
        return Project(path, key, L.project_roots(key, tuple(dict.fromkeys([root, path]))))

    def at(self, value: str | datetime) -> Column:
        """A literal of the ledger's kind of time."""
        kind = dict(self.ledger.dtypes)["ts"]
        return F.lit(iso(instant(value) if isinstance(value, str) else value)[:-1]).cast("timestamp_ntz" if kind == "timestamp_ntz" else "timestamp")

    @staticmethod
    def row(r) -> dict:
        meta = json.loads(r["metadata"]) if r["metadata"] is not None else None
        return {"id": r["id"], "source": r["source"], "timestamp": r["timestamp"], "content": r["content"], "metadata": meta if isinstance(meta, dict) else None}

    # Search ----------------------------------------------------------------------------------------------------------------------------
    def search_memories(self, query=None, source_app=None, source_prefix=None, source=None, since=None, until=None, cursor=None, limit=None, repo_path=None, metadata_match=None) -> dict:
        """The newest rows that match all that is given, and a cursor to older ones. Of several source selectors the narrowest counts."""
        n, match, project = clamp(limit, SEARCH_DEFAULT, SEARCH_MOST), dict(metadata_match or {}), self.project("search_memories", repo_path)
        prefix = family = None
        if source is None and source_prefix is not None:
            prefix = source_prefix
        elif source is None and source_app is not None:
            prefix, family = self.prefixes()[source_app], source_app
        if project is not None and "repo_root" in match:
            roots = match["repo_root"] if isinstance(match["repo_root"], (list, tuple)) else [match["repo_root"]]
            if project.path not in roots:
                raise ValueError("search_memories: metadata_match.repo_root conflicts with repo_path; pass one or the other")
        asked = any(s is not None and s.startswith("coord:") for s in (source, prefix))
        before = None
        if cursor is not None:
            timestamp, identifier = cursors.read_page_cursor(cursor)
            before = (self.at(timestamp), identifier)
        scan = L.Scan(
            source=source, source_prefixes=(prefix,) if prefix is not None else (), family=family, since=None if since is None else self.at(since), until=None if until is None else self.at(until),
            before=before, metadata=match, metadata_keys=L.SEARCH_KEYS, exclude_surfaces=("fs",) if asked else ("fs", "coord"), text=query,
            project=(project.key, project.roots) if project else None, limit=n + 1,
        )
        rows = self.ledger
        if wants_signals(source, prefix, match):
            rows = without_stale_signals(rows, self.ledger)
        found = [self.row(r) for r in scan.run(rows).select("id", "source", "timestamp", "content", "metadata").collect()]
        after = lambda r: cursors.page_cursor(r["timestamp"], r["id"])
        kept, following = found[:n], after(found[n - 1]) if len(found) > n else None
        warnings = self._selector_warnings(source, source_prefix, source_app) + ([told("TZ")] if any(b is not None and not has_tz(b) for b in (since, until)) else [])
        echo = {"query": query, "source_app": source_app, "source_prefix": source_prefix, "source": source, "since": since, "until": until, "cursor": cursor, "limit": n, "repo_path": project.path if project else None, "metadata_match": metadata_match}
        if wire.size(echo) > wire.ECHO_BYTES:
            echo = self._short_echo(echo)
            warnings.append(told("SEARCH_QUERY_ECHO_CAP", cap=wire.ECHO_BYTES))
        views = [wire.match_view(r) for r in kept]

        def answer(matches: list[dict], to: str | None, more: list[str]) -> dict:
            cap = [told("SEARCH_METADATA_CAP")]
            return {"matches": matches, "total_returned": len(matches), "limit_applied": n, "next_cursor": to, "query_echo": echo, "warnings": warnings + cap * any("metadata_keys_omitted" in m for m in matches) + more}

        out = answer(views, following, [])
        for k in range(len(kept), 0, -1):
            if wire.size(out) <= wire.ANSWER_BYTES:
                return out
            out = answer(views[:k], after(kept[k - 1]), [told("SEARCH_RESPONSE_CAP", n=k, all=len(views))])
        if wire.size(out) > wire.ANSWER_BYTES and kept:
            out = answer([wire.stub_view(kept[0])], after(kept[0]), [told("SEARCH_RESPONSE_STUB")])
        return out

    @staticmethod
    def _selector_warnings(source, prefix, app) -> list[str]:
        given = [name for name, v in (("source", source), ("source_prefix", prefix), ("source_app", app)) if v is not None]
        if len(given) < 2:
            return []
        return [told("SOURCE_SELECTOR_PRECEDENCE", applied=given[0], ignored=", ".join(given[1:]))]

    @staticmethod
    def _short_echo(echo: dict) -> dict:
        clip = lambda v, n: v if v is None else wire.clip_json(v, n)
        out = {k: clip(v, 384) if k not in ("limit", "source_app", "metadata_match") else v for k, v in echo.items()}
        if echo["metadata_match"] is not None:
            out["metadata_match"] = {}
            for k in sorted(echo["metadata_match"]):
                v = echo["metadata_match"][k]
                own = [clip(x, 128) for x in v[:8]] if isinstance(v, (list, tuple)) else clip(v, 384)
                longer = out | {"metadata_match": out["metadata_match"] | {k: own}}
                if wire.size(longer) > wire.ECHO_BYTES:
                    break
                out = longer
        return out

    # Clusters --------------------------------------------------------------------------------------------------------------------------
    def recent_work_context(self, since=None, until=None, artifact_hint=None, limit=None, window_hours=None, format="minimal", repo_path=None) -> dict:
        """Ranked clusters of the turns that occurred in a window, and the turns. Without bounds the last four hours, or, if these show
        nothing but the caller's own work of the last minutes, the last day."""
        n, now, project = clamp(limit, CLUSTER_DEFAULT, CLUSTER_MOST), self.now(), self.project("get_recent_work_context", repo_path)
        gap = LOOKBACK_HOURS if window_hours is None else window_hours
        end = until if until is not None else iso(now)
        begin = since if since is not None else iso(instant(end) - timedelta(hours=LOOKBACK_HOURS))
        out = self._pass(begin, end, n, gap, format, artifact_hint, project)
        if since is None and until is None:
            own = [self._own_recent(c, out["atoms"], now) for c in out["clusters"]]
            if all(own):
                trigger = "single-source-recent" if own else "empty"
                out = self._pass(iso(instant(end) - timedelta(hours=EXPANDED_HOURS)), end, n, gap, format, artifact_hint, project, now if own else None)
                out["warnings"].append(told("AUTO_EXPAND", trigger=trigger, why=told("ONLY_OWN_WORK" if own else "NOTHING"), hours=EXPANDED_HOURS))
        if any(b is not None and not has_tz(b) for b in (since, until)):
            out["warnings"].append(told("TZ"))
        if format == "minimal":
            out["atoms"] = {k: wire.minimal_atom(a) for k, a in out["atoms"].items()}
        return out

    @staticmethod
    def _own_recent(cluster: dict, atoms: dict, now: datetime) -> bool:
        latest = max(instant(atoms[i]["time"]["occurred_at"]) for i in cluster["atom_ids"])
        return len(cluster["source_breakdown"]) == 1 and (now - latest) <= timedelta(microseconds=clusters.OWN_WORK_US)

    def _pass(self, since, until, limit, gap, format, hint, project, own_now: datetime | None = None) -> dict:
        spark, low, high = self.ledger.sparkSession, self.at(since), self.at(until)
        rows = self.visible
        if project is not None:
            rows = rows.where(L.project_matches(project.key, project.roots))
        seen = materialized_rows(context.observations(rows, low, high, project.key if project else None), "observations")
        hint_key = ":".join(hint[k] for k in ("provider", "type", "id")) if hint else None
        members, links = context.joined(materialized_rows(context.logical(seen), "turns"), gap)
        members = materialized_rows(members, "members")
        window = {r.app: r.n for r in members.groupBy("app").agg(F.count("*").alias("n")).collect()}
        n_window = sum(window.values())
        if hint_key is None and n_window <= limit:
            total, in_clusters, kept = None, n_window, members
        else:
            made = context.derived(members, high, hint_key)
            signals = made.signals.where("hint") if hint_key else made.signals
            total, in_clusters = signals.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
            best = signals.orderBy(*clusters.best_first(signals, "cluster_id")).limit(limit).select("cluster", "size").collect()
            # The atoms of the best clusters, up to the limit; of the last of these the newest.
            room, taken = limit, []
            for r in best:
                taken.append((r.cluster, min(r["size"], room)))
                room -= taken[-1][1]
                if not room:
                    break
            chosen = spark.createDataFrame(taken, "cluster string, _n long")
            newest = Window.partitionBy("cluster").orderBy(F.desc("ts"), context.topology.in_text_order(F.col("id")).desc())
            kept = members.join(F.broadcast(chosen), "cluster").withColumn("_p", F.row_number().over(newest)).where("_p <= _n").drop("_p", "_n")
        # An answer's atoms, ``limit`` at most: one partition, so that nothing of them is shuffled.
        kept = spark.createDataFrame(kept.toArrow()).coalesce(1)
        return self._answer(kept, links, high, since, until, limit, gap, format, hint, hint_key, project, own_now, window, total, in_clusters > limit, seen)

    def _answer(self, kept, links, high, since, until, limit, gap, format, hint, hint_key, project, own_now, window, total, cut, seen) -> dict:
        derived = context.derived(kept, high, hint_key, None if own_now is None else self.at(own_now))
        order = clusters.best_first(derived.signals, "cluster_id")
        heads = derived.signals.withColumn("why", clusters.reasons()).orderBy(*order).collect()
        total = len(heads) if total is None else total
        order_of = ["ts", context.topology.in_text_order(F.col("occurred_at")), context.topology.in_text_order(F.col("id"))]
        loops: dict = {}
        for r in derived.loops.orderBy("ts", "id").collect():
            entry = {"atom_id": r.id, "kind": r.kind, "text": r.text, "confidence": r.confidence, "resolved": r.resolved_by is not None}
            loops.setdefault(r.cluster, []).append(entry | ({"resolved_by_atom_id": r.resolved_by} if r.resolved_by is not None else {}))
        anchors: dict = {}
        for r in derived.anchors.orderBy("cluster", "place").collect():
            anchors.setdefault(r.cluster, []).append({k: v for k, v in r.ref.asDict().items() if v is not None})
        names = {r.cluster: r.label for r in derived.labels.collect()}
        edges: dict = {}
        for r in context.kept_links(links, kept).orderBy("from", "to").collect():
            edges.setdefault(r.cluster, []).append({"from": r["from"], "to": r["to"], "kind": "shared_artifact", "artifact_ids": list(r["keys"]), "confidence": "high"})
        rows = kept.orderBy(*order_of).collect()
        of: dict = {}
        for r in rows:
            of.setdefault(r.cluster, []).append(r)
        found = []
        for place, h in enumerate(heads, 1):
            own = of[h.cluster]
            apps: dict = {}
            for r in own:
                apps[r.app] = apps.get(r.app, 0) + 1
            c = {
                "cluster_id": h.cluster_id, "rank": place, "rank_reason": list(h.why), "anchor_artifacts": anchors.get(h.cluster, []), "atom_ids": sorted(r.id for r in own), "edges": edges.get(h.cluster, []),
                "open_loop_hints": loops.get(h.cluster, []), "source_breakdown": apps, "time_range": {"from": own[0].occurred_at, "to": own[-1].occurred_at},
            }
            found.append(c | ({"label": names[h.cluster]} if h.cluster in names else {}))
        warnings = normalize.error_warnings([(r.error, r.n) for r in normalize.errors(seen).orderBy("error").collect()])
        if total > len(found):
            warnings.append(told("CLUSTERS_DROPPED", n=total - len(found)))
        return {
            "schema_version": 1, "tool": "get_recent_work_context",
            "query": {"since": since, "until": until, "artifact_hint": hint, "format": format, "window_hours": gap, "repo_path": project.path if project else None},
            "clusters": found, "atoms": {r.id: atom_view(r) for r in rows},
            "truncation": {"atoms_returned": len(rows), "atoms_total_in_window": sum(window.values()), "clusters_returned": len(found), "clusters_total": total, "truncated": cut, "source_breakdown": window},
            "warnings": warnings,
        }

    def find_clusters(self, since=None, until=None, window_hours=None, view="rich", repo_path=None, group_by=None, page_size=None, representative_limit=None, cursor=None) -> dict:
        """Clusters without bodies, or their turns by project or thread. An answer that would be too long shows fewer ids of each cluster,
        then fewer clusters; a page of groups or members ends earlier and has a cursor."""
        if group_by is not None or cursor is not None:
            return self._grouped(since, until, window_hours, view, repo_path, group_by, page_size, representative_limit, cursor)
        if page_size is not None or representative_limit is not None:
            raise ValueError("find_clusters: page_size and representative_limit require group_by")
        _one_of("find_clusters", "view", view, ("compact", "rich"))
        work = self.recent_work_context(since, until, limit=CLUSTER_MOST, window_hours=window_hours, format="skeleton", repo_path=repo_path)

        def answer(shown: list[dict], more: list[str], capped: bool) -> dict:
            t = work["truncation"]
            caps = {"clusters_returned": len(shown), "clusters_total": t["clusters_total"], "atoms_returned": sum(len(c["atom_ids"]) for c in shown), "atoms_total_in_window": t["atoms_total_in_window"], "source_breakdown": t["source_breakdown"], "truncated": t["truncated"] or capped or any("atom_ids_truncated" in c for c in shown)}
            asked = {k: work["query"][k] for k in ("since", "until", "window_hours", "format", "repo_path")}
            return {"schema_version": 1, "tool": "find_clusters", "query": asked, "clusters": shown, "result_caps": caps, "warnings": work["warnings"] + more}

        room = wire.ANSWER_BYTES - RESERVE
        for cap in ID_CAPS:
            shown = [wire.cluster_view(c, cap) for c in work["clusters"]]
            shown = [wire.compact_cluster(c) for c in shown] if view == "compact" else shown
            if wire.size(answer(shown, [], True)) <= room:
                break
        short = any("atom_ids_truncated" in c for c in shown)
        whole = len(shown)
        while shown and wire.size(answer(shown, [], True)) > room:
            shown = shown[:-1]
        more = []
        if short and cap != ID_CAPS[0]:
            more.append(told("FIND_CLUSTERS_ID_BUDGET", cap=cap))
        elif any("atom_ids_truncated" in c for c in shown):
            more.append(told("FIND_CLUSTERS_ID_CAP", cap=ID_CAPS[0]))
        if len(shown) < whole:
            more.append(told("FIND_CLUSTERS_RESPONSE_CAP", n=len(shown), all=whole, ceiling=wire.ANSWER_BYTES))
        return answer(shown, more, bool(more))

    # Groups ----------------------------------------------------------------------------------------------------------------------------
    def _grouped(self, since, until, window_hours, view, repo_path, group_by, page_size, representative_limit, cursor) -> dict:
        at = None
        if cursor is not None:
            given = {"since": since, "until": until, "window_hours": window_hours, "repo_path": repo_path, "group_by": group_by, "page_size": page_size, "representative_limit": representative_limit}
            if beside := [k for k, v in given.items() if v is not None] + ["view"] * (view != "rich"):
                raise ValueError(f"find_clusters: cursor continuation must be cursor-only; remove {', '.join(beside)}")
            at = cursors.read_group_cursor(cursor)
            since, until, window_hours, repo_path, group_by, page, reps = (at[k] for k in ("since", "until", "window_hours", "repo_path", "by", "page", "representatives"))
        else:
            _one_of("find_clusters", "view", view, ("compact", "rich"))
            _one_of("find_clusters", "group_by", group_by, ("project", "thread"))
            page = _within("page_size", page_size, cursors.GROUP_PAGE, cursors.GROUP_PAGE)
            reps = _within("representative_limit", representative_limit, 3, cursors.MOST_REPRESENTATIVES)
        work = self.recent_work_context(since, until, limit=CLUSTER_MOST, window_hours=window_hours, format="skeleton", repo_path=repo_path)
        models = group_models(self.ledger.sparkSession, work, group_by, reps)
        q = work["query"]
        frozen = (q["since"], q["until"], q["window_hours"], q["repo_path"])

        def member_cursor(model: dict, offset: int) -> str | None:
            if offset >= len(model["order"]):
                return None
            return cursors.group_cursor("members", group_by, *frozen, offset, cursors.MEMBER_PAGE, reps, model["digest"], model["wire"]["group_id"])

        def answer(mode, shown, ids, to, more, extra=None) -> dict:
            t = work["truncation"]
            turns, raw = (sum(m["wire"][k] for m in models) for k in ("unique_turn_count", "raw_observation_count"))
            caps = {
                "clusters_returned": 0, "clusters_total": t["clusters_total"], "atoms_returned": len(set(ids)), "atoms_total_in_window": t["atoms_total_in_window"], "source_breakdown": t["source_breakdown"],
                "truncated": t["truncated"], "groups_returned": len(shown), "groups_total": len(models), "unique_turns_total": turns, "raw_observations_total": raw, "counts_complete": not t["truncated"],
            }
            asked = {"since": q["since"], "until": q["until"], "window_hours": q["window_hours"], "format": "skeleton", "repo_path": q["repo_path"], "group_by": group_by, "page_size": page, "representative_limit": reps}
            out = {"schema_version": 1, "tool": "find_clusters", "query": asked, "clusters": [], "mode": mode, "groups": shown, "next_cursor": to, "result_caps": caps, "warnings": work["warnings"] + more}
            return out | (extra or {})

        def fitting(most: int, build: Callable[[int, bool], dict], what: str) -> dict:
            for n in range(most, 0, -1):
                out = build(n, n < most)
                if wire.size(out) <= wire.ANSWER_BYTES:
                    return out
            if most:
                raise ValueError(f"find_clusters: one {what} exceeds the {wire.ANSWER_BYTES}-byte response ceiling")
            return build(0, False)

        if at is not None and at["kind"] == "members":
            model = next((m for m in models if m["wire"]["group_id"] == at["group"]), None)
            if model is None or model["digest"] != at["snapshot"] or at["offset"] >= len(model["order"]):
                raise cursors.CursorError("STALE", "the group changed inside the frozen window; restart grouped discovery")

            def members(n: int, shortened: bool) -> dict:
                ids = model["order"][at["offset"] : at["offset"] + n]
                extra = {"membership_page": {"group_id": at["group"], "atom_ids": ids, "atoms_returned": len(ids), "atoms_total": len(model["order"])}}
                more = [told("FIND_CLUSTERS_MEMBER_PAGE_BUDGET", n=n, asked=page)] if shortened else []
                return answer("members", [model["wire"] | {"membership_cursor": None}], ids, member_cursor(model, at["offset"] + n), more, extra)

            return fitting(min(page, len(model["order"]) - at["offset"]), members, "member ID")
        whole = cursors.digest([[m["wire"]["group_id"], m["digest"]] for m in models])
        first = 0 if at is None else at["offset"]
        if at is not None and (at["snapshot"] != whole or first > len(models)):
            raise cursors.CursorError("STALE", "the groups changed inside the frozen window; restart grouped discovery")

        def headers(n: int, shortened: bool) -> dict:
            shown = [m["wire"] | {"membership_cursor": member_cursor(m, len(m["wire"]["representative_atom_ids"]))} for m in models[first : first + n]]
            to = cursors.group_cursor("groups", group_by, *frozen, first + n, page, reps, whole) if first + n < len(models) else None
            more = [told("FIND_CLUSTERS_GROUP_PAGE_BUDGET", n=n, asked=page)] if shortened else []
            return answer("groups", shown, [i for g in shown for i in g["representative_atom_ids"]], to, more)

        return fitting(min(page, len(models) - first), headers, "grouped header")

    # Hydration -------------------------------------------------------------------------------------------------------------------------
    def _rows(self, ids: list[str]) -> dict[str, dict]:
        wanted = self.ledger.where(F.col("id").isin(*dict.fromkeys(ids))).select("id", "source", "timestamp", "content", "metadata")
        return {r["id"]: self.row(r) for r in wanted.collect()}

    def get_atoms(self, atom_ids, fields=None, prefer="as_requested", view="rich", cursor=None) -> dict:
        """Rows by id, as many as an answer holds; a cursor continues the same request."""
        if not atom_ids or len(atom_ids) > IDS_MOST:
            raise ValueError(f"get_atoms: atom_ids must have 1 to {IDS_MOST} entries")
        if any(f not in ("content", "metadata") for f in fields or ()):
            raise ValueError('get_atoms: fields entries must be "content" or "metadata"')
        _one_of("get_atoms", "view", view, ("compact", "rich"))
        _one_of("get_atoms", "prefer", prefer, ("as_requested", "newest_first"))
        have = self._rows(atom_ids)
        order = list(atom_ids)
        if prefer == "newest_first":
            known = [i for i in dict.fromkeys(atom_ids) if i in have]
            order = sorted(known, key=lambda i: instant(have[i]["timestamp"]), reverse=True) + [i for i in dict.fromkeys(atom_ids) if i not in have]
        request = cursors.digest({"atom_ids": list(atom_ids), "fields": None if fields is None else sorted(set(fields)), "prefer": prefer, "view": view})
        process = cursors.digest([[i, have[i]["timestamp"] if i in have else None] for i in order])
        start = 0
        if cursor is not None:
            asked, ran, start = cursors.read_continuation_cursor(cursor)
            if asked != request:
                raise cursors.CursorError("MISMATCH", "atom_ids, fields, prefer or view differ from the original request")
            if ran != process or start >= len(order):
                raise cursors.CursorError("STALE", "the requested ids or their order in storage changed")
        rest = [i for i in order[start:] if cursor is None or i in have]
        missing = sum(i not in have for i in rest)
        atoms, room = [], wire.ANSWER_BYTES - 512
        stop = None
        for n, i in enumerate(rest):
            if i not in have:
                continue
            atoms.append(self._atom_view(have[i], fields, view))
            dropped = [j for j in rest[:n] if j not in have] + rest[n + 1 :]
            if wire.size(self._hydrated(atoms, dropped, [], room, missing, len(dropped) - missing, None)) > room:
                atoms.pop()
                stop = n
                break
        dropped = [j for k, j in enumerate(rest) if j not in have or stop is not None and k >= stop]
        deferred = sum(j in have for j in dropped)
        to, warnings = None, []
        if stop is not None and not atoms:
            warnings.append(told("GET_ATOMS_FIRST_TOO_LONG"))
        elif stop is not None:
            at = [k for k in range(start, len(order)) if cursor is None or order[k] in have][stop]
            to = cursors.continuation_cursor(request, process, at)
            warnings.append(told("GET_ATOMS_RESPONSE_CAP", n=deferred))
        if missing:
            warnings.append(told("GET_ATOMS_MISSING_IDS", n=missing))
        return self._hydrated(atoms, dropped, warnings, wire.ANSWER_BYTES, missing, deferred, to)

    @staticmethod
    def _atom_view(row: dict, fields, view: str) -> dict:
        m = wire.match_view(row)
        out = {k: m[k] for k in ("id", "source", "timestamp", "truncations")}
        out |= {new: m[old] for old, new in (("bytes_elided", "content_bytes_elided"), ("metadata_bytes_elided",) * 2, ("metadata_keys_omitted",) * 2) if old in m}
        body = {k: m[k] for k in ("content", "metadata") if k in m}
        if view == "compact":
            out = wire.compact_atom(out | body)
            body = {k: out.pop(k) for k in ("content", "metadata") if k in out}
        shown = {k: v for k, v in body.items() if not fields or k in fields}
        out["truncations"] = out["truncations"] + ["fields_omitted"] * (len(shown) < len(body))
        return out | shown

    @staticmethod
    def _hydrated(atoms, dropped, warnings, ceiling, missing, deferred, to) -> dict:
        out = {"schema_version": 1, "tool": "get_atoms", "atoms": list(atoms), "atoms_dropped": len(dropped), "atoms_dropped_ids": list(dropped), "atoms_missing": missing, "atoms_deferred": deferred, "next_cursor": to, "warnings": list(warnings)}
        if wire.size(out) <= ceiling or not dropped:
            return out
        out["warnings"].append(told("GET_ATOMS_DROPPED_ID_CAP"))
        out["atoms_dropped_ids_omitted"] = 0
        while out["atoms_dropped_ids"] and wire.size(out) > ceiling:
            out["atoms_dropped_ids"].pop()
            out["atoms_dropped_ids_omitted"] += 1
        return out

    def get_atom(self, id: str) -> dict:
        """One row with its text as it is, or why not."""
        if not id:
            raise ValueError("get_atom: id is required and must be a non-empty string")
        row = self._rows([id]).get(id)
        if row is None:
            return {"schema_version": 1, "tool": "get_atom", "atom": None, "atom_size_bytes": 0, "error_code": "atom_not_found", "source": None, "warnings": [told("ATOM_NOT_FOUND", id=id)]}
        m = wire.match_view(row)
        atom = {k: m[k] for k in ("id", "source", "timestamp")} | {"content": row["content"], "truncations": [t for t in m["truncations"] if t != "content"]}
        atom |= {"metadata": m["metadata"]} if "metadata" in m else {}
        n = wire.size(atom)
        out = {"schema_version": 1, "tool": "get_atom", "atom": atom, "atom_size_bytes": n, "warnings": []}
        if wire.size(out) <= wire.ANSWER_BYTES:
            return out
        why = [told("ATOM_TOO_LARGE")] + [told("GET_ATOM_SOURCE_CAP")] * ("source" in m["truncations"])
        return {"schema_version": 1, "tool": "get_atom", "atom": None, "atom_size_bytes": n, "error_code": "atom_too_large_for_wire", "source": m["source"], "warnings": why}

    # Newest sources and new turns ------------------------------------------------------------------------------------------------------
    def _active(self) -> DataFrame:
        """Rows that count as new activity: not copies that a fork has inherited."""
        return self.visible.where(~F.col("m_observation_kind").eqNullSafe("inherited"))

    def resolve_mru(self, sources: list[str], repo_path: str | None = None) -> dict:
        """For each app its newest source, for each other entry the entry, if it has a row. Git sources of a project also count by their exact
        root; at one time the one found by the app's sources wins."""
        if not sources or len(sources) > SOURCES_MOST:
            raise ValueError(f"resolve_mru: sources must have 1 to {SOURCES_MOST} entries")
        project, apps = self.project("resolve_mru", repo_path), self.prefixes()
        probes = []
        for n, entry in enumerate(dict.fromkeys(sources)):
            wanted = [(0, L.Scan(source_prefixes=(apps[entry],)))] if entry in apps else [(0, L.Scan(source=entry))]
            if entry == "git" and project is not None:
                wanted += [(1, L.Scan(source=f"git:{r}")) for r in dict.fromkeys([project.path, *project.roots])]
            for kind, scan in wanted:
                scan.project = (project.key, project.roots) if project else None
                probes.append(F.when(scan.predicate(), F.struct(F.lit(n).alias("n"), F.lit(kind).alias("kind"))))
        hits = self._active().select("id", "ts", "source", F.explode(F.array_distinct(F.array_compact(F.array(*probes)))).alias("p"))
        best = hits.groupBy("p.n").agg(F.max_by("source", F.struct("ts", -F.col("p.kind"), "id")).alias("source")).collect()
        newest = {r.n: r.source for r in best}
        where = {"repo_path": project.path} if project else {}
        found = {e: ({"source": newest[n] if e in apps else e, "filter": where} if n in newest else None) for n, e in enumerate(dict.fromkeys(sources))}
        return {"sources": found, "warnings": []} | where

    def poll(self, sources: list[str], prefixes: list[str], since: str, project: Project | None) -> DataFrame:
        """id, timestamp of the oldest new rows after ``since``: twenty, and all others of the last one's time. One scan for all selectors, so
        that no row is met twice."""
        tests = [L.Scan(source=s) for s in sources] + [L.Scan(source_prefixes=(p,)) for p in prefixes]
        for t in tests:
            t.project = (project.key, project.roots) if project else None
        wanted = tests[0].predicate()
        for t in tests[1:]:
            wanted = wanted | t.predicate()
        rows = self._active().where((F.col("timestamp") > since) & (F.col("ts") >= self.at(since)) & wanted).select("id", "timestamp")
        last = rows.orderBy("timestamp").limit(TURNS_MOST).agg(F.max("timestamp").alias("_last"))
        return rows.join(F.broadcast(last), F.col("timestamp") <= F.col("_last")).drop("_last").orderBy("timestamp", "id")

    def wait_for_new_turns(self, since: str, sources: list[str] | None = None, source_prefix: str | None = None, timeout: float | None = None, repo_path: str | None = None) -> dict:
        """Ids of rows after ``since``, oldest first, as soon as there are any, and from where to go on. A group of rows of one time is never
        split, so that nothing is lost between two calls."""
        if not sources and not source_prefix:
            raise ValueError("wait_for_new_turns: at least one of sources[] (non-empty) or source_prefix (non-empty) must be present")
        if sources and len(sources) > SOURCES_MOST:
            raise ValueError(f"wait_for_new_turns: sources exceeds max {SOURCES_MOST} per call")
        if not since or not ISO.match(since):
            raise ValueError("wait_for_new_turns: since must be a valid ISO 8601 timestamp")
        warnings = [] if has_tz(since) else [told("TZ")]
        begin, project, apps = iso(instant(since)), self.project("wait_for_new_turns", repo_path), self.prefixes()
        exact = [s for s in dict.fromkeys(sources or ()) if s not in apps]
        prefixes = list(dict.fromkeys([apps[s] for s in sources or () if s in apps] + ([source_prefix] if source_prefix else [])))
        left = min(WAIT_DEFAULT if timeout is None else max(0, timeout), WAIT_MOST)
        end = self.now() + timedelta(seconds=left)
        page = self.poll(exact, prefixes, begin, project).collect()
        while not page and self.now() < end:
            self.sleep(min(1.0, (end - self.now()).total_seconds()))
            page = self.poll(exact, prefixes, begin, project).collect()
        to = page[-1].timestamp if page else begin
        if instant(to) > self.now():
            now = iso(self.now())
            warnings.append(told("NEXT_SINCE_CLAMP", to=to, now=now))
            to = now
        if len(page) > TURNS_MOST or len(page) == TURNS_MOST and self._more(exact, prefixes, page[-1].timestamp, project):
            warnings.append(told("MORE_TURNS", most=TURNS_MOST, n=len(page)))
        return {"schema_version": 1, "tool": "wait_for_new_turns", "turn_ids": [r.id for r in page], "next_since": to, "timed_out": not page, "warnings": warnings}

    def _more(self, exact, prefixes, since, project) -> bool:
        return not self.poll(exact, prefixes, since, project).isEmpty()

    def ping(self, message: str | None = None) -> dict:
        return {"pong": True} | ({} if message is None else {"received": message}) | {"ts": iso(self.now())}

    # Service ---------------------------------------------------------------------------------------------------------------------------
    def service(self, route: str, **args) -> dict:
        """The frozen first version of the service: its routes, and the shapes that they had."""
        routes = {"ping": self.ping, "search": self.search_memories, "clusters": self.recent_work_context, "atoms": self.get_atoms, "wait": self.wait_for_new_turns}
        if route not in routes:
            raise ValueError(f"unknown route: {route}")
        out = routes[route](**args)
        if route == "clusters":
            return out | {"atoms": {k: wire.service_atom(a) for k, a in out["atoms"].items()}}
        if route == "atoms":
            return {k: v for k, v in out.items() if k not in ("atoms_missing", "atoms_deferred", "next_cursor")}
        return out


def _one_of(tool: str, name: str, value, allowed: tuple) -> None:
    if value not in allowed:
        raise ValueError(f"{tool}: {name} must be one of {', '.join(allowed)}")


def _within(name: str, value, default: int, most: int) -> int:
    if value is None:
        return default
    if isinstance(value, bool) or not isinstance(value, int) or not 1 <= value <= most:
        raise ValueError(f"find_clusters: {name} must be an integer from 1 to {most}")
    return value


def atom_view(r) -> dict:
    """A turn as the nested record that clusters show; what is absent is left out."""
    some = lambda d: {k: v for k, v in d.items() if v is not None}
    plain = lambda row: some(row.asDict()) if row is not None else None
    observed = r.observed_at if r.raw == 1 and r.observed_at is None else iso(r.observed_ts if r.observed_ts.tzinfo else r.observed_ts.replace(tzinfo=UTC))
    provenance = {"source_event_id": r.id, "raw_payload_hash": r.raw_payload_hash, "extractor_version": r.extractor_version}
    out = {
        "schema_version": 1, "id": r.id, "time": some({"occurred_at": r.occurred_at, "observed_at": observed}), "source": some({"app": r.app, "surface": r.surface, "raw_pointer": r.raw_pointer}),
        "actors": [plain(a) for a in r.actors], "action": some({"kind": r.kind, "verb": r.verb, "input": r.input, "output": r.output}), "artifacts": [plain(a) for a in r.artifacts],
        "provenance": provenance | ({"raw_observation_count": r.raw} if r.raw > 1 else {}),
    }
    shown = some({"visible": r.visible, "ambient": r.ambient})
    rest = {"context": shown or None, "state": {"delta": plain(r.delta)} if r.delta is not None else None, "conversation": plain(r.conversation), "project": plain(r.project), "open_loop_hints": r.hints or None}
    return out | some(rest)


def group_models(spark, work: dict, by: str, limit: int) -> list[dict]:
    """Groups of the turns of an answer, newest first: what is shown, the order of members, and a digest of that."""
    rows = []
    for c in work["clusters"]:
        for i in c["atom_ids"]:
            a = work["atoms"][i]
            talk, project = a.get("conversation", {}), a.get("project", {})
            rows.append((i, c["cluster_id"], a["source"]["app"], instant(a["time"]["occurred_at"]), a["time"]["occurred_at"], a["provenance"].get("raw_observation_count", 1), project.get("key"), project.get("canonical_root"), talk.get("provider"), talk.get("session_id"), talk.get("root_thread_id")))
    if not rows:
        return []
    schema = "id string, cluster string, app string, ts timestamp, at string, raw long, project_key string, canonical_root string, provider string, session_id string, root_thread_id string"
    atoms = groups.identities(spark.createDataFrame(rows, schema).coalesce(1)).withColumn("thread", F.col("thread_group"))
    atoms = atoms.withColumn("group_key", F.col(f"{by}_group"))
    counts = groups.discovery_groups(atoms).withColumn("group_id", groups.group_id(by, F.col("group_key")))
    one = atoms.groupBy("group_key").agg(*[F.min(c).alias(c) for c in ("project_quality", "thread_quality", "thread_project", "project_key", "thread_provider", "root_thread")], F.min_by("at", "ts").alias("first"), F.max_by("at", "ts").alias("last"))
    heads = counts.join(one, "group_key").join(groups.routes(atoms), "group_key").collect()
    places = groups.member_order(atoms, limit).select("group_key", "id", "place", "representative").collect()
    order: dict = {}
    for r in sorted(places, key=lambda r: r.place):
        order.setdefault(r.group_key, []).append((r.id, r.representative))
    out = []
    for h in heads:
        members = order[h.group_key]
        shown = {
            "group_id": h.group_id, "identity_quality": h[f"{by}_quality"], "project_key": h.project_key if by == "project" else h.thread_project, "canonical_root": h.canonical_root, "repo_path": h.canonical_root,
            "unique_turn_count": h.turns, "raw_observation_count": h.raw_observations, "collapsed_observation_count": h.collapsed, "representative_atom_ids": [i for i, rep in members if rep],
            "source_breakdown": dict(sorted(h.by_app.items())), "time_range": {"from": h["first"], "to": h["last"]},
        }
        if by == "thread":
            shown |= {k: v for k, v in (("provider", h.thread_provider), ("root_thread_id", h.root_thread)) if v is not None}
        else:
            shown["thread_count"] = h.threads
        ids = [i for i, _ in members]
        out.append({"wire": shown, "order": ids, "digest": cursors.digest({"group_id": h.group_id, "member_order": ids, "raw_observation_count": h.raw_observations})})
    return sorted(sorted(out, key=lambda m: m["wire"]["group_id"]), key=lambda m: instant(m["wire"]["time_range"]["to"]), reverse=True)


def capped_context(answer: dict, ceiling: int = wire.ANSWER_BYTES) -> dict:
    """An answer with bodies, under a ceiling: the lowest clusters go, with their bodies."""
    if wire.size(answer) < ceiling:
        return answer
    for n in range(len(answer["clusters"]), -1, -1):
        kept = answer["clusters"][:n]
        ids = {i for c in kept for i in c["atom_ids"]}
        atoms = {k: v for k, v in answer["atoms"].items() if k in ids}
        why = told("RECENT_WORK_CONTEXT_RESPONSE_CAP", n=len(answer["clusters"]) - n, ceiling=ceiling)
        out = answer | {"clusters": kept, "atoms": atoms, "truncation": answer["truncation"] | {"atoms_returned": len(atoms), "clusters_returned": n, "truncated": True}, "warnings": answer["warnings"] + [why]}
        if wire.size(out) < ceiling:
            return out
    return out
