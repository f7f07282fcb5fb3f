"""What goes over the wire: bounded shapes of rows and clusters, byte for byte. All of it runs on the few rows of an answer."""

from __future__ import annotations

import json
import math
import re

from .functions.text import clipped

#: Bytes (JSON bytes of sources and metadata, characters of minimal and skeleton texts) that an answer keeps.
SOURCE_JSON, CONTENT, META_VALUE, META_TOTAL, META_KEYS, MINIMAL_CHARS, SKELETON_CHARS = 1024, 2000, 1000, 4000, 32, 500, 200
#: Metadata that is kept first, in this order.
FIRST_KEYS = ("surface", "session_id", "repo_root", "cwd", "turn_index", "canonical_subject", "signal_type", "note_id", "files_referenced", "git_state", "model", "tool_calls", "tool_calls_by_name")
SKELETON_IDS, SKELETON_LOOPS, ANSWER_BYTES, ECHO_BYTES = 50, 30, 25_000, 4096


def to_json(value) -> str:
    """JSON as it is sent: no spaces, no escapes beyond the needed ones, whole numbers without a fraction."""

    def plain(v):
        if isinstance(v, float) and math.isfinite(v) and v == int(v):
            return int(v)
        if isinstance(v, dict):
            return {k: plain(x) for k, x in v.items()}
        return [plain(x) for x in v] if isinstance(v, (list, tuple)) else v

    return json.dumps(plain(value), separators=(",", ":"), ensure_ascii=False)


def size(value) -> int:
    return len(to_json(value).encode("utf-8", "surrogatepass"))


def utf16(text: str) -> bytes:
    return text.encode("utf-16-le", "surrogatepass")


def first_chars(text: str, n: int) -> str:
    """The first ``n`` characters as JavaScript counts them (UTF-16 units)."""
    return utf16(text)[: 2 * n].decode("utf-16-le", "replace")


def n_chars(text: str) -> int:
    return len(utf16(text)) // 2


def clip_json(text: str, budget: int) -> str:
    """A text whose JSON form is within ``budget`` bytes, escapes counted: clipped to half of it, then halved again as often as needed."""
    keep = max(16, budget // 2)
    out = text
    while size(out) > budget:
        out = clipped(text, keep)[0]
        if keep == 16:
            break
        keep = max(16, keep // 2)
    return out


def tool_view(calls) -> tuple[list[str], dict[str, int], int] | None:
    """The names of tool calls in order, how often each, and the characters saved; null for what is no list of calls."""
    if not isinstance(calls, list) or not all(isinstance(c, dict) and isinstance(c.get("name"), str) for c in calls):
        return None
    names = [c["name"] for c in calls]
    counts: dict[str, int] = {}
    for n in names:
        counts[n] = counts.get(n, 0) + 1
    return names, counts, n_chars(to_json(calls)) - n_chars(to_json(names)) if names else 0


def metadata_view(metadata: dict, value_cap: int = META_VALUE, total_cap: int = META_TOTAL, key_cap: int = META_KEYS) -> tuple[dict, int, list[str], int]:
    """The metadata within its budgets: kept members, bytes left out, keys whose values are replaced by their size, number of keys left out."""
    place = {k: i for i, k in enumerate(FIRST_KEYS)}
    kept: dict = {}
    lost, replaced, omitted = 0, [], 0
    for key in sorted(metadata, key=lambda k: (place.get(k, len(place)), k)):
        whole = size(metadata[key])
        value = {"__elided": True, "original_size": whole} if whole > value_cap else metadata[key]
        if len(kept) >= key_cap or size({**kept, key: value}) > total_cap:
            omitted += 1
            lost += max(0, size({key: metadata[key]}) - 2)
            continue
        kept[key] = value
        if whole > value_cap:
            replaced.append(key)
            lost += max(0, whole - (size({key: value}) - 2))
    return kept, lost, replaced, omitted


def match_view(row: dict) -> dict:
    """A ledger row (id, source, timestamp, content, metadata as a dict or None) in bounded form; ``truncations`` names all that was cut or reshaped."""
    source, (content, gone) = clip_json(row["source"], SOURCE_JSON), clipped(row["content"], CONTENT)
    cut: list[str] = []
    out = {"id": row["id"], "source": source, "timestamp": row["timestamp"], "content": content, "truncations": cut}
    if source != row["source"]:
        cut.append("source")
    if gone:
        out["bytes_elided"] = gone
        cut.append("content")
    if row.get("metadata") is None:
        return out
    shaped, saved, reshaped = dict(row["metadata"]), 0, []
    view = tool_view(shaped["tool_calls"]) if "tool_calls" in shaped else None
    if view is not None and view[2] > 0:
        shaped["tool_calls"], saved, reshaped = view[0], view[2], ["tool_calls"]
        if view[1]:
            shaped["tool_calls_by_name"] = view[1]
    kept, lost, replaced, omitted = metadata_view(shaped)
    reshaped = [k for k in reshaped if k in kept]
    out["metadata"] = kept
    for name, value in (("metadata_bytes_elided", saved + lost), ("metadata_keys_elided", replaced), ("metadata_keys_omitted", omitted), ("metadata_keys_projected", reshaped)):
        if value:
            out[name] = value
    cut += [f"metadata.{k}" for k in replaced] + ["metadata"] * bool(omitted) + [f"metadata.{k}:projected" for k in reshaped]
    return out


def stub_view(row: dict) -> dict:
    """A row by its identity alone."""
    source = clip_json(row["source"], SOURCE_JSON)
    out = {"id": row["id"], "source": source, "timestamp": row["timestamp"], "content": ""}
    if row["content"]:
        out["bytes_elided"] = len(row["content"].encode())
    if row.get("metadata") is not None:
        out["metadata_keys_omitted"] = len(row["metadata"])
    return {**out, "truncations": ["source"] * (source != row["source"]) + ["content", "metadata"]}


def head_tail(items: list, cap: int) -> list:
    return list(items) if len(items) <= cap else [*items[: cap // 2], *items[len(items) - (cap - cap // 2) :]]


def cluster_view(cluster: dict, id_cap: int) -> dict:
    """A cluster without bodies: its ids within a cap, and those open loops of which all ids are shown."""
    ids = head_tail(cluster["atom_ids"], id_cap)
    seen = set(ids)
    loops = [h for h in cluster["open_loop_hints"] if h["atom_id"] in seen and h.get("resolved_by_atom_id", h["atom_id"]) in seen]
    shown = head_tail(loops, SKELETON_LOOPS)
    out = {k: cluster[k] for k in ("cluster_id", "rank", "rank_reason")} | {"atom_ids": ids} | {k: cluster[k] for k in ("source_breakdown", "time_range")}
    out["open_loop_hints"] = [{"atom_id": h["atom_id"], "resolved": h["resolved"]} for h in shown]
    if cluster.get("label") is not None:
        out["label"] = cluster["label"]
    if len(ids) < len(cluster["atom_ids"]):
        out |= {"atom_ids_truncated": True, "atom_ids_total": len(cluster["atom_ids"])}
    if len(shown) < len(cluster["open_loop_hints"]):
        out["open_loop_hints_omitted"] = len(cluster["open_loop_hints"]) - len(shown)
    return out


#: A label that names a session only, and reasons of rank that the compact view keeps.
SESSION_LABEL = re.compile(r"discussion about [0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\Z")
COMPACT_REASONS = ("has_open_loop", "has_unresolved_open_loop", "code_session_anchor")


def compact_cluster(view: dict) -> dict:
    keep = ("cluster_id", "atom_ids", "source_breakdown", "time_range", "open_loop_hints", "rank", "label", "open_loop_hints_omitted", "atom_ids_truncated", "atom_ids_total")
    out = {k: view[k] for k in keep if k in view}
    if "label" in out and SESSION_LABEL.match(out["label"]):
        out["label"] = None
    why = [r for r in view.get("rank_reason", ()) if r in COMPACT_REASONS]
    return out | ({"rank_reason": why} if why else {})


def skeleton_cluster(cluster: dict) -> dict:
    ids, loops = head_tail(cluster["atom_ids"], SKELETON_IDS), head_tail(cluster["open_loop_hints"], SKELETON_LOOPS)
    out = {k: cluster[k] for k in ("cluster_id", "rank", "rank_reason")} | {"atom_ids": ids} | {k: cluster[k] for k in ("source_breakdown", "time_range")}
    out["open_loop_hints"] = [{"atom_id": h["atom_id"], "resolved": h["resolved"]} for h in loops]
    if cluster.get("label") is not None:
        out["label"] = cluster["label"]
    for name, short, whole in (("atom_ids_omitted", ids, cluster["atom_ids"]), ("open_loop_hints_omitted", loops, cluster["open_loop_hints"])):
        if len(short) < len(whole):
            out |= {name: len(whole) - len(short), "truncated": True}
    return out


def skeleton_atom(atom: dict) -> dict:
    said = atom["action"].get("input", atom["action"].get("output"))
    action = {"kind": atom["action"]["kind"]} | ({"summary": first_chars(said, SKELETON_CHARS)} if said else {})
    return {"id": atom["id"], "time": atom["time"], "source": atom["source"], "action": action}


def minimal_atom(atom: dict) -> dict:
    """An atom whose texts are cut to their beginnings, with a note of what was left out."""
    action = dict(atom["action"])
    for k in ("input", "output"):
        if k in action and n_chars(action[k]) > MINIMAL_CHARS:
            left = n_chars(action[k]) - MINIMAL_CHARS
            action[k] = first_chars(action[k], MINIMAL_CHARS) + f"… [truncated; {left} chars omitted; fetch full atom via search_memories]"
    return {**atom, "action": action}


def _record(value) -> dict:
    return value if isinstance(value, dict) else {}


def source_kind(source: str, metadata: dict) -> str:
    if metadata.get("surface") in ("claude_code", "cursor", "codex"):
        return metadata["surface"]
    tests = (
        ("git", source.startswith("git:")), ("claude_code", "/.claude/projects/" in source), ("codex", "/.codex/sessions/" in source),
        ("cursor", "/Cursor/User/" in source or source.endswith(".vscdb")),
    )
    return next((name for name, holds in tests if holds), "unknown")


def compact_atom(view: dict) -> dict:
    """A row's view with the metadata that its kind of source is read for."""
    out = {k: view[k] for k in ("id", "source", "timestamp") if k in view} | {"truncations": list(view["truncations"])}
    if "content" in view:
        out["content"] = view["content"]
    if "metadata" not in view:
        return out
    m, kind = view["metadata"], source_kind(view["source"], view["metadata"])
    pick = lambda r, *names: {k: r[k] for k in names if k in r}
    kept = pick(m, "session_id", "repo_root")
    if isinstance(m.get("tool_call_total"), (int, float)) and not isinstance(m["tool_call_total"], bool) and m["tool_call_total"] > 0:
        kept["tool_call_total"] = m["tool_call_total"]
    kept |= pick(m, "had_tool_use", "tool_calls_by_name", "files_referenced")
    if kind == "claude_code":
        kept |= pick(m, "model")
        if m.get("permission_mode", "default") != "default":
            kept["permission_mode"] = m["permission_mode"]
        branch = m.get("branch") if m.get("branch") is not None else _record(m.get("git_state")).get("branch")
        kept |= {} if branch is None else {"branch": branch}
    elif kind == "cursor":
        if m.get("is_continuation") is True:
            kept["is_continuation"] = True
        if context := pick(_record(m.get("context")), "attached_files", "referenced_files", "deleted_files"):
            kept["context"] = context
        if isinstance(m.get("thinking"), str) and m["thinking"] and not view.get("content", "").startswith(m["thinking"]):
            kept["thinking"] = m["thinking"]
    elif kind == "codex":
        if config := pick(_record(m.get("codex")), "model", "reasoning_effort"):
            kept["codex"] = config
        branches = [b for b in (_record(m.get(k)).get("branch") for k in ("git", "git_state")) if b is not None]
        kept |= {"git": {"branch": branches[0]}} if branches else {}
    return out | ({"metadata": kept} if kept else {})


#: Members of an atom that the frozen first version of the service shows.
SERVICE_V1 = {
    "schema_version": None, "id": None, "time": ("occurred_at", "observed_at", "duration_ms"), "source": ("app", "surface", "account", "raw_pointer"), "actors": ("role", "name", "model", "provider"),
    "action": ("kind", "verb", "input", "output", "status"), "artifacts": ("type", "provider", "id", "label", "locator"),
    "provenance": ("source_event_id", "raw_payload_hash", "extractor_version", "redacted_fields", "parse_warnings"), "context": ("visible", "selected", "ambient"),
    "state": ("snapshot", "delta"), "conversation": ("provider", "session_id", "turn_index", "parent_event_id"), "open_loop_hints": None, "warnings": None,
}


def service_atom(atom: dict) -> dict:
    def only(value, names):
        if names is None:
            return value
        if isinstance(value, list):
            return [only(v, names) for v in value]
        return {k: value[k] for k in names if k in value}

    return {k: only(atom[k], names) for k, names in SERVICE_V1.items() if k in atom}
