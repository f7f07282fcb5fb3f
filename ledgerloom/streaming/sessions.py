"""Session files to turns: what a person, an agent or a system asked, and what the assistant answered to it.

A parser takes the records of one file in order and gives turns as they close: with the next question, or with the mark that the answer is
done. The end of a file closes nothing. All that a parser knows between records is plain data, so that a stream keeps it as its state.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from datetime import UTC, datetime

from ..functions.text import ARGS_CHARS, FILE_KEYS, OUTPUT_CHARS, SYSTEM_PREFIXES, THINKING_CHARS
from ..wire import first_chars, n_chars, to_json

#: Calls that a turn keeps, and beginnings of records that a client puts in.
MOST_CALLS = 50
INJECTED = ("<system-reminder>", "<command-name>", "<command-message>", "<command-args>", "<command-stdout>", "<command-stderr>", "<local-command-stdout>", "<local-command-stderr>", "<local-command-caveat>")
UUID7 = re.compile(r"[0-9a-f]{8}-[0-9a-f]{4}-7[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}\Z", re.I)
ROLLOUT = re.compile(r"rollout-.*-([0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})\.jsonl\Z")
TOKEN = re.compile(r"[^\s\x00-\x1f\x7f]{1,512}\Z")
FAILED = re.compile(r"Process exited with code (?!0\b)\d+")
_BLANK = " \t\n\r\x0b\x0c\xa0﻿     　" + "".join(map(chr, range(0x2000, 0x200B)))


def some(value) -> str | None:
    """A string that is not empty."""
    return value if isinstance(value, str) and value else None


def record(value) -> dict | None:
    return value if isinstance(value, dict) else None


def iso_of(ms: int | float) -> str:
    at = datetime.fromtimestamp(ms / 1000, UTC)
    return at.strftime("%Y-%m-%dT%H:%M:%S.") + f"{at.microsecond // 1000:03d}Z"


def ms_of(text: str | None) -> float | None:
    try:
        at = datetime.fromisoformat(text) if text else None
    except ValueError:
        return None
    return None if at is None else (at if at.tzinfo else at.replace(tzinfo=UTC)).timestamp() * 1000


def uuid7_ms(identifier: str | None) -> int | None:
    return int(identifier.replace("-", "")[:12], 16) if identifier and UUID7.match(identifier) else None


def who_asked(text: str, otherwise: str) -> str:
    head = text.lstrip(_BLANK)
    if head.startswith(SYSTEM_PREFIXES):
        return "system"
    return "agent" if head.startswith("<teammate-message") else otherwise


def with_note(text: str, limit: int) -> tuple[str, bool]:
    n = n_chars(text)
    return (text, False) if n <= limit else (first_chars(text, limit) + f"\n[…truncated; {n - limit} chars dropped]", True)


def call_view(call: dict) -> dict:
    """A tool call as a turn keeps it: arguments and output within their limits."""
    out = {"name": call["name"]} | ({"call_id": call["id"]} if call.get("id") is not None else {})
    for key, raw, limit in (("args", call.get("args"), ARGS_CHARS), ("output", call.get("output"), OUTPUT_CHARS)):
        if raw is not None:
            out[key], cut = with_note(raw, limit)
            out |= {f"{key}_truncated": True} if cut else {}
    return out | ({"is_error": True} if call.get("is_error") else {})


def dedupe_key(extractor: str, path: str, session: str, offset: int, generation: int) -> str:
    """What a turn is known by, however often its file is read: of a file that was rewritten, also the generation."""
    parts = [path, session, offset] + ([f"source-generation:{generation}"] if generation else [])
    return f"{extractor}:{hashlib.sha256(to_json(parts).encode()).hexdigest()}"


class Parser:
    """The parts that both kinds of sessions share. ``state`` is plain data."""

    extractor = ""

    def __init__(self, path: str, state: dict | None = None):
        self.path = path
        self.state = state or {"pending": None, "turns": 0, "confirmed": 0, "dropped": [], **self.fresh()}

    def fresh(self) -> dict:
        return {}

    @property
    def session(self) -> str:
        return os.path.basename(self.path).removesuffix(".jsonl")

    def safe(self, end: int) -> None:
        """All up to ``end`` need not be read again, if nothing is held back."""
        if not self.holding():
            self.state["confirmed"] = max(self.state["confirmed"], end)

    def holding(self) -> bool:
        return self.state["pending"] is not None

    def feed(self, line: str, start: int, end: int, mtime_ms: int) -> list[dict]:
        """The turns that a record closes."""
        raise NotImplementedError

    def closed(self, mtime_ms: int) -> list[dict]:
        """The pending turn, if it has an answer."""
        p, s = self.state["pending"], self.state
        if p is None or not p["answers"]:
            return []
        turn = {"turn_index": s["turns"], "timestamp": p["timestamp"], "content": f"USER: {p['question']}\n\nASSISTANT: " + "\n\n".join(p["answers"]), "byte_offset": p["end"], "metadata": self.metadata(p, mtime_ms)}
        s["turns"] += 1
        s["confirmed"] = p["end"]
        return [turn]

    def metadata(self, p: dict, mtime_ms: int) -> dict:
        raise NotImplementedError

    def common(self, p: dict, mtime_ms: int) -> dict:
        return {"session_id": self.session, "turn_index": self.state["turns"], "mtime": mtime_ms, "byte_offset": p["end"]}


class ClaudeParser(Parser):
    """Records with a message of a user or an assistant. What tools did before a question, or between two, belongs to the question that follows."""

    extractor = "claude-code"

    def fresh(self) -> dict:
        return {"between": None, "cwd": None}

    def holding(self) -> bool:
        return self.state["pending"] is not None or self.state["between"] is not None

    @staticmethod
    def parsed(line: str) -> dict | None:
        try:
            obj = json.loads(line)
        except ValueError:
            return None
        message = record(obj.get("message")) if isinstance(obj, dict) else None
        if message is None or message.get("role") not in ("user", "assistant"):
            return None
        out = {"role": message["role"], "texts": [], "files": [], "uses": [], "results": [], "thinking": [], "tool": False}
        content = message.get("content")
        for block in [{"type": "text", "text": content}] if isinstance(content, str) else content if isinstance(content, list) else []:
            block = record(block) or {}
            kind = block.get("type")
            if kind == "text" and isinstance(block.get("text"), str):
                out["texts"].append(block["text"])
            elif kind == "thinking" and isinstance(block.get("thinking"), str) and block["thinking"].strip(_BLANK):
                out["thinking"].append(block["thinking"])
            elif kind == "tool_use":
                out["tool"] = True
                given = block.get("input")
                if some(block.get("id")) and some(block.get("name")):
                    args = None if given is None else given if isinstance(given, str) else to_json(given)
                    out["uses"].append({"id": block["id"], "name": block["name"], "args": args})
                out["files"] += [given[k] for k in FILE_KEYS if some(given.get(k))] if isinstance(given, dict) else []
            elif kind == "tool_result":
                out["tool"] = True
                if some(block.get("tool_use_id")):
                    said = block.get("content")
                    if isinstance(said, list):
                        said = "\n".join(b["text"] for b in said if isinstance(b, dict) and b.get("type") == "text" and isinstance(b.get("text"), str))
                    out["results"].append({"id": block["tool_use_id"], "output": said if isinstance(said, str) else "", "is_error": block.get("is_error") is True})
        out["text"] = "".join(out.pop("texts"))
        strict = {"session": ("sessionId", lambda v: bool(some(v) and v.strip(_BLANK))), "side": ("isSidechain", lambda v: isinstance(v, bool)), "agent": ("agentId", lambda v: bool(some(v) and v.strip(_BLANK)))}
        out["told"] = {k: obj[name] for k, (name, good) in strict.items() if name in obj and good(obj[name])}
        out["bad"] = any(name in obj and not good(obj[name]) for name, good in strict.values())
        uuid = obj.get("uuid")
        out["uuid"] = uuid if isinstance(uuid, str) and TOKEN.match(uuid) else None
        out["bad_uuid"] = "uuid" in obj and out["uuid"] is None
        out["timestamp"] = obj["timestamp"] if isinstance(obj.get("timestamp"), str) else None
        out |= {k: some(obj.get(name)) for k, name in (("cwd", "cwd"), ("branch", "gitBranch"), ("permission", "permissionMode"), ("version", "version"))}
        out["model"], out["done"] = some(message.get("model")), message["role"] == "assistant" and message.get("stop_reason") == "end_turn"
        return out

    @staticmethod
    def thread_kind(r: dict) -> str:
        told = r["told"]
        if r["bad"] or r["bad_uuid"] or "session" not in told or r["uuid"] is None:
            return "unknown"
        return {(False, False): "root", (True, True): "subagent"}.get((told.get("side"), "agent" in told), "unknown")

    @staticmethod
    def gather(into: dict, r: dict) -> None:
        into["tool"] |= r["tool"]
        for k in ("files", "uses", "results", "thinking"):
            into[k] += r[k]

    @staticmethod
    def conflicts(p: dict, r: dict) -> bool:
        return r["bad"] or any(v != p["told"].get(k) for k, v in r["told"].items())

    def feed(self, line, start, end, mtime_ms):
        s, r = self.state, self.parsed(line)
        if r is None:
            self.safe(end)
            return []
        s["cwd"] = r["cwd"] or s["cwd"]
        p = s["pending"]
        if r["text"] == "":
            if p is not None:
                p["kind"] = "unknown" if self.conflicts(p, r) else p["kind"]
                self.gather(p, r)
            elif r["tool"] or r["files"] or r["thinking"]:
                b = s["between"] = s["between"] or {"start": start, "tool": False, "files": [], "uses": [], "results": [], "thinking": [], "told": {}, "bad": False}
                b["bad"] |= r["bad"] or any(b["told"].get(k, v) != v for k, v in r["told"].items())
                b["told"] = r["told"] | b["told"]
                self.gather(b, r)
            self.safe(end)
            return []
        if r["role"] == "user":
            return self.asked(r, start, end, mtime_ms)
        if p is None:
            self.safe(end)
            return []
        p["kind"] = "unknown" if self.conflicts(p, r) else p["kind"]
        p["answers"].append(r["text"])
        p["end"], p["timestamp"], p["model"] = end, r["timestamp"] or p["timestamp"], r["model"] or p["model"]
        p["branch"], p["version"] = p["branch"] or r["branch"], p["version"] or r["version"]
        self.gather(p, r)
        if not r["done"]:
            return []
        out = self.closed(mtime_ms)
        s["pending"] = None
        self.safe(end)
        return out

    def asked(self, r, start, end, mtime_ms):
        s, p, b = self.state, self.state["pending"], self.state["between"]
        kind = self.thread_kind(r)
        if kind != "unknown" and b is not None and (b["bad"] or any(r["told"].get(k) != v for k, v in b["told"].items())):
            kind = "unknown"
        side, agent = r["told"].get("side") is True, "agent" in r["told"]
        initiator = who_asked(r["text"], "agent" if side and agent else "unknown" if side or agent else "human")
        if p is not None and not p["answers"] and p["initiator"] != "system" and initiator == "system":
            # A reminder never takes the place of a task that is still to be answered.
            p["kind"] = "unknown" if self.conflicts(p, r) else p["kind"]
            return []
        out = self.closed(mtime_ms)
        if p is not None and not p["answers"]:
            kind_of = "inject" if p["question"].lstrip(_BLANK).startswith(INJECTED) else "prompt"
            s["dropped"].append({"byte_offset": p["start"], "byte_count": len(p["question"].encode()), "classification": kind_of})
        first = b["start"] if b is not None else start
        s["confirmed"] = max(s["confirmed"], first)
        at = r["timestamp"] or iso_of(mtime_ms)
        s["pending"] = {
            "question": r["text"], "start": start, "asked_at": at, "timestamp": at, "answers": [], "end": end, "tool": False, "files": [], "uses": [], "results": [], "thinking": [], "kind": kind,
            "initiator": initiator, "told": r["told"], "uuid": r["uuid"], "cwd": s["cwd"], "branch": r["branch"], "permission": r["permission"], "version": r["version"], "model": None,
        }
        for part in (b, r):
            if part is not None:
                self.gather(s["pending"], part)
        s["between"] = None
        return out

    def metadata(self, p, mtime_ms):
        told, kind = p["told"], p["kind"]
        m = {"project": os.path.basename(os.path.dirname(self.path))} | self.common(p, mtime_ms)
        m |= {"logical_turn_id": p["uuid"]} if p["uuid"] is not None else {}
        original = kind == "root" or kind == "subagent" and p["initiator"] == "agent"
        m |= {"occurred_at": p["asked_at"], "observed_at": p["timestamp"], "observation_kind": "original" if original else "unknown", "initiator": p["initiator"]}
        if kind != "unknown":
            m |= {"thread_id": told["session"] if kind == "root" else told["agent"], "root_thread_id": told["session"]}
        m["thread_kind"] = kind
        m |= {"agent_id": told["agent"]} if kind == "subagent" else {}
        m |= {"had_tool_use": True} if p["tool"] else {}
        m |= {"repo_root": p["cwd"]} if p["cwd"] else {}
        m |= {"files_referenced": list(dict.fromkeys(p["files"]))} if p["files"] else {}
        if p["uses"]:
            last = {r["id"]: r for r in p["results"]}
            calls = [u | {k: v for k, v in last.get(u["id"], {}).items() if k != "id"} for u in p["uses"][:MOST_CALLS]]
            m |= {"tool_calls": [call_view(c) for c in calls], "tool_call_total": len(p["uses"])}
            m |= {"tool_calls_truncated": True} if len(p["uses"]) > MOST_CALLS else {}
        m |= {"thinking": with_note("\n\n".join(p["thinking"]), THINKING_CHARS)[0]} if p["thinking"] else {}
        m |= {name: p[k] for name, k in (("permission_mode", "permission"), ("cli_version", "version"), ("model", "model")) if p[k] is not None}
        if p["branch"] is not None:
            m |= {"git_state": {"captured_at": p["timestamp"], "fresh": False, "branch": p["branch"]}, "branch": p["branch"]}
        return m


LINEAGE = ("thread_id", "root_thread_id", "parent_thread_id", "forked_from_id", "thread_kind", "agent_path", "agent_depth", "agent_nickname", "history_mode", "session_started_at")


def agreed(*evidence: tuple[bool, str | None]) -> tuple[str | None, bool]:
    """The one value that evidence (malformed, value) tells, and whether it is in conflict."""
    values = {v for _, v in evidence if v is not None}
    bad = any(m for m, _ in evidence) or len(values) > 1
    return (None, True) if bad else (next(iter(values), None), False)


def evidence(rec: dict, key: str) -> tuple[bool, str | None]:
    if key not in rec:
        return False, None
    v = rec[key]
    return (False, v) if some(v) and v.strip(_BLANK) else (True, None)


def turn_identity(payload: dict) -> tuple[str | None, bool]:
    """The turn that a payload belongs to, told in one of two places, and whether that is malformed or in conflict."""
    inner = record(payload.get("internal_chat_message_metadata_passthrough")) or {}
    told = [p["turn_id"] for p in (payload, inner) if "turn_id" in p]
    good = [t for t in told if isinstance(t, str) and UUID7.match(t)]
    if len(good) < len(told) or len(set(good)) > 1:
        return None, True
    return (good[0] if good else None), False


def message_text(content) -> str:
    return "".join(b["text"] for b in content if isinstance(b, dict) and b.get("type") in ("input_text", "output_text") and isinstance(b.get("text"), str)) if isinstance(content, list) else ""


def session_meta(p: dict, timestamp: str | None) -> dict:
    """Lineage, settings and place of a session's header. Lineage that is incomplete, malformed or in conflict is unknown as a whole."""
    out: dict = {}
    spawn = record((record((record(p.get("source")) or {}).get("subagent")) or {}).get("thread_spawn")) or {}
    own, root, forked = evidence(p, "id"), evidence(p, "session_id"), evidence(p, "forked_from_id")
    parent, parent_bad = agreed(evidence(p, "parent_thread_id"), evidence(spawn, "parent_thread_id"))
    agent, agent_bad = agreed(evidence(p, "agent_path"), evidence(spawn, "agent_path"))
    conflict = own[0] or root[0] or forked[0] or parent_bad or agent_bad or None not in (parent, forked[1]) and parent != forked[1]
    kind = p.get("thread_source")
    nested = isinstance(p.get("source"), dict) and isinstance(p["source"].get("subagent"), dict)
    as_subagent = kind == "subagent" or nested or any(v is not None for v in (parent, forked[1], agent))
    lineage = {"thread_kind": "unknown"}
    if not conflict and own[1] is not None:
        if as_subagent and kind in (None, "subagent") and root[1] is not None and root[1] != own[1]:
            lineage = {"thread_id": own[1], "root_thread_id": root[1], "parent_thread_id": parent, "forked_from_id": forked[1], "agent_path": agent, "thread_kind": "subagent"}
        elif not as_subagent and kind in (None, "root", "user") and root[1] in (None, own[1]):
            lineage = {"thread_id": own[1], "root_thread_id": own[1], "thread_kind": "root"}
    depth = spawn.get("depth")
    if isinstance(depth, int) and not isinstance(depth, bool) and depth >= 0:
        lineage["agent_depth"] = depth
    lineage |= {"agent_nickname": some(spawn.get("agent_nickname")), "history_mode": some(p.get("history_mode")), "session_started_at": some(p.get("timestamp")) or timestamp}
    out["meta"] = {k: v for k, v in (lineage | {k: some(p.get(k)) for k in ("source", "cli_version", "model_provider")}).items() if v is not None}
    out["cwd"] = some(p.get("cwd"))
    git = record(p.get("git")) or {}
    out["git"] = {k: git[n] for k, n in (("sha", "commit_hash"), ("branch", "branch"), ("origin_url", "repository_url")) if some(git.get(n))}
    return out


def turn_settings(p: dict) -> dict:
    """What a turn's context says of model, sandbox and permissions."""
    box, rights, files = record(p.get("sandbox_policy")) or {}, record(p.get("permission_profile")) or {}, record(p.get("file_system_sandbox_policy")) or {}
    flag = lambda v: v if isinstance(v, bool) else None
    roots = list(dict.fromkeys(r for r in box["writable_roots"] if some(r))) if isinstance(box.get("writable_roots"), list) else None
    out = {
        "model": some(p.get("model")), "reasoning_effort": some(p.get("effort")), "personality": some(p.get("personality")), "approval_policy": some(p.get("approval_policy")),
        "sandbox_policy_type": some(box.get("type")), "sandbox_network_access": flag(box.get("network_access")), "sandbox_writable_roots": roots or None,
        "sandbox_exclude_tmpdir_env_var": flag(box.get("exclude_tmpdir_env_var")), "sandbox_exclude_slash_tmp": flag(box.get("exclude_slash_tmp")),
        "permission_profile_type": some(rights.get("type")), "permission_file_system_type": some((record(rights.get("file_system")) or {}).get("type")), "permission_network": some(rights.get("network")),
        "file_system_sandbox_kind": some(files.get("kind")),
    }
    return {k: v for k, v in out.items() if v is not None}


PATCHED = (re.compile(r"^\*\*\* (?:Add|Update|Delete) File: (.+)$", re.M), re.compile(r"^\*\*\* Move to: (.+)$", re.M))


def files_of_args(args: str) -> list[str]:
    """Files that the arguments of a tool name: in headers of patches, and, if they are JSON, under the keys for files, at any depth."""
    out = [m.strip(_BLANK) for rule in PATCHED for m in rule.findall(args)]

    def walk(v) -> None:
        if isinstance(v, str):
            out.extend(m.strip(_BLANK) for rule in PATCHED for m in rule.findall(v))
        elif isinstance(v, list):
            for x in v:
                walk(x)
        elif isinstance(v, dict):
            for k, x in v.items():
                if k in FILE_KEYS and some(x):
                    out.append(x)
                walk(x)

    try:
        walk(json.loads(args))
    except ValueError:
        pass
    return [f for f in dict.fromkeys(out) if f]


class CodexParser(Parser):
    """Records of a header, contexts, messages, calls and marks. Identity of a turn is told by its context, question and answer; if these
    differ, it has none. A message to an agent opens a turn only right after the mark that it does, and only to the session's own agent."""

    extractor = "codex"

    def fresh(self) -> dict:
        return {"meta": None, "cwd": None, "git": None, "chain": True, "frontier": [], "queued": None, "trigger": None}

    @property
    def session(self) -> str:
        return self.physical or super().session

    @property
    def physical(self) -> str | None:
        m = ROLLOUT.match(os.path.basename(self.path))
        return m and m[1]

    def holding(self) -> bool:
        s = self.state
        return s["pending"] is not None or s["queued"] is not None or s["trigger"] is not None

    # Header ----------------------------------------------------------------------------------------------------------------------------
    def settled(self, meta: dict) -> dict:
        """A header's lineage, unknown where the file's name tells another thread."""
        named, kind = self.physical, meta.get("thread_kind")
        if named is None or kind == "unknown" or "thread_id" in meta and meta["thread_id"].lower() == named.lower():
            return meta
        return self.unknown(meta) if kind in ("root", "subagent") else meta

    @staticmethod
    def unknown(meta: dict) -> dict:
        return {k: v for k, v in meta.items() if k not in LINEAGE} | {"thread_kind": "unknown"}

    @staticmethod
    def ancestors(meta: dict) -> list[str]:
        named = [meta.get("parent_thread_id"), meta.get("forked_from_id")] if meta.get("thread_kind") == "subagent" else []
        return list(dict.fromkeys(x for x in named if x))

    def copied_from(self, now: dict, new: dict) -> list[str] | None:
        """The ancestors that may follow, if a header is a copy of the next ancestor's; else null."""
        if not self.state["chain"] or now.get("thread_kind") != "subagent" or "thread_id" not in new or new.get("root_thread_id") != now.get("root_thread_id"):
            return None
        if new.get("thread_kind") == "root":
            return [] if new["thread_id"] == now["root_thread_id"] else None
        if new.get("thread_kind") != "subagent" or new["thread_id"] not in self.state["frontier"]:
            return None
        following = self.ancestors(new)
        return following if following and new["thread_id"] not in following and now.get("thread_id") not in following else None

    def header(self, payload: dict, timestamp: str | None, end: int) -> None:
        s, told = self.state, session_meta(payload, timestamp)
        now, new = s["meta"] or {}, told["meta"]
        own = True
        if "thread_kind" not in now:
            s["meta"] = self.settled(now | new)
        else:
            following = self.copied_from(now, new) if "unknown" not in (now["thread_kind"], new["thread_kind"]) else None
            same = all(now.get(k) == new.get(k) is not None for k in ("thread_kind", "thread_id", "root_thread_id")) and not any(now.get(k, v) != v for k, v in new.items() if k in LINEAGE)
            if following is not None:
                s["frontier"], s["chain"] = following, bool(following)
                return
            own = same and now["thread_kind"] != "unknown"
            s["meta"] = now | new if own else self.unknown(now)
        s["frontier"] = self.ancestors(s["meta"]) if own else []
        if own:
            s["cwd"] = told["cwd"] or s["cwd"]
            s["git"] = ((s["git"] or {}) | told["git"]) or None
        self.safe(end)

    # Records ---------------------------------------------------------------------------------------------------------------------------
    def forget_trigger(self, identity_too: bool = False) -> None:
        s = self.state
        s["trigger"] = None
        if s["queued"] is not None and (identity_too or s["queued"]["agent"]):
            s["queued"] = None

    def queue(self, start: int, turn: str | None, conflict: bool, agent: bool) -> None:
        q = self.state["queued"] or {"start": start, "turn": None, "conflict": False, "agent": False}
        q["conflict"] |= conflict or None not in (q["turn"], turn) and q["turn"] != turn
        q["turn"], q["start"], q["agent"] = q["turn"] or turn, min(q["start"], start), q["agent"] or agent
        self.state["queued"] = q

    def feed(self, line, start, end, mtime_ms):
        s = self.state
        try:
            obj = json.loads(line)
        except ValueError:
            obj = None
        if not isinstance(obj, (dict, list)):
            s["chain"], s["frontier"] = False, []
            self.forget_trigger(True)
            self.safe(end)
            return []
        obj = record(obj) or {}
        payload, timestamp = record(obj.get("payload")), obj["timestamp"] if isinstance(obj.get("timestamp"), str) else None
        kind, body = obj.get("type"), payload or {}
        if kind == "session_meta":
            self.header(body, timestamp, end)
            return []
        s["chain"], s["frontier"] = False, []
        if kind == "inter_agent_communication_metadata":
            if body.get("trigger_turn") is True:
                s["trigger"] = start
                if s["queued"] is not None:
                    s["queued"]["agent"] = True
            else:
                self.forget_trigger()
            self.safe(end)
            return []
        if kind == "turn_context":
            self.context(body, start, end)
            return []
        item = body.get("type") if kind == "response_item" else None
        if item == "agent_message":
            return self.question(body, timestamp, start, end, mtime_ms, agent=True)
        asked = item == "message" and body.get("role") == "user"
        self.forget_trigger(identity_too=not asked)
        if asked:
            return self.question(body, timestamp, start, end, mtime_ms, agent=False)
        p, out = s["pending"], []
        if kind == "event_msg" and body.get("type") == "task_complete":
            if p is not None and p["answers"]:
                p["end"] = end
                out, s["pending"] = self.closed(mtime_ms), None
        elif item == "message" and body.get("role") == "assistant":
            if p is not None:
                self.answer(p, body, timestamp, end)
                return []
        elif p is not None and item in ("function_call", "custom_tool_call"):
            args = body.get("arguments")
            args = args if args is None or isinstance(args, str) else to_json(args)
            p["tool"], p["calls_total"] = True, p["calls_total"] + 1
            p["files"] += files_of_args(args) if args else []
            if len(p["calls"]) < MOST_CALLS:
                p["calls"].append({"name": some(body.get("name")) or "?", "args": args, "id": some(body.get("call_id"))})
        elif p is not None and item in ("function_call_output", "custom_tool_call_output"):
            p["tool"] = True
            self.result(p, body)
        elif p is not None and item == "reasoning":
            parts = body.get("summary")
            if isinstance(parts, list):
                said = [x["text"] if isinstance(x, dict) else x for x in parts if isinstance(x, str) or isinstance(x, dict) and isinstance(x.get("text"), str)]
                p["thinking"] += ["\n".join(said)] if said else []
            elif isinstance(body.get("text"), str):
                p["thinking"].append(body["text"])
        self.safe(end)
        return out

    def context(self, body: dict, start: int, end: int) -> None:
        s, p = self.state, self.state["pending"]
        s["cwd"] = some(body.get("cwd")) or s["cwd"]
        s["meta"] = ((s["meta"] or {}) | turn_settings(body)) or None
        turn, conflict = turn_identity(body)
        if turn is not None or conflict:
            if p is not None and (not p["answers"] or turn is not None and turn in (p["context_turn"], p["user_turn"], p["assistant_turn"])):
                p["conflict"] |= conflict or None not in (p["context_turn"], turn) and p["context_turn"] != turn
                p["context_turn"] = p["context_turn"] or turn
            else:
                self.queue(start, turn, conflict, s["trigger"] is not None)
        self.safe(end)

    def question(self, body, timestamp, start, end, mtime_ms, agent):
        s, meta = self.state, self.state["meta"] or {}
        text, (turn, conflict) = message_text(body.get("content")), turn_identity(body)
        trigger = s["trigger"]
        if agent:
            s["trigger"] = None
            to = some(body.get("recipient"))
            if trigger is None or meta.get("thread_kind") != "subagent" or to is None or to != meta.get("agent_path"):
                s["queued"] = None
                self.safe(end)
                return []
        p = s["pending"]
        initiator = who_asked(text, "agent" if agent else "unknown" if meta.get("thread_kind") == "subagent" else "human")
        if p is not None and not p["answers"] and p["initiator"] != "system" and initiator == "system":
            return []
        out = self.closed(mtime_ms)
        if p is not None and not p["answers"] and p["initiator"] == "system":
            self.queue(p["start"], p["context_turn"], p["conflict"], False)
        q, s["queued"] = s["queued"], None
        first = min([start, *([trigger] if agent else []), *([q["start"]] if q else [])])
        s["confirmed"] = max(s["confirmed"], first)
        at, given = timestamp or iso_of(mtime_ms), q["turn"] if q else None
        s["pending"] = {
            "question": text, "start": first, "asked_at": at, "timestamp": at, "answers": [], "end": end, "tool": False, "calls": [], "calls_total": 0, "files": [], "thinking": [], "initiator": initiator,
            "local": agent, "context_turn": given, "user_turn": turn, "assistant_turn": None, "conflict": conflict or bool(q and q["conflict"]) or None not in (given, turn) and given != turn,
            "cwd": s["cwd"], "git": s["git"], "meta": s["meta"],
        }
        return out

    @staticmethod
    def answer(p: dict, body: dict, timestamp: str | None, end: int) -> None:
        text, (turn, conflict) = message_text(body.get("content")), turn_identity(body)
        if not text:
            return
        p["answers"].append(text)
        p["end"], p["timestamp"] = end, timestamp or p["timestamp"]
        p["conflict"] |= conflict or None not in (turn, p["assistant_turn"]) and turn != p["assistant_turn"]
        p["assistant_turn"] = turn or p["assistant_turn"]

    @staticmethod
    def result(p: dict, body: dict) -> None:
        """An output belongs to the latest call without one, of the same id where it tells one."""
        said, failed = body.get("output"), False
        if isinstance(said, dict):
            code = (record(said.get("metadata")) or {}).get("exit_code")
            failed = isinstance(code, (int, float)) and not isinstance(code, bool) and code != 0
            said = next((said[k] for k in ("content", "text") if isinstance(said.get(k), str)), None)
        said = said if isinstance(said, str) else None
        failed |= said is not None and FAILED.search(said) is not None
        wanted = some(body.get("call_id"))
        for call in reversed(p["calls"]):
            if call.get("output") is None and (wanted is None or call["id"] == wanted):
                call |= ({"output": said} if said is not None else {}) | ({"is_error": True} if failed else {})
                return

    @staticmethod
    def observation(p: dict, turn: str | None, conflict: bool) -> str:
        """original, inherited (copied from before the session began, by more than a second) or unknown."""
        meta, user, assistant = p["meta"] or {}, p["user_turn"], p["assistant_turn"]
        if conflict or None not in (user, assistant) and user != assistant:
            return "unknown"
        if meta.get("thread_kind") == "root":
            return "original"
        if meta.get("thread_kind") != "subagent":
            return "unknown"
        if p["local"]:
            return "original"
        at, began = uuid7_ms(turn), ms_of(meta.get("session_started_at"))
        told = turn is not None and user is not None and user == assistant
        return "inherited" if told and None not in (at, began) and at + 1000 < began else "unknown"

    def metadata(self, p, mtime_ms):
        named = [t for t in (p["assistant_turn"], p["user_turn"], p["context_turn"]) if t is not None]
        conflict = p["conflict"] or len(set(named)) > 1
        turn = named[0] if named and not conflict else None
        m = self.common(p, mtime_ms) | ({"logical_turn_id": turn} if turn else {})
        at = uuid7_ms(turn)
        m |= {"occurred_at": iso_of(at) if at is not None else p["asked_at"], "observed_at": p["timestamp"], "observation_kind": self.observation(p, turn, conflict), "initiator": p["initiator"]}
        m |= {"had_tool_use": True} if p["tool"] else {}
        m |= {"cwd": p["cwd"], "repo_root": p["cwd"]} if p["cwd"] else {}
        m |= {"git": p["git"]} if p["git"] else {}
        if p["meta"]:
            m |= {"codex": p["meta"]} | {k: p["meta"][k] for k in LINEAGE if k != "session_started_at" and k in p["meta"]}
        m |= {"tool_calls": [call_view(c) for c in p["calls"]]} if p["calls"] else {}
        if p["calls_total"]:
            m |= {"tool_call_total": p["calls_total"]} | ({"tool_calls_truncated": True} if p["calls_total"] > len(p["calls"]) else {})
        m |= {"files_referenced": list(dict.fromkeys(p["files"]))} if p["files"] else {}
        m |= {"thinking": with_note("\n\n".join(p["thinking"]), THINKING_CHARS)[0]} if p["thinking"] else {}
        state = {k: v for k, v in (("head_sha", (p["git"] or {}).get("sha")), ("branch", (p["git"] or {}).get("branch"))) if v}
        return m | ({"git_state": {"captured_at": p["timestamp"], "fresh": False} | state} if state else {})


def parser_for(path: str) -> type[Parser]:
    return CodexParser if "/.codex/" in path or ROLLOUT.match(os.path.basename(path)) else ClaudeParser
