"""Tail source, session parsers, gate, written ledger and checkpoints."""

import json
import os

import pytest
from pyspark.sql import functions as F

from ledgerloom import tools
from ledgerloom.sources import checkpoints
from ledgerloom.sources import ledger as L
from ledgerloom.streaming import capture, jsonl
from ledgerloom.streaming.sessions import ClaudeParser, CodexParser

U7 = "01890000-0000-7000-8000-00000000000%d"


def said(role, text, **top):
    message = {"role": role, "content": text} | {k: top.pop(k) for k in ("stop_reason", "model") if k in top}
    return json.dumps({"type": role, "sessionId": "S", "isSidechain": False, "timestamp": "2026-01-01T00:00:00.000Z", "message": message} | top)


def fed(parser, lines):
    """Turns of lines, each as long as it is in a file."""
    out, at = [], 0
    for line in lines:
        end = at + len(line.encode()) + 1
        out += parser.feed(line, at, end, 1000)
        at = end
    return out


def test_claude_turns_close_with_the_next_question_or_the_end_of_an_answer():
    lines = [
        said("user", "first", uuid="u1", cwd="/w", gitBranch="main", permissionMode="auto"),
        said("assistant", [{"type": "tool_use", "id": "t1", "name": "Read", "input": {"file_path": "/w/a.py"}}, {"type": "thinking", "thinking": "hm"}]),
        said("user", [{"type": "tool_result", "tool_use_id": "t1", "content": [{"type": "text", "text": "old"}]}, {"type": "tool_result", "tool_use_id": "t1", "content": "new", "is_error": True}]),
        said("assistant", "done one", model="m"),
        "{broken",
        said("user", "second", uuid="u2"),
        said("user", "<system-reminder> x"),
        said("assistant", "done two", stop_reason="end_turn"),
        said("user", "third", uuid="u3"),
        said("user", "fourth", uuid="u4"),
        said("assistant", "half"),
    ]
    p = ClaudeParser("/h/.claude/projects/proj/S.jsonl")
    one, two = fed(p, lines)
    m = one["metadata"]
    assert one["content"] == "USER: first\n\nASSISTANT: done one" and m["tool_calls"] == [{"name": "Read", "call_id": "t1", "args": '{"file_path":"/w/a.py"}', "output": "new", "is_error": True}]
    assert (m["files_referenced"], m["thinking"], m["branch"], m["model"], m["repo_root"], m["permission_mode"]) == (["/w/a.py"], "hm", "main", "m", "/w", "auto")
    assert (m["thread_kind"], m["thread_id"], m["logical_turn_id"], m["observation_kind"], m["initiator"], m["project"]) == ("root", "S", "u1", "original", "human", "proj")
    assert two["content"] == "USER: second\n\nASSISTANT: done two" and two["turn_index"] == 1
    assert [(d["classification"], d["byte_count"]) for d in p.state["dropped"]] == [("prompt", 5)] and p.state["pending"]["question"] == "fourth"
    # What is held back is read again: the question that is still open is after the confirmed place.
    assert p.state["confirmed"] == sum(len(x.encode()) + 1 for x in lines[:9])


def test_claude_lineage_conflicts_make_the_thread_unknown():
    p = ClaudeParser("/h/.claude/projects/proj/S.jsonl")
    lines = [said("user", "a", uuid="u1", isSidechain=True, agentId="A"), said("assistant", "b", isSidechain=True, agentId="A", stop_reason="end_turn")]
    lines += [said("user", "c", uuid="u2"), said("assistant", "d", sessionId="other", stop_reason="end_turn"), said("user", "e", uuid="has space"), said("assistant", "f", stop_reason="end_turn")]
    kinds = [(t["metadata"]["thread_kind"], t["metadata"].get("thread_id"), t["metadata"]["observation_kind"], t["metadata"]["initiator"]) for t in fed(p, lines)]
    assert kinds == [("subagent", "A", "original", "agent"), ("unknown", None, "unknown", "human"), ("unknown", None, "unknown", "human")]


def rec(kind, payload, at="2026-01-01T00:00:00.000Z"):
    return json.dumps({"type": kind, "timestamp": at, "payload": payload})


def item(role, text, **more):
    return rec("response_item", {"type": "message", "role": role, "content": [{"type": "input_text" if role == "user" else "output_text", "text": text}]} | more)


DONE = rec("event_msg", {"type": "task_complete"})


def test_codex_turns_calls_and_identity():
    lines = [
        rec("session_meta", {"id": "T", "cwd": "/w", "git": {"branch": "b", "commit_hash": "c"}, "cli_version": "9"}),
        rec("turn_context", {"turn_id": U7 % 1, "model": "m", "effort": "high", "sandbox_policy": {"type": "ro"}}),
        item("user", "do it", turn_id=U7 % 1),
        rec("response_item", {"type": "function_call", "name": "sh", "call_id": "1", "arguments": "*** Update File: x.py\n*** Move to: y.py"}),
        rec("response_item", {"type": "function_call", "name": "sh", "call_id": "2", "arguments": {"deep": [{"path": "z.py"}]}}),
        rec("response_item", {"type": "function_call_output", "call_id": "1", "output": "Process exited with code 2"}),
        rec("response_item", {"type": "function_call_output", "output": {"content": "ok", "metadata": {"exit_code": 0}}}),
        rec("response_item", {"type": "reasoning", "summary": [{"text": "think"}, "more"]}),
        item("assistant", "did", turn_id=U7 % 1),
        DONE,
        item("user", "again", turn_id=U7 % 2), item("assistant", "no", turn_id=U7 % 3), DONE,
    ]
    one, two = fed(CodexParser("/h/.codex/sessions/s.jsonl"), lines)
    m = one["metadata"]
    assert m["tool_calls"][0]["is_error"] and m["tool_calls"][0]["output"].endswith("2") and m["tool_calls"][1]["output"] == "ok" and m["files_referenced"] == ["x.py", "y.py", "z.py"]
    assert (m["thread_kind"], m["root_thread_id"], m["logical_turn_id"], m["observation_kind"], m["thinking"]) == ("root", "T", U7 % 1, "original", "think\nmore")
    assert m["occurred_at"] == "2023-06-28T03:15:47.328Z"
    assert m["codex"]["model"] == "m" and m["codex"]["sandbox_policy_type"] == "ro" and m["git_state"]["head_sha"] == "c" and m["cwd"] == "/w"
    assert "logical_turn_id" not in two["metadata"] and two["metadata"]["observation_kind"] == "unknown"


def test_codex_subagents_copies_and_triggers():
    child = {"id": "C", "session_id": "R", "parent_thread_id": "P", "agent_path": "R/a", "timestamp": "2026-01-01T00:00:00Z"}
    parent = {"id": "P", "session_id": "R", "parent_thread_id": "R", "cwd": "/not/mine"}
    lines = [
        rec("session_meta", child | {"cwd": "/mine"}), rec("session_meta", parent), rec("session_meta", {"id": "R", "cwd": "/nor/this"}),
        item("user", "old", turn_id=U7 % 1), item("assistant", "copied", turn_id=U7 % 1),
        rec("inter_agent_communication_metadata", {"trigger_turn": True}),
        rec("response_item", {"type": "agent_message", "recipient": "R/a", "content": [{"type": "input_text", "text": "task"}]}),
        item("user", "<environment_context>"), item("assistant", "answer"), DONE,
        rec("response_item", {"type": "agent_message", "recipient": "R/a", "content": [{"type": "input_text", "text": "no mark"}]}), item("assistant", "orphan"),
    ]
    p = CodexParser("/h/.codex/sessions/x.jsonl")
    old, task = fed(p, lines)
    assert (old["metadata"]["observation_kind"], old["metadata"]["cwd"], old["metadata"]["thread_kind"], old["metadata"]["initiator"]) == ("inherited", "/mine", "subagent", "unknown")
    assert task["content"] == "USER: task\n\nASSISTANT: answer" and (task["metadata"]["observation_kind"], task["metadata"]["initiator"]) == ("original", "agent")
    assert p.state["pending"] is None
    named = CodexParser("/h/.codex/sessions/rollout-2026-" + U7 % 9 + ".jsonl")
    (turn,) = fed(named, [lines[0], item("user", "q"), item("assistant", "a"), DONE])
    assert turn["metadata"]["thread_kind"] == "unknown" and turn["metadata"]["session_id"] == U7 % 9 and "thread_id" not in turn["metadata"]


def test_batch_lines_cover_every_byte_once(spark, tmp_path, monkeypatch):
    body = "".join(f'{{"n": {i}, "x": "{"é" * (i % 50)}"}}\n' for i in range(300)) + "\n" + '{"unfinished'
    (tmp_path / "a.jsonl").write_text(body)
    (tmp_path / "other.txt").write_text("x\n")
    rows = jsonl.read_lines(spark, str(tmp_path)).orderBy("byte_start").collect()
    assert "".join(r.line + "\n" for r in rows) == body[: body.rfind("\n") + 1] and rows[0].byte_start == 0 and all(a.byte_end == b.byte_start for a, b in zip(rows, rows[1:], strict=False))
    monkeypatch.setattr(jsonl, "PAGE_BYTES", 97)
    reader = jsonl.JsonlBatchReader({"path": str(tmp_path)})
    parts = [r for p in reader.partitions() for r in reader.read(p)]
    whole = sorted(r for r in parts if r[5] is not None)
    starts = {r.byte_start: r.line for r in rows}
    assert all(starts[r[2]] == r[5] for r in whole) and {r[2] for r in whole} | {r[2] - r[6] * jsonl.FRAGMENT_BYTES for r in parts if r[5] is None} == set(starts)


def test_stream_reader_resumes_and_sees_rewrites(tmp_path):
    f = tmp_path / "a.jsonl"
    reader = jsonl.JsonlStreamReader({"path": str(tmp_path)})
    f.write_text("one\ntw")
    rows, at = reader.read(reader.initialOffset())
    assert [r[5] for r in rows] == ["one"]
    first = reader.initialOffset()
    with open(f, "a") as g:
        g.write("o\n\nthree\n")
    rows, then = jsonl.JsonlStreamReader({"path": str(tmp_path)}).read(at)
    assert [(r[5], r[1]) for r in rows] == [("two", 0), ("", 0), ("three", 0)]
    assert [r[5] for r in reader.readBetweenOffsets(first, then)] == ["one", "two", "", "three"]
    f.write_text("xne\ntwo\n\nthree\nfour\n")
    rows, after = reader.read(then)
    assert [(r[5], r[1]) for r in rows] == [("xne", 1), ("two", 1), ("", 1), ("three", 1), ("four", 1)]
    f.write_text("s\n")
    rows, _ = reader.read(after)
    assert [(r[5], r[1]) for r in rows] == [("s", 2)]
    assert jsonl.lag_bytes({str(f): 1}) == 1


def test_oversized_records_become_fragments(spark):
    raw = b"x" * (jsonl.PAGE_BYTES + 10) + b"\n"
    rows = jsonl.line_rows("/h/a.jsonl", 1, 0, 100, b"a\n" + raw + b"b\n")
    assert [r[5] for r in rows if r[5]] == ["a", "b"] and rows[-1][2] == 102 + len(raw)
    df = capture.fragments(spark.createDataFrame(rows, jsonl.SCHEMA))
    got = df.select(F.get_json_object("metadata", "$.byte_count").cast("int").alias("n"), F.get_json_object("metadata", "$.cluster_start_offset").cast("int").alias("s"), "dedupe_key").collect()
    assert sum(r.n for r in got) == len(raw) and {r.s for r in got} == {102} and len({r.dedupe_key for r in got}) == len(got) == 9


def test_capture_stream_is_exactly_once(spark, tmp_path):
    folder, book, check = tmp_path / "h" / ".claude" / "projects" / "p", str(tmp_path / "ledger"), str(tmp_path / "check")
    folder.mkdir(parents=True)
    f = folder / "S.jsonl"

    def run():
        q = capture.start_capture(spark, str(tmp_path / "h"), book, check, availableNow=True)
        q.awaitTermination(120)
        written = L.WrittenLedger(spark, book)
        return {r.content: json.loads(r.metadata)["turn_index"] for r in written.read().collect()} if any(n for _, n, _ in written.commits()) else {}

    f.write_text(said("user", "q1", uuid="u1", cwd="/w") + "\n" + said("assistant", "a1") + "\n")
    assert run() == {}
    with open(f, "a") as g:
        g.write(said("assistant", "b1", stop_reason="end_turn") + "\n" + said("user", "q2", uuid="u2") + "\n")
    assert run() == {"USER: q1\n\nASSISTANT: a1\n\nb1": 0}
    with open(f, "a") as g:
        g.write(said("assistant", "a2", stop_reason="end_turn") + "\n")
    assert run() == {"USER: q1\n\nASSISTANT: a1\n\nb1": 0, "USER: q2\n\nASSISTANT: a2": 1}
    # A lost checkpoint reads everything again and adds nothing.
    import shutil

    shutil.rmtree(check)
    assert len(run()) == 2 and L.WrittenLedger(spark, book).read().count() == 2
    t = tools.ContextTools(L.ingested(L.WrittenLedger(spark, book).read().select("id", "seq", "source", "timestamp", "ts", "content", "metadata")))
    assert t.search_memories(query="A2")["total_returned"] == 1
    batch = capture.turns(jsonl.read_lines(spark, str(tmp_path / "h")))
    assert batch.count() == 2


def test_gate_and_ledger_append(spark, tmp_path):
    rows = [("app:x", "2026-01-01T00:00:00", "a", None), ("app:no", "2026-01-01T00:00:00Z", "b", "{}"), ("fs:C:\\Dev\\P\\f", "2026-01-01T01:00:00+01:00", "c", None), ("git:/w/", "soon", "d", None), ("zip:x", "2026-01-01T00:00:00Z", "e", None), ("api:g", "2026-01-01T00:00:00Z", None, None), ("fs:/other", "2026-01-01T00:00:00Z", "f", None), ("app:x", "2026-01-01T00:00:00Z", "g", "[1]")]
    df = spark.createDataFrame(rows, "source string, timestamp string, content string, metadata string").withColumn("dedupe_key", F.col("content"))
    allowed = {"app": ["x"], "fs": ["c:/dev/p"], "git": ["/w"]}
    got = {(r.source, r.timestamp): r.reject_reason for r in capture.gate(df, allowed).collect()}
    assert sorted(got.values(), key=str) == sorted([None, "unknown_app", None, "invalid_timestamp", "malformed_event", "malformed_event", "unknown_path", "malformed_event"], key=str)
    book = L.WrittenLedger(spark, str(tmp_path / "book"))
    for _ in range(2):
        assert capture.capture(df, book, allowed).count() == 6
    stored = book.read().orderBy("seq").collect()
    assert [(r.source, r.timestamp, r.seq) for r in stored] == [("app:x", "2026-01-01T00:00:00.000Z", 1), ("fs:C:\\Dev\\P\\f", "2026-01-01T00:00:00.000Z", 2)] or len(stored) == 2
    assert [n for _, n, _ in book.commits()] == [2, 0]
    # A writer that lost the race compares again and adds only what is new.
    late = L.WrittenLedger(spark, str(tmp_path / "book"))
    real, calls = late._commit, []
    late._commit = lambda n, e: (calls.append(n), book.append(extra) if len(calls) == 1 else None, real(n, e))[2]
    extra = capture.ledger_rows(spark.createDataFrame([("app:x", "2026-01-02T00:00:00Z", "z", None, "k")], "source string, timestamp string, content string, metadata string, dedupe_key string"))
    assert late.append(extra) == 0 and len(calls) == 2 and book.read().count() == 3
    assert L.verified_copy(spark, book.read(), str(tmp_path / "copy")).first().verified
    with pytest.raises(Exception, match="unreadable timestamp"):
        L.canonical_times(df).collect()
    config = tmp_path / "c.json"
    assert capture.allowed_sources(str(config), allowed) == allowed
    config.write_text(json.dumps({"schema_version": 1, "updated_at": "x", "git_repos": ["/w/", "/v"]}))
    assert capture.allowed_sources(str(config), allowed)["git"] == ["/w", "/v"]
    config.write_text("{}")
    with pytest.raises(ValueError):
        capture.allowed_sources(str(config))


def test_checkpoints(spark, tmp_path):
    path = str(tmp_path / "ck")
    row = lambda r, n: ("codex", r, "", n, None, n, 0.0, "{}", "t")
    checkpoints.upsert(spark.createDataFrame([row(f"r{i}", i) for i in range(5)], checkpoints.SCHEMA), path)
    checkpoints.upsert(spark.createDataFrame([row("r1", 9)], checkpoints.SCHEMA), path)
    assert checkpoints.get(spark, path, "codex", "r1")["position"] == 9 and checkpoints.get(spark, path, "codex", "zz") is None
    first, at = checkpoints.page(checkpoints.current(spark, path), "codex", limit=3)
    rest, end = checkpoints.page(checkpoints.current(spark, path), "codex", at, limit=3)
    assert [r.resource for r in first + rest] == [f"r{i}" for i in range(5)] and at == ("r2", "") and end is None
    with pytest.raises(Exception, match="invalid checkpoint"):
        checkpoints.upsert(spark.createDataFrame([("codex", "", "", 1, None, 1, 0.0, None, "t")], checkpoints.SCHEMA), path)


def test_file_discovery(tmp_path):
    (tmp_path / "d").mkdir()
    for name in ("b.jsonl", "d/a.jsonl", "d/x.json"):
        (tmp_path / name).write_text("")
    assert [os.path.relpath(p, tmp_path) for p in jsonl.find_files(str(tmp_path))] == ["b.jsonl", "d/a.jsonl"]
