"""The query surface over the fork-storm fixture and over rows made for single rules."""

import json
from datetime import UTC, datetime, timedelta

import pytest

from ledgerloom import cursors, tools, wire
from ledgerloom.sources import workspace

from .forkstorm import SINCE, UNTIL, rows

SCHEMA = "id string, source string, timestamp string, content string, metadata string"
NOW = datetime(2026, 7, 22, 15, tzinfo=UTC)


def over(spark, data, **args):
    made = [(*r[:4], r[4] if r[4] is None or isinstance(r[4], str) else json.dumps(r[4])) for r in data]
    return tools.ContextTools(workspace.materialized_rows(tools.from_events(spark.createDataFrame(made, SCHEMA).coalesce(1)), "book"), **({"now": lambda: NOW, "sleep": lambda s: None} | args))


@pytest.fixture(scope="module")
def storm(spark):
    return over(spark, rows())


def test_fork_storm_clusters(storm):
    out = storm.find_clusters(SINCE, UNTIL)
    assert (len(rows()), out["result_caps"]["atoms_total_in_window"], out["result_caps"]["source_breakdown"]) == (460, 123, {"codex": 85, "claude_code": 38})
    sizes = sorted((len(c["atom_ids"]) for c in out["clusters"]), reverse=True)
    assert sizes == [24, 24, 24, 19, 19, 7, 6] and out["warnings"] == [] and wire.size(out) < 10_000
    assert [c["rank"] for c in out["clusters"]] == list(range(1, 8)) and not out["result_caps"]["truncated"]
    compact = storm.find_clusters(SINCE, UNTIL, view="compact")
    assert wire.size(compact) < wire.size(out)


def test_fork_storm_groups(storm):
    project = storm.find_clusters(SINCE, UNTIL, group_by="project")
    thread = storm.find_clusters(SINCE, UNTIL, group_by="thread")
    assert (len(project["groups"]), len(thread["groups"])) == (3, 7)
    assert sum(len(g["representative_atom_ids"]) for g in project["groups"]) == 9 and sum(len(g["representative_atom_ids"]) for g in thread["groups"]) == 21
    assert {g["canonical_root"]: (g["unique_turn_count"], g["collapsed_observation_count"], g["thread_count"]) for g in project["groups"]} == {"/workspace/brain": (72, 282, 3), "/workspace/context": (38, 55, 2), "/workspace/hdc": (13, 0, 2)}
    ids, pages = [], 0
    for g in project["groups"]:
        ids += g["representative_atom_ids"]
        cursor = g["membership_cursor"]
        while cursor:
            page = storm.find_clusters(cursor=cursor)
            ids, cursor, pages = ids + page["membership_page"]["atom_ids"], page["next_cursor"], pages + 1
    assert len(ids) == len(set(ids)) == 123 and pages == 4
    first = storm.find_clusters(SINCE, UNTIL, group_by="thread", page_size=5)
    second = storm.find_clusters(cursor=first["next_cursor"])
    assert len(first["groups"]) == 5 and len(second["groups"]) == 2 and second["next_cursor"] is None
    with pytest.raises(ValueError, match="cursor-only"):
        storm.find_clusters(SINCE, cursor=first["next_cursor"])
    body = cursors.unsealed(first["next_cursor"], 16_384)
    with pytest.raises(cursors.CursorError, match="STALE"):
        storm.find_clusters(cursor=cursors.sealed(body | {"d": "0" * 64}, 16_384))


def test_fork_storm_context_and_project_scope(storm):
    out = storm.recent_work_context(SINCE, UNTIL, limit=500, repo_path="/workspace/hdc")
    assert len(out["clusters"]) == 2 and len(out["atoms"]) == 13
    atom = next(iter(out["atoms"].values()))
    assert atom["conversation"]["thread_kind"] == "root" and atom["project"]["canonical_root"] == "/workspace/hdc"
    assert set(wire.service_atom(atom)["conversation"]) == {"provider", "session_id", "turn_index"}
    small = storm.recent_work_context(SINCE, UNTIL, limit=30)
    assert len(small["atoms"]) == 30 and small["truncation"]["truncated"] and sum(len(c["atom_ids"]) for c in small["clusters"]) == 30
    assert any("limit dropped 5 entire" in w for w in small["warnings"])
    assert wire.size(tools.capped_context(out, 4000)) < 4000


def turn(i, at, user, assistant, **meta):
    stamp = (datetime(2026, 7, 22, 12, tzinfo=UTC) + timedelta(minutes=at)).strftime("%Y-%m-%dT%H:%M:%S.000Z")
    return (i, "fs:/home/user/.codex/sessions/a.jsonl", stamp, f"USER: {user}\n\nASSISTANT: {assistant}", {"session_id": "s1", "repo_root": "/w"} | meta)


def test_open_loops_and_their_resolvers(spark):
    data = [
        turn("a", 0, "Why?", ""), turn("b", 1, "Again?", ""), turn("c", 2, "It works.", "Shall I go on?"), turn("d", 3, "", "note"), turn("e", 4, "Yes. TODO: fix it\nmore", "fine", files_referenced=["/w/x.py"]),
        turn("f", 5, "we follow up on this\nlater", "ok"), turn("g", 6, "Is that so?", "It is."), turn("h", 7, "From an agent?", "", initiator="agent"),
    ]
    out = over(spark, data).recent_work_context("2026-07-22T11:00:00Z", "2026-07-22T13:00:00Z", limit=50)
    (cluster,) = out["clusters"]
    got = {(h["atom_id"], h["kind"]): (h["text"], h["resolved"], h.get("resolved_by_atom_id")) for h in cluster["open_loop_hints"]}
    assert got == {
        ("a", "ends_with_question"): ("Why?", True, "d"), ("b", "ends_with_question"): ("Again?", True, "d"), ("c", "unresolved_assistant_q"): ("Shall I go on?", True, "d"),
        ("e", "contains_todo"): ("TODO: fix it", False, None), ("f", "explicit_followup"): ("we follow up on this", False, None), ("g", "ends_with_question"): ("Is that so?", True, "g"),
    }
    assert "has_unresolved_open_loop" in cluster["rank_reason"] and "dense" in cluster["rank_reason"]


def test_search(spark):
    data = [(f"r{i}", "app:notes", f"2026-07-22T12:00:{i % 7:02d}.000Z", f"Text {i} of THE day_%", {"session_id": f"s{i % 3}"}) for i in range(40)]
    data += [("f", "fs:/x", "2026-07-22T12:30:00Z", "the day", {"surface": "fs"}), ("k", "coord:role", "2026-07-22T12:31:00Z", "the day", {"surface": "coord"}), ("n", "app:notes", "bad", "the day", None), ("t", "app:team", "2026-07-22T09:00:00+02:00", "x", {"decision_atom_type": "team_decision", "normalized_subject": "Price"})]
    t = over(spark, data)
    seen, cursor = [], None
    while True:
        page = t.search_memories(query="the DAY_%", limit=15, cursor=cursor)
        seen += [m["id"] for m in page["matches"]]
        cursor = page["next_cursor"]
        if cursor is None:
            break
    assert sorted(seen) == sorted(f"r{i}" for i in range(40)) and len(seen) == 40
    assert [m["id"] for m in t.search_memories(source_prefix="coord:")["matches"]] == ["k"]
    assert [m["id"] for m in t.search_memories(metadata_match={"canonical_subject": ["Price", "Cost"]})["matches"]] == ["t"]
    assert t.search_memories(source_prefix="app:team")["matches"][0]["timestamp"] == "2026-07-22T07:00:00.000Z"
    both = t.search_memories(source="app:notes", source_app="git", since="2026-07-22T12:00:06")
    assert len(both["matches"]) == 5 and [w.split("]")[0] for w in both["warnings"]] == ["[SOURCE_SELECTOR_PRECEDENCE", "[TZ"]
    with pytest.raises(ValueError, match="cannot be matched"):
        t.search_memories(metadata_match={"other": "x"})
    with pytest.raises(ValueError, match="absolute"):
        t.search_memories(repo_path="w")
    long = t.search_memories(query="x" * 9000)
    assert any("ECHO_CAP" in w for w in long["warnings"]) and wire.size(long["query_echo"]) <= 4096


def test_search_answer_is_bounded(spark):
    data = [(f"r{i:02d}", "app:n", f"2026-07-22T12:00:{i:02d}Z", "é" * 40_000, {f"k{j}": "v" * 300 for j in range(60)}) for i in range(20)]
    page = over(spark, data).search_memories(limit=20)
    assert wire.size(page) <= 25_000 and 0 < len(page["matches"]) < 20 and page["next_cursor"] and any("RESPONSE_CAP" in w for w in page["warnings"])
    m = page["matches"][0]
    assert m["bytes_elided"] == 78_000 and m["metadata_keys_omitted"] > 0 and m["truncations"] == ["content", "metadata"]


def test_current_signals(spark):
    manifest = lambda i, run, done, ids, **more: (i, "derived:granola-signals-index", "2026-07-22T12:00:00Z", "", {"note_id": "n1", "extractor_version": "1", "extraction_run_id": run, "completed_at": done, "signal_atom_ids": ids} | more)
    signal = lambda i: (i, "derived:granola-signals", "2026-07-22T12:00:00Z", i, {"signal_type": "t"})
    data = [signal("a"), signal("b"), signal("c"), manifest("m1", "r1", "2026-07-01", ["a"]), manifest("m2", "r2", "2026-07-03", ["b"]), manifest("m3", "r3", "2026-07-02", ["c"], supersedes="r2"), manifest("m4", "r4", "2026-08-01", [5])]
    t = over(spark, data)
    assert [m["id"] for m in t.search_memories(metadata_match={"signal_type": "t"})["matches"]] == ["c"]
    assert {m["id"] for m in t.search_memories()["matches"]} >= {"a", "b", "c"}


def test_hydration(spark):
    data = [(f"r{i}", "app:n", f"2026-07-22T12:00:{i:02d}Z", "t" * 1500, {"repo_root": "/w", "other": 1}) for i in range(40)]
    t = over(spark, [*data, ("big", "app:n", "2026-07-22T12:00:00Z", "x" * 30_000, None)])
    asked = ["r3", "none", "r1", "r3"]
    out = t.get_atoms(asked)
    assert [a["id"] for a in out["atoms"]] == ["r3", "r1", "r3"] and out["atoms_dropped_ids"] == ["none"] and out["atoms_missing"] == 1
    assert [a["id"] for a in t.get_atoms(asked, prefer="newest_first")["atoms"]] == ["r3", "r1"]
    lean = t.get_atoms(["r1"], fields=["metadata"], view="compact")["atoms"][0]
    assert lean["metadata"] == {"repo_root": "/w"} and "content" not in lean and lean["truncations"] == ["fields_omitted"]
    every, cursor, pages = [], None, 0
    want = [f"r{i}" for i in range(40)] + ["gone"]
    while True:
        page = t.get_atoms(want, cursor=cursor)
        assert wire.size(page) <= 25_000 and page["atoms_missing"] + page["atoms_deferred"] == page["atoms_dropped"]
        every, cursor, pages = every + [a["id"] for a in page["atoms"]], page["next_cursor"], pages + 1
        if cursor is None:
            break
    assert every == want[:-1] and pages > 1
    with pytest.raises(cursors.CursorError, match="MISMATCH"):
        t.get_atoms(want[:-1], cursor=t.get_atoms(want)["next_cursor"])
    assert t.get_atom("r1")["atom"]["content"] == "t" * 1500
    assert (t.get_atom("big")["error_code"], t.get_atom("zz")["error_code"]) == ("atom_too_large_for_wire", "atom_not_found")
    assert "next_cursor" not in t.service("atoms", atom_ids=["r1"]) and t.service("ping", message="m")["received"] == "m"


def test_newest_sources_and_new_turns(spark):
    at = lambda m: f"2026-07-22T12:{m:02d}:00.000Z"
    codex = "fs:/home/user/.codex/sessions/%s.jsonl"
    data = [("a", codex % "x", at(1), "", {"observation_kind": "original"}), ("b", codex % "y", at(2), "", {"observation_kind": "inherited"}), ("g", "git:/w", at(3), "", None), ("h", "git:/other", at(4), "", {"project_key": "local:workspace:/other"})]
    data += [(f"t{i:02d}", "app:team", at(10 + min(i, 15)), "", None) for i in range(30)]
    t = over(spark, data)
    out = t.resolve_mru(["codex", "git", "app:team", "app:none"])["sources"]
    assert {k: v and v["source"] for k, v in out.items()} == {"codex": codex % "x", "git": "git:/other", "app:team": "app:team", "app:none": None}
    assert t.resolve_mru(["git"], repo_path="/w")["sources"]["git"]["source"] == "git:/w"
    first = t.wait_for_new_turns(at(0), sources=["codex", "git"])
    assert first["turn_ids"] == ["a", "g", "h"] and first["next_since"] == at(4)
    page = t.wait_for_new_turns(at(4), source_prefix="app:")
    assert page["turn_ids"] == [f"t{i:02d}" for i in range(30)] and page["next_since"] == at(25) and "more than 20" in page["warnings"][0]
    assert t.wait_for_new_turns(at(25), source_prefix="app:", timeout=0)["timed_out"]
    late = over(spark, [("z", "app:q", "2026-07-23T00:00:00Z", "", None)]).wait_for_new_turns(at(0), sources=["app:q"])
    assert late["next_since"] == "2026-07-22T15:00:00.000Z" and "[NEXT_SINCE_CLAMP]" in late["warnings"][0]


def test_late_rows_and_auto_expand(spark):
    late = turn("late", 500, "captured later", "yes", occurred_at="2026-07-22T12:05:00Z")
    before = turn("early", -200, "too early", "no")
    out = over(spark, [late, before, turn("in", 6, "on time", "yes")]).recent_work_context("2026-07-22T12:00:00Z", "2026-07-22T12:30:00Z")
    assert set(out["atoms"]) == {"late", "in"} and len(out["clusters"]) == 1
    old = over(spark, [turn("x", -300, "five hours ago", "y"), turn("now", 178, "just now", "y")]).recent_work_context()
    assert set(old["atoms"]) == {"x", "now"} and old["warnings"][0].startswith("[AUTO_EXPAND] single-source-recent")
    assert old["clusters"][0]["atom_ids"] == ["x"]
    assert over(spark, [turn("x", -300, "a", "y")]).recent_work_context()["warnings"][0].startswith("[AUTO_EXPAND] empty")
