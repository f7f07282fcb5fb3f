"""Single rules of sources, projects, times, texts, adapters and the forest, each with its cases."""

import json
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom import tools, wire
from ledgerloom.functions import paths, text
from ledgerloom.operators import clusters, groups, normalize, topology
from ledgerloom.sources import ledger as L

EVENT = "id string, source string, timestamp string, content string, metadata string"


def ledger(spark, rows):
    """rows: (content, source, metadata)."""
    made = [(str(i), s, f"2026-04-30T12:{i:02d}:00Z", c, m if m is None or isinstance(m, str) else json.dumps(m)) for i, (c, s, m) in enumerate(rows)]
    return tools.from_events(spark.createDataFrame(made, EVENT))


SOURCES = [
    ("win", "C:\\Users\\me\\.codex\\sessions\\a.jsonl"), ("case", "C:\\DEV\\Project\\notes.md"), ("sibling", "fs:/a/bc"), ("child", "fs:/a/b/leaf"), ("git", "git:repo-events"), ("slash", "fs:/a/d/"),
    ("unc", "\\\\Host\\Share\\x"), ("tilde", "~/x/y"), ("both", "fs:/h/.codex/sessions/n/.claude/projects/a.jsonl"), ("api", "api:granola"), ("cursor", "fs:/h/Library/Application Support/Cursor/s"), ("plain", "notes"),
]
MATCHES = [
    ({"source_prefixes": ("C:/Users/me/.codex/sessions/",)}, ["win"]), ({"source": "C:/Users/me/.codex/sessions/a.jsonl"}, ["win"]), ({"source_prefixes": ("c:/dev/project",)}, ["case"]),
    ({"source_prefixes": ("fs:/a/b",)}, ["child"]), ({"source_prefixes": ("GIT:",)}, []), ({"source_prefixes": ("git:",)}, ["git"]), ({"source": "fs:/a/d"}, ["slash"]), ({"source": "//Host/Share/x"}, ["unc"]),
    ({"source_prefixes": ("~/x",)}, ["tilde"]), ({"family": "codex"}, ["both"]), ({"family": "claude_code"}, ["both"]), ({"family": "granola"}, ["api"]), ({"family": "cursor"}, ["cursor"]), ({"family": "git"}, ["git"]),
    ({"source_prefixes": ("not",)}, ["plain"]), ({"source": "Notes"}, []),
]


def test_sources(spark):
    rows = ledger(spark, [(c, s, None) for c, s in SOURCES]).cache()
    for args, want in MATCHES:
        assert sorted(r.content for r in L.Scan(**args).run(rows).collect()) == sorted(want), args


def test_project_identity(spark):
    key, rows = "local:workspace:/repo-a", [
        ("explicit", "fs:1", {"project_key": "local:workspace:/repo-a", "repo_root": "/nested"}), ("other key", "fs:2", {"project_key": "local:workspace:/other", "repo_root": "/repo-a/app"}),
        ("canonical", "fs:3", {"canonical_root": "/repo-a", "repo_root": "/elsewhere"}), ("other root", "fs:4", {"canonical_root": "/other", "repo_root": "/repo-a/app"}), ("legacy", "fs:5", {"repo_root": "/repo-a"}),
        ("descendant", "fs:6", {"repo_root": "/repo-a/packages/../app"}), ("alias", "fs:7", {"repo_root": "/link/app"}), ("sibling", "fs:8", {"repo_root": "/repo-ab/app"}),
        ("null key", "fs:9", {"project_key": None, "repo_root": "/repo-a/app"}), ("null root", "fs:10", {"canonical_root": None, "repo_root": "/repo-a/app"}), ("number", "fs:11", {"project_key": 5, "repo_root": "/repo-a"}),
        ("escape", "fs:12", {"repo_root": "/repo-a/../repo-b"}), ("relative", "fs:13", {"repo_root": "repo-a/app"}), ("none", "fs:14", {}), ("broken", "fs:15", "{no"), ("array", "fs:16", "[1]"), ("bare git", "git:/repo-a", None),
        ("poisoned git", "git:/repo-a", {"project_key": None, "repo_root": "/repo-a"}), ("windows", "fs:17", {"repo_root": "C:\\repo-a"}),
    ]
    book = ledger(spark, rows).cache()
    roots = L.project_roots(key, ("/repo-a/", "/link"))
    assert roots == ("/repo-a", "/link")
    got = sorted(r.content for r in L.Scan(project=(key, roots)).run(book).collect())
    assert got == sorted(["explicit", "canonical", "legacy", "descendant", "alias"])
    assert [r.content for r in L.Scan(project=(key, roots), source="git:/repo-a").run(book).collect()] == ["bare git"]
    assert L.Scan(project=(key, roots), source_prefixes=("git:",)).run(book).count() == 0
    for bad in (("a",), ("/1", "/2", "/3", "/4"), ("/1", "/2", "/3")):
        with pytest.raises(ValueError):
            L.project_roots(key, bad)
    rebased = normalize.rebased(book, key).select("content", F.get_json_object("metadata", "$.project_key").alias("k"), F.get_json_object("metadata", "$.observed_root").alias("o")).collect()
    assert {r.content: r.o for r in rebased if r.o} == {"legacy": "/repo-a", "descendant": "/repo-a/packages/../app", "alias": "/link/app", "sibling": "/repo-ab/app", "escape": "/repo-a/../repo-b", "relative": "repo-a/app", "windows": "C:\\repo-a"}


def test_filters_reach_the_files_of_a_written_ledger(spark, tmp_path):
    book = L.WrittenLedger(spark, str(tmp_path))
    book.append(ledger(spark, [(str(i), f"fs:/a/{i}", {"project_key": f"local:workspace:/p{i % 3}"}) for i in range(9)]))
    for scan in (L.Scan(project=("local:workspace:/p1", ("/p1",))), L.Scan(source_prefixes=("fs:/a/1",)), L.Scan(metadata={"session_id": "s"}), L.Scan(since=F.lit("2026-01-01").cast("timestamp"))):
        plan = book.read().where(scan.predicate())._jdf.queryExecution().executedPlan().toString()
        pushed = plan.split("PushedFilters: [")[1].split("]")[0]
        assert pushed, plan
    assert L.Scan(project=("local:workspace:/p1", ("/p1",))).run(book.read()).count() == 3


def test_paths_and_remotes(spark):
    cases = {"/a/./b/../c//d/": "/a/c/d", "/../..": "/", "/a": "/a", "a/../../b": "../b", "./x": "x", "/a/..b/c": "/a/..b/c"}
    got = spark.createDataFrame([(k,) for k in cases], "p string").select("p", paths.dot_free(F.col("p")).alias("n")).collect()
    assert {r.p: r.n for r in got} == cases
    remotes = {
        "git@GitHub.com:Org/Repo.git": "https://github.com/Org/Repo", "GIT@host.org:a/b/": "https://host.org/a/b", "https://GitLab.com/A/B.git": "https://gitlab.com/A/B", "ssh://Git@Bitbucket.org/x/Y/": "ssh://git@bitbucket.org/x/Y",
        "HTTPS://Example.com": "https://example.com", "/local/Path.git": "/local/Path", "": "", " git@h:p.git/ ": "https://h/p", "git@h": "git@h",
    }
    df = normalize.with_remote(spark.createDataFrame([(k,) for k in remotes], "o string"), "o", "url")
    assert {r.o: r.url for r in df.collect()} == remotes
    kinds = {"https://github.com/a": "github", "https://x.gitlab.com:80/a": "gitlab", "ssh://git@bitbucket.org/x": "bitbucket", "https://notgithub.com/a": "git", "/p": "git"}
    assert {r.u: r.k for r in spark.createDataFrame([(k,) for k in kinds], "u string").select("u", normalize.remote_provider(F.col("u")).alias("k")).collect()} == kinds


def test_times(spark):
    cases = {"2026-01-01T00:00:00": "2026-01-01T00:00:00.000Z", "2026-01-01T02:00:00.5+02:00": "2026-01-01T00:00:00.500Z", "2026-01-01T02:00:00+0200": "2026-01-01T00:00:00.000Z", "2026-01-01T02:00:00+02": "2026-01-01T00:00:00.000Z", "n/a": None, "": None}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r.t: r.n for r in df.select("t", text.iso_millis(text.captured_instant(F.col("t"))).alias("n")).collect()} == cases
    marks = {r.t: r.m for r in df.select("t", text.has_tz_mark(F.col("t")).alias("m")).collect()}
    assert marks == {k: tools.has_tz(k) for k in cases} and marks["2026-01-01T02:00:00+02"] and not marks["2026-01-01T00:00:00"]


def test_hints_and_their_texts(spark):
    cases = [
        ("Is it? Really?\n", "no", {"ends_with_question": "Really?"}), ("x", "TODO: a b\nc FIXME", {"contains_todo": "TODO: a b"}), ("éTODO x", "", {"contains_todo": "TODO x"}), ("aTODO: x", "", {}),
        ("x", "I will do later today.\nok", {"explicit_followup": "I will do later today."}), ("", "Why? ﻿\u00a0", {"unresolved_assistant_q": "Why?"}), ("FIXME", "", {"contains_todo": "FIXME"}), ("?", "", {"ends_with_question": "?"}),
    ]
    df = spark.createDataFrame([(i, u, a) for i, (u, a, _) in enumerate(cases)], "i int, u string, a string")
    df = df.withColumn("k", F.explode_outer(text.open_loop_hints(F.col("u"), F.col("a")))).withColumn("t", text.hint_text(F.col("k"), F.col("u"), F.col("a")))
    got = {}
    for r in df.collect():
        got.setdefault(r.i, {})
        if r.k:
            got[r.i][r.k] = r.t
    assert [got[i] for i in range(len(cases))] == [{k: v for k, v in w.items()} for _, _, w in cases]


def test_clips_and_wire_shapes(spark):
    for s, cap in (("é" * 100, 51), ("a" * 50, 50), ("🙂x" * 40, 33), ("", 5)):
        out, gone = text.clipped(s, cap)
        if len(s.encode()) <= cap:
            assert (out, gone) == (s, 0)
            continue
        head, tail = out.split(f"\n…[{gone} bytes elided]…\n")
        assert s.startswith(head) and s.endswith(tail) and len(head.encode()) <= cap // 2 and len((head + tail).encode()) <= cap and len((head + tail).encode()) + gone == len(s.encode())
    assert wire.to_json({"a": 1.0, "b": "é\u2028\"\\\n"}) == '{"a":1,"b":"é\u2028\\"\\\\\\n"}' and wire.size("\\" * 10) == 22
    assert wire.size(wire.clip_json("\\" * 5000, 1024)) <= 1024 and wire.clip_json("x", 1024) == "x"
    calls = [{"name": n, "args": "x" * 300} for n in ("a", "b", "a")]
    m = wire.match_view({"id": "1", "source": "s", "timestamp": "t", "content": "c", "metadata": {"tool_calls": calls, "big": "y" * 2000, "surface": "codex"}})
    assert m["metadata"]["tool_calls"] == ["a", "b", "a"] and m["metadata"]["tool_calls_by_name"] == {"a": 2, "b": 1} and m["metadata"]["big"] == {"__elided": True, "original_size": 2002}
    assert m["truncations"] == ["metadata.big", "metadata.tool_calls:projected"] and list(m["metadata"])[0] == "surface" and wire.tool_view([{"x": 1}]) is None
    many = wire.match_view({"id": "1", "source": "s", "timestamp": "t", "content": "c", "metadata": {f"k{i:02d}": i for i in range(40)}})
    assert many["metadata_keys_omitted"] == 8 and len(many["metadata"]) == 32
    lean = wire.compact_atom({"id": "1", "source": "fs:/h/.claude/projects/x", "timestamp": "t", "content": "c", "truncations": [], "metadata": {"session_id": "s", "model": "m", "permission_mode": "default", "git_state": {"branch": "b"}, "tool_call_total": 0, "other": 1}})
    assert lean["metadata"] == {"session_id": "s", "model": "m", "branch": "b"}
    cluster = {"cluster_id": "c", "rank": 1, "rank_reason": ["dense", "code_session_anchor"], "atom_ids": [str(i) for i in range(70)], "source_breakdown": {}, "time_range": {}, "open_loop_hints": [{"atom_id": str(i), "resolved": False} for i in range(40)], "label": "discussion about 01234567-89ab-cdef-0123-456789abcdef"}
    view = wire.cluster_view(cluster, 10)
    assert view["atom_ids"] == ["0", "1", "2", "3", "4", "65", "66", "67", "68", "69"] and view["atom_ids_total"] == 70 and view["open_loop_hints_omitted"] == 35
    assert wire.compact_cluster(view)["label"] is None and wire.compact_cluster(view)["rank_reason"] == ["code_session_anchor"]
    bones = wire.skeleton_cluster(cluster)
    assert (bones["atom_ids_omitted"], bones["open_loop_hints_omitted"], bones["truncated"]) == (20, 10, True)
    atom = {"id": "1", "time": {}, "source": {}, "action": {"kind": "message", "input": "🙂" * 300, "output": "o"}}
    assert len(wire.skeleton_atom(atom)["action"]["summary"]) == 100 and "[truncated; 100 chars omitted" in wire.minimal_atom(atom)["action"]["input"]
    df = spark.createDataFrame([("x" * 30, [0.5, 2.0])], "t string, v array<float>")
    r = df.select(text.cut_with_note(F.col("t"), 10).alias("c"), text.vector_of(text.vector_bytes(F.col("v"))).alias("v"), F.hex(text.vector_bytes(F.col("v"))).alias("b")).first()
    assert r.c == "x" * 10 + "\n[…truncated; 20 chars dropped]" and r.v == [0.5, 2.0] and r.b == "0000003F00000040"


def test_adapters(spark):
    pair = "USER: q\n\nASSISTANT: a"
    rows = [
        ("codex", "fs:/h/.codex/sessions/r.jsonl", pair, {"session_id": "s", "cwd": "/w/r", "git": {"origin_url": "git@github.com:O/R.git", "branch": "b"}, "codex": {"model": "m", "cli_version": "1"}, "files_referenced": ["/w/r/x.py", 5], "thread_kind": "root", "agent_depth": 2, "logical_turn_id": "has space", "observation_kind": "odd", "initiator": "agent", "turn_index": 3}),
        ("cursor", "fs:/U/Cursor/User/globalStorage/state.vscdb", pair, {"composer_id": "c", "context": {"attached_files": ["/v", 1], "referenced_files": [{"path": "/a/./b"}, {"no": 1}], "deleted_files": ["/d"]}, "workspace_id": "w"}),
        ("no session", "fs:/h/.codex/sessions/r.jsonl", pair, {}), ("no pair", "fs:/h/.codex/sessions/r.jsonl", "text", {"session_id": "s"}), ("other", "app:x", pair, {}),
        ("win", "fs:C:\\h\\.claude\\projects\\p\\x.jsonl", pair, {"session_id": "s", "git_state": {"origin_url": "https://gitlab.com/a/b"}, "repo_root": "/w", "canonical_root": "/w"}),
    ]
    made = spark.createDataFrame([(i, s, "2026-01-01T00:00:00Z", c, json.dumps(m)) for i, s, c, m in rows], EVENT)
    out = {r.id: r for r in normalize.normalized(made).collect()}
    assert set(out) == {"codex", "cursor", "no session", "win"} and out["no session"].error == "codex: missing metadata.session_id"
    c = out["codex"]
    assert [a.id for a in c.artifacts] == ["codex:s", "https://github.com/O/R", "https://github.com/O/R::x.py"] and c.ambient == {"cli_version": "1", "branch": "b", "git_alias": "https://github.com/O/R"}
    assert (c.conversation.root_thread_id, c.conversation.agent_depth, c.conversation.logical_turn_id, c.conversation.observation_kind, c.conversation.turn_index) == ("s", 2, None, None, 3)
    assert [(a.role, a.model, a.provider) for a in c.actors] == [("agent", None, None), ("assistant", "m", "openai")] and c.project.key == "local:workspace:/w/r"
    u = out["cursor"]
    assert [a.id for a in u.artifacts] == ["cursor:c", "abs:/a/b", "abs:/d"] and u.visible == ["/v"] and u.ambient == {"workspace_id": "w"} and u.conversation.thread_kind == "root" and u.conversation.thread_id == "c"
    assert out["win"].app == "claude_code" and [a.type for a in out["win"].artifacts] == ["conversation", "workspace"] and out["win"].ambient["git_alias"] == "https://gitlab.com/a/b"
    with pytest.raises(ValueError):
        normalize.checked((*normalize.ADAPTERS, normalize.ADAPTERS[0]))


def forest_by_hand(atoms, arts, hours):
    """Clusters by taking one candidate after the other: (project, id) to the least id of its cluster, and keys by pair."""
    window, of, keys = hours * 3600, {a["id"]: {a["id"]} for a in atoms}, {}
    at, own = {a["id"]: a["ts"] for a in atoms}, {a["id"]: a["owner"] for a in atoms}
    for project in sorted({a["project"] for a in atoms}):
        here = [a["id"] for a in atoms if a["project"] == project]

        def steps(ids, here_key):
            line = sorted(ids, key=lambda i: (at[i], i))
            return [(at[b] - at[a], here_key, a, b) for a, b in zip(line, line[1:], strict=False) if at[b] - at[a] <= window]  # noqa: B023

        todo = []
        for member in ("strong", "weak"):
            found = [s for k in sorted({k for _, k, m in arts if m == member}) for s in steps({i for i, key, m in arts if key == k and i in here}, k)]
            todo += [(member, *s) for s in sorted(found)]
        for o in sorted({own[i] for i in here if own[i]}):
            todo += [("lineage", *s) for s in steps([i for i in here if own[i] == o], o)]
        for kind, _, key, a, b in todo:
            pair = (min(a, b), max(a, b))
            if kind == "weak":
                x, y = ({own[i] for i in of[n] if own[i]} for n in (a, b))
                if x and y and not x & y:
                    continue
            if pair in keys:
                if kind != "lineage" and len(keys[pair]) < 32 and key not in keys[pair]:
                    keys[pair].append(key)
            elif of[a] is not of[b]:
                whole = of[a] | of[b]
                for i in whole:
                    of[i] = whole
                keys[pair] = [key]
    return {i: min(s) for i, s in of.items()}, {p: sorted(k) for p, k in keys.items()}


def test_forest_equals_taking_candidates_one_by_one(spark):
    for seed in range(4):
        rng = random.Random(seed)
        atoms = [{"id": f"n{i:03d}", "ts": rng.randrange(0, 400_000), "project": f"p{rng.randrange(2)}", "owner": rng.choice([None, "o1", "o2", "o3"])} for i in range(90)]
        arts = sorted({(a["id"], f"k{rng.randrange(8)}", m) for a in atoms for m in rng.sample(["weak", "weak2", "strong"], 2) if rng.random() < 0.6})
        arts = sorted({(i, k + m[0], "strong" if m == "strong" else "weak") for i, k, m in arts} | {(a["id"], f"z{j}", "weak") for a in atoms[:12] for j in range(40)})
        comp, keys = forest_by_hand(atoms, arts, 4)
        a = spark.createDataFrame([(x["id"], x["ts"], x["project"], x["owner"]) for x in atoms], "id string, s long, project string, owner string").withColumn("ts", F.timestamp_seconds("s"))
        b = spark.createDataFrame(arts, "id string, key string, membership string").join(a.select("id", "ts", "project"), "id")
        got = topology.constrained_forest(a, b, 4.0).collect()
        assert {r.id: r.component for r in got} == comp
        assert {(x["from"], x["to"]): list(x["keys"]) for r in got for x in r.links} == keys and all(r.id == r.component for r in got if r.links)


def test_stretches_join_where_a_whole_window_would(spark):
    rng = random.Random(5)
    rows = [(f"r{i:03d}", rng.choice(["a", None]), 86_400 * rng.randrange(4) + rng.choice([0, 100, 80_000, 86_300])) for i in range(80)]
    df = spark.createDataFrame(rows, "id string, key string, s long").withColumn("ts", F.timestamp_seconds("s"))
    want, edges = {}, set()
    for key in ("a", None):
        line, n, last = sorted((s, i) for i, k, s in rows if k == key), 0, None
        for s, i in line:
            n += last is None or s - last[0] > 3600
            if last is not None and s - last[0] <= 3600:
                edges.add((last[1], i))
            want[i], last = n, (s, i)
    assert {r.id: r.component for r in topology.gap_components(df, ["key"], 1.0).collect()} == want
    assert {(r.from_id, r.to_id) for r in topology.adjacent(df, ["key"], 1.0).collect()} == edges


def test_labels_ranks_and_groups(spark):
    rows = [("c", "1", 1, "edit", "git:commit:z/tail:x", None), ("c", "2", 2, "message", "git:commit:z/tail:x", None), ("d", "3", 3, "odd", "local_fs:file:f", "Nice")]
    rows += [("d", "4", 4, "odd", "local_fs:file:f", "Later"), ("e", "5", 5, None, "local_fs:file:f", None)]
    df = spark.createDataFrame(rows, "cluster string, id string, ts long, verb string, artifact string, label string")
    arts = df.select("*", F.lit("file").alias("type"), F.struct(F.substring_index("artifact", ":", -2).alias("id"), "label").alias("ref"))
    got = {r.cluster: r.label for r in clusters.labels(clusters.top_anchors(arts), df).collect()}
    assert got == {"c": "edits to x", "d": "work on Nice"}
    made = spark.createDataFrame([("x", 2, 5.0), ("y", 2, 5.0), ("z", 3, 9.0)], "cluster string, size long, median_age double").withColumns({"recent": F.lit(False), "hint": F.col("cluster") == "y", "own_recent": F.col("cluster") == "z"})
    assert [r.cluster for r in clusters.ranked(made).orderBy("rank").collect()] == ["y", "x", "z"]
    odd = 'a"b\\c\n\t\x01é/'
    r = spark.createDataFrame([(odd,)], "k string").select(groups.json_text(F.col("k")).alias("j")).first()
    assert r.j == json.dumps(odd, ensure_ascii=False)
