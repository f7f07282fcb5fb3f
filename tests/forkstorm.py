"""The fork-storm fixture: three projects, their turns and the copies that forks have inherited."""

from datetime import UTC, datetime, timedelta

SINCE, UNTIL = "2026-07-22T10:00:00.000Z", "2026-07-22T14:00:00.000Z"
#: name, root, sizes of threads, inherited copies, where the turns were seen (from turn, folder).
PROJECTS = (
    ("brain", "/workspace/brain", (24, 24, 24), 282, ((0, ""),), "codex"),
    ("context", "/workspace/context", (19, 19), 55, ((0, ""),), "claude"),
    ("hdc", "/workspace/hdc", (7, 6), 0, ((0, ""), (8, "/console"), (11, "/eval")), "codex"),
)


def rows(multiplier=1):
    """(id, source, timestamp, content, metadata) of every observation."""
    import json

    out, minute = [], 0
    text = lambda at: at.strftime("%Y-%m-%dT%H:%M:%S.000Z")
    for name, root, sizes, inherited, seen, app in PROJECTS:
        n = sum(sizes)
        thread_of = [t for t, size in enumerate(sizes) for _ in range(size)]
        for turn in range(n):
            at = datetime(2026, 7, 22, 10, tzinfo=UTC) + timedelta(minutes=minute)
            minute += 1
            copies = (inherited // n + (turn < inherited % n)) * multiplier
            folder = root + [f for first, f in seen if turn >= first][-1]
            for copy in range(copies + 1):
                thread = f"{name}:root:{thread_of[turn]}"
                own = thread if copy == 0 else f"{thread}:fork:{turn}:{copy}"
                path = f"{folder}/.claude/projects/bench/{own}.jsonl" if app == "claude" else f"{folder}/.codex/sessions/2026/07/22/{own}.jsonl"
                observed = text(at + timedelta(seconds=30 * copy))
                meta = {
                    "session_id": own, "turn_index": turn, "logical_turn_id": f"{name}:turn:{turn}", "occurred_at": text(at), "observed_at": observed,
                    "observation_kind": "inherited" if copy else "original", "initiator": "human", "thread_id": own, "root_thread_id": thread,
                    "thread_kind": "subagent" if copy else "root", "repo_root": folder, "canonical_root": root, "project_key": f"local:workspace:{root}",
                    "files_referenced": [f"{root}/src/shared.ts"], "codex": {"model_provider": "openai", "model": "synthetic"},
                }
                if copy:
                    meta |= {"parent_thread_id": thread, "agent_path": f"{thread}/agent-{copy}", "agent_depth": 1}
                out.append((f"{len(out):08d}-0000-4000-8000-000000000000", f"fs:{path}", observed, f"USER: Continue {name} turn {turn}.\n\nASSISTANT: Completed turn {turn}.", json.dumps(meta)))
    return out
