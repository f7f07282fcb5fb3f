"""Opaque cursors: keysets of pages, frozen queries of grouped answers, continuations of hydration."""

from __future__ import annotations

import base64
import hashlib
import json
import re
from datetime import datetime

from .wire import to_json


class CursorError(ValueError):
    """``code``: MALFORMED, INVALID, MISMATCH or STALE."""

    def __init__(self, code: str, why: str):
        super().__init__(f"[CURSOR_{code}] {why}; pass back the prior cursor verbatim")
        self.code = code


def digest(value) -> str:
    return hashlib.sha256(to_json(value).encode()).hexdigest()


def page_cursor(timestamp: str, identifier: str) -> str:
    return base64.b64encode(to_json({"timestamp": timestamp, "id": identifier}).encode()).decode()


def read_page_cursor(raw: str) -> tuple[str, str]:
    try:
        body = json.loads(base64.b64decode(raw + "=" * (-len(raw) % 4)))
    except ValueError:
        raise CursorError("MALFORMED", "not base64 of JSON") from None
    if not isinstance(body, dict) or not all(isinstance(body.get(k), str) for k in ("timestamp", "id")):
        raise CursorError("MALFORMED", "no timestamp or id")
    return body["timestamp"], body["id"]


def sealed(body: dict, most: int) -> str:
    """A body with the digest of itself as ``c``, in base64url without padding, of ``most`` characters at most."""
    raw = base64.urlsafe_b64encode(to_json({**body, "c": digest(body)}).encode()).decode().rstrip("=")
    if len(raw) > most:
        raise CursorError("INVALID", "the cursor would be too long")
    return raw


def unsealed(raw: str, most: int) -> dict:
    """The body of a ``sealed`` cursor in its one canonical spelling, untouched."""
    if not raw or len(raw) > most or not re.fullmatch(r"[A-Za-z0-9_-]+", raw):
        raise CursorError("INVALID", "not base64url of the allowed length")
    try:
        data = base64.urlsafe_b64decode(raw + "=" * (-len(raw) % 4))
        body = json.loads(data)
    except ValueError:
        raise CursorError("INVALID", "not base64url of JSON") from None
    if base64.urlsafe_b64encode(data).decode().rstrip("=") != raw or not isinstance(body, dict):
        raise CursorError("INVALID", "not in canonical form")
    seal = body.pop("c", None)
    if seal != digest(body):
        raise CursorError("INVALID", "the integrity check failed")
    return body


GROUP_CHARS, CONTINUATION_CHARS = 16_384, 2_048
GROUP_PAGE, MEMBER_PAGE, MOST_REPRESENTATIVES, MOST_MEMBERS = 20, 50, 5, 500
_HEX = re.compile(r"[0-9a-f]{64}")


def group_cursor(kind: str, by: str, since: str, until: str, window_hours: float, repo_path: str | None, offset: int, page: int, representatives: int, snapshot: str, group: str | None = None) -> str:
    """``kind``: groups or members; ``by``: project or thread."""
    body = {"v": 1, "k": kind[0], "b": by[0], "s": since, "u": until, "w": window_hours, "r": repo_path, "o": offset, "n": page, "l": representatives, "d": snapshot}
    return sealed(body | ({"g": group} if group is not None else {}), GROUP_CHARS)


def read_group_cursor(raw: str) -> dict:
    b = unsealed(raw, GROUP_CHARS)
    members = b.get("k") == "m"
    whole = lambda v, low, high: isinstance(v, int) and not isinstance(v, bool) and low <= v <= high
    rules = (
        ("version or kind", b.get("v") == 1 and b.get("k") in ("g", "m")),
        ("fields", set(b) <= set("vkbsuwronld") | ({"g"} if members else set())),
        ("grouping", b.get("b") in ("p", "t")),
        ("window", _before(b.get("s"), b.get("u"))),
        ("repo_path", b.get("r") is None or isinstance(b["r"], str) and len(b["r"]) <= 4096),
        ("digest", isinstance(b.get("d"), str) and _HEX.fullmatch(b["d"]) is not None),
        ("group", not members or isinstance(b.get("g"), str) and b["g"] != ""),
        ("offset", whole(b.get("o"), 0 if members else 1, MOST_MEMBERS)),
        ("page size", whole(b.get("n"), 1, MEMBER_PAGE if members else GROUP_PAGE) and (not members or b["n"] == MEMBER_PAGE)),
        ("representatives", whole(b.get("l"), 1, MOST_REPRESENTATIVES)),
        ("member offset", not members or b["o"] >= b["l"]),
        ("window_hours", isinstance(b.get("w"), (int, float)) and not isinstance(b.get("w"), bool) and 0.1 <= b["w"] <= 168),
    )
    for name, holds in rules:
        if not holds:
            raise CursorError("INVALID", f"invalid {name}")
    return {
        "kind": "members" if members else "groups", "by": "project" if b["b"] == "p" else "thread", "since": b["s"], "until": b["u"], "window_hours": b["w"], "repo_path": b["r"],
        "offset": b["o"], "page": b["n"], "representatives": b["l"], "snapshot": b["d"], "group": b.get("g"),
    }


def _before(since, until) -> bool:
    try:
        return datetime.fromisoformat(since) < datetime.fromisoformat(until)
    except (TypeError, ValueError):
        return False


def continuation_cursor(request: str, process: str, at: int) -> str:
    return sealed({"v": 1, "r": request, "p": process, "o": at}, CONTINUATION_CHARS)


def read_continuation_cursor(raw: str) -> tuple[str, str, int]:
    b = unsealed(raw, CONTINUATION_CHARS)
    at = b.get("o")
    good = set(b) == set("vrpo") and b["v"] == 1 and all(isinstance(b[k], str) and _HEX.fullmatch(b[k]) for k in "rp") and isinstance(at, int) and not isinstance(at, bool) and 1 <= at <= 50
    if not good:
        raise CursorError("INVALID", "invalid fields")
    return b["r"], b["p"], at
