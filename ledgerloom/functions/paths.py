"""Path-like sources: normalization, prefixes, families, artifact keys and labels as column expressions."""

from __future__ import annotations

import posixpath
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bits of the source families.
FAMILY_BITS = {"cursor": 1, "claude_code": 2, "codex": 4, "git": 8, "granola": 16}
#: What begins a scheme and what begins a path.
_SCHEME = r"^[A-Za-z_][A-Za-z0-9_+.-]*:"
_ABSOLUTE = r"^(?:[A-Za-z]:[\\/]|/|~/|\\)"


def _scheme(source: Column) -> Column:
    """The scheme (with its colon) before the path part; empty if the path begins at once."""
    found = F.regexp_extract(source, _SCHEME, 0)
    return F.when(source.rlike(_ABSOLUTE), F.lit("")).otherwise(found)


def norm_source(source: Column) -> Column:
    """The comparable form of a path-like source, or null: forward slashes, no trailing ones, drive paths in lower case."""
    scheme = _scheme(source)
    rest = F.substring(source, F.length(scheme) + 1, F.length(source))
    path_like = rest.rlike(_ABSOLUTE) | ((scheme == "") & source.contains("\\"))
    path = F.regexp_replace(F.translate(rest, "\\", "/"), r"(?<=[\s\S])/+$", "")
    whole = F.concat(scheme, path)
    return F.when(path_like, F.when(path.rlike(r"^[A-Za-z]:(?:/|$)"), F.lower(whole)).otherwise(whole))


def norm_source_value(source: str) -> str | None:
    """``norm_source`` of a Python string."""
    scheme = "" if re.match(_ABSOLUTE, source) else (re.match(_SCHEME, source) or [""])[0]
    rest = source[len(scheme) :]
    if not re.match(_ABSOLUTE, rest) and not (scheme == "" and "\\" in source):
        return None
    path = rest.replace("\\", "/")
    path = path[:1] + path[1:].rstrip("/")
    whole = scheme + path
    return whole.lower() if re.match(r"[A-Za-z]:(?:/|$)", path) else whole


def source_equals(source: Column, key: Column, value: str) -> Column:
    """Exact source: normalized if both are paths, else as written. ``key`` is ``norm_source(source)``."""
    norm = norm_source_value(value)
    return source == value if norm is None else (key == norm) | (key.isNull() & (source == value))


def source_has_prefix(source: Column, key: Column, prefix: str) -> Column:
    """Prefix at a boundary of path components where both are paths, else of the raw text."""
    norm = norm_source_value(prefix)
    if norm is None:
        return source.startswith(prefix)
    inside = (key == norm) | key.startswith(norm if norm.endswith("/") else norm + "/")
    return inside | (key.isNull() & source.startswith(prefix))


def family_mask(source: Column) -> Column:
    """Bits of every family that a source may belong to."""
    folded = F.concat(F.lower(F.translate(source, "\\", "/")), F.lit("/"))
    is_file = folded.startswith("fs:")
    bit = lambda cond, name: F.when(cond, FAMILY_BITS[name]).otherwise(0)
    return (
        bit(is_file & folded.contains("/library/application support/cursor/"), "cursor")
        .bitwiseOR(bit(is_file & folded.contains("/.claude/projects/"), "claude_code"))
        .bitwiseOR(bit(is_file & folded.contains("/.codex/sessions/"), "codex"))
        .bitwiseOR(bit(source.startswith("git:"), "git"))
        .bitwiseOR(bit(source.startswith("api:granola"), "granola"))
    )


def source_app(source: Column) -> Column:
    """The first family whose adapter takes the source, or null (the row is dropped by normalization)."""
    mask = family_mask(source)
    out = None
    for name in ("claude_code", "codex", "cursor", "git", "granola"):
        cond = mask.bitwiseAND(FAMILY_BITS[name]) != 0
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return out


def path_within(path: Column, root: str) -> Column:
    """Whether ``path`` (a result of ``absolute_path``) is ``root`` or under it."""
    norm = posixpath.normpath(root).rstrip("/") if root.startswith("/") else None
    if norm is None or "\0" in root:
        return F.lit(False)
    return path.isNotNull() if norm == "" else (path == norm) | path.startswith(norm + "/")


#: Bytes of the longest path that a project may be told by.
MAX_PATH_BYTES = 16 << 10


def absolute_path(path: Column) -> Column:
    """An absolute path without dot segments and trailing slash, in a form that filters can push down; null for any other."""
    usable = path.startswith("/") & ~path.contains("\0") & (F.octet_length(path) <= MAX_PATH_BYTES)
    return F.when(usable, F.when(dot_free(path) == "/", "").otherwise(dot_free(path)))


def dot_free(path: Column) -> Column:
    """A path without empty, ``.`` and ``..`` segments and without a trailing slash; leading ``..`` of a relative path stay."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != ".") & (p != ""))
    absolute = path.startswith("/")

    def step(acc: Column, p: Column) -> Column:
        up = (p == "..") & (F.size(acc) > 0) & (F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit("")) != "..")
        lost = (p == "..") & absolute
        return F.when(up, F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).when(lost, acc).otherwise(F.concat(acc, F.array(p)))

    # A path with nothing to remove, the usual one, is left as it is.
    plain = path.startswith("/") & ~path.rlike(r"/(?:\.{0,2})(?:/|\z)")
    return F.when(plain, path).otherwise(F.concat(F.when(absolute, "/").otherwise(""), F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")))


#: Artifact types by role, and those that may link atoms.
SCOPE, SESSION = ("repo", "workspace", "account", "org"), ("conversation", "thread", "channel")
STRONG = ("task", "issue", "pr", "email_thread", "meeting", "crm_record", "record", "commit")
WEAK = ("file", "doc")
WORK = (*STRONG, *WEAK, "branch")


def role_of(kind: Column) -> Column:
    low = F.lower(kind)
    return F.when(low.isin(*SCOPE), "scope").when(low.isin(*SESSION), "session").when(low.isin(*WORK), "work").otherwise("unknown")


def membership_of(kind: Column) -> Column:
    low = F.lower(kind)
    return F.when(low.isin(*STRONG), "strong").when(low.isin(*WEAK), "weak").otherwise("none")


def type_of_key(key: Column) -> Column:
    """The artifact type within ``provider:type:id``."""
    return F.coalesce(F.get(F.split(key, ":", 3), F.lit(1)), F.lit(""))


def id_tail(identifier: Column) -> Column:
    """What follows the last ``::``, then the last ``/``, then the last ``:``."""
    return F.substring_index(F.substring_index(F.substring_index(identifier, "::", -1), "/", -1), ":", -1)


def scrub_credentials(url: Column) -> Column:
    """A URL without user and password."""
    return F.regexp_replace(url, r"^([A-Za-z][A-Za-z0-9+.-]*://)[^/@\s]*@", "$1")
