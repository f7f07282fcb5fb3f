"""Turn texts: pairs, open-loop hints, initiators, times from ids, clips."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

PAIR = r"(?s)\AUSER: (.*?)\n\nASSISTANT: (.*)\z"
#: Beginnings of texts that a system puts in.
SYSTEM_PREFIXES = (
    "<system-reminder>", "<recommended_plugins>", "<environment_context>", "<permissions instructions>", "<collaboration_mode>",
    "<skills_instructions>", "<apps_instructions>", "<plugins_instructions>", "# AGENTS.md instructions",
)


#: White space as JavaScript trims it, for use in a character class.
SPACE = r"\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
TZ_MARK = r"(?:Z|[+-]\d{2}(?::?\d{2})?)\z"
#: Keys of tool arguments that hold a file, and the most characters of arguments, outputs and thoughts that a turn keeps.
FILE_KEYS = ("file_path", "path", "notebook_path")
ARGS_CHARS, OUTPUT_CHARS, THINKING_CHARS = 2000, 4000, 8000


def trimmed(column: Column) -> Column:
    return F.regexp_replace(column, rf"\A[{SPACE}]+|[{SPACE}]+\z", "")


def turn_pair(content: Column) -> tuple[Column, Column]:
    """Input and output of a turn; a text that isn't a pair is all input."""
    pair = content.rlike(PAIR)
    return F.when(pair, F.regexp_extract(content, PAIR, 1)).otherwise(content), F.when(pair, F.regexp_extract(content, PAIR, 2))


def open_loop_hints(user: Column, assistant: Column, question: str = "?") -> Column:
    """Kinds of open loops of a turn, in order."""
    both = F.concat_ws("\n", user, assistant)
    return F.array_compact(
        F.array(
            F.when(F.endswith(trimmed(user), F.lit(question)), F.lit("ends_with_question")),
            F.when(both.rlike(r"(?<![A-Za-z0-9_])(?:TODO|FIXME)(?![A-Za-z0-9_])"), F.lit("contains_todo")),
            F.when(F.endswith(trimmed(assistant), F.lit(question)), F.lit("unresolved_assistant_q")),
            F.when(both.rlike(r"(?i)(?<![A-Za-z0-9_])(?:follow up|will do later|come back to)(?![A-Za-z0-9_])"), F.lit("explicit_followup")),
        )
    )


def last_question(column: Column, question: str = "?") -> Column:
    """The last sentence of a text that ends with a question mark, else null."""
    whole = trimmed(column)
    return F.when(F.endswith(whole, F.lit(question)), trimmed(F.element_at(F.split(whole, rf"(?<=[.?!])[{SPACE}]+"), -1)))


def hint_text(kind: Column, user: Column, assistant: Column, question: str = "?") -> Column:
    """What an open loop of a kind says: the question, the rest of the line after a mark to do, or the line with the promise; null for none."""
    user, assistant = F.coalesce(user, F.lit("")), F.coalesce(assistant, F.lit(""))
    both = F.concat(user, F.lit("\n"), assistant)
    todo = trimmed(F.regexp_extract(both, rf"(?<![A-Za-z0-9_])(?:TODO|FIXME)[:{SPACE}][^\n]*", 0))
    later = trimmed(F.regexp_extract(both, r"(?i)[^\n]*?(?<![A-Za-z0-9_])(?:follow up|come back to|will do later)(?![A-Za-z0-9_])[^\n]*", 0))
    said = (
        F.when(kind == "ends_with_question", last_question(user, question)).when(kind == "unresolved_assistant_q", last_question(assistant, question))
        .when(kind == "contains_todo", todo).when(kind == "explicit_followup", later)
    )
    return F.when(said != "", said)


def initiator(content: Column, fallback: str = "human") -> Column:
    head = F.regexp_replace(content, r"\A[\s ﻿]+", "")
    system = F.lit(False)
    for p in SYSTEM_PREFIXES:
        system = system | head.startswith(p)
    return F.when(system, "system").when(head.startswith("<teammate-message"), "agent").otherwise(fallback)


def uuid7_millis(identifier: Column) -> Column:
    """Milliseconds since the epoch in a UUID of version 7, else null."""
    valid = identifier.rlike(r"\A[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-7[0-9a-fA-F]{3}-[89abAB][0-9a-fA-F]{3}-[0-9a-fA-F]{12}\z")
    return F.when(valid, F.conv(F.substring(F.replace(identifier, F.lit("-"), F.lit("")), 1, 12), 16, 10).cast("bigint"))


def iso_millis(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def has_tz_mark(text: Column) -> Column:
    return text.rlike(TZ_MARK)


def captured_instant(text: Column) -> Column:
    """The instant of a captured timestamp: one without an offset is in UTC, whatever the session's zone; null for what is no timestamp."""
    return F.try_to_timestamp(F.when(has_tz_mark(text), text).otherwise(F.concat(text, F.lit("Z"))))


def query_instant(text: Column) -> Column:
    """The instant of a bound in a query: one without an offset is in the session's zone."""
    return F.try_to_timestamp(text)


def cut_with_note(text: Column, limit: int) -> Column:
    """A text of over ``limit`` characters as its beginning and a note of how many were left out."""
    note = F.concat(F.lit("\n[…truncated; "), (F.length(text) - limit).cast("string"), F.lit(" chars dropped]"))
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), note)).otherwise(text)


def named_files(args: Column) -> Column:
    """Files that tool arguments name: in the headers of patches, then under the keys that hold one; each once, in order."""
    heads = F.regexp_extract_all(args, F.lit(r"(?m)^\*\*\* (?:Add|Update|Delete) File: (.+)$"), 1)
    moves = F.regexp_extract_all(args, F.lit(r"(?m)^\*\*\* Move to: (.+)$"), 1)
    keyed = F.regexp_extract_all(args, F.lit(r'"(?:' + "|".join(FILE_KEYS) + r')"\s*:\s*"([^"]+)"'), 1)
    return F.array_distinct(F.filter(F.transform(F.concat(heads, moves, keyed), trimmed), lambda x: x != ""))


def head_tail(items: Column, cap: int) -> Column:
    """A list of over ``cap`` items as its first cap // 2 and its last ones."""
    head = cap // 2
    return F.when(F.size(items) > cap, F.concat(F.slice(items, 1, head), F.slice(items, -(cap - head), cap - head))).otherwise(items)


def clip_value(text: str, cap: int) -> str:
    """A text of over ``cap`` UTF-8 bytes as a head of half of them, a marker with the number of bytes left out, and a tail; cut between characters."""
    return clipped(text, cap)[0]


def clipped(text: str, cap: int) -> tuple[str, int]:
    data = text.encode("utf-8", "surrogatepass")
    if len(data) <= cap:
        return text, 0
    head = data[: cap // 2].decode(errors="ignore")
    room = cap - len(head.encode())
    tail = data[len(data) - room :].decode(errors="ignore") if room else ""
    out = len(data) - len(head.encode()) - len(tail.encode())
    return f"{head}\n…[{out} bytes elided]…\n{tail}", out


def clip_bytes(column: Column, cap: int) -> Column:
    """``clip_value`` of a column."""

    @F.pandas_udf("string")
    def clip(text: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else clip_value(t, cap) for t in text], dtype=object)

    return clip(column)


def contains_folded(content: Column, needle: str) -> Column:
    """Case-insensitive literal substring."""
    return F.contains(F.lower(content), F.lower(F.lit(needle)))


def vector_bytes(vector: Column) -> Column:
    """A vector as little-endian 32-bit floats."""

    @F.pandas_udf("binary")
    def encode(v: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else np.asarray(x, "<f4").tobytes() for x in v], dtype=object)

    return encode(vector.cast("array<float>"))


def vector_of(blob: Column) -> Column:
    """The vector of little-endian 32-bit floats; null where the bytes are no whole number of them."""

    @F.pandas_udf("array<float>")
    def decode(b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or len(x) % 4 else np.frombuffer(x, "<f4") for x in b], dtype=object)

    return decode(blob)
