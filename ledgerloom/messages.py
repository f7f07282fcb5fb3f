"""Texts that answers carry."""

from __future__ import annotations

#: Warnings, with what is told in them in braces.
TEXTS = {
    "TZ": '[TZ] input.since or input.until lacks a TZ specifier and was parsed as local time; pass an explicit Z or +HH:MM to avoid ambiguity',
    "SEARCH_QUERY_ECHO_CAP": '[SEARCH_QUERY_ECHO_CAP] query_echo was clipped to {cap} UTF-8 JSON bytes; filtering still used the full input',
    "SEARCH_METADATA_CAP": '[SEARCH_METADATA_CAP] one or more matches omitted metadata keys; inspect metadata_keys_omitted. get_atom(id) can recover verbatim content when it fits, but metadata remains projected; read the captured source when exact metadata is required',
    "SEARCH_RESPONSE_CAP": '[SEARCH_RESPONSE_CAP] returned newest {n} of {all} candidate matches; next_cursor resumes after the last returned match',
    "SEARCH_RESPONSE_STUB": '[SEARCH_RESPONSE_CAP] newest match required an identity-only stub; use get_atom(id) for verbatim content when it fits, but metadata remains projected',
    "SOURCE_SELECTOR_PRECEDENCE": '[SOURCE_SELECTOR_PRECEDENCE] applied {applied}; ignored {ignored}. Pass one source selector per call.',
    "AUTO_EXPAND": '[AUTO_EXPAND] {trigger} no-args call: 4h default {why}; auto-expanded to {hours}h. Pass explicit `since`/`until` to suppress this fallback.',
    "ONLY_OWN_WORK": "returned only single-source-recent clusters (likely the calling session's own activity)",
    "NOTHING": 'returned 0 clusters',
    "CLUSTERS_DROPPED": 'limit dropped {n} entire cluster(s); raise `limit` or narrow the (since, until) window to retain them',
    "FIND_CLUSTERS_ID_BUDGET": '[FIND_CLUSTERS_ID_BUDGET] retained at most {cap} IDs per cluster to preserve cluster headers; use atom_ids_total and narrow the time window for full membership',
    "FIND_CLUSTERS_ID_CAP": '[FIND_CLUSTERS_ID_CAP] a cluster exceeded the {cap}-ID safety cap; narrow the time window for full membership',
    "FIND_CLUSTERS_RESPONSE_CAP": '[FIND_CLUSTERS_RESPONSE_CAP] response retained {n} of {all} clusters under the {ceiling}-byte ceiling; narrow since/until for full coverage',
    "FIND_CLUSTERS_MEMBER_PAGE_BUDGET": '[FIND_CLUSTERS_MEMBER_PAGE_BUDGET] returned {n} member IDs instead of {asked}; pass next_cursor to continue',
    "FIND_CLUSTERS_GROUP_PAGE_BUDGET": '[FIND_CLUSTERS_GROUP_PAGE_BUDGET] returned {n} group headers instead of the requested {asked}; pass next_cursor to continue',
    "GET_ATOMS_FIRST_TOO_LONG": '[GET_ATOMS_RESPONSE_CAP] even the first projected atom exceeded the response budget; no looping cursor was emitted. Retry with fields=["content"] or fields=["metadata"], or use get_atom(id)',
    "GET_ATOMS_RESPONSE_CAP": '[GET_ATOMS_RESPONSE_CAP] returned a process-order prefix; {n} existing ID entries are deferred behind next_cursor',
    "GET_ATOMS_MISSING_IDS": '[GET_ATOMS_MISSING_IDS] {n} requested ID entries were not found',
    "GET_ATOMS_DROPPED_ID_CAP": '[GET_ATOMS_DROPPED_ID_CAP] atoms_dropped_ids is a bounded process-order prefix; atoms_dropped and atoms_dropped_ids_omitted retain exact omission counts',
    "ATOM_NOT_FOUND": 'No atom with id={id} exists in storage. Verify the id was obtained from a current find_clusters / search_memories / get_atoms response — atom IDs are storage row IDs and cannot be guessed.',
    "ATOM_TOO_LARGE": 'Atom JSON exceeds 25_000-byte MCP envelope ceiling even with metadata projection; cannot transmit over MCP. Read source path directly to recover full content.',
    "GET_ATOM_SOURCE_CAP": '[GET_ATOM_SOURCE_CAP] source pointer was clipped by serialized JSON cost; use the atom ID or local storage for exact recovery',
    "NEXT_SINCE_CLAMP": '[NEXT_SINCE_CLAMP] computed next_since {to} is ahead of server time; clamped to {now} — a future watermark (usually a stripped or missing UTC offset in since) would hide every new turn from the chained call',
    "MORE_TURNS": 'wait_for_new_turns: more than {most} new turns matched; returning the oldest {n} — chain immediately with next_since to page through the backlog',
    "RECENT_WORK_CONTEXT_RESPONSE_CAP": '[RECENT_WORK_CONTEXT_RESPONSE_CAP] dropped {n} lowest-ranked whole cluster(s) and their atom bodies to keep the deprecated compound response below {ceiling} UTF-8 bytes; use find_clusters + get_atoms for complete targeted hydration',
}


def told(name: str, **values) -> str:
    """A warning with its values."""
    return TEXTS[name].format(**values)
