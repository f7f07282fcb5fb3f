"""Capture: which rows may enter the ledger, turns of session files in batch and as a stream, and their exactly-once append."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..functions.paths import norm_source, norm_source_value
from ..sources import ledger as L
from . import jsonl
from .sessions import dedupe_key, parser_for

TURNS = "path string, generation int, byte_offset long, source string, timestamp string, content string, metadata string, dedupe_key string"
#: Kinds of sources, and why a row of each is rejected.
KINDS = {"app": "unknown_app", "domain": "unknown_domain", "fs": "unknown_path", "api": "unknown_api", "git": "unknown_repo"}


def path_in(path: Column, roots: list[str]) -> Column:
    """Whether a path is one of the roots or under one, with either slash, and in either case where it is a Windows path."""
    plain = F.when(path == "/", path).otherwise(F.rtrim(F.translate(path, "\\", "/"), F.lit("/")))
    whole = F.when(plain.rlike(r"^[A-Za-z]:(?:/|\z)") | plain.startswith("//"), F.lower(plain)).otherwise(plain)
    out = F.lit(False)
    for r in roots:
        own = r.replace("\\", "/").rstrip("/") or "/"
        own = own.lower() if own[1:3] in (":/", ":") or own.startswith("//") else own
        out = out | (whole == own) | whole.startswith(own if own.endswith("/") else own + "/")
    return out


def gate(rows: DataFrame, allowed: dict[str, list[str]]) -> DataFrame:
    """``rows`` (source, timestamp, content, metadata JSON) with ``reject_reason``: null where the row's shape is good, its timestamp can be
    read and its source is allowed (``allowed`` by kind: app, domain, fs roots, api, git repositories)."""
    kind, name = F.substring_index("source", ":", 1), F.regexp_extract("source", r"(?s)^[^:]+:(.+)\z", 1)
    shaped = F.coalesce((F.length("source") > 0) & (F.length("timestamp") > 0) & F.col("content").isNotNull() & (F.instr("source", ":") > 1) & (F.length(name) > 0) & kind.isin(*KINDS), F.lit(False))
    shaped = shaped & (F.col("metadata").isNull() | F.json_object_keys("metadata").isNotNull())
    known = F.lit(False)
    for k in KINDS:
        given = allowed.get(k, [])
        if k == "fs":
            test = path_in(name, given)
        elif k == "git":
            test = reduce(lambda a, b: a | b, [norm_source(name) == (norm_source_value(g) or g) for g in given], F.lit(False))
        else:
            test = name.isin(*given) if given else F.lit(False)
        known = known | ((kind == k) & F.coalesce(test, F.lit(False)))
    why = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])[kind]
    bad = text.captured_instant(F.col("timestamp")).isNull()
    return rows.withColumn("reject_reason", F.when(~shaped, "malformed_event").when(~known, why).when(bad, "invalid_timestamp"))


def files_only(rows: DataFrame, roots: list[str], files: list[str] = ()) -> DataFrame:
    """``rows`` with ``reject_reason`` by the policy of one extractor: files under its roots, and single files, whatever else is allowed."""
    path = F.regexp_extract("source", r"(?s)^fs:(.+)\z", 1)
    fine = (path != "") & (path_in(path, list(roots)) | reduce(lambda a, b: a | b, [norm_source(path) == norm_source_value(f) for f in files], F.lit(False)))
    return rows.withColumn("reject_reason", F.when(~F.coalesce(fine, F.lit(False)), "unknown_path"))


def allowed_sources(path: str, defaults: dict[str, list[str]] | None = None) -> dict[str, list[str]]:
    """The allowed sources with the repositories that a configuration file names; a file that is not there adds none, one that is wrong is an error."""
    out = {k: list(v) for k, v in (defaults or {}).items()}
    try:
        with open(path) as f:
            body = json.load(f)
    except FileNotFoundError:
        return out
    except ValueError as e:
        raise ValueError(f"invalid capture configuration {path}: {e}") from None
    good = isinstance(body, dict) and set(body) <= {"schema_version", "updated_at", "git_repos"} and body.get("schema_version") == 1
    good = good and isinstance(body.get("updated_at"), str) and body["updated_at"] and isinstance(body.get("git_repos"), list) and all(isinstance(r, str) and r for r in body["git_repos"])
    if not good:
        raise ValueError(f"invalid capture configuration {path}")
    have = out.setdefault("git", [])
    seen = {norm_source_value(r) or r for r in have}
    for r in body["git_repos"]:
        key = norm_source_value(r) or r
        if key not in seen:
            seen.add(key)
            have.append(r)
    return out


def capture(rows: DataFrame, ledger: L.WrittenLedger, allowed: dict[str, list[str]]) -> DataFrame:
    """Appends the rows that pass the gate (those with a dedupe_key once, whatever is sent again) and gives the rejected ones."""
    judged = gate(rows, allowed)
    good = judged.where("reject_reason is null").drop("reject_reason")
    ledger.append(ledger_rows(good))
    return judged.where("reject_reason is not null")


def ledger_rows(rows: DataFrame) -> DataFrame:
    """Captured rows as the ledger has them: canonical timestamps, ids by dedupe key or at random, in the order of their time."""
    key = F.col("dedupe_key") if "dedupe_key" in rows.columns else F.lit(None).cast("string")
    at = rows.withColumn("ts", text.captured_instant(F.col("timestamp")))
    at = at.withColumns({"id": F.coalesce(L.dedupe_id(key), F.uuid()), "timestamp": text.iso_millis(F.col("ts")), "seq": F.unix_micros("ts")})
    return at.select("id", "seq", "source", "timestamp", "ts", "content", "metadata")


def with_project(metadata: dict, resolve: Callable[[str], str]) -> dict:
    """The metadata with the project of its folder, by a function that gives canonical roots."""
    root = metadata.get("repo_root")
    if root is None:
        return metadata
    canonical = resolve(root)
    return metadata | {"canonical_root": canonical, "project_key": f"local:workspace:{canonical}"}


def _turn_rows(path: str, generation: int, lines, state: dict | None, resolve) -> tuple[list[tuple], dict]:
    """Turns that lines (byte_start, byte_end, mtime_ms, line) close, and the parser's state after them."""
    parser = parser_for(path)(path, state)
    out = []
    for start, end, mtime, line in lines:
        for t in parser.feed(line, start, end, mtime):
            key = dedupe_key(parser.extractor, path, parser.session, t["byte_offset"], generation)
            out.append((path, generation, t["byte_offset"], f"fs:{path}", t["timestamp"], t["content"], json.dumps(with_project(t["metadata"], resolve), ensure_ascii=False), key))
    return out, parser.state


_NAMES = [c.split()[0] for c in TURNS.split(", ")]


def turns(lines: DataFrame, resolve: Callable[[str], str] = lambda p: p) -> DataFrame:
    """Turns of session files (columns TURNS) from their lines; a file is read in one task, in order, as its turns depend on it."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("byte_start")
        rows, _ = _turn_rows(key[0], int(key[1]), zip(pdf["byte_start"].tolist(), pdf["byte_end"].tolist(), pdf["mtime_ms"].tolist(), pdf["line"].tolist(), strict=True), None, resolve)
        return pd.DataFrame(rows, columns=_NAMES)

    return lines.where("line is not null").groupBy("path", "generation").applyInPandas(run, TURNS)


def fragments(lines: DataFrame) -> DataFrame:
    """Rows of records that are longer than a page, a fragment each, so that nothing of a file is lost."""
    f = lines.where("fragment is not null")
    meta = F.to_json(F.struct(
        F.lit("oversized_jsonl_cluster").alias("capture_fragment"), F.lit("jsonl_raw_v1").alias("fragment_schema"), F.lit("base64").alias("encoding"), F.col("generation").alias("source_generation"),
        (F.col("byte_start") - F.col("fragment_index") * jsonl.FRAGMENT_BYTES).alias("cluster_start_offset"), "fragment_index", "byte_start", F.col("byte_end").alias("byte_through"),
        (F.col("byte_end") - F.col("byte_start")).alias("byte_count"), "sha256",
    ))
    parts = [F.lit("raw-jsonl-fragment-v1"), F.col("path"), F.col("generation").cast("string"), F.col("byte_start").cast("string"), F.col("byte_end").cast("string"), F.col("sha256")]
    return f.select("path", "generation", F.col("byte_end").alias("byte_offset"), F.concat(F.lit("fs:"), "path").alias("source"), text.iso_millis(F.timestamp_millis("mtime_ms")).alias("timestamp"), F.concat(F.lit("jsonl-raw-base64:"), "fragment").alias("content"), meta.alias("metadata"), F.concat(F.lit("fragment:"), F.sha2(F.concat_ws("|", *parts), 256)).alias("dedupe_key"))


def stream_turns(lines: DataFrame, resolve: Callable[[str], str] = lambda p: p) -> DataFrame:
    """``turns`` of a stream of lines: what a parser holds back of a file is the file's state; a new generation starts afresh."""

    def run(key, batches, state):
        seen = pd.concat(list(batches)).sort_values("byte_start")
        held = json.loads(state.get[0]) if state.exists else None
        lines_of = zip(seen["byte_start"].tolist(), seen["byte_end"].tolist(), seen["mtime_ms"].tolist(), seen["line"].tolist(), strict=True)
        rows, after = _turn_rows(key[0], int(key[1]), lines_of, held, resolve)
        state.update((json.dumps(after),))
        yield pd.DataFrame(rows, columns=_NAMES)

    return lines.where("line is not null").groupBy("path", "generation").applyInPandasWithState(run, TURNS, "state string", "append", "NoTimeout")


def start_capture(spark: SparkSession, folder: str, ledger_path: str, checkpoint: str, resolve: Callable[[str], str] = lambda p: p, **trigger):
    """Tails session files into a written ledger. Replayed batches append nothing twice: rows are known by their dedupe key."""
    book = L.WrittenLedger(spark, ledger_path)

    def write(batch: DataFrame, _: int) -> None:
        book.append(ledger_rows(files_only(batch, [folder]).where("reject_reason is null")))

    query = stream_turns(jsonl.tail_lines(spark, folder), resolve).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (query.trigger(**trigger) if trigger else query).start()


def health(progress: dict | None, stale_ms: int, now_ms: int) -> str:
    """starting, healthy, degraded (no progress for longer than ``stale_ms``) of a stream by its last progress."""
    if progress is None:
        return "starting"
    at = pd.Timestamp(progress["timestamp"]).timestamp() * 1000
    return "healthy" if now_ms - at <= stale_ms else "degraded"
