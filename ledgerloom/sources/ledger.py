"""The event ledger: ingest columns, idempotent append, scans with keyset pages."""

from __future__ import annotations

import json
import posixpath
import uuid
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..functions.paths import FAMILY_BITS, absolute_path, family_mask, norm_source, norm_source_value, path_within, source_app, source_equals, source_has_prefix
from .workspace import hadoop_path

#: What dedupe ids are hashed with, so that they meet no other ids; a ledger that continues another one names that one's domain.
DEDUPE_DOMAIN = "ledgerloom:event-dedupe:v1\0"
#: Metadata keys that get a column at ingest, so that filters reach the scan.
HOT_KEYS = (
    "session_id", "repo_root", "project_key", "canonical_root", "surface", "logical_turn_id", "observation_kind", "thread_id", "root_thread_id", "workspace_id", "composer_id",
    "canonical_subject", "signal_type", "note_id",
)
#: Metadata keys that a scan may match, and those that a search may match besides.
SCAN_KEYS = ("workspace_id", "composer_id", "session_id", "repo_root")
SEARCH_KEYS = (*SCAN_KEYS, "source", "signal_type", "canonical_subject", "granola_atom_type", "note_id", "dedupe_key", "parent_dedupe_key", "extraction_run_id")
MAX_ROWS, DEFAULT_ROWS, MAX_ROOTS = 5000, 1000, 3


def json_string(metadata: Column, key: str) -> Column:
    """A member of a JSON object if it is a string, else null (numbers never match strings)."""
    v = F.try_parse_json(metadata)
    return F.when(F.schema_of_variant(F.try_variant_get(v, f"$.{key}", "variant")) == "STRING", F.try_variant_get(v, f"$.{key}", "string"))


def has_key(metadata: Column, key: str) -> Column:
    """Whether a JSON object has the member, null included."""
    return F.coalesce(F.array_contains(F.json_object_keys(metadata), key), F.lit(False))


def ingested(events: DataFrame) -> DataFrame:
    """Rows (id, seq, source, ts, content, metadata) with the derived columns that scans filter on.

    The metadata is parsed once; every derived column is one that a filter can push down to the files of a written ledger. Metadata that is
    no JSON object has no keys. ``app`` is the adapter's family and null where none takes the source; ``root_path`` is ``repo_root`` without
    dot segments, where it is absolute.
    """
    parsed = events.withColumns({"_v": F.try_parse_json("metadata"), "_keys": F.json_object_keys("metadata"), "source_key": norm_source(F.col("source")), "family_mask": family_mask(F.col("source"))})
    member = lambda k: F.try_variant_get("_v", f"$.{k}", "variant")
    keyed = parsed.withColumns({f"m_{k}": F.when(F.schema_of_variant(member(k)) == "STRING", F.try_variant_get("_v", f"$.{k}", "string")) for k in HOT_KEYS})
    keyed = keyed.withColumns({f"has_{k}": F.coalesce(F.array_contains("_keys", k), F.lit(False)) for k in ("project_key", "canonical_root", "repo_root")})
    return keyed.withColumns({"root_path": absolute_path(F.col("m_repo_root")), "app": source_app(F.col("source"))}).drop("_v", "_keys")


def dedupe_id(key: Column, domain: str = DEDUPE_DOMAIN) -> Column:
    return F.concat(F.lit("dedupe:v1:"), F.sha2(F.concat(F.lit(domain), key), 256))


def new_rows(batch: DataFrame, ledger: DataFrame) -> DataFrame:
    """The rows of a batch that an idempotent append adds: the first of each id (by seq) that the ledger hasn't got."""
    names = batch.columns
    first = batch.groupBy("id").agg(F.min_by(F.struct(*names), "seq").alias("r")).select("r.*")
    return first.join(ledger.select("id"), "id", "left_anti").select(*names)


class WrittenLedger:
    """An append-only ledger of Parquet folders, named by numbered commits.

    A commit is a file that is created once or not at all, so that of two writers at a time one wins; the other compares its rows with the
    new ones and tries again. What no commit names is never read. Rows are laid out by ``app`` and sorted by source and time in files.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def commits(self) -> list[tuple[str, int, int]]:
        """(folder, rows, greatest seq) of every commit, in order."""
        folder, fs = hadoop_path(self.spark, f"{self.path}/commits")
        if not fs.exists(folder):
            return []
        names = sorted(s.getPath().getName() for s in fs.listStatus(folder) if s.getPath().getName().endswith(".json"))
        out = []
        for name in names:
            body = self.spark.read.text(f"{self.path}/commits/{name}", wholetext=True).first()
            entry = json.loads(body.value) if body else None
            if entry:
                out.append((entry["folder"], entry["rows"], entry["seq"]))
        return out

    def read(self, schema=None) -> DataFrame:
        """All rows of the ledger; with ``schema``, also of one that is empty."""
        folders = [f"{self.path}/data/{f}" for f, n, _ in self.commits() if n]
        if not folders:
            if schema is None:
                raise ValueError("the ledger is empty")
            return self.spark.createDataFrame([], schema)
        return reduce(DataFrame.unionByName, [self.spark.read.parquet(f) for f in folders])

    def append(self, batch: DataFrame, tries: int = 10) -> int:
        """Adds the rows whose id is not there yet and gives their number. ``seq`` orders the batch; stored rows continue the ledger's count."""
        rows = batch if "source_key" in batch.columns else ingested(batch)
        for _ in range(tries):
            commits = self.commits()
            known = self.read(rows.schema) if commits else self.spark.createDataFrame([], rows.schema)
            folder = uuid.uuid4().hex
            last = max((s for _, _, s in commits), default=0)
            numbered = dense_order(new_rows(rows, known), ["seq"]).withColumn("seq", F.col("_n") + last).drop("_n")
            numbered.sortWithinPartitions("app", "source", F.desc("ts"), F.desc("id")).write.partitionBy("app").parquet(f"{self.path}/data/{folder}")
            count, top = self.spark.read.schema(numbered.schema).parquet(f"{self.path}/data/{folder}").agg(F.count("*"), F.max("seq")).first()
            if self._commit(len(commits), {"folder": folder, "rows": count, "seq": top or last}):
                return count
        raise RuntimeError("other writers kept committing first")

    def _commit(self, number: int, entry: dict) -> bool:
        path, fs = hadoop_path(self.spark, f"{self.path}/commits/{number:012d}.json")
        fs.mkdirs(path.getParent())
        try:
            out = fs.create(path, False)
        except Exception as e:
            if "FileAlreadyExists" in str(e) or "already exists" in str(e):
                return False
            raise
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()
        return True


def dense_order(rows: DataFrame, keys: list[str], width: int = 1 << 16) -> DataFrame:
    """``rows`` with ``_n``: 1, 2, 3 and so on by ``keys`` (the first of them a whole number), counted by ranges of it and so in no single task."""
    first = F.col(keys[0])
    bucket = F.floor(first / F.lit(width)).cast("long")
    rows = rows.withColumn("_b", bucket)
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("_b").agg(F.count("*").alias("_c")).withColumn("_start", F.coalesce(F.sum("_c").over(before), F.lit(0))).drop("_c")
    rows = rows.join(starts, "_b").withColumn("_n", F.row_number().over(Window.partitionBy("_b").orderBy(*keys)) + F.col("_start"))
    return rows.drop("_b", "_start")


def verified_copy(spark: SparkSession, source: DataFrame, path: str) -> DataFrame:
    """Writes a ledger's rows to ``path`` and gives one row of lineage: rows, greatest seq and a sum of row hashes of both, and whether they agree."""
    source.write.mode("overwrite").parquet(path)
    names = sorted(source.columns)
    measure = lambda d, n: d.agg(F.count("*").alias(f"{n}_rows"), F.max("seq").alias(f"{n}_seq"), F.sum(F.xxhash64(*names).cast("decimal(38,0)")).alias(f"{n}_hash"))
    both = measure(source, "source").crossJoin(measure(spark.read.parquet(path), "copy"))  # one row each
    same = F.col("source_rows").eqNullSafe(F.col("copy_rows")) & F.col("source_seq").eqNullSafe(F.col("copy_seq")) & F.col("source_hash").eqNullSafe(F.col("copy_hash"))
    return both.select("source_rows", "copy_rows", "source_seq", "copy_seq", same.alias("verified"))


def canonical_times(rows: DataFrame, column: str = "timestamp") -> DataFrame:
    """``rows`` with its timestamps in the canonical form; the query fails at a row whose timestamp cannot be read, so that none is lost."""
    at = text.captured_instant(F.col(column))
    told = F.raise_error(F.concat(F.lit("unreadable timestamp: "), F.col(column))).cast("string")
    return rows.withColumn(column, F.when(F.col(column).isNull(), None).when(at.isNull(), told).otherwise(text.iso_millis(at)))


@dataclass
class Scan:
    """Composable filters of a ledger scan; all given ones hold together. Pages are keysets on (ts, id)."""

    source: str | None = None
    source_prefixes: tuple[str, ...] = ()
    family: str | None = None
    since: object = None
    until: object = None
    before: tuple | None = None
    after: tuple | None = None
    metadata: dict = field(default_factory=dict)
    exclude_surfaces: tuple[str, ...] = ()
    project: tuple[str, tuple[str, ...]] | None = None
    text: str | None = None
    ascending: bool = False
    limit: int = DEFAULT_ROWS
    metadata_keys: tuple[str, ...] = SCAN_KEYS

    def predicate(self) -> Column:
        if self.before and self.ascending or self.after and not self.ascending:
            raise ValueError("before pages run newest first, after pages oldest first")
        if unknown := [k for k in self.metadata if k not in self.metadata_keys]:
            raise ValueError(f"metadata keys that cannot be matched: {', '.join(unknown)}; allowed: {', '.join(self.metadata_keys)}")
        if empty := [k for k, v in self.metadata.items() if isinstance(v, (list, tuple)) and not v]:
            raise ValueError(f"no values to match for {', '.join(empty)}")
        c, tests = F.col, [F.lit(True)]
        if self.source is not None:
            tests.append(source_equals(c("source"), c("source_key"), self.source))
        if self.source_prefixes:
            tests.append(reduce(lambda a, b: a | b, [source_has_prefix(c("source"), c("source_key"), p) for p in self.source_prefixes]))
        if self.family is not None:
            tests.append(c("family_mask").bitwiseAND(FAMILY_BITS[self.family]) != 0)
        if self.since is not None:
            tests.append(c("ts") >= F.lit(self.since))
        if self.until is not None:
            tests.append(c("ts") < F.lit(self.until))
        if self.before:
            tests.append(keyset_before(*self.before))
        if self.after:
            tests.append(keyset_after(*self.after))
        for k, v in self.metadata.items():
            col = metadata_value(k)
            tests.append(col.isin(*v) if isinstance(v, (list, tuple)) else col == v)
        if self.text is not None:
            subject = F.coalesce(text.contains_folded(c("m_canonical_subject"), self.text), F.lit(False))
            tests.append(text.contains_folded(c("content"), self.text) | subject)
        if self.exclude_surfaces:
            tests.append(~F.coalesce(c("m_surface"), F.lit("")).isin(*self.exclude_surfaces))
        if self.project:
            key, roots = self.project
            exact = self.source is not None and any(norm_source_value(self.source) == norm_source_value(f"git:{r}") for r in roots)
            tests.append(project_matches(key, roots, identity_less=exact))
        return reduce(lambda a, b: a & b, tests)

    def run(self, ledger: DataFrame) -> DataFrame:
        order = (lambda x: F.asc(x)) if self.ascending else (lambda x: F.desc(x))
        return ledger.where(self.predicate()).orderBy(order("ts"), order("id")).limit(max(1, min(self.limit, MAX_ROWS)))


def keyset_before(ts, id_: str) -> Column:
    """(timestamp, id) below a key, in the form of which the time part reaches the Parquet scan."""
    return (F.col("ts") <= F.lit(ts)) & ((F.col("ts") < F.lit(ts)) | (F.col("id") < id_))


def keyset_after(ts, id_: str) -> Column:
    return (F.col("ts") >= F.lit(ts)) & ((F.col("ts") > F.lit(ts)) | (F.col("id") > id_))


def metadata_value(key: str) -> Column:
    """The string that a metadata key is matched by. ``source`` is the row's own; a team decision without a canonical subject has its normalized one."""
    if key == "source":
        return F.col("source")
    value = F.col(f"m_{key}") if key in HOT_KEYS else json_string(F.col("metadata"), key)
    if key != "canonical_subject":
        return value
    decision = json_string(F.col("metadata"), "decision_atom_type") == "team_decision"
    return F.coalesce(value, F.when(decision, json_string(F.col("metadata"), "normalized_subject")))


def project_roots(key: str, roots: tuple[str, ...] = ()) -> tuple[str, ...]:
    """The roots that rows without a project key may lie under: that of the key itself, then the given ones; three at most, all absolute."""
    own = [key.removeprefix("local:workspace:")] if key.startswith("local:workspace:") and key != "local:workspace:" else []
    if len(roots) > MAX_ROOTS:
        raise ValueError(f"at most {MAX_ROOTS} roots")
    out = []
    for r in [*own, *roots]:
        if not r.startswith("/") or "\0" in r:
            raise ValueError("roots must be absolute paths")
        norm = posixpath.normpath(r)
        if norm not in out:
            out.append(norm)
    if len(out) > MAX_ROOTS:
        raise ValueError("the roots must include that of the project key")
    return tuple(out)


def project_matches(key: str, roots: tuple[str, ...], identity_less: bool = False) -> Column:
    """Project identity by presence: project_key, else canonical_root, else repo_root under a root; malformed fields never match.

    A disjunction of comparisons of columns, so that it reaches the files of a written ledger. ``identity_less`` admits rows with none of
    the three, for a scan of the exact source of the project's repository.
    """
    c, prefix = F.col, "local:workspace:"
    by_key = c("m_project_key") == key
    by_root = (~c("has_project_key") & (c("m_canonical_root") == key.removeprefix(prefix))) if key.startswith(prefix) else F.lit(False)
    under = reduce(lambda a, b: a | b, [path_within(c("root_path"), r) for r in roots], F.lit(False))
    matches = by_key | by_root | (~c("has_project_key") & ~c("has_canonical_root") & under)
    if identity_less:
        matches = matches | (~c("has_project_key") & ~c("has_canonical_root") & ~c("has_repo_root"))
    return matches


def multi_get(ledger: DataFrame, ids: list[str]) -> DataFrame:
    """Rows of the ids in their order, repeated ids repeated, unknown ones left out; up to 100 ids."""
    if len(ids) > 100:
        raise ValueError("at most 100 ids")
    wanted = F.array(*map(F.lit, ids)) if ids else F.array().cast("array<string>")
    asked = ledger.sparkSession.range(1).select(F.posexplode(wanted).alias("pos", "id"))
    return ledger.join(F.broadcast(asked), "id").orderBy("pos")


def since_sequence(ledger: DataFrame, seq: int, prefixes: tuple[str, ...] = (), limit: int = DEFAULT_ROWS) -> DataFrame:
    """Rows in order of their append, from a sequence number on."""
    rows = ledger.where(F.col("seq") >= seq)
    if prefixes:
        rows = rows.where(reduce(lambda a, b: a | b, [F.col("source").startswith(p) for p in prefixes]))
    return rows.orderBy("seq").limit(limit)


def current_sequence(ledger: DataFrame, prefixes: tuple[str, ...] = ()) -> DataFrame:
    rows = ledger.where(reduce(lambda a, b: a | b, [F.col("source").startswith(p) for p in prefixes])) if prefixes else ledger
    return rows.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("seq"))
