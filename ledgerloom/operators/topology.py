"""Gap-bounded links between atoms, the constrained spanning forest, and lineage components."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.workspace import materialized_rows

MAX_ARTIFACTS = 32
STRONG, WEAK, LINEAGE = 0, 1, 2
#: A time line is cut into stretches of a day, or of the window where that is longer, so that no task sorts the whole of a busy key.
STRETCH_US = 86_400_000_000


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def in_text_order(column: Column) -> Column:
    """A sort key by which texts compare as in a dictionary (``a`` before ``B``)."""
    return F.collate(column, "UNICODE")


def same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    """Equality of keys of which any may be null."""
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys])


def linked(rows: DataFrame, keys: list[str], window_hours: float, ts: str = "ts", id_: str = "id") -> DataFrame:
    """``rows`` with ``_prev`` and ``_gap``: the row before in its key's time line (by time, then id) and the microseconds between; null for
    the first, and ``_b``, the stretch. The rows of a stretch are sorted together; of each stretch one row goes on to the next."""
    width = max(int(window_hours * 3_600_000_000), STRETCH_US)
    rows = rows.withColumn("_b", F.floor(micros(F.col(ts)) / F.lit(width)).cast("long"))
    order = [ts, in_text_order(F.col(id_))]
    line = Window.partitionBy(*keys, "_b").orderBy(*order)
    inside = rows.withColumns({"_prev": F.lag(id_).over(line), "_at": F.lag(ts).over(line)})
    last = rows.groupBy(*keys, "_b").agg(F.max_by(id_, F.struct(F.col(ts), in_text_order(F.col(id_)))).alias("_last"), F.max(ts).alias("_last_at"))
    stretches = Window.partitionBy(*keys).orderBy("_b")
    before = last.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_b").alias("_sb"), F.lag("_last").over(stretches).alias("_before"), F.lag("_last_at").over(stretches).alias("_before_at"))
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)], F.col("_b") == F.col("_sb"))
    out = inside.join(before, on, "left")
    gap = micros(F.col(ts)) - micros(F.coalesce("_at", "_before_at"))
    return out.withColumns({"_prev": F.coalesce("_prev", "_before"), "_gap": gap}).drop("_at", "_before", "_before_at", "_sb", *[f"_k{i}" for i in range(len(keys))])


def adjacent(rows: DataFrame, keys: list[str], window_hours: float, ts: str = "ts", id_: str = "id") -> DataFrame:
    """Consecutive rows of each key (by time, then id) up to a gap apart: keys, from_id, to_id, gap_us. No self-join."""
    out = linked(rows.select(*dict.fromkeys([*keys, ts, id_])), keys, window_hours, ts, id_)
    return out.where(F.col("_gap") <= int(window_hours * 3_600_000_000)).select(*keys, F.col("_prev").alias("from_id"), F.col(id_).alias("to_id"), F.col("_gap").alias("gap_us"))


def gap_components(rows: DataFrame, keys: list[str], window_hours: float, ts: str = "ts", id_: str = "id") -> DataFrame:
    """``rows`` with ``component``: the number of gaps over the window up to it, within each key."""
    far = F.coalesce(F.col("_gap") > int(window_hours * 3_600_000_000), F.lit(True)).cast("int")
    out = linked(rows, keys, window_hours, ts, id_).drop("_prev").withColumn("_far", far).drop("_gap")
    stretches = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = out.groupBy(*keys, "_b").agg(F.sum("_far").alias("_n"))
    sums = sums.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_b").alias("_sb"), F.coalesce(F.sum("_n").over(stretches), F.lit(0)).alias("_before"))
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)], F.col("_b") == F.col("_sb"))
    line = Window.partitionBy(*keys, "_b").orderBy(ts, in_text_order(F.col(id_)))
    out = out.join(sums, on).withColumn("component", (F.sum("_far").over(line) + F.col("_before")).cast("long"))
    return out.drop("_far", "_b", "_sb", "_before", *[f"_k{i}" for i in range(len(keys))])


def candidates(atoms: DataFrame, bridge: DataFrame, window_hours: float) -> DataFrame:
    """project, phase, key, from_id, to_id, gap_us of every adjacent pair.

    ``atoms``: id, ts, project, owner (null: none). ``bridge``: id, ts, project, key, membership.
    """
    shared = adjacent(bridge.where("membership <> 'none'").select("id", "ts", "project", "key", "membership").distinct(), ["project", "membership", "key"], window_hours)
    shared = shared.select("project", F.when(F.col("membership") == "strong", STRONG).otherwise(WEAK).alias("phase"), "key", "from_id", "to_id", "gap_us")
    lineage = adjacent(atoms.where("owner is not null"), ["project", "owner"], window_hours)
    return shared.unionByName(lineage.select("project", F.lit(LINEAGE).alias("phase"), F.col("owner").alias("key"), "from_id", "to_id", "gap_us"))


def tree_edges(ordered: list[tuple[int, str, str]], owners: dict[str, str | None]) -> tuple[dict[str, str], list[int]]:
    """Which of the edges (phase, a, b) make the forest, in their order, and the least id of each node's tree.

    The rule: an edge makes one tree of two; a weak one only if a side has no owner yet, or both have one in common. Trees are lists of
    nodes, and the shorter is relabelled.
    """
    label = {i: n for n, i in enumerate(owners)}
    trees = [[i] for i in owners]
    owned = [set() if o is None else {o} for o in owners.values()]
    made = []
    for n, (phase, a, b) in enumerate(ordered):
        x, y = label[a], label[b]
        if x == y:
            continue
        if phase == WEAK and owned[x] and owned[y] and not owned[x] & owned[y]:
            continue
        if len(trees[x]) < len(trees[y]):
            x, y = y, x
        for i in trees[y]:
            label[i] = x
        trees[x] += trees[y]
        owned[x] |= owned[y]
        trees[y], owned[y] = [], set()
        made.append(n)
    return {i: least for t in trees if t for least in [min(t)] for i in t}, made


def forest_runs(atoms: DataFrame, bridge: DataFrame, window_hours: float) -> tuple[DataFrame, DataFrame]:
    """Atoms with the number of their run, and the candidate edges with it and their place in the order of decisions.

    Strong edges come first, then weak ones, each by gap, key and ends; then those of lineage by owner and time.
    """
    runs = gap_components(atoms.select("project", "id", "ts", "owner"), ["project"], window_hours).withColumnRenamed("component", "run")
    edges = candidates(atoms, bridge, window_hours).join(runs.select("project", F.col("id").alias("to_id"), "run", F.col("ts").alias("to_ts")), ["project", "to_id"])
    shared = F.col("phase") < LINEAGE
    order = Window.partitionBy("project", "run").orderBy(
        "phase", F.when(shared, F.col("gap_us")), in_text_order(F.col("key")), F.when(~shared, F.col("to_ts")), in_text_order(F.col("from_id")), in_text_order(F.col("to_id")),
    )
    return runs, edges.withColumn("place", F.row_number().over(order)).drop("to_ts")


def constrained_forest(atoms: DataFrame, bridge: DataFrame, window_hours: float = 4.0) -> DataFrame:
    """project, id, component (least id of its cluster), links (array of from, to, keys; on the component's first row only).

    Whether a weak edge counts depends on those before it, so a run of a project's time line is decided in one task; runs are apart by more
    than the window, which no edge crosses, so that a project is many tasks, each as large as its longest stretch of uninterrupted work.
    The task only decides; further keys of an accepted pair, the first 32 in order, are gathered by an aggregation.
    """
    runs, edges = forest_runs(atoms, bridge, window_hours)
    # Read by the decisions and by the keys; both are written once.
    edges = materialized_rows(edges, "edges")
    none = lambda kind: F.lit(None).cast(kind)
    nodes = runs.select("project", "run", "id", "owner", none("int").alias("phase"), none("int").alias("place"), none("string").alias("to_id"))
    rows = nodes.unionByName(edges.select("project", "run", F.col("from_id").alias("id"), none("string").alias("owner"), "phase", "place", "to_id"))

    def decide(pdf: pd.DataFrame) -> pd.DataFrame:
        own, links = pdf[pdf["phase"].isna()], pdf[pdf["phase"].notna()].sort_values("place")
        owners = {i: (o if isinstance(o, str) else None) for i, o in zip(own["id"], own["owner"], strict=True)}
        tree, made = tree_edges(list(zip(links["phase"].astype(int), links["id"], links["to_id"], strict=True)), owners)
        first = {"project": pdf["project"].iloc[0], "run": pdf["run"].iloc[0]}
        out = [pd.DataFrame({"id": list(tree), "component": list(tree.values()), "to_id": None, "made": None})]
        if made:
            kept = links.iloc[made]
            out.append(pd.DataFrame({"id": kept["id"].tolist(), "component": [tree[i] for i in kept["id"]], "to_id": kept["to_id"].tolist(), "made": kept["place"].astype("int64").tolist()}))
        return pd.concat(out).assign(**first)[["project", "run", "id", "component", "to_id", "made"]]

    decided = materialized_rows(rows.groupBy("project", "run").applyInPandas(decide, "project string, run long, id string, component string, to_id string, made int"), "decided")
    # The keys of a pair: that it was accepted by, then those of its later candidates, without lineage; 32 at most.
    ends = lambda a, b: (F.least(a, b).alias("from"), F.greatest(a, b).alias("to"))
    accepted = decided.where("made is not null").select(F.col("project").alias("p"), "component", "made", *ends("id", "to_id"))
    pairs = edges.select("project", "place", "phase", "key", *ends("from_id", "to_id"))
    later = pairs.join(accepted, ["from", "to"]).where(F.col("project").eqNullSafe(F.col("p")))
    later = later.where((F.col("place") == F.col("made")) | ((F.col("place") > F.col("made")) & (F.col("phase") < LINEAGE)))
    keys = later.groupBy("project", "component", "from", "to").agg(F.array_sort(F.collect_list(F.struct("place", "key"))).alias("k"))
    keys = keys.select("project", "component", F.struct("from", "to", F.array_sort(F.slice(F.array_distinct("k.key"), 1, MAX_ARTIFACTS)).alias("keys")).alias("link"))
    links = keys.groupBy("project", "component").agg(F.array_sort(F.collect_list("link")).alias("links")).withColumnsRenamed({"project": "p", "component": "c"})
    members = decided.where("made is null").select("project", "id", "component")
    out = members.join(links, (F.col("id") == F.col("c")) & F.col("project").eqNullSafe(F.col("p")), "left")
    empty = F.array().cast("array<struct<`from`: string, `to`: string, keys: array<string>>>")
    return out.select("project", "id", "component", F.coalesce("links", empty).alias("links"))


def without_redundant(links: Column, role) -> Column:
    """The links with a key that stands for work, or for what is not known; those of scopes and sessions alone go."""
    return F.filter(links, lambda e: (F.size(e["keys"]) == 0) | F.exists(e["keys"], lambda k: ~role(k).isin("scope", "session")))
