"""Near-duplicate vectors by an inverted multi-index.

Two codebooks, fitted on a bounded sample, quantize the halves of unit vectors; their product is a grid of cells, and every vector is
listed in its cell. A query visits cells by multi-sequence traversal, nearest first, until the extra distance exceeds what covers the
target recall; that is measured on pairs planted at the similarity threshold itself. The vectors of a visited cell are verified by
their exact cosine in double precision.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import connected_components, shuffle_width, written

#: Vectors that the codebooks are fitted on, planted pairs for the traversal bound, vectors in a block at most (about), in a cell on average;
#: centres in a codebook at most, each of 8 vectors of the sample: the grid grows with the rows up to 4.2 million cells.
SAMPLE, PLANTED, BLOCK, PER_CELL, CENTRES = 16_384, 4_096, 512, 64, 2_048


def codebook(x: np.ndarray, k: int, seed: int, rounds: int = 8) -> np.ndarray:
    """Lloyd's k-means on a sample."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        own = distances(x, c).argmin(1)
        n = np.bincount(own, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances, without the part that doesn't depend on the centre."""
    return (c * c).sum(1) - 2 * x @ c.T


def traverse(a: np.ndarray, b: np.ndarray, margin: float):
    """Cells (i, j) by growing a[i] + b[j], from the least sum on until it is exceeded by ``margin`` (Babenko and Lempitsky's multi-sequence algorithm)."""
    ia, ib = a.argsort(kind="stable"), b.argsort(kind="stable")
    sa, sb = a[ia].tolist(), b[ib].tolist()
    limit = sa[0] + sb[0] + margin
    heap, reached = [(sa[0] + sb[0], 0, 0)], [0] * len(sa)
    while heap:
        s, p, q = heapq.heappop(heap)
        if s > limit:
            return
        yield int(ia[p]), int(ib[q])
        reached[p] = q + 1
        if p + 1 < len(sa) and reached[p + 1] == q:
            heapq.heappush(heap, (sa[p + 1] + sb[q], p + 1, q))
        if q + 1 < len(sb) and (p == 0 or reached[p - 1] > q + 1):
            heapq.heappush(heap, (sa[p] + sb[q + 1], p, q + 1))


class MultiIndex:
    """Codebooks of the halves and the margin of the traversal."""

    def __init__(self, sample: np.ndarray, cells: int, threshold: float, recall: float, seed: int = 7):
        self.half = sample.shape[1] // 2
        k = max(1, min(int(np.ceil(cells**0.5)), CENTRES, len(sample)))
        self.k, self.a, self.b = k, codebook(sample[:, : self.half], k, seed), codebook(sample[:, self.half :], k, seed + 1)
        rng = np.random.default_rng(seed + 2)
        x = sample[rng.choice(len(sample), min(len(sample), PLANTED), replace=False)]
        u = rng.normal(size=x.shape)
        u -= (u * x).sum(1, keepdims=True) * x
        u /= np.linalg.norm(u, axis=1, keepdims=True)
        y = threshold * x + (1 - threshold**2) ** 0.5 * u
        (da, db), (ya, yb) = self.scores(x), self.nearest(y)
        r = np.arange(len(x))
        self.margin = float(np.quantile(da[r, ya] + db[r, yb] - da.min(1) - db.min(1), recall)) + 1e-12

    def scores(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return distances(x[:, : self.half], self.a), distances(x[:, self.half :], self.b)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.scores(x)
        return a.argmin(1), b.argmin(1)

    def cell(self, x: np.ndarray) -> np.ndarray:
        a, b = self.nearest(x)
        return a * self.k + b


def normed(x: np.ndarray) -> np.ndarray:
    """Unit vectors in double precision; scaled first, so that no square over- or underflows."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True) if len(x) else x
    return x / np.linalg.norm(x, axis=1, keepdims=True) if len(x) else x


def raw_rows(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as they are, ended by zeros up to ``width``."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    sizes = np.diff(column.offsets.to_numpy()) if len(column) else np.zeros(0, np.int64)
    if (sizes == width).all():
        return flat.reshape(len(column), width)
    out = np.zeros((len(column), width), flat.dtype)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def usable(vectors: DataFrame) -> DataFrame:
    """Rows vec_id, embedding (arrays of the input's floats, else of doubles) that may link: no null, zero or non-finite ones."""
    kind = "array<float>" if dict(vectors.dtypes)["embedding"] == "array<float>" else "array<double>"
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("embedding"))
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return v.where(good & F.exists("embedding", lambda x: x != 0))


def local_forest(near: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (id, smallest id of its component) of a bipartite graph, fewer than it has nodes."""
    i, j = np.nonzero(near)
    lr, lc = rows.copy(), cols.copy()
    while True:
        before = lr.sum(), lc.sum()
        np.minimum.at(lr, i, lc[j])
        np.minimum.at(lc, j, lr[i])
        if (lr.sum(), lc.sum()) == before:
            break
    nodes, least = np.concatenate([rows, cols]), np.concatenate([lr, lc])
    k = least != nodes
    pairs = np.unique(np.stack([nodes[k], least[k]]), axis=1)
    return pairs[0], pairs[1]


def linked(vectors: DataFrame, threshold: float = 0.95, recall: float = 0.99) -> DataFrame:
    """Columns vec_id, n_links, component_id, kept: one row per row of ``vectors``.

    Vectors that are null, zero, or hold null or non-finite components link with nothing, and none links with one of another length. Equal
    vectors are one node with a count, so a group of copies of any size is never expanded. A pair that either vector's traversal finds counts
    for both. Ids are taken to be unique (a repeated id counts once for each row). A null id is counted as a link of others, and gets a null
    component unless it has a smaller non-null one to reach. An empty table gives none; other columns are ignored.
    """
    spark = vectors.sparkSession
    good = usable(vectors)
    classes = good.groupBy("embedding").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"))
    far = F.lit(1 << 62) + F.xxhash64("embedding").bitwiseAND(F.lit((1 << 61) - 1))
    classes = written(classes.select("embedding", F.coalesce("first", far).alias("node"), "copies"), "vectors")
    n, width = classes.agg(F.count("*"), F.coalesce(F.max(F.size("embedding")), F.lit(0))).first()
    sample = classes.select("embedding", F.xxhash64("embedding").alias("h")).orderBy("h").limit(SAMPLE).select("embedding").toArrow()
    every = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(good.schema["embedding"].dataType).alias("embedding"))
    if not n:
        return every.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    x = raw_rows(sample.column(0).combine_chunks(), width)
    kind, index = x.dtype, MultiIndex(normed(x), max(1, n // PER_CELL), threshold, recall)

    def list_cells(batches):
        for b in batches:
            raw = raw_rows(b.column("embedding"), width)
            sizes = np.diff(b.column("embedding").offsets.to_numpy())
            yield pa.RecordBatch.from_arrays([b.column("node"), b.column("copies"), pa.array(index.cell(normed(raw)), pa.int64()), pa.array(sizes, pa.int64()), pa.array(list(map(np.ndarray.tobytes, raw)), pa.binary())], ["node", "copies", "cell", "dim", "raw"])

    listed = written(classes.mapInArrow(list_cells, "node long, copies long, cell long, dim long, raw binary"), "cells")
    #: One count for each cell of the grid that is not empty, of which there are CENTRES ** 2 at most.
    per_cell = written(listed.groupBy("cell").agg(F.count("*").alias("n")), "counts")
    filled = np.sort(per_cell.select("cell").toArrow()["cell"].to_numpy())

    def vectors_of(raws) -> np.ndarray:
        return np.frombuffer(b"".join(raws), kind).reshape(-1, width)

    def probe(batches):
        for b in batches:
            raw, ids = vectors_of(b.column("raw").to_pylist()), np.stack([b.column("node").to_numpy(), b.column("copies").to_numpy(), b.column("dim").to_numpy()], 1)
            for at in range(0, len(raw), 2048):
                part, own = raw[at : at + 2048], ids[at : at + 2048]
                da, db = index.scores(normed(part))
                to: dict[int, list[int]] = {}
                for r in range(len(part)):
                    for i, j in traverse(da[r], db[r], index.margin):
                        to.setdefault(i * index.k + j, []).append(r)
                cells = np.fromiter(to, np.int64, len(to))
                there = filled[np.minimum(np.searchsorted(filled, cells), len(filled) - 1)] == cells
                found = [(c, own[to[c]].tobytes(), part[to[c]].tobytes()) for c in cells[there].tolist()]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.int64(), pa.binary(), pa.binary()), strict=True)], ["cell", "ids", "raws"])

    def rebatched(batches):
        held, size = [], 0
        for b in batches:
            held.append(b)
            size += b.nbytes
            if size > 4 << 20:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
        if held:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    parts = F.ceil(F.col("n") / BLOCK).cast("int")
    blocks = per_cell.select("cell", parts.alias("blocks"))
    probes = listed.select("node", "copies", "dim", "raw").repartition(shuffle_width(spark)).mapInArrow(lambda it: rebatched(probe(it)), "cell long, ids binary, raws binary")
    probes = probes.join(blocks, "cell").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    stored = listed.join(blocks, "cell").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    stored = stored.groupBy("cell", "block").agg(F.collect_list(F.struct("node", "copies", "dim", "raw")).alias("own"))

    def verify(batches):
        for b in batches:
            for ids, raws, own in zip(b.column("ids").to_pylist(), b.column("raws").to_pylist(), b.column("own"), strict=True):
                rows, times, dims = np.frombuffer(ids, np.int64).reshape(-1, 3).T
                own = own.values
                cols, copies, dim = (own.field(c).to_numpy() for c in ("node", "copies", "dim"))
                p, q = normed(vectors_of([raws])), normed(vectors_of(own.field("raw").to_pylist()))
                near = (p @ q.T >= threshold) & (rows[:, None] != cols) & (dims[:, None] == dim)
                i, j = np.nonzero(near)
                if not len(i):
                    continue
                # A pair that the stored vector's own traversal doesn't reach counts for it here.
                ua, ub = np.unique(j), np.unique(i)
                da, db = index.scores(q[ua])
                ca, cb = index.nearest(p[ub])
                at, of = np.searchsorted(ua, j), np.searchsorted(ub, i)
                lost = da[at, ca[of]] + db[at, cb[of]] > da.min(1)[at] + db.min(1)[at] + index.margin
                back = np.bincount(j[lost], times[i[lost]], len(cols)).astype(np.int64)
                n_links = near @ copies
                k, m = np.nonzero(n_links)[0], np.nonzero(back)[0]
                a, c = local_forest(near, rows, cols)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in ([rows[k], cols[m], a], [n_links[k], back[m], np.zeros(len(a), np.int64)], [rows[k], cols[m], c])], ["node", "links", "other"])

    found = written(probes.join(stored, ["cell", "block"]).select("ids", "raws", "own").mapInArrow(lambda it: rebatched(verify(it)), "node long, links long, other long"), "found")
    comps = connected_components(found.where("node <> other").select(F.col("node").alias("a"), F.col("other").alias("b")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    of_class = classes.join(links, "node", "left").join(comps, "node", "left").select("embedding", F.coalesce("component", "node").alias("c"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    own = every.where("embedding is not null").join(of_class, "embedding", "left")
    own = own.unionByName(every.where("embedding is null").select("embedding", "vec_id", F.lit(None).cast("long").alias("c"), F.lit(None).cast("long").alias("links")))
    component = F.when(F.col("c").isNull(), F.col("vec_id")).when(F.col("c") < F.lit(1 << 62), F.col("c"))
    out = own.select("vec_id", F.coalesce("links", F.lit(0)).alias("n_links"), component.alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
