"""SimHash near-duplicates: fingerprints, pigeonhole blocks, Hamming verification, components."""

from __future__ import annotations

from copy import copy
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import byte_values, connected_components, release, shuffle_width, signed, written

#: A run of fingerprints up to this long is compared directly; a longer one by looking up every flip of up to ``radius`` bits.
DIRECT_RUN = 2048


def fingerprints(text: bytes, words: int = 3, seed: int = 42, extra: int = 0) -> list[int]:
    """The 64-bit SimHash of the shingles of a text, repeats included, and ``extra`` more from other hashes; zeros for a text without words."""
    return folded(shingle_hashes(text, words, seed), extra)


def shingle_hashes(text: bytes, words: int, seed: int = 42) -> list[bytes]:
    w = text.lower().split()
    digest = xxhash.xxh64_digest
    if len(w) < words:
        return [digest(b" ".join(w), seed)] if w else []
    return [digest(b" ".join(s), seed) for s in zip(*(w[i:] for i in range(words)), strict=False)]


def shingle_set(text: bytes, words: int) -> np.ndarray:
    """The distinct hashes of the shingles, in order."""
    return np.unique(np.frombuffer(b"".join(shingle_hashes(text, words)), ">u8").astype(np.uint64))


def folded(hashes: list[bytes], extra: int = 0) -> list[int]:
    """The fingerprint of hashed shingles, and ``extra`` more; zeros for none."""
    if not hashes:
        return [0] * (1 + extra)
    votes = np.zeros((1 + extra, 64), np.int64)
    for at in range(0, len(hashes), 1 << 13):
        part = np.frombuffer(b"".join(hashes[at : at + (1 << 13)]), np.uint8)
        for k in range(1 + extra):
            if k:
                h = part.view(">u8").astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15 + 2 * k)
                h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                own = (h ^ (h >> np.uint64(32))).view(np.uint8)
            else:
                own = part
            votes[k] += np.unpackbits(own.reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return [int.from_bytes(np.packbits(v * 2 > len(hashes)).tobytes(), "big") for v in votes]


def fingerprint(text: bytes, words: int = 3, seed: int = 42) -> int:
    return fingerprints(text, words, seed)[0]


def with_fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """Columns doc_id, fp (the fingerprint as a signed long)."""

    def run(batches):
        for b in batches:
            fp = [signed(fingerprint(t, words)) for t in byte_values(b.column("text"))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def block_masks(radius: int, spare: int) -> list[int]:
    """Masks of every choice of ``spare`` blocks out of radius + spare: close fingerprints agree on one of them at least."""
    n = radius + spare
    edges = [64 * i // n for i in range(n + 1)]
    blocks = [((1 << (edges[i + 1] - edges[i])) - 1) << edges[i] for i in range(n)]
    return [sum(c) for c in combinations(blocks, spare)]


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def linked_labels(run: np.ndarray, radius: int, free_bits: int, direct: int = DIRECT_RUN) -> np.ndarray:
    """For sorted distinct fingerprints: the index of the first one in the same component by links of up to ``radius`` bits.

    A run longer than ``direct`` is compared by flips of the free bits.
    """
    n = len(run)
    labels = np.arange(n)

    def near(a: slice, b: slice) -> tuple[np.ndarray, np.ndarray]:
        i, j = np.nonzero(_popcount(run[a, None] ^ run[None, b]) <= radius)
        return i + (a.start or 0), j + (b.start or 0)

    def settle(pairs) -> None:
        nonlocal labels
        while True:
            new = labels.copy()
            for i, j in pairs():
                np.minimum.at(new, i, new[j])
                np.minimum.at(new, j, new[i])
            new = np.minimum(new, new[new])
            if (new == labels).all():
                return
            labels = new

    step = 1024
    if n <= direct:
        found = [near(slice(a, min(a + step, n)), slice(b, min(b + step, n))) for a in range(0, n, step) for b in range(a, n, step)]
        settle(lambda: found)
    else:
        bits = np.array([np.uint64(1) << np.uint64(i) for i in range(64) if free_bits >> i & 1], np.uint64)
        flips = [np.bitwise_or.reduce(bits[list(c)]) for r in range(1, radius + 1) for c in combinations(range(len(bits)), r)]

        def flipped():
            for mask in flips:
                x = run ^ mask
                at = np.minimum(np.searchsorted(run, x), n - 1)
                hit = np.nonzero(run[at] == x)[0]
                if len(hit):
                    yield hit, at[hit]

        settle(flipped)
    return labels


def links(classes: DataFrame, radius: int = 3, spare: int = 3, direct: int = DIRECT_RUN) -> DataFrame:
    """A forest (columns a, b: nodes) that joins the same fingerprints as all links would. ``classes``: columns node, fp, one row per fp.

    Each fingerprint goes to every choice of ``spare`` blocks; those that agree there meet in one sorted run of a partition. A run
    holds distinct fingerprints only, so exact copies never swell it, and gives fewer edges than it has members.
    """
    spark = classes.sparkSession
    masks = block_masks(radius, spare)
    table = F.array(*[F.struct(F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key")) for i, m in enumerate(masks)])
    rows = classes.select("node", "fp", F.explode(table).alias("t")).select(F.col("t.i").alias("i"), F.col("t.key").alias("key"), "fp", "node")
    rows = rows.repartition(shuffle_width(spark), "i", "key").sortWithinPartitions("i", "key", "fp")

    def solve(i: int, fp, node):
        order = np.argsort(fp.view(np.uint64), kind="stable")
        node = node[order]
        lab = linked_labels(fp[order].view(np.uint64), radius, ~masks[i] & (1 << 64) - 1, direct)
        k = np.nonzero(lab != np.arange(len(lab)))[0]
        return node[k], node[lab[k]]

    def run(batches):
        held = None
        for b in batches:
            cols = [b.column(c).to_numpy() for c in ("i", "key", "fp", "node")]
            if held is not None:
                cols = [np.concatenate(c) for c in zip(held, cols, strict=True)]
            i, key = cols[:2]
            cut = np.nonzero((i[1:] != i[:-1]) | (key[1:] != key[:-1]))[0] + 1
            last = int(cut[-1]) if len(cut) else 0
            held = [c[last:].copy() for c in cols]
            if last:
                yield from done(np.concatenate([[0], cut]), cols[0], cols[2:])
        if held is not None:
            yield from done(np.array([0, len(held[0])]), held[0], held[2:])

    def done(edge, i, cols):
        sizes = np.diff(edge)
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        two = edge[:-1][sizes == 2]
        two = two[_popcount(cols[0][two].view(np.uint64) ^ cols[0][two + 1].view(np.uint64)) <= radius]
        a.append(cols[1][two + 1])
        b.append(cols[1][two])
        for s, m in zip(edge[:-1][sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
            x, y = solve(int(i[s]), *(c[s : s + m] for c in cols))
            a.append(x)
            b.append(y)
        a, b = np.concatenate(a), np.concatenate(b)
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = 3, words: int = 3, spare: int = 3) -> DataFrame:
    """Columns doc_id, fingerprint (16 hex digits), component_id: one row per row of ``docs``.

    Null and blank texts have fingerprint zero and are linked like any other. A row with a null doc_id links like the rest;
    component_id is the smallest non-null doc_id reachable, or null if there is none. Repeated rows give repeated rows.
    An empty table gives an empty table; other columns are ignored.
    """
    fps = written(with_fingerprints(docs, words), "simhash")
    spare_id = F.lit(1 << 62) + F.col("fp").bitwiseAND(F.lit((1 << 61) - 1))
    classes = written(fps.groupBy("fp").agg(F.min("doc_id").alias("first")).select("fp", F.coalesce("first", spare_id).alias("node")), "simhash")
    comps = connected_components(links(classes, radius, spare))
    of_fp = classes.join(comps, "node", "left").select("fp", F.coalesce("component", "node").alias("c"))
    out = fps.join(of_fp, "fp").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("c") < F.lit(1 << 62), F.col("c")).alias("component_id"),
    )
    return out


#: keep_one: fingerprints beside the first (all of them give block keys, the first two are compared), and bits that may differ in those
#: two. Texts whose shingle sets have a Jaccard similarity of 0.8 differ in 0.152 of the bits on average (19.4 of 128, deviation 4.1), with
#: a deviation of 0.02 over all 320; DIFFER is two of these more.
WIDE, RADIUS, DIFFER = 4, 34, 0.192
#: Chance that a pair with so many differing bits shares a block, by which the number of blocks is chosen; rows that a block's run has of
#: unrelated texts, about; run up to which all of its rows are compared.
RECALL, RUN, COMPARED = 0.98, 4, 1024
#: Nearest texts that each one is checked against first (of those that it meets in the first FIRST blocks); candidates left over (counted in the
#: first COUNTED blocks) from which a text is checked
#: against all rows in a block of such texts instead; bytes of the sets of a block; bits of all fingerprints that may differ then (3.2
#: deviations over the mean).
NEAREST, FIRST, DENSE, COUNTED, BLOCK_BYTES, LIMIT = 4, 32, 8, 16, 16 << 20, 69
#: Blocks at least; few texts cost little.
LEAST_BLOCKS = 64
#: Least Jaccard similarity of the shingle sets, as a fraction.
LEAST = (4, 5)


class Blocks:
    """Choices of bits of the fingerprints of which similar texts agree on one. With more texts a block has more bits, so that the runs of a
    block stay as short, and there are more blocks, about n ** 0.24."""

    def __init__(self, n: int, seed: int = 3):
        self.bits = min(40, max(8, int(np.ceil(np.log2(max(n, 2) / RUN)))))
        each = (1 - DIFFER) ** self.bits
        self.n = max(LEAST_BLOCKS, int(np.ceil(np.log(1 - RECALL) / np.log(1 - each))))
        rng = np.random.default_rng(seed)
        self.chosen = np.stack([rng.permutation(64 * (1 + WIDE))[: self.bits] for _ in range(self.n)])

    def first(self, n: int) -> Blocks:
        """The first n blocks alone."""
        out = copy(self)
        out.n, out.chosen = min(n, self.n), self.chosen[:n]
        return out

    def keys(self, prints: np.ndarray) -> np.ndarray:
        """The block keys (rows x blocks) of fingerprints (rows x 1 + WIDE), each with its block's number above its bits."""
        bits = np.unpackbits(np.ascontiguousarray(prints).astype(">u8").view(np.uint8).reshape(len(prints), -1), axis=1)
        out = np.zeros((len(prints), self.n), np.int64)
        for k in range(self.bits):
            out = out * 2 + bits[:, self.chosen[:, k]]
        return out + (np.arange(self.n, dtype=np.int64) << self.bits)


def compared(i: np.ndarray, j: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs of rows that differ in up to RADIUS bits, and in how many."""
    d = _popcount(x[i] ^ x[j]).astype(np.int64) + _popcount(y[i] ^ y[j])
    k = d <= RADIUS
    return i[k], j[k], d[k]


def pairs_in_runs(key: np.ndarray, comp: np.ndarray, x: np.ndarray, y: np.ndarray, seed: int = 9):
    """(i, j, bits that differ) of rows with one key (rows come in order of it) but of different components.

    All pairs of short runs are compared, row by row distance. In a long run (a group of near-copies, most of which are one component by
    then, or a block that much text shares) the rows of its largest component are compared with the others only; and if those are many,
    the run is dealt by further bits into shorter ones, as often as recall asks for.
    """
    edge = np.concatenate([[0], np.nonzero(key[1:] != key[:-1])[0] + 1, [len(key)]])
    size = np.repeat(np.diff(edge), np.diff(edge))
    rows, step = np.nonzero(size <= COMPARED)[0], 1
    while len(rows):
        rows = rows[rows + step < len(key)]
        rows = rows[key[rows] == key[rows + step]]
        apart = rows[comp[rows] != comp[rows + step]]
        yield compared(apart, apart + step, x, y)
        step += 1
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        if b - a > COMPARED:
            names, inverse, n = np.unique(comp[a:b], return_inverse=True, return_counts=True)
            inside = np.arange(a, b)
            few = inside[inverse != n.argmax()]
            if len(few) <= COMPARED:
                for at in range(0, len(few), 64):
                    i, j = np.repeat(few[at : at + 64], b - a), np.tile(inside, len(few[at : at + 64]))
                    k = comp[i] != comp[j]
                    yield compared(i[k], j[k], x, y)
                continue
            rng = np.random.default_rng(seed)
            more = int(np.ceil(np.log2((b - a) / COMPARED))) + 2
            bits = np.unpackbits(np.stack([x[a:b], y[a:b]], 1).astype(">u8").view(np.uint8).reshape(b - a, -1), axis=1)
            for _ in range(int(np.ceil(np.log(1 - RECALL) / np.log(1 - (1 - DIFFER) ** more)))):
                own = bits[:, rng.permutation(128)[:more]] @ (1 << np.arange(more))
                order = np.argsort(own, kind="stable")
                line, own = inside[order], own[order]
                # Rows that agree on these bits too are compared with the COMPARED next ones of their run.
                left = np.arange(len(own))
                for step in range(1, COMPARED):
                    left = left[left + step < len(own)]
                    left = left[own[left] == own[left + step]]
                    if not len(left):
                        break
                    i, j = line[left], line[left + step]
                    k = comp[i] != comp[j]
                    yield compared(i[k], j[k], x, y)


def candidates(classes: DataFrame, blocks: Blocks, what: str) -> DataFrame:
    """Pairs of nodes (columns node, comp, size of the component, dense, fp, x1 to x<WIDE>) of different components that agree on a block and
    differ in up to RADIUS bits. A pair is told by its node of the smaller component, of two alike the lower.

    ``what``: nearest (columns a, b, d: for each node the nearest one that it meets in a task, in the first blocks), counts (node, n: how many
    pairs are told by a node in the first blocks, once for each task) or pairs (a, b: all whose node is not dense).
    """
    if what != "pairs":
        blocks = blocks.first(COUNTED if what == "counts" else FIRST)
    names = ["fp", *[f"x{k + 1}" for k in range(WIDE)]]
    own = ("node", "comp", "size", "dense", "fp", "x1")

    def spread(batches):
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                part = b.slice(at, 4096)
                keys = blocks.keys(np.stack([part.column(c).to_numpy().view(np.uint64) for c in names], 1))
                n = keys.shape[1]
                cols = [np.repeat(part.column(c).to_numpy(zero_copy_only=False), n) for c in own]
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), *map(pa.array, cols)], ["key", *own])

    columns = "key long, node long, comp long, size long, dense boolean, fp long, x1 long"
    rows = classes.select("node", "comp", F.col("size").cast("long"), "dense", *names).mapInArrow(spread, columns).repartition(shuffle_width(classes.sparkSession), "key").sortWithinPartitions("key")

    def run(batches):
        held, parts = None, []
        for b in batches:
            cols = [b.column(c).to_numpy(zero_copy_only=False) for c in ("key", *own)]
            if held is not None:
                cols = [np.concatenate(c) for c in zip(held, cols, strict=True)]
            last = int(np.searchsorted(cols[0], cols[0][-1]))
            held = [c[last:].copy() for c in cols]
            yield from found([c[:last] for c in cols], parts)
        if held is not None:
            yield from found(held, parts)
        if parts:
            yield _pairs(parts, what)

    def found(cols, parts: list[tuple]):
        if len(cols[0]) < 2:
            return
        key, node, comp, size, dense = cols[:5]
        for i, j, d in pairs_in_runs(key, comp, cols[5].view(np.uint64), cols[6].view(np.uint64)):
            if not len(i):
                continue
            if what == "nearest":
                parts.append(_nearest([(node[np.concatenate([i, j])], node[np.concatenate([j, i])], np.concatenate([d, d]))]))
            else:
                tells = np.where((size[i] < size[j]) | ((size[i] == size[j]) & (node[i] < node[j])), i, j)
                if what == "counts":
                    parts.append(np.unique(node[tells], return_counts=True))
                else:
                    k = ~dense[tells]
                    parts.append((np.minimum(node[i[k]], node[j[k]]), np.maximum(node[i[k]], node[j[k]])))
            if sum(len(x[0]) for x in parts) > 1 << 18:
                parts[:] = [TOGETHER[what](parts)]
                if len(parts[0][0]) > 1 << 17:
                    yield _pairs(parts, what)
                    parts.clear()

    return rows.mapInArrow(run, ", ".join(f"{c} long" for c in COLUMNS[what]))


def _nearest(parts: list[tuple]) -> tuple[np.ndarray, ...]:
    """Of each first node the nearest second one."""
    a, b, d = (np.concatenate(c) for c in zip(*parts, strict=True))
    order = np.lexsort((b, d, a))
    first = order[np.concatenate([[True], a[order][1:] != a[order][:-1]])] if len(order) else order
    return a[first], b[first], d[first]


def _summed(parts: list[tuple]) -> tuple[np.ndarray, ...]:
    nodes, of = np.unique(np.concatenate([x for x, _ in parts]), return_inverse=True)
    return nodes, np.bincount(of, np.concatenate([n for _, n in parts])).astype(np.int64)


def _distinct(parts: list[tuple]) -> tuple[np.ndarray, ...]:
    a, b = (np.concatenate(c) for c in zip(*parts, strict=True))
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    first = np.ones(len(a), bool)
    first[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[first], b[first]


COLUMNS = {"nearest": ("a", "b", "d"), "counts": ("node", "n"), "pairs": ("a", "b")}
TOGETHER = {"nearest": _nearest, "counts": _summed, "pairs": _distinct}


def _pairs(parts: list[tuple], what: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in TOGETHER[what](parts)], list(COLUMNS[what]))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets (sorted, distinct) have a Jaccard similarity of LEAST or more."""
    (num, den), small, large = LEAST, min(len(a), len(b)), max(len(a), len(b))
    if small * den < large * num:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * den >= (small + large - both) * num


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose shingle sets (columns node, s) are similar."""

    def run(batches):
        for b in batches:
            ok = [similar(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")) for x, y in zip(b.column("s").to_pylist(), b.column("t").to_pylist(), strict=True)]
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    both = pairs.join(sets.select(F.col("node").alias("a"), "s"), "a").join(sets.select(F.col("node").alias("b"), F.col("s").alias("t")), "b")
    return both.select("a", "b", "s", "t").mapInArrow(run, "a long, b long")


def dense_links(placed: DataFrame, dense: DataFrame, sets_of) -> DataFrame:
    """Links (columns a, b) of the dense nodes with nodes of other components: one of each component that a task meets is enough.

    Dense nodes are texts among many near-copies that they are not quite similar to. They are a query set against all rows, in blocks of
    bounded bytes: a scan of the fingerprints finds the rows that any of them may be similar to, and the sets of these are compared with the
    sets of the block in place, so that no pair is ever a row.
    """
    spark, names = placed.sparkSession, ["fp", *[f"x{k + 1}" for k in range(WIDE)]]
    prints = written(placed.join(dense, "node", "left_semi").select("node", "comp", *names), "dense")
    own_sets = sets_of(dense)
    bounds = own_sets.select(F.floor(F.sum(F.octet_length("s")) / BLOCK_BYTES).alias("n")).first().n or 0
    n_blocks = int(bounds) + 1
    out = []
    for k in range(n_blocks):
        block = prints.join(own_sets, "node").where(F.pmod(F.xxhash64("node"), F.lit(n_blocks)) == k).toArrow()
        if not block.num_rows:
            continue
        ids, of = block["node"].to_numpy(), block["comp"].to_numpy()
        bits = np.stack([block[c].to_numpy().view(np.uint64) for c in names], 1)
        sets = [np.frombuffer(x, "<u8") for x in block["s"].to_pylist()]

        def close(b, bits=bits, of=of):
            """(row, node of the block) that may be similar, of other components."""
            x, comp = np.stack([b.column(c).to_numpy().view(np.uint64) for c in names], 1), b.column("comp").to_numpy()
            for at in range(0, len(x), 256):
                d = _popcount(x[at : at + 256, None, 0] ^ bits[None, :, 0]) + _popcount(x[at : at + 256, None, 1] ^ bits[None, :, 1])
                i, j = np.nonzero((d <= RADIUS) & (comp[at : at + 256, None] != of[None, :]))
                k = _popcount(x[i + at] ^ bits[j]).sum(1, dtype=np.int64) <= LIMIT
                yield i[k] + at, j[k]

        def partners(batches, close=close):
            for b in batches:
                rows = np.unique(np.concatenate([np.zeros(0, np.int64), *(i for i, _ in close(b))]))
                yield pa.RecordBatch.from_arrays([b.column("node").take(pa.array(rows))], ["node"])

        met = sets_of(placed.mapInArrow(partners, "node long"))

        def check(batches, close=close, ids=ids, of=of, sets=sets):
            done = set()
            for b in batches:
                a, b_ = [], []
                node, comp, s = b.column("node").to_numpy(), b.column("comp").to_numpy(), b.column("s").to_pylist()
                for i, j in close(b):
                    for x, y in zip(i.tolist(), j.tolist(), strict=True):
                        if (comp[x], y) not in done and similar(np.frombuffer(s[x], "<u8"), sets[y]):
                            done.add((comp[x], y))
                            a.append(int(ids[y]))
                            b_.append(int(node[x]))
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b_, pa.int64())], ["a", "b"])

        out.append(written(placed.join(met, "node").select("node", "comp", "s", *names).mapInArrow(check, "a long, b long"), "edges"))
        release(spark, met)
    release(spark, prints, own_sets)
    return reduce(DataFrame.unionByName, out) if out else spark.createDataFrame([], "a long, b long")


def keep_one(docs: DataFrame, words: int = 5) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: that of the smallest doc_id, then text hash (null ids come last).

    Links are pairs whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, checked on the sets; the pairs to check
    come from blocks of fingerprints. First each text is checked against the few nearest ones that it meets; then all pairs that still would
    join two components, and texts with very many of these, block by block, against all rows (``dense_links``). Texts without words are one group. Rows that repeat both doc_id and text stay or go together. All
    columns pass through; an empty table gives none.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    more = [f"x{k + 1}" for k in range(WIDE)]

    def run(batches):
        for b in batches:
            sets = [shingle_set(t, words) for t in byte_values(b.column("text"))]
            node = [signed(xxhash.xxh64_intdigest(s.tobytes())) for s in sets]
            fps = [[signed(x) for x in folded([h.tobytes() for h in s.astype(">u8")], WIDE)] for s in sets]
            cols = [pa.array(c, pa.int64()) for c in zip(*fps, strict=True)] or [pa.array([], pa.int64())] * (1 + WIDE)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("h"), pa.array(node, pa.int64()), *cols], ["doc_id", "h", "node", "fp", *more])

    def run_sets(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array([shingle_set(t, words).astype("<u8").tobytes() for t in byte_values(b.column("text"))], pa.binary())], ["node", "s"])

    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h"))
    fps = written(rows.mapInArrow(run, ", ".join(f"{c} long" for c in ("doc_id", "h", "node", "fp", *more))), "fingerprints")
    classes = written(fps.groupBy("node").agg(*[F.min(c).alias(c) for c in ("h", "fp", *more)]), "classes")
    blocks = Blocks(classes.count())

    def sets_of(nodes: DataFrame) -> DataFrame:
        wanted = rows.select("text", "h").join(classes.join(nodes.distinct(), "node", "left_semi").select("node", "h"), "h").dropDuplicates(["node"])
        return written(wanted.select("node", "text").mapInArrow(run_sets, "node long, s binary"), "sets")

    def checked(pairs: DataFrame) -> DataFrame:
        sets = sets_of(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))))
        out = written(verified(pairs, sets), "edges")
        release(spark, sets)
        return out

    near = candidates(classes.withColumns({"comp": F.col("node"), "size": F.lit(1), "dense": F.lit(False)}), blocks, "nearest")
    near = near.groupBy("a").agg(F.slice(F.array_sort(F.collect_set(F.struct("d", "b"))), 1, NEAREST).alias("n")).select("a", F.explode("n.b").alias("b"))
    near = written(near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    edges = checked(near)
    comps = written(connected_components(edges), "components")
    sizes = comps.groupBy("component").agg(F.count("*").alias("size"))
    placed = classes.join(comps.join(sizes, "component").withColumnRenamed("component", "comp"), "node", "left")
    placed = written(placed.select(*classes.columns, F.coalesce("comp", "node").alias("comp"), F.coalesce("size", F.lit(1)).alias("size")), "placed")
    left = candidates(placed.withColumn("dense", F.lit(False)), blocks, "counts").groupBy("node").agg(F.sum("n").alias("n"))
    left = written(left, "left")
    dense = written(left.where(F.col("n") > DENSE).select("node"), "dense")
    rest = candidates(placed.join(dense.withColumn("_d", F.lit(True)), "node", "left").withColumn("dense", F.col("_d").isNotNull()), blocks, "pairs")
    rest = written(rest.distinct().join(near, ["a", "b"], "left_anti"), "pairs")
    release(spark, near, left)
    more_edges = ([] if rest.isEmpty() else [checked(rest)]) + ([] if dense.isEmpty() else [dense_links(placed, dense, sets_of)])
    release(spark, rest, dense, placed)
    if more_edges:
        comps = connected_components(reduce(DataFrame.unionByName, more_edges, edges))
    placed = fps.select("node", "doc_id", "h", F.coalesce(F.col("doc_id"), F.lit((1 << 63) - 1)).alias("o"))
    placed = placed.join(comps, "node", "left").select(F.coalesce("component", "node").alias("c"), "doc_id", "h", "o")
    least = placed.groupBy("c").agg(F.min("o").alias("o"))
    first = placed.join(least, ["c", "o"]).groupBy("c", "o").agg(F.min("h").alias("h"), F.min_by("doc_id", "h").alias("doc_id"))
    keep = first.select("doc_id", "h")
    tagged = docs.select(F.struct("*").alias("r"), F.col("doc_id").cast("long").alias("d"), F.xxhash64(text).alias("h"))
    kept = tagged.join(keep, tagged["d"].eqNullSafe(keep["doc_id"]) & (tagged["h"] == keep["h"]), "left_semi")
    return kept.select(*[F.col(f"r.`{c}`") for c in docs.columns])


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
