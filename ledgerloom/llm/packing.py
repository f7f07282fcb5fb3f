"""Best-fit packing by a grouping genetic algorithm on islands.

Pieces of documents are dealt into shards of bounded size. On every shard several islands evolve packings of the same pieces, each from
groupings of its own; after each epoch the elite of an island moves to the next one as a DataFrame exchange. A crossover injects whole
well-filled bins of one parent into the other, drops the bins they collide with, and best-fits the displaced pieces: first in exchange for
one or two pieces of a bin that they fill better, then where they leave the least room. The least filled bins of all shards are pooled, and
packed again in the same way. A packing of as few bins as the total allows ends the search.
"""

from __future__ import annotations

import zlib
from functools import partial

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import BYTE_BPE, text_encoder
from .shared import byte_values, written

SEQUENCE, SHARD = 2048, 4096
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: whole ones of ``size``, before them the remainder if there is one."""
    first = n % size or min(n, size)
    return [(0, first)] + [(s, size) for s in range(first, n, size)]


def pieces(docs: DataFrame, tokenizer_path: str, end_id: int, size: int = SEQUENCE) -> DataFrame:
    """Columns doc_id, piece, start, length, ids_crc32 of every whole text (null: empty), each ended by ``end_id``."""

    def run(batches):
        encode, end = text_encoder(tokenizer_path), np.array([end_id], "<u4").tobytes()
        for b in batches:
            rows = []
            for doc, text in zip(b.column("doc_id").to_pylist(), byte_values(b.column("text")), strict=True):
                ids = encode(text) + end
                rows += [(doc, k, s, n, zlib.crc32(ids[4 * s : 4 * (s + n)])) for k, (s, n) in enumerate(cut(len(ids) // 4, size))]
            if rows:
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in PIECES.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, PIECES)


class Packing:
    """Bins of item numbers, and the room left in each."""

    def __init__(self, bins: list[list[int]], sizes: list[int], capacity: int):
        self.bins, self.room = bins, [capacity - sum(sizes[i] for i in b) for b in bins]

    def fitness(self, capacity: int) -> tuple[int, float]:
        """Fewer bins first, then the mean square of the fill (Falkenauer)."""
        return -len(self.bins), sum((1 - r / capacity) ** 2 for r in self.room) / max(1, len(self.bins))


def placed(order, sizes: list[int], capacity: int, bins: list[list[int]] = ()) -> Packing:
    """``bins``, with the items of ``order`` put where they leave the least room, and new bins for the rest."""
    p = Packing([list(b) for b in bins], sizes, capacity)
    by_room: dict[int, list[int]] = {}
    mask = 0
    for b, r in enumerate(p.room):
        by_room.setdefault(r, []).append(b)
        mask |= 1 << r
    for i in order:
        s = sizes[i]
        fits = mask >> s
        if fits:
            r = s + (fits & -fits).bit_length() - 1
            own = by_room[r]
            b = own.pop()
            if not own:
                mask ^= 1 << r
            p.bins[b].append(i)
        else:
            b, r = len(p.bins), capacity
            p.bins.append([i])
            p.room.append(r)
        p.room[b] = r - s
        by_room.setdefault(r - s, []).append(b)
        mask |= 1 << (r - s)
    return p


class Loose:
    """Items that are in no bin, by size, as bits of a number."""

    def __init__(self, items, sizes: list[int]):
        self.sizes, self.by_size, self.mask = sizes, {}, 0
        for i in items:
            self.add(i)

    def add(self, i: int) -> None:
        self.by_size.setdefault(self.sizes[i], []).append(i)
        self.mask |= 1 << self.sizes[i]

    def largest(self, room: int) -> int:
        """The size of the largest item that fits (0: none does)."""
        return max((self.mask & ((2 << room) - 1)).bit_length() - 1, 0)

    def pop(self, size: int) -> int:
        own = self.by_size[size]
        i = own.pop()
        if not own:
            del self.by_size[size]
            self.mask ^= 1 << size
        return i

    def items(self) -> list[int]:
        return [i for own in self.by_size.values() for i in own]


def refitted(bins: list[list[int]], loose: Loose, sizes: list[int], capacity: int) -> Packing:
    """``bins`` with the loose items best-fitted: a bin takes an item in place of none, one or two of its own as long as that fills it
    better; what is loose in the end goes where it leaves the least room, largest first."""
    bins = [list(b) for b in bins]
    for b in bins:
        room = capacity - sum(sizes[i] for i in b)
        while room:
            n = len(b)
            gain, size, out = 0, 0, ()
            for out_now in ((), *((x,) for x in range(n)), *((x, y) for x in range(n) for y in range(x))):
                freed = sum(sizes[b[x]] for x in out_now)
                fits = loose.largest(room + freed)
                if fits - freed > gain:
                    gain, size, out = fits - freed, fits, out_now
                    if gain == room:
                        break
            if not gain:
                break
            taken = loose.pop(size)
            for x in out:
                loose.add(b[x])
            b[:] = [i for x, i in enumerate(b) if x not in out] + [taken]
            room -= gain
    return placed(sorted(loose.items(), key=sizes.__getitem__, reverse=True), sizes, capacity, bins)


def crossover(a: Packing, b: Packing, sizes: list[int], capacity: int, rng, emptied: float = 0.02) -> Packing:
    """``a`` with some of the fullest bins of ``b`` injected whole; bins that hold a piece of these go, as do the least filled ones of the
    rest (the mutation), and what they held besides is fitted again."""
    full = sorted(range(len(b.bins)), key=lambda k: b.room[k])[: max(1, len(b.bins) // 2)]
    chosen = [b.bins[k] for k in full if rng.random() < 0.5] or [b.bins[full[0]]]
    moved = {i for x in chosen for i in x}
    kept, loose = [], []
    for k, x in enumerate(a.bins):
        if moved.isdisjoint(x):
            kept.append(k)
        else:
            loose += [i for i in x if i not in moved]
    kept.sort(key=lambda k: a.room[k])
    n = max(0, len(kept) - max(2, int(len(kept) * emptied)))
    loose += [i for k in kept[n:] for i in a.bins[k]]
    return refitted(chosen + [a.bins[k] for k in kept[:n]], Loose(loose, sizes), sizes, capacity)


def grouping(sizes: list[int], capacity: int, rng, noise: float) -> Packing:
    """A packing of the items from large to small, as ``noise`` (a share of their size) has it."""
    order = np.argsort(-np.array(sizes) * rng.uniform(1 - noise, 1 + noise, len(sizes)), kind="stable")
    return placed(order.tolist(), sizes, capacity)


def evolve(sizes: list[int], start: list[Packing], capacity: int, seed: int, generations: int = 20, population: int = 6, island: int = 0) -> Packing:
    """The best packing found, from ``start`` and groupings of the island's own; ends at once when the bins are as few as the total allows."""
    rng = np.random.default_rng(seed)
    least = -(-sum(sizes) // capacity)
    score = lambda p: p.fitness(capacity)
    people = list(start)
    while len(people) < population:
        people.append(grouping(sizes, capacity, rng, 0.3 if island or people else 0.0))
        if len(people[-1].bins) <= least:
            break
    for _ in range(generations):
        people.sort(key=score, reverse=True)
        if len(people[0].bins) <= least or len(people) < 2:
            break
        i, j = rng.permutation(min(4, len(people)))[:2].tolist()
        a, b = people[i], people[j]
        people = sorted(people + [crossover(a, b, sizes, capacity, rng), crossover(b, a, sizes, capacity, rng)], key=score, reverse=True)[:population]
    return max(people, key=score)


STATE = PIECES + ", shard long, island int, origin int, uid long, bin int"


def _epoch(key, pdf: pd.DataFrame, capacity: int, generations: int) -> pd.DataFrame:
    """One island of one shard: its own elite and the immigrant (rows of either origin; bin -1 before the first epoch) become its new elite."""
    origins = [o.sort_values("uid", kind="stable") for _, o in pdf.groupby("origin")]
    base = origins[0]
    sizes = base["length"].tolist()
    start = []
    for o in origins:
        bins: dict[int, list[int]] = {}
        for i, b in enumerate(o["bin"].tolist()):
            bins.setdefault(b, []).append(i)
        if -1 not in bins:
            start.append(Packing(list(bins.values()), sizes, capacity))
    best = evolve(sizes, start, capacity, hash((int(key[0]), int(key[1]), len(start))) & 0xFFFFFFFF, generations, island=int(key[1]))
    where = np.zeros(len(base), np.int32)
    for b, items in enumerate(best.bins):
        where[items] = b
    return base.assign(bin=where, island=np.int32(key[1]), origin=np.int32(0))


def _elect(key, pdf: pd.DataFrame, capacity: int, spare: int) -> pd.DataFrame:
    """The best island's packing of a shard: offsets within bins, and ``pooled`` for the pieces of its ``spare`` least filled bins."""
    best = None
    for _, own in pdf.groupby("island"):
        fill = own.groupby("bin")["length"].sum()
        score = (-len(fill), float(((fill / capacity) ** 2).mean()))
        if best is None or score > best[0]:
            best = (score, own, fill)
    _, own, fill = best
    own = own.sort_values(["bin", "uid"], kind="stable")
    worst = set(fill[fill < capacity].sort_values(kind="stable").index[:spare])
    out = own.assign(offset=own.groupby("bin")["length"].cumsum() - own["length"], pooled=own["bin"].isin(worst))
    return out.assign(sequence_id=(np.int64(key[0]) << 32) + own["bin"].astype("int64"))


OUT = PIECES + ", shard long, uid long, pooled boolean, sequence_id long, offset long"


def _packed(rows: DataFrame, islands: int, epochs: int, generations: int, capacity: int, spare: int) -> DataFrame:
    """``rows``: PIECES, uid, shard. Columns of OUT."""
    state = rows.select("*", F.explode(F.array(*[F.lit(i) for i in range(islands)])).alias("island"), F.lit(0).alias("origin"), F.lit(-1).alias("bin"))
    cols = [c.split()[0] for c in STATE.split(", ")]
    for e in range(epochs):
        if e:
            moved = state.withColumns({"island": ((F.col("island") + 1) % islands).cast("int"), "origin": F.lit(1)})
            state = state.unionByName(moved) if islands > 1 else state
        state = written(state.select(*cols).groupBy("shard", "island").applyInPandas(partial(_epoch, capacity=capacity, generations=generations), STATE), "islands")
    names = [c.split()[0] for c in OUT.split(", ")]
    return state.groupBy("shard").applyInPandas(lambda key, pdf: _elect(key, pdf, capacity, spare)[names], OUT)


def pack(rows: DataFrame, capacity: int = SEQUENCE, shard: int = SHARD, islands: int = 2, epochs: int = 2, generations: int = 10, spare: int = 4) -> DataFrame:
    """Adds sequence_id and offset to pieces (columns of PIECES, lengths from 1 to ``capacity``). Rows may repeat, ids may be null; no rows
    give none.

    About ``shard`` pieces meet in one task, however many the input has, and however many of them share a bin.
    """
    rows = written(rows.select(*[c.split()[0] for c in PIECES.split(", ")]), "pieces")
    n = rows.count()
    shards = max(1, -(-n // shard))
    rows = rows.withColumn("uid", F.monotonically_increasing_id())
    first = written(_packed(rows.withColumn("shard", F.pmod(F.xxhash64("uid"), F.lit(shards))), islands, epochs, generations, capacity, spare if shards > 1 else 0), "packed")
    pool = first.where("pooled").select(*[c.split()[0] for c in PIECES.split(", ")], "uid")
    again = max(1, -(-pool.count() // shard))
    second = _packed(pool.withColumn("shard", F.pmod(F.xxhash64("uid"), F.lit(again)) + F.lit(shards)), islands, epochs, generations, capacity, 0)
    keep = [c.split()[0] for c in PIECES.split(", ")] + ["sequence_id", "offset"]
    return first.where("not pooled").select(*keep).unionByName(second.select(*keep))


def packed_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 0, capacity: int = SEQUENCE) -> DataFrame:
    """Columns doc_id, piece, start, length, ids_crc32, sequence_id, offset of every whole text.

    Null and empty texts are one piece of one id (the end); a very long one is cut into many. Null ids and repeated rows are kept; other
    columns are ignored, whatever their names. An empty table gives none.
    """
    return pack(pieces(docs, tokenizer_path, end_id, capacity), capacity)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path(BYTE_BPE))
