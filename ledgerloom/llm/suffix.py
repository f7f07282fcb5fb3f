"""Removal of repeated passages by bucket-pointer refinement over sampled suffixes.

Every position of a text has the identifier of its q-gram bucket. A bucket of longer strings is refined by the identifiers at later offsets:
that of 2q bytes at p is made of those of q bytes at p and at p + q, that of 4q of those of 2q at p and p + 2q, and so on; any other length
of two that overlap. Each level reuses the one before (Karp, Miller and Rosenberg's naming). Identifiers are 64-bit hashes of the pair instead
of ranks, so that they are the same in all texts without a global sort, which would shuffle every position many times over.

To end early, only the suffixes that can start a bucket go through the shuffles. Each window of ``length`` bytes owns one anchor, the q-gram
in it with the least identifier (the leftmost of equals), which depends on nothing outside the window: equal windows have equal anchors at
equal offsets. So

1. the anchors, one or two of a hundred positions, are dealt into initial q-gram buckets; buckets of one end there;
2. a bucket is refined by the identifiers of its anchors' segments (all the windows that own one). If a segment comes twice, all its windows
   repeat, and it ends there;
3. a bucket of different segments is refined by the identifiers to half a window before and behind its anchor, one of which is in every window;
4. where those are in different segments, the windows they are in are refined to single offsets, and equal ones repeat.

Counts are combined before every shuffle, and joins are plain equi-joins between written tables, which skew handling can split, so that
neither hot passages nor groups of copies meet in one task.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import byte_values, release, written

LENGTH, Q = 200, 32
#: Texts longer than this are cut into blocks for their anchors; shorter ones are named together, about so many bytes.
BLOCK, GROUP = 1 << 22, 1 << 16
def paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The identifiers of pairs of identifiers, in order."""
    h = a * np.uint64(0x9E3779B97F4A7C15)
    h += b
    t = h >> np.uint64(29)
    h ^= t
    h *= np.uint64(0xBF58476D1CE4E5B9)
    np.right_shift(h, np.uint64(32), out=t)
    h ^= t
    h *= np.uint64(0x94D049BB133111EB)
    np.right_shift(h, np.uint64(31), out=t)
    h ^= t
    return h


class Names:
    """The bucket identifiers of a text: ``grams`` of every q-gram (q from 8), and ``ranges`` of any longer strings by recursion on them.

    Eight bytes are their own identifier, a whole number.
    """

    def __init__(self, text: bytes, q: int):
        self.q, width, n = q, 8, len(text) - 7
        h = np.empty(n, np.uint64)
        for k in range(min(8, n)):
            h[k::8] = np.frombuffer(text, "<u8", (n - k + 7) // 8, k)
        while 2 * width <= q:
            h = paired(h[: len(h) - width], h[width:])
            width *= 2
        if width < q:
            h = paired(h[: len(h) - (q - width)], h[q - width :])
        #: Of q = 8 the identifiers are still the bytes, which are no random order for anchors.
        self.grams = paired(h, h) if q == 8 else h

    def _power(self, at: np.ndarray, k: int) -> np.ndarray:
        """Identifiers of q * 2 ** k bytes."""
        if not k:
            return self.grams[at]
        return paired(self._power(at, k - 1), self._power(at + (self.q << (k - 1)), k - 1))

    def ranges(self, start: np.ndarray, n: int | np.ndarray, least: int) -> np.ndarray:
        """Identifiers of strings of n bytes, all from ``least`` to under four times the greatest power of two of q in that: of so many such
        blocks as cover them evenly, two where n is one number, else four."""
        k = (least // self.q).bit_length() - 1
        spread, parts = n - (self.q << k), 1 if isinstance(n, int) and n <= self.q << (k + 1) else 3
        at = np.concatenate([start + spread * i // parts for i in range(parts + 1)])
        names = self._power(at, k).reshape(parts + 1, -1)
        out = names[0] + (np.uint64(n) if isinstance(n, int) else n.astype(np.uint64))
        for other in names[1:]:
            out = paired(out, other)
        return out


def leftmost_least(h: np.ndarray, width: int) -> np.ndarray:
    """For every window of ``width`` values, the position of the least one by its upper 33 bits, the leftmost of equals."""
    n = len(h) - width + 1
    blocks = -(-len(h) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(h)] = (h >> np.uint64(31) << np.uint64(31)) | np.arange(len(h), dtype=np.uint64)
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])
    return (least & np.uint64((1 << 31) - 1)).astype(np.int64)


def segments(texts: list[bytes], length: int = LENGTH, q: int = Q):
    """The anchors of texts (of ``length`` bytes or more, in one buffer): bucket (identifier of the q-gram), identifier of the segment, those
    to half a window before and behind (0: outside the text), first window start, anchor and last window start in one number, and the text."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    begin = np.cumsum(sizes) - sizes
    names = Names(b"".join(texts), q)
    least = leftmost_least(names.grams, length - q + 1)
    inside = np.ones(len(least), bool)
    for e in begin[1:].tolist():
        inside[e - length + 1 : e] = False
    start, of = np.nonzero(inside)[0], np.repeat(np.arange(len(texts)), sizes - length + 1)
    at = least[start]
    new = np.nonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (of[1:] != of[:-1])]))[0]
    a, of, first, last = at[new], of[new], start[new], start[np.append(new[1:], len(start)) - 1]
    low, high, half = begin[of], (begin + sizes)[of], (length - q) // 2

    def side(ok: np.ndarray, at: np.ndarray) -> np.ndarray:
        out = np.zeros(len(a), np.uint64)
        out[ok] = names.ranges(at[ok], half + q, half + q) | np.uint64(1)
        return out.view(np.int64)

    before, behind = side(a - half >= low, a - half), side(a + q + half <= high, a)
    segment = names.ranges(first, last + length - first, length).view(np.int64)
    return names.grams[a].view(np.int64), segment, before, behind, (first - low) << 16 | (a - first) << 8 | (last - first), of


def grouped(rows: list, size: int):
    """Runs of rows (of which the first member is a text) of about ``size`` bytes together."""
    held, n = [], 0
    for r in rows:
        held.append(r)
        n += len(r[0])
        if n >= size:
            yield held
            held, n = [], 0
    if held:
        yield held


def all_segments(rows: list[tuple[bytes, int]], length: int, q: int, block: int = BLOCK):
    """``segments`` of texts and their keys, many short ones at once, a long one block by block. A segment that a block cuts is two; that is as
    good, as windows of different segments are compared one by one."""
    for text, k in (r for r in rows if len(r[0]) > block):
        for at in range(0, len(text) - length + 1, block):
            *names, where, _ = segments([text[at : at + block + length - 1]], length, q)
            yield *names, where + (at << 16), np.full(len(where), k, np.int64)
    for part in grouped([r for r in rows if len(r[0]) <= block], GROUP):
        *names, of = segments([t for t, _ in part], length, q)
        yield *names, np.array([k for _, k in part], np.int64)[of]


def asked_windows(text: bytes, begin: np.ndarray, asked: dict[str, np.ndarray], length: int, q: int) -> tuple[np.ndarray, ...]:
    """The windows in a buffer that segments (each with its text's ``begin``) still ask for: identifiers, segments, offsets from their first
    window, and whether the segment comes once."""
    half = (length - q) // 2
    first = (asked["at"] >> 16) + begin
    a, last = first + (asked["at"] >> 8 & 0xFF), first + (asked["at"] & 0xFF)
    lo, hi = np.where(asked["l"], first, np.maximum(first, a - half + 1)), np.where(asked["r"], last, np.minimum(last, a - half))
    n = np.maximum(hi - lo + 1, 0)
    start = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
    return Names(text, q).ranges(start, length, length).view(np.int64), np.repeat(asked["s"], n), start - np.repeat(first, n), np.repeat(asked["once"], n)


def _key(text: str | Column) -> Column:
    """Equal texts have equal results, so that a text stands for its row."""
    return F.xxhash64(text, F.octet_length(text))


def repeated_spans(docs: DataFrame, length: int = LENGTH, q: int = Q, block: int = BLOCK) -> DataFrame:
    """Columns k (the key of a text), spans (array of start, stop in bytes, in order, apart) of texts with repeated windows."""
    if not 8 <= q <= length <= q + 254:
        raise ValueError("q must be 8 at least, length from q to q + 254")
    spark, half = docs.sparkSession, (length - q) // 2
    texts = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where(F.octet_length("text") >= length)
    texts = texts.select(_key("text").alias("k"), "text")

    def anchors(batches):
        for b in batches:
            out, m = [], 0
            for own in all_segments(list(zip(byte_values(b.column("text")), b.column("k").to_pylist(), strict=True)), length, q, block):
                out.append(own)
                m += len(own[0])
                if m > 100_000:
                    yield _table(out, ["b", "s", "l", "r", "at", "k"])
                    out, m = [], 0
            if out:
                yield _table(out, ["b", "s", "l", "r", "at", "k"])

    found = written(texts.select("k", "text").mapInArrow(anchors, "b long, s long, l long, r long, at long, k long"), "anchors")
    buckets = found.groupBy("b").agg(F.count("*").alias("c"), F.min("s").alias("lo"), F.max("s").alias("hi"))
    buckets = written(buckets.where("c > 1").select("b", (F.col("lo") != F.col("hi")).alias("varied")), "buckets")
    release(spark)
    live = written(found.join(buckets, "b"), "live")
    release(spark, buckets, found)
    varied = live.where("varied")
    ahead, behind = (varied.where(f"{c} <> 0").groupBy(c).agg(F.min("s").alias("lo"), F.max("s").alias("hi")).where("lo <> hi").select(c, F.lit(True).alias(f"has_{c}")) for c in "lr")
    # One place of each segment stands for it; only segments that come once still need their windows looked up.
    place = varied.groupBy("s").agg(F.count("*").alias("c"), F.min("l").alias("l"), F.min("r").alias("r"), F.min(F.struct("k", "at")).alias("p"))
    # Those at the edge of a text have no half there (0), and look up what no one has, each something else.
    no_half = lambda c: F.when(F.col(c) != 0, F.col(c)).otherwise(F.xxhash64("s", F.lit(c)))
    place = place.withColumns({"_l": no_half("l"), "_r": no_half("r")})
    asked = place.join(ahead.withColumnRenamed("l", "_l"), "_l", "left").join(behind.withColumnRenamed("r", "_r"), "_r", "left")
    asked = asked.withColumns({"has_l": F.col("has_l") & (F.col("l") != 0), "has_r": F.col("has_r") & (F.col("r") != 0)}).where("has_l or has_r")
    asked = asked.select("s", "p.k", "p.at", (F.col("c") == 1).alias("once"), F.coalesce("has_l", F.lit(False)).alias("l"), F.coalesce("has_r", F.lit(False)).alias("r"))
    asked = written(asked, "asked")
    release(spark)

    def enumerate_windows(batches):
        before = None
        for b in batches:
            k, lists = b.column("k").to_numpy(), b.column("asked")
            # Rows come in order of k, so that of a run of copies one is enough.
            rows = np.nonzero(np.concatenate([[before is None or len(k) and k[0] != before], k[1:] != k[:-1]]))[0] if len(k) else []
            before = k[-1] if len(k) else before
            for part in grouped([(t, lists[i].values) for i, t in zip(rows, byte_values(b.column("text").take(pa.array(rows))), strict=True)] if len(rows) else [], GROUP):
                texts = [t for t, _ in part]
                own = pa.concat_arrays([x for _, x in part])
                asked = {c: own.field(c).to_numpy(zero_copy_only=False) for c in ("at", "s", "once", "l", "r")}
                sizes = np.array(list(map(len, texts)))
                begin = np.repeat(np.cumsum(sizes) - sizes, [len(x) for _, x in part])
                if len(texts) == 1 and sizes[0] > block:
                    # Of a long text only the bytes around each question are named.
                    first, last = asked["at"] >> 16, (asked["at"] >> 16) + (asked["at"] & 0xFF)
                    for i in range(len(first)):
                        one = {c: v[i : i + 1] for c, v in asked.items()}
                        yield _table([asked_windows(texts[0][first[i] : last[i] + length], -first[i : i + 1], one, length, q)], ["w", "s", "d", "once"])
                else:
                    yield _table([asked_windows(b"".join(texts), begin, asked, length, q)], ["w", "s", "d", "once"])

    def runs_of(batches):
        """Runs of window starts as first and number of more."""
        for b in batches:
            out = []
            for seg, d in zip(b.column("s").to_pylist(), b.column("d"), strict=True):
                v = np.sort(d.values.to_numpy())
                first = np.nonzero(np.concatenate([[True], v[1:] != v[:-1] + 1]))[0]
                out.append((np.full(len(first), seg, np.int64), v[first], v[np.append(first[1:], len(v)) - 1] - v[first]))
            if out:
                yield _table(out, ["s", "d", "m"])

    of_text = asked.groupBy("k").agg(F.collect_list(F.struct("at", "s", "once", "l", "r")).alias("asked"))
    refined = texts.join(of_text, "k").select("k", "text", "asked").sortWithinPartitions("k")
    refined = written(refined.mapInArrow(enumerate_windows, "w long, s long, d long, once boolean"), "windows")
    release(spark)
    twice = refined.groupBy("w").agg(F.min("s").alias("lo"), F.max("s").alias("hi")).where("lo <> hi").select("w")
    twice = written(twice, "twice")
    release(spark)
    single = refined.where("once").join(twice, "w", "left_semi").groupBy("s").agg(F.collect_list("d").alias("d"))
    single = written(single, "single")
    release(spark, refined, twice)
    runs = single.mapInArrow(runs_of, "s long, d long, m long").join(asked.where("once").select("s", "k", "at"), "s")
    runs = runs.select("k", ((F.shiftright("at", 16) + F.col("d")) * F.lit(1 << 16) + F.col("m")).alias("at"))
    # Written, so that the join deals its sides anew and a hot segment can be split.
    same = written(live.groupBy("b", "s").agg(F.count("*").alias("c")).where("c > 1").select("b", "s"), "same")
    whole = live.select("b", "s", "k", "at").join(same, ["b", "s"], "left_semi").select("k", "at").distinct()
    spans = whole.unionByName(runs).groupBy("k").agg(F.collect_set("at").alias("at"))

    def merged(batches):
        for b in batches:
            rows = []
            for at in b.column("at"):
                v = np.sort(at.values.to_numpy())
                s, e = merge(v >> 16, (v >> 16) + (v & 0xFF) + length)
                rows.append([{"start": int(x), "stop": int(y)} for x, y in zip(s, e, strict=True)])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
            yield pa.RecordBatch.from_arrays([b.column("k"), pa.array(rows, kind)], ["k", "spans"])

    out = written(spans.mapInArrow(merged, "k long, spans array<struct<start: long, stop: long>>"), "spans")
    release(spark, live, asked, single, same)
    return out


def _table(out: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names)


def merge(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of spans in order of start; touching ones are one run."""
    reach = np.maximum.accumulate(stop)
    new = np.concatenate([[True], start[1:] > reach[:-1]])
    return start[new], reach[np.append(np.nonzero(new)[0][1:] - 1, len(reach) - 1)]


def kept_bytes(text: bytes, spans) -> bytes:
    at, out = 0, []
    for s in spans or ():
        out.append(text[at : s["start"]])
        at = s["stop"]
    return b"".join([*out, text[at:]])


def with_spans(docs: DataFrame, length: int = LENGTH, q: int = Q, block: int = BLOCK) -> DataFrame:
    """doc_id, text (null: empty) and spans (null: none), one row per row of ``docs``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.withColumn("k", _key("text")).join(repeated_spans(docs, length, q, block), "k", "left").select("doc_id", "text", "spans")


def dedup_report(docs: DataFrame, length: int = LENGTH, block: int = BLOCK) -> DataFrame:
    """Columns doc_id, n_bytes, n_removed, n_spans, kept_sha256: one row per row of ``docs``.

    Every row counts as a text of its own, whatever its id, null or not: repeated rows repeat each other's passages. Null and short texts
    lose nothing; very long ones are anchored block by block. An empty table gives none; other columns are ignored.
    """
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]

    def run(batches):
        for b in batches:
            cols = [[], [], [], []]
            for text, spans in zip(byte_values(b.column("text")), b.column("spans").to_pylist(), strict=True):
                kept = kept_bytes(text, spans)
                for c, v in zip(cols, (len(text), len(text) - len(kept), len(spans or ()), hashlib.sha256(kept).hexdigest()), strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True))], names)

    return with_spans(docs, length, block=block).mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` without the repeated passages of ``text`` (and ``n_chars``, where there is one, set to the new length).

    Passages are those of ``dedup_report``, all their copies, each within whole characters. A null text stays null, null and repeated ids are
    rows like others. All other columns pass through, whatever their names; an empty table gives none.
    """

    @F.pandas_udf("string")
    def cut(text: pd.Series, start: pd.Series, stop: pd.Series) -> pd.Series:
        def one(t, a, b):
            if t is None or a is None or not len(a):
                return t
            data, spans = t.encode(), []
            for x, y in zip(a, b, strict=True):
                while x < len(data) and data[x] & 0xC0 == 0x80:
                    x += 1
                while y < len(data) and y > x and data[y] & 0xC0 == 0x80:
                    y -= 1
                spans.append({"start": int(x), "stop": int(y)})
            return kept_bytes(data, spans).decode()

        return pd.Series([one(*x) for x in zip(text, start, stop, strict=True)], dtype=object)

    spans = repeated_spans(docs, length)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.struct("*").alias("r"), _key(text).alias("k")).join(spans, "k", "left")
    rows = rows.select("r", F.when(F.col("spans").isNull(), F.col("r.text").cast("string")).otherwise(cut(F.col("r.text").cast("string"), "spans.start", "spans.stop")).alias("new"))
    new, kinds = {"text": F.col("new"), "n_chars": F.length("new")}, dict(docs.dtypes)
    return rows.select(*[new[c].cast(kinds[c]).alias(c) if c in new else F.col(f"r.`{c}`") for c in docs.columns])


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_report(spark.read.parquet(f"{sf_dir}/documents.parquet"))
