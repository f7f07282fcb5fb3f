"""Language-model scoring by logistic context mixing of bit predictors.

A text is coded as its lower-cased words and an end. After some hashed contexts of two words (one in EVERY) the words that followed there
most often are predicted, up to the next such context: a bit a word tells whether it is the predicted one, until one is not. Any other word
is coded by the bits of its place in a code tree, if it is frequent, else by an escape bit path and then either by its share of the rarer
words, or, if it is new, by the bits of its bytes. A bit of the tree is predicted in four contexts: its node alone, with the kind of text that
the words before it point to, with the word before it (hashed to a few classes), and with both. A bit of a byte is predicted in hashed
contexts, the one to four bytes before it. Predictions are mixed in the logistic domain by weights that a gate chooses (how much a context has
been seen), learned online, one update a batch, by the coding cost with each event left out of its own counts; for predicted words (gate: how
many have been right so far) the weights are fitted to the counts. All are then refined by an adaptive map. A text's score is minus its total
bits, as log10; a training text's own words are left out of what its contexts of two words predict.

All counts cover all training texts and are summed by shuffles, those of the kinds of text too, in every pass of their EM; what is
broadcast has a fixed size (HEAD words, kinds over MARKS words, and the tables of bits).
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterable
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import byte_values, release, written

#: Words with a place in the code tree at most; kinds of text; words counted before they are handed on; slots of the byte contexts.
HEAD, CLASSES, FLUSH = (1 << 17) - 2, 8, 300_000
#: Kinds of text are clusters of all training texts by so many of the most frequent words; EM starts from so many texts (chosen by hash),
#: then passes over all, so often at most, until the log-likelihood grows by less than this share of it.
MARKS, SAMPLE, PASSES, SETTLED = 4096, 4096, 25, 1e-4
SLOTS = (1 << 16, 1 << 18, 1 << 19, 1 << 19)
STARTS = np.cumsum((0, *SLOTS))
END, ESCAPE = 0, 1
LOG2_10 = math.log2(10)
GATES, MAP = 24, 33
#: Classes of the word before (0: it tells nothing), batches that the tree's weights are learned in, cells of its map.
AFTER, BATCHES, TREE_MAP = 8, 32, 57
#: Times a word must be seen for a place in the tree.
SEEN = 3
#: Parts that byte weights are learned on at least, and words in each at most.
LEARNERS, WORDS_EACH = 24, 250_000
#: Contexts of two words that predict what follows: one in so many by hash. Classes of how sure they are, and of words that were right.
EVERY, SURE, RIGHT = 48, 24, 8
TRAINING = "coalesce(crc32(cast(cast(doc_id as string) as binary)) % 5 <> 1, true)"


def stretch(p):
    return np.log(p / (1 - p))


def squash(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def count_words(docs: DataFrame) -> DataFrame:
    """word (binary), c: how often each word is in the texts."""

    def run(batches):
        held: Counter = Counter()
        for b in batches:
            for text in byte_values(b.column("text")):
                held.update(text.lower().split())
                if len(held) > FLUSH:
                    yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "c"])
                    held = Counter()
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "c"])

    return docs.select("text").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


class Places(dict):
    """Places of words; that of any other is the escape."""

    def __missing__(self, word: bytes) -> int:
        return ESCAPE


class Head:
    """Places of the frequent words in the code tree (0: end, 1: escape), and what they say about the kind of text."""

    def __init__(self, words: list[bytes], logp: np.ndarray | None = None):
        self.words = words
        self.place = Places({w: i + 2 for i, w in enumerate(words)})
        self.logp = np.zeros((len(words) + 2, CLASSES), np.float32)
        #: Places from here on tell nothing of kinds.
        self.telling = 0 if logp is None else logp.shape[1]
        if logp is not None:
            self.logp[: logp.shape[1]] = logp.T
        #: The class of each word as the word before another: words that tell kinds are hashed to classes from 1 on.
        by_hash = (np.arange(len(self.logp), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(AFTER - 1)
        self.after = np.where(self.logp.any(1), 1 + by_hash.astype(np.int64), 0)

    def places(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))

    def walk(self, text: bytes) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """For the words of a text and its end: the likeliest kind by those before each, its place, and the words that have none. Only the
        words that tell kinds are summed; between two of them the kind stays."""
        words = text.lower().split()
        at = self.places(words)
        return self.kinds(at), np.append(at, END), [words[i] for i in np.nonzero(at == ESCAPE)[0].tolist()]

    def kinds(self, at: np.ndarray) -> np.ndarray:
        """The likeliest kind of text before each of the words at these places, and before the end."""
        tell = np.nonzero(at < self.telling)[0]
        kinds = np.zeros(len(at) + 1, np.int64)
        so_far, last, of = np.zeros(CLASSES, np.float32), 0, 0
        for i in range(0, len(tell), 1 << 15):
            part = tell[i : i + (1 << 15)]
            sums = np.cumsum(self.logp[at[part]], axis=0)
            sums += so_far
            best = sums.argmax(1)
            kinds[last : part[0] + 1] = of
            kinds[part[0] + 1 : part[-1] + 1] = np.repeat(best[:-1], np.diff(part))
            so_far, last, of = sums[-1], part[-1] + 1, best[-1]
        kinds[last:] = of
        return kinds

    def contexts(self, kinds: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The tree's context of each word and the end: their kinds of text with the class of the word before."""
        rows = kinds * AFTER
        rows[1:] += self.after[at[: len(kinds) - 1]]
        return rows


_LOADED: dict[str, object] = {}


class Shared:
    """A broadcast value and what a worker makes of it once."""

    def __init__(self, spark: SparkSession, name: str, value):
        self.key, self.sent = f"{name}-{uuid.uuid4().hex}", spark.sparkContext.broadcast(value)

    def get(self, make):
        if self.key not in _LOADED:
            while len(_LOADED) > 3:
                _LOADED.pop(next(iter(_LOADED)))
            _LOADED[self.key] = make(self.sent.value)
        return _LOADED[self.key]


def followed(docs: DataFrame, head: Shared, size: int) -> tuple[DataFrame, DataFrame]:
    """In one pass over texts (columns k, train, text), written once: ctx, seg, k, train, at, for every chosen context of two words the words
    after it, up to the next one, as 16-bit hashes, and the place of the first; and cell (context * size + place), n, how often each place is in
    each context of the tree, in training."""

    def run(batches):
        h, total = head.get(lambda x: Head(*x)), np.zeros(CLASSES * AFTER * size, np.int64)
        for b in batches:
            cells = []
            out: tuple[list, ...] = ([], [], [], [], [])
            for k, train, text in zip(b.column("k").to_pylist(), b.column("train").to_pylist(), byte_values(b.column("text")), strict=True):
                words = text.lower().split()
                places = h.places(words)
                if train:
                    rows = h.contexts(h.kinds(places), places) * size
                    rows[:-1] += places
                    rows[-1] += END
                    cells.append(rows)
                if len(words) < 3:
                    continue
                x = places.astype(np.uint64)
                rare = np.nonzero(places == ESCAPE)[0]
                x[rare] = np.fromiter((crc32(words[i]) + (1 << 32) for i in rare.tolist()), np.uint64, len(rare))
                x = (x + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
                x ^= x >> np.uint64(32)
                ctx = (x[:-2] * np.uint64(0xD6E8FEB86659FD93) + x[1:-1]) * np.uint64(0xBF58476D1CE4E5B9)
                ctx ^= ctx >> np.uint64(29)
                at = np.nonzero(ctx % np.uint64(EVERY) == 0)[0]
                if len(at):
                    out[0].append(ctx[at].view(np.int64))
                    out[1].append((x[at[0] + 2 :] >> np.uint64(40)).astype("<u2"))
                    out[2].append(np.diff(np.append(at, len(words) - 2)))
                    out[3].append(at + 2)
                    out[4].append((k, train, len(at)))
            if cells:
                np.add.at(total, np.concatenate(cells), 1)
            if out[0]:
                data, sizes = np.concatenate(out[1]), np.concatenate(out[2])
                ends = np.concatenate([[0], np.cumsum(2 * sizes)]).astype(np.int32)
                seg = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(data.tobytes())])
                times = [n for _, _, n in out[4]]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out[0])), seg, pa.array(np.repeat([k for k, _, _ in out[4]], times)), pa.array(np.repeat([t for _, t, _ in out[4]], times)), pa.array(np.concatenate(out[3]).astype(np.int32))], ["ctx", "seg", "k", "train", "at"])
        at = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.nulls(len(at), pa.binary()), pa.array(total[at]), pa.nulls(len(at), pa.bool_()), pa.nulls(len(at), pa.int32())], ["ctx", "seg", "k", "train", "at"])

    both = written(docs.select("k", "train", "text").mapInArrow(run, "ctx long, seg binary, k long, train boolean, at int"), "followed")
    segments, cells = both.where("seg is not null"), both.where("seg is null").groupBy(F.col("ctx").alias("cell")).agg(F.sum("k").alias("n"))
    segments.written_to = both.written_to
    return segments, cells


def sureness(n: float, total: float) -> int:
    """The class of a prediction that was right n times of total."""
    return min(int(math.log2(n)), 5) * 4 + min(int(4 * n / total), 3)


def predicted(segments: DataFrame) -> DataFrame:
    """k, train, at, right, wrong, sure: how many of the words after a context are the predicted ones, whether the next one is another, and how
    sure the prediction was; without the text's own occurrence, and where another one remains."""
    counts = segments.where("train").groupBy("ctx", "seg").agg(F.count("*").alias("n"))
    x = F.xxhash64("seg")
    best = counts.groupBy("ctx").agg(F.sum("n").alias("total"), F.max(F.struct("n", x.alias("x"), "seg")).alias("a"), F.max(F.struct(F.col("n"), (-x).alias("x"), F.col("seg"))).alias("b"))
    best = written(best.select("ctx", "total", F.col("a.n").alias("n"), F.col("a.seg").alias("one"), F.when(F.col("a.seg") != F.col("b.seg"), F.col("b.seg")).alias("other")), "predictions")

    def match(batches):
        for b in batches:
            out: list[tuple] = []
            cols = [b.column(c).to_pylist() for c in ("seg", "k", "train", "at", "total", "n", "one", "other")]
            for seg, k, train, at, total, n, one, other in zip(*cols, strict=True):
                if train:
                    total -= 1
                    if seg == one:
                        n -= 1
                        if not n:
                            one, n = other, 1
                if not total or one is None:
                    continue
                if seg == one:
                    out.append((k, train, at, len(seg) // 2, False, sureness(n, total)))
                    continue
                differ = int.from_bytes(seg, "little") ^ int.from_bytes(one, "little")
                right = min(((differ & -differ).bit_length() - 1) // 16 if differ else len(seg), len(seg) // 2, len(one) // 2)
                out.append((k, train, at, right, right < min(len(seg), len(one)) // 2, sureness(n, total)))
            if out:
                kinds = (pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.bool_(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["k", "train", "at", "right", "wrong", "sure"])

    return segments.join(best, "ctx").select("seg", "k", "train", "at", "total", "n", "one", "other").mapInArrow(match, "k long, train boolean, at int, right int, wrong boolean, sure int")


def flag_costs(found: DataFrame) -> np.ndarray:
    """Bits (2 x SURE x RIGHT) of a predicted word that comes (1) or doesn't (0), by how sure the prediction was and how many came before it:
    the two inputs mixed by weights fitted to the training texts, then refined by what came in each case."""

    def run(batches):
        total = np.zeros((2, SURE, RIGHT), np.int64)
        for b in batches:
            right, wrong, sure = b.column("right").to_numpy(), b.column("wrong").to_numpy(zero_copy_only=False), b.column("sure").to_numpy()
            for t in range(RIGHT - 1):
                total[1, :, t] += np.bincount(sure[right > t], minlength=SURE)
            total[1, :, -1] += np.bincount(sure, np.maximum(right - RIGHT + 1, 0), SURE).astype(np.int64)
            np.add.at(total[0], (sure[wrong], np.minimum(right[wrong], RIGHT - 1)), 1)
        at = np.nonzero(total.ravel())[0]
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel()[at])], ["cell", "n"])

    got = found.where("train").select("right", "wrong", "sure").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(2 * SURE * RIGHT)
    counts[got["cell"].to_numpy()] = got["n"].to_numpy()
    n0, n1 = counts.reshape(2, SURE, RIGHT)
    # The predictions to mix: of the sureness alone, of the words that were right alone, and none.
    ratio = lambda a, b: np.log((a + 0.4) / (b + 0.4))
    x = np.stack([np.broadcast_to(ratio(n1.sum(1), n0.sum(1))[:, None], n0.shape), np.broadcast_to(ratio(n1.sum(0), n0.sum(0))[None], n0.shape), np.ones(n0.shape)], 2).reshape(-1, 3)
    w, y, times = np.array([0.6, 0.6, 0.0]), n1.ravel(), (n0 + n1).ravel()
    for _ in range(12):
        p = squash(x @ w)
        curve = (x * (p * (1 - p) * times)[:, None]).T @ x + 1e-3 * np.eye(3)
        w = w + np.clip(np.linalg.solve(curve, x.T @ (y - p * times)), -0.5, 0.5)
    p = squash(x @ w).reshape(n0.shape)
    p = np.clip((p + (n1 + 4 * p) / (n0 + n1 + 4)) / 2, 1e-4, 1 - 1e-4)
    return -np.log2(np.stack([1 - p, p]))


def mark_counts(docs: DataFrame, head: Shared, width: int) -> DataFrame:
    """at, n (arrays of 16 and 8 bits as binary): the places under ``width`` in each text that is not null, and how often (50 at most)."""

    def run(batches):
        h = head.get(lambda x: Head(*x))
        for b in batches:
            out: tuple[list, list] = ([], [])
            for text in byte_values(b.column("text")):
                at = h.places(text.lower().split())
                n = np.bincount(at[at < width], minlength=width)
                n[:2] = 0
                at = np.nonzero(n)[0]
                out[0].append(at.astype("<u2").tobytes())
                out[1].append(np.minimum(n[at], 50).astype("u1").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in out], ["at", "n"])

    return docs.where("text is not null").select("text").mapInArrow(run, "at binary, n binary")


def kind_step(at: list[bytes], n: list[bytes], logp: np.ndarray, prior: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """One step of EM over texts: the sums by kind of their words (kinds x places) and of their shares, and their log-likelihood."""
    where, times = np.frombuffer(b"".join(at), "<u2").astype(np.int64), np.frombuffer(b"".join(n), "u1").astype(np.float64)
    text = np.repeat(np.arange(len(n)), [len(x) for x in n])
    z = np.stack([np.bincount(text, times * logp[k, where], len(n)) + prior[k] for k in range(len(logp))], 1)
    top = z.max(1, keepdims=True)
    share = np.exp(z - top)
    whole = share.sum(1, keepdims=True)
    share /= whole
    mass = np.stack([np.bincount(where, times * share[text, k], logp.shape[1]) for k in range(len(logp))])
    return mass, share.sum(0), float((top + np.log(whole)).sum())


def kind_weights(mass: np.ndarray, shares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log P(word | kind) and log P(kind)."""
    mass, shares = mass + 0.05, shares + 1e-3
    return np.log(mass / mass.sum(1, keepdims=True)), np.log(shares / shares.sum())


def kinds_of_text(docs: DataFrame, words: list[bytes], seed: int = 5) -> np.ndarray:
    """log P(word | kind) of the first MARKS places (less the mean of the kinds; end and escape: zero), for a mixture of unigram models
    fitted by EM to all texts, whatever their length. Sums of a pass are added in fixed point."""
    spark, width = docs.sparkSession, min(MARKS, len(words) + 2)
    table = written(mark_counts(docs, Shared(spark, "words", (words,)), width), "marks")
    first = table.orderBy(F.xxhash64("at", "n"), "at", "n").limit(SAMPLE).toArrow()
    at, n = first["at"].to_pylist(), first["n"].to_pylist()
    rng, row = np.random.default_rng(seed), np.repeat(np.arange(len(n)), [len(x) for x in n])
    where, times = np.frombuffer(b"".join(at), "<u2").astype(np.int64), np.frombuffer(b"".join(n), "u1").astype(np.float64)
    share = rng.dirichlet(np.ones(CLASSES) * 0.3, len(n)).reshape(len(n), CLASSES)
    mass, shares = np.stack([np.bincount(where, times * share[row, k], width) for k in range(CLASSES)]), share.sum(0)
    for _ in range(25):
        mass, shares, _ = kind_step(at, n, *kind_weights(mass, shares))
    before = -math.inf
    for _ in range(PASSES if len(n) else 0):
        sent = Shared(spark, "kinds", kind_weights(mass, shares))

        def run(batches, sent=sent):
            logp, prior = sent.get(lambda x: x)
            total = np.zeros(CLASSES * width + CLASSES + 1)
            for b in batches:
                if b.num_rows:
                    m, s, fit = kind_step(b.column("at").to_pylist(), b.column("n").to_pylist(), logp, prior)
                    total += np.concatenate([m.ravel(), s, [fit]])
            fixed = np.rint(total * 1024).astype(np.int64)
            cell = np.nonzero(fixed)[0]
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(fixed[cell])], ["cell", "n"])

        got = table.mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
        total = np.zeros(CLASSES * width + CLASSES + 1)
        total[got["cell"].to_numpy()] = got["n"].to_numpy() / 1024
        mass, shares, fit = total[: CLASSES * width].reshape(CLASSES, width), total[CLASSES * width : -1], total[-1]
        if fit - before < SETTLED * abs(fit):
            break
        before = fit
    logp = kind_weights(mass, shares)[0].astype(np.float32)
    logp[:, :2] = 0
    release(spark, table)
    return logp - logp.mean(0)


def tree_costs(counts: np.ndarray) -> np.ndarray:
    """Bits of every place (a power of two of them) in every context (row: kind of text * AFTER + class of the word before).

    A bit of the tree is predicted by its node alone, with the kind, with the word before, and with both. The mixing weights are learned
    online: the bits of all training words are dealt into BATCHES by hash, each is in one of them, and each batch is predicted by the weights
    of those before it, every bit left out of its own counts, before the weights of its gates take one step. What was predicted so fills the
    adaptive map that refines the mixed predictions.
    """
    rows, levels = len(counts), int(math.log2(counts.shape[1]))
    below = np.pad(counts.astype(np.float64, copy=False), ((0, -rows % AFTER), (0, 0))) if rows % AFTER else counts.astype(np.float64, copy=False)
    steps: list[tuple[np.ndarray, ...]] = []
    for _ in range(levels):
        own = below.reshape(len(below), -1, 2)
        both = own.reshape(-1, AFTER, *own.shape[1:])
        steps.insert(0, (both.sum((0, 1)), both.sum(1), both.sum(0), own))
        below = own.sum(2)
    mixer = TreeMixer()
    dealt = [(step, y, *dealt_bits(step[-1][..., y], 2 * level + y)) for level, step in enumerate(steps) for y in (0, 1)]
    for batch in range(BATCHES):
        for step, y, often, shift, few, ends in dealt:
            at = np.concatenate([often, few[ends[batch] : ends[batch + 1]]])
            times = step[-1].reshape(-1, 2)[at, y]
            n = times[: len(often)]
            times[: len(often)] = n // BATCHES + ((batch + shift) % BATCHES < n % BATCHES)
            mixer.see(*tree_inputs(step, *np.divmod(at, step[-1].shape[1]), y), y, times)
        mixer.learn()
    del dealt
    out = np.empty(counts.shape, np.float32)
    for first in range(0, rows, AFTER):
        cost = np.zeros((AFTER, 1))
        for step in steps:
            nodes = step[-1].shape[1]
            row, node = np.divmod(np.arange(AFTER * nodes), nodes)
            p1 = mixer.refine(*tree_inputs(step, row + first, node)).reshape(AFTER, nodes)
            cost = np.stack([cost - np.log2(1 - p1), cost - np.log2(p1)], 2).reshape(AFTER, -1)
        out[first : first + AFTER] = cost[: rows - first]
    return out


def dealt_bits(n: np.ndarray, salt: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For counts of bits, where they are many and go to all batches (and which batches get one more), and where they are few and go to one:
    in the order of batches, with their ends."""
    at = np.flatnonzero(n)
    x = (at.astype(np.uint64) * np.uint64(64) + np.uint64(salt + 1)) * np.uint64(0x9E3779B97F4A7C15)
    part, many = ((x >> np.uint64(40)) % np.uint64(BATCHES)).astype(np.int64), n.ravel()[at] >= BATCHES
    few, part_few = at[~many], part[~many]
    order = np.argsort(part_few, kind="stable")
    return at[many].astype(np.int32), part[many], few[order].astype(np.int32), np.searchsorted(part_few[order], np.arange(BATCHES + 1))


def tree_inputs(step: tuple[np.ndarray, ...], row: np.ndarray, node: np.ndarray, y: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Stretched predictions (4) of bits at nodes of a level, and the gate: how often the narrowest context was seen. With ``y``, bits that are
    ``y`` are left out of all their counts."""
    whole, kind, before, own = step
    seen = [whole[node], kind[row // AFTER, node], before[row % AFTER, node], own[row, node]]
    if y is not None:
        for n in seen:
            n[:, y] -= 1
    gate = np.minimum(np.log2(seen[-1].sum(1) + 1).astype(np.int64), GATES - 1)
    return np.stack([np.log((n[:, 1] + 0.05) / (n[:, 0] + 0.05)) for n in seen], 1), gate


class TreeMixer:
    """Mixing weights of the tree's four inputs for each gate, learned a batch at a time, and the adaptive map of each gate."""

    def __init__(self):
        share = np.linspace(0.0, 0.8, GATES)[:, None]
        self.weights = np.concatenate([(1 - share) * [0.4, 0.4, 0.2], share], 1)
        self.refined = np.zeros((2, GATES * TREE_MAP))
        self.slope, self.curve = np.zeros((GATES, 4)), np.zeros((GATES, 4, 4))

    def mixed(self, x: np.ndarray, gate: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The mixed prediction, the cell of the map under it, and how far it is to the next one."""
        t = np.clip((self.weights[gate] * x).sum(1), -14, 14)
        at = (t + 14) * ((TREE_MAP - 1) / 28)
        cell = np.minimum(at.astype(np.int64), TREE_MAP - 2)
        return squash(t), gate * TREE_MAP + cell, at - cell

    def see(self, x: np.ndarray, gate: np.ndarray, y: int, times: np.ndarray) -> None:
        """Predicts bits ``y`` of a batch, so often each."""
        p, cell, beyond = self.mixed(x, gate)
        miss, spread = (y - p) * times, p * (1 - p) * times
        for i in range(4):
            self.slope[:, i] += np.bincount(gate, miss * x[:, i], GATES)
            for j in range(i, 4):
                self.curve[:, i, j] += np.bincount(gate, spread * x[:, i] * x[:, j], GATES)
        size = self.refined.shape[1]
        self.refined[y] += np.bincount(cell, times * (1 - beyond), size) + np.bincount(cell + 1, times * beyond, size)

    def learn(self) -> None:
        """One step of the weights by the batch just seen, as long as the bits of all batches so far allow (their curvature)."""
        curve = np.triu(self.curve) + np.swapaxes(np.triu(self.curve, 1), 1, 2)
        ridge = 1e-3 * (1 + np.trace(curve, axis1=1, axis2=2))[:, None, None] * np.eye(4)
        self.weights = np.clip(self.weights + np.clip(np.linalg.solve(curve + ridge, self.slope[..., None])[..., 0], -0.5, 0.5), -0.5, 2.0)
        self.slope[:] = 0

    def refine(self, x: np.ndarray, gate: np.ndarray) -> np.ndarray:
        """The mixed predictions, averaged with what came where the map's cells were met."""
        p, cell, beyond = self.mixed(x, gate)
        n0, n1 = (n[cell] * (1 - beyond) + n[cell + 1] * beyond for n in self.refined)
        return np.clip((p + (n1 + 4 * p) / (n0 + n1 + 4)) / 2, 1e-7, 1 - 1e-7)


def word_bytes(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words' bytes (each word ended by a space), the four bytes of the word before each (4 x bytes, none: zero), and the word of each."""
    flat = np.frombuffer(b"".join(w + b" " for w in words), np.uint8).astype(np.uint64)
    sizes = np.array([len(w) + 1 for w in words])
    word = np.repeat(np.arange(len(words)), sizes)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    last = np.zeros((4, len(flat)), np.uint64)
    for k in range(4):
        ok = place > k
        last[k, ok] = flat[np.nonzero(ok)[0] - k - 1]
    return flat, last, word


def byte_bits(flat: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bits of bytes that follow others: slots in the four contexts (bits x 4), and bits."""
    bits = ((flat[:, None] >> np.arange(7, -1, -1, dtype=np.uint64)) & np.uint64(1)).astype(np.int64)
    node = np.ones((len(flat), 8), np.uint64)
    for i in range(1, 8):
        node[:, i] = node[:, i - 1] * np.uint64(2) + bits[:, i - 1].astype(np.uint64)
    slots = np.empty((len(flat), 8, 4), np.int64)
    context = np.zeros(len(flat), np.uint64)
    for k in range(4):
        context = (context + last[k] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        h = (context[:, None] + node) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        slots[:, :, k] = STARTS[k] + ((last[0][:, None] * np.uint64(256) + node) if k == 0 else (h >> np.uint64(40)) % np.uint64(SLOTS[k])).astype(np.int64)
    return slots.reshape(-1, 4), bits.ravel()


def word_bits(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bits of the words' bytes: slots in the four contexts (bits x 4), bits, and the word of each."""
    flat, last, word = word_bytes(words)
    return *byte_bits(flat, last), np.repeat(word, 8)


def distinct_bits(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slots and bits as in ``word_bits``, once for all bytes that are equal with the four before them, and how many those are."""
    flat, last, _ = word_bytes(words)
    key, times = np.unique(flat | last[0] << np.uint64(8) | last[1] << np.uint64(16) | last[2] << np.uint64(24) | last[3] << np.uint64(32), return_counts=True)
    slots, bits = byte_bits(key & np.uint64(255), np.stack([key >> np.uint64(8 * k) & np.uint64(255) for k in (1, 2, 3, 4)]))
    return slots, bits, np.repeat(times, 8).astype(float)


def _in_parts(words: Iterable[bytes], size: int = 1 << 16):
    """Lists of words of bounded total length."""
    held, n = [], 0
    for w in words:
        held.append(w)
        n += len(w) + 1
        if n > size:
            yield held
            held, n = [], 0
    if held:
        yield held


def count_bits(words: DataFrame) -> DataFrame:
    """slot, n0, n1 of the byte contexts over the distinct words."""

    def run(batches):
        total = np.zeros((2, STARTS[-1]), np.int64)
        for b in batches:
            for part in _in_parts(b.column("word").to_pylist()):
                slots, bits, _ = word_bits(part)
                for y in (0, 1):
                    total[y] += np.bincount(slots[bits == y].ravel(), minlength=STARTS[-1])
        at = np.nonzero(total.sum(0))[0]
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[0, at]), pa.array(total[1, at])], ["slot", "n0", "n1"])

    return words.select("word").mapInArrow(run, "slot long, n0 long, n1 long").groupBy("slot").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


class ByteModel:
    """Mixing weights (a set for each gate: the longest context seen, and how often) and the adaptive map over the byte contexts' counts."""

    def __init__(self, counts: np.ndarray, weights: np.ndarray | None = None, refined: np.ndarray | None = None, tables=None):
        self.counts = counts.astype(np.float32, copy=False)
        self.weights = np.tile([0.1, 0.2, 0.3, 0.4], (5 * 4, 1)) if weights is None else weights
        self.refined = np.zeros((5 * MAP, 2)) if refined is None else refined
        #: Of every slot as it is (2) and with one event of bit 0 or 1 left out: stretched prediction, and how often it was seen (-1: never).
        self.tables = self.tabulated() if tables is None else tables

    def tabulated(self) -> tuple[np.ndarray, np.ndarray]:
        x, often = np.empty((3, len(self.counts)), np.float32), np.empty((3, len(self.counts)), np.int8)
        for case in range(3):
            n = np.maximum(self.counts - np.float32([case == 0, case == 1]), 0)
            total = n.sum(1)
            x[case] = np.log((n[:, 1] + 0.02) / (n[:, 0] + 0.02))
            often[case] = np.where(total > 0, np.minimum(np.log2(total + 1) / 2, 3), -1).astype(np.int8)
        return x.ravel(), often.ravel()

    def inputs(self, slots: np.ndarray, bits: np.ndarray | None = None):
        """Stretched predictions and gates; with ``bits``, every event is left out of its own counts."""
        at = slots + (2 if bits is None else bits[:, None]) * len(self.counts)
        x, often = self.tables[0][at], self.tables[1][at]
        order = (often >= 0).sum(1)
        top = often[np.arange(len(often)), np.maximum(order - 1, 0)]
        return x, order * 4 + np.maximum(top, 0)

    def mixed(self, x, gate):
        return np.clip(squash((self.weights[gate] * x).sum(1)), 1e-4, 1 - 1e-4)

    def learn(self, words: list[bytes], rate: float) -> int:
        slots, bits, times = distinct_bits(words)
        x, gate = self.inputs(slots, bits)
        p = self.mixed(x, gate)
        seen = np.bincount(gate, times, 20) + 1.0
        miss = (bits - p) * times
        for i in range(4):
            power = np.bincount(gate, x[:, i] ** 2 * times, 20) / seen + 1.0
            self.weights[:, i] += rate * np.bincount(gate, miss * x[:, i], 20) / seen / power * (seen > 20)
        cell = (gate // 4) * MAP + np.rint((np.clip(stretch(p), -8, 8) + 8) * 2).astype(np.int64)
        self.refined += np.stack([np.bincount(cell, times * (bits == y), 5 * MAP) for y in (0, 1)], 1)
        return int(times.sum())

    def costs(self, words: list[bytes]) -> np.ndarray:
        """Bits of each word."""
        slots, bits, word = word_bits(words)
        x, gate = self.inputs(slots)
        p = self.mixed(x, gate)
        cell = (gate // 4) * MAP + np.rint((np.clip(stretch(p), -8, 8) + 8) * 2).astype(np.int64)
        n = self.refined[cell]
        p = (p + (n[:, 1] + 4 * p) / (n.sum(1) + 4)) / 2
        return np.bincount(word, -np.log2(np.where(bits == 1, p, 1 - p)), len(words))


def fit_bytes(spark: SparkSession, words: DataFrame) -> ByteModel:
    """Counts over all words, then one online pass over each part of them; weights are averaged by bits, maps summed.

    The parts are by hash, as many as the words call for, and each in order, so that the result doesn't depend on where the rows were.
    """
    got = count_bits(words).toArrow()
    counts = np.zeros((STARTS[-1], 2), np.float32)
    counts[got["slot"].to_numpy()] = np.stack([got["n0"].to_numpy(), got["n1"].to_numpy()], 1)
    sent = Shared(spark, "bits", counts)

    def run(batches):
        start, n = sent.get(ByteModel), 0
        model = ByteModel(start.counts, tables=start.tables)
        for k, part in enumerate(_in_parts(w for b in batches for w in b.column("word").to_pylist())):
            n += model.learn(part, 0.5 / (1 + 0.2 * k))
        if n:
            yield pa.RecordBatch.from_pydict({"n": [n], "weights": [model.weights.tobytes()], "refined": [model.refined.tobytes()]})

    n_parts = max(LEARNERS, -(-words.count() // WORDS_EACH))
    dealt = words.select("word").repartition(n_parts, F.xxhash64("word") % n_parts).sortWithinPartitions("word")
    parts = sorted(dealt.mapInArrow(run, "n long, weights binary, refined binary").collect(), key=lambda p: (p.n, p.weights))
    if not parts:
        return ByteModel(counts)
    n = np.array([p.n for p in parts], float)
    weights = np.average([np.frombuffer(p.weights).reshape(20, 4) for p in parts], axis=0, weights=n)
    return ByteModel(counts, weights, np.sum([np.frombuffer(p.refined).reshape(-1, 2) for p in parts], axis=0))


def score_texts(docs: DataFrame) -> DataFrame:
    """Columns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte: one row per row of ``docs``.

    Null and empty texts are their end alone. A null id is in training. If no text is, nothing is known and all base probabilities are
    one half of the whole. Repeated rows are scored (and, in training, counted) each. An empty table gives none; other columns are
    never read.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    train = docs.where(TRAINING)
    vocab = written(count_words(train), "vocab")
    n_docs = train.count()
    by_count = vocab.groupBy("c").agg(F.count("*").alias("n")).orderBy(F.desc("c"))
    least, held, total, kinds, singles = None, 0, n_docs, int(n_docs > 0), 0
    for r in by_count.toLocalIterator():
        total, kinds = total + r.c * r.n, kinds + r.n
        singles = r.n if r.c == 1 else singles
        if held is not None and held + r.n <= HEAD and r.c >= SEEN:
            held, least = held + r.n, r.c
        else:
            held = None
    frequent = vocab.where(F.col("c") >= least).toArrow() if least is not None else None
    head_words: list[bytes] = []
    head_counts = np.zeros(0)
    if frequent is not None:
        c, w = frequent["c"].to_numpy(), frequent["word"].to_pylist()
        order = sorted(range(len(w)), key=lambda i: (-c[i], w[i]))
        head_words, head_counts = [w[i] for i in order], c[order].astype(float)
    size = 1 << max(1, (len(head_words) + 1).bit_length())
    head = Shared(spark, "head", (head_words, kinds_of_text(train, head_words)))
    # Contexts of words: a text is known by its hash, so that copies share what is predicted of them.
    key = F.xxhash64(F.coalesce("text", F.lit("")), F.octet_length(F.coalesce("text", F.lit(""))))
    keyed = docs.select("doc_id", "text", key.alias("k"), F.expr(TRAINING).alias("train"))
    segments, cells = followed(keyed, head, size)
    cells = cells.toArrow()
    counts = np.zeros(CLASSES * AFTER * size)
    counts[cells["cell"].to_numpy()] = cells["n"].to_numpy()
    del cells
    bits = tree_costs(counts.reshape(CLASSES * AFTER, size))
    del counts
    unit = math.log10(total + 0.5 * (kinds + 1))
    known = np.concatenate([[n_docs, 0], head_counts])
    base = np.log10(known + 0.5) - unit
    rarer = vocab.where(F.col("c") < least) if least is not None else vocab
    rare_total = max(0.0, total - n_docs - head_counts.sum())
    new_share = (singles + 0.5) / (rare_total + 1.0)
    known_share = math.log10(max(1 - new_share, 1e-6))
    found = written(predicted(segments), "predicted")
    release(spark, segments)
    flags = flag_costs(found) / LOG2_10
    told = found.groupBy("k", "train").agg(F.collect_set(F.struct("at", "right", "wrong", "sure")).alias("told"))
    tables = Shared(spark, "costs", (np.float32(bits / LOG2_10), base, known > 0, np.cumsum(np.concatenate([np.zeros((SURE, 1)), flags[1]], 1), 1), flags))
    bytes_model = fit_bytes(spark, rarer)
    spelled = Shared(spark, "spelled", (bytes_model.counts, bytes_model.weights, bytes_model.refined))

    def run(batches):
        h = head.get(lambda x: Head(*x))
        cost, base_, known_, hits, misses = tables.get(lambda x: x)
        for b in batches:
            out: list[list] = [[] for _ in range(8)]
            told_words: list[list] = [[] for _ in range(4)]
            lists = b.column("told")
            for i, (row, doc, text) in enumerate(zip(b.column("row").to_pylist(), b.column("doc_id").to_pylist(), byte_values(b.column("text")), strict=True)):
                kinds_, at, rare = h.walk(text)
                own = at[at != ESCAPE]
                own_base, own_known = float(base_[own].sum()), int(known_[own].sum())
                coded, contexts, flagged = at, h.contexts(kinds_, at), 0.0
                if lists[i].is_valid:
                    first, right, wrong, sure = (lists[i].values.field(c).to_numpy(zero_copy_only=False) for c in ("at", "right", "wrong", "sure"))
                    many = np.minimum(right, RIGHT)
                    flagged = float(hits[sure, many].sum() + ((right - many) * misses[1, sure, RIGHT - 1]).sum() + misses[0, sure[wrong], np.minimum(right[wrong], RIGHT - 1)].sum())
                    hit = np.zeros(len(at) + 1, np.int64)
                    np.add.at(hit, first, 1)
                    np.add.at(hit, first + right, -1)
                    free = np.cumsum(hit[:-1]) == 0
                    coded, contexts = at[free], contexts[free]
                    told_rare = Counter([w for w, f in zip(rare, free[at == ESCAPE].tolist(), strict=True) if f])
                else:
                    told_rare = None
                model = -float(cost[contexts, coded].sum(dtype=np.float64)) - flagged
                for c, v in zip(out, (row, doc, len(at), 0, own_known, own_base, model, len(text)), strict=True):
                    c.append(v)
                found_rare = Counter(rare)
                told_words[0] += [row] * len(found_rare)
                told_words[1] += found_rare.keys()
                told_words[2] += found_rare.values()
                told_words[3] += found_rare.values() if told_rare is None else [told_rare[w] for w in found_rare]
            names = ["row", "doc_id", "word", "n", "coded", "known", "base", "model", "n_bytes"]
            kinds__ = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64())
            cols = [pa.array(c, k) for c, k in zip(out, kinds__, strict=True)]
            yield pa.RecordBatch.from_arrays([*cols[:2], pa.nulls(len(cols[0]), pa.binary()), *cols[2:]], names)
            for at_ in range(0, len(told_words[0]), 50_000):
                row_, word_, n_, coded_ = (c[at_ : at_ + 50_000] for c in told_words)
                none, zero, real = pa.nulls(len(row_), pa.int64()), pa.array(np.zeros(len(row_), np.int64)), pa.array(np.zeros(len(row_)))
                yield pa.RecordBatch.from_arrays([pa.array(row_, pa.int64()), none, pa.array(word_, pa.binary()), pa.array(n_, pa.int64()), pa.array(coded_, pa.int64()), zero, real, real, zero], names)


    schema = "row long, doc_id long, word binary, n long, coded long, known long, base double, model double, n_bytes long"
    rows = keyed.join(told, ["k", "train"], "left").select("doc_id", "text", "told").withColumn("row", F.monotonically_increasing_id())
    parts = written(rows.mapInArrow(run, schema), "scored")
    release(spark, found)
    rare = parts.where("word is not null").select("row", "word", "n", "coded").join(rarer, "word", "left")
    seen = rare.where("c is not null").select(
        "row", F.lit(None).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("n"), F.col("n").alias("known"),
        (F.col("n") * (F.log10(F.col("c") + 0.5) - unit)).alias("base"), (F.col("coded") * (F.log10("c") + (known_share - math.log10(max(rare_total, 1.0))))).alias("model"), F.lit(0).cast("long").alias("n_bytes"),
    )

    def spell(batches):
        model = spelled.get(lambda x: ByteModel(*x))
        for b in batches:
            words = b.column("word").to_pylist()
            if not words:
                continue
            distinct = list(dict.fromkeys(words))
            cost = dict(zip(distinct, np.concatenate([model.costs(p) for p in _in_parts(distinct)]).tolist(), strict=True))
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("n"), b.column("coded"), pa.array([-cost[w] / LOG2_10 for w in words], pa.float64())], ["row", "n", "coded", "model"])

    new = rare.where("c is null").select("row", "n", "coded", "word").mapInArrow(spell, "row long, n long, coded long, model double")
    new = new.select("row", F.lit(None).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("known"), (F.col("n") * (math.log10(0.5) - unit)).alias("base"), (F.col("coded") * (F.col("model") + math.log10(new_share))).alias("model"), F.lit(0).cast("long").alias("n_bytes"))
    all_parts = parts.where("word is null").drop("word", "coded").unionByName(seen).unionByName(new)
    sums = all_parts.groupBy("row").agg(*[F.sum(c).alias(c) for c in ("n", "known", "base", "model", "n_bytes")], F.max("doc_id").alias("doc_id"))
    return sums.select(
        "doc_id", F.expr(f"not {TRAINING}").alias("held_out"), F.col("n").alias("n_tokens"), F.col("known").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), F.col("model").alias("score"),
        "n_bytes", (-F.col("model") * LOG2_10 / F.greatest("n_bytes", F.lit(1))).alias("bits_per_byte"),
    )


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
