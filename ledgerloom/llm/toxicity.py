"""Toxic passages by maximum-scoring segments.

Tokens (words and their leading letters) get log-odds between toxic and clean labelled texts under an informative Dirichlet prior.
Over the words of a text these make a walk with negative drift; its maximal scoring segments (Ruzzo and Tompa) are the candidate
passages. Segment scores are calibrated by the extreme-value law of the clean texts, and the significant ones give the text's score.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import byte_values, release, written

#: Labelled texts that the model is fitted on at most (chosen by hash), bytes of them after which no more are taken, words that are kept.
SAMPLE, SAMPLE_BYTES, VOCABULARY = 12_000, 24 << 20, 1 << 16
#: Strength of the Dirichlet prior, evidence (texts) a token needs, drift of a word without weight, standardized log-odds a token needs, folds.
PRIOR, EVIDENCE, DRIFT, Z, FOLDS = 40.0, 4, -0.15, 3.0, 5
#: What a text is judged by (see ``features``), and the log-odds of toxicity where no labelled text is toxic.
FEATURES, NEVER = 7, -20.0
_LETTERS = re.compile(r"[^\W\d_]+")


def words(text: bytes) -> list[str]:
    return [m for w in text.decode(errors="replace").lower().split() if (m := "".join(_LETTERS.findall(w)))]


def tokens(word: str) -> list[str]:
    """The word, then its leading letters: six, five and four."""
    return [word, *(word[:k] + "*" for k in (6, 5, 4) if len(word) > k)]


class Model:
    """Log-odds of tokens, calibration of segments, and the logistic weights of the text's score."""

    def __init__(self, texts: list[bytes], labels: list[int]):
        seen: dict[bytes, int] = {}
        for t, y in zip(texts, labels, strict=True):
            seen.setdefault(t, y)
        texts, labels = list(seen), [int(y == 1) for y in seen.values()]
        # Every text is measured with the log-odds of the other folds, then the log-odds of all are kept.
        counts = [(Counter(), Counter()) for _ in range(FOLDS)]
        sizes = np.zeros((FOLDS, 2), int)
        # Toxic texts first: of the clean ones only the tokens that may get a weight are counted.
        wanted: set[str] | None = None
        for now in (1, 0):
            for i, (t, y) in enumerate(zip(texts, labels, strict=True)):
                if y == now:
                    own = {k for w in set(words(t)) for k in tokens(w)}
                    counts[i % FOLDS][y].update(own if wanted is None else own & wanted)
                    sizes[i % FOLDS, y] += 1
            if now:
                whole: Counter = sum((c[1] for c in counts), Counter())
                wanted = {k for k, n in whole.items() if n >= EVIDENCE}
                counts = [(c[0], Counter({k: n for k, n in c[1].items() if k in wanted})) for c in counts]
        total = [sum((c[y] for c in counts), Counter()) for y in (0, 1)]
        walks: list[list[float]] = [[]] * len(texts)
        for f in range(FOLDS):
            self.weights = self.log_odds(total, sizes.sum(0), counts[f], sizes[f])
            for i in range(f, len(texts), FOLDS):
                walks[i] = self.scores(texts[i])
        self.calibrate([w for w, y in zip(walks, labels, strict=True) if not y])
        x = np.array([self.features(w, segments(w)) for w in walks]).reshape(len(walks), FEATURES)
        self.fit(x, np.array(labels, float))
        self.weights = self.log_odds(total, sizes.sum(0))

    def log_odds(self, total, n, less=(Counter(), Counter()), fewer=(0, 0)) -> dict[str, float]:
        """Weights of tokens that mark toxic text with a standardized log-odds over Z; counts are of texts, without those of ``less``."""
        out: dict[str, float] = {}
        n0, n1 = int(n[0] - fewer[0]), int(n[1] - fewer[1])
        if not n0 or not n1:
            return out
        for t, a in total[1].items():
            a, b = a - less[1][t], total[0][t] - less[0][t]
            if a < EVIDENCE:
                continue
            prior = PRIOR * (a + b + 1) / (n0 + n1 + 2)
            odds = [math.log((c + prior) / (m + PRIOR - c - prior + 1)) for c, m in ((a, n1), (b, n0))]
            delta, var = odds[0] - odds[1], 1 / (a + prior) + 1 / (b + prior)
            if delta / var**0.5 > Z and delta > 1.0:
                out[t] = delta
        return dict(sorted(out.items(), key=lambda x: -x[1])[:VOCABULARY])

    def weight(self, word: str) -> float:
        for t in tokens(word):
            if (w := self.weights.get(t)) is not None:
                return w
        return 0.0

    def scores(self, text: bytes) -> list[float]:
        known = self.cache
        out = []
        for raw in text.split():
            w = known.get(raw)
            if w is None:
                own = words(raw)
                w = known[raw] = max(map(self.weight, own), default=0.0) or DRIFT
                if len(known) > 1 << 18:
                    known.clear()
            out.append(w)
        return out

    @property
    def cache(self) -> dict:
        c = self.__dict__.get("_cache")
        if c is None or c[0] is not self.weights:
            c = self._cache = (self.weights, {})
        return c[1]

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_cache"}

    def calibrate(self, clean) -> None:
        """Gumbel parameters of the best segment of clean texts, by moments; its mode grows with the log of their length."""
        best = [(max((s for _, _, s in segments(x)), default=0.0), len(x)) for x in clean if x]
        top = np.array([b for b, _ in best] or [0.0])
        self.scale = max(float(top.std()) * 6**0.5 / math.pi, 0.25)
        self.mode = max(float(top.mean()) - 0.5772 * self.scale, 0.0)
        self.typical = max(1.0, float(np.median([n for _, n in best] or [1])))

    def significance(self, score: float, n: int) -> float:
        """-log10 of the chance that a clean text of n words has a segment of this score or more."""
        x = (score - self.mode) / self.scale - math.log(max(n, 1) / self.typical + 1e-9)
        p = -math.expm1(-math.exp(-max(min(x, 600.0), -5.0)))
        return min(-math.log10(max(p, 1e-300)), 50.0)

    def passages(self, text: bytes, alpha: float = 0.05) -> list[tuple[int, int, float, float]]:
        """(first word, word after the last, score, significance) of every segment significant at ``alpha``."""
        x = self.scores(text)
        return self.significant(segments(x), len(x), alpha)

    def significant(self, own: list[tuple[int, int, float]], n: int, alpha: float = 0.05) -> list[tuple[int, int, float, float]]:
        out = [(a, b, s, self.significance(s, n)) for a, b, s in own]
        return [p for p in out if p[3] >= -math.log10(alpha)]

    def features(self, x: list[float], own: list[tuple[int, int, float]]) -> list[float]:
        """Significance of the best segment, sum of all, number of significant ones, hits, their share, whether there are any, length (sums and numbers by logarithm)."""
        best, hits = max((s for _, _, s in own), default=None), sum(v > 0 for v in x)
        many = sum(self.significance(s, len(x)) > 1.3 for _, _, s in own)
        top = 0.0 if best is None else min(self.significance(best, len(x)), 12.0)
        return [top, math.log1p(sum(s for _, _, s in own)), math.log1p(many), math.log1p(hits), 100 * hits / (len(x) + 20), float(bool(hits)), math.log1p(len(x))]

    def fit(self, x: np.ndarray, y: np.ndarray) -> None:
        """Logistic regression by Newton's method with a small ridge, on standardized features; without a toxic text no score is over that of NEVER."""
        self.mean, self.sd = (x.mean(0), x.std(0) + 1e-9) if len(x) else (np.zeros(FEATURES), np.ones(FEATURES))
        z = np.hstack([np.ones((len(x), 1)), (x - self.mean) / self.sd])
        self.beta = np.zeros(z.shape[1])
        if not y.any():
            self.beta[0] = NEVER
            return
        for _ in range(30):
            p = 1 / (1 + np.exp(-z @ self.beta))
            ridge = np.eye(z.shape[1]) * 0.5
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge, z.T @ (y - p) - ridge @ self.beta)
            self.beta += step
            if np.abs(step).max() < 1e-8:
                break

    def judged(self, text: bytes) -> tuple[float, int]:
        """The score of a text, and how many significant passages it has; one walk and one scan."""
        x = self.scores(text)
        own = segments(x)
        z = self.beta[0] + float(((np.array(self.features(x, own)) - self.mean) / self.sd) @ self.beta[1:])
        return float(1 / (1 + math.exp(-max(min(z, 35.0), -35.0)))), len(self.significant(own, len(x)))

    def score(self, text: bytes) -> float:
        return self.judged(text)[0]


def segments(x: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring subsequences (start, stop, score), in linear time (Ruzzo and Tompa 1999).

    ``left`` and ``right`` are the sums before and after each candidate; ``lower`` is the last candidate before it with a lower left sum,
    so that a search skips all between, which it could not end at.
    """
    starts, stops, left, right, lower = [], [], [], [], []
    total = 0.0
    for i, v in enumerate(x):
        total += v
        if v <= 0:
            continue
        a, lo, hi = i, total - v, total
        j = len(left) - 1
        while j >= 0 and left[j] >= lo:
            j = lower[j]
        while j >= 0 and right[j] < hi:
            a, lo = starts[j], left[j]
            below = lower[j]
            del starts[j:], stops[j:], left[j:], right[j:], lower[j:]
            j = below
        starts.append(a)
        stops.append(i + 1)
        left.append(lo)
        right.append(hi)
        lower.append(j)
    return [(a, b, r - m) for a, b, m, r in zip(starts, stops, left, right, strict=True)]


def _docs(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """The model of a bounded sample of the labelled rows outside the held-out fold, by hash of the id and whatever their length: SAMPLE texts
    at most, and none after SAMPLE_BYTES are reached. Only a text that is longer than SAMPLE_BYTES by itself is passed over.

    Rows with a null id or label are not used; a repeated text or id counts once. Without labelled texts (an empty table on either side),
    or without a toxic one among them, the model finds nothing toxic.
    """
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    marked = marked.where("doc_id is not null and toxic is not null and not " + HELD_OUT).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = marked.select("*", F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id").limit(SAMPLE)
    texts = _docs(docs).where("text is not null").join(F.broadcast(chosen), "doc_id")
    sized = written(texts.select("doc_id", "h", "toxic", F.octet_length("text").alias("n"), "text").where(F.col("n") <= SAMPLE_BYTES), "labelled")
    # Bytes before each text, by the sizes alone: what comes to the driver is bounded by them.
    sizes = sized.groupBy("doc_id", "h").agg(F.min("n").alias("n")).orderBy("h", "doc_id").toArrow()
    n = sizes["n"].to_numpy().astype(np.int64)
    ids = sizes["doc_id"].to_numpy()[np.cumsum(n) - n < SAMPLE_BYTES].tolist()
    taken = docs.sparkSession.createDataFrame([(i,) for i in ids], "doc_id long")
    rows = sized.join(F.broadcast(taken), "doc_id").groupBy("doc_id", "h", "toxic").agg(F.min(F.struct("n", "text")).alias("t"))
    rows = rows.orderBy("h", "doc_id").select("toxic", F.col("t.text").alias("text")).toArrow()
    release(docs.sparkSession, sized)
    return Model([t.encode() for t in rows["text"].to_pylist()], rows["toxic"].to_pylist())


#: The fold that is held out of fitting.
HELD_OUT = "(crc32(cast(cast(doc_id as string) as binary)) % 5 = 0)"


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """Columns doc_id, held_out, score, predicted, n_passages: one row per row of ``docs``, from whole texts.

    Null and empty texts have no passages, and the score of that. A text of any length is walked whole. A null id is not held out. Repeated
    rows are scored each, alike; equal texts have equal scores. An empty table gives none. Other columns are never read.
    """
    names = ["doc_id", "score", "n_passages"]

    def run(batches):
        for b in batches:
            judged = [model.judged(t) for t in byte_values(b.column("text"))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([s for s, _ in judged], pa.float64()), pa.array([n for _, n in judged], pa.int64())], names)

    out = _docs(docs).mapInArrow(run, "doc_id long, score double, n_passages long")
    return out.select("doc_id", F.coalesce(F.expr(HELD_OUT), F.lit(False)).alias("held_out"), "score", F.expr("cast(score >= 0.5 as int)").alias("predicted"), "n_passages")


def drop_toxic(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose text scores under ``threshold``, with all columns, whatever their names.

    Null and empty texts are scored as such, long ones whole; repeated rows stay or go together. An empty table gives none.
    """

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        return pd.Series([model.score((t or "").encode()) for t in text], dtype="float64")

    return docs.where(score(F.coalesce(F.col("text").cast("string"), F.lit(""))) < threshold)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scored(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
