"""Language-model scoring: predictions of word contexts by brute force, the whole score recomputed, held-out gain, independence of layout."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import mixing

DIR = "/root/testdata/%s"


def corpus(n=160, seed=61):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7))) for _ in range(400)]
    passages = [[rng.choice(words) for _ in range(60)] for _ in range(6)]
    texts = []
    for _ in range(n):
        t = [words[min(int(rng.expovariate(0.02)), 399)] for _ in range(rng.randrange(0, 60))]
        if rng.random() < 0.5:
            t[len(t) // 2 : len(t) // 2] = rng.choice(passages)
        texts.append(" ".join(t))
    return texts


def test_predictions_equal_brute_force(spark, monkeypatch):
    texts = corpus(60)
    head = mixing.Shared(spark, "head", ([b"abc"],))
    rows = [(i, i % 3 != 0, t) for i, t in enumerate(texts)]
    segments, cells = mixing.followed(spark.createDataFrame(rows, "k long, train boolean, text string"), head, 4)
    assert sum(r.n for r in cells.collect()) == sum(len(t.split()) + 1 for _, train, t in rows if train)
    # Every segment is what follows its context, up to the next one.
    own = defaultdict(list)
    for r in segments.collect():
        own[r.k].append((r.at, r.ctx, bytes(r.seg)))
    by_ctx = defaultdict(Counter)
    for k, train, t in rows:
        found, n = sorted(own[k]), len(t.split())
        assert all(len(seg) == 2 * (stop - at) for (at, _, seg), stop in zip(found, ([a for a, _, _ in found[1:]] + [n])[: len(found)], strict=True))
        for _, ctx, seg in found if train else ():
            by_ctx[ctx][seg] += 1
    total = 0
    got = {(r.k, r.at): (r.right, r.wrong, r.sure) for r in mixing.predicted(segments).collect()}
    for k, train, _ in rows:
        for at, ctx, seg in own[k]:
            left = Counter(by_ctx[ctx])
            if train:
                left[seg] -= 1
            left = +left
            if not left:
                assert (k, at) not in got
                continue
            # The prediction is one of the most frequent ones that remain, or, of an own one, what was so before.
            right, wrong, sure = got[k, at]
            most = max(left.values())
            fits = []
            for one, n in left.items():
                same = next((i for i in range(0, min(len(seg), len(one)), 2) if seg[i : i + 2] != one[i : i + 2]), min(len(seg), len(one))) // 2
                fits.append((same, same < min(len(seg), len(one)) // 2, mixing.sureness(n, sum(left.values())), n))
            assert any((right, wrong, sure) == f[:3] and f[3] >= most - 1 for f in fits)
            total += 1
    assert total > 20


def test_whole_score_by_hand(spark):
    """The score of each text from the model's parts, word by word."""
    texts = corpus()
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    held = lambda d: zlib.crc32(str(d).encode()) % 5 == 1
    seen = {}
    keep = mixing.flag_costs

    def spy(found):
        out = keep(found)
        seen["flags"], seen["found"] = out, {(r.k, r.train, r.at): r for r in found.collect()}
        return out

    tree, base = mixing.tree_costs, {}
    with pytest.MonkeyPatch.context() as m:
        m.setattr(mixing, "flag_costs", spy)
        m.setattr(mixing, "tree_costs", lambda c: base.setdefault("bits", tree(c)))
        m.setattr(mixing, "kinds_of_text", lambda docs, words: np.zeros((mixing.CLASSES, min(mixing.MARKS, len(words) + 2)), np.float32))
        got = {r.doc_id: r for r in mixing.score_texts(df).collect()}
    count = Counter(w for i, t in enumerate(texts) if not held(i) for w in t.split())
    frequent = sorted((w for w, c in count.items() if c >= mixing.SEEN), key=lambda w: (-count[w], w))
    place = {w: i + 2 for i, w in enumerate(frequent)}
    rare = [w for w in count if w not in place]
    keys = {r.doc_id: r.k for r in df.select("doc_id", F.xxhash64("text", F.octet_length("text")).alias("k")).collect()}
    rare_total, singles = sum(count[w] for w in rare), sum(c == 1 for c in count.values())
    new = (singles + 0.5) / (rare_total + 1.0)
    exact = 0
    for i, t in enumerate(texts):
        w = t.split()
        mine = {at: r for (k, train, at), r in seen["found"].items() if k == keys[i] and train == (not held(i))}
        hit, score, unknown = set(), 0.0, False
        for at, r in mine.items():
            for x in range(r.right):
                hit.add(at + x)
                score -= seen["flags"][1, r.sure, min(x, mixing.RIGHT - 1)]
            if r.wrong:
                score -= seen["flags"][0, r.sure, min(r.right, mixing.RIGHT - 1)]
        for at, x in enumerate([*w, None]):
            if at in hit:
                continue
            score -= base["bits"][0, 0 if x is None else place.get(x, 1)]
            if x is not None and x not in place:
                if x in count:
                    score += math.log2(count[x] / max(rare_total, 1) * max(1 - new, 1e-6))
                else:
                    unknown = True
        if not unknown:
            exact += 1
            assert math.isclose(got[i].score, score / mixing.LOG2_10, rel_tol=1e-4, abs_tol=1e-3)
    assert exact > 100


def test_every_tree_bit_is_learned_in_one_batch():
    n = np.random.default_rng(64).integers(0, 3 * mixing.BATCHES, (8, 50)).astype(float) * (np.random.default_rng(65).random((8, 50)) < 0.7)
    often, shift, few, ends = mixing.dealt_bits(n, 5)
    got, size = np.zeros(n.size), []
    for b in range(mixing.BATCHES):
        part = np.zeros(n.size)
        part[often] += n.ravel()[often] // mixing.BATCHES + ((b + shift) % mixing.BATCHES < n.ravel()[often] % mixing.BATCHES)
        part[few[ends[b] : ends[b + 1]]] += n.ravel()[few[ends[b] : ends[b + 1]]]
        got, size = got + part, [*size, part.sum()]
    assert (got == n.ravel()).all() and max(size) < 1.3 * min(size)


def test_tree_mixes_online_as_by_hand():
    """Four contexts of every bit, weights that take a step after each batch, the map: bit by bit."""
    rng = np.random.default_rng(66)
    counts = np.floor(rng.gamma(0.4, 60, (2 * mixing.AFTER, 8))) * (rng.random((2 * mixing.AFTER, 8)) < 0.8)
    levels, cells = 3, mixing.TREE_MAP
    seen = {(r, lv, v, y): counts[r].reshape(-1, 8 >> lv + 1)[2 * v + y].sum() for r in range(len(counts)) for lv in range(levels) for v in range(1 << lv) for y in (0, 1)}
    alike = lambda r: (range(len(counts)), [k for k in range(len(counts)) if k // mixing.AFTER == r // mixing.AFTER], [k for k in range(len(counts)) if k % mixing.AFTER == r % mixing.AFTER], [r])
    share = np.linspace(0.0, 0.8, mixing.GATES)
    weights, refined = [np.array([0.4 * (1 - s), 0.4 * (1 - s), 0.2 * (1 - s), s]) for s in share], Counter()
    curve = [np.zeros((4, 4)) for _ in share]

    def predict(r, lv, v, y=None):
        n = [[sum(seen[k, lv, v, bit] for k in rows) - (bit == y) for bit in (0, 1)] for rows in alike(r)]
        x, gate = np.array([math.log((b + 0.05) / (a + 0.05)) for a, b in n]), min(int(math.log2(sum(n[-1]) + 1)), mixing.GATES - 1)
        t = min(max(float(weights[gate] @ x), -14), 14)
        at = (t + 14) * (cells - 1) / 28
        cell = min(int(at), cells - 2)
        return x, gate, 1 / (1 + math.exp(-t)), cell, at - cell

    dealt = {}
    for lv in range(levels):
        for y in (0, 1):
            n = np.array([[seen[r, lv, v, y] for v in range(1 << lv)] for r in range(len(counts))])
            often, shift, few, ends = mixing.dealt_bits(n, 2 * lv + y)
            for at, by in zip(often.tolist(), shift.tolist(), strict=True):
                for b in range(mixing.BATCHES):
                    dealt[b, at >> lv, lv, at & (1 << lv) - 1, y] = n.ravel()[at] // mixing.BATCHES + ((b + by) % mixing.BATCHES < n.ravel()[at] % mixing.BATCHES)
            for b in range(mixing.BATCHES):
                for at in few[ends[b] : ends[b + 1]].tolist():
                    dealt[b, at >> lv, lv, at & (1 << lv) - 1, y] = n.ravel()[at]
    for b in range(mixing.BATCHES):
        slope = [np.zeros(4) for _ in share]
        for (batch, r, lv, v, y), times in dealt.items():
            if batch == b:
                x, gate, p, cell, beyond = predict(r, lv, v, y)
                slope[gate] += (y - p) * times * x
                curve[gate] += p * (1 - p) * times * np.outer(x, x)
                refined[gate, cell, y] += times * (1 - beyond)
                refined[gate, cell + 1, y] += times * beyond
        for g in range(mixing.GATES):
            step = np.linalg.solve(curve[g] + 1e-3 * (1 + np.trace(curve[g])) * np.eye(4), slope[g])
            weights[g] = np.clip(weights[g] + np.clip(step, -0.5, 0.5), -0.5, 2.0)
    got = mixing.tree_costs(counts)
    for r in range(len(counts)):
        for place in range(8):
            bits = 0.0
            for lv in range(levels):
                v, y = place >> levels - lv, place >> levels - lv - 1 & 1
                _, gate, p, cell, beyond = predict(r, lv, v)
                n0, n1 = (refined[gate, cell, bit] * (1 - beyond) + refined[gate, cell + 1, bit] * beyond for bit in (0, 1))
                p = (p + (n1 + 4 * p) / (n0 + n1 + 4)) / 2
                bits -= math.log2(p if y else 1 - p)
            assert math.isclose(got[r, place], bits, rel_tol=1e-4, abs_tol=1e-4)


def test_words_are_predicted_by_the_word_before(spark):
    """Texts in which every word fixes the next one but for its class: the tree's bits must use the word before. Rows by hand."""
    rng = random.Random(67)
    heads = [f"w{i}".encode() for i in range(40)]
    logp = np.zeros((mixing.CLASSES, 42), np.float32)
    logp[:, 2:] = np.random.default_rng(68).normal(0, 0.1, (mixing.CLASSES, 40))
    h = mixing.Head(heads, logp)
    assert not h.after[:2].any() and set(h.after[2:].tolist()) == set(range(1, mixing.AFTER)) and not mixing.Head(heads, 0 * logp).after.any()
    follows = {c: [i for i in range(40) if i % mixing.AFTER == c] for c in range(mixing.AFTER)}
    texts = []
    for _ in range(60):
        text = [rng.randrange(40)]
        while len(text) < 80:
            text.append(rng.choice(follows[int(h.after[text[-1] + 2])]))
        texts.append(" ".join(f"w{i}" for i in text))
    _, cells = mixing.followed(spark.createDataFrame([(i, True, t) for i, t in enumerate(texts)], "k long, train boolean, text string"), mixing.Shared(spark, "head", (heads, logp)), 64)
    want, counts = Counter(), np.zeros((mixing.CLASSES * mixing.AFTER, 64))
    for t in texts:
        sums, before = np.zeros(mixing.CLASSES, np.float32), 0
        for w in [*t.split(), None]:
            place = 0 if w is None else int(w[1:]) + 2
            want[(int(sums.argmax()) * mixing.AFTER + before) * 64 + place] += 1
            sums, before = sums + logp[:, place], int(h.after[place])
    got = {r.cell: r.n for r in cells.collect()}
    assert got == want
    for cell, n in got.items():
        counts.ravel()[cell] = n
    bits = mixing.tree_costs(counts)
    # 40 words are over five bits each; the word before leaves five of them.
    assert (bits * counts).sum() / counts.sum() < 3.5


def test_flags_are_bits_of_probabilities(spark):
    rows = [(1, True, 0, r % 12, r % 3 == 0, r % mixing.SURE) for r in range(500)]
    bits = mixing.flag_costs(spark.createDataFrame(rows, "k long, train boolean, at int, right int, wrong boolean, sure int"))
    assert np.allclose((2.0**-bits).sum(0), 1) and (bits > 0).all()


@pytest.mark.parametrize("sf", ["sf0.01"])
def test_held_out_texts_score_above_the_base(spark, sf):
    out = mixing.op5(spark, DIR % sf).where("held_out").agg(F.sum("score").alias("score"), F.sum("base_score").alias("base"), F.sum("n_tokens").alias("n")).first()
    assert out.score > out.base + 0.1 * out.n


def test_scores_do_not_depend_on_layout(spark):
    texts = corpus(120, 62)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    one, two = ({r.doc_id: r.score for r in mixing.score_texts(d).collect()} for d in (df.coalesce(1), df.repartition(7, "text").sortWithinPartitions(F.desc("doc_id"))))
    assert one.keys() == two.keys() and all(math.isclose(one[k], two[k], rel_tol=1e-6) for k in one)


def test_copies_are_told_apart_from_what_occurs_once(spark):
    rng = random.Random(63)
    words = [f"w{i}" for i in range(3000)]
    texts = [" ".join(rng.choice(words) for _ in range(150)) for _ in range(120)]
    rows = list(enumerate(texts)) + [(1000 + i, texts[i]) for i in range(20)]
    got = {r.doc_id: r.bits_per_byte for r in mixing.score_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    # What one of two copies can be predicted by is the other, if that is in training.
    twice, once = [min(got[i], got[1000 + i]) for i in range(20)], [got[i] for i in range(20, 120)]
    assert sum(t < min(once) for t in twice) >= 17
