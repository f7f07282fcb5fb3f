"""The pipeline's SimHash stage: exact links, measured recall at its threshold, large groups, hard rows."""

import random
from collections import Counter

import numpy as np

from ledgerloom.llm import simhash


def shingles(t):
    w = t.lower().split()
    return {" ".join(w[i : i + 5]) for i in range(len(w) - 4)} or ({" ".join(w)} if w else set())


def kept_by_brute_force(rows):
    """doc_ids that stay: of each component of pairs at 0.8 or more, the row of the smallest id."""
    sets = [shingles(t or "") for _, t in rows]
    comp = list(range(len(rows)))
    near = [[j for j in range(len(rows)) if not sets[i] and not sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])] for i in range(len(rows))]
    while True:
        new = [min(comp[j] for j in near[i]) for i in range(len(rows))]
        if new == comp:
            break
        comp = new
    order = lambda i: (rows[i][0] is None, rows[i][0] or 0)
    best = {}
    for i in range(len(rows)):
        best[comp[i]] = min(best.get(comp[i], i), i, key=order)
    return Counter(rows[i][0] for i in best.values())


def test_keep_one_equals_brute_force(spark):
    rng = random.Random(21)
    fresh = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    rows = [(900, None), (901, ""), (902, " \n"), (903, "two words"), (904, "Two Words"), (None, "no id " * 9)]
    for g in range(60):
        base = fresh(rng.choice([6, 40, 120, 300]))
        for _ in range(rng.choice([1, 1, 2, 5])):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 6])):
                own[rng.randrange(len(own))] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows) * 7 % 499 + 1000 * g, " ".join(own)))
    df = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, node string")
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert Counter(r.doc_id for r in kept.collect()) == kept_by_brute_force(rows)


def test_recall_at_the_threshold():
    """Of pairs at exactly 0.8, nine in ten or more share a block and pass the comparison of bits, whatever the table's size."""
    rng = np.random.default_rng(22)
    one, two = [], []
    for _ in range(400):
        h = rng.integers(0, 1 << 63, 220, dtype=np.uint64) * np.uint64(2)
        for out, own in ((one, h[:200]), (two, np.concatenate([h[:180], h[200:220]]))):
            out.append(simhash.folded([x.astype(">u8").tobytes() for x in own], simhash.WIDE))
    one, two = (np.array(x, np.uint64) for x in (one, two))
    for n in (1_000, 200_000, 12_000_000):
        blocks = simhash.Blocks(n)
        share = (blocks.keys(one) == blocks.keys(two)).any(1)
        near = np.bitwise_count(one[:, :2] ^ two[:, :2]).sum(1) <= simhash.RADIUS
        assert (share & near).mean() >= 0.98, n


def test_long_runs_find_what_short_ones_find(monkeypatch):
    rng = np.random.default_rng(23)
    x = np.repeat(rng.integers(0, 1 << 63, 150, dtype=np.uint64), 4)
    y = np.repeat(rng.integers(0, 1 << 63, 150, dtype=np.uint64), 4)
    for a in (x, y):
        a ^= np.uint64(1) << rng.integers(0, 63, len(a)).astype(np.uint64)
    key, comp = np.zeros(len(x), np.int64), np.arange(len(x))
    whole = lambda: {(min(a, b), max(a, b)) for i, j, _ in simhash.pairs_in_runs(key, comp, x, y) for a, b in zip(i.tolist(), j.tolist(), strict=True)}
    want = whole()
    assert len(want) >= 150 * 6
    for size in (16, 64, 590):
        monkeypatch.setattr(simhash, "COMPARED", size)
        assert len(whole() & want) >= 0.99 * len(want)
    comp[:] = 0
    comp[::50] = 1 + np.arange(12)
    few = {(a, b) for a, b in want if comp[a] != comp[b]}
    assert whole() == few


def test_a_large_group_of_near_copies_is_one(spark):
    rng = random.Random(24)
    base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    rows = []
    for i in range(3000):
        own = list(base)
        own[rng.randrange(150)] = f"x{i}"
        rows.append((i, " ".join(own)))
    rows += [(5000 + i, " ".join(f"y{rng.randrange(10**6)}" for _ in range(150))) for i in range(200)]
    got = sorted(r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [0, *range(5000, 5200)]


def test_texts_among_many_near_copies_they_are_not_similar_to(spark, monkeypatch):
    """A group whose members are mostly under 0.8 of each other, with a few true links: the dense way and the pairs give what brute force gives."""
    rng = random.Random(25)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    rows = []
    for i in range(260):
        own = list(base)
        for at in rng.sample(range(5, 115), rng.choice([1, 3, 5, 7])):
            own[at] = f"x{i}-{at}"
        rows.append((i, " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = kept_by_brute_force(rows)
    assert 5 < len(want) < 255
    for dense in (simhash.DENSE, 2):
        monkeypatch.setattr(simhash, "DENSE", dense)
        assert Counter(r.doc_id for r in simhash.keep_one(df).collect()) == want
