"""The grouping genetic algorithm: where best-fit decreasing is known to be worse, crossover and migration save bins."""

import random

import numpy as np

from ledgerloom.llm import packing


def triplets(n, capacity, seed):
    """3n items that fill n bins exactly, three in each: best-fit decreasing needs more."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        a = rng.randrange(capacity * 38 // 100, capacity * 49 // 100)
        b = rng.randrange(capacity // 4, capacity // 2 - (a - capacity // 4) // 2)
        out += [a, b, capacity - a - b]
    rng.shuffle(out)
    return out


def bins_by_decreasing(sizes, capacity):
    return len(packing.placed(sorted(range(len(sizes)), key=sizes.__getitem__, reverse=True), sizes, capacity).bins)


def test_crossover_saves_bins():
    saved = 0
    for seed in range(6):
        sizes = triplets(40, 1000, seed)
        best = packing.evolve(sizes, [], 1000, seed, generations=60)
        assert sorted(i for b in best.bins for i in b) == list(range(len(sizes))) and min(best.room) >= 0
        down = bins_by_decreasing(sizes, 1000)
        assert 40 <= len(best.bins) <= down
        saved += down - len(best.bins)
    assert saved >= 6


def test_every_generation_builds_on_crossover():
    """Without generations the islands' groupings stay as they were; with them they get better."""
    sizes = triplets(60, 2048, 3)
    alone, grown = (packing.evolve(sizes, [], 2048, 5, generations=g, island=1) for g in (0, 40))
    assert len(grown.bins) < len(alone.bins)


def test_an_immigrant_is_taken_in():
    sizes = triplets(40, 1000, 8)
    good = packing.evolve(sizes, [], 1000, 1, generations=80)
    poor = packing.grouping(sizes, 1000, np.random.default_rng(1), 0.3)
    assert len(good.bins) < len(poor.bins)
    assert len(packing.evolve(sizes, [poor, good], 1000, 2, generations=3, island=1).bins) <= len(good.bins)


def test_shards_meet_their_bound_and_stay_bounded(spark):
    rng = random.Random(9)
    rows = [(i, 0, 0, rng.choice([rng.randrange(1, 40), rng.randrange(300, 1500)]), i) for i in range(3000)]
    df = spark.createDataFrame([*rows, (None, 0, 0, 2048, 1), (None, 0, 0, 2048, 1)], packing.PIECES)
    out = packing.pack(df, shard=500).toPandas()
    used = out.groupby("sequence_id")["length"].sum()
    assert len(out) == 3002 and used.max() <= 2048 and len(used) <= -(-int(out["length"].sum()) // 2048) + 3
    assert packing.pack(df.limit(0)).count() == 0
