"""Repeated passages: names of buckets, blocks of long texts, removal against brute force."""

import random
from collections import Counter

import numpy as np

from ledgerloom.llm import suffix


def kept(texts, length):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        out.append(bytes(np.frombuffer(t, np.uint8)[~gone]))
    return out


def test_names_are_equal_where_strings_are():
    rng = random.Random(31)
    text = bytes(rng.choice(b"ab") for _ in range(900))
    for q in (8, 20, 32):
        names = suffix.Names(text, q)
        for n in (q, q + 1, 2 * q - 1, 2 * q, 5 * q + 3, 300):
            start = np.arange(len(text) - n + 1)
            got = names.ranges(start, n, n)
            want = [text[i : i + n] for i in start.tolist()]
            assert len(set(zip(got.tolist(), want, strict=True))) == len(set(got.tolist())) == len(set(want))


def test_segments_of_many_texts_are_those_of_each():
    rng = random.Random(33)
    texts = [bytes(rng.choice(b"abc ") for _ in range(rng.choice([200, 201, 350, 900]))) for _ in range(30)]
    *whole, of = suffix.segments(texts)
    for i, t in enumerate(texts):
        *one, _ = suffix.segments([t])
        assert all((w[of == i] == o).all() for w, o in zip(whole, one, strict=True))


def test_removal_equals_brute_force_in_blocks(spark):
    rng = random.Random(32)
    shared = ["".join(rng.choice("abcdé ") for _ in range(n)) for n in (60, 200, 210, 400)]
    texts = ["", "x" * 199, "ab" * 400]
    for _ in range(60):
        parts = [rng.choice(shared) if rng.random() < 0.4 else "".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(300))) for _ in range(rng.randrange(1, 6))]
        texts.append("".join(parts))
    df = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    want = {i: len(t) for i, t in enumerate(kept([t.encode() for t in texts], 200))}
    for block in (1 << 22, 150):
        assert {r.doc_id: r.n_bytes - r.n_removed for r in suffix.dedup_report(df, block=block).collect()} == want
    out = suffix.remove_repeats(df)
    assert out.columns == df.columns and out.count() == len(texts)
    chars = [bytes(k).decode(errors="ignore") for k in kept([t.encode() for t in texts], 200)]
    got = {r.doc_id: r.text for r in out.collect()}
    assert sum(got[i] == chars[i] for i in got) >= len(texts) - 3 and all(len(got[i]) >= len(chars[i]) for i in got)
