"""Operators against brute force, on the smallest tables and on hard cases: nulls, empty and long texts, ties, repeats, empty tables, extra columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
import xxhash
from tokenizers import Tokenizer

from ledgerloom.llm import bpe, linededup, media, mixing, multiindex, packing, simhash, suffix, tokenfile, toxicity

DIR = "/root/testdata/sf0.001"
PASSAGE = "".join(random.Random(7).choice("abcdefgh ") for _ in range(260))
HARD = [
    (1, None, "x"), (2, "", "x"), (3, " \n\t ", None), (4, "One line, that is longer than twenty.\nOne line, that is longer than twenty!", "y"),
    (5, PASSAGE, "y"), (6, "ü" + PASSAGE + "é", "y"), (7, PASSAGE, "z"), (None, "no id at all", "z"), (9, "word " * 3000, "z"), (9, "word " * 3000, "z"), (10, "q" * 9000, None),
]
SCHEMA = "doc_id long, text string, h string"


@pytest.fixture(scope="module")
def hard(spark):
    return spark.createDataFrame(HARD, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DIR}/documents.parquet")


def pairs(df):
    return [(r.doc_id, (r.text or "")) for r in df.collect()]


def both(hard, docs):
    return [hard, docs]


def words(t):
    return re.findall(rb"[^\x20\x09-\x0D]+", t.encode().lower())


def test_media(spark, hard, docs):
    for df in both(hard, docs):
        want = Counter()
        for d, t in pairs(df):
            b = t.encode()
            p = b + b"\xff" * (-len(b) % 576 or (0 if b else 576))
            want[d, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:])] += 1
        assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in media.stored_texts(df).collect()) == want
    assert media.stored_texts(spark.createDataFrame([], SCHEMA)).count() == 0


def test_media_retries_single_members(spark, tmp_path):
    media.write_media(spark.createDataFrame([("a", b"1" * 5000), ("b", b"2" * 5000)], "member string, payload binary").coalesce(1), str(tmp_path))
    (archive,) = tmp_path.glob("*.zip")
    data = bytearray(archive.read_bytes())
    data[60] ^= 255
    archive.write_bytes(data)
    got = {r.member: r.error for r in media.read_media(spark, str(tmp_path), mode="permissive", retries=1).collect()}
    assert got["a"] and got["b"] is None


def test_simhash(spark, hard, docs):
    for df in both(hard, docs):
        rows = pairs(df)
        fp = []
        for _, t in rows:
            w = words(t)
            s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [b" ".join(w)] * bool(w)
            h = [xxhash.xxh64_intdigest(x, 42) for x in s]
            fp.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
        comp = list(range(len(rows)))
        for _ in rows:
            new = [min(comp[j] for j in range(len(rows)) if (fp[i] ^ fp[j]).bit_count() <= 3) for i in range(len(rows))]
            if new == comp:
                break
            comp = new
        least = {c: min((rows[i][0] for i in range(len(rows)) if comp[i] == c and rows[i][0] is not None), default=None) for c in comp}
        want = Counter((rows[i][0], f"{fp[i]:016x}", least[comp[i]]) for i in range(len(rows)))
        assert Counter(tuple(r) for r in simhash.near_duplicates(df).collect()) == want
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_simhash_long_runs_by_flips_and_blocks():
    rng = np.random.default_rng(1)
    run = np.unique(rng.integers(0, 1 << 12, 900).astype(np.uint64))
    want = simhash.linked_labels(run, 2, (1 << 64) - 1)
    assert (simhash.linked_labels(run, 2, (1 << 12) - 1, direct=10) == want).all()


def test_keep_one(spark, hard, docs):
    kept = simhash.keep_one(hard)
    assert kept.columns == hard.columns
    ids = Counter(r.doc_id for r in kept.collect())
    assert ids[1] == 1 and 2 not in ids and 3 not in ids and ids[5] == 1 and 7 not in ids
    assert simhash.keep_one(spark.createDataFrame([], SCHEMA)).count() == 0


def test_suffix(spark, hard, docs):
    for df in both(hard, docs):
        rows = [(d, t.encode()) for d, t in pairs(df)]
        seen = Counter(t[i : i + 200] for _, t in rows for i in range(len(t) - 199))
        want = Counter()
        for d, t in rows:
            cover = np.zeros(len(t) + 1, int)
            for i in range(len(t) - 199):
                if seen[t[i : i + 200]] > 1:
                    cover[i] += 1
                    cover[i + 200] -= 1
            gone = cover.cumsum()[: len(t)] > 0
            kept = bytes(np.frombuffer(t, np.uint8)[~gone])
            want[d, len(t), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest()] += 1
        assert Counter(tuple(r) for r in suffix.dedup_report(df).collect()) == want
    out = suffix.remove_repeats(hard)
    assert out.columns == hard.columns and {r.doc_id: r.text for r in out.collect()}[6] == "üé"
    assert suffix.dedup_report(spark.createDataFrame([], SCHEMA)).count() == 0


def test_line_dedup_sql(spark, docs):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DIR}/documents.parquet'")
    want = con.execute(linededup.ORACLE_SQL)
    names = [c[0] for c in want.description]
    got = linededup.op3(spark, DIR).select(*names)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_line_dedup_cases(spark, hard):
    base = "the quick brown fox jumps over the lazy dog"
    rows = [(1, base + "\n\nshort\nshort"), (2, base.replace("quick", "quack")), (3, base + "s"), (4, base[1:]), (5, base.replace("fox", "fxo")), (6, None), (None, base), (2**40, base[:-1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for small in (linededup.SMALL, 0):
        got = {r.doc_id: r.text for r in linededup.dedup_lines(df, small=small).collect()}
        assert got == {1: base + "\n\nshort", 2: "", 3: "", 4: "", 5: rows[4][1], 6: None, None: "", 2**40: ""}
    assert linededup.dedup_lines(hard).count() == len(HARD)
    assert linededup.dedup_lines(spark.createDataFrame([], SCHEMA)).count() == 0


def test_token_files(spark, hard, docs):
    t = Tokenizer.from_file(P.path(bpe.WORD_BPE))
    for df in both(hard, docs):
        at, want = 0, Counter()
        for d, x in sorted(pairs(df), key=lambda r: (r[0] is not None, r[0] or 0)):
            ids = [*t.encode(x, add_special_tokens=False).ids, 2]
            want[d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
            at += len(ids)
        assert Counter(tuple(r) for r in tokenfile.token_ids(df, P.path(bpe.WORD_BPE), 2).collect()) == want
    assert tokenfile.token_ids(spark.createDataFrame([], SCHEMA), P.path(bpe.WORD_BPE), 2).count() == 0


def test_elias_fano():
    rng = np.random.default_rng(2)
    for n, top in ((0, 0), (1, 0), (1, 10**9), (5000, 40), (3000, 10**7)):
        v = np.sort(rng.integers(0, top + 1, n))
        e = tokenfile.EliasFano.from_bytes(tokenfile.EliasFano.encode(v).to_bytes())
        assert (e.slice(0, n) == v).all() and all(e.select(i) == v[i] for i in range(0, n, 7))
        for i, j in ((3, 700), (256, 512), (255, 257), (n - 2, n)):
            assert n < 1000 or (e.slice(i, j) == v[i:j]).all()
        assert n < 1000 or len(e.to_bytes()) * 8 < n * (3 + max(0, math.log2(max(top, 1) / n))) + 400


@pytest.mark.parametrize("name", [bpe.BYTE_BPE, bpe.WORD_BPE])
def test_encoder_equals_library(name):
    rng = random.Random(3)
    parts = ["a", "B", "the ", ".", " ", ",", "  ", "\n", "é", "1", "99", "'s", " 't", "!?", "<|endoftext|>", "ß", "́", "\t", "漢字", "🙂", "x" * 50, "\xa0", "\x1c", " .", "., "]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(60))) for _ in range(600)] + ["", "ab" * 20000, "é" * 12001 + " x", "".join(rng.choice("abcdefgh") for _ in range(30000))]
    t, e = Tokenizer.from_file(P.path(name)), bpe.Encoder(P.path(name), list, remembered=200)
    for x, got in zip(texts, e.encode_all([x.encode() for x in texts], group=3000), strict=True):
        assert [i for c in got for i in c] == t.encode(x, add_special_tokens=False).ids


def test_text_encoder_equals_library():
    rng = random.Random(11)
    texts = ["", " ", "a" * 9000, " " * 9000 + "x", "é" * 5000, "日本語 " * 4000, "日本語" * 4000, "a" * 3000 + " " + "b" * 6000, "x<|endoftext|> y"]
    texts += ["".join(rng.choice(["a", "b", " ", "  ", "\n", "é", "日", "1", "'s", ".", "<|", "😀", "\u0301"]) for _ in range(n)) for n in (5, 50, 500, 9000) * 20]
    t, one = Tokenizer.from_file(P.path(bpe.BYTE_BPE)), bpe.text_encoder(P.path(bpe.BYTE_BPE))
    for x in texts:
        assert np.frombuffer(one(x.encode()), "<u4").tolist() == t.encode(x, add_special_tokens=False).ids


def test_runs_end_direct_encoding():
    for text, want in (("a" * 99, False), ("ab " * 50, True), ("ab " * 50 + "c" * 8, False), ("ab " * 50 + " " * 8, False), ("abc", True)):
        assert bpe.evenly_spaced(text, 8) == want, text


def test_encode_decode(spark, hard, docs):
    t = Tokenizer.from_file(P.path(bpe.BYTE_BPE))
    want = Counter()
    for d, x in pairs(hard) + pairs(docs.limit(50)):
        ids = t.encode(x, add_special_tokens=False).ids
        want[d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    df = hard.select("doc_id", "text").unionByName(docs.limit(50).select("doc_id", "text"))
    assert Counter(tuple(r) for r in bpe.encode_decode(df, P.path(bpe.BYTE_BPE)).collect()) == want


def test_packing(spark, hard, docs):
    for df in both(hard, docs):
        out = packing.packed_documents(df, P.path(bpe.BYTE_BPE)).toPandas()
        out = out.sort_values(["sequence_id", "offset"], kind="stable")
        assert (out["offset"] == out.groupby("sequence_id")["length"].cumsum() - out["length"]).all()
        assert out.groupby("sequence_id")["length"].sum().max() <= 2048
        assert out["sequence_id"].nunique() <= math.ceil(out["length"].sum() / 2048) + 1
        t, want = Tokenizer.from_file(P.path(bpe.BYTE_BPE)), Counter()
        for d, x in pairs(df):
            ids = np.array([*t.encode(x, add_special_tokens=False).ids, 0], "<u4")
            for k, (s, n) in enumerate(packing.cut(len(ids), 2048)):
                want[d, k, s, n, zlib.crc32(ids[s : s + n].tobytes())] += 1
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        assert Counter(tuple(None if v != v else int(v) for v in r) for r in out[names].itertuples(index=False)) == want
    assert packing.packed_documents(spark.createDataFrame([], SCHEMA), P.path(bpe.BYTE_BPE)).count() == 0


def test_genetic_operators_keep_all_items():
    rng = np.random.default_rng(4)
    sizes = rng.integers(1, 100, 200).tolist()
    best = packing.evolve(sizes, [], 128, 1)
    assert sorted(i for b in best.bins for i in b) == list(range(200)) and min(best.room) >= 0
    again = packing.crossover(best, packing.placed(range(200), sizes, 128), sizes, 128, rng)
    assert sorted(i for b in again.bins for i in b) == list(range(200)) and min(again.room) >= 0


def test_vectors(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 16))
    x[50:90] = x[49] + rng.normal(size=(40, 16)) * 0.05
    x[100:110] = x[99]
    rows = [(i, v.tolist(), "e") for i, v in enumerate(x)] + [(300, None, "e"), (301, [0.0] * 16, "e"), (302, [float("nan")] * 16, "e"), (303, [None] * 16, "e")]
    got = {r.vec_id: r for r in multiindex.linked(spark.createDataFrame(rows, "vec_id long, embedding array<float>, node string")).collect()}
    x = np.float32(x).astype(float)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = u @ u.T >= 0.95
    want = near.sum(1) - 1
    assert sum(got[i].n_links for i in range(300)) >= 0.9 * want.sum() and all(got[i].n_links <= want[i] for i in range(300))
    assert all(got[i].n_links == 0 and got[i].kept and got[i].component_id == i for i in range(300, 304))
    assert {got[i].component_id for i in range(99, 110)} == {99} and got[99].kept and not got[100].kept
    assert multiindex.linked(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_traversal_is_in_order_and_whole():
    rng = np.random.default_rng(6)
    a, b = rng.random(9), rng.random(7)
    seen = list(multiindex.traverse(a, b, 10.0))
    sums = [a[i] + b[j] for i, j in seen]
    assert len(set(seen)) == 63 and sums == sorted(sums)


def test_scoring(spark, docs, hard):
    rows = pairs(docs)
    held = lambda d: zlib.crc32(str(d).encode()) % 5 == 1
    count = Counter(w for d, t in rows if not held(d) for w in [*words(t), None])
    n, v = sum(count.values()), len(count)
    for r in mixing.score_texts(docs).collect():
        w = [*words(dict(rows)[r.doc_id]), None]
        base = sum(math.log10((count[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id), len(w), sum(count[x] > 0 for x in w), n)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and math.isfinite(r.score) and r.score < 0
    assert mixing.score_texts(hard).count() == len(HARD)
    assert mixing.score_texts(spark.createDataFrame([], SCHEMA)).count() == 0


def test_tree_is_a_distribution():
    counts = np.random.default_rng(8).integers(0, 50, (3, 64)).astype(float)
    assert np.allclose((2.0 ** -mixing.tree_costs(counts)).sum(1), 1)


def test_segments_are_maximal():
    rng = random.Random(9)
    for _ in range(50):
        x = [rng.uniform(-1, 1) for _ in range(30)]
        best = max((sum(x[i:j]) for i in range(30) for j in range(i + 1, 31)), default=0)
        got = toxicity.segments(x)
        assert math.isclose(max((s for _, _, s in got), default=0.0), max(best, 0.0), abs_tol=1e-9)
        assert all(math.isclose(sum(x[a:b]), s, abs_tol=1e-9) for a, b, s in got)


def test_toxicity_held_out(spark):
    rng = random.Random(10)
    rows, labels = [], []
    for i in range(600):
        w = [rng.choice(["tree", "house", "river", "stone", "cloud", "green"]) for _ in range(40)]
        y = int(i % 4 == 0)
        if y:
            w[10:10] = ["vilefool", "grubworm"]
        rows.append((i, " ".join(w)))
        labels.append((i, 1, y))
    docs = spark.createDataFrame([*rows, (900, None), (None, "")], "doc_id long, text string")
    out = toxicity.scored(docs, toxicity.fit(docs, spark.createDataFrame([*labels, (None, 1, 1), (5000, 1, None)], "doc_id long, quality int, toxic int"))).collect()
    held = [r for r in out if r.held_out and r.doc_id is not None and r.doc_id < 600]
    assert sum(r.predicted == int(r.doc_id % 4 == 0) for r in held) >= 0.95 * len(held)
    assert len(out) == 602 and all(0 <= r.score <= 1 for r in out)


def test_byte_weights_learn_from_every_word(spark):
    rng = random.Random(12)
    made = list({"".join(rng.choice("abcdeé") for _ in range(rng.randrange(6, 14))).encode() for _ in range(40_000)})
    df = spark.createDataFrame([(w,) for w in made], "word binary").coalesce(1)
    bits = 8 * sum(len(w) + 1 for w in made)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        models = []
        for size in (700, 30_000):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            models.append(mixing.fit_bytes(spark, df))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert [m.refined.sum() for m in models] == [bits, bits]
    assert np.allclose(models[0].weights, models[1].weights)


def test_equal_bits_learn_as_one():
    made = [b"abab", b"abac", b"b"] * 50
    slots, bits, _ = mixing.word_bits(made)
    counts = np.zeros((mixing.STARTS[-1], 2), np.float32)
    for y in (0, 1):
        counts[:, y] = np.bincount(slots[bits == y].ravel(), minlength=len(counts))
    model = mixing.ByteModel(counts)
    x, gate = model.inputs(slots, bits)
    n = counts[slots]
    n[np.arange(len(bits)), :, bits] -= 1
    assert np.allclose(x, np.log((n[:, :, 1] + 0.02) / (n[:, :, 0] + 0.02)), atol=1e-5)
    p, seen, want = model.mixed(x, gate), np.bincount(gate, minlength=20) + 1.0, model.weights.copy()
    for i in range(4):
        power = np.bincount(gate, x[:, i] ** 2, 20) / seen + 1.0
        want[:, i] += 0.5 * np.bincount(gate, (bits - p) * x[:, i], 20) / seen / power * (seen > 20)
    assert model.learn(made, 0.5) == len(bits) and np.allclose(model.weights, want) and model.refined.sum() == len(bits)


def test_kinds_come_from_all_texts(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SAMPLE", 12)
    rng = random.Random(13)
    tongues = [[f"{c}{i}" for i in range(40)] for c in "xyz"]
    texts = [" ".join(rng.choices(tongues[k], k=n)) for k, n, times in ((0, 60, 150), (1, 60, 20), (2, 30_000, 6)) for _ in range(times)]
    assert max(map(len, texts)) > 1 << 16
    heads = [w.encode() for t in tongues for w in t]
    head = mixing.Head(heads, mixing.kinds_of_text(spark.createDataFrame([(t,) for t in [*texts, None, ""]], "text string"), heads))
    kinds = [{int(head.walk(" ".join(rng.choices(t, k=40)).encode())[0][-1]) for _ in range(20)} for t in tongues]
    assert not (kinds[0] & kinds[1] or kinds[0] & kinds[2] or kinds[1] & kinds[2])
    assert not mixing.kinds_of_text(spark.createDataFrame([], "text string"), []).any()


def test_keep_one_links_by_exact_similarity(spark):
    rng = random.Random(14)
    fresh = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    rows, want = [], set()
    for i in range(120):
        a = fresh(204)
        # One changed word takes five of 200 shingles: 4 changes are 180 of 220 (0.818), 5 are 175 of 225 (0.778).
        b = list(a)
        for at in range(20, 20 + 40 * (4 + i % 2), 40):
            b[at] = "changed%d" % rng.randrange(10**9)
        rows += [(2 * i, " ".join(a)), (2 * i + 1, " ".join(b))]
        want |= {2 * i} | ({2 * i + 1} if i % 2 else set())
    got = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want
    a = np.arange(9, dtype=np.uint64)
    assert simhash.similar(a[:8], a[:8]) and simhash.similar(a[:4], a[:5]) and not simhash.similar(a[:3], a[:4])


def test_toxicity_learns_from_long_texts(spark):
    rng = random.Random(15)
    rows, labels = [], []
    for i in range(120):
        w = [rng.choice(["tree", "house", "river", "stone", "cloud", "green"]) for _ in range(4000 if i % 2 else 40)]
        if i % 2:
            for at in range(0, len(w), 40):
                w[at:at] = ["vilefool", "grubworm"]
        rows.append((i, " ".join(w)))
        labels.append((i, i % 2))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert model.weight("vilefool") > 0 and model.score(rows[1][1].encode()) > 0.5 > model.score(rows[0][1].encode())
    x = ([3.0] + [toxicity.DRIFT] * 60) * 80
    model.mode, model.scale, model.typical = 0.0, 0.25, 1.0
    assert math.isclose(model.features(x, toxicity.segments(x))[2], math.log1p(80))
