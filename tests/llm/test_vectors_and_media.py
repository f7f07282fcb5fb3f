"""Multi-index links against all pairs, recall on the shipped table, ragged vectors, large groups; media reads in ranges."""

import hashlib
import zlib

import numpy as np

from ledgerloom.llm import media, multiindex

DIR = "/root/testdata/sf0.001"


def exact(vectors, threshold=0.95):
    """Links and components by all pairs of vectors (None: links with nothing)."""
    n = len(vectors)
    near = np.zeros((n, n), bool)
    for i, a in enumerate(vectors):
        for j, b in enumerate(vectors):
            if i != j and a is not None and b is not None and len(a) == len(b):
                near[i, j] = np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b) >= threshold
    comp = np.arange(n)
    while True:
        new = np.array([min([comp[i], *comp[near[i]]]) for i in range(n)])
        if (new == comp).all():
            return near.sum(1), comp
        comp = new


def test_recall_on_the_shipped_table(spark):
    df = spark.read.parquet(f"{DIR}/embeddings.parquet")
    rows = sorted(df.collect(), key=lambda r: r.vec_id)
    x = np.array([r.embedding for r in rows], float)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = u @ u.T >= 0.95
    want = near.sum(1) - 1
    got = {r.vec_id: r for r in multiindex.linked(df).collect()}
    links = np.array([got[r.vec_id].n_links for r in rows])
    assert (links <= want).all() and links.sum() >= 0.9 * want.sum()
    at = {r.vec_id: i for i, r in enumerate(rows)}
    for i, r in enumerate(rows):
        assert got[r.vec_id].kept == (got[r.vec_id].component_id == r.vec_id)
        assert links[i] == 0 or any(near[i, at[s.vec_id]] and got[s.vec_id].component_id == got[r.vec_id].component_id for s in rows if s.vec_id != r.vec_id)


def test_ragged_vectors_and_clashing_columns(spark):
    rng = np.random.default_rng(41)
    x = [None if k % 31 == 0 else rng.normal(size=8 if k % 3 else 6) for k in range(240)]
    for k in range(1, 240):
        if k % 5 == 0 and x[k] is not None and x[k - 3] is not None and len(x[k]) == len(x[k - 3]):
            x[k] = x[k - 3] + rng.normal(size=len(x[k])) * 0.03
    x[200:210] = [np.array([1.0, 0, 0, 0, 0, 0, 0, 0])] * 5 + [np.array([1.0, 0, 0, 0, 0, 0])] * 5
    df = spark.createDataFrame([(i, None if v is None else v.tolist(), 1, "n") for i, v in enumerate(x)], "vec_id long, embedding array<double>, cell int, node string")
    links, comp = exact(x)
    got = {r.vec_id: r for r in multiindex.linked(df, recall=1.0).collect()}
    assert sum(got[i].n_links for i in range(240)) >= 0.98 * links.sum() and all(got[i].n_links <= links[i] for i in range(240))
    assert sum(got[i].component_id == comp[i] for i in range(240)) >= 236
    assert got[204].component_id == 200 and got[209].component_id == 205


def test_links_count_on_both_sides(spark, monkeypatch):
    rng = np.random.default_rng(42)
    x = rng.normal(size=(400, 12))
    x[1::2] = x[::2] + rng.normal(size=(200, 12)) * 0.09
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    monkeypatch.setattr(multiindex, "PER_CELL", 2)
    got = {r.vec_id: r.n_links for r in multiindex.linked(df, recall=0.6).collect()}
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = (u @ u.T >= 0.95) & ~np.eye(400, dtype=bool)
    # Pairs alone with each other: found by one traversal or by both, both count it.
    alone = [i for i in range(0, 400, 2) if near[i].sum() == near[i + 1].sum() == 1 and near[i, i + 1]]
    assert len(alone) > 50 and all(got[i] == got[i + 1] for i in alone)


def test_a_large_group_of_near_vectors(spark):
    rng = np.random.default_rng(43)
    base = rng.normal(size=16)
    x = np.concatenate([base + rng.normal(size=(1500, 16)) * 0.05, rng.normal(size=(300, 16)), np.tile(base, (500, 1))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in multiindex.linked(df).collect()}
    u = x / np.linalg.norm(x, axis=1)[:, None]
    want = (u @ u.T >= 0.95).sum(1) - 1
    assert len({got[i].component_id for i in [*range(1500), *range(1800, 2300)]}) <= 5
    assert sum(r.n_links for r in got.values()) >= 0.95 * want.sum() and all(got[i].n_links <= want[i] for i in range(2300))


def test_media_forms_and_features(spark, tmp_path):
    texts = ["", "a", "é" * 700, "x" * 576, "long " * 40_000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for r in media.stored_texts(df).collect():
        png = media.encode_png(media.padded(texts[r.doc_id].encode()))
        x = np.frombuffer(media.padded(texts[r.doc_id].encode()), np.uint8).astype(float)
        mean, sd = (float(part.split("=")[1]) for part in r.feature.split(";")[:2])
        assert (r.media_bytes, r.media_sha256) == (len(png), hashlib.sha256(png).hexdigest()) and abs(mean - x.mean()) < 1e-3 and abs(sd - x.std()) < 1e-3
        runs = [x[a:b].mean() for a, b in zip(np.arange(64) * len(x) // 64, np.append(np.arange(1, 64) * len(x) // 64, len(x)), strict=True)]
        bits = int(r.feature.split("ahash=")[1], 16)
        assert all((bits >> (63 - k) & 1) == (v > x.mean()) for k, v in enumerate(runs) if abs(v - x.mean()) > 1e-6)
    media.write_media(spark.createDataFrame([(str(i), bytes([i]) * 3000) for i in range(40)], "member string, payload binary").coalesce(1), str(tmp_path))
    for size in (700, 1 << 20):
        rows = media.read_media(spark, str(tmp_path), range_bytes=size).collect()
        assert sorted(int(r.member) for r in rows) == list(range(40)) and all(media.decode_png(r.media)[:3000] == bytes([int(r.member)]) * 3000 for r in rows)


def test_permissive_reads_describe_what_is_left(spark, tmp_path):
    media.write_media(spark.createDataFrame([("1", b"1" * 5000), ("2", b"2" * 5000)], "member string, payload binary").coalesce(1), str(tmp_path))
    (archive,) = tmp_path.glob("*.zip")
    data = bytearray(archive.read_bytes())
    data[60] ^= 255
    archive.write_bytes(data)
    got = {r.doc_id: r.n_bytes for r in media.described(media.read_media(spark, str(tmp_path), mode="permissive", retries=0)).collect()}
    assert got == {1: None, 2: 5000} and zlib.crc32(b"") == 0
