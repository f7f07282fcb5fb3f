"""The corpus pipeline: every stage and the whole against brute force on a small fixture; its stages keep the columns of documents, and survive hard rows."""

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

import corpus_pipeline
from ledgerloom.llm import bpe, linededup, packing, shared, toxicity

from .test_passages import kept
from .test_similar_documents import kept_by_brute_force

DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def within_one_edit(a, b):
    if a == b:
        return True
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def lines_left(rows):
    """(doc_id, text) without lines that equal an earlier one, or are within an edit of it from twenty characters on."""
    firsts, out = {}, []
    for d, t in rows:
        for line in (t or "").split("\n"):
            firsts.setdefault(line, len(firsts))
    long = [x for x in firsts if len(x) >= linededup.MIN_CHARS and x.strip(" \t\r")]
    near = {b for k, b in enumerate(long) if any(within_one_edit(a, b) for a in long[:k])}
    seen = set()
    for d, t in rows:
        if t is None:
            out.append((d, t))
            continue
        keep = []
        for line in t.split("\n"):
            if not line.strip(" \t\r"):
                keep.append(line)
            elif line not in seen:
                seen.add(line)
                if line not in near:
                    keep.append(line)
        out.append((d, "\n".join(keep)))
    return out


def fixture():
    rng = random.Random(51)
    fresh = lambda n: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 8))) for _ in range(n))
    passage, line, rows, labels = fresh(60), fresh(12), [], []
    for i in range(140):
        parts = [fresh(rng.choice([3, 30, 80])) for _ in range(rng.randrange(1, 5))]
        if i % 9 == 0:
            parts.insert(1, passage)
        if i % 7 == 0:
            parts.append(line if i % 2 else line[:5] + "#" + line[6:])
        if i % 5 == 0:
            parts.append("such a vilefool and grubworm " + fresh(4))
        labels.append((i, 1, int(i % 5 == 0)))
        rows.append((i, "\n".join(parts)))
    words = rows[3][1].split(" ")
    rows += [(200, rows[3][1]), (201, " ".join([*words[:-1], "changed"])), (202, None), (203, ""), (204, fresh(3000)), (205, rows[11][1])]
    return rows, labels


def test_whole_pipeline_equals_brute_force(spark, tmp_path):
    rows, labels = fixture()
    docs = spark.createDataFrame([(d, t, "en", "s", None if t is None else len(t)) for d, t in rows], SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    want = [[(d, t) for d, t in rows if model.score((t or "").encode()) < 0.5]]
    assert {d for d, _ in rows} - {d for d, _ in want[0]} == set(range(0, 140, 5))
    want.append(lines_left(want[0]))
    stays = kept_by_brute_force(want[1])
    want.append([(d, t) for d, t in want[1] if stays[d]])
    cut = kept([(t or "").encode() for _, t in want[2]], 200)
    want.append([(d, None if t is None else c.decode()) for (d, t), c in zip(want[2], cut, strict=True)])
    got = spark.read.parquet(f"{tmp_path}/documents.parquet")
    sizes = [got.count()]
    for (name, stage), rows_wanted in zip(corpus_pipeline.STAGES[:-1], want, strict=True):
        got = shared.written(stage(spark, got, str(tmp_path)), name)
        assert got.columns == docs.columns
        found = got.collect()
        assert Counter((r.doc_id, r.text) for r in found) == Counter(rows_wanted), name
        assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in found)
        sizes.append(len(found))
    assert sizes[0] > sizes[1] == sizes[2] > sizes[3] == sizes[4] and any(a != b for a, b in zip(want[0], want[1], strict=True)) and want[2] != want[3]
    t, pieces = Tokenizer.from_file(P.path(bpe.BYTE_BPE)), Counter()
    for d, x in want[3]:
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 0], "<u4")
        for k, (s, n) in enumerate(packing.cut(len(ids), 2048)):
            pieces[d, k, s, n, zlib.crc32(ids[s : s + n].tobytes())] += 1
    packed = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert Counter(tuple(map(int, r)) for r in packed[names].itertuples(index=False)) == pieces
    used = packed.groupby("sequence_id")["length"].sum()
    assert used.max() <= 2048 and len(used) <= -(-int(packed["length"].sum()) // 2048) + 1


def test_stages_survive_hard_rows_and_empty_tables(spark, tmp_path):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").limit(60)
    hard = [(90001, None, None, None, None), (90002, "", None, None, 0), (None, "no id", "x", None, 5), (7, "again " * 9, "x", "s", 54), (7, "again " * 9, "x", "s", 54), (90003, "long " * 60_000, "x", "s", 300_000)]
    docs = docs.unionByName(spark.createDataFrame(hard, docs.schema)).select("*", docs["doc_id"].alias("node"), docs["n_chars"].alias("spans"), docs["lang"].alias("kept"))
    for table in (docs, docs.limit(0)):
        now = table
        for name, stage in corpus_pipeline.STAGES[:-1]:
            now = shared.written(stage(spark, now, DIR), name)
            assert now.columns == docs.columns
        packed = corpus_pipeline.STAGES[-1][1](spark, now, DIR).toPandas()
        assert packed["doc_id"].nunique() == now.select("doc_id").where("doc_id is not null").distinct().count()
        assert not len(packed) or packed.groupby("sequence_id")["length"].sum().max() <= 2048
