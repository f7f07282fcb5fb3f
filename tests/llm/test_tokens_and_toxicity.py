"""Token files and toxic passages: brute force, hard cases, time in proportion."""

import random
import time

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from ledgerloom.llm import bpe, shared, tokenfile, toxicity

DIR = "/root/testdata/sf0.001"


def test_token_files_are_reached_by_select(spark, tmp_path):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").limit(600)
    entries = tokenfile.write_token_files(docs, str(tmp_path), P.path(bpe.WORD_BPE), 2)
    f = tokenfile.TokenFile(f"{tmp_path}/{entries[0]['name']}")
    every = list(f.each())
    assert len(every) == entries[0]["documents"] == len(f.doc_ids())
    for i in range(0, len(every), 7):
        assert f.bounds.select(i) == every[i][1] and (f.ids(i) == every[i][2]).all()


def test_word_encoder_equals_library():
    rng = random.Random(5)
    letters = [chr(c) for c in range(1, 0x250)] + list("éÉßſİŉǅ'sStTreRE<|>abcABC0129 \u0085́ \t\n  '") * 20 + ["<|endoftext|>"]
    t, e = Tokenizer.from_file(P.path(bpe.WORD_BPE)), bpe.WordEncoder(P.path(bpe.WORD_BPE), "<u2", remembered=50)
    for _ in range(4000):
        x = "".join(rng.choices(letters, k=rng.randrange(25)))
        assert np.frombuffer(b"".join(e.encode(x.encode())), "<u2").tolist() == t.encode(x, add_special_tokens=False).ids, x


def test_segments_equal_a_recursive_search():
    def best(x, lo, hi):
        """The maximal segments of x[lo:hi]: the best one, and those on either side of it."""
        found = max(((sum(x[i:j]), i, j) for i in range(lo, hi) for j in range(i + 1, hi + 1)), default=(0, 0, 0))
        if found[0] <= 0:
            return []
        s, i, j = found
        return [*best(x, lo, i), (i, j), *best(x, j, hi)]

    rng = random.Random(16)
    for _ in range(60):
        x = [rng.choice([-5, -3, -2, 1, 2, 4]) + rng.random() / 100 for _ in range(24)]
        assert [(a, b) for a, b, _ in toxicity.segments(x)] == best(x, 0, len(x))


def test_segments_take_time_in_proportion():
    def took(n):
        x = ([3.0] + [toxicity.DRIFT] * 30) * n
        began = time.process_time()
        assert len(toxicity.segments(x)) == n
        return time.process_time() - began

    took(1000)
    assert took(40_000) < 12 * took(10_000) + 0.2


def test_toxicity_hard_cases(spark):
    schema = "doc_id long, text string, score double"
    docs = spark.createDataFrame([(1, "a vilefool " * 20000, 3.0), (1, "a vilefool " * 20000, 3.0), (2, None, None), (None, "", 1.0), (4, "ties ties", 0.0)], schema)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    for labels in (none, spark.createDataFrame([(1, 0), (4, 0)], none.schema), spark.createDataFrame([(9, 1), (8, 0)], none.schema)):
        model = toxicity.fit(docs, labels)
        out = toxicity.scored(docs, model).collect()
        assert len(out) == 5 and all(r.predicted == 0 for r in out) and len({r.score for r in out if r.doc_id == 1}) == 1
        kept = toxicity.drop_toxic(docs, model)
        assert kept.count() == 5 and kept.columns == docs.columns
    empty = spark.createDataFrame([], schema)
    model = toxicity.fit(empty, spark.createDataFrame([(1, 1)], none.schema))
    assert toxicity.scored(empty, model).count() == 0 and toxicity.drop_toxic(empty, model).count() == 0


def test_all_passages_of_a_long_text_count():
    clean = [b"tree house river stone cloud green " * 8 + b"%d" % i for i in range(30)]
    toxic = [b"tree house " * 5 + b"vilefool grubworm " + b"river stone %d" % i for i in range(30)]
    model = toxicity.Model([*clean, *toxic], [0] * 30 + [1] * 30)
    text = (b"vilefool grubworm " * 3 + b"tree house river stone cloud green " * 20) * 200
    assert model.judged(text)[1] == len(model.passages(text)) == 200


def test_shared_folder_is_needed_off_local_masters(spark):
    class Context:
        master = "spark://somewhere:7077"
        applicationId = "a"

        def getConf(self):
            return {}

    class Session:
        sparkContext, conf = Context(), spark.conf

    if not spark.sparkContext.getConf().get("spark.checkpoint.dir"):
        with pytest.raises(ValueError):
            shared.shared_dir(Session())
