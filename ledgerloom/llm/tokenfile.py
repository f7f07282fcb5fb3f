"""Token-id files: one id array, and Elias-Fano encoded document boundaries with select."""

from __future__ import annotations

import json
import struct
import uuid
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import WORD_BPE, id_encoder
from .shared import byte_values, filesystem, new_folder, shuffle_width

MAGIC = b"EFIDS1\n"
#: One select sample for so many values; bytes of ids read at once.
SAMPLE, READ_BYTES = 256, 8 << 20


class EliasFano:
    """A non-decreasing sequence of n values below u + 1 in about n * (2 + log2(u / n)) bits, with ``select``.

    The upper parts of the values are the ones of a bit string in unary, the lower parts an array of ``l`` bits each. The select structure
    is stored with them: the place of every SAMPLE-th one, in 32 bits. Nothing else is built when a sequence is opened.
    """

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes, samples: bytes):
        self.n, self.l = n, low_bits
        self.low, self.high, self.samples = np.frombuffer(low, np.uint8), np.frombuffer(high, np.uint8), np.frombuffer(samples, "<u4")

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, np.uint64)
        n, top = len(v), int(v[-1]) if len(v) else 0
        l = max(0, (top // n).bit_length() - 1) if n else 0
        bits = ((v[:, None] >> np.arange(l, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8) if l else np.zeros((n, 0), np.uint8)
        high, ones = np.zeros((top >> l) + n + 1, np.uint8), (v >> np.uint64(l)).astype(np.int64) + np.arange(n)
        if len(high) >> 32:
            raise ValueError("too many values for one sequence")
        high[ones] = 1
        return cls(n, l, np.packbits(bits.ravel(), bitorder="little").tobytes(), np.packbits(high, bitorder="little").tobytes(), ones[::SAMPLE].astype("<u4").tobytes())

    def _low(self, i: int, j: int) -> np.ndarray:
        first = i * self.l
        bits = np.unpackbits(self.low[first >> 3 : (j * self.l + 7) >> 3], bitorder="little")[first & 7 :][: (j - i) * self.l]
        return (bits.reshape(j - i, self.l).astype(np.int64) << np.arange(self.l)).sum(1) if self.l else np.zeros(j - i, np.int64)

    def select(self, i: int) -> int:
        """The i-th value, from the sample before it, a scan of a few bytes and its low bits."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        bit = int(self.samples[i // SAMPLE])
        at, left = bit >> 3, i % SAMPLE
        b = int(self.high[at]) >> (bit & 7) << (bit & 7)
        while (c := b.bit_count()) <= left:
            at, left = at + 1, left - c
            b = int(self.high[at])
        for _ in range(left):
            b &= b - 1
        return (at * 8 + ((b & -b).bit_length() - 1) - i) << self.l | int(self._low(i, i + 1)[0])

    def __len__(self) -> int:
        return self.n

    def slice(self, i: int, j: int) -> np.ndarray:
        """Values i to j - 1, from the samples around them."""
        if i >= j:
            return np.zeros(0, np.int64)
        k, last = i // SAMPLE, -(-j // SAMPLE)
        start = int(self.samples[k])
        stop = int(self.samples[last]) if last < len(self.samples) else len(self.high) * 8
        bits = np.unpackbits(self.high[start >> 3 : (stop + 7) >> 3], bitorder="little")
        bits[: start & 7] = 0
        ones = np.nonzero(bits)[0][i - k * SAMPLE :][: j - i] + (start >> 3 << 3)
        return (ones - np.arange(i, j)) << self.l | self._low(i, j)

    def to_bytes(self) -> bytes:
        parts = [x.tobytes() for x in (self.low, self.high, self.samples)]
        return struct.pack("<QBQQQ", self.n, self.l, *map(len, parts)) + b"".join(parts)

    @classmethod
    def from_bytes(cls, data: bytes) -> EliasFano:
        n, l, *sizes = struct.unpack_from("<QBQQQ", data)
        cuts = np.cumsum([struct.calcsize("<QBQQQ"), *sizes]).tolist()
        return cls(n, l, *[data[x:y] for x, y in zip(cuts, cuts[1:], strict=False)])


class TokenFile:
    """One file: MAGIC, ids, Elias-Fano boundaries (n + 1 of them), deflated document ids, a JSON footer, its length."""

    def __init__(self, path: str):
        self.files, self.path = filesystem(path)
        with self.files.open_input_file(self.path) as f:
            size = f.size()
            f.seek(size - 4)
            (n,) = struct.unpack("<I", f.read(4))
            f.seek(size - 4 - n)
            self.footer = json.loads(f.read(n))
            f.seek(self.footer["bounds_at"])
            self.bounds = EliasFano.from_bytes(f.read(self.footer["docs_at"] - self.footer["bounds_at"]))
            self.docs = f.read(size - 4 - n - self.footer["docs_at"])
        self.dtype = np.dtype(self.footer["dtype"])

    def doc_ids(self) -> list[int | None]:
        return [None] * self.footer["nulls"] + np.frombuffer(zlib.decompress(self.docs), "<i8").tolist()

    def ids(self, i: int) -> np.ndarray:
        """The ids of the i-th document, by select."""
        a, b = self.bounds.select(i), self.bounds.select(i + 1)
        with self.files.open_input_file(self.path) as f:
            f.seek(len(MAGIC) + a * self.dtype.itemsize)
            return np.frombuffer(f.read((b - a) * self.dtype.itemsize), self.dtype)

    def each(self):
        """(doc_id, first position, ids) of all documents in order. Bounds are selected for SAMPLE documents at a time; ids are read in runs of bounded size."""
        docs, w = self.doc_ids(), self.dtype.itemsize
        with self.files.open_input_file(self.path) as f:
            for first in range(0, len(docs), SAMPLE):
                bounds = self.bounds.slice(first, min(first + SAMPLE, len(docs)) + 1)
                i = 0
                while i + 1 < len(bounds):
                    j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + READ_BYTES // w, side="right")) - 1)
                    f.seek(len(MAGIC) + int(bounds[i]) * w)
                    run = np.frombuffer(f.read(int(bounds[j] - bounds[i]) * w), self.dtype)
                    for k in range(i, j):
                        yield docs[first + k], int(bounds[k]), run[bounds[k] - bounds[i] : bounds[k + 1] - bounds[i]]
                    i = j


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int, dtype: str = "<u2") -> list[dict]:
    """Encodes whole texts and writes one file per range of doc_id, in ascending order (null first); the files in order.

    Rows of one doc_id are ordered by their text's hash. Null texts are empty: their only id is ``end_id``. The list has one entry per
    partition. Each attempt writes under a name of its own, and only what a finished task reports is used.
    """

    def run(batches):
        from pyspark import TaskContext

        files, root = filesystem(folder)
        files.create_dir(root, recursive=True)
        encoder, end, name = id_encoder(tokenizer_path, dtype), np.array([end_id], dtype).tobytes(), f"ids-{uuid.uuid4().hex}.efi"
        width, total, bounds, ids, nulls = np.dtype(dtype).itemsize, 0, [0], [], 0
        with files.open_output_stream(f"{root}/{name}") as f:
            f.write(MAGIC)
            for b in batches:
                doc_ids = b.column("doc_id")
                nulls += doc_ids.null_count
                ids.append(np.array(doc_ids.drop_null().to_numpy(zero_copy_only=False), np.int64))
                for chunks in encoder.encode_all(byte_values(b.column("text"))):
                    data = b"".join([*chunks, end])
                    f.write(data)
                    total += len(data) // width
                    bounds.append(total)
            ef = EliasFano.encode(np.array(bounds)).to_bytes()
            docs_at = len(MAGIC) + total * width + len(ef)
            footer = json.dumps({"dtype": dtype, "documents": len(bounds) - 1, "tokens": total, "nulls": nulls, "bounds_at": len(MAGIC) + total * width, "docs_at": docs_at}).encode()
            f.write(ef + zlib.compress(np.concatenate([*ids, np.zeros(0, np.int64)]).astype("<i8").tobytes()) + footer + struct.pack("<I", len(footer)))
        yield pa.RecordBatch.from_pydict({"part": [TaskContext.get().partitionId()], "name": [name], "documents": [len(bounds) - 1], "tokens": [total]})

    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64(F.col("text").cast("string")).alias("h"))
    rows = rows.repartitionByRange(shuffle_width(spark), F.col("doc_id").asc_nulls_first(), "h").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "h")
    out = rows.select("doc_id", "text").mapInArrow(run, "part long, name string, documents long, tokens long").collect()
    return [r.asDict() for r in sorted(out, key=lambda r: r.part) if r.documents]


def read_token_files(spark: SparkSession, folder: str, manifest: list[dict]) -> DataFrame:
    """Columns doc_id, start, n_tokens, ids_crc32 of every document, one task per file."""
    base, starts = 0, []
    for m in manifest:
        starts.append((m["name"], base))
        base += m["tokens"]

    def run(batches):
        for b in batches:
            for k in b.column("id").to_pylist():
                name, first = starts[k]
                doc, start, n, crc = [], [], [], []
                for d, at, ids in TokenFile(f"{folder}/{name}").each():
                    doc.append(d)
                    start.append(first + at)
                    n.append(len(ids))
                    crc.append(zlib.crc32(ids.astype("<u4").tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (doc, start, n, crc)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return spark.range(0, len(starts), 1, max(1, len(starts))).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_ids(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """Writes the token files of ``docs`` to the shared folder and reads them back. An empty table gives no rows."""
    folder = new_folder(docs.sparkSession, "tokens")
    return read_token_files(docs.sparkSession, folder, write_token_files(docs, folder, tokenizer_path, end_id))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_ids(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path(WORD_BPE), 2)
