"""Media columns: a Spark data source over archives of media members.

``media_archive`` writes rows (member, payload) as ZIP archives of lossless 8-bit grayscale PNG members, and reads them back. The
reader plans byte ranges over each archive; a task takes the directory of its archive and owns the members whose header begins in
its range, so that planning costs the driver one entry per archive, not per member. Members are read by their own offset, and each
is retried alone.
"""

from __future__ import annotations

import hashlib
import json
import struct
import time
import uuid
import zipfile
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from .shared import filesystem, new_folder

#: Samples in a row of an image; payloads are padded to a multiple of it with PAD, which no UTF-8 text contains.
ROW, PAD = 576, b"\xff"
ARCHIVE_BYTES, RANGE_BYTES, BATCH_BYTES = 256 << 20, 32 << 20, 8 << 20
PNG_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def padded(data: bytes) -> bytes:
    return data + PAD * (ROW - len(data) % ROW if len(data) % ROW or not data else 0)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_png(payload: bytes, level: int = 3) -> bytes:
    """An 8-bit grayscale PNG whose samples are the payload (a positive multiple of ROW bytes)."""
    lines = np.zeros((len(payload) // ROW, ROW + 1), np.uint8)
    lines[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    head = struct.pack(">IIBBBBB", ROW, len(lines), 8, 0, 0, 0, 0)
    return PNG_SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def decode_png(media: bytes) -> bytes:
    """The samples of a PNG that ``encode_png`` made; every chunk's checksum is verified."""
    if media[:8] != PNG_SIGNATURE:
        raise ValueError("not a PNG")
    at, size, data = 8, None, []
    while at < len(media):
        n = int.from_bytes(media[at : at + 4], "big")
        kind, body = media[at + 4 : at + 8], media[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != int.from_bytes(media[at + 8 + n : at + 12 + n], "big"):
            raise ValueError("damaged PNG chunk")
        if kind == b"IHDR":
            size = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    if size is None or size[2:4] != (8, 0):
        raise ValueError("not 8-bit grayscale")
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(size[1], size[0] + 1)
    if lines[:, 0].any():
        raise ValueError("filtered rows are not written by this source")
    return lines[:, 1:].tobytes()


def feature(samples: bytes) -> str:
    """Mean, deviation and a 64-bit average hash (64 equal runs against the mean) of the samples."""
    x = np.frombuffer(samples, np.uint8)
    total, square = int(x.sum(dtype=np.int64)), int((x.astype(np.int64) ** 2).sum())
    mean = total / len(x)
    runs = np.add.reduceat(x, np.arange(64) * len(x) // 64, dtype=np.int64)
    width = np.diff(np.append(np.arange(64) * len(x) // 64, len(x)))
    bits = np.packbits(runs * len(x) > total * width).tobytes().hex()
    return f"mean={mean:.4f};sd={max(square / len(x) - mean * mean, 0.0) ** 0.5:.4f};ahash={bits}"


class Written(WriterCommitMessage):
    def __init__(self, archives: list[dict]):
        self.archives = archives


class MediaArchiveWriter(DataSourceArrowWriter):
    """One task writes its rows to archives of up to ARCHIVE_BYTES under names no other attempt uses; only the committed ones enter the manifest."""

    def __init__(self, options: dict):
        self.path, self.level = options["path"], int(options.get("level", 3))

    def write(self, iterator) -> Written:
        files, root = filesystem(self.path)
        files.create_dir(root, recursive=True)
        done: list[dict] = []
        out = archive = name = None

        def close():
            nonlocal archive
            if archive is not None:
                n = len(archive.infolist())
                archive.close()
                out.close()
                done.append({"name": name, "members": n, "bytes": files.get_file_info(f"{root}/{name}").size})
                archive = None

        for batch in iterator:
            names, payloads = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for member, payload in zip(names, payloads, strict=True):
                if archive is None:
                    name = f"media-{uuid.uuid4().hex}.zip"
                    out = files.open_output_stream(f"{root}/{name}")
                    archive = zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True)
                info = zipfile.ZipInfo("" if member is None else member)
                archive.writestr(info, encode_png(padded(payload or b""), self.level))
                if archive.start_dir >= ARCHIVE_BYTES:
                    close()
        close()
        return Written(done)

    def commit(self, messages) -> None:
        files, root = filesystem(self.path)
        files.create_dir(root, recursive=True)
        with files.open_output_stream(f"{root}/_manifest-{uuid.uuid4().hex}.json") as f:
            f.write(json.dumps([a for m in messages if m for a in m.archives]).encode())

    def abort(self, messages) -> None:
        files, root = filesystem(self.path)
        for a in (a for m in messages if m for a in m.archives):
            files.delete_file(f"{root}/{a['name']}")


class ByteRange(InputPartition):
    def __init__(self, name: str, start: int, stop: int):
        self.name, self.start, self.stop = name, start, stop


class MediaArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.range = options["path"], int(options.get("range_bytes", RANGE_BYTES))
        self.retries, self.mode = int(options.get("retries", 3)), options.get("mode", "failfast")

    def partitions(self):
        from pyarrow.fs import FileSelector

        files, root = filesystem(self.path)
        parts = []
        for info in sorted(files.get_file_info(FileSelector(root, allow_not_found=True)), key=lambda x: x.path):
            if info.base_name.startswith("_manifest-"):
                with files.open_input_stream(info.path) as f:
                    for a in json.loads(f.read()):
                        parts += [ByteRange(a["name"], s, min(s + self.range, a["bytes"])) for s in range(0, a["bytes"], self.range)]
        return parts or [ByteRange("", 0, 0)]

    def member(self, files, path: str, info: zipfile.ZipInfo) -> bytes:
        """The stored bytes of one member, read by its offset; opened anew for each retry."""
        wait = 0.1
        for attempt in range(self.retries + 1):
            try:
                with files.open_input_file(path) as f:
                    f.seek(info.header_offset)
                    head = f.read(30)
                    return stored_bytes(head + f.read(_names(head) + info.compress_size), info)
            except (OSError, ValueError):
                if attempt == self.retries:
                    raise
                time.sleep(wait)
                wait *= 2
        raise AssertionError

    def read(self, partition: ByteRange):
        """The members of a range in large reads of neighbours; one that is not whole in these is read again by itself."""
        if not partition.name:
            return
        files, root = filesystem(self.path)
        path = f"{root}/{partition.name}"
        with files.open_input_file(path) as f, zipfile.ZipFile(f) as z:
            infos, end = sorted(z.infolist(), key=lambda i: i.header_offset), z.start_dir
        stops = [i.header_offset for i in infos[1:]] + [end]
        own = [(i, e) for i, e in zip(infos, stops, strict=True) if partition.start <= i.header_offset < partition.stop]
        while own:
            n = 1
            while n < len(own) and own[n][1] - own[0][0].header_offset <= BATCH_BYTES:
                n += 1
            yield self._run(files, path, partition.name, own[:n])
            own = own[n:]

    def _run(self, files, path: str, name: str, own: list[tuple]) -> pa.RecordBatch:
        first = own[0][0].header_offset
        try:
            with files.open_input_file(path) as f:
                f.seek(first)
                data = f.read(own[-1][1] - first)
        except OSError:
            data = b""
        rows = []
        for info, end in own:
            media = error = None
            try:
                media = stored_bytes(data[info.header_offset - first : end - first], info)
            except ValueError:
                try:
                    media = self.member(files, path, info)
                except (OSError, ValueError) as e:
                    if self.mode == "failfast":
                        raise
                    error = f"{type(e).__name__}: {e}"
            rows.append((info.filename or None, name, info.header_offset, media, error))
        return _batch(rows)


def _names(head: bytes) -> int:
    """Bytes of name and extra fields after a member's header."""
    return sum(struct.unpack("<HH", head[26:30])) if len(head) == 30 else 0


def stored_bytes(data: bytes, info: zipfile.ZipInfo) -> bytes:
    """What a member holds, from the bytes that begin with its header; an error if they are not it."""
    if data[:4] != b"PK\x03\x04" or len(data) < 30:
        raise ValueError("no member here")
    start = 30 + _names(data[:30])
    out = data[start : start + info.compress_size]
    if len(out) != info.compress_size or zlib.crc32(out) != info.CRC:
        raise ValueError("damaged member")
    return out


SCHEMA = "member string, archive string, offset long, media binary, error string"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["member", "archive", "offset", "media", "error"])


class MediaArchive(DataSource):
    """Options: path; level (PNG compression) to write; range_bytes, retries, mode (failfast or permissive: a member that stays
    unreadable gives a null media and its error) to read."""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> MediaArchiveReader:
        return MediaArchiveReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> MediaArchiveWriter:
        return MediaArchiveWriter(dict(self.options))


def write_media(rows: DataFrame, path: str, level: int = 3) -> None:
    """Stores rows (member string, payload binary) as archives under ``path``. A null member is stored without a name, a null payload as an empty one."""
    rows.sparkSession.dataSource.register(MediaArchive)
    rows.select(F.col("member").cast("string"), F.col("payload").cast("binary")).write.format("media_archive").mode("append").option("level", level).save(path)


def read_media(spark: SparkSession, path: str, **options) -> DataFrame:
    """Columns member, archive, offset, media, error: one row per member. A folder without archives gives no rows."""
    spark.dataSource.register(MediaArchive)
    return spark.read.format("media_archive").options(**options).load(path)


DIGESTS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def described(media: DataFrame) -> DataFrame:
    """Sizes, digests and features of stored members whose names are document ids (or absent, for null); null for a member that a permissive
    read could not get."""

    def run(batches):
        for b in batches:
            rows = []
            for member, stored in zip(b.column("member").to_pylist(), b.column("media").to_pylist(), strict=True):
                if stored is None:
                    rows.append((int(member) if member else None, *[None] * 7))
                    continue
                data = decode_png(stored)
                rows.append((int(member) if member else None, len(data.rstrip(PAD)), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(data)))
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [c.split()[0] for c in DIGESTS.split(", ")])

    return media.select("member", "media").mapInArrow(run, DIGESTS)


def stored_texts(docs: DataFrame) -> DataFrame:
    """Stores every text as a media member and describes what is read back; one row per row of ``docs``.

    Null and empty texts are stored as one row of padding, long ones as one tall image. Null ids come back null, repeated rows repeated. An
    empty table gives none; other columns are ignored.
    """
    spark, path = docs.sparkSession, new_folder(docs.sparkSession, "media")
    write_media(docs.select(F.col("doc_id").cast("string").alias("member"), F.encode(F.col("text").cast("string"), "UTF-8").alias("payload")), path)
    return described(read_media(spark, path))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_texts(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
