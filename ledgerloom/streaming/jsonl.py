"""A data source over growing JSONL files: every complete line once, with the bytes that it covers.

``spark.read.format("jsonl_tail")`` reads files by byte ranges on the executors; ``spark.readStream`` tails them. The offset of a stream is,
for every file, how far it has been read, which file that was (device and inode), a hash of the bytes before that place, and a generation. A
file that shrank, was replaced, or whose bytes before the place have changed is read from its beginning as a new generation. A line without
its end stays unread. The stream's reader works on the driver, as offsets ask for, and takes a page of each file at a time.
"""

from __future__ import annotations

import base64
import hashlib
import json
import os
from dataclasses import asdict, dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

SCHEMA = "path string, generation int, byte_start long, byte_end long, mtime_ms long, line string, fragment_index int, fragment_count int, fragment string, sha256 string"
#: Bytes of a page, of the fragments of a record that is longer, and of the boundary that proves where a file was left.
PAGE_BYTES, FRAGMENT_BYTES, BOUNDARY_BYTES = 4 << 20, 512 << 10, 4 << 10


def find_files(prefix: str) -> list[str]:
    """All ``.jsonl`` files under a folder (or the file itself), in order; folders that are links are not followed."""
    if os.path.isfile(prefix):
        return [prefix]
    out = [os.path.join(folder, f) for folder, _, files in os.walk(prefix) for f in files if f.endswith(".jsonl")]
    return sorted(out)


@dataclass
class Place:
    """How far a file has been read."""

    offset: int = 0
    identity: str = ""
    boundary: str = ""
    generation: int = 0


def boundary(f, offset: int) -> str:
    """The hash of the bytes right before an offset."""
    start = max(0, offset - BOUNDARY_BYTES)
    f.seek(start)
    return hashlib.sha256(f.read(offset - start)).hexdigest()


def identity(stat: os.stat_result) -> str:
    return f"{stat.st_dev}:{stat.st_ino}"


def discontinuity(f, stat: os.stat_result, place: Place) -> str | None:
    """Why a file does not continue what was read of it: truncated, replaced or rewritten; else null."""
    if not place.identity:
        return None
    if identity(stat) != place.identity:
        return "replaced"
    if stat.st_size < place.offset:
        return "truncated"
    return "rewritten" if boundary(f, place.offset) != place.boundary else None


def line_rows(path: str, generation: int, mtime_ms: int, start: int, data: bytes) -> list[tuple]:
    """A row for each line of ``data`` (whole lines from byte ``start`` on), of a record longer than a page a row for each fragment."""
    out = []
    for text in data.split(b"\n")[:-1]:
        raw = text + b"\n"
        end = start + len(raw)
        if len(raw) <= PAGE_BYTES:
            out.append((path, generation, start, end, mtime_ms, raw[:-1].decode(errors="replace"), None, None, None, None))
        else:
            n = -(-len(raw) // FRAGMENT_BYTES)
            for k in range(n):
                part = raw[k * FRAGMENT_BYTES : (k + 1) * FRAGMENT_BYTES]
                at = start + k * FRAGMENT_BYTES
                out.append((path, generation, at, at + len(part), mtime_ms, None, k, n, base64.b64encode(part).decode(), hashlib.sha256(part).hexdigest()))
        start = end
    return out


def whole_lines(f, start: int, size: int) -> bytes:
    """The complete lines from ``start`` on: those that end within a page, or else the first one, however long it is."""
    f.seek(start)
    data = f.read(min(PAGE_BYTES, size - start))
    end = data.rfind(b"\n") + 1
    while not end and start + len(data) < size:
        more = f.read(min(PAGE_BYTES, size - start - len(data)))
        if not more:
            break
        end = more.find(b"\n") + 1
        end = len(data) + end if end else 0
        data += more
    return data[:end]


class JsonlStreamReader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict):
        self.prefix = options["path"]

    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def read(self, start: dict) -> tuple:
        places = {p: Place(**v) for p, v in json.loads(start["files"]).items()}
        rows = []
        for path in find_files(self.prefix):
            try:
                rows += self._page(path, places)
            except FileNotFoundError:
                continue
        return iter(rows), {"files": json.dumps({p: asdict(v) for p, v in sorted(places.items())})}

    def _page(self, path: str, places: dict[str, Place]) -> list[tuple]:
        place = places.get(path, Place())
        with open(path, "rb") as f:
            stat = os.fstat(f.fileno())
            if discontinuity(f, stat, place):
                place = Place(generation=place.generation + 1)
            data = whole_lines(f, place.offset, stat.st_size)
            rows = line_rows(path, place.generation, stat.st_mtime_ns // 1_000_000, place.offset, data)
            end = place.offset + len(data)
            places[path] = Place(end, identity(stat), boundary(f, end), place.generation)
        return rows

    def readBetweenOffsets(self, start: dict, end: dict):
        """What was read between two offsets, for a batch that is done again; a file that has changed since is left to the next batch."""
        before, after = ({p: Place(**v) for p, v in json.loads(o["files"]).items()} for o in (start, end))
        for path, to in sorted(after.items()):
            at = before.get(path, Place())
            first = at.offset if at.generation == to.generation else 0
            try:
                with open(path, "rb") as f:
                    stat = os.fstat(f.fileno())
                    if to.offset <= first or discontinuity(f, stat, to):
                        continue
                    f.seek(first)
                    yield from line_rows(path, to.generation, stat.st_mtime_ns // 1_000_000, first, f.read(to.offset - first))
            except FileNotFoundError:
                continue

    def commit(self, end: dict) -> None:
        pass


class ByteRange(InputPartition):
    def __init__(self, path: str, start: int, stop: int):
        self.path, self.start, self.stop = path, start, stop


class JsonlBatchReader(DataSourceReader):
    """Byte ranges of a page each, of files that all executors see; a line belongs to the range that its first byte is in."""

    def __init__(self, options: dict):
        self.prefix = options["path"]

    def partitions(self):
        out = [ByteRange(p, s, s + PAGE_BYTES) for p in find_files(self.prefix) for s in range(0, max(1, os.path.getsize(p)), PAGE_BYTES)]
        return out or [ByteRange("", 0, 0)]

    def read(self, part: ByteRange):
        if not part.path:
            return
        with open(part.path, "rb") as f:
            stat = os.fstat(f.fileno())
            at = part.start
            if at:
                f.seek(at - 1)
                at += len(f.readline()) - 1
            while at < min(part.stop, stat.st_size):
                data = whole_lines(f, at, stat.st_size)
                if not data:
                    return
                if at + len(data) > part.stop:
                    # The last line that begins in the range is the range's.
                    inside = data.rfind(b"\n", 0, part.stop - at)
                    data = data[: data.find(b"\n", max(part.stop - at - 1, 0)) + 1] if inside != part.stop - at - 1 else data[: inside + 1]
                yield from line_rows(part.path, 0, stat.st_mtime_ns // 1_000_000, at, data)
                at += len(data)


class JsonlTail(DataSource):
    """Option: path, a folder or a file."""

    @classmethod
    def name(cls) -> str:
        return "jsonl_tail"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> JsonlBatchReader:
        return JsonlBatchReader(dict(self.options))

    def simpleStreamReader(self, schema) -> JsonlStreamReader:
        return JsonlStreamReader(dict(self.options))


def read_lines(spark: SparkSession, path: str):
    spark.dataSource.register(JsonlTail)
    return spark.read.format("jsonl_tail").load(path)


def tail_lines(spark: SparkSession, path: str):
    spark.dataSource.register(JsonlTail)
    return spark.readStream.format("jsonl_tail").load(path)


def lag_bytes(files: dict[str, int]) -> int:
    """The most bytes that any file holds beyond where it has been read (offsets by path)."""
    left = [os.path.getsize(p) - at for p, at in files.items() if os.path.exists(p)]
    return max([0, *left])
