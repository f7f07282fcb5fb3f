"""BPE encoding and decoding with the public tokenizer files.

A text is cut where no token can cross: before a single space between non-space characters (byte-level files) or at ASCII white
space (word files). Chunks are encoded by the tokenizers library, or from the rank file of the same vocabulary, and remembered, within a bound. A long chunk without such a place
is encoded as a tree: its leaves at once on several threads, then pairs of neighbours are joined by encoding anew a growing window
around the join until its first and last tokens agree with both sides. BPE is determined by its adjacent pairs, so agreement on one
token at either end makes the joined ids exact.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
import struct
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import lru_cache

import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .shared import byte_values

BYTE_BPE, WORD_BPE = "byte_bpe_50k.json", "word_bpe_49k.json"
#: Chunks remembered by one encoder; characters from which a chunk is encoded as a tree, and in a leaf of it.
REMEMBERED, LONG, LEAF = 1 << 20, 8192, 2048
_OTHER_SPACE = re.compile(r"[^\S \n]")
_SAFE_CUT = re.compile(r"(?<=\S)(?= \S)")


@lru_cache(maxsize=4)
def tokenizer(path: str) -> Tokenizer:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


@lru_cache(maxsize=4)
def ranks(path: str):
    """The tiktoken encoding of the rank file beside a byte-level file, if there is one: the same vocabulary and merges, encoded faster."""
    beside = path.removesuffix(".json") + ".tiktoken"
    if not os.path.exists(beside):
        return None
    with open(beside, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level files: itself if printable in Latin-1, else from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class TreeEncoder:
    """Encodes one long chunk of a byte-level file."""

    def __init__(self, path: str, leaf: int = LEAF, threads: int = 4):
        self.t, self.leaf, self.threads = tokenizer(path), leaf, threads
        self.bytes = byte_alphabet()
        added = sorted((a.content for a in self.t.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.added = re.compile("(" + "|".join(map(re.escape, added)) + ")") if added else None
        self.pieces = regex.compile(public_tokenizers.PATTERN)

    def plain(self, mapped: str) -> list[int]:
        return [x.id for x in self.t.model.tokenize(mapped)]

    def spelled(self, ids: list[int]) -> str:
        return "".join(map(self.t.id_to_token, ids))

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The ids of the concatenated strings of two encodings."""
        if not left or not right:
            return left + right
        k = 4
        while True:
            i, j = min(k, len(left)), min(k, len(right))
            window = self.plain(self.spelled(left[len(left) - i :]) + self.spelled(right[:j]))
            if (i == len(left) or window[0] == left[len(left) - i]) and (j == len(right) or window[-1] == right[j - 1]):
                return left[: len(left) - i] + window + right[j:]
            k *= 2

    def piece(self, mapped: str) -> list[int]:
        """A piece that the pattern doesn't split: halves down to the leaves, these at once, and joins level by level."""
        if len(mapped) <= self.leaf:
            return self.plain(mapped)
        n = 1
        while n * self.leaf < len(mapped):
            n *= 2
        cut = [len(mapped) * i // n for i in range(n + 1)]
        with ThreadPoolExecutor(self.threads) as pool:
            level = list(pool.map(lambda i: self.plain(mapped[cut[i] : cut[i + 1]]), range(n)))
            while len(level) > 1:
                level = list(pool.map(lambda i: self.join(level[i], level[i + 1]), range(0, len(level), 2)))  # noqa: B023
        return level[0]

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for k, part in enumerate(self.added.split(text) if self.added else [text]):
            if k % 2:
                out.append(self.t.token_to_id(part))
                continue
            for piece in self.pieces.findall(part):
                out += self.piece("".join(map(self.bytes.__getitem__, piece.encode())))
        return out


class Memory(dict):
    """What chunks gave, for the newest ``size`` chunks at least that were new or used: two generations, of which the older is dropped."""

    def __init__(self, size: int):
        super().__init__()
        self.size, self.old = size // 2, {}

    def __missing__(self, chunk):
        self[chunk] = value = self.old[chunk]
        return value

    def missing(self, chunks) -> list:
        return [c for c in chunks if c not in self and c not in self.old]

    def grow(self, values: dict) -> None:
        if len(self) + len(values) > self.size:
            self.old = dict(self)
            self.clear()
        self.update(values)


class Encoder:
    """Encodes whole texts; ``value`` turns the ids of a chunk into what is remembered and given back for it, ``add`` joins two of them."""

    def __init__(self, path: str, value: Callable[[list[int]], object], add: Callable = lambda a, b: a + b, long: int = LONG, remembered: int = REMEMBERED):
        self.t, self.value, self.add, self.long = tokenizer(path), value, add, long
        self.byte_level = self.t.normalizer is None
        self.tree = TreeEncoder(path) if self.byte_level else None
        self.known, self.spaced = Memory(remembered // 4 if self.byte_level else remembered), Memory(remembered)
        self.ranks = ranks(path) if self.byte_level else None

    def encoded(self, texts: list):
        """Ids of short texts: by the rank file of the same vocabulary where there is one, but for what may hold a special token."""
        if self.ranks is None:
            return [e.ids for e in self.t.encode_batch_fast(texts, add_special_tokens=False)]
        one = self.ranks.encode_ordinary
        return [one(t) if "<|" not in t else self.t.encode(t, add_special_tokens=False).ids for t in texts]

    def learn(self, known: Memory, chunks: list, lead: str = "") -> dict:
        """Remembers the values of chunks (with ``lead`` before each). A comma or full stop after a letter at the end of a chunk is always a
        piece of its own, as a chunk is followed by white space or the end; so the rest of the chunk may be known already."""
        stems = [c[:-1] if len(c) > 1 and c[-1:] in self.marks and c[-2:-1].isalpha() and c[-2:-1].isascii() else c for c in chunks]
        fresh = known.missing(dict.fromkeys(stems))
        short = [c for c in fresh if len(c) <= self.long or not self.byte_level]
        got: dict = {}
        for at in range(0, len(short), 20_000):
            part = short[at : at + 20_000]
            for c, ids in zip(part, self.encoded([lead + c for c in part] if self.byte_level else [c.decode() for c in part]), strict=True):
                got[c] = self.value(ids)
        for c in fresh:
            if c not in got:
                got[c] = self.value(self.tree.encode(lead + c))
        if self.mark is None:
            self.mark = dict(zip(self.marks, map(self.value, self.encoded([",", "."])), strict=True))
        for c, stem in zip(chunks, stems, strict=True):
            if c is not stem:
                got[c] = self.add(got[stem] if stem in got else known[stem], self.mark[c[-1:]])
        known.grow(got)
        return got

    mark = None

    @property
    def marks(self) -> tuple:
        return (",", ".") if self.byte_level else (b",", b".")

    def chunks(self, text: bytes) -> tuple[list, list]:
        """Chunks without and, after them, with a space before them (which is left out)."""
        if not self.byte_level:
            # Lower case is part of these files' normalization; only special tokens are found before it.
            return (text if b"<|" in text else text.lower()).split(), []
        if not text:
            return [], []
        s = text.decode()
        if s[0] == " " or s[-1] == " " or "  " in s or " \n" in s or "\n " in s or _OTHER_SPACE.search(s):
            return _SAFE_CUT.split(s), []
        first, *rest = s.split(" ")
        return [first], rest

    def encode(self, text: bytes) -> list:
        """The values of the chunks of a text (UTF-8), in order; none for an empty text."""
        return next(self.encode_all([text]))

    def encode_all(self, texts: list[bytes], group: int = 1 << 20):
        """``encode`` of each text in turn; new chunks of about ``group`` bytes of texts are encoded together."""
        held, n = [], 0
        for i, text in enumerate(texts):
            held.append(self.chunks(text))
            n += len(text)
            if n > group or i + 1 == len(texts):
                for k, (known, lead) in enumerate(((self.known, ""), (self.spaced, " "))):
                    new = set()
                    for c in held:
                        new.update(c[k])
                    if new := known.missing(new):
                        self.learn(known, new, lead)
                for own, rest in held:
                    yield self.look_up(self.known, own, "") + self.look_up(self.spaced, rest, " ")
                held, n = [], 0

    def look_up(self, known: Memory, chunks: list, lead: str) -> list:
        try:
            return list(map(known.__getitem__, chunks))
        except KeyError:  # dropped meanwhile
            have = {c: known[c] for c in dict.fromkeys(chunks) if c in known or c in known.old}
            have |= self.learn(known, [c for c in dict.fromkeys(chunks) if c not in have], lead)
            return [have[c] for c in chunks]


@lru_cache(maxsize=4)
def _digest_encoder(path: str) -> Encoder:
    t = tokenizer(path)
    back = {c: b for b, c in byte_alphabet().items()}
    special = {i: a.content.encode() for i, a in t.get_added_tokens_decoder().items()}

    @lru_cache(maxsize=None)
    def spelled(i: int) -> bytes:
        return special[i] if i in special else bytes(back[c] for c in t.id_to_token(i))

    return Encoder(path, lambda ids: (",".join(map(str, ids)).encode(), len(ids), b"".join(map(spelled, ids))), lambda a, b: (a[0] + b"," + b[0], a[1] + b[1], a[2] + b[2]), remembered=1 << 19)


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """Columns doc_id, n_tokens, ids_sha256, decoded_sha256: one row per row of ``docs``, from whole texts.

    Null and empty texts have no tokens. Ids may be null or repeat; an empty table gives none; other columns are ignored.
    """
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]

    def run(batches):
        encoder = _digest_encoder(path)
        for b in batches:
            n, ids, decoded = [], [], []
            for chunks in encoder.encode_all(byte_values(b.column("text"))):
                n.append(sum(c[1] for c in chunks))
                ids.append(hashlib.sha256(b",".join([c[0] for c in chunks])).hexdigest())
                decoded.append(hashlib.sha256(b"".join([c[2] for c in chunks]).decode(errors="replace").encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


#: Letters that lower-case and compose alone: ASCII, and U+00C0 to U+017F but for the signs of multiplication and division and U+0130.
_PLAIN = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f"
#: Words of such letters, ASCII digits and ASCII marks; and, as a fixed value, the pieces that the pattern of word files finds in them.
_PLAIN_WORD = re.compile(f"[\x21-\x7e{_PLAIN}]+")
_PLAIN_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_PLAIN}]+|[0-9]|[^0-9{_PLAIN}]+")


class WordEncoder:
    """Encodes whole texts with a word file. Every word is remembered; a new one is cut into its pieces, and these go to the merges at
    once, without the library's normalization, where that is sure to change nothing but the case."""

    def __init__(self, path: str, dtype: str, remembered: int = REMEMBERED):
        self.t, self.kind = tokenizer(path), {"<u2": "H", "<u4": "I"}[dtype]
        table = byte_alphabet()
        self.table = {b: c for b, c in table.items() if chr(b) != c}
        self.pieces: dict[str, bytes] = {}
        self.words = _Words(self.word, remembered)

    def packed(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{self.kind}", *ids)

    def piece(self, piece: str) -> bytes:
        if not piece.isascii():
            piece = piece.encode().decode("latin-1").translate(self.table)
        return self.packed([x.id for x in self.t.model.tokenize(piece)])

    def word(self, word: bytes) -> bytes:
        """The ids of what stands between white space (lower case but for what may hold a special token)."""
        s = word.decode()
        if b"<|" in word or not _PLAIN_WORD.fullmatch(s):
            return self.packed(self.t.encode(s, add_special_tokens=False).ids)
        s = s.lower()
        if s.isalpha():
            return self.piece(s)
        out = []
        for p in _PLAIN_PIECES.findall(s):
            if p[0].isalpha():
                out.append(self.piece(p))
                continue
            ids = self.pieces.get(p)
            if ids is None:
                ids = self.piece(p)
                if len(self.pieces) < 1 << 16:
                    self.pieces[p] = ids
            out.append(ids)
        return b"".join(out)

    def encode(self, text: bytes) -> list[bytes]:
        """The ids of each word of a text, as bytes."""
        return list(map(self.words.__getitem__, (text if b"<|" in text else text.lower()).split()))

    def encode_all(self, texts: list[bytes]):
        return map(self.encode, texts)


class _Words(dict):
    """What ``make`` gives for words: for the newest ``size`` at least that were new or used, in two generations, of which the older is dropped."""

    def __init__(self, make: Callable[[bytes], bytes], size: int):
        super().__init__()
        self.make, self.size, self.old = make, max(1, size // 2), {}

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        value = self.old.get(word)
        self[word] = value = self.make(word) if value is None else value
        return value


@lru_cache(maxsize=4)
def id_encoder(path: str, dtype: str) -> Encoder | WordEncoder:
    """An encoder that gives the ids of the chunks of a text as little-endian bytes."""
    kind = {"<u2": "H", "<u4": "I"}[dtype]
    if tokenizer(path).normalizer is not None:
        return WordEncoder(path, dtype)
    return Encoder(path, lambda ids: struct.pack(f"<{len(ids)}{kind}", *ids))


def evenly_spaced(text: str, long: int = LONG) -> bool:
    """Whether no run of ``long`` characters is all white space or without a space: each half window has both."""
    half = long // 2
    return len(text) <= half or all(text.find(" ", i, i + half) >= 0 and not text[i : i + half].isspace() for i in range(0, len(text) - half + 1, half))


@lru_cache(maxsize=4)
def text_encoder(path: str) -> Callable[[bytes], bytes]:
    """From a whole text to its ids, as little-endian unsigned 32-bit integers: at once from the rank file where there is one, and through
    chunks and trees for texts with long runs or what may be a special token."""
    chunked = id_encoder(path, "<u4")

    def ids(text: bytes) -> bytes:
        if chunked.ranks is not None and b"<|" not in text and evenly_spaced(t := text.decode()):
            return chunked.ranks.encode_to_numpy(t, disallowed_special=()).astype("<u4", copy=False).tobytes()
        return b"".join(chunked.encode(text))

    return ids


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path(BYTE_BPE))
