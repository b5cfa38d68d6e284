"""Token-ID files: a static range asymmetric numeral system over shared frequency tables.

Texts are tokenized in ascending doc_id order, with an end id after each, and cut into blocks of whole documents (about BLOCK_IDS ids). One frequency table, of all ids of
the corpus, normalised to 2^SCALE, codes every block: LANES coders take turns over the block's ids, each a 64-bit state that spills 32-bit words into one stream. A
block's header keeps the first state of every lane; every CHECKPOINT steps the states and the place in the stream are kept too, so that parts of a block can be decoded in
parallel; a CRC-32 of the ids and one of the frequency table guard the result.

Layout of a block (little-endian): magic "RLT1", number of ids u32, CRC of ids u32, CRC of the table u32, lanes u16, checkpoints u16, words u32, documents u32; then per document its ids u32; the lanes' states u64; per
checkpoint step u32, word u32 and the states; then the words u32.

The order comes from bounds on doc_id (approximate quantiles, for parts of PART_BYTES, beyond MANY_PARTS of them of up to MOST_PART_BYTES) and a sort inside each part; texts are compressed before that
shuffle. A part's bound and total are the only things that the driver sees of it.

Tokens are found for the distinct pieces of the tokenizer's own splitting rule, kept in a cache of bounded size in each worker; a text with a special token's string is
encoded whole. The tokenizers library does all encoding.

Defined results: a null or empty text is its end id alone. A null doc_id comes first. Rows that repeat a doc_id stand next to each other, ordered by a hash of the text. An empty table gives no
blocks and no rows. A long text is one document of one block, however long. Only doc_id and text are read.
"""

from __future__ import annotations

import gc
import json
import re
import struct
import sys
import zlib
from array import array

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table, total, written

SCALE, LANES, CHECKPOINT, BLOCK_IDS, END_ID = 20, 512, 256, 1 << 18, 2
LOW, CACHED, LONGEST = np.uint64(1 << 31), 700_000, 200
PART_BYTES, MANY_PARTS, MOST_PART_BYTES = 8 << 20, 4096, 256 << 20
HEAD = struct.Struct("<4sIIIHHII")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


#: The characters that stand for bytes in byte-level vocabularies; bytes that print stand for themselves, the others for 256 and up.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_OTHERS = sorted(set(range(256)) - set(_PRINTED))
LETTERS = [chr(256 + _OTHERS.index(c)) if c in _OTHERS else chr(c) for c in range(256)]


def letters(piece: str) -> str:
    """A piece with each of its bytes as the character that stands for it."""
    if piece.isascii() and piece.isprintable():
        return piece.replace(" ", LETTERS[32])
    return "".join(map(LETTERS.__getitem__, piece.encode()))


class Known(dict):
    """The ids of pieces as little-endian unsigned 16-bit integers; a new piece is encoded by the library when it is first asked for."""

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenizer, self.tokenize = tokenizer, tokenizer.model.tokenize
        # With byte-level splitting and nothing else before the model, the model alone gives a piece's ids.
        kind = json.loads(tokenizer.to_str())
        before = kind["pre_tokenizer"] or {}
        self.bare = kind["normalizer"] is None and before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and kind["model"].get("dropout") is None

    def __missing__(self, piece: str) -> bytes:
        if self.bare:
            ids = [t.id for t in self.tokenize(letters(piece))]
        else:
            ids = self.tokenizer.encode(piece, add_special_tokens=False).ids
        got = array("H", ids).tobytes()
        if len(piece) <= LONGEST:
            self[piece] = got
        return got


class Pieces:
    """Encodes texts by distinct pieces; one for each worker process and tokenizer file."""

    def __init__(self, path: str):
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.exact = regex.compile(public_tokenizers.PATTERN).findall
        # The same rule for texts without characters that Python's classes sort otherwise.
        self.fast = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+").findall
        self.odd = frozenset("\x1c\x1d\x1e\x1f").union(x for x in map(chr, range(sys.maxunicode + 1)) if x.isalnum() and not x.isalpha() and not x.isdecimal())
        self.odd_ascii = re.compile("[\x1c-\x1f]").search
        self.known = Known(self.tokenizer)

    def plain(self, text: str) -> bool:
        return not self.odd_ascii(text) if text.isascii() else self.odd.isdisjoint(set(text))

    def __call__(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 16-bit integers, without an end id."""
        if len(self.known) > CACHED:
            self.known.clear()
        known, out = self.known.__getitem__, []
        for t in texts:
            if any(s in t for s in self.special):
                out.append(array("H", self.tokenizer.encode(t, add_special_tokens=False).ids).tobytes())
            else:
                out.append(b"".join(map(known, (self.fast if self.plain(t) else self.exact)(t))))
        return out


_pieces: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _pieces:
        _pieces[path] = Pieces(path)
    return _pieces[path]


def packed(bounds: np.ndarray):
    """(part, doc_id, h, z) of (doc_id, h, text): the part by the bounds, a null id in the first; the text compressed."""

    def run(batches):
        z = zstandard.ZstdCompressor(level=1)
        for b in batches:
            ids = b.column(0)
            part = np.where(ids.is_null().to_numpy(zero_copy_only=False), 0, np.searchsorted(bounds, ids.fill_null(0).to_numpy(zero_copy_only=False), "left"))
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), ids, b.column(1), pa.array([z.compress(t or b"") for t in b.column(2).to_pylist()], pa.binary())], names=["part", "doc_id", "h", "z"])

    return run


def planes(ids: np.ndarray) -> bytes:
    """16-bit ids, all low bytes before all high bytes, which compresses better."""
    return np.ascontiguousarray(ids.astype("<u2").view(np.uint8).reshape(-1, 2).T).tobytes()


def from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(2, -1).T).view("<u2").ravel()


def blocks_of(path: str):
    """Rows (part, doc_id, z) in order to blocks: (part, block, start, doc_ids, lengths, ids); start counts from the part's first id."""

    def run(batches):
        encode, z = pieces(path), zstandard.ZstdDecompressor()
        gc.freeze()  # the cache holds no cycles
        part, block, start, n, keys, sizes, held = None, 0, 0, 0, [], [], []

        def row():
            ids = np.frombuffer(b"".join(held), "<u2")
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([block], pa.int64()), pa.array([start], pa.int64()), pa.array([keys], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int64())), pa.array([planes(ids)], pa.binary())],
                names=["part", "block", "start", "doc_ids", "lengths", "ids"],
            )

        end = int(END_ID).to_bytes(2, "little")
        for b in batches:
            for some in slices(b, 3):
                texts = [z.decompress(x).decode("utf-8", "replace") for x in some.column(3).to_pylist()]
                for p, doc_id, ids in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), encode(texts), strict=True):
                    if keys and (p != part or n >= BLOCK_IDS):
                        yield row()
                        start, block, n = start + n, block + 1, 0
                        keys, sizes, held = [], [], []
                    if p != part:
                        part, block, start = p, 0, 0
                    keys.append(doc_id)
                    sizes.append(len(ids) // 2 + 1)
                    n += sizes[-1]
                    held += (ids, end)
        if keys:
            yield row()

    return run


def id_counts(batches):
    out = None
    for b in batches:
        for x in b.column(0).to_pylist():
            got = np.bincount(from_planes(x), minlength=1 << 16)
            out = got if out is None else out + got
    return out


def normalised(counts: np.ndarray) -> np.ndarray:
    """Frequencies that sum to 2^SCALE, at least 1 for every id that occurs."""
    n = counts.sum()
    if not n:
        return np.zeros(len(counts), np.uint64)
    f = np.where(counts > 0, np.maximum(1, counts * float(1 << SCALE) // float(n)), 0).astype(np.int64)
    over = int(f.sum()) - (1 << SCALE)
    order = np.argsort(-f, kind="stable")
    for k in order:  # takes from the most frequent, which have the most to give
        if not over:
            break
        give = min(over, int(f[k]) // 2) if over > 0 else over
        f[k] -= give
        over -= give
    return f.astype(np.uint64)


class Coder:
    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.start = (np.cumsum(self.freq) - self.freq).astype(np.uint64)
        self.crc = zlib.crc32(self.freq.astype("<u4").tobytes())
        self.symbol = np.repeat(np.arange(len(freq)), self.freq.astype(np.int64)).astype(np.uint16)

    def encode(self, ids: np.ndarray, lengths: list[int]) -> bytes:
        x, kept, words, count = np.full(LANES, LOW, np.uint64), [], [], 0
        steps = -(-len(ids) // LANES)
        f_of, s_of = self.freq[ids], self.start[ids]
        for t in range(steps - 1, -1, -1):
            f, s = f_of[t * LANES : (t + 1) * LANES], s_of[t * LANES : (t + 1) * LANES]
            if t and (t + 1) % CHECKPOINT == 0 and t + 1 < steps:
                kept.append((t + 1, count, x.copy()))
            y = x[: len(f)]
            spill = y >= f << np.uint64(63 - SCALE)
            if spill.any():
                out = y[spill]
                words.append((out & np.uint64(0xFFFFFFFF)).astype("<u4"))
                count += len(out)
                y[spill] = out >> np.uint64(32)
            q = y // f
            y[:] = (q << np.uint64(SCALE)) + (y - q * f) + s
        head = HEAD.pack(b"RLT1", len(ids), zlib.crc32(ids.astype("<u4").tobytes()), self.crc, LANES, len(kept), count, len(lengths))
        marks = b"".join(struct.pack("<II", t, count - n) + states.astype("<u8").tobytes() for t, n, states in reversed(kept))
        return head + np.array(lengths, "<u4").tobytes() + x.astype("<u8").tobytes() + marks + b"".join(w.tobytes() for w in reversed(words))

    def parse(self, data: bytes):
        magic, n, crc, table_crc, lanes, marks, count, docs = HEAD.unpack_from(data)
        if magic != b"RLT1" or table_crc != self.crc:
            raise ValueError("not a block of this frequency table")
        at = HEAD.size
        lengths = np.frombuffer(data, "<u4", docs, at)
        at += 4 * docs
        points = [(0, 0, np.frombuffer(data, "<u8", lanes, at))]
        at += 8 * lanes
        for _ in range(marks):
            t, w = struct.unpack_from("<II", data, at)
            points.append((t, w, np.frombuffer(data, "<u8", lanes, at + 8)))
            at += 8 + 8 * lanes
        return n, crc, lanes, lengths, points, np.frombuffer(data, "<u4", count, at)

    def part(self, n: int, lanes: int, point, stop: int, words: np.ndarray) -> np.ndarray:
        """The ids from one checkpoint up to the step `stop`."""
        t0, w, states = point
        x, out, mask = states.astype(np.uint64), [], np.uint64((1 << SCALE) - 1)
        for t in range(t0, stop):
            y = x[: min(lanes, n - t * lanes)]
            slot = y & mask
            sym = self.symbol[slot]
            out.append(sym)
            y[:] = self.freq[sym] * (y >> np.uint64(SCALE)) + slot - self.start[sym]
            need = np.flatnonzero(y < LOW)
            if len(need):
                y[need] = (y[need] << np.uint64(32)) | words[w : w + len(need)]
                w += len(need)
        return np.concatenate(out) if out else np.zeros(0, np.uint16)

    def decode(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """The ids and the documents' lengths of a block; ValueError if a checksum fails."""
        n, crc, lanes, lengths, points, words = self.parse(data)
        stops = [p[0] for p in points[1:]] + [-(-n // lanes)]
        ids = np.concatenate([self.part(n, lanes, p, stop, words) for p, stop in zip(points, stops, strict=True)])
        if zlib.crc32(ids.astype("<u4").tobytes()) != crc:
            raise ValueError("checksum of ids")
        return ids, lengths


def encoded(freq: np.ndarray):
    def run(batches):
        coder = Coder(freq)
        for b in batches:
            data = [coder.encode(from_planes(x), n) for x, n in zip(b.column(5).to_pylist(), b.column(4).to_pylist(), strict=True)]
            sizes = [sum(n) for n in b.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), b.column(3), pa.array(sizes, pa.int64()), pa.array(data, pa.binary())], names=["part", "block", "start", "doc_ids", "n_ids", "data"])

    return run


BLOCKS = "part int, block long, start long, doc_ids array<long>, n_ids long, data binary"


def write(docs: DataFrame, tokenizer: str | None = None) -> tuple[DataFrame, np.ndarray]:
    """The corpus as a table of coded blocks in order of (part, block), and its frequency table."""
    path = tokenizer or default_tokenizer()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).collect()[0][0]
    n = max(1, min(-(-size // PART_BYTES), MANY_PARTS), -(-size // MOST_PART_BYTES))
    bounds = rows.agg(F.percentile_approx("doc_id", [k / n for k in range(1, n)], max(10_000, 4 * n))).collect()[0][0] if n > 1 else None  # n - 1 numbers
    small = rows.select("doc_id", F.xxhash64("text").alias("h"), "text").mapInArrow(packed(np.unique(np.array(bounds or [], np.int64))), "part int, doc_id long, h long, z binary")
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // 4, 1)
    ordered = small.repartition(tasks, "part").sortWithinPartitions("part", "doc_id", "h")
    plain = written(ordered.mapInArrow(blocks_of(path), "part int, block long, start long, doc_ids array<long>, lengths array<long>, ids binary"), "ids", "zstd")
    counts = total(plain.select("ids"), id_counts)
    freq = normalised(counts if counts is not None else np.zeros(1 << 16))
    return written(plain.mapInArrow(encoded(freq), BLOCKS), "rans"), freq


def decoded(freq: np.ndarray, offsets: np.ndarray):
    def run(batches):
        coder = Coder(freq)
        for b in batches:
            out = {k: [] for k in ("doc_id", "start", "n_tokens", "ids_crc32")}
            for part, start, keys, data in zip(*(b.column(k).to_pylist() for k in (0, 2, 3, 5)), strict=True):
                ids, lengths = coder.decode(data)
                flat, at, first = ids.astype("<u4"), 0, int(offsets[part]) + start
                for doc_id, n in zip(keys, lengths.tolist(), strict=True):
                    for k, v in zip(out, (doc_id, first + at, n, zlib.crc32(flat[at : at + n].tobytes())), strict=True):
                        out[k].append(v)
                    at += n
            yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64()) for k, v in out.items()})

    return run


def read(blocks: DataFrame, freq: np.ndarray) -> DataFrame:
    """One row per document, from the coded blocks: doc_id, start, n_tokens, ids_crc32."""
    sizes = {r["part"]: r["n"] for r in blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()}  # one number for each part
    each = np.zeros(max(sizes, default=0) + 2, np.int64)
    for part, n in sizes.items():
        each[part + 1] = n
    offsets = np.cumsum(each)
    return blocks.mapInArrow(decoded(freq, offsets), "doc_id long, start long, n_tokens long, ids_crc32 long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(*write(table(spark, sf_dir, "documents")))
