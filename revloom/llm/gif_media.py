"""Media columns: GIF files decoded to timed frames with colour histograms.

decode() reads a file's logical screen, palettes, LZW code streams (with clear codes and growing code widths), interlace, transparency and disposal, and gives each frame as
it is shown. encode() writes 8-bit samples as frames of WIDTH pixels a row on a grey palette, losslessly.

Codes are cut out of a stream with one array operation for each run between clear codes: within a run, the width of the i-th code depends on i only.

Defined results: a null text is an empty one; its payload is one unit of padding. A file that ends too early gives the frames and pixels read so far, the rest of a frame
being 0; one that isn't a GIF gives no frames. A null doc_id is passed on. Repeated rows give repeated results. An empty table gives no rows. A long text is one file of many frames. Only the columns
named are read.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table, written

UNIT, WIDTH, ROWS = 576, 24, 144  # a frame has at most 24 x 144 samples, so that its codes stay below 4,096 without a clear code
BINS = 8


@dataclass
class Frame:
    delay_ms: int
    disposal: int
    pixels: np.ndarray  # height x width x 4, RGBA, as shown
    samples: np.ndarray  # the frame's own samples, in rows
    palette: np.ndarray  # 256 x 3, the colours of samples


def widths(first: int, n: int) -> np.ndarray:
    """The width in bits of each of the first n codes after a clear code: the i-th is read when the table has 2^(first-1) + 2 + max(i - 1, 0) entries."""
    entries = (1 << (first - 1)) + 2 + np.maximum(np.arange(n) - 1, 0)
    return np.clip(np.floor(np.log2(entries + 0.5)).astype(np.int64) + 1, first, 12)


_schedule: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}


def schedule(first: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Widths and starting bits of n codes."""
    size = 1 << max(12, (n - 1).bit_length())
    if (first, size) not in _schedule:
        w = widths(first, size)
        _schedule[first, size] = (w, np.concatenate([[0], np.cumsum(w)[:-1]]))
    w, at = _schedule[first, size]
    return w[:n], at[:n]


def cut_codes(data: np.ndarray, start: int, first: int, limit: int) -> np.ndarray:
    """Codes from bit `start` on, by the schedule that a clear code begins; data ends with 4 bytes of padding, `limit` is its number of bits."""
    w, at = schedule(first, max(1, (limit - start) // first + 1))
    at = at + start
    k = int(np.searchsorted(at + w, limit, "right"))
    w, at = w[:k], at[:k]
    b = at >> 3
    word = data[b].astype(np.uint32) | (data[b + 1].astype(np.uint32) << 8) | (data[b + 2].astype(np.uint32) << 16)
    return (word >> (at & 7).astype(np.uint32)) & ((1 << w) - 1).astype(np.uint32)


def lzw_decode(stream: bytes, code_size: int, n: int) -> np.ndarray:
    """At most n samples of a code stream."""
    clear, end, first = 1 << code_size, (1 << code_size) + 1, code_size + 1
    data = np.frombuffer(stream + b"\0\0\0\0", np.uint8)
    limit, start, parts, left = 8 * len(stream), 0, [], n
    basic = [bytes([k]) for k in range(min(clear, 256))] + [b"", b""]
    while left > 0 and start < limit:
        codes = cut_codes(data, start, first, limit)
        stops = np.flatnonzero((codes == clear) | (codes == end))
        k = int(stops[0]) if len(stops) else len(codes)
        run = codes[:k].tolist()
        if run:
            known, size, out = list(basic), clear + 2, []
            if run[0] >= clear:
                break
            before = known[run[0]]
            out.append(before)
            add, put = known.append, out.append
            for c in run[1:]:
                if c < size:
                    got = known[c]
                elif c == size:
                    got = before + before[:1]
                else:
                    left = 0
                    break
                put(got)
                if size < 4096:
                    add(before + got[:1])
                    size += 1
                before = got
            joined = b"".join(out)[: max(left, 0) or None]
            parts.append(joined)
            left -= len(joined)
        if not len(stops) or codes[k] == end:
            break
        w, at = schedule(first, k + 1)
        start += int(at[k] + w[k])
    got = np.frombuffer(b"".join(parts), np.uint8)[:n]
    return got if len(got) == n else np.concatenate([got, np.zeros(n - len(got), np.uint8)])


def lzw_encode(samples: bytes) -> bytes:
    """8-bit samples as a code stream; clear codes where the table is full."""
    codes: list[int] = []
    runs: list[list[int]] = []
    table_of: dict[int, int] = {}
    nxt, p = 258, samples[0]
    get, put = table_of.get, codes.append
    for c in samples[1:]:
        k = p << 8 | c
        q = get(k)
        if q is None:
            put(p)
            table_of[k] = nxt
            nxt += 1
            p = c
            if nxt == 4095:
                put(p)
                runs.append(codes)
                codes, nxt, p = [], 258, -1
                table_of.clear()
                put = codes.append
        else:
            p = q
        if p == -1:
            break
    else:
        put(p)
        runs.append(codes)
    if p == -1:  # the rest, after a clear code
        done = sum_decoded(runs[-1])
        rest = samples[done:]
        return pack_runs([*runs, *([unpack(lzw_encode(rest))] if rest else [])])
    return pack_runs(runs)


def sum_decoded(codes: list[int]) -> int:
    """How many samples a run of codes stands for."""
    length = [1] * 256 + [0, 0]
    total, before = 0, 0
    for i, c in enumerate(codes):
        n = length[c] if c < len(length) else before + 1
        if i:
            length.append(before + 1)
        total, before = total + n, n
    return total


def unpack(stream: bytes) -> list[int]:
    """The codes of a stream of one run, without its clear and end codes; of several, all of them with the clear codes between."""
    data, out, start = np.frombuffer(stream + b"\0\0\0\0", np.uint8), [], 9
    while True:
        codes = cut_codes(data, start, 9, 8 * len(stream))
        stops = np.flatnonzero((codes == 256) | (codes == 257))
        k = int(stops[0])
        out += codes[:k].tolist()
        if codes[k] == 257:
            return out
        out.append(256)
        w, at = schedule(9, k + 1)
        start += int(at[k] + w[k])


def pack_runs(runs: list[list[int]]) -> bytes:
    """A clear code, then each run, a clear code between runs, and an end code; bits from the lowest on."""
    parts, bits = [np.array([256], np.int64)], [np.array([9], np.int64)]
    flat: list[list[int]] = []
    for run in runs:
        cut = 0
        for k, c in enumerate(run):
            if c == 256:
                flat.append(run[cut:k])
                cut = k + 1
        flat.append(run[cut:])
    for i, run in enumerate(flat):
        run = [*run, 257 if i == len(flat) - 1 else 256]
        parts.append(np.array(run, np.int64))
        bits.append(schedule(9, len(run))[0])
    c, w = np.concatenate(parts), np.concatenate(bits)
    grid = (c[:, None] >> np.arange(12)) & 1
    return np.packbits(grid[np.arange(12)[None, :] < w[:, None]].astype(np.uint8), bitorder="little").tobytes()


def sub_blocks(data: bytes) -> bytes:
    return b"".join(bytes([len(data[k : k + 255])]) + data[k : k + 255] for k in range(0, len(data), 255)) + b"\0"


GREY = bytes(v for k in range(256) for v in (k, k, k))


def encode(samples: bytes, delay_cs: int = 10) -> bytes:
    """A GIF89a of WIDTH pixels a row whose frames hold the samples in order. Its length must be a multiple of UNIT."""
    rows = min(len(samples) // WIDTH, ROWS)
    out = [b"GIF89a", WIDTH.to_bytes(2, "little"), rows.to_bytes(2, "little"), b"\xf7\0\0", GREY]
    for k in range(0, len(samples), WIDTH * ROWS):
        part = samples[k : k + WIDTH * ROWS]
        out += [b"\x21\xf9\x04\x04", delay_cs.to_bytes(2, "little"), b"\0\0", b"\x2c\0\0\0\0", WIDTH.to_bytes(2, "little"), (len(part) // WIDTH).to_bytes(2, "little"), b"\0\x08", sub_blocks(lzw_encode(part))]
    return b"".join(out) + b"\x3b"


def interlaced(height: int) -> np.ndarray:
    """The row that each stored row of an interlaced frame stands for."""
    return np.concatenate([np.arange(a, height, s) for a, s in ((0, 8), (4, 8), (2, 4), (1, 2))])


def decode(media: bytes):
    """The file's frames, in order."""
    if media[:6] not in (b"GIF87a", b"GIF89a") or len(media) < 13:
        return
    n16 = lambda k: int.from_bytes(media[k : k + 2], "little")
    width, height, flags = n16(6), n16(8), media[10]
    pos, common = 13, None

    def palette(k: int, bits: int) -> np.ndarray:
        got = np.frombuffer(media[k : k + 3 * (2 << bits)], np.uint8)
        out = np.zeros((256, 3), np.uint8)
        out[: len(got) // 3] = got[: len(got) // 3 * 3].reshape(-1, 3)
        return out

    def gather(k: int) -> tuple[bytes, int]:
        parts = []
        while k < len(media) and media[k]:
            parts.append(media[k + 1 : k + 1 + media[k]])
            k += 1 + media[k]
        return b"".join(parts), k + 1

    if flags & 0x80:
        common = palette(pos, flags & 7)
        pos += 3 * (2 << (flags & 7))
    canvas = np.zeros((height, width, 4), np.uint8)
    delay, disposal, clear_to = 0, 0, None
    while pos < len(media):
        kind = media[pos]
        if kind == 0x21:
            if media[pos + 1 : pos + 2] == b"\xf9" and pos + 6 < len(media):
                f = media[pos + 3]
                disposal, delay, clear_to = (f >> 2) & 7, n16(pos + 4), media[pos + 6] if f & 1 else None
            _, pos = gather(pos + 2)
        elif kind == 0x2C and pos + 10 < len(media):
            x, y, w, h, f = n16(pos + 1), n16(pos + 3), n16(pos + 5), n16(pos + 7), media[pos + 9]
            pos += 10
            colours = common if common is not None else np.zeros((256, 3), np.uint8)
            if f & 0x80:
                colours = palette(pos, f & 7)
                pos += 3 * (2 << (f & 7))
            if pos >= len(media):
                return
            code_size = media[pos]
            stream, pos = gather(pos + 1)
            samples = lzw_decode(stream, code_size, w * h).reshape(h, w) if 1 < code_size < 9 else np.zeros((h, w), np.uint8)
            if f & 0x40:
                whole = np.empty_like(samples)
                whole[interlaced(h)] = samples
                samples = whole
            before = canvas.copy() if disposal == 3 else None
            part = canvas[y : y + h, x : x + w]
            seen = samples[: part.shape[0], : part.shape[1]]
            if clear_to is None:
                part[..., :3], part[..., 3] = colours[seen], 255
            else:
                drawn = seen != clear_to
                part[drawn] = np.concatenate([colours[seen], np.full((*seen.shape, 1), 255, np.uint8)], axis=2)[drawn]
            yield Frame(10 * delay, disposal, canvas.copy(), samples, colours)
            if disposal == 2:
                part[:] = 0
            elif disposal == 3:
                canvas = before
            delay, disposal, clear_to = 0, 0, None
        else:
            return


def histogram(values: np.ndarray) -> np.ndarray:
    """Counts of 8-bit values in BINS equal ranges."""
    return np.bincount(values.ravel() >> 5, minlength=BINS)


FRAME = "frame int, start_ms long, delay_ms long, width int, height int, red array<long>, green array<long>, blue array<long>, transparent long"
_hist = pa.list_(pa.int64())
FRAME_ARROW = pa.struct([("frame", pa.int32()), ("start_ms", pa.int64()), ("delay_ms", pa.int64()), ("width", pa.int32()), ("height", pa.int32()), ("red", _hist), ("green", _hist), ("blue", _hist), ("transparent", pa.int64())])


def described(got: list[Frame]) -> list[dict]:
    """For each frame as shown: its place, start, delay, size, histograms of its drawn pixels by colour, and the number of transparent ones."""
    out, at = [], 0
    for k, f in enumerate(got):
        clear = int((f.pixels[..., 3] == 0).sum())
        drawn = f.pixels[f.pixels[..., 3] > 0] if clear else f.pixels.reshape(-1, 4)
        out.append({"frame": k, "start_ms": at, "delay_ms": f.delay_ms, "width": f.pixels.shape[1], "height": f.pixels.shape[0], **{c: histogram(drawn[:, i]).tolist() for i, c in enumerate(("red", "green", "blue"))}, "transparent": clear})
        at += f.delay_ms
    return out


def frames(media: DataFrame) -> DataFrame:
    """One row per frame of media(id, media): id, frame, start_ms, delay_ms, width, height, red, green, blue (histograms over drawn pixels), transparent (pixels)."""

    def run(batches):
        for b in (part for whole in batches for part in slices(whole, 1)):
            got = [described(list(decode(data or b""))) for data in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.list_(FRAME_ARROW))], names=["id", "frames"])

    found = media.select(F.col("id").cast("long").alias("id"), F.col("media").cast("binary").alias("media")).mapInArrow(run, f"id long, frames array<struct<{FRAME.replace(' ', ':').replace(',:', ',')}>>")
    return found.select("id", F.inline("frames"))


def store_batches(batches):
    for b in (part for whole in batches for part in slices(whole, 1)):
        sizes, media = [], []
        for t in b.column(1).to_pylist():
            t = t or b""
            sizes.append(len(t))
            media.append(encode(t + b"\xff" * (-len(t) % UNIT if t else UNIT)))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])


def store(docs: DataFrame) -> DataFrame:
    """The texts as GIF files, written as a table: doc_id, n_bytes, media."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return written(rows.mapInArrow(store_batches, "doc_id long, n_bytes long, media binary"), "gif")


READ = f"doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, frames array<struct<{FRAME.replace(' ', ':').replace(',:', ',')}>>"


def read_back(batches):
    """Rows of a stored file: its digests, those of the samples it gives back, and its frames."""
    names = ("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "frames")
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(FRAME_ARROW)]
    for b in (part for whole in batches for part in slices(whole, 2)):
        rows = []
        for key, size, media in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
            got = list(decode(media))
            payload = b"".join(np.ascontiguousarray(f.palette[f.samples][..., 0]).tobytes() for f in got)  # the red of the palette's greys
            rows.append((key, size, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), described(got)))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=list(names))


def features(docs: DataFrame) -> DataFrame:
    """Stores the texts as files and their frames as a table of timed frames with colour histograms for each file; one row per document, its feature from that table: number of frames, length in ms, sums of the red histograms."""
    stored = written(store(docs).mapInArrow(read_back, READ), "frames")
    sums = F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda k: F.aggregate("frames", F.lit(0).cast("long"), lambda a, f: a + F.get(f["red"], k)))
    length = F.aggregate("frames", F.lit(0).cast("long"), lambda a, f: a + f["delay_ms"])
    return stored.withColumn("feature", F.concat_ws(":", F.size("frames").cast("string"), length.cast("string"), F.array_join(sums.cast("array<string>"), ","))).drop("frames")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(table(spark, sf_dir, "documents"))
