"""Bloom filters of 64-bit hashes seen once and seen twice, built by tasks and merged by segments.

"Twice" of a merge is either side's "twice", or both sides' "once": a hash that two tasks hold is always in it. There are no false negatives. A filter has at most MOST bits (128 MB),
whatever the input; more hashes only make it let more through.

A task's own filter is as large as the whole one, so that many tasks send much for each of their hashes. built_from_hashes() has tasks send the hashes themselves, cut to KEPT bits, sorted and as differences: as much for each hash,
however many tasks there are. Its places are those of near_places().
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import pow2_at_least

HASHES, SEGMENTS, LEAST, MOST = 4, 64, 1 << 20, 1 << 30
KEPT, AT_ONCE = 40, 1 << 21


def bits_for(n: int, each: int) -> int:
    return pow2_at_least(min(max(n * each, LEAST), MOST))


def places(h: np.ndarray, bits: int) -> np.ndarray:
    """The bits of each 64-bit hash, by double hashing: one row of HASHES positions for each."""
    a, b = h, (h >> np.uint64(32)) | np.uint64(1)
    return (a[:, None] + b[:, None] * np.arange(HASHES, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits.bit_length() + 1)


def near_places(h: np.ndarray, bits: int) -> np.ndarray:
    """The bits of each 64-bit hash, told by its first KEPT bits and all in the segment that the first six of them name."""
    t = h >> np.uint64(64 - KEPT)
    size = np.uint64((bits // SEGMENTS).bit_length() - 1)
    m = (t ^ (t >> np.uint64(17))) * np.uint64(0xFF51AFD7ED558CCD)
    return (t >> np.uint64(KEPT - SEGMENTS.bit_length() + 1) << size)[:, None] | (places(m ^ (m >> np.uint64(29)), bits) >> np.uint64(SEGMENTS.bit_length() - 1))


def has_all(filled: np.ndarray, at: np.ndarray) -> np.ndarray:
    return ((filled[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1)


def put(filled: np.ndarray, at: np.ndarray) -> None:
    if len(at):
        at = np.sort(at)
        byte = at >> np.uint64(3)
        first = np.flatnonzero(np.concatenate([[True], byte[1:] != byte[:-1]]))
        filled[byte[first]] |= np.bitwise_or.reduceat(np.left_shift(np.uint8(1), (at & np.uint64(7)).astype(np.uint8)), first)


def fill(bits: int, hashes_of):
    """For mapInArrow: a task's two filters, in segments. hashes_of(batch): the hashes of a batch."""

    def run(batches):
        once, twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
        for b in batches:
            u, n = np.unique(hashes_of(b), return_counts=True)
            for k in range(0, len(u), 1 << 18):
                at = places(u[k : k + (1 << 18)], bits)
                put(twice, at[has_all(once, at) | (n[k : k + (1 << 18)] > 1)].ravel())
                put(once, at.ravel())
        size = bits // 8 // SEGMENTS
        for s in range(SEGMENTS):
            a = once[s * size : (s + 1) * size]
            if a.any():
                yield pa.RecordBatch.from_pydict({"segment": pa.array([s], pa.int32()), "once": [zlib.compress(a.tobytes(), 1)], "twice": [zlib.compress(twice[s * size : (s + 1) * size].tobytes(), 1)]})

    return run


def merge(batches):
    """Both filters of each segment of a partition; holds two arrays for each, whatever the number of tasks."""
    state: dict[int, list[np.ndarray]] = {}
    for b in batches:
        for s, once, twice in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
            new = [np.frombuffer(zlib.decompress(x), np.uint8) for x in (once, twice)]
            if s not in state:
                state[s] = [x.copy() for x in new]
            else:
                old = state[s]
                old[1] |= new[1] | (old[0] & new[0])
                old[0] |= new[0]
    for s, (once, twice) in state.items():
        yield pa.RecordBatch.from_pydict({"segment": pa.array([s], pa.int32()), "once": [zlib.compress(once.tobytes(), 1)], "twice": [zlib.compress(twice.tobytes(), 1)]})


def packed_hashes(hashes_of):
    """For mapInArrow: a task's distinct hashes, AT_ONCE or so at a time, by segment: their first KEPT bits as differences, byte by byte, and a bit for each that came twice."""

    def rows(hashes):
        t, n = np.unique(np.concatenate(hashes) >> np.uint64(64 - KEPT), return_counts=True)
        ends = np.searchsorted(t, np.arange(SEGMENTS + 1, dtype=np.uint64) << np.uint64(KEPT - SEGMENTS.bit_length() + 1))
        for s in range(SEGMENTS):
            part = t[ends[s] : ends[s + 1]]
            if len(part):
                steps = np.diff(part, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8)[:, : KEPT // 8]
                yield pa.RecordBatch.from_pydict({"segment": pa.array([s], pa.int32()), "once": [zlib.compress(np.ascontiguousarray(steps.T).tobytes(), 1)], "twice": [zlib.compress(np.packbits(n[ends[s] : ends[s + 1]] > 1).tobytes(), 1)]})

    def run(batches):
        held, size = [], 0
        for b in batches:
            held.append(hashes_of(b))
            size += len(held[-1])
            if size >= AT_ONCE:
                yield from rows(held)
                held, size = [], 0
        if size:
            yield from rows(held)

    return run


def unpacked_hashes(once: bytes, twice: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of a row of packed_hashes, with zeros behind their first KEPT bits, and which of them came twice."""
    steps = np.frombuffer(zlib.decompress(once), np.uint8).reshape(KEPT // 8, -1)
    wide = np.zeros((steps.shape[1], 8), np.uint8)
    wide[:, : KEPT // 8] = steps.T
    return np.cumsum(wide.view(np.uint64).ravel(), dtype=np.uint64) << np.uint64(64 - KEPT), np.unpackbits(np.frombuffer(zlib.decompress(twice), np.uint8))[: steps.shape[1]].astype(bool)


def fill_segments(bits: int):
    """For mapInArrow: both filters of each segment of a partition, of rows of packed_hashes."""

    def run(batches):
        state: dict[int, list[np.ndarray]] = {}
        size = bits // 8 // SEGMENTS
        for b in batches:
            for s, *packed in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                once, twice = state.setdefault(s, [np.zeros(size, np.uint8), np.zeros(size, np.uint8)])
                h, again = unpacked_hashes(*packed)
                for k in range(0, len(h), 1 << 18):
                    at = near_places(h[k : k + (1 << 18)], bits) - np.uint64(s * size * 8)
                    put(twice, at[has_all(once, at) | again[k : k + (1 << 18)]].ravel())
                    put(once, at.ravel())
        for s, (once, twice) in state.items():
            yield pa.RecordBatch.from_pydict({"segment": pa.array([s], pa.int32()), "once": [zlib.compress(once.tobytes(), 1)], "twice": [zlib.compress(twice.tobytes(), 1)]})

    return run


KINDS = "segment int, once binary, twice binary"


def built_from_hashes(df: DataFrame, hashes_of, bits: int, which: str = "twice"):
    """As built(), from the tasks' hashes; its places are near_places()."""
    return sent(df, df.mapInArrow(packed_hashes(hashes_of), KINDS).repartition(SEGMENTS // 4, "segment").mapInArrow(fill_segments(bits), KINDS), bits, which)


def built(df: DataFrame, hashes_of, bits: int, which: str = "twice"):
    """The broadcast filter of all hashes of df's rows, packed; open it with opened()."""
    return sent(df, df.mapInArrow(fill(bits, hashes_of), KINDS).repartition(SEGMENTS // 4, "segment").mapInArrow(merge, KINDS), bits, which)


def sent(df: DataFrame, segments: DataFrame, bits: int, which: str):
    """The filter of whole segments, broadcast."""
    found = {r["segment"]: r[which] for r in segments.select("segment", which).collect()}  # at most MOST / 8 bytes
    size = bits // 8 // SEGMENTS
    return df.sparkSession.sparkContext.broadcast([found.get(s) or zlib.compress(bytes(size), 1) for s in range(SEGMENTS)])


def opened(packed) -> np.ndarray:
    return np.frombuffer(b"".join(zlib.decompress(x) for x in packed.value), np.uint8)
