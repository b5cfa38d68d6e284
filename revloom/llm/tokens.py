"""Words of whole batches of texts as arrays of 64-bit hashes.

A word's hash is a polynomial over a random table of its bytes, mixed with its length; two different words of a corpus share one with a chance of about
2^-60 for each pair.
"""

from __future__ import annotations

import numpy as np

_rng = np.random.default_rng(7)
TABLE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
BASE = np.uint64(0x9E3779B97F4A7C15)
_powers = BASE ** np.arange(1 << 12, dtype=np.uint64)
PART = 1 << 19
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class Words:
    """The words of texts, lower-cased (A-Z): `hashes` of all of them in order, `at` where each text's begin (one more entry than texts), their `lengths` in bytes, `last`: their last three bytes as one number."""

    def __init__(self, texts: list[bytes | None]):
        parts, some, size = [], [], 0
        for t in texts:  # in parts of about PART bytes, which bounds the arrays on the way
            some.append(t or b"")
            size += len(some[-1])
            if size >= PART:
                parts.append(_words(some))
                some, size = [], 0
        parts.append(_words(some))
        self.hashes, self.lengths, self.last = (np.concatenate([p[k] for p in parts]) for k in range(3))
        self.at = np.concatenate([[0], np.cumsum(np.concatenate([p[3] for p in parts]))])


def _words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, lengths and last bytes of all words, and how many each text has."""
    raw = np.frombuffer(b"\n".join(texts).lower(), np.uint8)
    where = np.flatnonzero(~SPACE[raw])
    if not len(where):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
    starts = np.concatenate([[0], np.flatnonzero(np.diff(where) > 1) + 1])
    lengths = np.diff(np.concatenate([starts, [len(where)]]))
    b = raw[where]
    inside = np.arange(len(b)) - np.repeat(starts, lengths)
    weights = _powers[inside & (len(_powers) - 1)]
    if lengths.max() > len(_powers):  # BASE to the power of any place, from two tables
        far = np.flatnonzero(inside >= len(_powers))
        weights[far] *= (_powers[-1:] * BASE) ** (inside[far] // len(_powers)).astype(np.uint64)
    sums = np.add.reduceat(TABLE[b] * weights, starts)
    hashes = mix(sums + lengths.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
    stop = starts + lengths
    last = b[stop - 1].astype(np.uint32)
    for k in (2, 3):
        last |= np.where(lengths >= k, b[np.maximum(stop - k, 0)], 0).astype(np.uint32) << np.uint32(8 * (k - 1))
    ends = np.cumsum([len(t) + 1 for t in texts])
    return hashes, lengths, last, np.diff(np.concatenate([[0], np.searchsorted(where[starts], ends)]))
