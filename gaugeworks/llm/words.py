"""Words of a slice of texts as arrays: a word is a run of bytes outside space and
0x09-0x0D, which in UTF-8 is the run of such characters. All work is in numpy over
the Arrow buffer, without a Python object per word."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_KEEP = np.array([(1 << (8 * i)) - 1 for i in range(8)] + [(1 << 64) - 1], np.uint64)


@dataclass
class Words:
    """starts, ends: byte places in `data`; doc: row of each word; first: number of
    words before each row (one more entry than rows); hashes: 64 bits a word."""

    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray
    first: np.ndarray
    hashes: np.ndarray


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values (the finaliser of MurmurHash3)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def words_of(texts: pa.Array, lower: bool = False, hashed: bool = True) -> Words:
    """Words of an Arrow array of strings; a null has none."""
    if texts.null_count:
        texts = texts.fill_null("")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    low, high = int(offsets[0]), int(offsets[-1])
    offsets = offsets - low
    data = np.zeros(high - low + 8, np.uint8)
    if high > low:
        data[: high - low] = np.frombuffer(buffers[2], np.uint8, high - low, low)
    if lower:
        data = _LOWER[data]
    n = high - low
    blank = _BLANK[data[:n]]
    inside = ~blank
    before, after = np.ones(n, bool), np.ones(n, bool)
    before[1:], after[:-1] = blank[:-1], blank[1:]
    before[offsets[:-1][offsets[:-1] < n]] = True
    last = offsets[1:] - 1
    after[last[last >= 0]] = True
    starts, ends = np.flatnonzero(inside & before), np.flatnonzero(inside & after) + 1
    first = np.searchsorted(starts, offsets)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    return Words(data, offsets, starts, ends, doc, first, hash_spans(data, starts, ends) if hashed else np.empty(0, np.uint64))


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes. `data` has 8 bytes to spare at its end."""
    lane = np.ndarray((max(len(data) - 7, 0),), "<u8", data, 0, (1,))
    size = ends - starts
    h = size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    at = np.arange(len(starts))
    step = 0
    while len(at):
        left = size[at] - step
        h[at] = mix(h[at] ^ (lane[starts[at] + step] & _KEEP[np.minimum(left, 8)])) + np.uint64(step + 1)
        at, step = at[left > 8], step + 8
    return h


class Rolling:
    """Hashes of every run of k consecutive values: a polynomial modulo 2^64 over
    well-mixed values, kept as prefix sums."""

    def __init__(self, values: np.ndarray, base: int):
        n = len(values)
        base |= 1
        up = np.full(n + 1, base, np.uint64)
        up[0] = 1
        self.down = np.full(n + 1, pow(base, -1, 1 << 64), np.uint64)
        self.down[0] = 1
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * np.cumprod(up, out=up)[:n], out=self.sums[1:])
        np.cumprod(self.down, out=self.down)

    def runs(self, k: int) -> np.ndarray:
        """Hashes of the runs at 0, 1, ... (none if there are fewer than k values)."""
        n = len(self.sums) - k
        return mix((self.sums[k:] - self.sums[:n]) * self.down[:n]) if n > 0 else np.empty(0, np.uint64)


def sliding_min(values: np.ndarray, size: int) -> np.ndarray:
    """Minimum of each run of `size` values."""
    have = 1
    while have < size:
        more = min(have, size - have)
        values = np.minimum(values[:-more], values[more:]) if len(values) > more else values[:0]
        have += more
    return values
