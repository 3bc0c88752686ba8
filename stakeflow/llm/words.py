"""Words, shingles and min-hashes of Arrow text columns, vectorised over whole batches."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes handled together.
CHUNK_BYTES = 1 << 20

# fixed values: words are runs of bytes other than ASCII white space; only A-Z is lower-cased
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the usual shift-multiply finalizer)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _powers(n: int, base: np.uint64 = _BASE) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


@dataclass
class Words:
    """Words of a run of texts: 64-bit hashes, byte places in the joined texts, first word of each text."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    offsets: np.ndarray  # byte range of each text

    def of(self, i: int) -> np.ndarray:
        return self.hashes[self.first[i] : self.first[i + 1]]


def split_words(texts: pa.Array) -> Words:
    """Lower-cased words of a text column; null counts as empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    inside = ~_SPACE[data]
    after = np.empty(len(inside) + 1, bool)  # a word goes on at this byte
    after[0] = False
    after[1:] = inside
    after[offsets] = False
    starts = np.flatnonzero(inside & ~after[:-1])
    before = np.empty(len(inside) + 1, bool)
    before[:-1] = inside
    before[-1] = False
    before[offsets] = False
    ends = np.flatnonzero(inside & ~before[1:]) + 1
    length = ends - starts
    letters = _LOWER[data[inside]].astype(np.uint64) + np.uint64(1)
    begin = np.cumsum(length) - length
    place = np.arange(len(letters)) - np.repeat(begin, length)
    letters *= _powers(int(length.max()) if len(length) else 1)[place]
    hashes = np.add.reduceat(letters, begin) if len(begin) else np.zeros(0, np.uint64)
    hashes = mix(hashes + length.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return Words(hashes, starts, ends, np.searchsorted(starts, offsets), offsets)


def chunks(texts: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """(first row, slice) pieces of a text column of about ``size`` bytes each; a long text is a piece of its own."""
    length = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    lo, held = 0, 0
    for i, n in enumerate(length.tolist()):
        if held and held + n > size:
            yield lo, texts.slice(lo, i - lo)
            lo, held = i, 0
        held += n
    if lo < len(texts):
        yield lo, texts.slice(lo)


def shingle(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of ``n`` words, in order; shorter sequences are one shingle, empty ones none."""
    if not len(words):
        return words
    if len(words) < n:
        n = len(words)
    factors = _powers(n + 1)[1:]
    total = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        total += words[k : len(words) - n + 1 + k] * factors[k]
    return mix(total + np.uint64(n))


def shingle_set(words: np.ndarray, n: int) -> np.ndarray:
    """Distinct shingle hashes, sorted."""
    return np.unique(shingle(words, n))


def minhash(values: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Smallest 32-bit hash of a non-empty set under each (odd multiplier, shift) row of ``seeds``."""
    return ((values[None, :] * seeds[:, :1] + seeds[:, 1:]) >> np.uint64(32)).min(1).astype(np.uint32)


def hash_seeds(count: int, seed: int) -> np.ndarray:
    draws = np.random.default_rng(seed).integers(0, 1 << 63, (count, 2)).astype(np.uint64)
    draws[:, 0] = draws[:, 0] * np.uint64(2) + np.uint64(1)
    return draws
