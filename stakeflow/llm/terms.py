"""Terms of Arrow text columns as byte spans: splitting, xxhash64 keys and an open-addressed table, vectorised.

Terms are kept as (start, length) spans of one byte buffer in which the lower-cased words of a text
stand one space apart, so a run of n words is one span as well.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from stakeflow.llm.words import chunks

# fixed values: a term is a run of ASCII digits, ASCII letters and characters beyond ASCII; only A-Z is lower-cased
TERM_BYTES = np.zeros(256, bool)
TERM_BYTES[0x30:0x3A] = True
TERM_BYTES[0x41:0x5B] = True
TERM_BYTES[0x61:0x7B] = True
TERM_BYTES[0x80:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_PAD = 8

# fixed values: the five primes of the xxhash64 specification
_P1, _P2, _P3, _P4, _P5 = (
    np.uint64(v) for v in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261)
)


@dataclass
class Terms:
    """Terms of a run of texts: spans of ``data`` and the number of the first term of each text."""

    data: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray
    first: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.starts[i] + self.lengths[i]].tobytes()


def split_terms(texts: pa.Array) -> Terms:
    """Lower-cased terms of a text column, whole texts; null has none."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    inside = TERM_BYTES[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    joined = np.zeros(len(data) + 1, bool)  # the bytes on both sides of this place belong to one term
    joined[1:-1] = inside[1:] & inside[:-1] & ~edge[1:-1]
    starts = np.flatnonzero(inside & ~joined[:-1])
    lengths = np.flatnonzero(inside & ~joined[1:]) + 1 - starts
    begin = np.cumsum(lengths + 1) - (lengths + 1)
    out = np.full(int((lengths + 1).sum()) + _PAD, 0x20, np.uint8)
    letters = _LOWER[data[inside]]
    out[np.arange(len(letters)) + np.repeat(np.arange(len(starts)), lengths)] = letters
    return Terms(out, begin, lengths, np.searchsorted(starts, offsets))


def runs(terms: Terms, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of all runs of ``n`` consecutive terms, and the number of the first run of each text."""
    if n == 1:
        return terms.starts, terms.lengths, terms.first
    per_text = np.maximum(terms.counts() - n + 1, 0)
    first = np.concatenate([[0], np.cumsum(per_text)])
    at = np.arange(first[-1]) + np.repeat(terms.first[:-1] - first[:-1], per_text)
    return terms.starts[at], terms.starts[at + n - 1] + terms.lengths[at + n - 1] - terms.starts[at], first


def _turn(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def span_keys(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """xxhash64 (seed 0) of every span; ``data`` ends with 8 bytes of padding.

    Spans below 32 bytes go through NumPy eight bytes at a time, the few longer ones through the library.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    eights = np.ndarray(len(data) - 7, "<u8", data, 0, (1,))
    fours = np.ndarray(len(data) - 3, "<u4", data, 0, (1,))
    short = lengths < 32
    h = _P5 + lengths.astype(np.uint64)
    for at in (0, 8, 16):
        on = np.flatnonzero(short & (lengths >= at + 8))
        lane = _turn(eights[starts[on] + at] * _P2, 31) * _P1
        h[on] = _turn(h[on] ^ lane, 27) * _P1 + _P4
    on = np.flatnonzero(short & (lengths & 4 > 0))
    h[on] = _turn(h[on] ^ (fours[starts[on] + (lengths[on] & ~7)].astype(np.uint64) * _P1), 23) * _P2 + _P3
    for k in range(3):
        on = np.flatnonzero(short & (lengths & 3 > k))
        h[on] = _turn(h[on] ^ (data[starts[on] + (lengths[on] & ~3) + k].astype(np.uint64) * _P5), 11) * _P1
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    h = h ^ (h >> np.uint64(32))
    for i in np.flatnonzero(~short).tolist():
        h[i] = xxhash.xxh64_intdigest(data[starts[i] : starts[i] + lengths[i]].tobytes())
    return h


def same_bytes(a: np.ndarray, a_starts: np.ndarray, b: np.ndarray, b_starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Whether spans of equal lengths (1 at least) hold equal bytes."""
    if not len(lengths):
        return np.zeros(0, bool)
    begin = np.cumsum(lengths) - lengths
    step = np.arange(int(lengths.sum())) - np.repeat(begin, lengths)
    equal = a[np.repeat(a_starts, lengths) + step] == b[np.repeat(b_starts, lengths) + step]
    return np.logical_and.reduceat(equal, begin)


def intern(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Open-addressed table of the distinct spans: (slot number of each occurrence, one occurrence of each slot).

    A slot is found by its key and taken by an occurrence; others stay only if their key, length and
    bytes are those of the owner, else they go on to the next slot. The table is at most half full.
    """
    size = 1 << max(4, (2 * len(starts)).bit_length())
    owner = np.full(size, -1, np.int64)
    place = (keys & np.uint64(size - 1)).astype(np.int64)
    slot = np.empty(len(starts), np.int64)
    left = np.arange(len(starts))
    while len(left):
        at = place[left]
        free = owner[at] < 0
        owner[at[free]] = left[free]
        own = owner[at]
        same = (keys[own] == keys[left]) & (lengths[own] == lengths[left])
        check = np.flatnonzero(same & (own != left))
        same[check] = same_bytes(data, starts[own[check]], data, starts[left[check]], lengths[left[check]])
        slot[left[same]] = at[same]
        left = left[~same]
        place[left] = (place[left] + 1) & (size - 1)
    used = np.flatnonzero(owner >= 0)
    number = np.empty(size, np.int64)
    number[used] = np.arange(len(used))
    return number[slot], owner[used]


def term_chunks(column: pa.Array) -> Iterator[tuple[int, int, Terms]]:
    """(first row, rows, terms) of pieces of a text column of about 1 MB each."""
    for lo, piece in chunks(column):
        yield lo, len(piece), split_terms(piece)
