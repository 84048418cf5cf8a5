"""Words of many texts at once: positions, hashes and n-word windows in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from tabshift.llm.common import bytes_of

# Multipliers of a 64-bit mixer; any odd numbers with well spread bits do.
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Letters, digits and everything beyond ASCII, after lower-casing A-Z.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: Everything but space and \t to \r.
BLACK = np.ones(256, bool)
BLACK[[0x20, *range(9, 14)]] = False


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _A
    x = (x ^ (x >> np.uint64(29))) * _B
    return x ^ (x >> np.uint64(32))


@dataclass
class Words:
    """Words of a column of texts. `first[i] : first[i + 1]` are the words of text i."""

    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes, eight bytes a step."""
        padded = np.concatenate([self.data, np.zeros(8, np.uint8)])
        at_byte = np.ndarray((len(self.data) + 1,), "<u8", padded.data, 0, (1,))
        size = self.ends - self.starts
        h = mix(size.astype(np.uint64) * _C + _A)
        open_, at = np.arange(len(size)), 0
        while len(open_):
            left = size[open_] - at
            part = at_byte[self.starts[open_] + at] & _MASK[np.minimum(left, 8)]
            h[open_] = mix(h[open_] * _C ^ part)
            open_, at = open_[left > 8], at + 8
        return h


def words(array: pa.Array, inside: np.ndarray, lower: bool) -> Words:
    """Maximal runs of bytes in `inside`, which never cross two texts. Bytes of a
    multi-byte character are all inside or all outside, so this equals a regular
    expression over characters whose class holds all or nothing beyond ASCII."""
    data, off = bytes_of(array)
    if lower:
        data = LOWER[data]
    inner = inside[data]
    before, after = np.empty_like(inner), np.empty_like(inner)
    before[1:], after[:-1] = inner[:-1], inner[1:]
    edges = off[:-1][off[:-1] < off[1:]]
    before[edges] = False
    after[off[1:][off[:-1] < off[1:]] - 1] = False
    starts = np.flatnonzero(inner & ~before)
    ends = np.flatnonzero(inner & ~after) + 1
    return Words(data, off, starts, ends, np.searchsorted(starts, off))


def windows(w: Words, h: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and owner of each `size`-word window inside one text, in order."""
    n = len(h) - size + 1
    owner = w.owner()
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = np.full(n, _B)
    for k in range(size):
        out = mix(out * _C ^ h[k : k + n])
    whole = owner[:n] == owner[size - 1 :]
    return out[whole], owner[:n][whole]


def sequence_hash(h: np.ndarray) -> np.uint64:
    """Hash of a whole short sequence; never equals a window's by construction."""
    out = np.full(1, _A ^ np.uint64(len(h)))
    for x in h:
        out = mix(out * _C ^ x)
    return out[0]


def runs(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places of runs by their first places and sizes, one run after the other."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - size), size)
