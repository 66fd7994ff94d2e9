"""Words of many texts at once, as numpy arrays of places and 64-bit hashes."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa

from semcorpus.llm.batches import utf8

ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(ODD), -1, 1 << 64))
_VALUES = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


class Kind(NamedTuple):
    """What a word is made of."""

    low: np.ndarray  # byte to lower-cased byte (A-Z only)
    inside: np.ndarray  # whether a byte belongs to a word


def kind_of(separators: bytes) -> Kind:
    low, inside = np.arange(256, dtype=np.uint8), np.ones(256, bool)
    low[65:91] += 32
    inside[list(separators)] = False
    return Kind(low, inside)


# Words are runs of anything but blanks.
BLANK_SEPARATED = kind_of(b" \t\n\v\f\r")
# Words are runs of ASCII letters, digits and characters beyond ASCII.
ALPHANUMERIC = kind_of(bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """ODD ** i and its inverse modulo 2 ** 64 for i up to n."""
    if len(_powers[0]) <= n:
        size = max(n + 1, 1 << 20)
        for k, base in enumerate((ODD, _INVERSE)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


class Words(NamedTuple):
    start: np.ndarray  # byte places within the joined texts
    end: np.ndarray
    hash: np.ndarray
    counts: np.ndarray  # words of each text
    raw: np.ndarray  # the joined bytes
    total: np.ndarray  # running sums that hashes are cut from

    def heads(self, size: int) -> np.ndarray:
        """Hash of the first `size` bytes of each word; 0 for shorter words."""
        out = np.zeros(len(self.start), np.uint64)
        long = np.flatnonzero(self.end - self.start >= size)
        a = self.start[long]
        out[long] = mix((self.total[a + size] - self.total[a]) * powers(len(self.raw))[1][a] + np.uint64(size))
        return out


def words(texts: pa.Array, kind: Kind) -> Words:
    """The words of every text. Null has none. Equal words have equal hashes in every process.
    """
    raw, ends = utf8(texts)
    n = len(raw)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(none, none, np.zeros(0, np.uint64), np.zeros(len(texts), np.int64), raw, np.zeros(1, np.uint64))
    inside = kind.inside[raw]
    first = np.empty(n, bool)
    first[0] = True
    np.logical_not(inside[:-1], out=first[1:])
    first[ends[:-1][ends[:-1] < n]] = True
    first &= inside
    last = np.empty(n, bool)
    last[-1] = True
    np.logical_not(inside[1:], out=last[:-1])
    last[ends[1:][ends[1:] > 0] - 1] = True
    last &= inside
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = powers(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_VALUES[kind.low[raw]] * up[:n], out=total[1:])
    h = (total[end] - total[start]) * down[start]
    counts = np.diff(np.searchsorted(start, ends))
    return Words(start, end, mix(h), counts, raw, total)
