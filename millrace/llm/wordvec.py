"""Words of many texts at once, as numpy arrays over one byte buffer.

Words are runs of bytes other than space and the controls 0x09 to 0x0D.  All of these are single
bytes in UTF-8, so word boundaries in bytes are word boundaries in characters.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .common import CHUNK_BYTES, mix64

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, for n places at least."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + 65536)
        out = []
        for b in (_BASE, _INVERSE):
            a = np.full(size, b, np.uint64)
            a[0] = 1
            out.append(np.multiply.accumulate(a))
        _powers[:] = out
    return _powers[0], _powers[1]


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of buf[starts[i]:ends[i]], equal for equal bytes wherever they stand."""
    n = len(buf)
    up, down = _power_tables(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    return mix64((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


@dataclass
class Words:
    """Words of a group of texts: where they stand, whose they are, and their hashes."""

    buf: np.ndarray
    text_start: np.ndarray  # first byte of each text, and one end
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray  # index of the word's text
    first: np.ndarray  # index of each text's first word, and one end
    hash: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def words_of(data: list[bytes]) -> Words:
    """Words of the given texts.  A newline is put after each text, so no word runs on into the next."""
    joined = b"\n".join(data) + b"\n"
    buf = np.frombuffer(joined, np.uint8)
    text_start = np.zeros(len(data) + 1, np.int64)
    np.cumsum([len(d) + 1 for d in data], out=text_start[1:])
    inside = np.empty(len(buf) + 1, bool)
    inside[0] = False
    np.logical_not(SPACE[buf], out=inside[1:])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[0::2], edge[1::2]
    first = np.searchsorted(start, text_start)
    doc = np.repeat(np.arange(len(data)), np.diff(first))
    return Words(buf, text_start, start, end, doc, first, span_hashes(buf, start, end))


def windows(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of `size` words within one text, and the index of each window's first word."""
    n = len(w.hash)
    if n < size:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(w.doc[: n - size + 1] == w.doc[size - 1 :])
    h = np.zeros(n - size + 1, np.uint64)
    for i in range(size):
        h = h * np.uint64(0xD6E8FEB86659FD93) + w.hash[i : n - size + 1 + i]
    return mix64(h)[at], at


def sum_by(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values over [first[i], first[i + 1]), in integers or floats; empty ranges give 0."""
    total = np.zeros(len(values) + 1, np.int64 if values.dtype.kind in "biu" else np.float64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]
