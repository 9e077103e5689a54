"""Vectorised 64-bit hashes of words and word shingles over UTF-8 buffers.

A word's hash is a polynomial over its bytes modulo 2**64, read off one running
sum: (C[end] - C[start]) * R**-start.  Bytes go through a random table first and
the result through a finaliser, so that no two short words collide by structure.
Every executor derives the same tables from fixed seeds.
"""

from __future__ import annotations

import numpy as np

PIECE = 1 << 16  # bytes hashed at once; keeps the 8-byte temporaries in the cache

_R = 0x9E3779B97F4A7C15 | 1
_R_INV = pow(_R, -1, 1 << 64)
_U = np.uint64


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & (2**64 - 1), dtype=_U)
    out[0] = 1
    return np.multiply.accumulate(out)


_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_MIX = _rng.integers(1, 2**63, 16, dtype=np.uint64) * _U(2) + _U(1)
_POW: dict[str, np.ndarray] = {}

#: ASCII white space as the contracts name it: space and \t to \r.
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
#: A-Z to a-z, all else unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit (in place)."""
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    n = len(buf)
    if len(_POW.get("p", ())) < n + 1:
        _POW["p"], _POW["i"] = _powers(_R, n + 1), _powers(_R_INV, n + 1)
    run = np.empty(n + 1, dtype=_U)
    run[0] = 0
    np.cumsum(_BYTE[buf] * _POW["p"][:n], out=run[1:])
    return mix64((run[ends] - run[starts]) * _POW["i"][starts] + (ends - starts).astype(_U))


def word_spans(buf: np.ndarray, breaks: np.ndarray | None = None, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of buf; a word also ends at each position of breaks."""
    blank = space[buf]
    edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    if len(buf) and not blank[0]:
        edge = np.concatenate(([0], edge))
    if len(buf) and not blank[-1]:
        edge = np.concatenate((edge, [len(buf)]))
    starts, ends = edge[0::2], edge[1::2]
    if breaks is not None and len(breaks):
        breaks = np.unique(breaks)
        at = np.searchsorted(starts, breaks, "right") - 1
        cut = (at >= 0) & (breaks > starts[at]) & (breaks < ends[at]) if len(starts) else np.zeros(len(breaks), bool)
        if cut.any():
            starts = np.sort(np.concatenate((starts, breaks[cut])))
            ends = np.sort(np.concatenate((ends, breaks[cut])))
    return starts, ends


def hash_words(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of buf; spans are ordered and disjoint."""
    out = np.empty(len(starts), dtype=_U)
    i = 0
    while i < len(starts):
        base = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, base + PIECE, "right")))
        out[i:j] = _span_hashes(buf[base : ends[j - 1]], starts[i:j] - base, ends[i:j] - base)
        i = j
    return out


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word windows of words; fewer than k words make one shingle, none make none."""
    n = len(words)
    if n == 0:
        return words
    if n < k:
        x = np.full(1, n, dtype=_U)
        for i in range(n):
            x = x * _U(3) + words[i : i + 1] * _MIX[i]
        return mix64(x)
    x = words[: n - k + 1] * _MIX[0]
    for i in range(1, k):
        x += words[i : n - k + 1 + i] * _MIX[i]
    return mix64(x)


def texts(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and offsets of an Arrow string column; null counts as empty."""
    import pyarrow as pa

    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def document_words(column, most: int = 1 << 21):
    """(first row, word hashes, word counts cumulated by row) of an Arrow string column, some MB of whole texts at a time."""
    data, offsets = texts(column)
    row = 0
    while row < len(offsets) - 1:
        last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1)
        buf = LOWER[data[offsets[row] : offsets[last]]]
        cuts = offsets[row : last + 1] - offsets[row]
        starts, ends = word_spans(buf, cuts)
        yield row, hash_words(buf, starts, ends), np.searchsorted(starts, cuts)
        row = last
