"""Vectorised word hashing straight from Arrow string buffers.

Words are maximal runs of bytes outside ``[\\x20\\x09-\\x0D]`` (or of any other byte class handed in).  A word is read in
pieces of eight bytes, the last filled up with zeros; its length and its pieces are mixed one after the other.  Equal bytes
give equal hashes on every executor, because all constants are fixed or come from one fixed seed.

Memory is bounded by ``CHUNK``: callers see blocks of rows of about that many bytes, or a single longer row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 19
#: Words longer than this many bytes are hashed by BLAKE2b.
LONG_WORD = 4096
_rng = np.random.Generator(np.random.PCG64(20240229))
#: Keeps the first 0 to 8 bytes of a piece.
_FIRST = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
_MUL = np.uint64(0x9E3779B97F4A7C15)
_SHINGLE = _rng.integers(1, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LENGTH = np.uint64(0xD6E8FEB86659FD93)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
WORD = ~SPACE
LETTERS = np.zeros(256, bool)
LETTERS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit values that spreads every input bit."""
    h = h ^ (h >> np.uint64(33))  # a new array, changed in place from here on
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def blocks(texts: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, bytes, start of each row, end of each row): rows follow each other with one ``\\n`` after each.

    Null rows are empty.  A block has at most ``limit`` bytes, or one row.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    if not len(texts):
        return
    _, off, data = texts.buffers()
    off = np.frombuffer(off, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        n = hi - lo
        raw, lens = data[off[lo] : off[hi]], np.diff(off[lo : hi + 1])
        starts = np.zeros(n, np.int64)
        np.cumsum(lens[:-1] + 1, out=starts[1:])
        if n == 1:
            buf = np.append(raw, np.uint8(10))
        else:
            buf = np.insert(raw, off[lo + 1 : hi + 1] - off[lo], np.uint8(10))
        yield lo, buf, starts, starts + lens
        lo = hi


def spans(buf: np.ndarray, inside: np.ndarray = WORD) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes whose class is set in ``inside``."""
    flag = np.zeros(len(buf) + 2, bool)
    flag[1:-1] = inside[buf]
    turns = np.flatnonzero(flag[1:] != flag[:-1])
    return turns[::2], turns[1::2]


def hashes(buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte ranges [s, e), none of them empty."""
    if not len(s):
        return np.zeros(0, np.uint64)
    n = e - s
    padded = np.append(buf, np.zeros(8, np.uint8))
    piece = np.ndarray((len(buf) + 1,), "<u8", padded, strides=(1,))  # the eight bytes from each place on
    with np.errstate(over="ignore"):
        out = piece[s]
        out &= _FIRST[np.minimum(n, 8)]
        out *= _MUL
        out += n.view(np.uint64) * _LENGTH
        out = mix(out)
        on, at = np.flatnonzero((n > 8) & (n <= LONG_WORD)), 8
        while len(on):
            left = n[on] - at
            out[on] = mix(out[on] * _MUL + (piece[s[on] + at] & _FIRST[np.minimum(left, 8)]))
            on, at = on[left > 8], at + 8
        for k in np.flatnonzero(n > LONG_WORD):
            out[k] = np.frombuffer(hashlib.blake2b(buf[s[k] : e[k]].tobytes(), digest_size=8).digest(), np.uint64)[0]
    return out


def windows(h: np.ndarray, width: int = 5) -> np.ndarray:
    """Hash of each run of ``width`` consecutive word hashes: one less than ``width`` shorter than ``h``."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        acc = np.full(n, _LENGTH * np.uint64(width), np.uint64)
        for k in range(width):
            acc += h[k : k + n] * _SHINGLE[k]
        return mix(acc)


def rows_of(s: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Index of the first range of each row and one more at the end: row r has the ranges [out[r], out[r + 1])."""
    return np.append(np.searchsorted(s, starts), len(s))


def shingle_sets(texts: pa.Array, width: int = 5) -> Iterator[np.ndarray]:
    """For each row the ascending distinct shingle hashes; a row of fewer words has its whole sequence as one."""
    for _, buf, starts, _ in blocks(texts):
        buf = LOWER[buf]
        s, e = spans(buf)
        h, at = hashes(buf, s, e), rows_of(s, starts)
        wide = windows(h, width)
        for a, b in zip(at[:-1], at[1:], strict=True):
            if b - a >= width:
                yield np.unique(wide[a : b - width + 1])
            else:
                yield windows(h[a:b], int(b - a)) if b > a else np.zeros(0, np.uint64)
