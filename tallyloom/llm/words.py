"""Word splitting and hashing over Arrow string columns, vectorised with numpy.

Used inside Arrow tasks by the operators that work on word sequences. A word is a maximal run of bytes for which
``table[byte]`` is true; words never cross documents. A word's identity is a 64-bit hash of its bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_C1, _C2, _C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def not_space() -> np.ndarray:
    """Bytes of words ``[^\\x20\\x09-\\x0D]+``."""
    t = np.ones(256, bool)
    t[[0x20, *range(0x09, 0x0E)]] = False
    return t


def alphanumeric() -> np.ndarray:
    """Bytes of words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of text in which A-Z is lower-cased."""
    t = np.zeros(256, bool)
    for lo, hi in ((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF)):
        t[lo : hi + 1] = True
    return t


def lower_ascii() -> np.ndarray:
    """Byte map that lower-cases A-Z only."""
    t = np.arange(256, dtype=np.uint8)
    t[0x41:0x5B] += 0x20
    return t


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls count as empty. offsets has one entry more than the column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    column = column.cast(pa.large_binary()).fill_null(b"")
    n = len(column)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8) if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def split(raw: np.ndarray, at: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte of each word, its end, first word of each document with the total appended)."""
    n = len(raw)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(at), np.int64)
    inside = table[raw]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cut = at[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    first[cut] = inside[cut]
    last[cut - 1] = inside[cut - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, at)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x *= _C2
    x ^= x >> np.uint64(27)
    x *= _C3
    x ^= x >> np.uint64(31)
    return x


def hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte run: one-to-one up to 8 bytes of one length, mixed 8 bytes at a time beyond."""
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    loads = np.ndarray((len(raw) + 1,), "<u8", padded.data, strides=(1,))
    size = ends - starts
    keep = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], np.uint64)
    out = mix((loads[starts] & keep[np.minimum(size, 8)]) + _C1 * size.astype(np.uint64))
    rest, done = np.flatnonzero(size > 8), 8
    while len(rest):
        more = loads[starts[rest] + done] & keep[np.minimum(size[rest] - done, 8)]
        out[rest] = mix((out[rest] * _C1) ^ more)
        done += 8
        rest = rest[size[rest] > done]
    return out


def combine(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k consecutive words of one flat sequence (len - k + 1 values, document ends ignored)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, have = words, 1  # out[i]: hash of words i .. i + have - 1
    for bit in bin(k)[3:]:
        m = len(words) - 2 * have + 1
        out, have = mix(out[:m] * _C1 + mix(out[have : have + m])), 2 * have
        if bit == "1":
            m = len(words) - have
            out, have = mix(out[:m] * _C1 + words[have : have + m]), have + 1
    return out


def whole(per_doc: np.ndarray, k: int) -> np.ndarray:
    """For first-word offsets per_doc: starts of those runs of k words that lie inside one document."""
    if per_doc[-1] < k:
        return np.zeros(0, np.int64)
    ok = np.ones(per_doc[-1], bool)
    for j in range(1, k):
        bad = per_doc[1:] - j
        ok[bad[bad >= per_doc[:-1]]] = False
    return np.flatnonzero(ok)
