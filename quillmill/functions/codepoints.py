"""Vectorised text kernels over flat code-point arrays.

A batch of texts is one ``uint32`` array of code points and an ``int64`` array of row offsets, so that every step is a
numpy pass over the batch and none is a Python loop over characters. Null texts are rows of length 0.
"""

from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute

LIMIT = 0x110000
U64 = np.uint64


@cache
def core_tables() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: is it a letter, mark or digit; its lower-case form."""
    keep, lower = np.zeros(LIMIT, bool), np.arange(LIMIT, dtype=np.uint32)
    for i in (*range(0x20, 0xD800), *range(0xF900, 0x34000), *range(0xE0000, 0xE0200)):
        ch = chr(i)
        if unicodedata.category(ch)[0] in "LMN":
            keep[i] = True
            low = ch.lower()
            if low != ch and len(low) == 1:
                lower[i] = ord(low)
    return keep, lower


def flatten(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points and row offsets of a string array."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        arr = arr.fill_null("")
    if pa.types.is_large_string(arr.type):
        kind = np.int64
    else:
        arr, kind = arr.cast(pa.string()), np.int32
    if not len(arr):
        return np.zeros(0, np.uint32), np.zeros(1, np.int64)
    _, off, data = arr.buffers()
    off = np.frombuffer(off, kind)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    raw = bytes(data[off[0] : off[-1]]) if data is not None else b""
    codes = np.frombuffer(raw.decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)
    byte = np.frombuffer(raw, np.uint8)
    if len(codes) == len(byte):
        return codes, off - off[0]
    starts = np.zeros(len(byte) + 1, np.int64)
    np.cumsum((byte & 0xC0) != 0x80, out=starts[1:])
    return codes, starts[off - off[0]]


def unflatten(codes: np.ndarray, offs: np.ndarray, valid: np.ndarray | None = None) -> pa.Array:
    """The string array of flat code points; rows that aren't ``valid`` are null."""
    wide = 1 + (codes >= 0x80).astype(np.int64) + (codes >= 0x800) + (codes >= 0x10000)
    ends = np.zeros(len(codes) + 1, np.int64)
    np.cumsum(wide, out=ends[1:])
    data = np.ascontiguousarray(codes, "<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "replace")
    out = pa.LargeStringArray.from_buffers(len(offs) - 1, pa.py_buffer(ends[offs].tobytes()), pa.py_buffer(data)).cast(pa.string())
    if valid is not None and not valid.all():
        out = pa.compute.if_else(pa.array(valid), out, pa.scalar(None, pa.string()))
    return out


def row_of(offs: np.ndarray) -> np.ndarray:
    """The row of each element."""
    return np.repeat(np.arange(len(offs) - 1), np.diff(offs))


def core(codes: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """C(t): letters, marks and digits, each lower-cased, in order."""
    keep, lower = core_tables()
    if len(codes) and (codes == 0x130).any():  # the one letter whose lower case is two code points
        n = np.where(codes == 0x130, 2, 1)
        offs = np.concatenate([[0], np.cumsum(n)])[offs]
        at = np.cumsum(n) - n
        wide = np.repeat(codes, n)
        dotted = at[codes == 0x130]
        wide[dotted], wide[dotted + 1] = 0x69, 0x307
        codes = wide
    mask = keep[codes]
    ends = np.zeros(len(codes) + 1, np.int64)
    np.cumsum(mask, out=ends[1:])
    return lower[codes[mask]], ends[offs]


def select_rows(codes: np.ndarray, offs: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows of ``mask`` only."""
    size = np.diff(offs)
    return codes[np.repeat(mask, size)], np.concatenate([[0], np.cumsum(size[mask])])


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(33)
    x *= U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(29)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(32)
    return x


def row_sums(x: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Sum of each row, modulo 2**64."""
    ends = np.zeros(len(x) + 1, U64)
    np.cumsum(x.astype(U64, copy=False), out=ends[1:])
    return ends[offs[1:]] - ends[offs[:-1]]


def row_hash(codes: np.ndarray, offs: np.ndarray, seed: int = 1) -> np.ndarray:
    """A 64-bit hash of each row that depends on order and length."""
    pos = (np.arange(len(codes)) - np.repeat(offs[:-1], np.diff(offs))).astype(U64)
    each = mix(codes.astype(U64) * U64(0x9E3779B97F4A7C15) + mix(pos + U64(seed << 40)))
    return mix(row_sums(each, offs) + U64(seed) + np.diff(offs).astype(U64) * U64(0xD6E8FEB86659FD93))


def gram_hashes(codes: np.ndarray, offs: np.ndarray, q: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``q`` code points within a row, and the row offsets of these."""
    n = np.maximum(np.diff(offs) - q + 1, 0)
    out = np.concatenate([[0], np.cumsum(n)])
    if not out[-1]:
        return np.zeros(0, U64), out
    h = np.zeros(len(codes) - q + 1, U64)
    for i in range(q):
        h = h * U64(0x9E3779B97F4A7C15) + codes[i : len(codes) - q + 1 + i]
        h ^= h >> U64(31)
    at = np.arange(out[-1]) + np.repeat(offs[:-1] - out[:-1], n)
    return mix(h[at]), out


def as_int64(x: np.ndarray) -> np.ndarray:
    """Unsigned hashes as BIGINT."""
    return x.view(np.int64) if x.dtype == U64 else x.astype(np.int64)


def shared_trigrams(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For row i of either batch: the sizes of intersection and union of the sets of 3-character pieces, exactly."""
    rows = len(a[1]) - 1
    seen = np.zeros(LIMIT, bool)
    seen[a[0]] = seen[b[0]] = True
    dense = np.cumsum(seen) - 1
    bits = max(1, int(dense[-1]).bit_length())
    if 3 * bits + max(1, rows).bit_length() > 64:
        half = rows // 2
        if not half:
            raise ValueError("more than 2**21 distinct characters in one pair")
        parts = []
        for lo, hi in ((0, half), (half, rows)):
            cutpart = [(c[o[lo] : o[hi]], o[lo : hi + 1] - o[lo]) for c, o in (a, b)]
            parts.append(shared_trigrams(*cutpart))
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))

    def keys(codes: np.ndarray, offs: np.ndarray) -> np.ndarray:
        n = np.maximum(np.diff(offs) - 2, 0)
        out = np.concatenate([[0], np.cumsum(n)])
        at = np.arange(out[-1]) + np.repeat(offs[:-1] - out[:-1], n)
        d = dense[codes].astype(U64)
        k = np.repeat(np.arange(rows, dtype=U64), n) << U64(3 * bits)
        for i in range(3):
            k |= d[at + i] << U64(bits * (2 - i))
        k.sort()
        return k[np.concatenate([[True], k[1:] != k[:-1]])] if len(k) else k

    ka, kb = keys(*a), keys(*b)
    both = np.concatenate([ka, kb])
    both.sort()
    twice = both[1:][both[1:] == both[:-1]]
    count = lambda k: np.bincount((k >> U64(3 * bits)).astype(np.int64), minlength=rows)
    inter = count(twice)
    return inter, count(ka) + count(kb) - inter


def take_rows(codes: np.ndarray, offs: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The named rows, in that order, with repeats."""
    size = np.diff(offs)[rows]
    new = np.concatenate([[0], np.cumsum(size)])
    return codes[np.arange(new[-1]) + np.repeat(offs[:-1][rows] - new[:-1], size)], new


def slices(batches, col: str, size: int = 6_000_000):
    """The batches in parts whose texts have at most about ``size`` bytes, so that very long texts don't add up; a longer one comes alone."""
    for batch in batches:
        n = pa.compute.binary_length(batch[col]).fill_null(0).to_numpy(zero_copy_only=False)
        if n.sum() <= size:
            yield batch
            continue
        part = (np.cumsum(n) - 1).clip(0) // size
        edges = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        for a, b in zip(edges, [*edges[1:], len(n)], strict=True):
            yield batch.slice(int(a), int(b - a))
