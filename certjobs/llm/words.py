"""Words and word n-grams of whole texts as 64-bit hashes, computed with numpy inside Spark's Arrow tasks."""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes hashed at a time; longer words are hashed whole by blake2b.
CHUNK = 1 << 20
#: Bytes of text per slice of a batch, beyond which a slice has a single text.
SLICE = 1 << 22


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64's)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int) -> np.ndarray:
    out = np.full(CHUNK + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_BASE = 0x9E3779B97F4A7C15
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_POW: np.ndarray | None = None
_INV: np.ndarray | None = None

_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)

_ALL = np.arange(256)
#: Bytes of a word, when words are `[^\x20\x09-\x0D]+`.
NOT_SPACE = ~((_ALL == 0x20) | ((_ALL >= 0x09) & (_ALL <= 0x0D)))
#: Bytes of a word, when words are `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` of lower-cased text.
ALNUM = ((_ALL >= 0x30) & (_ALL <= 0x39)) | ((_ALL >= 0x61) & (_ALL <= 0x7A)) | (_ALL >= 0x80)
#: A-Z to a-z, byte by byte.
LOWER = np.where((_ALL >= 0x41) & (_ALL <= 0x5A), _ALL + 32, _ALL).astype(np.uint8)


@dataclass
class Words:
    """The words of some rows: ``buf[starts[i]:ends[i]]`` is word i; row r has words ``cuts[r]`` to ``cuts[r + 1]``."""

    first: int
    rows: int
    buf: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    cuts: np.ndarray
    hashes: np.ndarray

    def word(self, i: int) -> bytes:
        return self.buf[self.starts[i] : self.ends[i]].tobytes()


def hash_words(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    global _POW, _INV
    if _POW is None:
        _POW, _INV = _powers(_BASE), _powers(pow(_BASE, -1, 1 << 64))
    out, i, n = np.empty(len(starts), np.uint64), 0, len(starts)
    while i < n:
        base = int(starts[i])
        j = int(np.searchsorted(ends, base + CHUNK, "right"))
        if j <= i:  # a word longer than a chunk
            out[i] = int.from_bytes(hashlib.blake2b(buf[base : int(ends[i])].tobytes(), digest_size=8).digest(), "little")
            i += 1
            continue
        part = buf[base : int(ends[j - 1])]
        sums = np.empty(len(part) + 1, np.uint64)
        sums[0] = 0
        np.cumsum(_BYTE[part] * _POW[: len(part)], out=sums[1:])
        s, e = starts[i:j] - base, ends[i:j] - base
        out[i:j] = mix((sums[e] - sums[s]) * _INV[s] + (e - s).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
        i = j
    return out


def grams(hashes: np.ndarray, k: int, seed: int = 0x8CB92BA72F3D8DD7) -> np.ndarray:
    """Hashes of every k consecutive words, whatever rows they come from."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, seed + 2 * k, np.uint64)
    for j in range(k):
        out = out * np.uint64(0xE7037ED1A0B428DB) + hashes[j : j + n]
    return mix(out)


def whole(hashes: np.ndarray, seed: int) -> int:
    """One hash of a whole sequence, order kept."""
    n = len(hashes)
    if not n:
        return 0
    x = mix(hashes ^ (np.arange(1, n + 1, dtype=np.uint64) * np.uint64(seed)))
    return int(mix(np.array([x.sum(dtype=np.uint64) + np.uint64(n)], np.uint64))[0])


def signed(x) -> np.ndarray:
    return np.asarray(x, np.uint64).view(np.int64)


def slices(column: pa.Array | pa.ChunkedArray, kind: np.ndarray, lower: bool, size: int = SLICE) -> Iterator[Words]:
    """The words of a string column, a slice of rows of about ``size`` bytes at a time; null counts as empty."""
    arr = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    arr = pc.fill_null(arr, "") if arr.null_count else arr
    if not len(arr):
        return
    wide = pa.types.is_large_string(arr.type)
    offsets = np.frombuffer(arr.buffers()[1], np.int64 if wide else np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    data = np.frombuffer(arr.buffers()[2], np.uint8) if arr.buffers()[2] is not None and arr.buffers()[2].size else np.empty(0, np.uint8)
    r = 0
    while r < len(arr):
        to = max(r + 1, int(np.searchsorted(offsets, offsets[r] + size, "right")) - 1)
        buf, cuts = data[offsets[r] : offsets[to]], offsets[r : to + 1] - offsets[r]
        if lower:
            buf = LOWER[buf]
        inside = kind[buf]
        before, after = np.zeros(len(buf), bool), np.zeros(len(buf), bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        before[cuts[:-1][cuts[:-1] < len(buf)]] = False
        after[cuts[1:][cuts[1:] > 0] - 1] = False
        starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
        yield Words(r, to - r, buf, starts, ends, np.searchsorted(starts, cuts), hash_words(buf, starts, ends))
        r = to
    release()


def release() -> None:
    """Give freed memory back to the system, as Python workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)
