"""Vectorised text kernels shared by the corpus operators.

Everything here works on Arrow string buffers with NumPy, never on one Python
string at a time.  A *word* is a maximal run of ASCII letters, digits,
underscores and non-ASCII characters of the lower-cased text; words and
n-grams are identified by 64-bit (n-grams: 54-bit) hashes.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

_WORD = np.zeros(256, dtype=bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), 95, *range(128, 256)]] = True
_RNG = np.random.default_rng(20_240_229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
#: Longest run of bytes that is hashed by powers; a longer one is hashed by xxhash.
POWERS = 1024
_POW = np.cumprod(np.full(POWERS, 0x9E3779B97F4A7C15, dtype=np.uint64))
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Bits of an n-gram hash; the ten bits above them number documents inside a block.
GRAM_BITS = 54
BLOCK_DOCS = 1 << (64 - GRAM_BITS)
BLOCK_BYTES = 400_000
try:
    _LIBC = ctypes.CDLL("libc.so.6")
except OSError:  # another C library
    _LIBC = None


def release() -> None:
    """Give freed memory back to the system: Python workers outlive their tasks and share the executor's limit."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


def runs(data: np.ndarray, byte: np.ndarray | None, first: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Hash of each run of bytes. byte: places of the runs' bytes in data, one run after another (None: all of data); first, start: where a run begins in byte, and in data."""
    value = _BYTE[data if byte is None else data[byte]]
    value *= _POW[(np.arange(len(value), dtype=np.int64) - np.repeat(first, length)) & (POWERS - 1)]
    hashed = mix(np.add.reduceat(value, first) + length.astype(np.uint64))
    for i in np.flatnonzero(length > POWERS):
        hashed[i] = xxhash.xxh64_intdigest(data[start[i] : start[i] + length[i]].tobytes())
    return hashed


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null counts as an empty text."""
    if column.null_count:
        column = column.fill_null("")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, dtype=np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(column: pa.Array, max_docs: int = BLOCK_DOCS, max_bytes: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, bytes, offsets) of runs of rows of bounded size; a longer text is a run of its own."""
    data, offsets = string_buffers(column)
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + max_bytes, "right")) - 1
        last = min(max(last, first + 1), first + max_docs, rows)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text number, first byte, length) of each word, in order."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, none
    inside = _WORD[data]
    edge = np.empty(len(data), dtype=bool)
    edge[0] = True
    np.not_equal(inside[1:], inside[:-1], out=edge[1:])
    cuts = offsets[1:-1]
    edge[cuts[cuts < len(data)]] = True
    at = np.flatnonzero(edge)
    length = np.diff(at, append=len(data))
    keep = inside[at]
    start, length = at[keep], length[keep]
    if not len(start):
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, none
    byte = np.flatnonzero(inside)
    hashed = runs(data, byte, np.cumsum(length) - length, start, length)
    return hashed, np.searchsorted(offsets, start, "right") - 1, start, length


def raw_grams(hashed: np.ndarray, doc: np.ndarray, docs: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(64-bit hash, text number, first word) of each n-gram.

    A text of 1 to n-1 words has one gram, of all its words; one without words has none.
    """
    counts = np.bincount(doc, minlength=docs)
    first = np.cumsum(counts) - counts
    gram, owner, at = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(hashed) >= n:
        gram = hashed[: len(hashed) - n + 1].copy()
        for k in range(1, n):
            gram = gram * np.uint64(0x9E3779B97F4A7C15) + (hashed[k : len(hashed) - n + 1 + k] ^ np.uint64(k))
        at = np.flatnonzero(doc[: len(hashed) - n + 1] == doc[n - 1 :])
        gram, owner = mix(gram[at]), doc[at]
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        tail = np.array([np.bitwise_xor.reduce(mix(hashed[first[d] : first[d] + counts[d]] + np.arange(counts[d], dtype=np.uint64))) for d in short], dtype=np.uint64)
        gram, owner, at = np.concatenate([gram, tail]), np.concatenate([owner, short]), np.concatenate([at, first[short]])
    return gram, owner, at


def distinct(key: np.ndarray, owner: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys (GRAM_BITS wide) of each text, ascending, and each text's offset into them."""
    if docs > BLOCK_DOCS:
        raise ValueError("too many texts in a block")
    packed = (owner.astype(np.uint64) << np.uint64(GRAM_BITS)) | key
    packed.sort()
    if len(packed):
        packed = packed[np.concatenate([[True], packed[1:] != packed[:-1]])]
    bounds = np.arange(docs, dtype=np.uint64) << np.uint64(GRAM_BITS)
    return packed & np.uint64((1 << GRAM_BITS) - 1), np.append(np.searchsorted(packed, bounds), len(packed))


def grams(hashed: np.ndarray, doc: np.ndarray, docs: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes (GRAM_BITS wide) of each text, ascending, and each text's offset into them."""
    gram, owner, _ = raw_grams(hashed, doc, docs, n)
    return distinct(gram >> np.uint64(64 - GRAM_BITS), owner, docs)
