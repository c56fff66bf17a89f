"""Words and word shingles of whole Arrow columns as 64-bit hashes, computed with numpy over the UTF-8 bytes.

No Python object is made for a word. The hash of a word is a polynomial over its bytes modulo 2**64 (by prefix sums),
mixed with its length; a shingle mixes the hashes of its words in order.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BASE = 0x9E3779B97F4A7C15 | 1
_U = np.uint64

#: The bytes of ``[\x20\x09-\x0D]``.
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: All ASCII bytes but letters and digits: words without punctuation.
PUNCTUATION = np.zeros(256, bool)
PUNCTUATION[:128] = True
PUNCTUATION[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False
#: A-Z to a-z.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32

#: Bytes that one step of hashing takes.
PIECE = 1 << 19

_powers: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least ``n`` of each."""
    if not _powers or len(_powers["up"]) < n:
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            table = np.full(max(n, 1 << 16), base, _U)
            table[0] = 1
            _powers[name] = np.multiply.accumulate(table)
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that near values end far apart."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def slices(batch: pa.RecordBatch, columns: tuple[str, ...], most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about ``most`` bytes of text, so that memory doesn't follow the batch size."""
    if not batch.num_rows:
        return
    size = np.zeros(batch.num_rows, np.int64)
    for name in columns:
        size += pc.fill_null(pc.binary_length(batch.column(name)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    piece = np.cumsum(size + 64) // most
    cuts = np.flatnonzero(np.diff(piece)) + 1
    for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
        yield batch.slice(int(a), int(b - a))


def release() -> None:
    """Give free memory back to the system, at the end of a task: a Python worker goes on to other tasks and operators."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts and the offset of each (one more than texts); null counts as empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _spans(column: pa.Array, separators: np.ndarray) -> tuple[np.ndarray, ...]:
    """``(data, bounds, start, end)``: the words of text ``i`` are ``bounds[i]:bounds[i + 1]``, each with its first byte and the
    one behind it."""
    data, offsets = text_bytes(column)
    inside = ~separators[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    heads = offsets[:-1][np.diff(offsets) > 0]
    tails = offsets[1:][np.diff(offsets) > 0] - 1
    first[heads] = inside[heads]
    last[tails] = inside[tails]
    start = np.flatnonzero(first)
    return data, np.searchsorted(start, offsets), start, np.flatnonzero(last) + 1


def _hashed(data: np.ndarray, start: np.ndarray, end: np.ndarray, fold: np.ndarray) -> np.ndarray:
    """The hashes of spans of bytes, which ascend: by prefix sums over PIECE bytes at a time (or one longer word), so that
    a very long text takes little more than its words."""
    out, k = np.zeros(len(start), _U), 0
    while k < len(start):
        stop = max(k + 1, int(np.searchsorted(end, start[k] + PIECE, "right")))
        low, high = int(start[k]), int(end[k:stop].max())
        up, down = _power_tables(high - low)
        total = np.zeros(high - low + 1, _U)
        np.cumsum((fold[data[low:high]].astype(_U) + _U(1)) * up[: high - low], out=total[1:])
        a, b = start[k:stop] - low, end[k:stop] - low
        out[k:stop] = mix((total[b] - total[a]) * down[a] ^ ((b - a).astype(_U) * _U(0xD6E8FEB86659FD93)))
        k = stop
    return out


def words(column: pa.Array, separators: np.ndarray = SPACES, fold: np.ndarray = FOLD) -> tuple[np.ndarray, np.ndarray]:
    """``(bounds, hashes)``: the words of text ``i`` are ``hashes[bounds[i]:bounds[i + 1]]``."""
    data, bounds, start, end = _spans(column, separators)
    return bounds, _hashed(data, start, end, fold)


def beginnings(column: pa.Array, sizes: tuple[int, ...], separators: np.ndarray = SPACES, fold: np.ndarray = FOLD) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """``(bounds, kinds)``: bounds as of ``words``; kinds has the places of all words and their hashes and then, for each of
    ``sizes``, the places of the words with more bytes and the hashes of their first so many bytes."""
    data, bounds, start, end = _spans(column, separators)
    kinds = [(np.arange(len(start)), _hashed(data, start, end, fold))]
    for size in sizes:
        at = np.flatnonzero(end - start > size)
        kinds.append((at, _hashed(data, start[at], start[at] + size, fold)))
    return bounds, kinds


def ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places ``first[k], ..., first[k] + size[k] - 1`` of all ``k`` in order."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - size), size)


def _multipliers(k: int) -> np.ndarray:
    return mix(np.arange(1, k + 1, dtype=_U) * _U(0x9E3779B97F4A7C15)) | _U(1)


def rolling(hashes: np.ndarray, k: int) -> np.ndarray:
    """The hash of each run of ``k`` words of the whole array; runs across two texts are for the caller to leave out."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, _U)
    out = np.zeros(n, _U)
    for j, m in enumerate(_multipliers(k)):
        out += hashes[j : j + n] * m
    return mix(out)


def shingle_sets(bounds: np.ndarray, hashes: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct shingles of ``k`` words; a shorter text has its whole sequence as one."""
    runs = rolling(hashes, k)
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a >= k:
            yield np.unique(runs[a : b - k + 1])
        elif b > a:
            yield rolling(hashes[a:b], int(b - a)) ^ _U(int(b - a))
        else:
            yield np.zeros(0, _U)
