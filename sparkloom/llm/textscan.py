"""Vectorised scanning of Arrow string columns: blocks of texts as byte arrays, runs of bytes, hashes of runs.

Everything works on a block of whole texts laid end to end, so the cost of numpy calls is shared by many texts; a block
ends at a text's end, and one text longer than the block size is a block of its own.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_LIBC = None
with contextlib.suppress(OSError, AttributeError):  # only where the C library is glibc
    _LIBC = ctypes.CDLL("libc.so.6")
    _LIBC.malloc_trim  # noqa: B018
_RNG = np.random.Generator(np.random.PCG64(20240607))
BYTE_KEYS = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
BASE = U(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
BASE_INV = U(pow(0x9E3779B97F4A7C15, -1, 2**64))

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of text in a block: numpy's arrays over a block take many times as much, and an executor has several workers.
BLOCK_BYTES = 1 << 19

_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**0.. and its inverses, at least n of each."""
    if len(_powers.get("up", ())) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for name, base in (("up", BASE), ("down", BASE_INV)):
            x = np.full(size, base, U)
            x[0] = 1
            _powers[name] = np.cumprod(x, dtype=U)
    return _powers["up"], _powers["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U(27))
    h = h * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def give_back() -> None:
    """Return freed memory to the system, and the powers, which are soon made again: a Python worker goes on to other tasks or
    waits for some, and what it keeps for itself others lack."""
    _powers.clear()
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def blocks(batches: Iterator[pa.RecordBatch], column: str, most: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows with about ``most`` bytes of text each; freed memory is given back when they end."""
    yield from _blocks(batches, column, most)
    give_back()


def _blocks(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        offs = text_offsets(batch.column(column))
        i = 0
        while i < n:
            j = int(np.searchsorted(offs, offs[i] + most, "right")) - 1
            j = min(n, max(i + 1, j))
            yield batch.slice(i, j - i)
            i = j


def text_offsets(col: pa.Array) -> np.ndarray:
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    kind = np.int64 if wide else np.int32
    return np.frombuffer(col.buffers()[1], kind, len(col) + 1, col.offset * np.dtype(kind).itemsize).astype(np.int64)


def raw(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the texts end to end, and where each begins; null texts are empty."""
    if col.null_count:
        col = col.fill_null("" if not pa.types.is_binary(col.type) else b"")
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = text_offsets(col)
    data = col.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[offs[0] : offs[-1]], offs - offs[0]


def runs(mark: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of marked bytes; no run crosses from one text to the next."""
    if not len(mark):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    begin, end = mark.copy(), mark.copy()
    begin[1:] &= ~mark[:-1]
    end[:-1] &= ~mark[1:]
    edge = offs[1:-1]
    edge = edge[(edge > 0) & (edge < len(mark))]
    begin[edge] = mark[edge]
    end[edge - 1] = mark[edge - 1]
    return np.flatnonzero(begin), np.flatnonzero(end) + 1


def owners(starts: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Which text each start lies in."""
    return np.searchsorted(offs, starts, "right") - 1


def hash_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, the same wherever it stands."""
    up, down = powers(len(buf) + 1)
    sums = np.zeros(len(buf) + 1, U)
    np.cumsum(BYTE_KEYS[buf] * up[: len(buf)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U) * U(0xD6E8FEB86659FD93))


def words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and owners of the words [^\\x20\\x09-\\x0D]+."""
    starts, ends = runs(~SPACE[buf], offs)
    return starts, ends, owners(starts, offs)


def windows(h: np.ndarray, owner: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every ``size`` neighbouring values that have one owner, and the index of the first of each."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, U), np.zeros(0, np.int64)
    first = np.flatnonzero(owner[:n] == owner[size - 1 :])
    out = np.zeros(n, U)
    for k in range(size):  # the values are hashes already; each place has an odd factor of its own
        out += h[k : k + n] * U(0x9E3779B97F4A7C15 ** (k + 1) % 2**64)
    return mix(out[first]), first


def ngrams(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, least: int, most: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets (below 2**bits) of the n-grams of ``least`` to ``most`` bytes of each span, end to end, and where each span's
    begin.  A span counts with a mark before it and one behind it."""
    lens = ends - starts + 2
    offs = segments(lens)
    src = np.arange(offs[-1]) - np.repeat(offs[:-1], lens) - 1
    inner = (src >= 0) & (src < np.repeat(ends - starts, lens))
    flat = np.full(offs[-1], ord("<"), np.uint8)
    flat[offs[1:] - 1] = ord(">")
    flat[inner] = buf[(np.repeat(starts, lens) + src)[inner]]
    left = np.repeat(offs[1:], lens) - np.arange(offs[-1])  # bytes to the span's end
    span = np.repeat(np.arange(len(lens)), lens)
    h = np.zeros(offs[-1], U)
    grams, owner = [], []
    for k in range(most):
        h[: max(0, offs[-1] - k)] = (h[: max(0, offs[-1] - k)] + BYTE_KEYS[flat[k:]]) * BASE
        if k + 1 >= least:
            ok = left > k
            grams.append((mix(h[ok]) >> U(64 - bits)).astype(np.int32))
            owner.append(span[ok])
    grams, owner = np.concatenate(grams), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return grams[order], np.searchsorted(owner[order], np.arange(len(lens) + 1))


def segments(counts: np.ndarray) -> np.ndarray:
    """Offsets from counts."""
    out = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=out[1:])
    return out


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
