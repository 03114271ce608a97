"""Vectorised word tables over Arrow string columns.

A *word* is a maximal run of characters outside ``\\x20 \\x09-\\x0D``; every separator is one
ASCII byte, so words are found on UTF-8 bytes. A batch becomes a few numpy arrays (word starts,
ends, 64-bit hashes and per-row word ranges); Python never touches single words.

Word hash: ``sum(T[byte] * P**i)`` over the word modulo 2**64, from a prefix sum and the modular
inverse of ``P``, passed through a 64-bit finaliser. N-gram hashes are polynomials of word hashes.
"""

from __future__ import annotations

import ctypes
import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

CHUNK_BYTES = 4 << 20
_SEGMENT = 1 << 20
_MASK = (1 << 64) - 1
_P = 0x9E3779B97F4A7C15
_PINV = pow(_P, -1, 1 << 64)

IS_SEP = np.zeros(256, dtype=bool)
IS_SEP[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


#: Rows of an Arrow batch of texts, so that batches stay small beside long documents.
BATCH_ROWS = 2000


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], rows: int = BATCH_ROWS) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """An Arrow map that hands freed memory back at its end: workers are reused, and what one task took and freed would
    otherwise stay with the process beside the next one's. The session's Arrow batches are set to ``rows`` rows."""
    if session := SparkSession.getActiveSession():
        session.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
            if trim:
                trim(0)

    return mapped


def one_thread() -> None:
    """Matrix products of this process run on its own thread: a task has one core, and threads that wait for work spin."""
    if not os.path.exists("/proc/self/maps"):
        return
    with open("/proc/self/maps") as maps:
        libraries = {line.split()[-1] for line in maps if "openblas" in line}
    for library in libraries:
        blas = ctypes.CDLL(library)
        for name in ("scipy_openblas_set_num_threads64_", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            if hasattr(blas, name):
                getattr(blas, name)(1)


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (xor-shift, multiply), a bijection."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def mix_int(x: int) -> int:
    return int(mix(np.array([x & _MASK], dtype=np.uint64))[0])


_TABLE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_P))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n + 1:
        size = max(n + 1, _SEGMENT + 4096)
        for k, base in enumerate((_P, _PINV)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0], _powers[1]


@dataclass
class Words:
    """Words of rows ``first .. first + len(bounds) - 1`` of a batch."""

    first: int
    buf: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray
    hashes: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.offsets) - 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def row_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.rows), self.counts)

    def text(self, row: int) -> bytes:
        return self.buf[self.offsets[row] : self.offsets[row + 1]].tobytes()

    def words(self, row: int) -> list[bytes]:
        """The row's words as bytes, unchanged."""
        lo, hi = self.bounds[row], self.bounds[row + 1]
        return [self.buf[s:e].tobytes() for s, e in zip(self.starts[lo:hi], self.ends[lo:hi])]


def _hash_words(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    out = np.empty(len(starts), dtype=np.uint64)
    if not len(starts):
        return out
    table = _TABLE[LOWER] if lower else _TABLE
    cuts = np.unique(np.r_[np.searchsorted(starts, np.arange(0, int(ends[-1]), _SEGMENT)), len(starts)])
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        base, top = int(starts[lo]), int(ends[hi - 1])
        pw, inv = _power_tables(top - base)
        sums = np.empty(top - base + 1, dtype=np.uint64)
        sums[0] = 0
        np.cumsum(table[buf[base:top]] * pw[: top - base], out=sums[1:])
        s = starts[lo:hi] - base
        out[lo:hi] = (sums[ends[lo:hi] - base] - sums[s]) * inv[s]
    return mix(out ^ (ends - starts).astype(np.uint64))


def word_chunks(texts: pa.Array | pa.ChunkedArray, lower: bool = False, chunk_bytes: int = CHUNK_BYTES) -> Iterator[Words]:
    """Yield ``Words`` over consecutive row ranges of about ``chunk_bytes`` each.

    Null texts count as empty. One row is never cut, whatever its length."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_binary())
    n = len(texts)
    offs = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8) if texts.buffers()[2] is not None else np.empty(0, np.uint8)
    row = 0
    while row < n:
        end = int(np.searchsorted(offs, offs[row] + chunk_bytes, side="right")) - 1
        end = min(max(end, row + 1), n)
        buf = data[offs[row] : offs[end]]
        yield _words(row, buf, offs[row : end + 1] - offs[row], lower)
        row = end


def _words(first: int, buf: np.ndarray, offsets: np.ndarray, lower: bool) -> Words:
    n = len(buf)
    if n == 0:
        none = np.empty(0, dtype=np.int64)
        return Words(first, buf, offsets, none, none, np.zeros(len(offsets), np.int64), np.empty(0, np.uint64))
    sep = IS_SEP[buf]
    before = np.empty(n, dtype=bool)
    before[0] = True
    before[1:] = sep[:-1]
    heads = offsets[:-1]
    before[heads[heads < n]] = True
    after = np.empty(n, dtype=bool)
    after[-1] = True
    after[:-1] = sep[1:]
    tails = offsets[1:] - 1
    after[tails[tails >= 0]] = True
    np.logical_not(sep, out=sep)
    starts = np.flatnonzero(sep & before)
    ends = np.flatnonzero(sep & after) + 1
    bounds = np.searchsorted(starts, offsets)
    return Words(first, buf, offsets, starts, ends, bounds, _hash_words(buf, starts, ends, lower))


def gram_hashes(hashes: np.ndarray, n: int, seed: int = 0x51ED27) -> np.ndarray:
    """Hash of each run of ``n`` consecutive word hashes (length ``len(hashes) - n + 1``), row
    bounds ignored. Built by doubling, so a 20-gram costs six multiply-adds."""
    total = len(hashes) - n + 1
    if total <= 0:
        return np.empty(0, dtype=np.uint64)
    q = (mix_int(seed) | 1) & _MASK
    acc, done = None, 0
    block, width = hashes, 1
    left = n
    while left:
        if left & 1:
            acc = block[: len(hashes) - width + 1] if acc is None else acc[: len(hashes) - done - width + 1] + np.uint64(pow(q, done, 1 << 64)) * block[done : done + len(hashes) - done - width + 1]
            done += width
        left >>= 1
        if left:
            m = len(block) - width
            block = block[:m] + np.uint64(pow(q, width, 1 << 64)) * block[width : width + m]
            width *= 2
    return mix(acc[:total] ^ np.uint64(mix_int(seed + n)))


def grams_by_row(w: Words, n: int, seed: int = 0x51ED27) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(row, position in row, hash)`` of every n-gram that lies inside one row, in order."""
    h = gram_hashes(w.hashes, n, seed)
    if not len(h):
        return np.empty(0, np.int64), np.empty(0, np.int64), h
    row = w.row_of_word()
    keep = row[: len(h)] == row[n - 1 : n - 1 + len(h)]
    at = np.flatnonzero(keep)
    r = row[at]
    return r, at - w.bounds[r], h[at]


def strings_to_words(texts: list[str | None], lower: bool = False) -> Words:
    """All words of a short list of texts, as one table."""
    return next(word_chunks(pa.array(["" if t is None else t for t in texts], pa.string()), lower, 1 << 62))
