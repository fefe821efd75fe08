"""Vectorised word and shingle hashing over UTF-8 buffers.

A word is a run of bytes outside space, tab, line feed, vertical tab, form
feed and carriage return; A-Z are lower-cased and nothing else changes.  All
arithmetic is modulo 2**64 on numpy arrays, so one call handles a block of
texts without a Python loop over words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Texts are handled in blocks of about this many bytes, to bound memory.
BLOCK_BYTES = 1 << 20

_SEPARATORS = np.zeros(256, bool)
_SEPARATORS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
#: By n, a number whose lowest n bytes are set.
_LOW_BYTES = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_POWERS = np.ones(1 << 16, np.uint64)
_POWERS[1:] = _MULTIPLIER
_POWERS = np.multiply.accumulate(_POWERS)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    while len(_POWERS) < n:
        _POWERS = np.concatenate([_POWERS, _POWERS * (_POWERS[-1] * _MULTIPLIER)])
    return _POWERS


def blocks(text: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts have about ``limit`` bytes together; one row at least."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes.astype(np.int64))
    start = 0
    while start < len(sizes):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield start, stop
        start = stop


def by_blocks(batches: Iterator[pa.RecordBatch], text_of, convert, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """``convert`` of each block of rows; at the end of the partition, memory that the allocators hold goes back to the system."""
    for batch in batches:
        for lo, hi in blocks(text_of(batch), limit):
            yield convert(batch.slice(lo, hi - lo))
    pa.default_memory_pool().release_unused()
    _trim()


def _trim() -> None:
    """Workers live on between tasks; where the C library can, it gives back what they no longer use."""
    import ctypes

    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def bounded_batches(spark, rows: int = 2000) -> None:
    """Lower the session's rows in an Arrow batch, unless they are lower already: whole texts make wide rows."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) > rows:
        spark.conf.set(name, str(rows))


def buffer_of(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, each followed by a separator, and the offsets of the texts."""
    data = [b"" if x is None else x for x in text.cast(pa.large_binary()).to_pylist()]
    sizes = np.fromiter((len(x) + 1 for x in data), np.int64, len(data))
    return np.frombuffer(b"\n".join([*data, b""]), np.uint8), np.concatenate([[0], np.cumsum(sizes)])


def word_hashes(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in order, and offsets: text i has words offsets[i] to offsets[i + 1]."""
    raw, ends = buffer_of(text)
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(len(ends), np.int64)
    inside = ~_SEPARATORS[raw]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).view(np.int8)))
    starts, stops = edge[::2], edge[1::2]
    offsets = np.searchsorted(starts, ends)
    if not len(starts):
        return np.zeros(0, np.uint64), offsets
    sizes = stops - starts
    # eight bytes are one number; numbers are mixed with their place before they are added, so no pattern of letters cancels out
    parts = (sizes + 7) // 8
    first = np.cumsum(parts) - parts
    within = np.arange(int(parts.sum())) - np.repeat(first, parts)
    at = np.repeat(starts, parts) + 8 * within
    left = np.minimum(np.repeat(sizes, parts) - 8 * within, 8)
    lower = np.concatenate([_LOWER[raw], np.zeros(7, np.uint8)])
    chunks = np.lib.stride_tricks.sliding_window_view(lower, 8)[at].view("<u8").ravel() & _LOW_BYTES[left]
    values = mix(chunks ^ mix((within.astype(np.uint64) + np.uint64(1)) * _MULTIPLIER))
    return mix(np.add.reduceat(values, first) + sizes.astype(np.uint64)), offsets


def shingle_hashes(text: pa.Array, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``width`` words of all texts, repeats included, and offsets.

    A text with fewer words has its whole sequence as its one shingle; a text
    without words has none.
    """
    words, offsets = word_hashes(text)
    n = len(words)
    counts = np.diff(offsets)
    rolled = np.zeros(n, np.uint64)
    for k in range(width):
        rolled[: n - k or None] += words[k:] * _powers(width + 1)[width - k] if k < n else np.uint64(0)
    rolled = mix(rolled + np.uint64(width))
    doc = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(n) - offsets[:-1][doc]
    keep = place <= counts[doc] - width
    short = np.flatnonzero((counts > 0) & (counts < width))
    keep[offsets[short]] = True
    for i in short:
        own = words[offsets[i] : offsets[i + 1]]
        rolled[offsets[i]] = mix(np.array([(own * _powers(width + 1)[width : width - len(own) : -1]).sum() + np.uint64(len(own))], np.uint64))[0]
    got = np.where(counts == 0, 0, np.maximum(1, counts - width + 1))
    return rolled[keep], np.concatenate([[0], np.cumsum(got)])


def shingle_sets(text: pa.Array, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """As shingle_hashes, but each text has each of its shingles once, in rising order."""
    hashes, offsets = shingle_hashes(text, width)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    order = np.lexsort((hashes, doc))
    hashes, doc = hashes[order], doc[order]
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    return hashes[fresh], np.concatenate([[0], np.cumsum(np.bincount(doc[fresh], minlength=len(offsets) - 1))])
