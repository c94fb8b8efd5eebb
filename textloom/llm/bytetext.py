"""Vectorised work on the UTF-8 bytes of whole Arrow string columns: words, hashes, shingles.

Words are runs of bytes other than 0x20 and 0x09-0x0D. Those bytes never occur inside a multi-byte UTF-8
character, so byte runs equal the character runs of ``[^\\x20\\x09-\\x0D]+``.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]

U64 = np.uint64
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[9, 10, 11, 12, 13, 32]] = True
#: Texts are worked on in slices of at most so many bytes (or one text).
SLICE_BYTES = 1 << 20


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_MIXERS = mix64(np.arange(1001, 1017, dtype=U64)) | U64(1)
_TAILS = np.array([(1 << (8 * n)) - 1 for n in range(9)], U64)


def release() -> None:
    """Gives memory back to the system that the allocators of this process hold for later."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def lean(run: Run) -> Run:
    """run, after which a worker that waits for its next task holds no more than it needs."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return wrapped


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its len+1 offsets into them; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if offsets is None or n == 0:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if large else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cuts a batch between rows, so that each part has at most `most` bytes of text, or one row."""
    raw, at = text_bytes(batch.column(column))
    i, n = 0, batch.num_rows
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield batch.slice(i, j - i), raw[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def word_spans(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each text the number of words before it (len+1)."""
    inside = ~SEPARATOR[raw]
    edge = np.empty(len(raw) + 1, bool)
    edge[:-1] = inside
    edge[1:-1] &= ~inside[:-1]
    begins = at[:-1][at[:-1] < at[1:]]
    edge[begins] = inside[begins]
    starts = np.flatnonzero(edge[:-1])
    edge[:-1] = inside
    edge[: len(raw) - 1][inside[1:]] = False
    lasts = (at[1:] - 1)[at[:-1] < at[1:]]
    edge[lasts] = inside[lasts]
    ends = np.flatnonzero(edge[:-1]) + 1
    return starts, ends, np.searchsorted(starts, at)


def folded(raw: np.ndarray) -> np.ndarray:
    """The bytes with A-Z lower-cased."""
    return _FOLD[raw]


def span_chunks(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all spans as little-endian numbers of eight bytes, each span's last one filled up with zeros, and the
    number of them before each span (len+1)."""
    sizes = ends - starts
    counts = (sizes + 7) >> 3
    before = np.concatenate(([0], np.cumsum(counts)))
    owner = np.repeat(np.arange(len(starts)), counts)
    place = (np.arange(before[-1]) - before[owner]) << 3
    padded = np.concatenate((raw, np.zeros(8, np.uint8)))
    eights = np.ndarray(len(raw) + 1, "<u8", padded, strides=(1,))
    return eights[starts[owner] + place] & _TAILS[np.minimum(sizes[owner] - place, 8)], before


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, chunks: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """A 64-bit hash of each span: of every eight bytes, mixed with their place in the span, the sum; and of the size.
    The mixer is not linear, so equal parts in another order or repeated patterns do not cancel out."""
    values, before = chunks or span_chunks(raw, starts, ends)
    owner = np.repeat(np.arange(len(starts)), np.diff(before))
    values = mix64(values + mix64((np.arange(len(values)) - before[owner]).astype(U64) + U64(0x9E3779B97F4A7C15)))
    sums = np.concatenate(([U64(0)], np.cumsum(values, dtype=U64)))
    return mix64(sums[before[1:]] - sums[before[:-1]] + (ends - starts).astype(U64) * _MIXERS[15])


def distinct_spans(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the distinct spans, one example of each, and for each span its place among them. Spans of one hash are
    compared by their bytes; where two differ, all are told apart by their bytes instead."""
    chunks = span_chunks(raw, starts, ends)
    keys, example, place = np.unique(span_hashes(raw, starts, ends, chunks), return_index=True, return_inverse=True)
    values, before = chunks
    twin, counts = example[place], np.diff(before)
    same = bool((ends - starts == (ends - starts)[twin]).all())
    if same and len(values):
        owner = np.repeat(np.arange(len(starts)), counts)
        same = np.array_equal(values, values[before[twin[owner]] + np.arange(len(values)) - before[owner]])
    if not same:
        body = raw.tobytes()
        found: dict[bytes, int] = {}
        place = np.array([found.setdefault(body[s:e], len(found)) for s, e in zip(starts.tolist(), ends.tolist())], np.int64)
        example = np.unique(place, return_index=True)[1]
        keys = span_hashes(raw, starts[example], ends[example])
    return keys, example, place


def gather(raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The bytes of spans, one after another."""
    ends = np.cumsum(sizes)
    return raw[np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)]


def shingle_hashes(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles, and for each text the number before it. A text with 1 to k-1 words has its
    whole word sequence as the one shingle; one without words has none."""
    counts = np.diff(first)
    per = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    offset = np.concatenate(([0], np.cumsum(per)))
    n = len(words)
    joint = np.zeros(max(n - k + 1, 0), U64)
    for j in range(k):
        joint += words[j : n - k + 1 + j] * _MIXERS[j]
    owner = np.repeat(np.arange(len(per)), per)
    begin = first[:-1][owner] + np.arange(offset[-1]) - offset[:-1][owner]
    out = np.zeros(offset[-1], U64)
    full = counts[owner] >= k
    out[full] = joint[begin[full]]
    for i in np.flatnonzero((counts > 0) & (counts < k)):
        w = words[first[i] : first[i + 1]]
        out[offset[i]] = np.append(w * _MIXERS[: len(w)], _MIXERS[14 - len(w)]).sum(dtype=U64)
    return mix64(out), offset


def distinct(values: np.ndarray) -> np.ndarray:
    """The distinct values, ascending. (Sorting beats hashing at the length of a document.)"""
    values = np.sort(values)
    if len(values) < 2:
        return values
    keep = np.empty(len(values), bool)
    keep[0] = True
    np.not_equal(values[1:], values[:-1], out=keep[1:])
    return values[keep]


def shingle_sets(raw: np.ndarray, at: np.ndarray, k: int) -> list[np.ndarray]:
    """For each text the ascending distinct hashes of its k-word shingles, words with A-Z lower-cased."""
    starts, ends, first = word_spans(raw, at)
    hashes, offset = shingle_hashes(span_hashes(folded(raw), starts, ends), first, k)
    return [distinct(hashes[offset[i] : offset[i + 1]]) for i in range(len(offset) - 1)]
