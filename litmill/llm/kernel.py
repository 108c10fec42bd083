"""Vectorised text kernels shared by the training-data operators.

Everything works on the UTF-8 bytes of an Arrow string column, many texts at
once.  Texts are taken in blocks of bounded size; a text that is longer than a
block is cut between words, so memory does not grow with the longest text.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa

U64 = np.uint64
BLOCK = 1 << 20

#: The bytes that separate words, space and 0x09-0x0D.
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: For words whose case counts.
AS_IS = np.arange(256, dtype=np.uint8)

IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[list(SPACES)] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: a bijection that spreads every input bit."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


WORD_STEP = U64(0xA0761D6478BD642F)
#: Places of a word whose values are kept in a table.
PLACES = 64


def placed_values(places: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    """A random-looking 64-bit value of each byte at its place in a word."""
    return mix((places.astype(U64) << U64(8) | symbols.astype(U64)) * U64(0x9E3779B97F4A7C15) + U64(1))


_VALUES = placed_values(np.repeat(np.arange(PLACES), 256), np.tile(np.arange(256), PLACES))


def release() -> None:
    """Give memory that is free back to the system: Python workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def tidy(run):
    """A function over batches, or over a group, that releases memory when it is through."""

    def over_batches(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return over_batches


def tidy_group(run):
    def over_group(table):
        try:
            return run(table)
        finally:
            release()

    return over_group


def tidy_pair(run):
    def over_pair(left, right):
        try:
            return run(left, right)
        finally:
            release()

    return over_pair


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(column: pa.Array, most: int = BLOCK, rows: int = 1 << 16):
    """Slices of a text column of about `most` bytes and at most `rows` texts each, as (first, last, bytes, offsets)."""
    data, offsets = text_bytes(column)
    at, n = 0, len(offsets) - 1
    while at < n:
        to = min(at + rows, max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1))
        yield at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def _spans(data: np.ndarray, offsets: np.ndarray, is_gap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of non-gap bytes; runs end where a text ends."""
    inside = ~is_gap[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets[:-1]] = True
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    edge[:] = False
    edge[offsets[1:]] = True
    after = np.empty_like(inside)
    after[-1:] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends


def word_hashes(data: np.ndarray, offsets: np.ndarray, is_gap: np.ndarray = IS_SPACE, case: np.ndarray = LOWER) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every word (A-Z lower-cased by `case`) and the number of words in each text."""
    hashes, where = placed_words(data, offsets, is_gap, case)
    return hashes, np.diff(np.searchsorted(where, offsets, side="left"))


def placed_words(data: np.ndarray, offsets: np.ndarray, is_gap: np.ndarray = IS_SPACE, case: np.ndarray = LOWER) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every word (A-Z lower-cased by `case`) and the byte where it starts."""
    hashes, at = [], []
    for lo, hi in _blocks(data, offsets, is_gap):
        part = case[data[lo:hi]]
        first = np.searchsorted(offsets, lo, side="right")
        last = np.searchsorted(offsets, hi, side="left")
        inner = np.concatenate(([0], offsets[first:last] - lo, [hi - lo]))
        starts, ends = _spans(part, inner, is_gap)
        if not len(starts):
            continue
        size = ends - starts
        first = np.cumsum(size) - size
        letters = part[~is_gap[part]]
        place = np.arange(len(letters)) - np.repeat(first, size)
        value = _VALUES[np.minimum(place, PLACES - 1) << 8 | letters]
        far = np.flatnonzero(place >= PLACES)
        if len(far):
            value[far] = placed_values(place[far], letters[far])
        # A sum of values that depend on byte and place together has no structure that words could share.
        hashes.append(mix(np.add.reduceat(value, first) + size.astype(U64)))
        at.append(starts + lo)
    if not hashes:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(at)


def class_counts(data: np.ndarray, bounds: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """How many bytes of each class lie between neighbouring bounds; classes is a bool table (class, byte)."""
    out = np.zeros((len(classes), len(bounds)), dtype=np.int64)
    for i, members in enumerate(classes):
        member = members.astype(np.uint8)
        carry = 0
        for lo in range(0, len(data), BLOCK):
            part = member[data[lo : lo + BLOCK]]
            a, b = np.searchsorted(bounds, (lo, lo + len(part)), side="right")
            total = np.cumsum(part, dtype=np.int32)
            out[i, a:b] = carry + total[bounds[a:b] - lo - 1]
            carry += int(total[-1])
    return np.diff(out, axis=1)


def _blocks(data: np.ndarray, offsets: np.ndarray, is_gap: np.ndarray):
    lo, n = 0, len(data)
    while lo < n:
        hi = min(n, lo + BLOCK)
        if hi < n:
            k = np.searchsorted(offsets, hi, side="right") - 1
            if offsets[k] > lo:
                hi = int(offsets[k])
            else:
                gaps = np.flatnonzero(is_gap[data[lo:hi]])
                if len(gaps):
                    hi = lo + int(gaps[-1]) + 1
                else:  # one word longer than a block
                    rest = np.flatnonzero(is_gap[data[hi : int(offsets[k + 1])]])
                    hi = hi + int(rest[0]) + 1 if len(rest) else int(offsets[k + 1])
        yield lo, hi
        lo = hi


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of `width` words; a shorter, non-empty text is one run."""
    if not len(words):
        return words
    k = min(width, len(words))
    out = words[: len(words) - k + 1].copy()
    for i in range(1, k):
        out *= WORD_STEP
        out += words[i : len(words) - k + 1 + i]
        out = mix(out)
    return mix(out + U64(k))
