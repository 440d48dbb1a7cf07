"""Array views of text columns, shared by the operators that run inside Arrow tasks.

A batch of texts is one flat byte buffer plus row offsets, so that cutting words,
hashing them and hashing every window of them are a handful of numpy passes over
the batch instead of a Python loop over words.  Nothing here starts Spark jobs.
"""

from __future__ import annotations

import ctypes
import functools
import inspect

import numpy as np
import pyarrow as pa
import xxhash

#: ASCII white space that separates words: space and 0x09 to 0x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
#: Words of more bytes are hashed one by one.
LONG_WORD = 64
_powers: dict[int, np.ndarray] = {}


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and int64 offsets of its rows; a null row has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(offsets: np.ndarray, most: int = 1 << 20):
    """(first row, end row) of runs of rows with about `most` bytes; a longer row is a run of its own."""
    first, n = 0, len(offsets) - 1
    while first < n:
        end = int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1
        end = min(n, max(end, first + 1))
        yield first, end
        first = end


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def mix2(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64-bit hash of an ordered pair of hashes."""
    return mix(a * np.uint64(0xD6E8FEB86659FD93) + (b ^ np.uint64(0xA0761D6478BD642F)) * np.uint64(0xE7037ED1A0B428DB))


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """The first n powers of the hash base, or of its inverse modulo 2**64."""
    have = _powers.get(inverse)
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << int(n - 1).bit_length())
        have = np.full(size, _BASE_INVERSE if inverse else _BASE, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if size <= 1 << 22:
            _powers[inverse] = have
    return have[:n]


def _sums(values: np.ndarray) -> np.ndarray:
    out = np.empty(len(values) + 1, np.uint64)
    out[0] = 0
    np.cumsum(values * powers(len(values)), out=out[1:])
    return out


def spans(buffer: np.ndarray, offsets: np.ndarray, separator: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word of the rows, and where each row's words begin (one more than rows)."""
    inside = ~separator[buffer]
    edge = np.zeros(len(buffer) + 1, bool)
    edge[1:-1] = inside[1:] != inside[:-1]
    if len(buffer):
        edge[0], edge[-1] = inside[0], inside[-1]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(buffer))]
    joined = np.unique(cut[inside[cut - 1] & inside[cut]]) if len(cut) else cut  # a word ends and another begins at the same byte
    at = np.flatnonzero(edge)
    if len(joined):
        at = np.sort(np.concatenate([at, joined, joined]), kind="stable")
    start, end = at[0::2], at[1::2]
    return start, end, np.searchsorted(start, offsets)


def word_hashes(buffer: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash of each word's bytes; hashes of another seed are independent of these.

    Eight bytes at a time are mixed into the hash, so what a word looks like doesn't matter.
    """
    size = end - start
    out = mix(size.astype(np.uint64) + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
    padded = np.concatenate([buffer, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(buffer) + 1,), "<u8", padded.data, strides=(1,))  # the eight bytes from each byte on
    own = np.arange(len(start)) if size.max(initial=0) <= LONG_WORD else np.flatnonzero(size <= LONG_WORD)
    for k in range(0, LONG_WORD, 8):
        if k:
            own = own[size[own] > k]
        if not len(own):
            break
        part, left = eight[start[own] + k], size[own] - k
        cut = np.flatnonzero(left < 8)
        part[cut] &= (np.uint64(1) << (left[cut] * 8).astype(np.uint64)) - np.uint64(1)
        out[own] = mix2(out[own], part)
    for i in np.flatnonzero(size > LONG_WORD):
        out[i] = xxhash.xxh3_64_intdigest(padded[start[i] : end[i]], seed)
    return out


def numbered(buffer: np.ndarray, start: np.ndarray, end: np.ndarray, separator: np.ndarray = SPACE) -> tuple[np.ndarray, pa.Array]:
    """A number for each word that spans() found, equal for equal words alone, and the words by number."""
    at = np.zeros(len(start) + 1, np.int64)
    np.cumsum(end - start, out=at[1:])
    words = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(at), pa.py_buffer(buffer[~separator[buffer]])]).dictionary_encode()
    return words.indices.to_numpy(), words.dictionary


def window_hashes(words: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """64-bit hash of every k consecutive word hashes, rows disregarded: len(words) - k + 1 of them."""
    if len(words) < k:
        return np.zeros(0, np.uint64)
    sums = _sums(mix(words ^ np.uint64(salt)) if salt else words)
    n = len(words) - k + 1
    return mix((sums[k:] - sums[:-k]) * powers(n, inverse=True) + np.uint64(k + salt))


def ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... count[0] numbers, then the same for the next."""
    count = np.maximum(count, 0)
    total = int(count.sum())
    first = np.cumsum(count) - count
    return np.repeat(start - first, count) + np.arange(total)


def within(first: np.ndarray, k: int) -> np.ndarray:
    """Indices of words at which a window of k words starts and stays in its row; first is spans()'s third result."""
    return ranges(first[:-1], np.diff(first) - k + 1)


def free_name(rows, name: str) -> str:
    """The name, with underscores before it until no column of the table has it."""
    taken = {c.lower() for c in rows.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def _give_back() -> None:
    """Returns what this worker has freed to the system: idle workers of an executor share its memory with the JVM."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidy(run):
    """A function for mapInArrow or applyInArrow that leaves its worker small."""
    if inspect.isgeneratorfunction(run):

        @functools.wraps(run)
        def stream(batches):
            try:
                yield from run(batches)
            finally:
                _give_back()

        return stream

    if len(inspect.signature(run).parameters) == 2:  # Spark reads the number of tables off the function

        @functools.wraps(run)
        def cogroup(left, right):
            try:
                return run(left, right)
            finally:
                _give_back()

        return cogroup

    @functools.wraps(run)
    def group(table):
        try:
            return run(table)
        finally:
            _give_back()

    return group
