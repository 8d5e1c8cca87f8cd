"""Whole texts of an Arrow batch as one run of bytes, and hashes of their words.

Everything here works on the bytes of many texts at once with numpy, so that a batch
costs a few passes over memory. A null text counts as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts are handled in slices of about so many bytes, so that what a task holds is
#: bounded by this and the longest single text.
SLICE_BYTES = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
POWERS_STEP = 1 << 16

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SAME = np.arange(256, dtype=np.uint8)
#: Bytes of words that white space parts, and of words of letters, digits and non-ASCII.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False
WORDLIKE = np.zeros(256, bool)
WORDLIKE[48:58] = WORDLIKE[97:123] = WORDLIKE[128:] = True


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row, and the offsets at which each begins and ends."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    array = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, where, what = array.buffers()
    if len(array) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(where, np.int64)[array.offset : array.offset + len(array) + 1]
    data = np.frombuffer(what, np.uint8) if what is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``size`` bytes in all, one text at least."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1
        last = min(n, max(first + 1, last))
        yield first, last
        first = last


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit over all others (a bijection of 64-bit numbers)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse."""
    if len(_powers[0]) < n:
        # kept by the worker, so hardly longer than asked for
        size = -(-n // POWERS_STEP) * POWERS_STEP
        for i, factor in enumerate((_BASE, _INVERSE)):
            row = np.full(size, factor, np.uint64)
            row[0] = 1
            _powers[i] = np.cumprod(row, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Sums of byte times power, so that the hash of any stretch takes two look-ups."""
    sums = np.zeros(len(data) + 1, np.uint64)
    # in place, as a worker keeps the memory of what it once held
    terms = sums[1:]
    terms[:] = data
    terms += np.uint64(1)
    terms *= powers(len(data))[0]
    np.cumsum(terms, out=terms)
    return sums


def stretch_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of stretches; equal stretches have equal hashes wherever they stand."""
    return mix((sums[end] - sums[start]) * powers(len(sums))[1][start] + (end - start).astype(np.uint64))


def word_bounds(data: np.ndarray, offsets: np.ndarray, in_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of all words; a word never reaches over the end of its text."""
    flag = in_word[data]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    start, end = flag.copy(), flag.copy()
    start[1:] &= ~flag[:-1]
    start[inner] = flag[inner]
    end[:-1] &= ~flag[1:]
    end[inner - 1] = flag[inner - 1]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def word_hashes(data: np.ndarray, offsets: np.ndarray, in_word: np.ndarray, case: np.ndarray = LOWER):
    """Hash, start and end of every word, and the number of the first word of each text."""
    data = case[data]
    start, end = word_bounds(data, offsets, in_word)
    first = np.searchsorted(start, offsets)
    return stretch_hashes(prefix_hashes(data), start, end), start, end, first


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of ``size`` words from each word on (those that go on into the next text too)."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for i in range(size):
        total = mix(total ^ words[i : i + n]) + np.uint64(i + 1)
    return total


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of each run of equal keys, from batches that are sorted by them."""
    kept: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        now = tuple(c[0] for c in columns)
        if kept and now != last:
            yield pa.Table.from_batches(kept)
            kept = []
        starts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, z in zip(starts, starts[1:]):
            kept.append(batch.slice(a, z - a))
            if z < batch.num_rows:
                yield pa.Table.from_batches(kept)
                kept = []
        last = tuple(c[-1] for c in columns)
    if kept:
        yield pa.Table.from_batches(kept)


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts in a row, and the offsets of the texts in them."""
    first = (data & 0xC0) != 0x80
    number = np.zeros(len(data) + 1, np.int64)
    np.cumsum(first, out=number[1:])
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    return points, number[offsets]


def pack(docs, text: str, *keys: str):
    """``docs`` as (row, text, keys): the whole row as one struct, so that no name can clash."""
    from pyspark.sql import functions as F

    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text).alias("text"), *keys)
