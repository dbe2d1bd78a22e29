"""Vectorised hashing of words and shingles over the bytes of Arrow string columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Texts are hashed together up to so many bytes; a longer text alone.
CHUNK_BYTES = 1 << 19

_ODD = 0x9E3779B97F4A7C15 | 1
_ODD_INVERSE = pow(_ODD, -1, 1 << 64)
_BYTE_VALUES = np.random.default_rng(20240531).integers(1, 1 << 63, 256, dtype=np.uint64)
_MULTIPLIERS = np.random.default_rng(77).integers(1, 1 << 63, 64, dtype=np.uint64) | U64(1)
_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, size: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < size:
        full = np.full(max(size, CHUNK_BYTES), base, np.uint64)
        full[0] = 1
        table = np.cumprod(full, dtype=np.uint64)
        if size > 8 * CHUNK_BYTES:
            return table
        _powers[base] = have = table
    return have[:size]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of ``x`` moves every bit of the result."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """A table of 256 flags: whether a byte belongs to a word. Bytes over 127 are parts of characters, each in or out as a whole."""
    table = np.zeros(256, bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


#: Bytes of words that white space ends: all but space and 9 to 13.
SPACE_WORD_BYTES = ~byte_class((0x20, 0x20), (0x09, 0x0D))
LOWER_BYTES = np.arange(256, dtype=np.uint8)
LOWER_BYTES[ord("A") : ord("Z") + 1] += 32


def text_chunks(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows with about CHUNK_BYTES of text; nulls are empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + CHUNK_BYTES, "right")) - 1)
        yield first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def word_hashes(data: np.ndarray, offsets: np.ndarray, word_bytes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word of the chunk, A-Z lowered, and for each text the number of the first word (and the end)."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = word_bytes[data]
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    before[offsets[:-1][offsets[:-1] < len(data)]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return span_hashes(data, starts, ends), np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each span of bytes, A-Z lowered."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_VALUES[LOWER_BYTES[data]] * _power_table(_ODD, len(data)), dtype=np.uint64, out=sums[1:])
    hashes = (sums[ends] - sums[starts]) * _power_table(_ODD_INVERSE, len(data))[starts]
    return mix(hashes + (ends - starts).astype(np.uint64))


def gram_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words of one text; of the whole text if it has fewer, none without words."""
    if not len(words):
        return words
    size = min(size, len(words))
    n = len(words) - size + 1
    total = np.full(n, size, np.uint64)
    for k in range(size):
        total += words[k : k + n] * _MULTIPLIERS[k]
    return mix(total)


def planes(values: np.ndarray) -> bytes:
    """The bytes of the values, all first bytes, then all second ones: sorted values compress well like this."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes()


def from_planes(blob: bytes, dtype) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    if not blob:
        return np.zeros(0, dtype)
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(width, -1).T).reshape(-1).view(dtype)


def bucket_slices(keys: np.ndarray, buckets: int) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of sorted keys, only buckets that have some: the top bits tell the bucket."""
    if not len(keys):
        return []
    where = ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    edges = np.flatnonzero(np.concatenate(([True], where[1:] != where[:-1])))
    return list(zip(where[edges].tolist(), edges.tolist(), [*edges[1:].tolist(), len(keys)], strict=True))


def sorted_groups(batches: Iterator[pa.RecordBatch], *columns: int, stream: int | None = None) -> Iterator[tuple]:
    """(value, rows) of rows sorted by columns, all of one value together; no more than one value's rows are held.

    With several columns the value is a tuple. Where its last part is ``stream``, rows come one at a time instead.
    """
    last, rows = None, []
    for batch in batches:
        for k in range(0, batch.num_rows, 64):
            part = batch.slice(k, 64)
            for row in zip(*(part.column(c).to_pylist() for c in range(part.num_columns)), strict=True):
                value = row[columns[0]] if len(columns) == 1 else tuple(row[c] for c in columns)
                if rows and (value != last or stream is not None and value[-1] == stream):
                    yield last, rows
                    rows = []
                last = value
                rows.append(row)
    if rows:
        yield last, rows
