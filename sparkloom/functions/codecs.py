"""Stored vector codes and what they say about a query, over whole Arrow batches.

========  =====================================================  ==========================================
codec     blob of a unit vector                                  score for a unit query
========  =====================================================  ==========================================
fp32      little-endian float32 components                       dot product
int8      float32 scale (largest component), then signed bytes   dot product with codes * scale / 127
binary    a bit for each component >= 0, most significant first  cos(pi * differing bits / dim)
polar     angular codes, see :mod:`polar`                        dot product with the decoded direction
========  =====================================================  ==========================================

A zero vector has no direction; its code is that of all zeros (polar: empty) and its score 0 for all but ``binary``.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import ConfigurationError
from ..session import map_arrow, ship_package
from . import polar

CODECS = ("fp32", "int8", "binary", "polar")
#: Candidates that a coded search hands to exact rescoring, for each result asked for.
SHORTLIST = 4
POLAR_BITS = 1.0


def check_codec(codec: str) -> str:
    if codec not in CODECS:
        raise ConfigurationError(f"Unknown codec {codec}", f"Known: {', '.join(CODECS)}")
    return codec


def split_magnitude(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, unit vectors); a zero vector stays zero."""
    lengths = np.linalg.norm(vectors.astype(np.float64), axis=1)
    return lengths, vectors / np.where(lengths > 0, lengths, 1.0)[:, None]


def encode(units: np.ndarray, codec: str, bits_per_dim: float = POLAR_BITS) -> list[bytes]:
    """A blob for each row of unit vectors."""
    check_codec(codec)
    if codec == "polar":
        some = np.linalg.norm(units, axis=1) > 0
        blobs = iter(polar.encode(units[some], bits_per_dim) if some.any() else [])
        return [next(blobs) if s else b"" for s in some]
    units = units.astype(np.float32)
    if codec == "fp32":
        return [row.astype("<f4").tobytes() for row in units]
    if codec == "binary":
        return [row.tobytes() for row in np.packbits(units >= 0, axis=1)]
    scale = np.abs(units).max(axis=1, initial=0).astype("<f4")
    codes = np.clip(np.rint(units * (127 / np.where(scale > 0, scale, 1))[:, None]), -127, 127).astype(np.int8)
    return [s.tobytes() + row.tobytes() for s, row in zip(scale, codes, strict=True)]


def blob_bytes(codec: str, dim: int) -> int | None:
    """How long a blob is; None for polar, whose header tells."""
    return {"fp32": 4 * dim, "int8": 4 + dim, "binary": -(-dim // 8)}.get(check_codec(codec))


Blobs = list[bytes] | pa.Array


def _bytes_of(blobs: Blobs) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, all bytes one after another); an Arrow column without nulls is read where it lies."""
    if isinstance(blobs, list):
        return np.array([len(b) for b in blobs], np.int64), np.frombuffer(b"".join(blobs), np.uint8)
    _, offsets, data = blobs.buffers()
    kind = np.int64 if pa.types.is_large_binary(blobs.type) else np.int32
    ends = np.frombuffer(offsets, kind)[blobs.offset : blobs.offset + len(blobs) + 1]
    return np.diff(ends), np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)


def _matrix(blobs: Blobs, codec: str, dim: int) -> np.ndarray:
    want = blob_bytes(codec, dim)
    lengths, data = _bytes_of(blobs)
    if (lengths != want).any():
        raise ConfigurationError(f"A {codec} code of {dim} components has {want} bytes")
    return data.reshape(len(blobs), want)


def decode(blobs: list[bytes], codec: str, dim: int) -> np.ndarray:
    """What the blobs give back of their directions."""
    check_codec(codec)
    if codec == "polar":
        out, some = np.zeros((len(blobs), dim)), [k for k, b in enumerate(blobs) if b]
        if some:
            found = polar.decode([blobs[k] for k in some])
            if found.shape[1] != dim:
                raise ConfigurationError(f"The codes have {found.shape[1]} components, not {dim}")
            out[some] = found
        return out
    raw = _matrix(blobs, codec, dim)
    if codec == "fp32":
        return raw.view("<f4").astype(np.float64)
    if codec == "binary":
        return np.where(np.unpackbits(raw, axis=1, count=dim) == 1, 1.0, -1.0) / math.sqrt(dim)
    return raw[:, 4:].view(np.int8) * (np.ascontiguousarray(raw[:, :4]).view("<f4").astype(np.float64) / 127)


def scorer(blobs: Blobs, codec: str, dim: int) -> Callable[[np.ndarray], np.ndarray]:
    """What each code says about the cosine with a unit query, for any number of queries: the codes are unpacked once, and scored by tables or as they are."""
    check_codec(codec)
    if not len(blobs):
        return lambda query: np.zeros(0)
    if codec == "polar":
        lengths, data = _bytes_of(blobs)
        some = np.flatnonzero(lengths)
        if not len(some):
            return lambda query: np.zeros(len(lengths))
        if (lengths[some] != lengths[some[0]]).any():
            raise ConfigurationError("Angular codes of several kinds")
        width, bits, codes = polar.unpack(data.reshape(len(some), -1))
        if width != dim:
            raise ConfigurationError(f"The codes have {width} components, not {dim}")

        def by_tables(query: np.ndarray) -> np.ndarray:
            out = np.zeros(len(lengths))
            out[some] = polar.scores(width, bits, codes, query)
            return out

        return by_tables
    raw = _matrix(blobs, codec, dim)
    if codec == "binary":
        return lambda query: np.cos(np.pi * np.bitwise_count(raw ^ np.packbits(query >= 0)[None, :]).sum(axis=1) / dim)
    if codec == "int8":
        whole, scale = raw[:, 4:].view(np.int8).astype(np.float64), np.ascontiguousarray(raw[:, :4]).view("<f4")[:, 0].astype(np.float64) / 127
        return lambda query: whole @ query * scale
    values = np.ascontiguousarray(raw).view("<f4").astype(np.float64)
    return lambda query: values @ query


def scores(blobs: Blobs, query: np.ndarray, codec: str) -> np.ndarray:
    """What each code says about the cosine with a unit query."""
    return scorer(blobs, codec, len(query))(query)


def cosines_from_codes(left: list[bytes], right: list[bytes], codec: str, dim: int) -> np.ndarray:
    """Cosines of coded directions, pair by pair; 0 where one has none."""
    a, b = split_magnitude(decode(left, codec, dim))[1], split_magnitude(decode(right, codec, dim))[1]
    return (a * b).sum(axis=1)


def rows_of(column: pa.Array, dim: int | None = None) -> np.ndarray:
    """An Arrow list column without nulls as a matrix."""
    width = dim or (len(column[0]) if len(column) else 0)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(flat) != width * len(column):
        raise ConfigurationError(f"A vector has not {width} components")
    return flat.reshape(len(column), width)


def with_codes(df: DataFrame, vector: str, codec: str, code: str = "_emb_code", length: str = "_emb_r", bits_per_dim: float = POLAR_BITS) -> DataFrame:
    """``df`` with the length and the code of each vector; null where the vector is."""
    check_codec(codec)
    ship_package(df.sparkSession)

    @F.pandas_udf("struct<r double, code binary>")
    def coded(column):
        import pandas as pd

        some = column.notna()
        out = pd.DataFrame({"r": np.nan, "code": None}, index=column.index, dtype=object)
        if some.any():
            lengths, units = split_magnitude(np.stack(column[some].to_list()).astype(np.float64))
            out.loc[some, "r"] = lengths
            out.loc[some, "code"] = pd.Series(encode(units, codec, bits_per_dim), index=column.index[some])
        return out

    kept = [c for c in df.columns if c not in (code, length)]
    both = df.withColumn("__coded", coded(F.col(vector)))
    some = F.col(vector).isNotNull()
    return both.select(*[F.col(f"`{c}`") for c in kept], F.when(some, F.col("__coded.r")).alias(length), F.when(some, F.col("__coded.code")).alias(code))


def shortlist(df: DataFrame, key: str, column: str, query: list[float], k: int, codec: str, coded: bool) -> DataFrame:
    """``key``, ``approx`` of the ``k`` rows whose codes promise most. Each batch hands on its own best ``k`` only.

    ``column`` holds codes, or vectors of which codes are made on the way (``coded`` false).
    """
    check_codec(codec)
    unit = np.asarray(query, np.float64)
    unit = unit / (np.linalg.norm(unit) or 1.0)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(1)
            blobs = values if coded else encode(split_magnitude(rows_of(values))[1], codec)
            found = scores(blobs, unit, codec)
            # ties at the cut go on, so that the order by key decides them
            keep = np.flatnonzero(found >= np.partition(found, len(found) - k)[len(found) - k]) if len(found) > k else np.arange(len(found))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep)), pa.array(found[keep])], ["key", "approx"])

    rows = df.where(F.col(column).isNotNull()).select(F.col(key).alias("key"), F.col(column).alias("value"))
    kind = df.schema[key].dataType.simpleString()
    return map_arrow(rows, best, f"key {kind}, approx double").orderBy(F.desc("approx"), "key").limit(k)


#: Query vectors of a block, rows of a block, and query blocks of a partition: what a task holds is bounded by these.
BATCH_QUERIES, BLOCK_ROWS, BLOCKS_A_PART = 1024, 8192, 16
#: Cosines of a matrix product this much below the bound are worked out term by term.
SLACK = 1e-9
#: Cosines that are in memory at once, and results that a task collects before it thins them out.
MATRIX, PENDING = 2 << 20, 1 << 18


def _blobs(df: DataFrame, names: list[str], rows: int) -> DataFrame:
    """Rows packed ``rows`` at a time: the first column as an array, the second (vectors) as ``dim`` and float64 bytes, others as arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                values = rows_of(part.column(1))
                lists = [pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(k)) for k in range(part.num_columns) if k != 1]
                yield pa.RecordBatch.from_arrays([pa.array([values.tobytes()], pa.binary()), pa.array([values.shape[1]], pa.int32()), *lists], [f"{names[1]}", f"{names[1]}_dim", names[0], *names[2:]])

    kinds = [f"{n} array<{f.dataType.simpleString()}>" for k, (n, f) in enumerate(zip(names, df.schema.fields, strict=True)) if k != 1]
    return map_arrow(df, run, ", ".join([f"{names[1]} binary, {names[1]}_dim int", *kinds]))


def _matrix_of(batch: pa.RecordBatch, name: str, row: int) -> np.ndarray:
    width = batch.column(f"{name}_dim")[row].as_py()
    return np.frombuffer(batch.column(name)[row].as_buffer(), np.float64).reshape(-1, width)


def _items(batch: pa.RecordBatch, name: str, row: int) -> np.ndarray:
    return batch.column(name)[row].values.to_numpy(zero_copy_only=False)


def _lengths(values: np.ndarray) -> np.ndarray:
    return np.sqrt(_dots(values, values))


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dot products row by row, each summed from the first component to the last: equal rows have equal results wherever they lie, as in SQL."""
    out = np.zeros(len(a))
    for i in range(a.shape[1]):
        out += a[:, i] * b[:, i]
    return out


def _cosines(a: np.ndarray, la: np.ndarray, b: np.ndarray, lb: np.ndarray) -> np.ndarray:
    both = la * lb
    return np.where(both > 0, _dots(a, b) / np.where(both > 0, both, 1.0), 0.0)


def _leading(columns: list[np.ndarray], k: int) -> list[np.ndarray]:
    """Of each query (first column) the ``k`` rows that are highest in the third column, then lowest in the second (their key)."""
    query, key, score = columns[:3]
    order = np.lexsort((key, -score, query))
    query = query[order]
    new = np.concatenate(([True], query[1:] != query[:-1]))
    place = np.arange(len(query)) - np.maximum.accumulate(np.where(new, np.arange(len(query)), 0))
    return [c[order[place < k]] for c in columns]


def _first_copies(keys: np.ndarray, values: np.ndarray, groups: np.ndarray | None, k: int) -> np.ndarray:
    """The rows without those that have ``k`` equal rows of smaller keys: those can be among nobody's best ``k``."""
    order = np.argsort(keys, kind="stable")
    own = np.ascontiguousarray(values[order]).view(f"V{values.shape[1] * 8}")[:, 0]
    _, code = np.unique(own, return_inverse=True)
    code = code if groups is None else code * (int(groups.max()) + 2) + groups[order] + 1
    by = np.argsort(code, kind="stable")
    new = np.concatenate(([True], code[by][1:] != code[by][:-1]))
    place = np.arange(len(by)) - np.maximum.accumulate(np.where(new, np.arange(len(by)), 0))
    return np.sort(order[by[place < k]])


def _best_pairs(own: np.ndarray, lengths: np.ndarray, asked: np.ndarray, asked_lengths: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, cosine) of the rows that can be among the ``k`` nearest of each query, all with that k-th cosine included."""
    units, out = own / np.where(lengths > 0, lengths, 1.0)[:, None], []
    step = max(1, MATRIX // max(1, len(own)))
    for at in range(0, len(asked), step):
        some, size = asked[at : at + step], asked_lengths[at : at + step]
        near = (some / np.where(size > 0, size, 1.0)[:, None]) @ units.T
        if near.shape[1] > k:
            least = np.partition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k]
            q, r = np.nonzero(near >= least[:, None] - SLACK)
        else:
            q, r = (x.ravel() for x in np.indices(near.shape))
        for a in range(0, len(q), MATRIX // 8):
            x, y = q[a : a + MATRIX // 8], r[a : a + MATRIX // 8]
            out.append((x + at, y, _cosines(some[x], size[x], own[y], lengths[y])))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))


def nearest_pairs(rows: DataFrame, queries: DataFrame, k: int, codec: str = "fp32", coded: bool = False, near: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """``query``, ``key``, ``score``, ``rank``: the ``k`` nearest of ``rows`` (``key``, ``value``, with ``coded`` ``code``) for each of ``queries`` (``query``, ``vector``).

    Blocks of rows meet blocks of queries, neither of which any process holds whole; a task thins out what it found as it goes on. ``near``: which cells (``cell``, a column
    of the rows) each query of a matrix of unit vectors reads, a matrix of booleans; all rows without it.
    """
    keep = k if codec == "fp32" else SHORTLIST * k
    extra = (["code"] if coded else []) + (["cell"] if near else [])
    packed = _blobs(rows.select("key", "value", *extra), ["keys", "own", *extra], BLOCK_ROWS)
    asked = queries.where(F.col("vector").isNotNull()).select("query", "vector")
    parts = max(1, -(-asked.count() // (BATCH_QUERIES * BLOCKS_A_PART)))
    blocks = _blobs(asked.repartition(parts), ["numbers", "asked"], BATCH_QUERIES).withColumn("block", F.monotonically_increasing_id())
    names = ["query", "key", "approx", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells: dict[int, np.ndarray] = {}
        waiting, number = [], 0
        for batch in batches:
            for row in range(batch.num_rows):
                for found in _met(batch, row, cells):
                    waiting.append(found)
                    number += len(found[0])
                    if number > PENDING:
                        waiting = [_leading([np.concatenate(c) for c in zip(*waiting, strict=True)], keep)]
                        number = len(waiting[0][0])
                        if number > PENDING // 2:
                            yield pa.RecordBatch.from_arrays([pa.array(c) for c in waiting[0]], names)
                            waiting, number = [], 0
        if waiting:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in _leading([np.concatenate(c) for c in zip(*waiting, strict=True)], keep)], names)

    def _met(batch: pa.RecordBatch, row: int, cells: dict[int, np.ndarray]) -> Iterator[list[np.ndarray]]:
        keys, own, numbers, asked = _items(batch, "keys", row), _matrix_of(batch, "own", row), _items(batch, "numbers", row), _matrix_of(batch, "asked", row)
        if own.shape[1] != asked.shape[1]:
            raise ConfigurationError(f"A vector has not {asked.shape[1]} components")
        lengths, asked_lengths = _lengths(own), _lengths(asked)
        if codec != "fp32":
            units, mine = split_magnitude(asked)[1], split_magnitude(own)[1]
            score = scorer(batch.column("code")[row].values if coded else encode(mine, codec), codec, own.shape[1])
            for n, unit in enumerate(units):
                found = score(unit)
                picked = np.flatnonzero(found >= np.partition(found, len(found) - keep)[len(found) - keep]) if len(found) > keep else np.arange(len(found))
                picked = picked[np.lexsort((keys[picked], -found[picked]))[:keep]]
                one = np.full(len(picked), n)
                yield [numbers[one], keys[picked], found[picked], _cosines(asked[one], asked_lengths[one], own[picked], lengths[picked])]
            return
        there = _items(batch, "cell", row) if near else None
        some = _first_copies(keys, own, there, k)
        keys, own, lengths, there = keys[some], own[some], lengths[some], None if there is None else there[some]
        if near is None:
            q, r, cosine = _best_pairs(own, lengths, asked, asked_lengths, k)
            yield [numbers[q], keys[r], cosine, cosine]
            return
        block = batch.column("block")[row].as_py()
        if block not in cells:
            if len(cells) >= BLOCKS_A_PART:
                cells.clear()
            cells[block] = near(split_magnitude(asked)[1])
        for cell in np.unique(there):
            readers = np.flatnonzero(cells[block][:, cell] & (asked_lengths > 0)) if cell >= 0 else np.zeros(0, int)
            inside = np.flatnonzero(there == cell)
            if len(readers):
                q, r, cosine = _best_pairs(own[inside], lengths[inside], asked[readers], asked_lengths[readers], k)
                yield [numbers[readers[q]], keys[inside[r]], cosine, cosine]

    kinds = [queries.schema["query"].dataType.simpleString(), rows.schema["key"].dataType.simpleString()]
    found = map_arrow(packed.crossJoin(blocks), run, f"query {kinds[0]}, key {kinds[1]}, approx double, score double")
    if codec != "fp32":
        found = found.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("approx"), "key"))).where(F.col("place") <= keep)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "key")))
    return ranked.where(F.col("rank") <= k).select("query", "key", "score", "rank")


def batch_top_k(df: DataFrame, key: str, vector: str, queries: list[tuple[int, list[float]]] | DataFrame, k: int, codec: str = "fp32", code: str | None = None) -> DataFrame:
    """``query``, ``key``, ``score``, ``rank``: the ``k`` nearest rows of each query, by pairs (number, vector) or a table (``query``, ``vector``) of any size.

    Of coded rows the best ``SHORTLIST * k`` of each query by code are scored exactly. Equal scores are in order of their keys.
    """
    check_codec(codec)
    if not isinstance(queries, DataFrame):
        queries = df.sparkSession.createDataFrame([(int(q), [float(x) for x in v]) for q, v in queries], "query long, vector array<double>")
    rows = df.where(F.col(vector).isNotNull()).select(F.col(key).alias("key"), F.col(vector).alias("value"), *([F.col(code).alias("code")] if code else []))
    return nearest_pairs(rows, queries, k, codec, code is not None)


def recall(truth: DataFrame, found: DataFrame) -> DataFrame:
    """``recall``: which share of the true pairs (``query``, ``key``) was found, over all queries."""
    pairs = truth.select("query", "key")
    hit = pairs.intersect(found.select("query", "key")).agg(F.count("*").alias("hit"))
    return pairs.agg(F.count("*").alias("all")).crossJoin(F.broadcast(hit)).select((F.col("hit") / F.col("all")).alias("recall"))  # one row and one row
