"""Substring deduplication by content-defined chunking.

A gear hash rolls over the text's bytes: each byte shifts the hash left and adds a random value, so that it depends
on the last WINDOW bytes alone. A chunk ends before a word whose hash is the least of some WINNOW words in a row, of equal ones
the last. Boundaries follow from the text around them only, so an insertion moves chunks but leaves their digests, and any WINNOW
words in a row have one, whatever they say: equal passages of 50 words share a window.
From each chunk on, the fewest chunks with LEAST_WORDS words make a window; what is shorter repeats by chance alone. Windows are dealt
by digest to buckets, where each repeated digest learns its first place (smallest doc_id, then start). A repeated window is a repeated
passage by itself, whatever its neighbours' first places are; overlapping windows whose first places stand in one document at
one distance are joined. Then the texts are compared, and a passage grows to both sides by the whole words that are equal too.
Passages of one document with different first places may overlap.

Defined cases: null and empty texts have no chunks; repeated rows and rows of one doc_id are one document, their equal windows at equal
places counting once; a null doc_id comes before all others; very long texts are hashed alone, in time linear in their length; an empty
table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import map_arrow
from .common import MOST_TASKS, SPACE_WORD, deal_by_id, or_empty, packed_checkpoint, partitions_for
from .hashing import _BYTE_VALUES, _ODD, _ODD_INVERSE, SPACE_WORD_BYTES, _power_table, bucket_slices, from_planes, mix, planes, sorted_groups, text_chunks

#: Bytes before a word that its hash covers, and words in a row of which the least hash is a boundary.
WINDOW, WINNOW = 16, 8
#: Words before and after a passage that are compared: as many as its outermost windows can leave out, LEAST_WORDS of them after it.
RIM_BEFORE, RIM_AFTER = 16, 28
#: A repeated passage has so many words in whole chunks, and so many chunks.
LEAST_WORDS, LEAST_CHUNKS = 20, 2
BUCKET_BYTES = 6_000_000
MAPPER_CHUNKS = 500_000

_GEAR = np.random.default_rng(4242).integers(0, 1 << 32, 256, dtype=np.uint32)
_NULL_ID = -(1 << 63)
_DEALT = "bucket int, kind int, keys binary, docs binary, starts binary, ends binary, word_at binary, words binary, more binary"
_HIT = "doc_id long, start long, end long, word_at long, n_words long, first_doc long, first_start long"
_FOUND = "doc_id long, start long, end long, n_words long, first_doc long, first_start long"


def gear_boundaries(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Places after which a chunk ends, over the texts of one run of bytes; each text's end is one."""
    rolled = _GEAR[data]
    span = 1
    while span < WINDOW:  # the hash over twice the span is the later half plus the earlier one, shifted
        shifted = np.zeros_like(rolled)
        shifted[span:] = rolled[:-span] << np.uint32(span)
        rolled = rolled + shifted
        span *= 2
    inside = SPACE_WORD_BYTES[data]
    places = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
    text = np.searchsorted(offsets, places, "right") - 1
    whole = places - offsets[text] >= WINDOW  # else the window reaches into the text before
    places, text = places[whole], text[whole]
    value = mix(rolled[places - 1].astype(np.uint64))
    # words in a row to the left and right of each that leave it the least, of equal ones the last
    reach = np.ones(len(places), np.int64)
    for left in (True, False):
        on = np.ones(len(places), bool)
        for k in range(1, min(WINNOW, len(places))):
            here, there = (slice(k, None), slice(None, -k)) if left else (slice(None, -k), slice(k, None))
            on[here] &= (text[here] == text[there]) & ((value[here] <= value[there]) if left else (value[here] < value[there]))
            on[slice(None, k) if left else slice(-k, None)] = False
            reach += on
    return np.union1d(places[reach >= WINNOW], offsets[1:][offsets[1:] > offsets[:-1]])


def window_texts(column: pa.Array, least_words: int, least_chunks: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Per run of texts: row, start and end in code points, first word, words and digest of each window.

    From each chunk on a window takes the fewest chunks that hold enough; one more per text ends with it.
    """
    for first, data, offsets in text_chunks(column):
        if not len(data):
            continue
        ends = gear_boundaries(data, offsets)
        starts = np.concatenate(([0], ends[:-1]))
        points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
        inside = SPACE_WORD_BYTES[data]
        stops = inside.copy()
        stops[:-1] &= ~inside[1:]
        closing = offsets[1:][offsets[1:] > offsets[:-1]] - 1
        stops[closing] = inside[closing]
        words = np.concatenate(([0], np.cumsum(stops)))
        row = np.searchsorted(offsets, starts, "right") - 1
        number = np.arange(len(ends))
        final = np.searchsorted(ends, offsets[row + 1])
        reach = np.maximum(np.searchsorted(words[ends], words[starts] + least_words), number + least_chunks - 1)
        whole = np.flatnonzero(reach <= final)
        closes = whole[np.append(row[whole][1:] != row[whole][:-1], True)] if len(whole) else whole
        closes = closes[reach[closes] < final[closes]]
        row, starts, ends = (np.concatenate(x) for x in ((row[whole], row[closes]), (starts[whole], starts[closes]), (ends[reach[whole]], ends[final[closes]])))
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE_VALUES[data] * _power_table(_ODD, len(data)), dtype=np.uint64, out=sums[1:])
        digest = mix((sums[ends] - sums[starts]) * _power_table(_ODD_INVERSE, len(data))[starts] + (ends - starts).astype(np.uint64))
        at = offsets[row]
        yield first + row, points[starts] - points[at], points[ends] - points[at], words[starts] - words[at], words[ends] - words[starts], digest


_KINDS = (np.uint64, np.int64, np.uint32, np.uint32, np.uint32, np.uint16, np.uint8)


def _deal(buckets: int, least_words: int, least_chunks: int):
    """Windows by bucket: each digest of a flush once, with its first place and whether there are more (kind 0), and those others (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def flush() -> pa.RecordBatch:
            docs, starts, ends, word_at, words, keys = (np.concatenate([h[k] for h in held]) for k in range(6))
            held.clear()
            order = np.lexsort((starts, docs, keys))
            docs, starts, ends, word_at, words, keys = (x[order] for x in (docs, starts, ends, word_at, words, keys))
            new = np.concatenate(([True], keys[1:] != keys[:-1]))
            edge = np.flatnonzero(new)
            first = edge[np.cumsum(new) - 1]
            other = (docs != docs[first]) | (starts != starts[first])  # rows of one document at one place are one place
            more = np.repeat(np.maximum.reduceat(other.astype(np.uint8), edge), np.diff(np.append(edge, len(keys))))
            rows = []
            for kind, chosen in ((0, new), (1, other)):
                columns = [x[chosen] for x in (keys, docs, starts, ends, word_at, words, more)]
                rows += [(b, kind, *(planes(x[i:j]) for x in columns)) for b, i, j in bucket_slices(columns[0], buckets)]
            kinds = (pa.int32(), pa.int32(), *[pa.binary()] * 7)
            return pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(zip(*rows), kinds, strict=True)], [x.split()[0] for x in _DEALT.split(", ")])

        size = 0
        for batch in batches:
            ids = np.array(batch.column("doc_id").fill_null(_NULL_ID).to_numpy(zero_copy_only=False), np.int64)
            for row, *columns in window_texts(batch.column("text"), least_words, least_chunks):
                held.append((ids[row], *(x.astype(kind, copy=False) for x, kind in zip(columns, (np.uint32, np.uint32, np.uint32, np.uint16, np.uint64), strict=True))))
                size += len(row)
                if size >= MAPPER_CHUNKS:
                    yield flush()
                    size = 0
        if size:
            yield flush()

    return run


def _hits(columns: list[np.ndarray], first_doc: np.ndarray, first_start: np.ndarray, picked: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of the picked windows with their first places."""
    _, docs, starts, ends, word_at, words, _ = columns
    for k in range(0, len(picked), 50_000):
        p = picked[k : k + 50_000]
        found = (docs[p], starts[p], ends[p], word_at[p], words[p], first_doc[p], first_start[p])
        yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in found], [x.split()[0] for x in _HIT.split(", ")])


def _resolve(firsts: bool):
    """Per bucket: all windows whose digest other places share, with the first of them; ``firsts``: the first itself too.

    Rows come by bucket and kind. What is held is a place of each digest and flush; all further places of a passage that many texts share pass through.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = first_doc = first_start = np.zeros(0)
        for (_, kind), rows in sorted_groups(batches, 0, 1, stream=1):
            columns = [np.concatenate([from_planes(r[k], x) for r in rows]) for k, x in enumerate(_KINDS, 2)]
            if kind == 0:
                order = np.lexsort((columns[2], columns[1], columns[0]))
                columns = [x[order] for x in columns]
                new = np.concatenate(([True], columns[0][1:] != columns[0][:-1]))
                edge = np.flatnonzero(new)
                keys, first_doc, first_start = columns[0][edge], columns[1][edge], columns[2][edge]
                # rows of one document at one place are one place
                place = new | np.concatenate(([True], (columns[1][1:] != columns[1][:-1]) | (columns[2][1:] != columns[2][:-1])))
                many = (np.add.reduceat(place.astype(np.int64), edge) > 1) | (np.maximum.reduceat(columns[6], edge) > 0)
                which = np.cumsum(new) - 1
                picked = np.flatnonzero(many[which] & place & (firsts | ~new))
            else:
                which = np.searchsorted(keys, columns[0])
                other = (columns[1] != first_doc[which]) | (columns[2] != first_start[which])
                picked = np.flatnonzero(other)
            yield from _hits(columns, first_doc[which], first_start[which], picked)

    return run


def _join_runs():
    """Windows sorted by doc to passages."""

    def finish(rows: list[np.ndarray]) -> pa.RecordBatch:
        doc, start, end, word_at, words, first, first_start = rows
        order = np.lexsort((start, first_start - start, first, doc))
        doc, start, end, word_at, words, first, first_start = (x[order] for x in rows)
        # a run goes on while the next window begins within this one, and so do their first places
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (start[1:] > end[:-1]) | (first[1:] != first[:-1]) | (first_start[1:] - start[1:] != first_start[:-1] - start[:-1])
        at = np.flatnonzero(new)
        total = np.maximum.reduceat(word_at + words, at) - word_at[at]
        columns = (doc[at], start[at], np.maximum.reduceat(end, at), total, first[at], first_start[at])
        return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], [x.split()[0] for x in _FOUND.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] | None = None
        for batch in batches:
            rows = [batch.column(k).to_numpy() for k in range(7)]
            if rest is not None:
                rows = [np.concatenate(x) for x in zip(rest, rows, strict=True)]
            if not len(rows[0]):
                continue
            cut = int(np.searchsorted(rows[0], rows[0][-1]))  # the last document may go on in the next batch
            rest = [x[cut:] for x in rows]
            if cut:
                yield finish([x[:cut] for x in rows])
        if rest is not None:
            yield finish(rest)

    return run


_UNIT = re.compile(f"{SPACE_WORD}[\\x20\\x09-\\x0D]*")
_WORD = re.compile(SPACE_WORD)
_SIDE = "doc long, start long, size long, digest binary, before string, after string"


def _side(text: str, at: int, forward: bool) -> str:
    """RIM_AFTER words after a place of the text, or RIM_BEFORE before it."""
    most = RIM_AFTER if forward else RIM_BEFORE
    size = 8 * most
    while True:
        piece = text[at : at + size] if forward else text[max(0, at - size) : at]
        words = list(_UNIT.finditer(piece))
        if len(words) > most:  # an outermost word may be cut
            return piece[: words[most - 1].end()] if forward else piece[words[-most].start() :]
        if at + size >= len(text) if forward else at <= size:
            return piece
        size *= 2


def _sides(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per place asked for: the digest of its text and what stands beside it."""
    names = [x.split()[0] for x in _SIDE.split(", ")]
    for batch in batches:
        rows: list[tuple] = []
        for row in zip(*(batch.column(k) for k in range(3)), strict=True):
            doc, text, places = (x.as_py() for x in row)
            for place in places:
                start, end = place["start"], place["start"] + place["size"]
                if end <= len(text):
                    digest = hashlib.blake2b(text[start:end].encode(), digest_size=16).digest()
                    rows.append((doc, start, end - start, digest, _side(text, start, False), _side(text, end, True)))
            if len(rows) >= 5_000:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], names)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], names)


_BLANKS = frozenset("\x20\t\n\x0b\x0c\r")


def _alike(a: str, b: str) -> int:
    """Length of the common beginning."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def equal_after(a: str, b: str) -> int:
    """Characters of the equal words that both begin with, and of the equal space between them."""
    n = _alike(a, b)
    if not n:
        return 0
    next_a, next_b = a[n : n + 1], b[n : n + 1]
    if a[n - 1] in _BLANKS:  # a word counts though the space after it differs
        return len(a[:n].rstrip("".join(_BLANKS))) if next_a in _BLANKS or next_b in _BLANKS else n
    if (not next_a or next_a in _BLANKS) and (not next_b or next_b in _BLANKS):
        return n
    while n and a[n - 1] not in _BLANKS:
        n -= 1
    return n


def equal_before(a: str, b: str) -> int:
    """Characters of the equal words that both end with, each with the space after it."""
    n = _alike(a[::-1], b[::-1])
    i, j = len(a) - n, len(b) - n
    if n and a[i] not in _BLANKS and (i and a[i - 1] not in _BLANKS or j and b[j - 1] not in _BLANKS):
        while i < len(a) and a[i] not in _BLANKS:  # the rest of a word that differs
            i += 1
    while i < len(a) and a[i] in _BLANKS:
        i += 1
    return len(a) - i


def _lists(column: pa.Array) -> tuple[list, list, list, list]:
    """Where each row's list of sides begins and the last ends, and the digests, texts before and texts after of all."""
    offsets = column.offsets.to_numpy()
    values = column.values.slice(int(offsets[0]), int(offsets[-1] - offsets[0]))
    return ((offsets - offsets[0]).tolist(), *(values.field(k).to_pylist() for k in range(3)))


def _extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Passages with the whole words that are equal on both sides of both places."""
    for batch in batches:
        if not batch.num_rows:
            continue
        doc, start, end, words, first, first_start = (batch.column(k).to_numpy() for k in range(6))
        own, own_digests, own_before, own_after = _lists(batch.column(6))
        kept, kept_digests, kept_before, kept_after = _lists(batch.column(7))
        most = np.zeros((batch.num_rows, 3), np.int64)
        for row in range(batch.num_rows):
            best = (0, 0, 0)
            for x in range(own[row], own[row + 1]):
                for y in range(kept[row], kept[row + 1]):
                    if own_digests[x] == kept_digests[y]:
                        before, after = own_before[x], own_after[x]
                        left, right = equal_before(before, kept_before[y]), equal_after(after, kept_after[y])
                        more = (len(_WORD.findall(before[len(before) - left :])) if left else 0) + (len(_WORD.findall(after[:right])) if right else 0)
                        best = max(best, (more, left, right))
            most[row] = best
        columns = (doc, start - most[:, 1], end + most[:, 2], words + most[:, 0], first, first_start - most[:, 1])
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], [x.split()[0] for x in _FOUND.split(", ")])


def repeated_passages(docs: DataFrame, doc: str = "doc_id", text: str = "text", least_words: int = LEAST_WORDS, least_chunks: int = LEAST_CHUNKS, firsts: bool = True) -> DataFrame:
    """Per repeated passage: ``doc_id``, ``start``, ``end`` (code points), ``n_words``, ``first_doc``, ``first_start``.

    The first place of a passage is a row too (unless ``firsts`` is false), with itself as first; where it differs, the span can be cut out of ``doc_id``.
    """
    docs = docs.select(F.col(doc).cast("long").alias("doc_id"), or_empty(text).alias("text"))
    text_bytes = docs.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    buckets = max(32, -(-text_bytes // BUCKET_BYTES))
    parts = max(partitions_for(docs), min(buckets, MOST_TASKS))
    dealt = deal_by_id(map_arrow(docs, _deal(buckets, least_words, least_chunks), _DEALT), "bucket", buckets).sortWithinPartitions("bucket", "kind")
    found = map_arrow(dealt, _resolve(firsts), _HIT).repartition(parts, "doc_id").sortWithinPartitions("doc_id")
    runs = packed_checkpoint(found, _join_runs(), _FOUND)
    itself = (F.col("doc_id") == F.col("first_doc")) & (F.col("start") == F.col("first_start"))
    firsts, runs = runs.where(itself), runs.where(~itself)  # a first place has no other text to be compared with
    size = (F.col("end") - F.col("start")).alias("size")
    own = runs.select(F.col("doc_id").alias("doc"), "start", size)
    kept = runs.select(F.col("first_doc").alias("doc"), F.col("first_start").alias("start"), size)
    asked = own.union(kept).groupBy("doc").agg(F.collect_set(F.struct("start", "size")).alias("places"))
    texts = docs.select(F.coalesce("doc_id", F.lit(_NULL_ID)).alias("doc"), "text")
    sides = map_arrow(texts.join(asked, "doc").select("doc", "text", "places"), _sides, _SIDE)
    # both joins read one shuffle of the sides
    sides = sides.groupBy("doc", "start", "size").agg(F.collect_set(F.struct("digest", "before", "after")).alias("sides"))
    at = lambda doc, start, name: sides.select(F.col("doc").alias(doc), F.col("start").alias(start), "size", F.col("sides").alias(name))
    both = runs.withColumn("size", size)
    both = both.join(at("doc_id", "start", "own"), ["doc_id", "start", "size"], "left").join(at("first_doc", "first_start", "kept"), ["first_doc", "first_start", "size"], "left")
    out = map_arrow(both.select(*[x.split()[0] for x in _FOUND.split(", ")], "own", "kept"), _extend, _FOUND).distinct().unionByName(firsts)
    real = lambda c: F.when(F.col(c) != F.lit(_NULL_ID), F.col(c)).alias(c)
    return out.select(real("doc_id"), "start", "end", "n_words", real("first_doc"), "first_start")


def op6_chunk_dedup(spark, sf_dir: str) -> DataFrame:
    """Passages that stand earlier too, in another document or the same: each row pairs the place to cut with the one that keeps the passage."""
    found = repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"), firsts=False)
    return found.where(~(F.col("doc_id").eqNullSafe(F.col("first_doc")) & (F.col("start") == F.col("first_start"))))
