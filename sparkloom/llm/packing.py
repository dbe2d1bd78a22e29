"""Sum-of-squares packing of tokenised documents into sequences of a fixed size.

Documents are cut only where they exceed a sequence. Pieces are dealt by hash into groups that a task packs one after another:
longest first, each piece goes to the open sequence whose choice makes the sum of the squared counts of open
sequences per remaining gap smallest (the smaller gap on a tie); a new sequence opens only where no open one has room.
Groups keep a bounded number of pieces whatever the input's size, and each leaves but its last sequences partly empty.

Defined cases: a null text counts as empty and gives one piece of the end token alone; equal lengths are ordered by document, piece,
start and the ids' checksum; repeated rows are each packed, spread over the groups by how many equal ones their task has had before; a null
doc_id is packed like any other; very long texts are cut into pieces in time linear in their length; an empty table gives an
empty table; other columns pass through :func:`pack_pieces`, except that those named like a result give way to it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import map_arrow
from .common import deal_by_id
from .hashing import byte_class, span_hashes, text_chunks

CAPACITY = 4096
END_ID = 1
#: Rows of documents for each group of pieces.
GROUP_DOCS = 4000
#: Slots of a worker's table of known units, a power of two, and how many units fill it: 24 bytes a slot with the ids.
TABLE_SLOTS, TABLE_UNITS = 1 << 21, 1_200_000
VOCABULARY = "word_bpe_49k.json"
#: Strings that the vocabulary reads as one token wherever they stand, and a letter whose lower case depends on its neighbours: such texts are encoded whole.
SPECIAL = ("<|startoftext|>", "<|endoftext|>", "\u03a3")

_BLANK, _LETTER, _MARK, _OTHER = range(4)
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[byte_class((0x21, 0x26), (0x28, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7E))] = _MARK
_CLASS[byte_class((0x41, 0x5A), (0x61, 0x7A))] = _LETTER
_CLASS[byte_class((0x09, 0x0A), (0x0D, 0x0D), (0x20, 0x20))] = _BLANK

_state: dict = {}


def default_tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


class _Table:
    """Open addressing over whole arrays: 64-bit hashes to numbers of entries."""

    def __init__(self):
        self.keys, self.entries = np.zeros(TABLE_SLOTS, np.uint64), np.zeros(TABLE_SLOTS, np.int32)
        self.shift = np.uint64(65 - TABLE_SLOTS.bit_length())

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The entry of each hash, -1 where there is none."""
        at = (hashes >> self.shift).astype(np.int64)
        found, left = np.full(len(hashes), -1, np.int32), np.arange(len(hashes))
        while len(left):
            keys = self.keys[at]
            hit = keys == hashes[left]
            found[left[hit]] = self.entries[at[hit]]
            on = ~hit & (keys != 0)
            left, at = left[on], (at[on] + 1) & (TABLE_SLOTS - 1)
        return found

    def add(self, hashes: np.ndarray, entries: np.ndarray) -> None:
        """Distinct hashes that are not there yet."""
        at = (hashes >> self.shift).astype(np.int64)
        while len(hashes):
            slot, first = np.unique(at, return_index=True)
            first = first[self.keys[slot] == 0]
            self.keys[at[first]], self.entries[at[first]] = hashes[first], entries[first]
            left = np.ones(len(hashes), bool)
            left[first] = False
            hashes, entries, at = hashes[left], entries[left], (at[left] + 1) & (TABLE_SLOTS - 1)


class UnitTokenizer:
    """Ids of whole texts from ids of their units.

    The vocabulary lowers letters; its pre-tokeniser drops white space and never joins what stands on both sides of a blank, or an ASCII letter
    and an ASCII mark (apostrophes apart). Between such places lie the units, and a text's ids are those of its units, one after
    another. A unit is encoded once and then known by a 64-bit hash of its bytes, A-Z lowered. Units of letters or marks alone
    are one word to the vocabulary, whose last token ends a word: many are encoded in one call and cut apart at those tokens.
    """

    def __init__(self, path: str, end_id: int = END_ID):
        from tokenizers import Tokenizer

        self.tokenizer, self.end_id = Tokenizer.from_file(path), end_id
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[k for token, k in vocabulary.items() if token.endswith("</w>")]] = True
        self._forget()

    def _forget(self) -> None:
        """Entry 0 is the end token."""
        self.table, self.known = _Table(), 1
        self.pool, self.used = np.full(1 << 20, self.end_id, np.uint32), 1
        self.start, self.length = np.zeros(TABLE_UNITS + 1, np.int32), np.ones(TABLE_UNITS + 1, np.int32)

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(got.ids, np.uint32) for got in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode_units(self, units: list[str]) -> list[np.ndarray]:
        ids: list = [None] * len(units)
        whole, single = [], []
        for k, unit in enumerate(units):
            (single if unit.isalpha() and unit.lower().isalpha() or unit.isascii() and not any(map(str.isalnum, unit)) and "'" not in unit else whole).append(k)
        groups = [single[k : k + 256] for k in range(0, len(single), 256)]
        for group, got in zip(groups, self._encode([" ".join(units[k] for k in g) for g in groups]), strict=True):
            cuts = np.flatnonzero(self.closes[got]) + 1
            if len(cuts) != len(group):
                whole.extend(group)
                continue
            for k, part in zip(group, np.split(got, cuts[:-1]), strict=True):
                ids[k] = part
        for k, got in zip(whole, self._encode([units[k] for k in whole]), strict=True):
            ids[k] = got
        return ids

    def _learn(self, hashes: np.ndarray, units: list[str]) -> np.ndarray:
        """Entries of distinct new units."""
        ids = self.encode_units(units)
        sizes = np.array([len(x) for x in ids], np.int32)
        total = int(sizes.sum())
        if self.used + total > len(self.pool):
            grown = np.zeros(max(2 * len(self.pool), self.used + total), np.uint32)
            grown[: self.used] = self.pool[: self.used]
            self.pool = grown
        entries = np.arange(self.known, self.known + len(units), dtype=np.int32)
        self.pool[self.used : self.used + total] = np.concatenate(ids)
        self.start[entries] = self.used + np.cumsum(sizes) - sizes
        self.length[entries] = sizes
        self.known += len(units)
        self.used += total
        self.table.add(hashes, entries)
        return entries

    def _entries(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        hashes = span_hashes(data, starts, ends)
        hashes[hashes == 0] = 1
        found = self.table.find(hashes)
        fresh = np.flatnonzero(found < 0)
        if len(fresh):
            new, first, back = np.unique(hashes[fresh], return_index=True, return_inverse=True)
            blob = data.tobytes()
            units = [blob[i:j].decode() for i, j in zip(starts[fresh[first]].tolist(), ends[fresh[first]].tolist(), strict=True)]
            found[fresh] = self._learn(new, units)[back]
        return found

    def ids(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first row, ids with an end token after each text, where each text's ids begin and the last end) of runs of rows."""
        odd = pc.match_substring(column, SPECIAL[0])
        for mark in SPECIAL[1:]:
            odd = pc.or_(odd, pc.match_substring(column, mark))
        odd = pc.fill_null(odd, False)
        plain = pc.if_else(odd, pa.scalar("", column.type), column) if pc.any(odd).as_py() else column
        for first, data, offsets in text_chunks(plain):
            kind = _CLASS[data]
            cut = np.ones(len(data) + 1, bool)
            cut[1:-1] = (kind[1:] * kind[:-1] == _LETTER * _MARK) | (kind[1:] == _BLANK) | (kind[:-1] == _BLANK)
            cut[offsets] = True
            edges = np.flatnonzero(cut)
            inside = kind[edges[:-1]] != _BLANK if len(data) else np.zeros(0, bool)
            starts, ends = edges[:-1][inside], edges[1:][inside]
            if self.known + len(starts) > TABLE_UNITS:
                self._forget()
            parts = []
            # a very long text is looked up in steps, so that its new units fit the table
            for k in range(0, max(1, len(starts)), TABLE_UNITS // 2):
                if self.known + min(len(starts) - k, TABLE_UNITS // 2) > TABLE_UNITS:
                    self._forget()
                entries = self._entries(data, starts[k : k + TABLE_UNITS // 2], ends[k : k + TABLE_UNITS // 2])
                length = self.length[entries]
                after = np.cumsum(length, dtype=np.int64)
                places = np.repeat(self.start[entries] - (after - length), length) + np.arange(after[-1] if len(after) else 0)
                parts.append((self.pool[places], length))
            ids, length = (np.concatenate([p[k] for p in parts]) for k in range(2))
            after = np.concatenate(([0], np.cumsum(length, dtype=np.int64)))
            bounds = after[np.searchsorted(starts, offsets)]
            out = np.insert(ids, bounds[1:], np.uint32(self.end_id))
            bounds = bounds + np.arange(len(bounds))
            special = [k for k in range(len(offsets) - 1) if odd[first + k].as_py()] if plain is not column else []
            if special:
                whole = dict(zip(special, self._encode([column[first + k].as_py() for k in special]), strict=True))
                texts = [np.append(whole[k], np.uint32(self.end_id)) if k in whole else out[i:j] for k, (i, j) in enumerate(zip(bounds[:-1], bounds[1:], strict=True))]
                out, bounds = np.concatenate(texts), np.concatenate(([0], np.cumsum([len(t) for t in texts])))
            yield first, out, bounds


def _tokenizer(path: str, end_id: int) -> UnitTokenizer:
    if (path, end_id) not in _state:
        _state[path, end_id] = UnitTokenizer(path, end_id)
    return _state[path, end_id]


def _pieces(path: str, capacity: int, end_id: int, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tokenizer = _tokenizer(path, end_id)
        had: dict[int, int] = {}  # equal pieces so far
        for batch in batches:
            docs = batch.column("doc_id")
            for first, tokens, bounds in tokenizer.ids(batch.column("text")):
                bounds = bounds.tolist()
                rows, ids, piece, start, length, crc, copy = [], [], [], [], [], [], []
                for row, (i, j) in enumerate(zip(bounds[:-1], bounds[1:], strict=True), first):
                    doc = docs[row].as_py()
                    for number, at in enumerate(range(i, j, capacity)):
                        part = tokens[at : min(j, at + capacity)].tobytes()
                        rows.append(row)
                        piece.append(number)
                        start.append(at - i)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                        same = hash((doc, number, crc[-1]))
                        had[same] = had.get(same, -1) + 1
                        copy.append(had[same])
                        if keep_ids:
                            ids.append(part)
                if rows:
                    columns = [docs.take(pa.array(rows)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(copy, pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns + [pa.array(ids, pa.binary())] * keep_ids, ["doc_id", "piece", "start", "length", "ids_crc32", "copy"] + ["ids"] * keep_ids)

    return run


def tokenize_pieces(docs: DataFrame, doc: str = "doc_id", text: str = "text", tokenizer_path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = True) -> DataFrame:
    """Per piece: ``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32``, ``copy`` and, if asked for, ``ids`` (little-endian unsigned 32-bit).

    ``copy`` numbers equal pieces of one task from 0; equal rows that it tells apart can be dealt to different groups.
    """
    kind = docs.schema[doc].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, copy long" + ", ids binary" * keep_ids
    return map_arrow(docs.select(F.col(doc).alias("doc_id"), F.col(text).alias("text")), _pieces(tokenizer_path or default_tokenizer_path(), capacity, end_id, keep_ids), schema)


def sum_of_squares(lengths: list[int], capacity: int = CAPACITY) -> tuple[list[int], list[int]]:
    """For each piece, given longest first, its sequence's number and its place there."""
    open_by_gap = np.zeros(capacity + 1, np.int64)
    bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    gap_of: list[int] = []
    number, offset = [], []
    for length in lengths:
        # taking a gap g for a piece s lowers count[g] by one and raises count[g - s]; a gap of 0 is closed and does not count
        at_gap = open_by_gap[length:]
        change = 2 * (open_by_gap[: capacity + 1 - length] - at_gap) + 2
        change[0] = 1 - 2 * at_gap[0]
        change = np.where(at_gap > 0, change, np.iinfo(np.int64).max)
        best = int(np.argmin(change))
        if at_gap[best] > 0:
            gap = best + length
            b = bins[gap].pop()
            open_by_gap[gap] -= 1
        else:
            gap, b = capacity, len(gap_of)
            gap_of.append(capacity)
        number.append(b)
        offset.append(capacity - gap)
        gap -= length
        gap_of[b] = gap
        if gap:
            bins[gap].append(b)
            open_by_gap[gap] += 1
    return number, offset


def _pack(capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def finish(group: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks()  # sorted longest first
            number, offset = sum_of_squares(rows.column("length").to_pylist(), capacity)
            rows = rows.append_column("sequence_id", pa.array([(group << 32) + b for b in number], pa.int64())).append_column("offset", pa.array(offset, pa.int64()))
            return rows.drop_columns(["__group"]).combine_chunks().to_batches()[0]

        last, held = None, []
        for batch in batches:
            groups = batch.column("__group").to_numpy()
            cuts = [0, *(np.flatnonzero(groups[1:] != groups[:-1]) + 1).tolist(), len(groups)]
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                if i < j:
                    group = int(groups[i])
                    if held and group != last:
                        yield finish(last, held)
                        held = []
                    last = group
                    held.append(batch.slice(i, j - i))
        if held:
            yield finish(last, held)

    return run


def pack_pieces(pieces: DataFrame, groups: int, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (``doc_id``, ``piece``, ``start``, ``length`` and any others) with ``sequence_id`` and ``offset``."""
    pieces = pieces.drop("sequence_id", "offset", "__group")
    more = [c for c in ("ids_crc32", "copy") if c in pieces.columns]
    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    dealt = pieces.withColumn("__group", F.pmod(F.xxhash64("doc_id", "piece", "start", *more), F.lit(max(1, groups))).cast("int"))
    dealt = deal_by_id(dealt, "__group", max(1, groups)).sortWithinPartitions("__group", F.desc("length"), "doc_id", "piece", "start", *more)
    return map_arrow(dealt, _pack(capacity), schema)


def pack_documents(docs: DataFrame, doc: str = "doc_id", text: str = "text", tokenizer_path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = True) -> DataFrame:
    """Tokenise, cut and pack: the pieces with their sequence and place. With ``keep_ids`` the token ids travel along."""
    groups = -(-docs.count() // GROUP_DOCS)
    return pack_pieces(tokenize_pieces(docs, doc, text, tokenizer_path, capacity, end_id, keep_ids), groups, capacity)


def op4_packing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack_documents(docs, keep_ids=False).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
