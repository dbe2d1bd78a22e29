"""Bigram language model whose counts live in a log-frequency Bloom filter.

Texts are dealt by hash to packs. Each pack sends its distinct words and word pairs, with their counts in training texts, by
hash to buckets. A bucket holds one segment of the filter: a pair seen c times is entered under the levels 1 to
1 + floor(log2 c), and a probe asks for level after level until one is missing, which gives c to within a factor of
two, never too low but for the rounding. Word counts are kept exactly. Each bucket answers all packs for what they asked, and the packs score their texts:

    p(w | v) = PAIR_WEIGHT * max(0, 2^(level - 1) - D) / c(v) + (1 - PAIR_WEIGHT) * (c(w) + 1) / (N + V + 1)

with the last factor alone where v is unseen. D is the absolute discount n1 / (n1 + 2 n2) of the numbers of pairs seen once and twice. The sum over
all w is one at the most: what rounding counts down and the discount take is not given back. The text's end is a token and also the context of its first word.
A filter for all pairs grows with the corpus and has no bound that a broadcast could rely on, so probes go to segments
instead of the filter to workers; one segment is bounded by a bucket.

Defined cases: a null text counts as empty (its end token alone); a null doc_id counts as an empty text when texts are held
out; repeated rows and rows of one doc_id count as often as they stand; without training texts N and V are 0; a very long text makes a pack
of its own size; an empty table gives an empty table; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import map_arrow
from .common import MOST_TASKS, deal_by_id, or_empty
from .hashing import SPACE_WORD_BYTES, bucket_slices, from_planes, mix, planes, sorted_groups, text_chunks, word_hashes

PAIR_WEIGHT = 0.7
HELD_OUT = (7, 2)
#: Bytes of text of a pack (larger ones ask for fewer words twice), and of the texts whose words one bucket counts.
PACK_BYTES = 16_000_000
BUCKET_BYTES = 6_000_000
BITS_PER_ENTRY = 12
PROBES = 6

END = np.uint64(0x51ED270B9F3C5A17)
_ROWS = "bucket int, pack long, words binary, word_counts binary, pairs binary, pair_counts binary, n long, v long, once long, twice long"
_KINDS = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), *[pa.int64()] * 4)


class LogBloom:
    """Levels of quantised counts in one array of packed bits. Sizes follow the entries, so the error rate is the same at every size."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, bits_per_entry: int = BITS_PER_ENTRY):
        levels = np.floor(np.log2(np.maximum(counts, 1))).astype(np.int64) + 1
        entries = int(levels.sum())
        self.top = int(levels.max(initial=0))
        self.size = max(64, entries * bits_per_entry)
        bits = np.zeros(self.size, bool)
        for level in range(1, self.top + 1):
            for places in self._places(keys[levels >= level], level):
                bits[places] = True
        self.bits = np.packbits(bits, bitorder="little")

    def _places(self, keys: np.ndarray, level: int) -> Iterator[np.ndarray]:
        first = mix(keys ^ np.uint64(level * 0xD1B54A32D192ED03 % (1 << 64)))
        step = mix(first ^ np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)
        for k in range(PROBES):
            yield (first + np.uint64(k) * step) % np.uint64(self.size)

    def levels(self, keys: np.ndarray) -> np.ndarray:
        found = np.zeros(len(keys), np.uint8)
        left = np.arange(len(keys))
        for level in range(1, self.top + 1):
            hit = np.ones(len(left), bool)
            for places in self._places(keys[left], level):
                hit &= (self.bits[places >> np.uint64(3)] >> (places & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
            left = left[hit]
            if not len(left):
                break
            found[left] = level
        return found


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts, an END after each, and the number of tokens of each text."""
    parts, sizes = [], []
    for _, data, offsets in text_chunks(texts):
        words, bounds = word_hashes(data, offsets, SPACE_WORD_BYTES)
        parts.append(np.insert(words, bounds[1:], END))
        sizes.append(np.diff(bounds) + 1)
    return (np.concatenate(parts), np.concatenate(sizes)) if parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def _pairs(tokens: np.ndarray) -> np.ndarray:
    before = np.empty_like(tokens)
    before[:1], before[1:] = END, tokens[:-1]
    return mix(before * np.uint64(0xC2B2AE3D27D4EB4F) + tokens)


def held_out(doc_ids: list, rule: tuple[int, int] = HELD_OUT) -> np.ndarray:
    return np.array([zlib.crc32(b"" if d is None else str(d).encode()) % rule[0] == rule[1] for d in doc_ids], bool)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(zip(*rows), _KINDS, strict=True)], [x.split()[0] for x in _ROWS.split(", ")])


def _by_pack(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    last, held = None, []
    for batch in batches:  # sorted by pack
        packs = batch.column("pack").to_numpy()
        cuts = [0, *(np.flatnonzero(packs[1:] != packs[:-1]) + 1).tolist(), len(packs)]
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            if i < j:
                if held and packs[i] != last:
                    yield last, pa.Table.from_batches(held)
                    held = []
                last = int(packs[i])
                held.append(batch.slice(i, j - i))
    if held:
        yield last, pa.Table.from_batches(held)


def _ask(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pack, docs in _by_pack(batches):
            tokens, sizes = _tokens(docs.column("text"))
            train = np.repeat(~held_out(docs.column("doc_id").to_pylist()), sizes)
            parts: dict[int, list[bytes]] = {}
            for k, keys in enumerate((tokens, _pairs(tokens))):
                unique, inverse = np.unique(keys, return_inverse=True)
                counts = np.bincount(inverse[train], minlength=len(unique)).astype(np.uint32)
                del inverse
                for bucket, i, j in bucket_slices(unique, buckets):
                    parts.setdefault(bucket, [b""] * 4)[2 * k : 2 * k + 2] = planes(unique[i:j]), planes(counts[i:j])
            filled = sorted(parts)
            for i in range(0, len(filled), 256):
                yield _rows([(k, pack, *parts.pop(k), 0, 0, 0, 0) for k in filled[i : i + 256]])

    return run


def _totals(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    unique, inverse = np.unique(keys, return_inverse=True)
    return unique, np.bincount(inverse, counts, len(unique)).astype(np.int64), inverse


def _answer(bits_per_entry: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in sorted_groups(batches, 0):
            words = [from_planes(r[2], np.uint64) for r in rows]
            _, totals, inverse = _totals(np.concatenate(words), np.concatenate([from_planes(r[3], np.uint32) for r in rows]))
            exact = totals[inverse]
            n, v = int(totals.sum()), int((totals > 0).sum())
            keys, counts, _ = _totals(np.concatenate([from_planes(r[4], np.uint64) for r in rows]), np.concatenate([from_planes(r[5], np.uint32) for r in rows]))
            once, twice = int((counts == 1).sum()), int((counts == 2).sum())
            segment = LogBloom(keys[counts > 0], counts[counts > 0], bits_per_entry)
            del keys, counts, totals, inverse
            at = 0
            for row, word in zip(rows, words, strict=True):
                levels = segment.levels(from_planes(row[4], np.uint64)).tobytes()
                yield _rows([(bucket, row[1], None, _narrow(exact[at : at + len(word)]), None, levels, n, v, once, twice)])
                at, n, v, once, twice = at + len(word), 0, 0, 0, 0  # the first answer alone carries the bucket's totals

    return run


def _narrow(counts: np.ndarray) -> bytes:
    """The width that the largest count needs, then the counts."""
    kind = np.min_scalar_type(counts.max(initial=0))
    return bytes([kind.itemsize]) + counts.astype(kind).tobytes()


def _wide(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, f"<u{blob[0]}", offset=1).astype(np.int64)


def _score(docs: pa.Table, answers: pa.Table) -> pa.Table:
    answers = answers.sort_by("bucket")
    n, v, once, twice = (answers.column("totals")[0].as_py()[k] for k in ("n", "v", "once", "twice"))
    discount = once / (once + 2 * twice) if once else 0.5
    counts = np.concatenate([_wide(x) for x in answers.column("word_counts").to_pylist()])
    levels = np.concatenate([np.frombuffer(x, np.uint8) for x in answers.column("pair_counts").to_pylist()])
    tokens, sizes = _tokens(docs.column("text"))
    c = counts[np.unique(tokens, return_inverse=True)[1]]
    level = levels[np.unique(_pairs(tokens), return_inverse=True)[1]].astype(np.float64)
    end = c[-1:]  # the last token is an END
    before = np.concatenate([end, c[:-1]]).astype(np.float64)
    alone = (c + 1) / (n + v + 1)
    seen = np.where(level > 0, np.exp2(level - 1) - discount, 0.0)
    both = np.where(before > 0, PAIR_WEIGHT * np.minimum(1.0, seen / np.maximum(before, 1)) + (1 - PAIR_WEIGHT) * alone, alone)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    add = lambda x: np.add.reduceat(x, starts) if len(starts) else np.zeros(0)
    ids = docs.column("doc_id")
    return pa.table(
        {
            "doc_id": ids,
            "held_out": pa.array(held_out(ids.to_pylist())),
            "n_tokens": pa.array(sizes, pa.int64()),
            "n_known": pa.array(add((c > 0).astype(np.int64)), pa.int64()),
            "train_tokens": pa.array(np.full(len(sizes), n), pa.int64()),
            "base_score": pa.array(add(np.log10(alone)), pa.float64()),
            "score": pa.array(add(np.log10(both)), pa.float64()),
        }
    )


def score_texts(docs: DataFrame, doc: str = "doc_id", text: str = "text", bits_per_entry: int = BITS_PER_ENTRY) -> DataFrame:
    """Train on the texts that are not held out and score all of them.

    Everything is one plan, in which the exchange of the texts serves both the counting and the scoring, and that of the counts both the
    answers and their totals; nothing but shuffle files has to be kept.
    """
    kind = docs.schema[doc].dataType.simpleString()
    docs = docs.select(F.col(doc).alias("doc_id"), or_empty(text).alias("text"))
    text_bytes = docs.agg(F.coalesce(F.sum(F.octet_length("text").cast("long") + 16), F.lit(0))).first()[0]
    packs, buckets = max(16, -(-text_bytes // PACK_BYTES)), max(16, -(-text_bytes // BUCKET_BYTES))
    tasks = min(packs, MOST_TASKS)
    # equal rows of different input partitions go to different packs
    dealt = docs.withColumn("pack", F.pmod(F.xxhash64("doc_id", "text", F.spark_partition_id()), F.lit(packs)).cast("long")).repartition(tasks, "pack")
    asked = map_arrow(dealt.sortWithinPartitions("pack"), _ask(buckets), _ROWS)
    answers = map_arrow(deal_by_id(asked, "bucket", buckets).sortWithinPartitions("bucket"), _answer(bits_per_entry), _ROWS)
    totals = answers.agg(F.struct(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "v", "once", "twice")]).alias("totals"))
    answers = answers.select("pack", "bucket", "word_counts", "pair_counts", totals.scalar().alias("totals")).repartition(tasks, "pack")
    schema = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return dealt.groupBy("pack").cogroup(answers.groupBy("pack")).applyInArrow(_score, schema)


def op7_ngram_lm(spark, sf_dir: str) -> DataFrame:
    return score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
