"""A stored text index of segments: postings in blocks, so that a query reads blocks of its own terms, and of those only what can matter.

A block is a row: a term, up to BLOCK postings (``keys``, ``tfs``, ``lengths``) and a level, which bounds their scores from above. Postings of a term are put into
blocks by falling score, so few blocks hold what scores high. Blocks lie in folders by a hash of the term, as many folders as the text's bytes ask for, in
files of even size: the postings of a frequent word fill several files and no task sorts them all. What is shuffled is runs: of each term the postings of many texts, packed.

A search for the best ``k`` first reads the levels alone. The blocks of the highest level give ``k`` rows whose k-th score bounds the result from below, and
levels of which no row can reach it are not read: a comparison with a column by which the files are sorted, so Spark's reader skips their pages.
"""

from __future__ import annotations

import hashlib
import json
import math
import uuid
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as bm
from ..session import map_arrow
from ..store import GraphStore, read_small, write_once
from .segments import segments_of, touched_after

#: Postings of a block.
BLOCK = 128
#: Postings of a run, as they are shuffled, and those that a task makes runs of at a time.
RUN = 64
RUN_POSTINGS = 2_000_000
#: Bytes of text for each folder of postings.
FOLDER_BYTES = 256 << 20
MOST_FOLDERS = 4096
#: Levels for a term's full weight: scores are rounded up to a level, so that block bounds are whole numbers.
LEVELS = 32
#: Blocks of each term that give the first scores of a search, at least.
FIRST_BLOCKS = 4
#: A search of fewer blocks reads them all at once: finding the bound would take longer.
FEW_BLOCKS = 64
#: Scores this close below the bound are still read.
SLACK = 1e-9

_open: dict[tuple[str, str], "TextIndex"] = {}


def _levels(tf: np.ndarray, dl: np.ndarray, mean: float) -> np.ndarray:
    return np.ceil(LEVELS * _norm(tf, dl, mean or 1.0, bm.K1, bm.B)).astype(np.int32)


def _varints(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unsigned numbers in seven bits a byte, and the place of each in these bytes, the end included."""
    sizes = np.ones(len(values), np.int64)
    for k in range(1, 10):
        sizes += values >= np.uint64(1 << 7 * k)
    at = np.concatenate(([0], np.cumsum(sizes)))
    out = np.zeros(at[-1], np.uint8)
    for k in range(int(sizes.max(initial=0))):
        on = sizes > k
        out[at[:-1][on] + k] = (values[on] >> np.uint64(7 * k)) & np.uint64(127) | np.where(sizes[on] > k + 1, np.uint64(128), np.uint64(0))
    return out, at


def _numbers(data: np.ndarray) -> np.ndarray:
    """What :func:`_varints` has written."""
    if not len(data):
        return np.zeros(0, np.uint64)
    first = np.concatenate(([0], np.flatnonzero(data < 128)[:-1] + 1))
    place = np.arange(len(data)) - np.repeat(first, np.diff([*first, len(data)]))
    return np.add.reduceat((data & 127).astype(np.uint64) << (7 * place).astype(np.uint64), first)


def _as_runs(postings: pa.Table, mean: float) -> Iterator[pa.RecordBatch]:
    """``postings`` (``key``, ``term``, ``tf``, ``dl``) as runs of up to RUN of a term, those of alike level together.

    Whole keys are written as differences, within ``data``; others, and null, as they are, in ``keys``.
    """
    coded = postings.column("term").combine_chunks().dictionary_encode()
    codes, keys = coded.indices.to_numpy(), postings.column("key").combine_chunks()
    tf, dl = (postings.column(c).to_numpy() for c in ("tf", "dl"))
    level = _levels(tf, dl, mean)
    order = np.lexsort((-level, codes))
    own = np.concatenate(([True], np.diff(codes[order]) != 0))
    starts = np.flatnonzero(own)
    place = np.arange(len(order)) - np.repeat(starts, np.diff([*starts, len(order)]))
    cuts = np.flatnonzero(place % RUN == 0)
    top, n = level[order[cuts]], np.diff([*cuts, len(order)])
    columns = [tf, dl]
    if whole := pa.types.is_integer(keys.type) and not keys.null_count:
        number = keys.to_numpy().astype(np.int64)
        order = order[np.lexsort((number[order], np.repeat(np.arange(len(cuts)), n)))]
        step = np.diff(number[order], prepend=0)
        step[cuts] = number[order[cuts]]
        zigzag = np.empty(len(tf), np.int64)
        zigzag[order] = (step << 1) ^ (step >> 63)
        columns = [zigzag, *columns]
    data, at = _varints(np.stack([c[order] for c in columns], axis=1).astype(np.int64).view(np.uint64).ravel())
    ends = np.append(cuts, len(order))
    for a in range(0, len(cuts), bm.COUNTED_ROWS):
        part = ends[a : a + bm.COUNTED_ROWS + 1]
        edges = at[part * len(columns)]
        binary = pa.Array.from_buffers(pa.binary(), len(part) - 1, [None, pa.py_buffer((edges - edges[0]).astype(np.int32)), pa.py_buffer(data[edges[0] : edges[-1]])])
        lists = pa.nulls(len(part) - 1, pa.list_(keys.type)) if whole else pa.ListArray.from_arrays(pa.array(part - part[0], pa.int32()), keys.take(pa.array(order[part[0] : part[-1]])))
        here = slice(a, a + len(part) - 1)
        yield pa.RecordBatch.from_arrays([coded.dictionary.take(coded.indices.take(pa.array(order[cuts[here]]))), pa.array(top[here]), pa.array(n[here].astype(np.int32)), lists, binary], ["term", "level", "n", "keys", "data"])


def _runs(mean: float):
    """Words of rows (``key``, ``words``) to runs of postings: those of RUN_POSTINGS together, so that a frequent word is a few rows of each task, not one of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in bm.count_words(batches):
            held.append(batch)
            size += batch.num_rows
            if size >= RUN_POSTINGS:
                yield from _as_runs(pa.Table.from_batches(held), mean)
                held, size = [], 0
        if size:
            yield from _as_runs(pa.Table.from_batches(held), mean)

    return run


def _postings_of(batch: pa.RecordBatch) -> pa.Table:
    """The postings of runs."""
    n, keys = batch.column("n").to_numpy(), batch.column("keys")
    kind = keys.type.value_type
    lists, data = keys.is_valid().to_numpy(zero_copy_only=False), batch.column("data")
    out = []
    for whole in (True, False):
        rows = np.flatnonzero(lists != whole)
        if not len(rows):
            continue
        mine, sizes = data.take(pa.array(rows)), n[rows]
        offsets = np.frombuffer(mine.buffers()[1], np.int32)[mine.offset : mine.offset + len(mine) + 1]
        raw = np.frombuffer(mine.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if mine.buffers()[2] else np.zeros(0, np.uint8)
        numbers = _numbers(raw).view(np.int64).reshape(-1, 3 if whole else 2)
        if whole:
            zigzag = numbers[:, 0].view(np.uint64)
            step = (zigzag >> np.uint64(1)).view(np.int64) ^ -(numbers[:, 0] & 1)
            total = np.cumsum(step)
            first = np.cumsum(sizes) - sizes
            key = pa.array(total - np.repeat(total[first] - step[first], sizes)).cast(kind)
        else:
            key = keys.take(pa.array(rows)).flatten()
        at = pa.array(np.repeat(rows, sizes))
        out.append(pa.table([batch.column("bucket").take(at), batch.column("term").take(at), key, pa.array(numbers[:, -2].astype(np.int32)), pa.array(numbers[:, -1].astype(np.int32))], ["bucket", "term", "key", "tf", "dl"]))
    return pa.concat_tables(out)


def _blocks(mean: float):
    """Runs sorted by folder, term and falling level to blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            last = batch.column("term")[-1]
            table = _postings_of(batch)
            if rest is not None:
                table = pa.concat_tables([rest, table])
            codes = table.column("term").combine_chunks().dictionary_encode()
            level = _levels(table.column("tf").to_numpy(), table.column("dl").to_numpy(), mean)
            code = codes.indices.to_numpy()
            end = codes.dictionary.index(last).as_py()  # the last term comes last: it may go on in the next batch
            order = np.lexsort((-level, code, code == end))
            code, level = code[order], level[order]
            table = table.take(pa.array(order))
            new = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))
            cuts = [at for a, b in zip(new, [*new[1:], len(code)], strict=True) for at in range(a, b, BLOCK)]
            if cuts[:-1]:
                yield _as_blocks(table.slice(0, cuts[-1]), level[: cuts[-1]], cuts[:-1])
            rest = table.slice(cuts[-1])
        if rest is not None:
            yield _as_blocks(rest, _levels(rest.column("tf").to_numpy(), rest.column("dl").to_numpy(), mean), [0])

    return run


def _as_blocks(table: pa.Table, level: np.ndarray, cuts: list[int]) -> pa.RecordBatch:
    offsets = pa.array([*cuts, table.num_rows], pa.int32())
    lists = [pa.ListArray.from_arrays(offsets, table.column(c).combine_chunks()) for c in ("key", "tf", "dl")]
    n = np.diff([*cuts, table.num_rows]).astype(np.int32)
    term, bucket = (table.column(c).combine_chunks().take(pa.array(cuts, pa.int64())) for c in ("term", "bucket"))
    return pa.RecordBatch.from_arrays([term, *lists, pa.array(n), pa.array(np.maximum.reduceat(level, cuts)), bucket], ["term", "keys", "tfs", "lengths", "n", "level", "bucket"])


def _norm(tf, dl, mean: float, k1: float, b: float):
    """Of columns or of arrays."""
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / (mean or 1.0)))


def write_segment(df: DataFrame, touched: DataFrame | None, key: str, columns: list[str], folder: str, earlier: list[dict] = ()) -> dict:
    """Write the postings of ``df``, its rows' lengths and the touched keys; what to remember of the segment, the live totals included."""
    spark = df.sparkSession
    text = bm.searched_text(df, columns)
    tokens = F.size(bm.tokens(text)).cast("long")
    df.select(F.col(key).alias("key"), tokens.alias("dl"), F.octet_length(text).cast("long").alias("size")).write.parquet(f"{folder}/docs")
    size, documents, length = spark.read.parquet(f"{folder}/docs").agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
    mean = length / documents if documents else 0.0
    folders = max(1, min(MOST_FOLDERS, -(-size // FOLDER_BYTES)))
    words = df.select(F.col(key).alias("key"), bm.tokens(text).alias("words"))
    kind = words.schema["key"].dataType.simpleString()
    runs = map_arrow(words, _runs(mean), f"term string, level int, n int, keys array<{kind}>, data binary").withColumn("bucket", (F.crc32("term") % folders).cast("int"))
    dealt = runs.hint("rebalance", F.col("bucket"), F.col("term")).sortWithinPartitions("bucket", "term", F.desc("level"))
    schema = f"term string, keys array<{kind}>, tfs array<int>, lengths array<int>, n int, level int, bucket int"
    blocks = map_arrow(dealt, _blocks(mean), schema).sortWithinPartitions("bucket", "term", F.desc("level"))
    blocks.write.option("compression", "zstd").partitionBy("bucket").parquet(f"{folder}/blocks")
    if touched is not None:
        touched.distinct().write.parquet(f"{folder}/touched")
        gone = spark.read.parquet(f"{folder}/touched")
        for number, segment in enumerate(earlier):
            dead = spark.read.parquet(f"{segment['folder']}/docs").join(gone, "key", "left_semi")
            if (later := touched_after(spark, list(earlier), number)) is not None:
                dead = dead.join(later, "key", "left_anti")  # those were dead before
            lost, short = dead.agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
            documents, length = documents - lost, length - short
        documents, length = documents + earlier[-1]["documents"], length + earlier[-1]["length"]
    return {"folder": folder, "schema": schema, "folders": folders, "mean": mean, "documents": documents, "length": length}


class TextIndex:
    """``segments``: as :func:`write_segment` describes them, in order; the last knows the totals of all."""

    def __init__(self, spark: SparkSession, segments: list[dict]):
        self.spark, self.segments = spark, segments
        self.documents = segments[-1]["documents"]
        self.mean_length = segments[-1]["length"] / self.documents if self.documents else 0.0
        self._frames: dict[int, DataFrame] = {}

    def blocks(self, terms: list[str]) -> list[DataFrame]:
        """The terms' blocks of each segment; other folders are not listed, and within files only pages of the terms are read."""
        out = []
        for number, segment in enumerate(self.segments):
            if number not in self._frames:
                self._frames[number] = self.spark.read.schema(segment["schema"]).parquet(f"{segment['folder']}/blocks")  # a segment may be empty
            own = sorted({zlib.crc32(t.encode()) % segment["folders"] for t in terms})
            out.append(self._frames[number].where(F.col("bucket").isin(own) & F.col("term").isin(terms)))
        return out

    def _alive(self, postings: DataFrame, number: int) -> DataFrame:
        later = touched_after(self.spark, self.segments, number)
        return postings if later is None else postings.join(later, "key", "left_anti")

    def _postings(self, parts: list[DataFrame], weights: Column, k1: float, b: float) -> DataFrame:
        """``key``, ``score`` of the blocks' live postings, one a term."""
        out = []
        for number, part in enumerate(parts):
            each = part.select(weights.alias("w"), F.explode(F.arrays_zip("keys", "tfs", "lengths")).alias("p"))
            out.append(self._alive(each.select("w", F.col("p.keys").alias("key"), F.col("p.tfs").alias("tf"), F.col("p.lengths").alias("dl")), number))
        rows = reduce(DataFrame.unionByName, out)
        return rows.groupBy("key").agg(F.sum(F.col("w") * _norm(F.col("tf"), F.col("dl"), self.mean_length, k1, b)).alias("score"))

    def search(self, terms: list[str], k1: float = bm.K1, b: float = bm.B, k: int | None = None) -> DataFrame:
        """``key``, ``score`` of rows with any of the terms: of all of them, or of those that can be among the best ``k``, ties included."""
        terms = list(dict.fromkeys(terms))
        parts = self.blocks(terms)
        # a larger mean length than at the time of writing raises scores by no more than its growth
        growth = [max(1.0, self.mean_length / s["mean"]) / LEVELS if s["mean"] else 1.0 for s in self.segments]
        known: dict[str, list] = {}
        for number, part in enumerate(parts):
            for r in part.groupBy("term").agg(F.sum("n").alias("n"), F.count("*").alias("blocks"), F.max("level").alias("level")).collect():  # a row a term
                have = known.setdefault(r["term"], [0, 0, 0.0])
                known[r["term"]] = [have[0] + r["n"], have[1] + r["blocks"], max(have[2], r["level"] * growth[number])]
            if (later := touched_after(self.spark, self.segments, number)) is not None:
                dead = part.select("term", F.explode("keys").alias("key")).join(later, "key", "left_semi").groupBy("term").count()
                for r in dead.collect():
                    known[r["term"]][0] -= r["count"]
        idf = {t: math.log(1 + (self.documents - n + 0.5) / (n + 0.5)) for t, (n, _, _) in known.items() if n > 0}
        if not idf:
            return self._postings([p.where("false") for p in parts], F.lit(0.0), k1, b)
        weights = F.create_map(*[x for t, w in idf.items() for x in (F.lit(t), F.lit(w))])[F.col("term")]
        parts = [p.where(F.col("term").isin(list(idf))) for p in parts]
        if k and (k1, b) == (bm.K1, bm.B) and sum(known[t][1] for t in idf) > FEW_BLOCKS:
            parts = self._within_reach(parts, weights, idf, {t: idf[t] * known[t][2] for t in idf}, growth, k)
        return self._postings(parts, weights, k1, b)

    def _within_reach(self, parts: list[DataFrame], weights: Column, idf: dict[str, float], most: dict[str, float], growth: list[float], k: int) -> list[DataFrame]:
        """The blocks without those of which no row can be among the best ``k``. most: what each term can add to a score at the most."""
        best = Window.partitionBy("term").orderBy(F.desc("level"))
        first = [p.withColumn("place", F.row_number().over(best)).where(F.col("place") <= FIRST_BLOCKS + k // BLOCK).drop("place") for p in parts]
        scores = [r["score"] for r in self._postings(first, weights, bm.K1, bm.B).orderBy(F.desc("score")).limit(k).collect()]  # k rows
        if len(scores) < k:
            return parts
        # what a row must get from a term, if all others give it their most
        needed = {t: (scores[-1] - SLACK - (sum(most.values()) - most[t])) / idf[t] for t in idf}
        return [p.where(reduce(lambda a, c: a | c, [(F.col("term") == t) & (F.col("level") >= math.ceil(needed[t] / up - SLACK)) for t in idf])) for p, up in zip(parts, growth, strict=True)]


# where indexes are kept


def fingerprint(df: DataFrame, columns: list[str], key: str) -> str | None:
    """What the table is made of: its files, when they were written, and how; None for what stands in no files."""
    files = sorted(df.inputFiles())
    if not files:
        return None
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    stamps = []
    for folder in sorted({f.rpartition("/")[0] for f in files}):  # one listing a folder
        path = jvm.org.apache.hadoop.fs.Path(folder)
        own = {f.rpartition("/")[2] for f in files if f.rpartition("/")[0] == folder}
        stamps += [(folder, s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in path.getFileSystem(conf).listStatus(path) if s.getPath().getName() in own]
    # filters and projections over the files count too
    plan = df._jdf.queryExecution().analyzed().canonicalized().toString()
    return hashlib.sha256(repr((sorted(stamps), columns, key, plan)).encode()).hexdigest()[:32]


def index_for(df: DataFrame, key: str, columns: list[str], root: str | None) -> TextIndex | None:
    """The index of a table made of files, below ``root``, written on first use; None where nothing can be kept. It is one segment: files do not say what changed."""
    if root is None or (name := fingerprint(df, columns, key)) is None:
        return None
    spark = df.sparkSession
    place = (spark.sparkContext.applicationId, f"{root.rstrip('/')}/text-{name}")
    if place not in _open:
        text = read_small(spark, f"{place[1]}/current")
        if text is None:  # of several writers the first to finish names the segment that all use
            made = write_segment(df, None, key, columns, f"{place[1]}/{uuid.uuid4().hex}")
            text = write_once(spark, f"{place[1]}/current", json.dumps(made))
        _open[place] = TextIndex(spark, [json.loads(text)])
    return _open[place]


def index_of(store: GraphStore, label: str, columns: list[str]) -> TextIndex:
    """The index of a store's table as it is now: what has changed since the last search becomes a segment."""
    key = store.keys(label)[0]
    signature = hashlib.sha256(repr(columns).encode()).hexdigest()[:16]
    write = lambda rows, touched, folder, earlier: write_segment(rows, touched, key, columns, folder, earlier)
    return TextIndex(store.spark, segments_of(store, label, f"{store.path}/indexes/text-{label}-{signature}", write))


def shared_root(spark: SparkSession) -> str | None:
    """Where indexes are kept unless the caller says: in the shared folder of ``spark.checkpoint.dir``; None if the session names none."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    return f"{folder.rstrip('/')}/indexes" if folder else None
