"""What the training-data operators share: checkpoints, text helpers, size-checked broadcasts."""

from __future__ import annotations

import contextlib
import re
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import map_arrow

#: Java regular expression of a white-space-delimited word.
SPACE_WORD = r"[^\x20\x09-\x0D]+"
#: The same for words of ASCII digits, letters of either case and any non-ASCII character.
ALNUM_WORD_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Most rows that :func:`broadcast_if_small` lets Spark broadcast.
BROADCAST_ROWS = 200_000


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder of ``spark.checkpoint.dir``; a folder of our own only where none is set and all runs in one process (tests)."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("Set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="sparkloom-checkpoint-"))


def checkpoint(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder, its lineage cut."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files go as soon as their query is done, instead of when the driver happens to collect its garbage: for a method of many checkpoints."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
            writer.write_batch(batch)
        yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["blob"])


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for blob in batch.column(0):
            yield from pa.ipc.open_stream(blob.as_buffer())


def packed_checkpoint(df: DataFrame, function, schema) -> DataFrame:
    """What ``function`` makes of the batches of ``df``, as a :func:`checkpoint` of compressed batches.

    It takes a fraction of the disk for columns that repeat or are sorted, and one worker a task, as one function makes and packs the batches.
    """
    return map_arrow(checkpoint(map_arrow(df, lambda batches: _pack(function(batches)), "blob binary")), _unpack, schema)


def ascii_lower(text: Column) -> Column:
    """``text`` with A-Z lowered and nothing else; pure-ASCII texts take Spark's fast path."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def or_empty(column: str | Column) -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def broadcast_if_small(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint if the counted ``rows`` stay within ``limit``; beyond it a shuffled join handles ``df``."""
    return F.broadcast(df) if rows <= limit else df


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, though the body names it often."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: Elements of a run of :func:`running` and :func:`gathered`: appending within runs keeps both linear in an array's length.
RUN = 128


def running(values: Column, zero: Column, join) -> Column:
    """For each element what ``join``, an associative function, makes of ``zero`` and all elements before it."""
    runs = F.when(F.size(values) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / RUN).cast("int")), lambda k: F.slice(values, k * RUN + 1, F.lit(RUN))))
    scan = lambda xs: F.aggregate(xs, F.array(zero), lambda acc, x: F.array_append(acc, join(F.get(acc, F.size(acc) - 1), x)))
    # each run from zero on, its total last; then the totals before each run
    inner = F.transform(runs, scan)
    whole = let(inner, lambda parts: let(scan(F.transform(parts, lambda part: F.get(part, F.size(part) - 1))), lambda before: F.flatten(F.transform(parts, lambda part, k: let(F.get(before, k), lambda b: F.transform(F.slice(part, F.lit(1), F.size(part) - 1), lambda x: join(b, x)))))))
    return F.coalesce(whole, F.slice(F.array(zero), 1, 0))


#: Code points of a block of :func:`text_blocks`.
BLOCK_CHARS = 1024


def text_blocks(text: Column) -> Column:
    """The text in blocks, from which :func:`cut_out` takes pieces in time that does not grow with the place."""
    return F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % BLOCK_CHARS), F.lit(0))


def cut_out(blocks: Column, start: Column, end: Column) -> Column:
    """The code points from ``start`` to ``end`` (exclusive)."""
    first = F.floor(start / BLOCK_CHARS).cast("int")
    some = F.array_join(F.slice(blocks, first + 1, F.floor(end / BLOCK_CHARS).cast("int") - first + 1), "")
    return F.when(end > start, F.substring(some, start - first * BLOCK_CHARS + 1, end - start)).otherwise(F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions_for(df: DataFrame, least: int = 0) -> int:
    """Shuffle partitions as the session sets them, ``least`` at least."""
    return max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


#: Most tasks of a shuffle whose rows are dealt by number; each works through its buckets one after another.
MOST_TASKS = 20_000


def deal_by_id(df: DataFrame, column: str, numbers: int) -> DataFrame:
    """``df`` dealt by a column of numbers from 0 to ``numbers - 1``: consecutive tasks get consecutive numbers in turn, none by chance more than others."""
    tasks = max(1, min(numbers, MOST_TASKS))
    return df.repartitionById(tasks, F.pmod(F.col(column), F.lit(tasks)).cast("int"))
