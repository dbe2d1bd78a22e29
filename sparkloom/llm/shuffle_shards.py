"""Two-pass external shuffle of records into shards.

Pass one scatters the records by a seeded hash into buckets small enough for a task's memory. Pass two shuffles each bucket
with Fisher-Yates under a seed of its own and writes it. The buckets in order make one shuffled sequence; with the
counts of the buckets before it each record knows its place p there, and shard p mod n at slot p div n takes it, so shards
differ by one row at most (the law ``rows``). A bucket's count before it travels ahead of its records through the same exchange.

Defined cases: a null text has no bytes; a null doc_id is hashed like a value; repeated rows each get a slot of their own, in one bucket; very
long texts make larger buckets; an empty table gives an empty table; other columns travel along, whatever their names, but columns
named like a result give way to it; a bucket's rows start from a fixed order, so that a lost task redoes the same shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import map_arrow
from .common import deal_by_id, or_empty

SHARDS = 24
SEED = 20240607
#: Bytes of a bucket as intended; the buckets' number grows with the input.
BUCKET_BYTES = 8_000_000
LEAST_BUCKETS = 64


def fisher_yates(n: int, seed: int, bucket: int) -> np.ndarray:
    """A permutation of n places: from the last place down, each is swapped with a random one up to it."""
    draw = np.random.Generator(np.random.PCG64([seed, bucket]))
    order = list(range(n))
    if n > 1:
        picks = draw.integers(0, np.arange(n, 1, -1)).tolist()
        for i, j in zip(range(n - 1, 0, -1), picks, strict=True):
            order[i], order[j] = order[j], order[i]
    return np.array(order, np.int64)


def _shuffle(shards: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def finish(bucket: int, before: int, held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(held).combine_chunks()
            order = fisher_yates(len(rows), seed, bucket)
            place = before + np.arange(len(rows), dtype=np.int64)
            for k in range(0, len(order), 2000):
                part = rows.take(pa.array(order[k : k + 2000])).combine_chunks().to_batches()[0]
                fields = part.column(0).flatten()
                names = [part.schema.field(0).type.field(i).name for i in range(len(fields))]
                yield pa.RecordBatch.from_arrays([*fields, pa.array(place[k : k + 2000] % shards, pa.int32()), pa.array(place[k : k + 2000] // shards, pa.int64())], [*names, "shard", "slot"])

        last, before, held = None, 0, []
        for batch in batches:
            buckets = batch.column("bucket").to_numpy()
            cuts = [0, *(np.flatnonzero(buckets[1:] != buckets[:-1]) + 1).tolist(), len(buckets)]
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                if i < j:
                    if int(buckets[i]) != last:  # its first row is the count of what lies before
                        if held:
                            yield from finish(last, before, held)
                        last, before, held = int(buckets[i]), batch.column("before")[i].as_py(), []
                        i += 1
                    if i < j:
                        held.append(batch.select(["row"]).slice(i, j - i))
        if held:
            yield from finish(last, before, held)

    return run


def shuffle_into_shards(df: DataFrame, shards: int = SHARDS, seed: int = SEED, doc: str = "doc_id", text: str = "text", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``df`` with ``shard`` and ``slot``, in the shuffled order of each bucket."""
    df = df.drop("shard", "slot")
    size = F.octet_length(or_empty(df[text])).cast("long") + 8
    total = df.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    buckets = max(LEAST_BUCKETS, -(-total // bucket_bytes))
    crc = F.crc32(or_empty(df[text]))
    scattered = df.select(F.pmod(F.xxhash64(F.lit(seed), df[doc], crc), F.lit(buckets)).cast("long").alias("bucket"), df[doc].alias("doc"), crc.alias("crc"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
    counts = scattered.groupBy("bucket").count()
    # one row per bucket, so a sum over all of them in order is small
    before = counts.select("bucket", (F.sum("count").over(Window.orderBy("bucket")) - F.col("count")).alias("before"))
    ahead = before.select("bucket", "before", *[F.lit(None).cast(scattered.schema[c].dataType).alias(c) for c in ("doc", "crc", "row")])
    dealt = ahead.unionByName(scattered.withColumn("before", F.lit(None).cast("long")))
    dealt = deal_by_id(dealt, "bucket", buckets).sortWithinPartitions("bucket", F.asc_nulls_last("before"), "doc", "crc").select("bucket", "before", "row")
    schema = T.StructType([*df.schema.fields, T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())])
    return map_arrow(dealt, _shuffle(shards, seed), schema)


def write_shards(df: DataFrame, path: str, **options) -> None:
    """Shuffle and write one folder per shard; readers sort a shard by ``slot``."""
    shuffle_into_shards(df, **options).write.mode("overwrite").partitionBy("shard").parquet(path)


def op2_shuffle_shards(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = shuffle_into_shards(docs)
    return out.select(
        "doc_id",
        (F.octet_length(or_empty("text")).cast("long") + 8).alias("size"),
        F.crc32(or_empty("text")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
