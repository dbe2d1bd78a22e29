"""Tokens, postings and BM25 as DataFrame operations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import map_arrow

#: Rows of a batch on its way back from a worker.
COUNTED_ROWS = 65_536
K1, B = 1.2, 0.75
SEPARATOR = r"[^\p{L}\p{N}]+"


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), SEPARATOR), lambda t: t != "")


def query_terms(spark, text: str) -> list[str]:
    """Distinct terms of a query, split just as documents are."""
    row = spark.range(1).select(F.array_distinct(tokens(F.lit(text))).alias("t")).first()
    return list(row["t"])


def searched_text(df: DataFrame, columns: list[str]) -> Column:
    return F.concat_ws(" ", *[F.col(c) for c in columns])


def postings(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``key``, ``term``, ``tf``, ``dl``: an index that can be written and read again for any query."""
    words = df.select(F.col(key).alias("key"), tokens(searched_text(df, columns)).alias("words"))
    return words.select("key", F.size("words").alias("dl"), F.explode("words").alias("term")).groupBy("key", "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a key and its words to ``key``, ``term``, ``tf``, ``dl``."""
    for batch in batches:
        words = batch.column(1)
        lengths = np.diff(words.offsets.to_numpy())
        coded = words.flatten().dictionary_encode()
        size = max(1, len(coded.dictionary))
        both, tf = np.unique(np.repeat(np.arange(len(lengths)), lengths) * size + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
        for at in range(0, len(both), COUNTED_ROWS):
            row, term = (pa.array(x) for x in np.divmod(both[at : at + COUNTED_ROWS], size))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(row), coded.dictionary.take(term), pa.array(tf[at : at + COUNTED_ROWS]), pa.array(lengths.astype(np.int32)).take(row)], ["key", "term", "tf", "dl"])


def counted(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``key``, ``term``, ``tf``, ``dl`` of each row by itself: as :func:`postings` where keys are unique, without a shuffle."""
    words = df.select(F.col(key).alias("key"), tokens(searched_text(df, columns)).alias("words"))
    return map_arrow(words, count_words, f"key {words.schema['key'].dataType.simpleString()}, term string, tf long, dl int")


def _is(word: str):
    return lambda t: t == word


def bm25(df: DataFrame, key: str, columns: list[str], terms: list[str], k1: float = K1, b: float = B) -> DataFrame:
    """``key``, ``score`` of all rows with any of the terms.

    The terms are known while planning, so each row counts them in its own token array: one scan, no postings shuffle; the
    collection's statistics are one row, joined by a broadcast of that row.
    """
    terms = list(dict.fromkeys(terms))
    words = df.select(F.col(key).alias("key"), tokens(searched_text(df, columns)).alias("words"))
    # occurrences of each term in one pass over the tokens that are terms at all
    hit = F.filter("words", lambda t: t.isin(terms)) if terms else F.array().cast("array<string>")
    words = words.select("key", F.size("words").alias("dl"), hit.alias("hit"))
    tf = words.select("key", "dl", *[F.size(F.filter("hit", _is(w))).alias(f"tf{k}") for k, w in enumerate(terms)])
    stats = tf.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *[F.sum((F.col(f"tf{k}") > 0).cast("long")).alias(f"df{k}") for k in range(len(terms))])
    score = F.lit(0.0)
    for k in range(len(terms)):
        idf = F.log(1 + (F.col("n") - F.col(f"df{k}") + 0.5) / (F.col(f"df{k}") + 0.5))
        norm = F.col(f"tf{k}") * (k1 + 1) / (F.col(f"tf{k}") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
        score = score + F.when(F.col(f"tf{k}") > 0, idf * norm).otherwise(0.0)
    any_hit = " OR ".join(f"tf{k} > 0" for k in range(len(terms))) or "false"
    return tf.where(any_hit).crossJoin(F.broadcast(stats)).select("key", score.alias("score"))
