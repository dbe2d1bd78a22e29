"""Vector arithmetic and codecs over array columns, in built-in functions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import codecs
from .codecs import SHORTLIST

#: Known vectors of so many components are written out in generated code; longer ones are one array literal.
UNROLLED = 128


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def magnitude(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def direction(v: Column, r: Column) -> Column:
    return F.transform(v, lambda x: F.when(r == 0, F.lit(0.0)).otherwise(x.cast("double") / r))


def literal(vector: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def dot_with(v: Column, query: list[float]) -> Column:
    """The dot product with a known vector: component by component in generated code while that stays small."""
    if len(query) > UNROLLED:
        return dot(v, literal(query))
    total = F.lit(0.0)
    for i, x in enumerate(query):
        total = total + F.get(v, F.lit(i)).cast("double") * float(x)
    return total


def cosine_with(v: Column, query: list[float]) -> Column:
    """Cosine with a known vector; 0 where the row has no length."""
    norm = math.sqrt(sum(float(x) * float(x) for x in query))
    r = magnitude(v)
    return F.when(r == 0, 0.0).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot_with(v, query) / (r * norm))))


def int8_scale(v: Column) -> Column:
    return F.array_max(F.transform(v, lambda x: F.abs(x.cast("double"))))


def int8_codes(v: Column, scale: Column) -> Column:
    """round(u * 127 / scale), halves to even, within +-127."""
    return F.transform(v, lambda x: F.when(scale == 0, F.lit(0)).otherwise(F.greatest(F.lit(-127), F.least(F.lit(127), F.bround(x.cast("double") * 127 / scale, 0).cast("int")))))


def sign_bits(v: Column) -> Column:
    return F.transform(v, lambda x: F.when(x >= 0, 1).otherwise(0))


def hamming(a: Column, bits: list[int]) -> Column:
    total = F.lit(0)
    for i, x in enumerate(bits):
        total = total + F.when(F.get(a, F.lit(i)) != x, 1).otherwise(0)
    return total


def int8_score(v: Column, query: list[float]) -> Column:
    """What the int8 code of a vector says about the dot product with the query's direction, in built-in functions."""
    norm = math.sqrt(sum(x * x for x in query)) or 1.0
    scale = int8_scale(v)
    return dot_with(int8_codes(v, scale), [x / norm for x in query]) * scale / 127


def top_k(df: DataFrame, key: str, vector: str, query: list[float], k: int, codec: str = "fp32", code: str | None = None) -> DataFrame:
    """``key``, ``score`` of the k nearest rows by cosine. Coded search scores codes first and rescores SHORTLIST * k exactly.

    With ``code``, a column of stored codes, only keys and codes are read for the shortlist and vectors for its few rows; without one the codes
    are made on the way. Both limits are a top-k per task and a merge of tops.
    """
    codecs.check_codec(codec)
    if not any(query):
        return df.select(F.col(key).alias("key"), F.lit(0.0).alias("score")).limit(0)
    rows = df.where(F.col(vector).isNotNull()).select(F.col(key).alias("key"), F.col(vector).alias("v"))
    if codec != "fp32":
        few = codecs.shortlist(df, key, code or vector, query, SHORTLIST * k, codec, code is not None)
        rows = rows.join(F.broadcast(few.select("key")), "key")  # SHORTLIST * k rows at the most
    return rows.select("key", cosine_with(F.col("v"), query).alias("score")).orderBy(F.desc("score"), "key").limit(k)
