"""Which texts mention which names.

A list of names that can travel becomes automata (Aho-Corasick) of bounded size; every text passes each automaton once, whatever the number of names, and no
text meets a name that it does not hold. A longer list, of any size, is for :func:`mentioned`: a text's words are joined with the rarest word of each name, and only
the pairs that meet are tested, which finds names as whole words.
"""

from __future__ import annotations

import unicodedata
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ConfigurationError
from ..session import map_arrow

#: Code points of the names of one automaton, and automata that a search makes at the most: their names travel to the executors.
AUTOMATON_CHARS, MOST_AUTOMATA = 2_000_000, 16
_WORD = r"[\p{L}\p{N}_]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_built: dict[str, object] = {}


def _automaton(number: str, words: list[tuple[str, list[str]]]):
    """The automaton of a list, built once a worker; the last two are kept."""
    import ahocorasick

    if number not in _built:
        for old in list(_built)[:-1]:
            del _built[old]
        made = ahocorasick.Automaton()
        for word, names in words:
            made.add_word(word, (len(word), names))
        made.make_automaton()
        _built[number] = made
    return _built[number]


def _of_word(char: str) -> bool:
    return char == "_" or unicodedata.category(char)[0] in "LN"


def _hits(texts: DataFrame, text: Column, words: DataFrame, whole: bool) -> DataFrame:
    """``key``, ``name`` of texts (``key``) that hold a word (``word``, ``name``), each once. ``whole``: no letter, digit or underscore may stand beside it."""
    words = words.where("word IS NOT NULL AND name IS NOT NULL AND word <> ''").groupBy("word").agg(F.collect_set("name").alias("names"))
    size = words.agg(F.coalesce(F.sum(F.length("word") + F.aggregate("names", F.lit(0), lambda a, n: a + F.length(n))), F.lit(0))).first()[0]
    groups = max(1, -(-size // AUTOMATON_CHARS))
    if groups > MOST_AUTOMATA:
        raise ConfigurationError(f"The names have {size} characters", f"Up to {AUTOMATON_CHARS * MOST_AUTOMATA} can travel; `mentioned` joins names of any number by their words.")
    kind, out = texts.schema["key"].dataType.simpleString(), None
    for group in range(groups):
        listed = [(r["word"], r["names"]) for r in words.where(F.pmod(F.xxhash64("word"), F.lit(groups)) == group).collect()]  # about AUTOMATON_CHARS
        shared, number = texts.sparkSession.sparkContext.broadcast(listed), uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch], shared=shared, number=number) -> Iterator[pa.RecordBatch]:
            found = _automaton(number, shared.value) if shared.value else None
            for batch in batches:
                keys, names = [], []
                for row, value in enumerate(batch.column(1).to_pylist()):
                    mine = set()
                    for end, (size, own) in found.iter(value) if found and value else ():
                        start = end + 1 - size
                        if not whole or not (start and _of_word(value[start - 1])) and not (end + 1 < len(value) and _of_word(value[end + 1])):
                            mine.update(own)
                    keys += [row] * len(mine)
                    names += sorted(mine)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keys, pa.int64())), pa.array(names, pa.string())], ["key", "name"])

        one = map_arrow(texts.select("key", text.alias("text")), run, f"key {kind}, name string")
        out = one if out is None else out.unionByName(one)
    return out if groups == 1 else out.distinct()


def contained(texts: DataFrame, key: str, text: str, names: DataFrame, name: str) -> DataFrame:
    """``key``, ``name``: texts that hold the name anywhere, letters of either case being the same. A list too long to travel is an error."""
    words = names.select(F.lower(name).alias("word"), F.col(name).alias("name"))
    return _hits(texts.select(F.col(key).alias("key"), F.col(text).alias("__text")), F.lower("__text"), words, False)


def mentioned(texts: DataFrame, key: str, text: str, names: DataFrame, name: str) -> DataFrame:
    """``key``, ``name``: texts in which the name stands as whole words, letters of either case being the same.

    An equi-join on words, so that both sides may be large: a text meets only names whose rarest word it has.
    """
    rows = texts.select(F.col(key).alias("key"), F.lower(text).alias("__low"))
    words = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit(_WORD), F.lit(0)))
    wanted = names.select(F.col(name).alias("name")).where("name IS NOT NULL").distinct().withColumn("__n", F.lower("name"))
    parts = wanted.select("name", "__n", F.explode(words(F.col("__n"))).alias("word"))
    of_texts = rows.select("key", F.explode(words(F.col("__low"))).alias("word"))
    asked = parts.select("word").distinct()
    common = of_texts.join(asked, "word", "left_semi").groupBy("word").agg(F.count("*").alias("times"))
    rarest = parts.join(common, "word", "left").groupBy("name", "__n").agg(F.min(F.struct(F.coalesce("times", F.lit(0)).alias("times"), "word")).alias("r"))
    rarest = rarest.where("r.times > 0").select("name", "__n", F.col("r.word").alias("word"))
    pairs = of_texts.join(rarest, "word").select("key", "name", "__n")
    quoted = F.concat(F.lit(r"(?<![\p{L}\p{N}_])\Q"), F.regexp_replace("__n", r"\\E", r"\\E\\\\E\\Q"), F.lit(r"\E(?![\p{L}\p{N}_])"))
    return pairs.join(rows, "key").where(F.col("__low").contains(F.col("__n"))).where(F.regexp_like("__low", quoted)).select("key", "name").distinct()


def pattern_mentions(texts: DataFrame, key: str, text: str, aliases: dict[str, list[str]] | DataFrame) -> DataFrame:
    """``key``, ``name``: texts in which any alias of a name stands as whole words, ASCII letters of either case being the same.

    ``aliases``: the aliases of each name, or a table of them (``name``, ``alias``).
    """
    if isinstance(aliases, dict):
        aliases = texts.sparkSession.createDataFrame([(n, a) for n, words in aliases.items() for a in words], "name string, alias string")
    low = lambda c: F.translate(c, UPPER, LOWER)
    return _hits(texts.select(F.col(key).alias("key"), F.col(text).alias("__text")), low("__text"), aliases.select(low("alias").alias("word"), "name"), True)
