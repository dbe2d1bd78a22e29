"""Benchmark decontamination by winnowing, in DataFrame functions only.

A window of 13 words holds six hashes of eight consecutive words; the smallest of the six is the window's fingerprint.
Equal windows have equal fingerprints, so whatever 13 words a document shares with the benchmark, both sides keep the same
minimum there: the guarantee of winnowing for every shared span of 13 words. Fingerprints are joined first; only documents
with a fingerprint of the benchmark are extended to whole windows, whose words are compared as text.
Items of fewer than 13 words are one window each; their lengths that occur (twelve at most) each get fingerprints of
that many words.

One pass over the texts gives their word counts and suspects. A word is hashed once; runs of two, four and eight words, and the minima of two, four and six
of their hashes, come from pairs of neighbours, so that no step looks at more than two entries.

Defined cases: a null or wordless text has no words, no hits and is not contaminated; null and wordless items have no
window; null item_ids mark hits but are not listed; repeated document rows each get the same result; an empty
benchmark leaves all documents clean; documents of one doc_id with different texts are told apart by a hash of the text; a very long text is
one row of its words, which must fit a task; other columns are ignored, and those of documents travel through :func:`drop_contaminated`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# An inner explode makes the optimizer test the array's size first, and it pushes that test down through the projections, where
# arrays would be made anew for each element of a lambda; explode_outer keeps each array computed once.
from .common import ascii_lower, checkpoint, or_empty

WINDOW = 13
GRAM = 8
#: Hashes of GRAM words in a window; with GRAM words each they span WINDOW words.
PER_WINDOW = WINDOW - GRAM + 1
#: A benchmark is broadcast up to so many bytes of windows, and a set of documents' keys up to so many rows; else joins shuffle.
BROADCAST_BYTES = 16_000_000
BROADCAST_KEYS = 200_000


def alnum_words(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(text), F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0))


#: Stands for the document itself among its fingerprints, which are even.
DOCUMENT = 1


def _hashed(a: Column, b: Column) -> Column:
    return F.xxhash64(a, b)


def _less(a: Column, b: Column) -> Column:
    return F.least(a, b)


def _ahead(array: str, n: int) -> Column:
    return F.slice(array, F.lit(n + 1), F.size(array))


def _pairs(df: DataFrame, out: str, left: str, right: str, n: int, join) -> DataFrame:
    """``out``: each entry of ``left`` joined with the entry of ``right`` that is ``n`` places on; past its end ``left``'s alone."""
    return df.withColumn(out, F.zip_with(left, _ahead(right, n), join))


def _gram_hashes(df: DataFrame, hashes: str, out: str, size: int) -> DataFrame:
    """``out``: for each place the hash of ``size`` words from there; the last ``size - 1`` entries are of fewer words."""
    half = 1 << (size.bit_length() - 1)
    if size == 1:
        return df.withColumn(out, F.col(hashes))
    rest = half if size > half else half // 2
    names = [f"{out}a", f"{out}b"]
    df = _gram_hashes(df, hashes, names[0], size - rest if size > half else rest)
    if size == half:  # two equal halves
        return _pairs(df, out, names[0], names[0], rest, _hashed).drop(names[0])
    df = _gram_hashes(df, hashes, names[1], rest)
    return _pairs(df, out, names[0], names[1], size - rest, _hashed).drop(*names)


def _fingerprints(df: DataFrame, words: str, lengths: list[int], out: str) -> DataFrame:
    """``out``: the distinct fingerprints of all windows of the given lengths."""
    n, parts = F.size(words), []
    df = df.withColumn("__h", F.transform(words, lambda w: F.xxhash64(w)))
    for length in lengths:
        name = f"__f{length}"
        if length == WINDOW:
            df = _gram_hashes(df, "__h", "__g", GRAM)
            df = _pairs(df, "__m2", "__g", "__g", 1, _less)
            df = _pairs(df, "__m4", "__m2", "__m2", 2, _less)
            df = _pairs(df, "__m6", "__m4", "__m2", PER_WINDOW - 2, _less).drop("__g", "__m2", "__m4")
            df = df.withColumn(name, F.when(n >= WINDOW, F.slice("__m6", F.lit(1), F.greatest(n - WINDOW + 1, F.lit(1))))).drop("__m6")
        else:
            df = _gram_hashes(df, "__h", "__g", length)
            df = df.withColumn(name, F.when(n >= length, F.slice("__g", F.lit(1), F.greatest(n - length + 1, F.lit(1))))).drop("__g")
        df = df.withColumn(name, F.coalesce(F.transform(F.array_distinct(name), lambda x: x.bitwiseAND(F.lit(-2).cast("long"))), F.array().cast("array<bigint>")))
        parts.append(name)
    return df.withColumn(out, F.concat(*parts)).drop("__h", *parts)


def _windows(words: Column, length: int) -> Column:
    """All windows of a length as text; words hold no space, so the text tells its words."""
    places = F.when(F.size(words) >= length, F.sequence(F.lit(0), F.size(words) - length)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda p: F.struct(p.alias("p"), F.lit(length).alias("len"), F.array_join(F.slice(words, p + 1, length), " ").alias("win")))


def benchmark_windows(benchmark: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """One row per distinct window: ``win``, ``len``, ``items``."""
    words = benchmark.select(F.col(item).alias("__item"), alnum_words(or_empty(text)).alias("__w"))
    length = F.least(F.size("__w"), F.lit(WINDOW))
    places = F.when(F.size("__w") > 0, F.sequence(F.lit(0), F.size("__w") - length))
    wins = F.transform(places, lambda p: F.array_join(F.slice("__w", p + 1, length), " "))
    rows = words.select("__item", length.alias("len"), F.explode_outer(F.array_distinct(wins)).alias("win")).where("win IS NOT NULL")
    return rows.groupBy("win", "len").agg(F.collect_set("__item").alias("items"))


def find_contamination(docs: DataFrame, benchmark: DataFrame, doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per document row: ``doc_id``, ``text_key``, ``n_words``, ``n_hit``, ``n_items``, ``items`` (sorted as strings), ``contaminated``."""
    docs = docs.select(F.col(doc).alias("doc_id"), or_empty(text).alias("__t"))
    docs = docs.withColumn("text_key", F.xxhash64("__t"))
    bench = checkpoint(benchmark_windows(benchmark, item, item_text))
    found = bench.groupBy("len").agg(F.sum(F.octet_length("win") + 64 + 16 * F.size("items")).alias("bytes")).collect()  # thirteen rows at most
    lengths = sorted(r["len"] for r in found) or [WINDOW]
    small = sum(r["bytes"] for r in found) <= BROADCAST_BYTES
    hint = F.broadcast if small else (lambda df: df)

    worded = docs.withColumn("__w", alnum_words(F.col("__t")))
    prints = _fingerprints(bench.select(F.split("win", " ").alias("__w"), "len"), "__w", lengths, "__f")
    prints = prints.select(F.explode_outer("__f").alias("fp")).where("fp IS NOT NULL").distinct()
    prints = prints.union(docs.sparkSession.range(1).select(F.lit(DOCUMENT).cast("long")))
    marks = _fingerprints(worded.select("doc_id", "text_key", "__w"), "__w", lengths, "__f").select("doc_id", "text_key", F.size("__w").cast("long").alias("n_words"), F.concat(F.array(F.lit(DOCUMENT).cast("long")), "__f").alias("__f"))
    marks = marks.select("doc_id", "text_key", "n_words", F.explode_outer("__f").alias("fp"))
    # a row for each document, and one for each fingerprint that it shares with the benchmark
    seen = checkpoint(marks.join(hint(prints), "fp", "left_semi"))
    suspects = checkpoint(seen.where(F.col("fp") != DOCUMENT).select("doc_id", "text_key").distinct())
    few = suspects.count() <= BROADCAST_KEYS

    same = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & (a["text_key"] == b["text_key"])
    near = F.broadcast(suspects) if few else suspects
    held = docs.join(near, same(docs, near), "left_semi").withColumn("__w", alnum_words(F.col("__t")))
    places = F.concat(*[_windows(F.col("__w"), length) for length in lengths])
    rows = held.select("doc_id", "text_key", F.explode_outer(places).alias("s")).select("doc_id", "text_key", "s.p", "s.len", "s.win")
    hits = rows.join(hint(bench.select("win", "items")), "win")
    by_doc = hits.groupBy("doc_id", "text_key").agg(
        F.sort_array(F.collect_set(F.struct("p", "len"))).alias("spans"),
        F.collect_set("items").alias("lists"),
    )
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda acc, s: F.struct(
            F.greatest(acc["end"], s["p"] + s["len"]).alias("end"),
            (acc["n"] + F.greatest(F.lit(0), s["p"] + s["len"] - F.greatest(acc["end"], s["p"]))).alias("n"),
        ),
        lambda acc: acc["n"].cast("long"),
    )
    items = F.sort_array(F.transform(F.array_distinct(F.flatten("lists")), lambda x: x.cast("string")))
    by_doc = by_doc.select(F.col("doc_id").alias("__d"), F.col("text_key").alias("__k"), covered.alias("n_hit"), items.alias("items"))
    by_doc = checkpoint(by_doc)
    if by_doc.agg(F.coalesce(F.sum(64 + F.octet_length(F.array_join("items", ","))), F.lit(0))).first()[0] <= BROADCAST_BYTES:
        by_doc = F.broadcast(by_doc)
    counted = seen.where(F.col("fp") == DOCUMENT).select("doc_id", "text_key", "n_words")
    out = counted.join(by_doc, counted["doc_id"].eqNullSafe(by_doc["__d"]) & (counted["text_key"] == by_doc["__k"]), "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select(
        "doc_id",
        "text_key",
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that are not contaminated, in the columns of ``docs``."""
    bad = find_contamination(docs, benchmark, doc, text).where("contaminated").select(F.col("doc_id").alias("__d"), F.col("text_key").alias("__k")).distinct()
    return docs.join(bad, docs[doc].eqNullSafe(bad["__d"]) & (F.xxhash64(or_empty(docs[text])) == bad["__k"]), "left_anti")


def op3_decontaminate(spark, sf_dir: str) -> DataFrame:
    found = find_contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


_SQL_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE_SQL = f"""
WITH b AS (SELECT item_id, {_SQL_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 13) AS k, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') AS g
       FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM b WHERE len(w) > 0)),
d AS (SELECT doc_id, {_SQL_WORDS} AS w FROM documents),
dw AS (SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS g
       FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM bw))),
h AS (SELECT doc_id, dw.k, i, item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.g = bw.g),
hp AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM h) GROUP BY 1),
hi AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM h GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated
FROM d LEFT JOIN hp ON d.doc_id = hp.doc_id LEFT JOIN hi ON d.doc_id = hi.doc_id
"""
