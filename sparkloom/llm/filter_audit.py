"""Filter interaction audit: what each of five filters removes in every order in which they may run.

1. One pass over the texts tests filters A to D and hashes each text in blocks of growing size.
2. Duplicates (filter E) by partition refinement: classes of equal length in UTF-8 bytes are split by the hash of one block
   after another, and a class of one leaves at once. The texts that survive all blocks are compared as they are, and the ids
   that are not the least of their text are marked.
3. Documents are counted by part and by mask, the letters of the filters that they fail. All orders, steps and Shapley sums follow from these few counts.

A class or text that a third of all rows share is a partial count in every task, and a key of joins that adaptive execution splits.

Defined cases: a null text is an empty one and so equal to it; a null doc_id is no smaller id than another and never a duplicate; repeated rows
count each; rows of one doc_id are duplicates only of a smaller doc_id; a null part is the empty string; a document with several labels has what any of them
says; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_WORD, checkpoint, or_empty

FILTERS = "ABCDE"
ORDERS = ["".join(order) for order in permutations(FILTERS)]
MIN_WORDS, LEAST_DISTINCT_PERCENT, MOST_CAPITALS_PERCENT = 200, 50, 3
SYMBOL = r"[#$%&*|]"
#: Bytes of a text's first block; each later block is GROWTH times as long.
FIRST_BLOCK, GROWTH = 128, 4
#: (start, length) of blocks; what lies beyond them, at 715 MB, only the comparison of texts sees.
BLOCKS = [(FIRST_BLOCK * (GROWTH**k - 1) // (GROWTH - 1), FIRST_BLOCK * GROWTH**k) for k in range(12)]
#: Classes that are broadcast, of eight bytes each; more are joined by a shuffle.
BROADCAST_CLASSES = 500_000


def _block_hash(block: Column) -> Column:
    return F.xxhash64(block)


def _blocks(data: Column, block_hash=_block_hash) -> Column:
    """A hash of each block of the text's bytes. A block of bytes is cut out in time of its length; one of code points would be counted from the text's start."""
    spans = F.array(*[F.struct(F.lit(a).alias("at"), F.lit(n).alias("n")) for a, n in BLOCKS])
    return F.transform(F.filter(spans, lambda s: s["at"] < F.octet_length(data)), lambda s: block_hash(F.substring(data, s["at"] + 1, s["n"])))


def _class_of(size: Column, blocks: Column) -> Column:
    """The class to which a text belongs once all its blocks have been seen."""
    return F.aggregate(blocks, F.xxhash64(size), lambda acc, b: F.xxhash64(acc, b))


def failure_mask(text: Column) -> Column:
    """The letters of the filters A to D that the text fails."""
    words = F.regexp_extract_all(text, F.lit(SPACE_WORD), F.lit(0))
    tests = {
        "A": F.size(words) < MIN_WORDS,
        "B": 100 * F.size(F.array_distinct(words)) < LEAST_DISTINCT_PERCENT * F.size(words),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > MOST_CAPITALS_PERCENT * F.length(text),
        "D": F.regexp_like(text, F.lit(SYMBOL)),
    }
    return F.concat(*[F.when(test, name).otherwise("") for name, test in tests.items()])


def shared_classes(rows: DataFrame) -> DataFrame:
    """``class`` of two or more rows that agree in length and in every block. ``rows``: ``size``, ``blocks``."""
    live = rows.select(F.xxhash64("size").alias("class"), "blocks")
    out = None
    for k in range((rows.agg(F.max(F.size("blocks"))).first()[0] or 0) + 1):
        several = live.groupBy("class").agg(F.count("*").alias("n")).where("n > 1").select("class")
        left = checkpoint(live.join(several, "class", "left_semi"))
        ended = left.where(F.size("blocks") == k).select("class").distinct()
        out = ended if out is None else out.unionByName(ended)
        live = left.where(F.size("blocks") > k).select(F.xxhash64("class", F.get("blocks", F.lit(k))).alias("class"), "blocks")
    return checkpoint(out)


def _with_bytes(docs: DataFrame) -> DataFrame:
    return docs.withColumn("data", F.col("text").cast("binary"))


def _duplicates(docs: DataFrame, described: DataFrame, block_hash=_block_hash) -> DataFrame:
    """``described`` (``doc_id``, ``class``, ...) with ``twice``: "E" for the documents whose text a smaller doc_id has, else null."""
    classes = shared_classes(described)
    if classes.count() <= BROADCAST_CLASSES:
        classes = F.broadcast(classes)
    texts = _with_bytes(docs).select("doc_id", "text", _class_of(F.octet_length("data"), _blocks(F.col("data"), block_hash)).alias("class")).join(classes, "class", "left_semi")
    least = checkpoint(texts.groupBy("class", "text").agg(F.min("doc_id").alias("least")).groupBy("class").agg(F.count("*").alias("texts"), F.min("least").alias("least")))
    alike = described.join(least.where("texts = 1").drop("texts"), "class", "left").withColumn("twice", F.when(F.col("doc_id") > F.col("least"), "E")).drop("least")
    several = least.where("texts > 1").select("class")
    if several.isEmpty():
        return alike
    # different texts of equal length and block hashes: their documents are compared by the texts themselves
    apart = texts.join(several, "class", "left_semi")
    own = apart.groupBy("class", "text").agg(F.min("doc_id").alias("least"))
    more = apart.join(own, ["class", "text"]).where("doc_id > least").select("doc_id", "class").distinct().withColumn("more", F.lit("E"))
    return alike.join(more, ["doc_id", "class"], "left").withColumn("twice", F.coalesce("twice", "more")).drop("more")


def failed_filters(docs: DataFrame, doc: str = "doc_id", text: str = "text", part: str = "lang", block_hash=_block_hash) -> DataFrame:
    """Per row ``doc_id``, ``part`` and ``mask``, the letters of all filters that the document fails."""
    docs = docs.select(F.col(doc).cast("long").alias("doc_id"), or_empty(text).alias("text"), or_empty(part).alias("part"))
    words = _with_bytes(docs).select("doc_id", "part", failure_mask(F.col("text")).alias("mask"), F.octet_length("data").alias("size"), _blocks(F.col("data"), block_hash).alias("blocks"))
    described = checkpoint(words.withColumn("class", _class_of(F.col("size"), F.col("blocks"))))
    marked = _duplicates(docs, described, block_hash)
    return marked.select("doc_id", "part", F.concat("mask", F.coalesce("twice", F.lit(""))).alias("mask"))


def audit_filters(docs: DataFrame, labels: DataFrame, doc: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """Per part, order and step: ``kept``, ``removed``, ``redundant``, ``unique_fails``, ``good_lost``, ``toxic_lost``, ``shapley``."""
    said = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "toxic").groupBy("doc_id")
    said = said.agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    rows = failed_filters(docs, doc, text, part).join(said, "doc_id", "left")
    counts = rows.groupBy("part", "mask").agg(F.count("*").alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))
    # at most 32 rows a part from here on
    each = counts.withColumn("filter_order", F.explode(F.split(F.lit(",".join(ORDERS)), ","))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    own = F.expr("substring(filter_order, step, 1)")
    fails, gone = F.contains(F.col("mask"), own), F.expr("translate(mask, substring(filter_order, 1, step - 1), '')") != F.col("mask")
    total = lambda test, what="n": F.coalesce(F.sum(F.when(test, F.col(what))), F.lit(0)).alias
    # of a document's failed filters each comes first in an equal share of the orders
    share = F.when(fails, F.col("n") * (F.lit(len(ORDERS)) / F.length("mask")).cast("long"))
    return each.groupBy("part", "filter_order", "step").agg(
        total(~fails & ~gone)("kept"),
        total(fails & ~gone)("removed"),
        total(fails & gone)("redundant"),
        total(F.col("mask") == own)("unique_fails"),
        total(fails & ~gone, "good")("good_lost"),
        total(fails & ~gone, "toxic")("toxic_lost"),
        F.coalesce(F.sum(share), F.lit(0)).alias("shapley"),
    )


def op12_filter_audit(spark, sf_dir: str) -> DataFrame:
    return audit_filters(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


ORACLE_SQL = r"""
WITH RECURSIVE orders AS (
  SELECT '' AS o UNION ALL SELECT o || f FROM orders, (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) AS v(f) WHERE NOT contains(o, f)
), w AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), fails AS (
  SELECT part, doc_id,
    (CASE WHEN len(w) < 200 THEN 'A' ELSE '' END) || (CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END)
    || (CASE WHEN 100 * len(regexp_extract_all(t, '[A-Z]')) > 3 * length(t) THEN 'C' ELSE '' END) || (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END)
    || (CASE WHEN min(doc_id) OVER (PARTITION BY t) < doc_id THEN 'E' ELSE '' END) AS m,
    EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = w.doc_id AND l.quality = 1) AS good, EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = w.doc_id AND l.toxic = 1) AS toxic
  FROM w
), counts AS (SELECT part, m, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM fails GROUP BY part, m),
steps AS (SELECT o, step, o[step] AS f, o[1 : step - 1] AS earlier FROM orders, range(1, 6) AS r(step) WHERE length(o) = 5),
each AS (SELECT part, o, step, f, m, n, good, toxic, contains(m, f) AS fails, translate(m, earlier, '') <> m AS gone FROM counts, steps),
first AS (SELECT part, f, sum(n) AS shapley FROM each WHERE fails AND NOT gone GROUP BY part, f)
SELECT part, o AS filter_order, step::INTEGER AS step,
  coalesce(sum(n) FILTER (NOT fails AND NOT gone), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (fails AND NOT gone), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (fails AND gone), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (m = f), 0)::BIGINT AS unique_fails,
  coalesce(sum(good) FILTER (fails AND NOT gone), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (fails AND NOT gone), 0)::BIGINT AS toxic_lost,
  coalesce(any_value(shapley), 0)::BIGINT AS shapley
FROM each LEFT JOIN first USING (part, f) GROUP BY part, o, step
"""
