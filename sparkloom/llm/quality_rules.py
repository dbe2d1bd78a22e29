"""Line-first quality rules, in DataFrame functions only.

Every line is judged on its own: by punctuation (marks after most words, no mark at its end), by its words (capitals, words without
letters, links), as navigation and as boilerplate. Failing lines are removed; a document goes if it fails the base rules or loses too
much of its text.

Defined cases: a null text counts as an empty one (no words, rejected, cleaned text empty); an empty table
gives an empty table; repeated rows and rows of one doc_id are judged each on their own; a very long text is one row of its words, which must
fit a task; all other columns pass through, and a column named like one of the results is replaced by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_WORD, let, or_empty

SYMBOL = r"[#*$%&|<>]"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A document that loses more than this share of the characters of its lines is rejected.
MAX_LOST = 0.5
#: A line fails the punctuation rule if symbols or marks other than sentence marks follow more than this share of its words.
MAX_MARKED_WORDS = 0.5
#: Shares of a line's words, and words that a line needs to be judged by them.
MAX_CAPITALS, MAX_LETTERLESS, MAX_LINKS = 0.8, 0.4, 0.3
LEAST_SHOUTED, LEAST_LETTERLESS = 8, 5
#: Lines of so many words need a mark at their end: fragments of menus and lists have none, longer ones are prose all the same.
ENDED_WORDS = (5, 30)
#: A stock phrase fails a line of so many words at the most.
BOILERPLATE_WORDS = 20
_SPACE = r"\x20\x09-\x0D"
#: Marks with which a line of prose may end.
_CLOSING = ".!?…:;\"'”»’)]。！？"
_LETTERS = r"A-Za-z\x{80}-\x{10FFFF}"
BOILERPLATE = ("lorem ipsum", "javascript", "cookie policy", "privacy policy", "terms of use", "terms of service", "all rights reserved", "click here")


def _repeat_count(df: DataFrame, words: str, out: str) -> DataFrame:
    """Add ``out``: how many words of the array stand in a three-word window that occurs twice or more in it.

    Each window becomes one long: a hash in the high bits, its place in the low bits. After a sort of the longs
    equal windows are neighbours; their words are compared, so that equal hash bits alone count for nothing.
    """
    n, high, packed, near, places = (F.col(f"__{x}") for x in ("n", "hi", "p", "c", "h"))
    df = df.withColumn("__n", F.size(words)).withColumn("__hi", -F.call_function("shiftleft", F.lit(1).cast("long"), F.ceil(F.log2(n + 2)).cast("int")))
    window = lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)).bitwiseAND(high).bitwiseOR(i.cast("long"))
    df = df.withColumn("__p", F.sort_array(F.when(n > 3, F.transform(F.slice(words, F.lit(1), n - 2), window))))
    alike = lambda x, other: x.bitwiseXOR(other).bitwiseAND(high) == 0  # noqa: E731  null past either end, which filters as false
    df = df.withColumn("__c", F.filter(packed, lambda x, i: alike(x, F.get(packed, i + 1)) | alike(x, F.get(packed, i - 1))))
    place = lambda x: x.bitwiseAND(F.bitwise_not(high)).cast("int")
    equal = lambda a, b: (F.get(words, place(a)) == F.get(words, place(b))) & (F.get(words, place(a) + 1) == F.get(words, place(b) + 1)) & (F.get(words, place(a) + 2) == F.get(words, place(b) + 2))
    sure = F.when(F.size(near) > 0, F.filter(near, lambda x, i: equal(x, F.get(near, i + 1)) | equal(x, F.get(near, i - 1))))
    df = df.withColumn("__h", F.sort_array(F.transform(sure, place)))
    covered = F.transform(places, lambda p, i: F.when(i == 0, 3).otherwise(F.least(F.lit(3), p - F.get(places, i - 1))))
    total = F.when(F.size(places) > 0, F.aggregate(covered, F.lit(0), lambda a, b: a + b)).otherwise(0)
    return df.withColumn(out, total.cast("long")).drop("__n", "__hi", "__p", "__c", "__h")


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))


def _marked(line: Column) -> Column:
    """Punctuation rule: runs of symbols or of doubled marks follow most words, as in ``word$$$ word!! word###``."""
    return F.regexp_count(line, F.lit(r"(?:[#*$%&<>]|[!?]{2,})(?=[\x20\x09-\x0D]|$)")) > F.lit(MAX_MARKED_WORDS) * F.regexp_count(line, F.lit(SPACE_WORD))


def _navigation(line: Column) -> Column:
    """Navigation rule: three separators or more that stand alone, as in ``Home | News | Contact |``."""
    separators = F.regexp_count(line, F.lit(r"(?<![^\x20\x09-\x0D])[|»›•·>](?![^\x20\x09-\x0D])"))
    return (separators >= 3) & (4 * separators >= F.regexp_count(line, F.lit(SPACE_WORD)))


def _has_phrase(text: Column, found: Column) -> Column:
    """``found``, or a stock phrase stands in ``text`` as listed, with large first letters, or in capitals."""
    for phrase in BOILERPLATE:
        for form in dict.fromkeys((phrase, phrase.capitalize(), phrase.title(), phrase.upper())):
            found = found | text.contains(form)
    return found


def _words(line: Column) -> Column:
    return F.regexp_count(line, F.lit(SPACE_WORD))


def _whole_words(line: Column, word: str) -> Column:
    """How many words of the line match as a whole."""
    return F.regexp_count(line, F.lit(f"(?<![^{_SPACE}])(?:{word})(?![^{_SPACE}])"))


def _unended(line: Column) -> Column:
    """Second punctuation rule: a short line that no closing mark ends."""
    last = F.right(F.rtrim(line, F.lit(" \t\x0b\x0c\r")), F.lit(1))
    return (F.instr(F.lit(_CLOSING), last) == 0) & _words(line).between(*ENDED_WORDS)


def _shouted(line: Column) -> Column:
    """Word rule: most words have capitals and no small letters."""
    n = _words(line)
    return (n >= LEAST_SHOUTED) & (_whole_words(line, f"[^a-z{_SPACE}]*?[A-Z][^a-z{_SPACE}]*+") >= F.lit(MAX_CAPITALS) * n)


def _letterless(line: Column) -> Column:
    """Word rule: many words hold no letter."""
    n = _words(line)
    return (n >= LEAST_LETTERLESS) & (_whole_words(line, f"[^{_LETTERS}{_SPACE}]++") > F.lit(MAX_LETTERLESS) * n)


def _linked(line: Column) -> Column:
    """Word rule: many words are links."""
    return _whole_words(line, f"(?:https?://|www[.])[^{_SPACE}]*+") > F.lit(MAX_LINKS) * _words(line)


def _phrase(text: Column) -> Column:
    return _has_phrase(text, F.lit(False))


#: Rules with the test that a text, and then a line of it, must pass before they are worth trying; it means the same for both.
_RULES = (
    (lambda t: t.rlike(r"[#*$%&<>|»›•·]|[!?]{2}"), lambda line: _marked(line) | _navigation(line)),
    (lambda t: t.rlike(r"[A-Z][^a-z]{15}"), _shouted),
    (lambda t: t.rlike(f"(?:^|[{_SPACE}])[^{_LETTERS}{_SPACE}]"), _letterless),
    (lambda t: t.contains("http") | t.contains("www."), _linked),
    (_phrase, lambda line: _words(line) <= BOILERPLATE_WORDS),
)


def line_fails(line: Column, worth: list[Column] | None = None) -> Column:
    """Whether any rule removes the line. ``worth``: what the tests of the whole text say, rule by rule; cheap tests stand before the costly ones."""
    fails = _unended(line)
    for k, (test, rule) in enumerate(_RULES):
        passed = test(line) & rule(line)
        fails = fails | (passed if worth is None else worth[k] & passed)
    return fails


def _parted(text: Column) -> Column:
    """``bad``: the failing lines; ``clean``: the text without them. The whole text is tested once for each rule before its lines are."""
    worth = F.struct(*[test(text).alias(f"w{k}") for k, (test, _) in enumerate(_RULES)])
    flags = lambda w: [w[f"w{k}"] for k in range(len(_RULES))]
    blank = lambda line: ~line.rlike(f"[^{_SPACE}]")
    judged = let(worth, lambda w: F.transform(F.split(text, "\n", -1), lambda line: F.struct(line.alias("line"), (~blank(line) & line_fails(line, flags(w))).alias("bad"))))
    lines = lambda rows: F.transform(rows, lambda r: r["line"])
    return let(judged, lambda rows: let(F.filter(rows, lambda r: r["bad"]), lambda bad: F.struct(lines(bad).alias("bad"), F.when(F.size(bad) == 0, text).otherwise(F.array_join(lines(F.filter(rows, lambda r: ~r["bad"])), "\n")).alias("clean"))))


def apply_quality_rules(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with ``cleaned_text``, ``lost_chars``, the base counts, ``base_failed`` and ``kept``."""
    out = df.withColumn("__t", or_empty(text)).withColumn("__w", F.regexp_extract_all(F.col("__t"), F.lit(SPACE_WORD), F.lit(0)))
    out = out.withColumn("__l", _lines(F.col("__t")))
    out = _repeat_count(out, "__w", "n_repeat_words")
    out = (
        out.withColumn("n_words", F.size("__w").cast("long"))
        .withColumn("word_chars", F.length(F.array_join("__w", "")).cast("long"))
        .withColumn("n_symbols", F.length(F.regexp_replace("__t", r"[^#*$%&|<>]+", "")).cast("long"))
        .withColumn("n_dup_lines", (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long"))
        .withColumn("base_failed", (F.size("__w") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.size("__w")))
        .withColumn("__p", _parted(F.col("__t")))
    )
    chars = lambda lines: F.coalesce(F.length(F.array_join(lines, "")), F.lit(0)).cast("long")
    out = out.withColumn("lost_chars", chars(F.col("__p.bad"))).withColumn("cleaned_text", F.col("__p.clean"))
    kept = ~F.col("base_failed") & (F.col("lost_chars") <= F.lit(MAX_LOST) * chars("__l"))
    return out.withColumn("kept", kept).drop("__t", "__w", "__l", "__p")


def filter_quality(df: DataFrame, text: str = "text") -> DataFrame:
    """The kept documents with their cleaned text, in the columns of ``df``."""
    judged = apply_quality_rules(df.select(F.struct(*df.columns).alias("__row"), F.col(text).alias("__in")), "__in")
    # rejected rows get a null from explode_outer: a filter on what stands before it would be pushed down and make arrays anew inside lambdas
    clean = F.explode_outer(F.when(F.col("kept"), F.array("cleaned_text"))).alias("__clean")
    kept = judged.select("__row", clean).where("__clean IS NOT NULL")

    def column(c: str) -> Column:
        if c == text:
            return F.col("__clean").alias(c)
        return (F.length("__clean").cast(df.schema[c].dataType) if c == "n_chars" else F.col(f"__row.`{c}`")).alias(c)

    return kept.select(*map(column, df.columns))


def op10_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return apply_quality_rules(docs.select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_chars"
    )


_SQL_FORMS = [form for phrase in BOILERPLATE for form in dict.fromkeys((phrase, phrase.capitalize(), phrase.title(), phrase.upper()))]
ORACLE_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT doc_id, i, array_to_string(w[i : i + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT g.doc_id, unnest(range(i, i + 3)) AS p FROM g JOIN (SELECT doc_id, g FROM g GROUP BY 1, 2 HAVING count(*) > 1) m ON g.doc_id = m.doc_id AND g.g = m.g) GROUP BY 1),
x AS (SELECT doc_id, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS v FROM (SELECT doc_id, unnest(l) AS line FROM w)),
c AS (SELECT doc_id, line, v, len(v) AS n,
  len(list_filter(v, lambda x: regexp_matches(x, '([#*$%&<>]|[!?][!?])$'))) AS marked,
  len(list_filter(v, lambda x: x IN ('|', '»', '›', '•', '·', '>'))) AS separators,
  len(list_filter(v, lambda x: regexp_matches(x, '[A-Z]') AND NOT regexp_matches(x, '[a-z]'))) AS shouted,
  len(list_filter(v, lambda x: NOT regexp_matches(x, '[A-Za-z\x{{80}}-\x{{10FFFF}}]'))) AS letterless,
  len(list_filter(v, lambda x: regexp_matches(x, '^(https?://|www[.])'))) AS links,
  {" OR ".join(f"contains(line, '{form}')" for form in _SQL_FORMS)} AS phrase
  FROM x),
b AS (SELECT doc_id, sum(length(line)) AS chars, sum(length(line)) FILTER (
  marked > {MAX_MARKED_WORDS} * n OR separators >= 3 AND 4 * separators >= n OR phrase AND n <= {BOILERPLATE_WORDS}
  OR n BETWEEN {ENDED_WORDS[0]} AND {ENDED_WORDS[1]} AND NOT contains('{_CLOSING.replace("'", "''")}', right(v[-1], 1))
  OR n >= {LEAST_SHOUTED} AND shouted >= {MAX_CAPITALS} * n OR n >= {LEAST_LETTERLESS} AND letterless > {MAX_LETTERLESS} * n OR links > {MAX_LINKS} * n) AS lost
  FROM c GROUP BY 1),
e AS (SELECT w.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, coalesce(lost, 0) AS lost_chars, coalesce(chars, 0) AS chars FROM w LEFT JOIN r ON r.doc_id = w.doc_id LEFT JOIN b ON b.doc_id = w.doc_id)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
  n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) AND lost_chars <= {MAX_LOST} * chars AS kept, lost_chars::BIGINT AS lost_chars FROM e
"""
