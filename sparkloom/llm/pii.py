"""Personal data: regular expressions propose spans, checksums confirm them, nearby words adjust the score.

DataFrame functions only. Spans are counted in code points, the end exclusive. Beside personal data, keys and
other secrets are spans of their own.

Defined cases: a null text counts as an empty one (no spans); an empty table gives an empty table; repeated rows and rows of one
doc_id are scanned each on their own; equal starts are ordered by kind as listed in KINDS; very long texts and texts of many
matches take time in proportion to their length; other columns pass through, whatever their names, but one named like the result gives way to it.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import RUN, cut_out, let, or_empty, running, text_blocks

SPAN = "array<struct<start:int,kind_rank:int,end:int,kind:string,score:double>>"
BASE_KINDS = ("email", "ip", "card", "phone")
#: Kinds in the order that breaks ties between spans that start together.
KINDS = (*BASE_KINDS, "iban", "ssn", "key", "secret")

# The expressions find just what their plain forms find. Possessive repeats and the tests before the first character
# (the end of the last match, or no character of the same run) keep the search linear in the text.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    # all words of capitals and digits in a row: _accounts looks for the numbers in them
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]*+(?![a-z])(?:\x20[A-Z0-9]++(?![a-z]))*+",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    # what providers give out, by its opening, and private keys by their first line
    "key": r"(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[A-Z0-9]{16}+|gh[opsu]_[A-Za-z0-9]{36}+|xox[abpr]-[A-Za-z0-9-]{10,}+|AIza[A-Za-z0-9_-]{35}+|sk-[A-Za-z0-9_-]{20,}+|eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+)(?![A-Za-z0-9])|-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----",
    # a value that is assigned to a telling name
    "secret": r"(?i)(?<![a-z])(?:password|passwd|pwd|passphrase|secret|token|api[_-]?key|access[_-]?key|auth[_-]?key)[\x22']?\x20?(?:=|:)\x20?[\x22']?[a-z0-9+/=_.~!@#$%^&*-]{8,}+",
}


def _holds(text: Column, *strings: str) -> Column:
    return reduce(or_, (text.contains(s) for s in strings))


#: A text without a match of these cannot hold a span of the kind.
GATES = {
    "email": lambda t: t.contains("@"),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){13}"),
    "phone": lambda t: t.contains("+"),
    "iban": lambda t: t.rlike(r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]"),
    "ssn": lambda t: t.rlike(r"[0-9]{3}-[0-9]{2}-[0-9]{4}"),
    "key": lambda t: _holds(t, "AKIA", "ASIA", "ghp_", "gho_", "ghs_", "ghu_", "xox", "AIza", "sk-", "eyJ", "-----BEGIN "),
    "secret": lambda t: _holds(t, "=", ":") & t.rlike(r"[A-Za-z][\x22']?\x20?[=:]\x20?[\x22']?[A-Za-z0-9+/=_.~!@#$%^&*-]{8}"),
}
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "ssn": 0.2, "key": 0.9, "secret": 0.4}
CONTEXT = {
    "email": r"mail|contact|write to",
    "ip": r"\bip\b|address|server|host",
    "card": r"card|visa|credit|payment",
    "phone": r"phone|tel|call|fax|mobile",
    "iban": r"iban|account|bank|transfer",
    "ssn": r"ssn|social security|tax id",
    "key": r"key|token|secret|aws|credential",
    "secret": r"login|user|auth|credential|config",
}
CONTEXT_CHARS = 40
CONTEXT_BONUS = 0.4
#: Spans of the kinds beyond the base need this score; base spans always stay.
MIN_SCORE = 0.4

_PLACES = "array<struct<start:int,end:int,match:string,before:string,after:string>>"

#: Characters of an account number, blanks apart, and how many each country's have.
IBAN_LEAST, IBAN_MOST = 15, 34
IBAN_COUNTRIES = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH CR HR LI LV", 22: "BG BH DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def _mod97(match: Column) -> Column:
    """Whether an account number leaves 1 after division by 97, its first four characters moved to the end."""
    plain = F.regexp_replace(match, r"\x20", "")
    moved = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))

    def step(rest: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code <= 57, (rest * 10 + code - 48) % 97).otherwise((rest * 100 + code - 55) % 97)

    return F.aggregate(F.split(moved, ""), F.lit(0), step) == 1


def _valid(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, r"[^0-9]+", "")
    if kind == "ip":
        return match.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})(?:\.|$)){4}$")
    if kind == "card":
        return F.length(digits).between(14, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    if kind == "secret":  # a word alone is no secret: the value has a digit
        return F.regexp_extract(match, r"[=:][\x00-\x{10FFFF}]*", 0).rlike("[0-9]")
    return F.lit(True)


def _accounts(place: Column) -> Column:
    """The account numbers in one row of words: from each word that can open one, the country's length if that is valid, else the longest that is."""
    words = F.split(place["match"], " ")
    plain = lambda t: F.length(F.regexp_replace(t, r"\x20", ""))
    lengths = F.create_map(*[F.lit(x) for size, names in IBAN_COUNTRIES.items() for name in names.split() for x in (name, size)])
    nothing = F.array().cast(_PLACES)

    def longest(rest: Column) -> Column:
        tries = F.transform(F.sequence(F.lit(1), F.size(rest)), lambda k: F.array_join(F.slice(rest, 1, k), " "))
        valid = F.filter(tries, lambda t: plain(t).between(IBAN_LEAST, IBAN_MOST) & _mod97(t))
        pick = lambda v: F.coalesce(F.get(F.filter(v, lambda t: plain(t) == F.try_element_at(lengths, F.substring(t, 1, 2))), F.lit(0)), F.get(v, F.size(v) - 1))
        return F.get(F.transform(F.array(valid), pick), F.lit(0))

    def add(acc: Column, word: Column) -> Column:
        opens = (acc["at"] >= acc["until"]) & word.rlike(r"^[A-Z]{2}[0-9]{2}")
        match = F.when(opens, longest(F.slice(words, acc["n"] + 1, F.lit(IBAN_MOST))))
        since = F.greatest(acc["n"] - CONTEXT_CHARS, F.lit(0))
        before = F.concat(place["before"], F.concat_ws(" ", F.slice(words, since + 1, acc["n"] - since)), F.when(acc["n"] > 0, " ").otherwise(""))
        start = place["start"] + acc["at"]

        def taken(m: Column) -> Column:
            found = F.struct(start.alias("start"), (start + F.length(m)).alias("end"), m.alias("match"), F.right(before, F.lit(CONTEXT_CHARS)).alias("before"), place["after"].alias("after"))
            got = F.when(m.isNull(), acc["got"]).otherwise(F.array_append(acc["got"], found))
            until = F.when(m.isNull(), acc["until"]).otherwise(acc["at"] + F.length(m))
            full = F.size(got) >= RUN
            # what is found is kept in runs, so that no long array is copied for each account
            return F.struct(
                (acc["at"] + F.length(word) + 1).alias("at"),
                (acc["n"] + 1).alias("n"),
                until.alias("until"),
                F.when(full, nothing).otherwise(got).alias("got"),
                F.when(full, F.array_append(acc["runs"], got)).otherwise(acc["runs"]).alias("runs"),
            )

        return F.get(F.transform(F.array(match), taken), F.lit(0))

    zero = F.struct(F.lit(0).alias("at"), F.lit(0).alias("n"), F.lit(0).alias("until"), nothing.alias("got"), F.array().cast(f"array<{_PLACES}>").alias("runs"))
    return F.aggregate(words, zero, add, lambda acc: F.flatten(F.array_append(acc["runs"], acc["got"])))


def _spans(text: Column, kind: str) -> Column:
    """The confirmed spans of one kind: places come from the lengths of the pieces between matches."""
    matches = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))

    def place(pieces: Column) -> Column:
        """A match lies between its piece and the next."""
        both = F.zip_with(F.slice(pieces, F.lit(1), F.size(pieces) - 1), matches, lambda p, m: F.struct(p.alias("p"), m.alias("m"), (F.length(p) + F.length(m)).alias("n")))
        both = F.zip_with(both, F.slice(pieces, F.lit(2), F.size(pieces)), lambda b, q: F.struct(b["p"].alias("p"), b["m"].alias("m"), b["n"].alias("n"), q.alias("q")))

        def found(b: Column, at: Column) -> Column:
            start = at + F.length(b["p"])
            return F.struct(start.alias("start"), (at + b["n"]).alias("end"), b["m"].alias("match"), F.right(b["p"], F.lit(CONTEXT_CHARS)).alias("before"), F.left(b["q"], F.lit(CONTEXT_CHARS)).alias("after"))

        return let(both, lambda rows: F.zip_with(rows, running(F.transform(rows, lambda b: b["n"]), F.lit(0), lambda x, y: x + y), found))

    placed = let(F.split(text, PATTERNS[kind], -1), place)
    if kind == "iban":
        placed = F.flatten(F.transform(placed, _accounts))
    bonus = lambda s: F.when(F.lower(s["before"]).rlike(CONTEXT[kind]) | F.lower(s["after"]).rlike(CONTEXT[kind]), CONTEXT_BONUS).otherwise(0.0)
    scored = F.transform(
        F.filter(placed, lambda s: _valid(kind, s["match"])),
        lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind_rank"), s["end"].alias("end"), F.lit(kind).alias("kind"), F.least(F.lit(1.0), F.lit(SCORES[kind]) + bonus(s)).alias("score")),
    )
    if kind not in BASE_KINDS:
        scored = F.filter(scored, lambda s: s["score"] >= MIN_SCORE)
    return F.when(GATES[kind](text), scored).otherwise(F.array().cast(SPAN)).cast(SPAN)


def find_pii(df: DataFrame, text: str = "text", out: str = "pii_spans") -> DataFrame:
    """``df`` with all spans by start and kind: ``array<struct<start,kind_rank,end,kind,score>>``."""
    names = [c for c in df.columns if c != out]
    # whatever the columns are called, they travel as one
    df = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), or_empty(df[text]).alias("t"))
    df = df.select("*", *[_spans(F.col("t"), kind).alias(kind) for kind in KINDS])
    return df.select(*[F.col(f"row.`{c}`") for c in names], F.sort_array(F.concat(*[F.col(kind) for kind in KINDS])).alias(out))


def _cut(text: Column, spans: Column) -> Column:
    """``text`` with the spans replaced; each starts where those before it end at the earliest."""
    covered = lambda rows: running(F.transform(rows, lambda s: s["end"]), F.lit(0), F.greatest)
    pairs = F.zip_with(spans, covered(spans), lambda s, c: F.struct(c.alias("from"), F.greatest(s["start"], c).alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    kept = F.filter(pairs, lambda s: s["end"] > s["from"])
    piece = lambda blocks: lambda s: F.concat(cut_out(blocks, s["from"], s["start"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))
    last = F.array_max(F.transform(spans, lambda s: s["end"]))
    return let(text_blocks(text), lambda blocks: F.concat(F.array_join(F.transform(kept, piece(blocks)), ""), cut_out(blocks, last, F.length(text))))


def redact_pii(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with each span of ``text`` replaced by its kind in brackets; of overlapping spans the part not yet covered goes.

    ``n_chars``, where there is one, follows the new text. A null text stays null.
    """
    found = find_pii(df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), df[text].alias("t")), "t", "spans")
    some = F.size("spans") > 0
    found = found.select("row", F.when(some, _cut(F.col("t"), F.col("spans"))).otherwise(F.col("t")).alias("t"), some.alias("some"))

    def column(c: str) -> Column:
        if c == text:
            return F.col("t").alias(c)
        if c == "n_chars":
            return F.when(F.col("some"), F.length("t").cast(df.schema[c].dataType)).otherwise(F.col("row.n_chars")).alias(c)
        return F.col(f"row.`{c}`").alias(c)

    return found.select(*map(column, df.columns))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op5_pii(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_pii(docs)
    count = lambda kind: F.size(F.filter("pii_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("pii_spans", lambda s: s["kind_rank"] < len(BASE_KINDS))
    return found.select("doc_id", *[count(kind) for kind in BASE_KINDS], F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("pii_spans")).alias("spans"), *[count(kind) for kind in KINDS[len(BASE_KINDS):]], F.size("pii_spans").cast("long").alias("n_spans"))
