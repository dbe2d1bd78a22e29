"""The training-data operators against brute force, on a small fixture with the awkward cases and on the smallest tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import chat_format, chunk_dedup, components, decontaminate, license_scan, ngram_join, ngram_lm, packing, pii, quality_rules, registry, shuffle_shards

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACE = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PASSAGE = " ".join(f"Word{k}" for k in range(30))
rng = random.Random(5)
VOCABULARY = ["the", "of", "Über", "naïve", "x", "$y$", "Zed.", "été", "😀", "foo"]
LONG = " ".join(rng.choice(VOCABULARY) for _ in range(3000))
NEAR = [f"w{rng.randrange(10**6)}" for _ in range(120)]


def near(k):
    words = list(NEAR)
    words[k % 120] = f"changed{k}"
    return " ".join(words)


TEXTS = [
    (1, None), (2, ""), (3, "   \n\t "), (4, "one two"), (5, "one two"), (6, PASSAGE), (7, "before " + PASSAGE.upper() + " after"), (8, LONG), (9, LONG),
    (10, "mail a.b@c.de, then x@y.z_d@e.fg and 1.2.3.4.5.6.7.256 call +1 (555) 010-9999 card 4111 1111 1111 1111 iban GB82 WEST 1234 5698 7654 32 ssn: 123-45-6789"),
    (11, "CC BY CC by, All rights   Reserved; GNU general public license"), (12, "Licensed under the Apache License, Version 2.0."),
    (13, "a b c a b c a b c\nsame line\nsame line\nsame line"), (14, "Home | News | Contact | About |\n" * 9), (15, "Fine words make a sentence here. " * 8 + "\nAnd one more good line ends it."),
    *[(20 + k, near(k)) for k in range(12)], (40, near(0)), (41, "\\ <|turn|> [INST] </s>"), (42, "word" * 2000), (43, "9" * 3000 + "." + "@" * 50),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "src0", -1, "clash") for i, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_words string")


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.limit(0)


def keyed(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def space_words(t):
    return SPACE.findall((t or ""))


# 1


def test_chat_round_trip(spark):
    probe = "</s>[INST] ok [/INST] \\ <|end|> <"
    rows = [(1, 0, "user", probe), (1, 1, "assistant", probe), (1, 1, "assistant", None), (2, 0, None, "x"), (3, None, "assistant|", "a\nb"), (None, 0, "assistant", "<|text|>"), (4, 0, "assistant", "same"), (4, 0, "assistant", "same")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    formatted = chat_format.format_conversations(df)
    out, written = keyed(chat_format.read_back(formatted), "conv_id"), keyed(formatted, "conv_id")
    conv = {}
    for c, turn, role, text in rows:
        conv.setdefault(c, []).append((turn if turn is not None else -1, role or "", text or ""))
    assert set(out) == set(conv)
    for c, turns in conv.items():
        turns.sort()
        assert [(t["role"], t["text"]) for t in out[c]["turns"]] == [(r, t) for _, r, t in turns]
        assert out[c]["targets"] == [t for _, r, t in turns if r == "assistant"] and out[c]["chars"] == len(written[c]["formatted"])
        for e, target in zip([m for m in written[c]["mask"] if m], out[c]["targets"], strict=True):
            span = written[c]["formatted"][e["loss_start"] : e["loss_end"]]
            assert re.sub(r"\\(.)", r"\1", span, flags=re.S) == target and "[INST]" not in span and "</s>" not in span
    examples = chat_format.expand_examples(formatted).collect()
    assert len(examples) == 5
    assert all(written[e["conv_id"]]["formatted"].startswith(e["context"] + e["target"] + chat_format.END) for e in examples)
    assert chat_format.read_back(chat_format.format_conversations(df.limit(0))).count() == 0


def test_chat_loss_comes_from_the_mask(spark):
    df = spark.createDataFrame([(1, 0, "user", "ask me"), (1, 1, "assistant", "told you"), (1, 2, "assistant", "again")], "conv_id long, turn long, role string, text string")
    formatted = chat_format.format_conversations(df)
    moved = formatted.withColumn("mask", F.transform("mask", lambda m: F.when(m.isNotNull(), F.struct((m["loss_start"] + 1).alias("loss_start"), (m["loss_end"] + 1).alias("loss_end")))))
    assert chat_format.read_back(formatted).first()["targets"] == ["told you", "again"]
    assert chat_format.read_back(moved).first()["targets"] == ["old you", "gain"]  # a mask that is off by one shows


def test_chat_losses_are_those_of_the_expanded_examples(spark, monkeypatch):
    df = spark.createDataFrame([(1, 0, "user", "ask"), (1, 1, "assistant", "told <|end|>"), (2, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    formatted = chat_format.format_conversations(df)
    expand = chat_format.expanded
    monkeypatch.setattr(chat_format, "expanded", lambda turns: expand(turns).withColumn("target", F.concat("target", F.lit("!"))))
    assert {r["conv_id"]: r["targets"] for r in chat_format.read_back(formatted).collect()} == {1: ["told <|end|>!"], 2: []}


def test_long_conversations_and_texts_take_linear_time(spark):
    import time

    def took(n, run):
        best = 1e9
        for _ in range(2):
            began = time.time()
            run(n)
            best = min(best, time.time() - began)
        return best

    def chat(n):
        df = spark.range(n).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("text "), F.col("id")).alias("text"))
        assert len(chat_format.read_back(chat_format.format_conversations(df)).select("targets").first()[0]) == n // 2

    def mails(n):
        df = spark.range(1).select(F.array_join(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda k: F.concat(F.lit("a"), k, F.lit("@b.c"))), " ").alias("text"))
        assert pii.redact_pii(df).first()[0] == " ".join(["[EMAIL]"] * n)

    for run in (chat, mails):
        took(1000, run)
        assert took(64_000, run) < 2.5 * took(32_000, run) + 0.5


# 2


def test_shards(docs, nothing):
    clash = docs.union(docs.where("doc_id = 4")).withColumns({c: F.lit("x") for c in ("shard", "slot", "bucket", "before", "row", "__bucket")})
    out = shuffle_shards.shuffle_into_shards(clash, shards=5).collect()
    assert all(r["bucket"] == r["row"] == "x" and r["n_words"] == "clash" for r in out)
    assert Counter((r["doc_id"], r["text"]) for r in out) == Counter([*TEXTS, (4, "one two")])
    sizes = Counter(r["shard"] for r in out)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    for shard, size in sizes.items():
        assert sorted(r["slot"] for r in out if r["shard"] == shard) == list(range(size))
    again = shuffle_shards.shuffle_into_shards(docs.repartition(7), shards=5)
    same = shuffle_shards.shuffle_into_shards(docs, shards=5)
    assert sorted((r.doc_id, r.shard, r.slot) for r in again.collect()) == sorted((r.doc_id, r.shard, r.slot) for r in same.collect())
    assert shuffle_shards.shuffle_into_shards(nothing).count() == 0


def test_fisher_yates_is_even():
    places = np.array([shuffle_shards.fisher_yates(4, 9, b) for b in range(4000)])
    for k in range(4):
        assert abs(np.bincount(places[:, k]) / 4000 - 0.25).max() < 0.04


# 3


def brute_contamination(texts, items):
    windows = {}
    for item, text in items:
        words = ALNUM.findall((text or "").translate(LOW))
        size = min(13, len(words))
        for k in range(len(words) - size + 1 if words else 0):
            windows.setdefault(tuple(words[k : k + size]), set()).add(item)
    out = {}
    for i, text in texts:
        words, hit, found = ALNUM.findall((text or "").translate(LOW)), set(), set()
        for size in {len(w) for w in windows}:
            for k in range(len(words) - size + 1):
                if (owners := windows.get(tuple(words[k : k + size]))) is not None:
                    hit |= set(range(k, k + size))
                    found |= owners
        out[i] = (len(words), len(hit), sorted(str(x) for x in found if x is not None), bool(hit) and 20 * len(hit) >= len(words))
    return out


def test_decontamination(spark, docs, nothing):
    items = [(1, PASSAGE), (2, "one TWO"), (3, None), (4, "!!"), (5, " ".join(NEAR[10:40])), (6, "foo"), (10, " ".join(PASSAGE.split()[3:20])), (None, "fine words make")]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in decontaminate.find_contamination(docs, bench).collect()}
    want = brute_contamination(TEXTS, items)
    assert got == want
    left = {r["doc_id"] for r in decontaminate.drop_contaminated(docs, bench).collect()}
    assert left == {i for i, _ in TEXTS if not want[i][3]}
    assert not any(r["contaminated"] for r in decontaminate.find_contamination(docs, bench.limit(0)).collect())
    assert decontaminate.find_contamination(nothing, bench).count() == 0


# 4


def test_packing(docs, nothing):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_tokenizer_path())
    clash = docs.withColumn("sequence_id", F.lit("x"))
    out = packing.pack_documents(clash, capacity=512).collect()
    twice = clash.union(clash.where("doc_id IN (4, 8)")).union(clash.where("doc_id = 4").withColumn("doc_id", F.lit(None).cast("long")))
    assert Counter((r["doc_id"], r["piece"]) for r in packing.pack_documents(twice, capacity=512).collect()) == Counter([(r["doc_id"], r["piece"]) for r in out] + [(r["doc_id"], r["piece"]) for r in out if r["doc_id"] in (4, 8)] + [(None, 0)])
    ids = {}
    for r in sorted(out, key=lambda r: (r["doc_id"], r["piece"])):
        assert r["start"] == len(ids.setdefault(r["doc_id"], b"")) // 4 and r["length"] * 4 == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(r["ids"])
        ids[r["doc_id"]] += r["ids"]
    for i, t in TEXTS:
        assert np.frombuffer(ids[i], "<u4").tolist() == tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
    by_sequence = {}
    for r in out:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 512
    assert len(by_sequence) <= 1.1 * math.ceil(sum(r["length"] for r in out) / 512)
    assert packing.pack_documents(nothing).count() == 0


def brute_sum_of_squares(lengths, capacity):
    gaps, where = [], []
    for length in lengths:
        options = []
        for b, gap in enumerate(gaps):
            if gap >= length:
                after = Counter(g for k, g in enumerate(gaps) if k != b and g)
                after.update([gap - length] if gap > length else [])
                options.append((sum(n * n for n in after.values()), gap))
        if options:
            gap = min(options)[1]
            b = max(k for k, g in enumerate(gaps) if g == gap)
        else:
            b, gap = len(gaps), capacity
            gaps.append(capacity)
        where.append(capacity - gap)
        gaps[b] -= length
    return len(gaps), where


def test_sum_of_squares_choice():
    r = random.Random(3)
    for _ in range(40):
        lengths = sorted((r.randrange(1, 21) for _ in range(60)), reverse=True)
        number, offset = packing.sum_of_squares(lengths, 20)
        assert (max(number) + 1, offset) == brute_sum_of_squares(lengths, 20)


def test_units_make_texts(monkeypatch):
    import pyarrow as pa
    from tokenizers import Tokenizer

    path = packing.default_tokenizer_path()
    plain = Tokenizer.from_file(path)
    texts = [t for _, t in TEXTS] + ["It's naïve, isn't it?! 12,5. A.. b,, İstanbul, ΣΑΣ. e\u0301t\u0301. x\u00a0y ,. \u2003z 's don't ﬁne, Ǆ. =\u0338 a\x0bb c\x0cd \x1c e"]
    texts += ["x <|endoftext|> y", "<|startoftext|>x", "<|EndOfText|> <| endoftext |>", "aΣ.b a.Σ x.'s 's.y", None, "a" * 30_000 + "." * 3000]
    r = random.Random(77)
    texts += ["".join(r.choice("aB3.,'!$ \n\té»Σ“ñß<|>😀\u0301") for _ in range(r.randrange(60))) for _ in range(3000)]
    want = [plain.encode(t or "", add_special_tokens=False).ids + [1] for t in texts]
    for units in (packing.TABLE_UNITS, 60):  # the second table forgets again and again
        monkeypatch.setattr(packing, "TABLE_UNITS", units)
        own, got = packing.UnitTokenizer(path), []
        for _ in range(2):
            got.clear()
            for _, ids, bounds in own.ids(pa.array(texts)):
                got.extend(ids[i:j].tolist() for i, j in zip(bounds[:-1], bounds[1:], strict=True))
            assert got == want


# 5


def luhn(s):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(s))) % 10 == 0


def brute_pii(text):
    kinds = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]
    out = []
    for k, pattern in enumerate(kinds):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub(r"[^0-9]", "", m[0])
            if [True, k == 1 and all(int(x) < 256 for x in m[0].split(".")), 14 <= len(digits) <= 19 and luhn(digits), 10 <= len(digits) <= 15][k]:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_pii(docs, nothing):
    for r in pii.find_pii(docs).collect():
        assert [(s["start"], s["kind_rank"], s["end"]) for s in r["pii_spans"] if s["kind_rank"] < 4] == brute_pii(r["text"])
        if r["doc_id"] == 10:
            assert {s["kind"] for s in r["pii_spans"]} == {"email", "ip", "card", "phone", "iban", "ssn"}
    clean = keyed(pii.redact_pii(docs))
    assert clean[1]["text"] is None and clean[8]["text"] == LONG and clean[8]["n_chars"] == -1
    assert not brute_pii(clean[10]["text"]) and clean[10]["n_chars"] == len(clean[10]["text"]) and "[EMAIL]" in clean[10]["text"]
    assert pii.find_pii(nothing).count() == 0


def test_mod97(spark):
    pick = lambda t: spark.range(1).select(pii._mod97(F.lit(t))).first()[0]
    assert pick("GB82 WEST 1234 5698 7654 32") and pick("DE89370400440532013000") and not pick("DE89370400440532013001")


def test_account_numbers_among_capitals(spark):
    de, gb, fr = "DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32", "FR1420041010050500013M02606"
    texts = {
        f"IBAN {de} BIC COBADEFFXXX": [de], f"{de} {gb} 12": [de, gb], f"REF AB12 {gb} OK": [gb], f"x {fr} 2024 EUR.": [fr],
        f"{de}A": [], f"{de}a": [], f"A{de}": [], "DE89 3704 0044 0532 0130 01 BIC": [], f"été {de}, then {gb} Bank": [de, gb], "AB12 " * 500 + gb: [gb],
    }
    out = pii.find_pii(spark.createDataFrame([(t,) for t in texts], "text string")).collect()
    assert {r["text"]: [r["text"][s["start"] : s["end"]] for s in r["pii_spans"] if s["kind"] == "iban"] for r in out} == texts
    clean = pii.redact_pii(spark.createDataFrame([(f"IBAN {de} BIC COBADEFFXXX",)], "text string")).first()["text"]
    assert clean == "IBAN [IBAN] BIC COBADEFFXXX"


# 6


def test_chunks_resist_shifts(spark, nothing):
    words = [f"t{rng.randrange(10**7)}" for _ in range(400)]
    alone = " ".join(f"u{rng.randrange(10**7)}" for _ in range(300))
    text = " ".join(words)
    rows = [(1, text), (2, "put before: " + text), (3, alone), (4, alone[:200] + " été " + " ".join(words[100:170]) + alone[200:]), (5, None), (6, ""), (None, text)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("start", F.lit(0))
    found = chunk_dedup.repeated_passages(df).collect()
    by = dict(rows)
    for r in found:
        assert by[r["doc_id"]][r["start"] : r["end"]] == by[r["first_doc"]][r["first_start"] : r["first_start"] + r["end"] - r["start"]]
    cut = {d: sum(r["end"] - r["start"] for r in found if r["doc_id"] == d and r["first_doc"] != d) for d in (1, 2, 3, 4)}
    assert cut[1] == len(text) and cut[2] > 0.9 * len(text) and cut[3] == 0 and cut[4] > 0.6 * len(" ".join(words[100:170]))
    assert chunk_dedup.repeated_passages(nothing).count() == 0


@pytest.mark.parametrize("flush", [10, 10**6])
def test_windows_against_all_places(spark, flush, monkeypatch):
    """Every window whose text stands in another place too is found with the first of its places, whatever a flush holds."""
    import pyarrow as pa

    monkeypatch.setattr(chunk_dedup, "MAPPER_CHUNKS", flush)
    r = random.Random(31)
    common = " ".join(f"c{r.randrange(10**6)}" for _ in range(60))
    rows = [(k, f"{' '.join(f'o{r.randrange(10**6)}' for _ in range(r.randrange(30, 60)))} {common if k % 3 else ''} end") for k in range(40)]
    rows += [rows[0], rows[1], (None, rows[2][1])]
    places = {}
    for doc, text in rows:
        for _, starts, ends, word_at, words, _ in chunk_dedup.window_texts(pa.array([text]), 20, 2):
            for start, end in zip(starts.tolist(), ends.tolist()):
                places.setdefault(text[start:end], set()).add((chunk_dedup._NULL_ID if doc is None else doc, start, end))
    want = {(*p, *min(found)[:2]) for found in places.values() if len(found) > 1 for p in found}
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for firsts in (True, False):
        dealt = chunk_dedup.deal_by_id(chunk_dedup.map_arrow(table, chunk_dedup._deal(7, 20, 2), chunk_dedup._DEALT), "bucket", 7).sortWithinPartitions("bucket", "kind")
        got = {(x["doc_id"], x["start"], x["end"], x["first_doc"], x["first_start"]) for x in chunk_dedup.map_arrow(dealt, chunk_dedup._resolve(firsts), chunk_dedup._HIT).collect()}
        assert got == {x for x in want if firsts or x[:2] != x[3:]}


def planted_repeats(seed, pairs, size):
    """Pairs of documents of a small vocabulary that share one passage each, and unrelated earlier documents."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("etaoinshrdlu") for _ in range(r.choice([1, 2, 3, 4, 5, 6, 8]))) for _ in range(1500)]
    text = lambda n: " ".join(vocabulary[min(int(r.paretovariate(0.7)) - 1, 1499)] for _ in range(n))
    rows, passages = [], {}
    for k in range(pairs):
        passages[2 * k + 1] = text(size)
        rows += [(2 * k + d, f"{text(40)} {passages[2 * k + 1]} {text(30)}") for d in (0, 1)]
    return rows, [(k - 10**6, text(400)) for k in range(400)], passages


def test_equal_words_beside_a_passage():
    """Against a comparison word by word."""
    unit = re.compile(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*")

    def units(own, other, last):
        chars = 0
        for a, b in zip(own, other):
            if a != b:
                if last and SPACE.match(a)[0] == SPACE.match(b)[0]:
                    chars += len(SPACE.match(a)[0])
                break
            chars += len(a)
        return chars

    r = random.Random(3)
    for _ in range(20_000):
        a, b = ("".join(r.choice(["a", "b", "ab", " ", "  ", "\n"]) for _ in range(r.randrange(9))).lstrip() for _ in range(2))
        assert chunk_dedup.equal_after(a, b) == units(unit.findall(a), unit.findall(b), True), (a, b)
        c, d = (x + " " if x and not x[-1].isspace() else x for x in (a, b))  # what stands before a chunk ends with space
        assert chunk_dedup.equal_before(c, d) == units(unit.findall(c)[::-1], unit.findall(d)[::-1], False), (c, d)


def test_earlier_documents_cut_no_passage(spark):
    rows, earlier, passages = planted_repeats(17, 60, 55)

    def caught(rows):
        found = chunk_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        by = dict(rows)
        assert all(by[r["doc_id"]][r["start"] : r["end"]] == by[r["first_doc"]][r["first_start"] : r["first_start"] + r["end"] - r["start"]] for r in found)
        return {r["doc_id"] for r in found if r["doc_id"] in passages and r["first_doc"] == r["doc_id"] - 1}

    alone = caught(rows)
    assert len(alone) > 50 and caught(earlier + rows) == alone


def test_every_passage_is_found_whole(spark):
    rows, earlier, passages = planted_repeats(23, 60, 55)
    phrase = "so it goes on and on "  # few distinct bytes in a row
    rows += [(1000, "Alpha beta gamma, delta. " + phrase * 10), (1001, "Quite other words open this one: " + phrase * 10 + "and more of them close it.")]
    passages[1001] = (phrase * 10).strip()
    found = chunk_dedup.repeated_passages(spark.createDataFrame(earlier + rows, "doc_id long, text string")).collect()
    by = dict(earlier + rows)
    assert all(len(space_words(by[r["doc_id"]][r["start"] : r["end"]])) == r["n_words"] >= chunk_dedup.LEAST_WORDS for r in found)
    for doc, passage in passages.items():
        at = by[doc].index(passage)
        assert any(r["doc_id"] == doc and r["first_doc"] == doc - 1 and r["start"] <= at and r["end"] >= at + len(passage) for r in found)


def test_repeats_inside_a_document(spark, tmp_path):
    r = random.Random(29)
    text = lambda n: " ".join(f"v{r.randrange(10**6)}" for _ in range(n))
    twice, shared = text(60), text(60)
    rows = [(1, f"{text(50)} {twice} {text(50)} {twice} {text(50)}"), (None, f"{text(20)} {shared} {text(9)}"), (None, f"{text(40)} {shared}"), (2, text(90))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r["doc_id"] or 0, r["start"], r["end"], r["n_words"], r["first_doc"] or 0, r["first_start"]) for r in chunk_dedup.op6_chunk_dedup(spark, str(tmp_path)).collect())
    early, late = sorted(t.index(shared) for d, t in rows if d is None)
    one = rows[0][1]
    assert [(d, f, n >= 60) for d, _, _, n, f, _ in got] == [(0, 0, True), (1, 1, True)]
    assert got[0][1] <= late and got[0][2] >= late + len(shared) and got[0][5] - got[0][1] == early - late
    assert got[1][1] <= one.rindex(twice) and got[1][2] >= one.rindex(twice) + len(twice) and got[1][5] - got[1][1] == one.index(twice) - one.rindex(twice)
    firsts = [r for r in chunk_dedup.repeated_passages(spark.read.parquet(f"{tmp_path}/documents.parquet")).collect() if (r["doc_id"], r["start"]) == (r["first_doc"], r["first_start"])]
    assert len(firsts) == 2 and all(r["n_words"] <= 60 for r in firsts)


# 7


def brute_model(texts):
    """Per text: held out, tokens, known ones, N, unigram score, score of the discounted and quantised bigrams."""
    tokens = [SPACE.findall((t or "").translate(LOW)) + [None] for _, t in texts]
    held = [zlib.crc32(str(i).encode() if i is not None else b"") % 7 == 2 for i, _ in texts]
    counts = Counter(w for ws, h in zip(tokens, held) if not h for w in ws)
    pairs = Counter(p for ws, h in zip(tokens, held) if not h for p in zip([None, *ws], ws))
    n, v = sum(counts.values()), len(counts)
    once, twice = (sum(c == k for c in pairs.values()) for k in (1, 2))
    discount = once / (once + 2 * twice) if once else 0.5
    for (i, _), ws, h in zip(texts, tokens, held):
        alone = [(counts[w] + 1) / (n + v + 1) for w in ws]
        score = 0.0
        for before, w, p in zip([None, *ws], ws, alone):
            if counts[before]:
                c = pairs[before, w]
                seen = 2 ** int(math.log2(c)) - discount if c else 0
                p = ngram_lm.PAIR_WEIGHT * seen / counts[before] + (1 - ngram_lm.PAIR_WEIGHT) * p
            score += math.log10(p)
        yield i, h, len(ws), sum(counts[w] > 0 for w in ws), n, sum(map(math.log10, alone)), score


def test_language_model(spark, docs, nothing):
    more = [(None, "one two"), (None, LONG), (4, "one two"), (6, "other text of the id")]
    table = docs.select("doc_id", "text", "n_words").union(spark.createDataFrame([(*r, "x") for r in more], "doc_id long, text string, n_words string"))
    # so many bits that no probe errs
    got = sorted(((r["doc_id"] or 0, r["n_tokens"], r) for r in ngram_lm.score_texts(table.withColumn("pack", F.lit("clash")), bits_per_entry=256).collect()), key=lambda x: x[:2])
    want = sorted(((r[0] or 0, r[2], r) for r in brute_model([*TEXTS, *more])), key=lambda x: x[:2])
    assert len(got) == len(want)
    for (_, _, r), (_, _, w) in zip(got, want):
        assert (r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == w[:5]
        assert math.isclose(r["base_score"], w[5], rel_tol=1e-9) and math.isclose(r["score"], w[6], rel_tol=1e-9) and r["score"] < 0
    assert ngram_lm.score_texts(nothing).count() == 0


def test_held_out_accuracy(spark, folder):
    """On held-out texts the model beats the unigram base, and prefers the text to the same words shuffled."""
    table = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    mixed = []
    for r in table.collect():
        if zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2:
            words = r["text"].split()
            random.Random(1).shuffle(words)
            mixed.append((next(k for k in range(10**6, 2 * 10**6) if zlib.crc32(str(k + r["doc_id"] * 1000).encode()) % 7 == 2) + r["doc_id"] * 1000, " ".join(words), r["doc_id"]))
    shuffled = spark.createDataFrame(mixed, "doc_id long, text string, of long")
    scores = {r["doc_id"]: r for r in ngram_lm.score_texts(table.unionByName(shuffled.drop("of"))).collect()}
    own = [scores[of]["score"] for _, _, of in mixed]
    assert sum(own) > sum(scores[of]["base_score"] for _, _, of in mixed)
    assert sum(a > scores[i]["score"] for a, (i, _, _) in zip(own, mixed, strict=True)) >= 0.8 * len(mixed)


def test_log_bloom():
    keys = np.arange(1, 20001, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    counts = np.arange(20000) % 100 + 1
    bloom = ngram_lm.LogBloom(keys, counts)
    levels = bloom.levels(keys)
    exact = np.floor(np.log2(counts)) + 1
    assert (levels >= exact).all() and (levels == exact).mean() > 0.98
    assert (bloom.levels(keys + np.uint64(1)) > 0).mean() < 0.02


# 8


def brute_licenses(text):
    words = ALNUM.findall((text or "").translate(LOW))
    phrases = {tuple(k.split()): label for k, label in license_scan.BASE_PHRASES.items()}
    return sorted((k, label) for ws, label in phrases.items() for k in range(len(words)) if tuple(words[k : k + len(ws)]) == ws)


def test_licenses(docs, nothing):
    got = keyed(license_scan.scan_licenses(docs))
    for i, t in TEXTS:
        words = ALNUM.findall((t or "").translate(LOW))
        assert got[i]["n_words"] == len(words) and sorted((b["word"], b["label"]) for b in got[i]["base"]) == brute_licenses(t)
    assert [m["label"] for m in got[12]["matches"]] == ["apache-2.0"] and got[12]["score"] == 1.0 and got[8]["score"] == 0.0
    assert license_scan.scan_licenses(nothing).count() == 0


MIT = """Copyright (c) 2024 A. Person

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without
restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the
Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND
NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING
FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
"""


def brute_accepts(parts, words, at):
    """Ends of all runs from a word that a template's parts accept, tried one way after another."""
    if not parts:
        return {at}
    (kind, what), rest = parts[0], parts[1:]
    if kind == "words":
        return brute_accepts(rest, words, at + len(what)) if words[at : at + len(what)] == what else set()
    if kind == "var":
        return set().union(*(brute_accepts(rest, words, at + n) for n in range(what + 1) if at + n <= len(words)))
    return brute_accepts(rest, words, at) | brute_accepts([*what, *rest], words, at)


def template_parts(template):
    stack = [[]]
    for k, part in enumerate(license_scan._MARK.split(template)):
        if k % 2 == 0:
            if words := license_scan.words_of(part):
                stack[-1].append(("words", words))
        elif part == "beginOptional":
            stack.append([])
        elif part == "endOptional":
            inner = stack.pop()
            stack[-1].append(("optional", inner))
        else:
            stack[-1].append(("var", int(part.partition(";")[2])))
    return stack[0]


def test_automata_against_trying_all_ways():
    r = random.Random(8)
    compiled = {label: automaton for label, automaton, _ in license_scan.compile_templates(license_scan.TEMPLATES)}
    for label, template in license_scan.TEMPLATES.items():
        parts = template_parts(template)

        def written(parts):
            out = []
            for kind, what in parts:
                out += what if kind == "words" else [b"x"] * r.randrange(what + 2) if kind == "var" else written(what) if r.random() < 0.5 else []
            return out

        for _ in range(30):
            words = written(parts) + [b"more"] * r.randrange(2)
            if r.random() < 0.5:
                words[r.randrange(len(words))] = b"changed"
            assert compiled[label].longest(words, 0) == max(brute_accepts(parts, words, 0), default=-1), (label, words)


def test_whole_license_texts(spark):
    docs = [(1, MIT), (2, MIT.replace("merge, ", "")), (3, "x " + MIT.upper()), (4, MIT + "\n" + MIT), (4, None), (5, MIT.replace("AUTHORS OR COPYRIGHT HOLDERS", "ACME Corp of Nowhere"))]
    rows = license_scan.scan_licenses(spark.createDataFrame(docs, "doc_id long, text string").withColumn("labels", F.lit("clash"))).collect()
    labels = [sorted(m["label"] for m in r["matches"]) for r in sorted(rows, key=lambda r: (r["doc_id"], r["n_words"]))]
    assert labels == [["mit", "mit-text"], [], ["mit", "mit-text"], [], ["mit", "mit", "mit-text", "mit-text"], ["mit", "mit-text"]]


def test_template_regions():
    (label, automaton, _), *_ = license_scan.compile_templates({"t": "use <<var;2>> freely <<beginOptional>>or not<<endOptional>> today"})
    run = lambda s: automaton.longest(license_scan.words_of(s), 0)
    assert [run(s) for s in ("use it freely today", "use freely or not today", "use a b freely today x", "use a b c freely today", "use it freely or today")] == [4, 5, 5, -1, -1]


# 9


def brute_join(texts):
    sets = {}
    for i, t in texts:
        w = SPACE.findall((t or "").translate(LOW))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("block", [128, 3])
def test_ngram_join(docs, nothing, block, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", block)
    monkeypatch.setattr(ngram_join, "BUCKET_BYTES", 900)  # tens of buckets
    monkeypatch.setattr(ngram_join, "TREE_SHINGLES", 300)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(docs).collect()}
    assert got == brute_join(TEXTS)
    if block == 128:
        left = {r["doc_id"] for r in ngram_join.drop_near_duplicates(docs).collect()}
        assert left == {i for i, (_, c) in got.items() if i == c}
        assert ngram_join.jaccard_components(nothing).count() == 0


def test_shared_sets_of_one_mapper_and_many(spark, monkeypatch):
    """Shingles that a flush has in several sets are asked for once; counts are those over all sets."""
    r = random.Random(13)
    bases = [[f"v{r.randrange(10**6)}" for _ in range(60)] for _ in range(8)]
    texts = [" ".join(base[r.randrange(9) : r.randrange(40, 60)] + [f"x{r.randrange(10**6)}" for _ in range(r.randrange(12))]) for base in bases for _ in range(9)]
    monkeypatch.setattr(ngram_join, "MAPPER_SHINGLES", 200)
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    got = {r["digest"]: r for r in ngram_join.shared_sets(df, 10**8).collect()}
    import pyarrow as pa

    sets = {ngram_join._digest(keys): keys for _, keys in ngram_join.shingle_sets(pa.array(texts))}
    flushes = Counter(int(x) for keys in sets.values() for x in keys)
    assert got
    for digest, keys in sets.items():
        shared = [int(x) for x in keys if flushes[int(x)] > 1]
        if 100 * len(shared) >= 75 * len(keys):
            have = np.frombuffer(got[digest]["keys"], np.uint64).tolist()
            assert sorted(have) == sorted(shared) and got[digest]["n"] == len(keys)
            counts = np.frombuffer(got[digest]["counts"], np.uint32).tolist()
            assert counts == sorted(counts) and all(c == flushes[k] for k, c in zip(have, counts))
        else:
            assert digest not in got


def test_one_row_of_each_component_stays(spark):
    other, third = " ".join(f"other{k}" for k in range(40)), " ".join(f"third{k}" for k in range(40))
    rows = [(None, near(0)), (None, near(1)), (None, other), (7, third), (7, third), (7, near(2)), (8, third + " x"), (9, None), (9, None), (None, ""), (3, "lone text"), (3, "its other text")]
    df = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, n int")
    left = Counter((r["doc_id"], r["text"]) for r in ngram_join.drop_near_duplicates(df).collect())
    assert left == Counter([(7, near(2)), (None, other), (7, third), (9, None), (9, None), (None, ""), (3, "lone text"), (3, "its other text")])
    linked = spark.createDataFrame([(1, near(0)), (1, near(1)), (2, near(2))], "doc_id long, text string")
    assert [r["doc_id"] for r in ngram_join.drop_near_duplicates(linked).collect()] == [1]


def test_clusters_that_fall_into_small_components(spark, monkeypatch):
    """Texts about a common passage form one cluster of many components, blocks of two sets each."""
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", 2)
    r = random.Random(47)
    common = [f"c{r.randrange(10**6)}" for _ in range(30)]
    texts = []
    for k in range(12):
        base = [f"b{r.randrange(10**6)}" for _ in range(25)]
        for _ in range(r.randrange(1, 5)):
            words = base + common
            for _ in range(r.randrange(3)):
                words[r.randrange(len(words))] = f"x{r.randrange(10**6)}"
            texts.append((len(texts), " ".join(words)))
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in ngram_join.jaccard_components(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    want = brute_join(texts)
    assert got == want and 3 < len({c for _, c in want.values()}) < len(texts)


@pytest.mark.parametrize("tree", [100_000, 90])
def test_prefix_tree_against_pairs(tree, monkeypatch):
    monkeypatch.setattr(ngram_join, "TREE_SHINGLES", tree)
    r = random.Random(11)
    for _ in range(30):
        base = [[r.randrange(10**6) for _ in range(40)] for _ in range(4)]
        members = []
        for _ in range(25):
            s = set(r.choice(base))
            for _ in range(r.randrange(8)):
                s.discard(r.choice(sorted(s)))
                s.add(r.randrange(10**6))
            members.append(s)
        times = Counter(x for s in members for x in s)
        rows = [(len(s), np.array(sorted(x for x in s if times[x] > 1), np.uint64), np.array([times[x] for x in sorted(s) if times[x] > 1], np.uint32), None, True, True) for s in members]
        roots = ngram_join.join_sets(rows)
        parent = list(range(25))

        def find(x, parent=parent):
            while parent[x] != x:
                x = parent[x]
            return x

        for a in range(25):
            for b in range(a):
                if 100 * len(members[a] & members[b]) >= 75 * len(members[a] | members[b]):
                    parent[find(a)] = find(b)
        assert len({(find(k), roots[k]) for k in range(25)}) == len(set(roots)) == len({find(k) for k in range(25)})


@pytest.mark.parametrize("final", [100_000, 0])
def test_components(spark, final, monkeypatch):
    monkeypatch.setattr(components, "FINAL_LINKS", final)
    links = [(f"a{k}", f"a{k + 1}") for k in range(40)] + [("hub", f"x{k}") for k in range(60)] + [("lone", "lone"), ("p", "q"), ("q", "p")]
    got = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame(links, "a string, b string")).collect()}
    assert len({got[f"a{k}"] for k in range(41)}) == 1 and len({got["hub"], *(got[f"x{k}"] for k in range(60))}) == 1
    assert got["p"] == got["q"] and len(set(got.values())) == 3 and "lone" not in got
    assert components.connected_components(spark.createDataFrame([], "a string, b string")).count() == 0


# 10


def test_quality(docs, nothing):
    for r in quality_rules.apply_quality_rules(docs.drop("n_words")).collect():
        t = r["text"] or ""
        words = SPACE.findall(t)
        windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
        times, covered = Counter(windows), set()
        for k, w in enumerate(windows):
            if times[w] > 1:
                covered |= {k, k + 1, k + 2}
        lines = [line for line in t.split("\n") if SPACE.search(line)]
        failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
        assert (r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == (sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), failed)
        assert not (r["kept"] and failed)
    kept = keyed(quality_rules.filter_quality(docs))
    assert 20 in kept and 14 not in kept and kept[20]["text"] == near(0) and kept[20]["n_words"] == "clash"
    assert quality_rules.apply_quality_rules(nothing).count() == 0


def brute_line_fails(line):
    words = SPACE.findall(line)
    n = len(words)
    marked = len(re.findall(r"(?:[#*$%&<>]|[!?]{2,})(?=[\x20\x09-\x0D]|$)", line))
    separators = sum(w in ("|", "»", "›", "•", "·", ">") for w in words)
    phrase = any(form in line for p in quality_rules.BOILERPLATE for form in (p, p.capitalize(), p.title(), p.upper()))
    shouted = sum(any("A" <= c <= "Z" for c in w) and not any("a" <= c <= "z" for c in w) for w in words)
    letterless = sum(not any(c >= "\x80" or c.isalpha() for c in w) for w in words)
    links = sum(w.startswith(("http://", "https://", "www.")) for w in words)
    return (
        marked > 0.5 * n or separators >= 3 and 4 * separators >= n or phrase and n <= 20
        or 5 <= n <= 30 and words[-1][-1] not in ".!?…:;\"'”»’)]。！？" or n >= 8 and shouted >= 0.8 * n or n >= 5 and letterless > 0.4 * n or links > 0.3 * n
    )


def brute_quality(text):
    """(kept, cleaned text) given that the base rules pass."""
    lines = (text or "").split("\n")
    bad = [bool(SPACE.search(x)) and brute_line_fails(x) for x in lines]
    full = sum(len(x) for x in lines if SPACE.search(x))
    lost = sum(len(x) for x, b in zip(lines, bad) if b)
    return lost <= 0.5 * full, "\n".join(x for x, b in zip(lines, bad) if not b), lost


def test_kept_against_brute_force(spark, docs, folder):
    table = docs.select("doc_id", "text").union(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text"))
    kinds = Counter()
    for r in quality_rules.apply_quality_rules(table).collect():
        keeps, clean, lost = brute_quality(r["text"])
        assert (r["kept"], r["cleaned_text"], r["lost_chars"]) == (keeps and not r["base_failed"], clean, lost), r["text"]
        kinds[r["kept"], lost > 0] += 1
    assert len(kinds) == 4


def test_lines_are_judged(spark):
    good = "This is a good line of prose that ends well."
    bad = ["Home | News | Contact | About |", "we%%% love$$$ odd### marks***", "Read our Privacy Policy", "THIS LINE IS ALL IN CAPITALS, SO OUT IT GOES!", "1 22 333 4.4 five.", "this one has no mark at its end", "see https://a.example www.b.example"]
    row = quality_rules.apply_quality_rules(spark.createDataFrame([(1, "\n".join([good, *bad, good, "Two words"]))], "doc_id long, text string")).first()
    assert row["cleaned_text"] == f"{good}\n{good}\nTwo words"


# pipeline


def test_pipeline_run(spark, tmp_path):
    """run() against brute force after the quality rules, whose own tests are above."""
    import corpus_pipeline
    from tokenizers import Tokenizer

    r = random.Random(41)
    prose = lambda: " ".join(" ".join(f"{r.choice('bcdfgh')}{r.choice('aeiou')}{r.choice('lmnrst')}{r.randrange(10**4)}" for _ in range(9)).capitalize() + "." for _ in range(12))
    leaked = prose()
    texts = [*TEXTS, (50, prose() + " Please write to jane.doe@example.org about this one."), (51, leaked), (52, prose() + " Call +1 (555) 010-9999 or ask the host 10.2.3.4 for it.")]
    items = [(1, leaked), (2, "nothing of this stands anywhere in the small fixture of documents at all")]
    spark.createDataFrame([(i, t, "en", "src0", len(t or "")) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = [(row["doc_id"], row["text"]) for row in quality_rules.filter_quality(spark.read.parquet(f"{tmp_path}/documents.parquet")).collect()]
    assert {20, 21, 50, 51, 52} <= {i for i, _ in left}
    places = brute_join(left)
    left = [(i, t) for i, t in left if places[i][1] == i]
    hit = brute_contamination(left, items)
    left = [(i, t) for i, t in left if not hit[i][3]]
    assert {50, 52} <= {i for i, _ in left} and not {21, 51} & {i for i, _ in left}
    tokenizer = Tokenizer.from_file(packing.default_tokenizer_path())
    want = {}
    for i, t in left:
        for start, k, end in reversed(brute_pii(t)):
            t = f"{t[:start]}[{pii.KINDS[k].upper()}]{t[end:]}"
        want[i] = tokenizer.encode(t, add_special_tokens=False).ids + [1]
    got = {}
    for row in sorted(corpus_pipeline.run(spark, str(tmp_path)).collect(), key=lambda row: (row["doc_id"], row["piece"])):
        got.setdefault(row["doc_id"], []).extend(np.frombuffer(row["ids"], "<u4").tolist())
    assert got == want


# all


def test_names():
    assert {int(re.match(r"op(\d+)_", n)[1]) for n in registry.QUERIES} == set(range(1, 11))


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_sql(spark, folder, name):
    import duckdb

    con = duckdb.connect()
    for table in ("conversations", "documents", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    want = con.execute(registry.ORACLE_SQL[name]).df()
    got = registry.QUERIES[name](spark, folder).toPandas()[list(want.columns)]
    assert sorted(map(tuple, got.itertuples(index=False))) == sorted(map(tuple, want.itertuples(index=False)))


def test_digest_columns(spark, folder):
    found = keyed(registry.QUERIES["op5_pii"](spark, folder))
    for r in spark.read.parquet(f"{folder}/documents.parquet").collect():
        spans = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in brute_pii(r["text"]))
        assert found[r["doc_id"]]["base_sha256"] == hashlib.sha256(spans.encode()).hexdigest()
