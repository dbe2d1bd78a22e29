"""All operators and pipeline stages on tables with nulls, repeated rows, several texts under one id, very long texts, clashing columns, and no rows."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sparkloom.llm import chat_format, chunk_dedup, decontaminate, license_scan, ngram_join, ngram_lm, packing, pii, quality_rules, shuffle_shards

from .test_operators import LONG, NEAR, PASSAGE, SPACE, TEXTS, ALNUM, LOW, brute_contamination, brute_join, brute_licenses, brute_pii, brute_quality, near

r = random.Random(99)
HUGE = " ".join(r.choice(["alpha", "Beta,", "gamma.", "dElta", f"x{r.randrange(10**5)}", "a@b.cd", "été"]) for _ in range(120_000))
EXTRA = [(4, "one two"), (4, "one two"), (4, "two one"), (6, "other text of the id"), (None, PASSAGE), (None, None), (None, PASSAGE), (None, near(3)), (700, HUGE), (701, "before it " + HUGE)]
ROWS = [*TEXTS, *EXTRA]
CLASHES = (
    "win len fp items row t spans bucket before crc doc n_words kept score labels matches digest root cluster n_shingles component_id piece length start end offset sequence_id shard slot pack held_out text_key "
    "__w __t __l __p __h __f __k __d __g __group __bucket __row __in __clean copy ids first_doc n_hit contaminated email card"
).split()


@pytest.fixture(scope="module")
def table(spark):
    df = spark.createDataFrame([(i, t, "en", "src0", -1) for i, t in ROWS], "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit(f"clash {c}") for c in CLASHES}).repartition(3).persist()


def several(rows):
    return Counter(rows)


def test_decontamination(spark, table):
    bench = spark.createDataFrame([(1, PASSAGE), (2, "one two"), (None, None), (3, " ".join(NEAR[5:40]))], "item_id long, text string").withColumn("doc_id", F.lit(1)).withColumn("win", F.lit("x"))
    items = [(1, PASSAGE), (2, "one two"), (3, " ".join(NEAR[5:40]))]
    want = {t: brute_contamination([(0, t)], items)[0] for _, t in ROWS}
    got = decontaminate.find_contamination(table, bench).collect()
    assert several((x["doc_id"], x["n_words"], x["n_hit"], tuple(x["items"]), x["contaminated"]) for x in got) == several((i, want[t][0], want[t][1], tuple(want[t][2]), want[t][3]) for i, t in ROWS)
    left = decontaminate.drop_contaminated(table, bench)
    assert left.columns == table.columns and several((x["doc_id"], x["text"]) for x in left.collect()) == several((i, t) for i, t in ROWS if not want[t][3])
    assert decontaminate.drop_contaminated(table.limit(0), bench).count() == 0


def test_packing(table):
    got = packing.pack_documents(table).collect()
    places, texts = Counter(), Counter()
    for x in got:
        places[x["sequence_id"]] += x["length"]
    assert max(places.values()) <= packing.CAPACITY
    assert Counter(x["doc_id"] for x in got if x["piece"] == 0) == Counter(i for i, _ in ROWS)
    for s in places:
        at = 0
        for x in sorted((x for x in got if x["sequence_id"] == s), key=lambda x: x["offset"]):
            assert x["offset"] == at
            at += x["length"]
    assert not texts and len([x for x in got if x["doc_id"] == 700]) > 20


def test_pii(table):
    for x in pii.find_pii(table, out="spans").collect():
        assert [(s["start"], s["kind_rank"], s["end"]) for s in x["spans"] if s["kind_rank"] < 4] == brute_pii(x["text"]) and x["t"] == "clash t" and x["email"] == "clash email"
    clean = pii.redact_pii(table)
    assert clean.columns == table.columns and clean.count() == len(ROWS)
    assert all(x["text"] is None or not brute_pii(x["text"]) for x in clean.collect())


def test_chunks(spark, table):
    found = chunk_dedup.repeated_passages(table).collect()
    by = {}
    for i, t in ROWS:
        by.setdefault(i, []).append(t or "")
    for x in found:
        size = x["end"] - x["start"]
        own, first = ({t[at : at + size] for t in by[d]} for d, at in ((x["doc_id"], x["start"]), (x["first_doc"], x["first_start"])))
        assert own & first
    assert any(x["doc_id"] == 701 and x["first_doc"] == 700 and x["end"] - x["start"] > 0.9 * len(HUGE) for x in found)


def test_language_model(table):
    got = ngram_lm.score_texts(table).collect()
    words = lambda t: len(SPACE.findall(t or "")) + 1
    assert several((x["doc_id"], x["n_tokens"]) for x in got) == several((i, words(t)) for i, t in ROWS)
    assert all(x["score"] <= 0 for x in got)


def test_licenses(table):
    got = license_scan.scan_licenses(table).collect()
    assert several((x["doc_id"], x["n_words"], tuple(sorted((b["word"], b["label"]) for b in x["base"]))) for x in got) == several((i, len(ALNUM.findall((t or "").translate(LOW))), tuple(brute_licenses(t))) for i, t in ROWS)


def test_ngram_join(table):
    texts = list(dict.fromkeys((i, t) for i, t in ROWS))
    numbered = dict(enumerate(texts))
    roots = brute_join([(k, t) for k, (_, t) in numbered.items()])
    # rows of one id are classed by their texts; the smallest id of a component counts, null only without another
    least = {}
    for k, (i, _) in numbered.items():
        least.setdefault(roots[k][1], []).append(i)
    want = Counter()
    for i, t in ROWS:
        k = texts.index((i, t))
        ids = [x for x in least[roots[k][1]] if x is not None]
        want[i, roots[k][0], (min(ids) if ids else None) if roots[k][0] else i] += 1
    assert several((x["doc_id"], x["n_shingles"], x["component_id"]) for x in ngram_join.jaccard_components(table).collect()) == want
    left = ngram_join.drop_near_duplicates(table)
    assert left.columns == table.columns and left.where("doc_id IN (700, 701)").count() == 1
    assert ngram_join.drop_near_duplicates(table.limit(0)).count() == 0


def test_quality(table):
    got = quality_rules.filter_quality(table)
    assert got.columns == table.columns

    def base_failed(t):
        words = SPACE.findall(t or "")
        windows = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
        covered = {p for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for p in (k, k + 1, k + 2)}
        return len(words) < 50 or 100 * len(covered) > 50 * len(words)

    want = several((i, brute_quality(t)[1]) for i, t in ROWS if not base_failed(t) and brute_quality(t)[0])
    assert want and several((x["doc_id"], x["text"]) for x in got.collect()) == want
    assert quality_rules.filter_quality(table.limit(0)).count() == 0


def test_shards(table):
    got = shuffle_shards.shuffle_into_shards(table.drop("shard", "slot"), shards=4).collect()
    assert several((x["doc_id"], x["text"], x["before"]) for x in got) == several((i, t, "clash before") for i, t in ROWS)


def test_chat(spark):
    rows = [(1, 0, "user", HUGE), (1, 0, "user", HUGE), (1, 1, "assistant", HUGE), (None, None, None, None), (2, 5, "assistant", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("x") for c in ("number", "at", "head", "body", "mask", "t", "formatted", "block", "end")})
    out = {x["conv_id"]: x for x in chat_format.read_back(chat_format.format_conversations(df)).collect()}
    assert out[1]["targets"] == [HUGE] and len(out[1]["turns"]) == 3 and out[2]["targets"] == [""] and out[None]["targets"] == []


def test_pipeline_stages(spark, table, tmp_path):
    """Every stage but the last gives the columns of documents, on awkward rows and on none."""
    import corpus_pipeline

    names = ["doc_id", "text", "lang", "source", "n_chars"]
    bench = spark.createDataFrame([(1, PASSAGE), (None, None)], "item_id long, text string")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    for docs in (table.select(names), table.select(names).limit(0)):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            docs = stage(spark, docs, str(tmp_path))
            assert k == 4 or docs.columns == names
            docs = spark.createDataFrame(docs.collect(), docs.schema)
        assert set(docs.columns) >= {"doc_id", "piece", "sequence_id", "offset"}
    docs.write.parquet(f"{tmp_path}/documents.parquet")


def test_long_texts_are_whole(table):
    kept = table.where("doc_id = 700").select("text").first()[0]
    assert kept == HUGE and len(LONG) > 1000
