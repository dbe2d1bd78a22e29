"""Structure repair, filter audit and chosen-path join against brute force, on random and awkward tables."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sparkloom.llm import chosen_path, filter_audit, structure_repair

from .test_awkward import CLASHES, ROWS
from .test_operators import LOW, SPACE

r = random.Random(4)


def shown(rows):
    return Counter(map(tuple, rows))


# structure repair


def brute_repair(rows):
    """Tries all edits. rows: (role, text, fault)."""
    best = None
    grammar = re.compile(r"(s?(ua)+)?")
    begins = lambda x: re.fullmatch(r"s?(ua)*u?", x)

    def go(i, roles, cost, audit, out, inserted):
        nonlocal best
        if cost > limit:
            return
        if i == len(rows) and grammar.fullmatch(roles):
            best = min(best or (cost, audit, out), (cost, audit, out))
        if inserted < 3:
            for new in ("user", "assistant"):
                if begins(roles + new[0]):
                    go(i, roles + new[0], cost + 2, audit + "I", [*out, f"{new}:"], inserted + 1)
        if i == len(rows):
            return
        role, text, fault = rows[i]
        extra = 1 if fault == "truncated" else 0
        go(i + 1, roles, cost + 3, audit + "D", out, 0)
        if fault in ("blank", "duplicate"):
            return
        if role and begins(roles + role[0]):
            go(i + 1, roles + role[0], cost + extra, audit + "K", [*out, f"{role}:{text}"], 0)
        for new in ("user", "assistant"):
            if begins(roles + new[0]):
                go(i + 1, roles + new[0], cost + 2 + extra, audit + "R", [*out, f"{new}:{text}"], 0)

    for limit in range(3 * len(rows) + 1):  # all can be deleted
        go(0, "", 0, "", [], 0)
        if best:
            return best


def brute_conversations(table):
    convs = {}
    for conv, turn, role, text in table:
        rows = convs.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        what = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if what:
            text = "" if what == 1 else re.sub("[.!?]", "", text) if what == 2 else text
            rows += [(turn, "user" if what == 4 else role, text)] * (2 if what == 3 else 1)
    out = []
    for conv, rows in convs.items():
        rows.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], hashlib.sha256(x[2].encode()).hexdigest()))
        judged, seen = [], set()
        for _, role, text in rows:
            bare = text.strip(" \t\n\v\f\r")
            judged.append((role, text, "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""))
            seen.add((role, text))
        faults = Counter(f for *_, f in judged)
        turns = {t for t, *_ in rows if t is not None}
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
        cost, audit, fixed = brute_repair(judged)
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(fixed).encode()).hexdigest()))
    return out


AWKWARD_TURNS = [
    (None, None, None, None), (None, None, None, None), (None, 1, "user", "Hi."), (901, None, "system", "Be brief."), (901, 3, "assistant", "Yes!"), (901, 3, "assistant", "Yes!"), (901, 3, "user", "no"), (902, 0, "", "Text."),
    (903, 0, "user", "a.b" * 40_000 + "."), (903, 1, "assistant", "done.\n"), (904, 0, "tool", "Result."), (904, 1, "User", "Q?"), (905, 5, "assistant", "\t"), (906, 2, "user", "x" * 9), (906, 1, "user", "x" * 9),
]


def turns():
    said = ["Yes.", "No!", "", "why", "  ", "So?", "Well. ", None]
    rows = [(c, t, r.choice(["user", "assistant", "system", "user", "assistant", "tool", None]), r.choice(said)) for c in range(60) for t in range(r.randrange(1, 5))]
    return [*rows, *[(c, t + 7 * (t > 2), "user" if t % 2 == 0 else "assistant", f"Turn {t}.") for c in range(700, 730) for t in range(5)], *AWKWARD_TURNS]


def test_repair(spark):
    table = turns()
    df = spark.createDataFrame(table, "conv_id long, turn long, role string, text string")
    df = df.withColumns({c: F.lit("clash") for c in ("fault", "times", "digest", "copies", "what", "first", "gaps", "c", "r", "d")}).repartition(5)
    got = structure_repair.audit_conversations(df.select("conv_id", "turn", "role", "text", "fault", "times"))
    assert shown(got.collect()) == shown(brute_conversations(table))
    assert structure_repair.audit_conversations(df.limit(0)).count() == 0


def test_paths_without_damage():
    """Single conversations, many of them, against trying all edits."""
    names = {structure_repair.FINE: "", structure_repair.BLANK: "blank", structure_repair.DUPLICATE: "duplicate", structure_repair.TRUNCATED: "truncated"}
    for _ in range(150):
        rows = [(r.choice(["user", "assistant", "system", "x"]), f"t{k}", r.choice([0, 0, 1, 2, 3])) for k in range(r.randrange(0, 5))]
        now = structure_repair.Repair()
        for row in rows:
            now.row(*row)
        cost, audit, fixed = brute_repair([(role, text, names[f]) for role, text, f in rows])
        assert now.finish() == (cost, audit, hashlib.sha256("\n".join(fixed).encode()).hexdigest())


def test_long_conversation():
    now = structure_repair.Repair()
    for k in range(20_001):
        now.row("user" if k % 2 == 0 else "assistant", "ok.", structure_repair.FINE)
    cost, audit, _ = now.finish()
    assert cost == 2 and audit == "K" * 20_001 + "I"


# filter audit


def brute_audit(rows, labels):
    least, fails = {}, []
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    for i, t, lang in rows:
        t = t or ""
        words = SPACE.findall(t)
        tests = (len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), bool(re.search(r"[#$%&*|]", t)), i is not None and least[t] < i)
        said = [x for d, *x in labels if d is not None and d == i]
        fails.append((lang or "", "".join(f for f, test in zip("ABCDE", tests, strict=True) if test), any(q == 1 for q, _ in said), any(x == 1 for _, x in said)))
    out, shapley = {}, Counter()
    for part in {f[0] for f in fails}:
        for order in map("".join, itertools.permutations("ABCDE")):
            left = [f for f in fails if f[0] == part]
            for k, f in enumerate(order):
                gone = [x for x in left if f in x[1]]
                shapley[part, f] += len(gone)
                every = [x for x in fails if x[0] == part and f in x[1]]
                left = [x for x in left if f not in x[1]]
                out[part, order, k + 1] = (len(left), len(gone), len(every) - len(gone), sum(x[1] == f for x in every), sum(x[2] for x in gone), sum(x[3] for x in gone))
    return {(*key, *x, shapley[key[0], key[1][key[2] - 1]]) for key, x in out.items()}


def audit_rows():
    rows = [(i, t, r.choice(["en", "de", None, ""])) for i, t in ROWS]
    block = "x" * 5000
    # copies that differ only late, in every block, and equal lengths
    rows += [(1000 + k, block[: r.randrange(5000)] + f" {k % 3}" + block, "en") for k in range(20)] + [(1100 + k, block + f"{k % 4}" + "y" * 700, "fr") for k in range(24)] + [(1200 + k, "#Copy " * 300, "es") for k in range(30)]
    return rows


LABELS = [(i, k % 2, k % 3 % 2) for k, i in enumerate([1, 4, 4, 6, 8, 9, 13, 20, 21, 1101, 1105, 1201, 1202, 1203, None, 99999])]


@pytest.mark.parametrize("collide", [False, True])
def test_audit(spark, collide):
    rows = audit_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({c: F.lit("clash") for c in [*CLASHES, "mask", "class", "chars", "blocks", "twice", "part", "good", "least"]}).repartition(3)
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int").withColumn("lang", F.lit("clash"))
    want = brute_audit(rows, LABELS)
    if collide:  # blocks that all hash alike leave it to the texts
        marks = filter_audit.failed_filters(df, block_hash=lambda block: F.lit(1).cast("long")).collect()
        assert sum("E" in x["mask"] for x in marks) == sum("E" in x["mask"] for x in filter_audit.failed_filters(df).collect()) > 40
    else:
        got = filter_audit.audit_filters(df, labels)
        assert shown(got.collect()) == shown(want)
        assert filter_audit.audit_filters(df.limit(0), labels).count() == 0


def test_blocks_are_cut_from_bytes(spark):
    """A block of code points would be counted from the text's start, once for every block and once more for the text's length."""
    df = spark.createDataFrame(audit_rows(), "doc_id long, text string, lang string")
    cut = filter_audit._with_bytes(df).select(filter_audit._blocks(F.col("data")).alias("blocks"), "text")
    plan = cut._jdf.queryExecution().optimizedPlan().toString()
    assert "substring(data" in plan and "octet_length(data" in plan and " length(" not in plan
    for row in cut.where("text LIKE '%é%' OR octet_length(text) > 3000").collect():
        raw = row["text"].encode()
        assert len(row["blocks"]) == sum(a < len(raw) for a, _ in filter_audit.BLOCKS)
    parts = [b"".join(raw[a : a + n] for a, n in filter_audit.BLOCKS) for raw in (b"x" * k for k in (0, 127, 128, 129, 10_881, 200_000))]
    assert list(map(len, parts)) == [0, 127, 128, 129, 10_881, 200_000]



# chosen paths


def brute_components(texts, size=4, top=80):
    sets = []
    for t in texts:
        words = SPACE.findall((t or "").translate(LOW))
        sets.append({tuple(words[k : k + size]) for k in range(max(1, len(words) - size + 1))} if words else set())
    up = list(range(len(texts)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    where = {}
    for i, s in enumerate(sets):
        for g in s:
            where.setdefault(g, []).append(i)
    for i, s in enumerate(sets):
        for j in {j for g in s for j in where[g] if j < i}:
            both = len(s & sets[j])
            if 100 * both >= top * (len(s) + len(sets[j]) - both):
                up[find(i)] = find(j)
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def with_ids(rows):
    found = brute_components([t for _, t in rows])
    least = {}
    for (i, _), (_, root) in zip(rows, found, strict=True):
        if i is not None:
            least[root] = min(i, least.get(root, i))
    out = []
    for (i, _), (n, root) in zip(rows, found, strict=True):
        c = least.get(root) if n else i
        out.append((i, n, c, i == c))
    return shown(out)


def test_near_duplicates(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").withColumns({c: F.lit("clash") for c in [*CLASHES, "sketch", "node", "n", "size", "kept", "comp"]}).repartition(3)
    assert shown(chosen_path.near_duplicates(df).collect()) == with_ids(ROWS)
    assert chosen_path.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize(("leaf", "levels"), [(8, 24), (8, 2)])
def test_large_groups(spark, monkeypatch, leaf, levels):
    """Groups many times a leaf: near copies, chains that lead away, texts that share a common passage, and what lies just below the similarity."""
    monkeypatch.setattr(chosen_path, "LEAF", leaf)
    monkeypatch.setattr(chosen_path, "LEVELS", levels)
    for name, value in (("END_BLOCK", 6), ("END_SIZE", 20), ("END_ROWS", 12)):
        monkeypatch.setattr(chosen_path, name, value)
    word = lambda: f"w{r.randrange(10**6)}"
    base, rows = [word() for _ in range(300)], []
    for k in range(60):
        words = list(base)
        for at in r.sample(range(300), k % 9):
            words[at] = word()
        rows.append((k, " ".join(words)))
    walk = list(base)
    for k in range(100, 140):
        for at in r.sample(range(300), 4):
            walk[at] = word()
        rows.append((k, " ".join(walk)))
    shared = " ".join(word() for _ in range(60))
    rows += [(k, f"{shared} " + " ".join(word() for _ in range(r.choice([5, 12, 30, 200])))) for k in range(200, 260)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert shown(chosen_path.near_duplicates(df).collect()) == with_ids(rows)


def test_chosen_path_leaves_no_shuffle_files(spark, folder):
    """What its many checkpoints shuffled is gone from the disk when the method returns; the setting is as it was."""
    import time

    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        files = disk.getAllFiles()
        return {files.apply(k).getName() for k in range(files.size()) if files.apply(k).getName().startswith("shuffle_")}

    old = shuffled()
    chosen_path.near_duplicates(spark.read.parquet(f"{folder}/documents.parquet"))
    end = time.time() + 20
    while shuffled() - old and time.time() < end:
        time.sleep(0.5)
    assert not shuffled() - old
    assert spark.conf.get(key, None) == before
