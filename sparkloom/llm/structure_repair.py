"""Conversation structure repair: the cheapest edits that make the roles of a conversation follow ``(s?(ua)+)?``.

Three weighted automata are composed as far as rows ask for it:

* the input acceptor reads a conversation's rows in order, each as a symbol: the initial of its role and its fault;
* the edit transducer keeps, reroles or deletes a row, or inserts one before it, each at its cost;
* the grammar acceptor has a state for what may come next.

A path's weight is (cost, labels), compared in this order. States of the composition are (rows read, grammar state), which is a
topological order, so one pass over the rows finds the shortest paths. Two paths to one state that cost the same never have labels of which one
begins the other (what would follow are insertions, which cost), so the least labels so far stay the least, and four weights are all that is carried on.

Rows of a conversation travel to one task and pass it in order, one at a time; four labels and running digests are held, never the rows. Equal
rows of one turn travel as one row with a count, and whether a text was said before is found by a join, not in that task.

Defined cases: null roles, texts and parts of the damage's key are one space, rows with a null turn come first, rows of one turn go by role and by digest of the
text; a role whose initial is neither s, u nor a can only be reroled or deleted; repeated rows are duplicates of the first; a null conv_id is a
conversation; conversations of which no row is left are there with zeros; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import map_arrow
from .common import partitions_for

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COST = {KEEP: 0, REROLE: 2, DELETE: 3, INSERT: 2}
#: What a truncated row costs unless it is deleted.
TRUNCATED_COST = 1
#: The grammar acceptor: for each state the initials that may come, and the state after them. States END may be the last.
START, AFTER_SYSTEM, AFTER_USER, AFTER_ASSISTANT = range(4)
GRAMMAR = {START: {"s": AFTER_SYSTEM, "u": AFTER_USER}, AFTER_SYSTEM: {"u": AFTER_USER}, AFTER_USER: {"a": AFTER_ASSISTANT}, AFTER_ASSISTANT: {"u": AFTER_USER}}
END = (START, AFTER_ASSISTANT)
#: Roles that an edit may write.
WRITTEN = {"u": "user", "a": "assistant"}
LEGAL_PAIRS = ("su", "ua", "au")
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
#: More insertions in one place only come back to a grammar state, at a cost.
MOST_INSERTED = 2

_BLANK = r"[^\x20\x09-\x0D]"
_OUT = "conv_id {kind}, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


@cache
def _inserted(state: int) -> list[tuple[int, int, str]]:
    """(state, cost, initials) of all runs of insertions from a grammar state."""
    runs = [(state, 0, "")]
    for k in range(MOST_INSERTED):
        runs += [(after, cost + COST[INSERT], written + initial) for s, cost, written in runs if len(written) == k for initial, after in GRAMMAR[s].items() if initial in WRITTEN]
    return runs


@cache
def arcs(initial: str, fault: int, state: int) -> list[tuple[int, int, str, str, str | None]]:
    """The composition's arcs out of a grammar state over one row: (state, cost, labels, inserted initials, initial written for the row or "" for its own or None).

    ``initial`` is the row's, or "" if no state takes it.
    """
    out = []
    extra = TRUNCATED_COST if fault == TRUNCATED else 0
    for s, cost, written in _inserted(state):
        labels = INSERT * len(written)
        out.append((s, cost + COST[DELETE], labels + DELETE, written, None))
        if fault in (BLANK, DUPLICATE):
            continue
        if initial in GRAMMAR[s]:
            out.append((GRAMMAR[s][initial], cost + COST[KEEP] + extra, labels + KEEP, written, ""))
        out += [(after, cost + COST[REROLE] + extra, labels + REROLE, written, i) for i, after in GRAMMAR[s].items() if i in WRITTEN]
    return out


class _Path:
    """The shortest path to a state: its cost, its labels (linked, so that paths share their beginnings) and the digest of what it writes."""

    __slots__ = ("cost", "labels", "digest", "some")

    def __init__(self, cost: int, labels: tuple | None, digest, some: bool):
        self.cost, self.labels, self.digest, self.some = cost, labels, digest, some

    def then(self, cost: int, labels: str, rows: list[tuple[str, str]]) -> _Path:
        digest, some = self.digest, self.some
        if rows:
            digest = digest.copy()
        for role, text in rows:
            digest.update(b"\n" if some else b"")
            digest.update(f"{role}:".encode())
            digest.update(text.encode())
            some = True
        return _Path(cost, (self.labels, labels) if labels else self.labels, digest, some)

    def audit(self) -> str:
        parts, at = [], self.labels
        while at:
            at, part = at
            parts.append(part)
        return "".join(reversed(parts))


class Repair:
    """One conversation's shortest paths, row by row."""

    def __init__(self):
        self.paths = {START: _Path(0, None, hashlib.sha256(), False)}
        #: Grammar states by their paths' labels, least first.
        self.order = [START]

    def _advance(self, options, role: str, text: str) -> None:
        """Take the best arc into each state. options: grammar state to arcs."""
        best: dict[int, tuple] = {}
        for rank, state in enumerate(self.order):
            for after, cost, labels, written, own in options(state):
                weight = (self.paths[state].cost + cost, rank, labels)
                if after not in best or weight < best[after][0]:
                    best[after] = (weight, state, written, own)
        paths = {}
        for after, ((cost, _, labels), state, written, own) in best.items():
            rows = [(WRITTEN[i], "") for i in written]
            if own is not None:
                rows.append((WRITTEN[own] if own else role, text))
            paths[after] = self.paths[state].then(cost, labels, rows)
        self.order = sorted(best, key=lambda after: best[after][0][1:])
        self.paths = paths

    def row(self, role: str, text: str, fault: int, times: int = 1) -> None:
        """Read a row, and ``times - 1`` repeats of it, which must go."""
        initial = role[:1] if any(role[:1] in taken for taken in GRAMMAR.values()) else ""
        self._advance(lambda state: arcs(initial, fault, state), role, text)
        if times > 1:  # insertions among deleted rows come after them: D is less than I
            cost, labels = COST[DELETE] * (times - 1), DELETE * (times - 1)
            self.paths = {state: path.then(path.cost + cost, labels, []) for state, path in self.paths.items()}

    def finish(self) -> tuple[int, str, str]:
        """(cost, audit, SHA-256 of the repaired rows)."""
        self._advance(lambda state: [(END[0], cost, INSERT * len(written), written, None) for s, cost, written in _inserted(state) if s in END], "", "")
        path = self.paths[END[0]]
        return path.cost, path.audit(), path.digest.hexdigest()


def _repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conversation and place to a row for each conversation."""
    last = now = None
    faults, illegal, before = [0] * 4, 0, ""
    out: list[tuple] = []
    kind = None

    def done() -> tuple:
        return (last, faults[BLANK], faults[DUPLICATE], faults[TRUNCATED], illegal, *now.finish())

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [kind, *[pa.int64()] * 5, pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds, strict=True)], ["conv_id", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"])

    for batch in batches:
        kind = batch.schema.field("conv_id").type
        columns = [batch.column(c) for c in ("conv_id", "role", "text", "fault", "times")]
        for conv, role, text, fault, times in zip(*(c.to_pylist() for c in columns), strict=True):
            if now is None or conv != last:
                if now is not None:
                    out.append(done())
                last, now, faults, illegal, before = conv, Repair(), [0] * 4, 0, None
            now.row(role, text, fault, times)
            faults[fault] += 1
            faults[BLANK if fault == BLANK else DUPLICATE] += times - 1
            initial = role[:1]
            illegal += (before is not None and before + initial not in LEGAL_PAIRS) + (times - 1) * (initial + initial not in LEGAL_PAIRS)
            before = initial
        if len(out) >= 1000:
            yield batch_of(out)
            out = []
    if now is not None:
        out.append(done())
    if out:
        yield batch_of(out)


def damage(rows: DataFrame) -> DataFrame:
    """Rows with faults put in, by a checksum of conversation and turn: dropped, emptied, without sentence ends, repeated, said by the user."""
    rows = rows.select("conv_id", "turn", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")])
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    what = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn"))) % 20
    text = F.when(what == 1, "").when(what == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", what.alias("what"), F.when(what == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text")).where("what <> 0")
    return rows.withColumn("copies", F.when(F.col("what") == 3, 2).otherwise(1)).drop("what")


def _faults(rows: DataFrame) -> DataFrame:
    """Equal rows of a turn as one with their number (``times``), ``digest`` of the text, and the row's first ``fault``."""
    rows = rows.withColumn("digest", F.sha2("text", 256)).groupBy("conv_id", "turn", "role", "digest", "text").agg(F.sum("copies").alias("times"))
    # when a role first said a text: null turns come first
    place = F.struct(F.col("turn").isNotNull().alias("later"), F.col("turn").alias("turn"))
    first = rows.groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d")).agg(F.min(place).alias("first"), F.count("*").alias("turns")).where("turns > 1")
    on = rows["conv_id"].eqNullSafe(first["c"]) & (rows["role"] == first["r"]) & (rows["digest"] == first["d"])
    rows = rows.join(first, on, "left")
    again = F.coalesce(F.col("first") < place, F.lit(False))
    cut_off = ~F.regexp_like("text", F.lit(r"[.!?][\x20\x09-\x0D]*\z"))
    fault = F.when(~F.regexp_like("text", F.lit(_BLANK)), BLANK).when(again, DUPLICATE).when(cut_off, TRUNCATED).otherwise(FINE)
    return rows.select("conv_id", "turn", "role", "digest", "text", "times", fault.alias("fault"))


def repair_conversations(rows: DataFrame) -> DataFrame:
    """Per conversation of ``rows`` (``conv_id``, ``turn``, ``role``, ``text``, and ``copies``, how often each stands there): ``gaps``, ``blank``, ``duplicate``,
    ``truncated``, ``illegal``, ``cost``, ``audit`` and ``repaired_sha256``."""
    turns = rows.groupBy("conv_id", "turn").agg(F.lit(1).alias("one")).groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count("turn")).alias("gaps"))
    found = _faults(rows)
    dealt = found.repartition(partitions_for(rows), "conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "digest")
    kind = rows.schema["conv_id"].dataType.simpleString()
    fixed = map_arrow(dealt.select("conv_id", "role", "text", "fault", F.col("times").cast("long").alias("times")), _repair, _OUT.format(kind=kind))
    turns = turns.withColumnRenamed("conv_id", "c")
    return fixed.join(turns, fixed["conv_id"].eqNullSafe(turns["c"])).select("conv_id", F.coalesce("gaps", F.lit(0)).cast("long").alias("gaps"), *fixed.columns[1:])


def audit_conversations(rows: DataFrame) -> DataFrame:
    """The repair of damaged conversations, with a row for each conversation that was there before the damage."""
    fixed = repair_conversations(damage(rows))
    every = rows.select(F.col("conv_id").alias("c")).distinct()
    zero: dict[str, Column] = {c: F.lit(0).cast("long") for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    zero |= {"audit": F.lit(""), "repaired_sha256": F.lit(hashlib.sha256().hexdigest())}
    out = every.join(fixed, every["c"].eqNullSafe(fixed["conv_id"]), "left")
    return out.select(F.col("c").alias("conv_id"), *[F.coalesce(F.col(name), value).alias(name) for name, value in zero.items()])


def op11_structure_repair(spark, sf_dir: str) -> DataFrame:
    return audit_conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text"))


#: The checksum bit by bit, and the cheapest edits to each grammar state (0 start, 1 after system, 2 after user, 3 after assistant) row by row.
ORACLE_SQL = r"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations
), coded AS (
  SELECT *, xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(k, ''), lambda c: ascii(c)::BIGINT)),
    lambda crc, c: list_reduce(list_prepend(xor(crc, c), list_transform(range(8), lambda i: 0::BIGINT)), lambda x, i: xor(x >> 1, (x & 1) * 3988292384::BIGINT)))) % 20 AS what
  FROM keyed
), damaged AS (
  SELECT conv_id, turn, CASE WHEN what = 4 THEN 'user' ELSE role END AS role, CASE what WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, copy
  FROM coded, range(2) AS c(copy) WHERE what <> 0 AND (copy = 0 OR what = 3)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i FROM damaged
), judged AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd'
    WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 't' ELSE '' END AS fault, lag(role) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM placed
), ins(s, z, written) AS (
  VALUES (0, 0, []::VARCHAR[]), (0, 2, ['user']), (0, 3, ['user', 'assistant']), (1, 1, []), (1, 2, ['user']), (1, 3, ['user', 'assistant']), (2, 2, []), (2, 3, ['assistant']), (2, 2, ['assistant', 'user']), (3, 3, []), (3, 2, ['user']), (3, 3, ['user', 'assistant'])
), took(z, initial, after) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
walk AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS i, 0 AS s, 0::BIGINT AS cost, '' AS audit, []::VARCHAR[] AS said FROM judged
  UNION ALL
  SELECT conv_id, i, s, (b).cost, (b).audit, (b).said FROM (
    SELECT conv_id, i, s, min({'cost': cost, 'audit': audit, 'said': said}) AS b FROM (
      SELECT w.conv_id, j.i, ins.z AS s, w.cost + 2 * len(written) + 3 AS cost, w.audit || repeat('I', len(written)) || 'D' AS audit, w.said || list_transform(written, lambda x: x || ':') AS said
      FROM walk w JOIN judged j ON j.conv_id IS NOT DISTINCT FROM w.conv_id AND j.i = w.i + 1 JOIN ins ON ins.s = w.s
      UNION ALL
      SELECT w.conv_id, j.i, took.after, w.cost + 2 * len(written) + (CASE j.fault WHEN 't' THEN 1 ELSE 0 END), w.audit || repeat('I', len(written)) || 'K', w.said || list_transform(written, lambda x: x || ':') || [j.role || ':' || j.text]
      FROM walk w JOIN judged j ON j.conv_id IS NOT DISTINCT FROM w.conv_id AND j.i = w.i + 1 JOIN ins ON ins.s = w.s JOIN took ON took.z = ins.z AND took.initial = j.role[1] WHERE j.fault NOT IN ('b', 'd')
      UNION ALL
      SELECT w.conv_id, j.i, took.after, w.cost + 2 * len(written) + 2 + (CASE j.fault WHEN 't' THEN 1 ELSE 0 END), w.audit || repeat('I', len(written)) || 'R', w.said || list_transform(written, lambda x: x || ':') || [(CASE took.initial WHEN 'u' THEN 'user' ELSE 'assistant' END) || ':' || j.text]
      FROM walk w JOIN judged j ON j.conv_id IS NOT DISTINCT FROM w.conv_id AND j.i = w.i + 1 JOIN ins ON ins.s = w.s JOIN took ON took.z = ins.z AND took.initial <> 's' WHERE j.fault NOT IN ('b', 'd')
    ) GROUP BY conv_id, i, s)
), counts AS (
  SELECT conv_id, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
    count(*) FILTER (before IS NOT NULL AND before[1] || role[1] NOT IN ('su', 'ua', 'au')) AS illegal FROM judged GROUP BY conv_id
), ended AS (
  SELECT w.conv_id, min({'cost': w.cost + 2 * len(written), 'audit': audit || repeat('I', len(written)), 'said': said || list_transform(written, lambda x: x || ':')}) AS b
  FROM walk w JOIN counts c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND c.n = w.i JOIN ins ON ins.s = w.s AND ins.z IN (0, 3) GROUP BY w.conv_id
)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  coalesce((b).cost, 0)::BIGINT AS cost, coalesce((b).audit, '') AS audit, sha256(coalesce(array_to_string((b).said, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM o.conv_id
"""
