"""N-gram Jaccard join with prefix trees, exact for every pair of different texts.

1. Each text becomes the sorted set of hashes of its distinct shingles; equal sets form a class under one digest.
2. Shingles are dealt by hash to buckets, which count in how many sets each occurs. A set is joined on only if shingles
   that others share make up three quarters of it: no partner could reach the similarity otherwise.
3. In the global order (rarest first, then by hash) two similar sets share a shingle of their prefixes. Sets that share
   one, directly or over others, form a cluster; all links lie inside clusters.
4. A cluster's ordered sets go into a prefix tree. A probe walks it with the overlap so far, which sets with a common
   path share, and leaves subtrees whose remaining length cannot reach the similarity, or whose sets are all
   connected to it already: links between different sets of one component add nothing to the result.
5. A cluster beyond BLOCK_SETS sets or BLOCK_SHINGLES shingles is dealt by hash to blocks, each joined together with block 0. What is then
   outside the cluster's largest component is joined with every block, so that no link is lost and no task grows with a cluster.

Defined cases: null texts and texts without words have an empty set and are their own component; texts of fewer words than
a shingle have one shingle of all their words; repeated rows and rows of one doc_id are classed by their texts; a null doc_id
is ignored as a component's smallest unless it has no other; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import map_arrow
from .common import MOST_TASKS, checkpoint, deal_by_id, or_empty, partitions_for
from .components import connected_components
from .hashing import SPACE_WORD_BYTES, bucket_slices, from_planes, gram_hashes, planes, sorted_groups, text_chunks, word_hashes

SHINGLE_WORDS = 5
#: Similarity as a fraction of whole numbers: intersection / union >= 75 / 100.
SIMILARITY = (75, 100)
#: A mapper hands on what it has gathered whenever it holds so many shingles.
MAPPER_SHINGLES = 1_500_000
#: Bytes of text for each bucket of shingles; the buckets' number grows with the input.
BUCKET_BYTES = 4_000_000
BLOCK_SETS = 128
BLOCK_SHINGLES = 400_000
#: A prefix tree holds so many shingles at most (or one set); a group of more is joined tree after tree.
TREE_SHINGLES = 100_000
#: A batch of sets, on its way out of a worker, holds about so many shingles.
BATCH_SHINGLES = 100_000
#: Digests of sets that a mapper remembers, so that exact copies are dealt once.
SEEN_DIGESTS = 200_000

_BUCKETED = "bucket int, mapper long, kind int, keys binary, docs binary, counts binary"
_SETS = "digest binary, n long, keys binary, counts binary"


def shingle_sets(column: pa.Array, size: int = SHINGLE_WORDS) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of each text of an Arrow column."""
    for first, data, offsets in text_chunks(column):
        words, bounds = word_hashes(data, offsets, SPACE_WORD_BYTES)
        for k in range(len(offsets) - 1):
            yield first + k, np.unique(gram_hashes(words[bounds[k] : bounds[k + 1]], size))


def _digest(keys: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(keys.tobytes())


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, digests = [], []
        for _, keys in shingle_sets(batch.column("text")):
            sizes.append(len(keys))
            digests.append(_digest(keys))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary())], ["doc_id", "text_key", "n_shingles", "digest"])


def _bucket_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(zip(*rows), kinds, strict=True)], ["bucket", "mapper", "kind", "keys", "docs", "counts"])


def _deal(buckets: int):
    """Texts to rows of shingles by bucket (kind 0), and for each flush a row of what need not be asked (kind 1).

    Kind 0 has each shingle of the flush once, with the first set that has it and the number of sets: a shingle of a third of all texts is one entry
    of a flush. Kind 1 has the sets' digests and sizes, and the further sets of shingles that several have.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, part = 0, TaskContext.get().partitionId()
        sets: list[np.ndarray] = []
        digests: list[bytes] = []
        seen: set[bytes] = set()

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal number
            mapper = (part << 24) | number
            number += 1
            sizes = np.array([len(x) for x in sets], np.int64)
            keys, docs = np.concatenate(sets), np.repeat(np.arange(len(sets), dtype=np.uint32), sizes)
            sets.clear()
            order = np.argsort(keys, kind="stable")
            keys, docs = keys[order], docs[order]
            del order
            new = np.concatenate(([True], keys[1:] != keys[:-1]))
            more_keys, more_docs = keys[~new], docs[~new]
            edges = np.flatnonzero(new)
            times = np.diff(np.append(edges, len(keys))).astype(np.uint32)
            keys, docs = keys[new], docs[new]
            rows = [(b, mapper, 0, planes(keys[i:j]), planes(docs[i:j]), planes(times[i:j])) for b, i, j in bucket_slices(keys, buckets)]
            rows.append((mapper % buckets, mapper, 1, b"".join(digests), sizes.tobytes(), planes(more_keys) + planes(more_docs)))
            digests.clear()
            for k in range(0, len(rows), 32):
                yield _bucket_rows(rows[k : k + 32])

        held = 0
        for batch in batches:
            for _, keys in shingle_sets(batch.column("text")):
                if not len(keys):
                    continue
                digest = _digest(keys)
                if digest in seen:
                    continue
                if len(seen) >= SEEN_DIGESTS:
                    seen.clear()
                seen.add(digest)
                sets.append(keys)
                digests.append(digest)
                held += len(keys)
                if held >= MAPPER_SHINGLES:
                    yield from flush()
                    held = 0
        if sets:
            yield from flush()

    return run


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per bucket: answer each mapper with its shingles that two or more sets have, and their counts."""
    for _, rows in sorted_groups(batches, 0):
        for _, mapper, kind, keys, docs, counts in rows:
            if kind:
                yield _bucket_rows([(0, mapper, 1, keys, docs, counts)])
        rows = [r for r in rows if not r[2]]
        if not rows:
            continue
        parts = [from_planes(r[3], np.uint64) for r in rows]
        keys = np.concatenate(parts)
        times = np.concatenate([from_planes(r[5], np.uint32) for r in rows])
        order = np.argsort(keys, kind="stable")
        ordered = keys[order]
        edge = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
        totals = np.add.reduceat(times[order].astype(np.uint64), edge)
        counts = np.empty(len(keys), np.uint32)
        counts[order] = np.repeat(np.minimum(totals, (1 << 32) - 1).astype(np.uint32), np.diff(np.append(edge, len(keys))))
        del keys, times, order, ordered
        at = 0
        for (_, mapper, _, _, docs, _), part in zip(rows, parts, strict=True):
            here = counts[at : at + len(part)]
            shared = np.flatnonzero(here >= 2)
            if len(shared):
                yield _bucket_rows([(0, mapper, 0, planes(part[shared]), planes(from_planes(docs, np.uint32)[shared]), planes(here[shared]))])
            at += len(part)


def _set_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.binary(), pa.int64(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(zip(*rows), kinds, strict=True)], ["digest", "n", "keys", "counts"])


def _gather(similarity: tuple[int, int]):
    """Per mapper: the sets of which shared shingles make up enough, their shared shingles in the global order."""

    def finish(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        digests = sizes = more = None
        parts = []
        for _, _, kind, keys, docs, counts in rows:
            if kind:
                digests, sizes, more = keys, np.frombuffer(docs, np.int64), counts
            else:
                parts.append((from_planes(keys, np.uint64), from_planes(docs, np.uint32), from_planes(counts, np.uint32)))
        if digests is None or not parts:
            return
        if more:  # keys that several sets of the mapper have were answered once
            further = len(more) // 12
            keys, docs = from_planes(more[: 8 * further], np.uint64), from_planes(more[8 * further :], np.uint32)
            answered, counts = (np.concatenate([p[k] for p in parts]) for k in (0, 2))
            order = np.argsort(answered)
            parts.append((keys, docs, counts[order[np.searchsorted(answered, keys, sorter=order)]]))
        keys, docs, counts = (np.concatenate([p[k] for p in parts]) for k in range(3))
        enough = similarity[1] * np.bincount(docs, minlength=len(sizes)) >= similarity[0] * sizes
        keep = enough[docs]
        keys, docs, counts = keys[keep], docs[keep], counts[keep]
        order = np.lexsort((keys, counts, docs))
        keys, docs, counts = keys[order], docs[order], counts[order]
        out, held = [], 0
        cuts = np.searchsorted(docs, np.arange(len(sizes) + 1, dtype=docs.dtype))
        for d in np.flatnonzero(enough):
            i, j = cuts[d], cuts[d + 1]
            if i < j:
                out.append((digests[16 * d : 16 * d + 16], int(sizes[d]), keys[i:j].tobytes(), counts[i:j].tobytes()))
                held += j - i
            if held >= BATCH_SHINGLES:
                yield _set_rows(out)
                out, held = [], 0
        if out:
            yield _set_rows(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in sorted_groups(batches, 1):
            yield from finish(rows)

    return run


def prefix_length(n: int, shared: int, similarity: tuple[int, int]) -> int:
    """How many of the rarest shared shingles a set of ``n`` must show, ``n - shared`` being its own alone."""
    return n - -(-n * similarity[0] // similarity[1]) + 1 - (n - shared)


def _prefixes(similarity: tuple[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out_keys, out_digests = [], []
            for digest, n, keys in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                keys = np.frombuffer(keys, np.int64)
                keys = keys[: prefix_length(n, len(keys), similarity)]
                out_keys.append(keys)
                out_digests.extend([digest] * len(keys))
            if out_digests:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_keys)), pa.array(out_digests, pa.binary())], ["key", "digest"])

    return run


class _Node:
    """A path of shingles, the subtrees below, the sets that end here, and bounds over all sets of the subtree."""

    __slots__ = ("path", "below", "ends", "least", "longest", "member")

    def __init__(self, path: list[int]):
        self.path, self.below, self.ends = path, {}, []
        self.least, self.longest, self.member = 1 << 62, 0, None


MIXED = -1


class PrefixTree:
    """Sets in a global order, with the components of what was found similar. ``parents`` is the union-find forest of the sets."""

    def __init__(self, parents: list[int], similarity: tuple[int, int] = SIMILARITY):
        self.parents, self.root, self.sizes = parents, _Node([]), {}
        self.top, self.bottom = similarity

    def find(self, x: int) -> int:
        parents = self.parents
        while parents[x] != x:
            parents[x] = parents[parents[x]]
            x = parents[x]
        return x

    def _similar(self, overlap: int, both: int) -> bool:
        return (self.top + self.bottom) * overlap >= self.top * both

    def probe(self, x: int, tokens: list[int], size: int) -> None:
        """Join ``x`` with the components of all similar sets of the tree."""
        have, stack = set(tokens).__contains__, [(self.root, 0, 0)]
        while stack:
            node, depth, overlap = stack.pop()
            mine = self.find(x)
            if node.member is not None and node.member != MIXED and self.find(node.member) == mine:
                continue
            path = node.path
            if path:
                overlap += sum(map(have, path))
                depth += len(path)
                left = min(node.longest - depth, len(tokens) - bisect_right(tokens, path[-1]))
            else:
                left = min(node.longest, len(tokens))
            if not self._similar(overlap + left, size + node.least):
                continue
            for y in node.ends:
                if self._similar(overlap, size + self.sizes[y]):
                    self.parents[self.find(y)] = self.find(x)
            if node.member == MIXED:
                roots = {self.find(y) for y in node.ends}
                if len(roots) < 2 and all(child.member != MIXED for child in node.below.values()):
                    roots |= {self.find(child.member) for child in node.below.values()}
                    if len(roots) == 1:
                        node.member = roots.pop()
                        if node.member == self.find(x):
                            continue
            stack.extend((child, depth, overlap) for child in node.below.values())

    def _widen(self, node: _Node, x: int, tokens: int, size: int) -> None:
        node.least, node.longest = min(node.least, size), max(node.longest, tokens)
        if node.member is None:
            node.member = x
        elif node.member != MIXED and self.find(node.member) != self.find(x):
            node.member = MIXED

    def add(self, x: int, tokens: list[int], size: int) -> None:
        self.sizes[x] = size
        node, at, n = self.root, 0, len(tokens)
        self._widen(node, x, n, size)
        while at < n:
            child = node.below.get(tokens[at])
            if child is None:
                child = _Node(tokens[at:])
                node.below[tokens[at]] = child
                self._widen(child, x, n, size)
                child.ends.append(x)
                return
            path, k = child.path, 0
            while k < len(path) and at + k < n and path[k] == tokens[at + k]:
                k += 1
            if k < len(path):
                upper = _Node(path[:k])
                upper.least, upper.longest, upper.member = child.least, child.longest, child.member
                child.path = path[k:]
                upper.below[child.path[0]] = child
                node.below[tokens[at]] = child = upper
            self._widen(child, x, n, size)
            node, at = child, at + k
        node.ends.append(x)


def join_sets(members: list[tuple], similarity: tuple[int, int] = SIMILARITY) -> list[int]:
    """Union-find parents after a prefix-tree join. members: (n, keys, counts, component or None, whether it goes into the tree, whether it probes)."""
    keys = np.concatenate([m[1] for m in members])
    counts = np.concatenate([m[2] for m in members])
    lengths = np.array([len(m[1]) for m in members])
    distinct, inverse, times = np.unique(keys, return_inverse=True, return_counts=True)
    weight = np.zeros(len(distinct), np.uint32)
    weight[inverse] = counts
    # the common shingles first, so that similar sets share long paths; what only one member has is left out
    rank = np.empty(len(distinct), np.int64)
    rank[np.lexsort((distinct, -weight.astype(np.int64)))] = np.arange(len(distinct))
    owner = np.repeat(np.arange(len(members)), lengths)
    keep = times[inverse] > 1
    owner, ranks = owner[keep], rank[inverse][keep]
    order = np.lexsort((ranks, owner))
    owner, ranks = owner[order], ranks[order]
    cuts = np.searchsorted(owner, np.arange(len(members) + 1))
    parents = list(range(len(members)))
    first: dict = {}
    for k, m in enumerate(members):
        if m[3] is not None:
            parents[k] = first.setdefault(m[3], k)
    ranks = ranks.astype(np.int32)
    del keys, counts, distinct, inverse, times, weight, rank, owner, keep, order
    order = sorted(range(len(members)), key=lambda k: (not members[k][4], members[k][5], -members[k][0]))
    at = 0
    while True:
        # the next members that a tree has room for; whoever comes later probes it
        tree, held, end = PrefixTree(parents, similarity), 0, at
        while end < len(order) and members[order[end]][4] and (end == at or held + cuts[order[end] + 1] - cuts[order[end]] <= TREE_SHINGLES):
            held += cuts[order[end] + 1] - cuts[order[end]]
            end += 1
        if end == at:
            break
        for place in range(at, len(order)):
            k = order[place]
            if not members[k][5] and place >= end:
                continue
            tokens = ranks[cuts[k] : cuts[k + 1]].tolist()
            if members[k][5]:
                tree.probe(k, tokens, members[k][0])
            if place < end:
                tree.add(k, tokens, members[k][0])
        at = end
    return [tree.find(k) for k in range(len(members))]


def _join_groups(similarity: tuple[int, int]):
    """Rows sorted by group: cluster, group, role, digest, n, keys, counts, component. Gives links ``a``, ``b``."""

    def finish(rows: list[tuple]) -> tuple[list[bytes], list[bytes]]:
        unique = {}
        for role, digest, n, keys, counts, component in rows:
            old = unique.get(digest)
            into, probes = role in (0, 1), role in (0, 2)
            unique[digest] = (n, np.frombuffer(keys, np.uint64), np.frombuffer(counts, np.uint32), component, into or bool(old and old[4]), probes or bool(old and old[5]))
        digests, members = list(unique), list(unique.values())
        if len(members) < 2:
            return [], []
        roots = join_sets(members, similarity)
        linked = [k for k, r in enumerate(roots) if k != r]
        return [digests[k] for k in linked], [digests[roots[k]] for k in linked]

    def links(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        a, b = finish(rows)
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, rows = None, []
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                for cluster, group, *row in zip(*(part.column(c).to_pylist() for c in range(part.num_columns)), strict=True):
                    if (cluster, group) != last and rows:
                        yield from links(rows)
                        rows = []
                    last = (cluster, group)
                    rows.append(tuple(row))
        if rows:
            yield from links(rows)

    return run


def _run_groups(places: DataFrame, sets: DataFrame, parts: int, similarity: tuple[int, int]) -> DataFrame:
    """Links of the sets that places (``cluster``, ``group``, ``role``, ``digest``, ``component``) bring together."""
    once = sets.groupBy("digest").agg(F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("counts").alias("counts"))  # where the join puts them
    rows = places.join(once, "digest").select("cluster", "group", "role", "digest", "n", "keys", "counts", "component")
    dealt = rows.repartition(parts, "cluster", "group").sortWithinPartitions("cluster", "group", "role", "digest")
    return map_arrow(dealt, _join_groups(similarity), "a binary, b binary")


def shared_sets(docs: DataFrame, text_bytes: int, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """The sets of which enough is shared: ``digest``, ``n``, ``keys`` (shared shingles, rarest first), ``counts``; once for each flush that has a set."""
    buckets = max(1, -(-text_bytes // BUCKET_BYTES))
    parts = max(partitions_for(docs), min(buckets, MOST_TASKS))
    dealt = map_arrow(docs.select("text"), _deal(buckets), _BUCKETED)
    counted = map_arrow(deal_by_id(dealt, "bucket", buckets).sortWithinPartitions("bucket"), _count, _BUCKETED)
    return map_arrow(counted.repartition(parts, "mapper").sortWithinPartitions("mapper"), _gather(similarity), _SETS)


def set_links(sets: DataFrame, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """Links ``a``, ``b`` between digests, enough of them to connect whatever similar pairs connect."""
    parts = partitions_for(sets, 32)
    prefixes = checkpoint(map_arrow(sets.select("digest", "n", "keys"), _prefixes(similarity), "key long, digest binary"))
    first = prefixes.groupBy("key").agg(F.min("digest").alias("b"), F.count("*").alias("times")).where("times > 1").drop("times")
    clusters = connected_components(prefixes.join(first, "key").select(F.col("digest").alias("a"), "b").where("a != b").distinct())
    clusters = clusters.select(F.col("node").alias("digest"), F.col("root").alias("cluster"))
    # the sets themselves travel only once their places are known
    placed = sets.groupBy("digest").agg(F.max(F.octet_length("keys") / 8).alias("shingles")).join(clusters, "digest")
    size = placed.groupBy("cluster").agg(F.greatest(F.ceil(F.count("*") / BLOCK_SETS), F.ceil(F.sum("shingles") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    placed = checkpoint(placed.join(size, "cluster").withColumn("block", F.pmod(F.xxhash64("digest"), "blocks").cast("int")))
    none = F.lit(None).cast("binary")
    own = placed.select("cluster", F.col("block").cast("long").alias("group"), F.lit(0).alias("role"), "digest", none.alias("component"))
    pivots = placed.where("blocks > 1 AND block = 0").select("cluster", F.explode(F.expr("sequence(1L, blocks - 1L)")).alias("group"), F.lit(1).alias("role"), "digest", none.alias("component"))
    links = checkpoint(_run_groups(own.unionByName(pivots), sets, parts, similarity))
    large = placed.where("blocks > 1")
    if large.isEmpty():
        return links
    # what the blocks and block 0 left outside a cluster's largest component meets every block
    roots = connected_components(links).select(F.col("node").alias("digest"), "root")
    parted = checkpoint(large.join(roots, "digest", "left").withColumn("component", F.coalesce("root", "digest")).drop("root"))
    most = parted.groupBy("cluster", "component").count().groupBy("cluster").agg(F.max(F.struct("count", "component"))["component"].alias("main"))
    rest = checkpoint(parted.join(most, "cluster").where("component != main").drop("main"))  # a cluster's rows need not meet in one task from here on
    if rest.isEmpty():
        return links
    extent = rest.groupBy("cluster").agg(F.greatest(F.ceil(F.count("*") / BLOCK_SETS), F.ceil(F.sum("shingles") / BLOCK_SHINGLES)).cast("int").alias("rows"))
    place = lambda row, column: (row.cast("long") * F.lit(1 << 31) + column.cast("long")).alias("group")
    row = F.pmod(F.xxhash64("digest", F.lit(1)), "rows")
    inner = rest.join(extent, "cluster").withColumn("row", row).select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("col"))
    inner = inner.select("cluster", place(F.col("row"), F.col("col")), F.lit(1).alias("role"), "digest", "component")
    probes = parted.join(extent, "cluster").select("*", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("row"))
    probes = probes.select("cluster", place(F.col("row"), F.col("block")), F.lit(2).alias("role"), "digest", "component")
    return links.unionByName(checkpoint(_run_groups(inner.unionByName(probes), sets, parts, similarity)))


def _rooted(docs: DataFrame, doc: str, text: str, similarity: tuple[int, int]) -> DataFrame:
    """Per document row what :func:`jaccard_components` gives, and ``root``, which no two components share (null without shingles)."""
    docs = docs.select(F.col(doc).cast("long").alias("doc_id"), F.xxhash64(or_empty(text)).alias("text_key"), or_empty(text).alias("text"))
    text_bytes = docs.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    described = checkpoint(map_arrow(docs, _describe, "doc_id long, text_key long, n_shingles long, digest binary"))
    links = set_links(checkpoint(shared_sets(docs, text_bytes, similarity)), similarity)
    roots = connected_components(links)
    least = described.where("n_shingles > 0").groupBy("digest").agg(F.min("doc_id").alias("least"))
    least = least.join(roots, least["digest"] == roots["node"], "left").select("digest", F.coalesce("root", "digest").alias("root"), "least")
    whole = least.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = least.join(whole, "root").select("digest", "root", "component_id")
    found = described.join(classes, "digest", "left")
    return found.select("doc_id", "text_key", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.when(F.col("n_shingles") > 0, F.col("root")).alias("root"))


def jaccard_components(docs: DataFrame, doc: str = "doc_id", text: str = "text", similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """Per document row: ``doc_id``, ``text_key``, ``n_shingles``, ``component_id``."""
    return _rooted(docs, doc, text, similarity).drop("root")


def drop_near_duplicates(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each component: of the smallest doc_id (null comes last), then text_key; rows without shingles stay."""
    pairs = _rooted(docs, doc, text, SIMILARITY).where("root IS NOT NULL").groupBy("root", "doc_id", "text_key").agg(F.count("*").alias("times"))
    pairs = checkpoint(pairs.select("root", F.col("doc_id").alias("__d"), F.col("text_key").alias("__k"), "times"))
    best = pairs.groupBy("root").agg(F.min(F.struct(F.col("__d").isNull().alias("none"), F.col("__d").alias("d"), F.col("__k").alias("k"))).alias("best"))
    first = F.col("__d").eqNullSafe(F.col("best.d")) & (F.col("__k") == F.col("best.k"))
    placed = pairs.join(best, "root").withColumn("first", first)
    match = lambda other: docs[doc].cast("long").eqNullSafe(other["__d"]) & (F.xxhash64(or_empty(docs[text])) == other["__k"])
    # a component's row that is there several times leaves with the others, and one of it comes back
    gone = placed.where("NOT first OR times > 1").select("__d", "__k")
    left = docs.join(gone, match(gone), "left_anti")
    again = placed.where("first AND times > 1").select("__d", "__k")
    if again.isEmpty():
        return left
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), docs[doc].cast("long").alias("d"), F.xxhash64(or_empty(docs[text])).alias("k"))
    one = rows.join(again, F.col("d").eqNullSafe(F.col("__d")) & (F.col("k") == F.col("__k"))).dropDuplicates(["__d", "__k"])
    return left.unionByName(one.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns]))


def op9_ngram_join(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return jaccard_components(docs).select("doc_id", "n_shingles", "component_id")


ORACLE_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * o >= 75 * (x.n + y.n - o)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS d, doc_id AS c FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.d)
SELECT w.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(r.c) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id JOIN r ON r.d = w.doc_id GROUP BY w.doc_id
"""
