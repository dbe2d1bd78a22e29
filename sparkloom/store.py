"""A graph kept as versioned snapshots on any file system that Spark reads.

A table is a base folder and a list of deltas. A delta holds the rows of one write as they are now, or marks of deleted keys, and is as large as that write;
readers take of each key the newest delta's row, else the base's. Rows carry a bucket, a hash of their key: files are sorted by it, so that what
looks for some keys reads their pages only, and two writers whose keys fall into different buckets do not hinder each other. Compaction folds deltas into a new base.

Each write makes new folders and then one new catalog version; readers use the newest complete catalog, so a write shows
as a whole or not at all. Folders being read are never overwritten; :meth:`GraphStore.vacuum` removes what no kept version names.
"""

from __future__ import annotations

import json
import threading
import time
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .catalog import TYPES, VECTOR_COLUMNS, Graph, NodeTable, RelTable, check_identifier
from .errors import SchemaError

RESERVED_NODE = {"_source": "STRING", "_created_at": "TIMESTAMP"}
PUBLISH_TRIES = 20
BUCKETS = 1024
BUCKET, DELETED = "_bucket", "_deleted"
#: Deltas of a table beyond which they should be folded into the base.
MOST_DELTAS = 24
#: Merges of a table that its catalog entry remembers, to tell whether two writers touched the same buckets.
REMEMBERED = 64


def _place(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def read_small(spark: SparkSession, path: str) -> str | None:
    """The text of a small file; None if it is missing or still empty."""
    where, files = _place(spark, path)
    if not files.exists(where):
        return None
    stream = files.open(where)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8") or None
    finally:
        stream.close()


def list_names(spark: SparkSession, path: str) -> list[str]:
    """The names of a folder's JSON files, in order."""
    where, files = _place(spark, path)
    names = sorted(s.getPath().getName() for s in files.listStatus(where)) if files.exists(where) else []
    return [n for n in names if n.endswith(".json") and not n.startswith(".")]


def create_file(spark: SparkSession, path: str, text: str) -> bool:
    """Write a file that must not be there yet; False if it is."""
    where, files = _place(spark, path)
    files.mkdirs(where.getParent())
    try:
        out = files.create(where, False)
    except Exception:
        if files.exists(where):
            return False
        raise
    out.write(bytearray(text.encode()))
    out.close()
    return True


def write_once(spark: SparkSession, path: str, text: str) -> str:
    """What the file says: ``text``, or what another has written there first."""
    if create_file(spark, path, text):
        return text
    for _ in range(PUBLISH_TRIES):
        if found := read_small(spark, path):
            return found
        time.sleep(0.1)
    raise SchemaError(f"{path} is empty", "A writer stopped half-way; remove the file.")


def bucket_of(keys: list[Column]) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")


def _same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[f"__{k}"]) for k in keys])


class GraphStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self._lock = spark, path.rstrip("/"), threading.RLock()
        self._frames: dict[str, DataFrame] = {}
        self._catalog = self._newest()

    # catalog versions: one small file each, made only if it is not there yet

    def _versions(self) -> list[str]:
        return list_names(self.spark, f"{self.path}/catalog")

    def _newest(self) -> dict:
        for name in reversed(self._versions()):
            try:
                return json.loads(read_small(self.spark, f"{self.path}/catalog/{name}") or "")
            except ValueError:  # another process is still writing it
                continue
        return {"version": 0, "nodes": {}, "rels": {}}

    def _change(self, apply) -> None:
        """Publish the newest catalog as ``apply`` changes it; whoever publishes first wins, the others apply their change to what is there then."""
        with self._lock:
            for _ in range(PUBLISH_TRIES):
                catalog = self._newest()
                apply(catalog)
                catalog["version"] += 1
                if create_file(self.spark, f"{self.path}/catalog/v{catalog['version']:08d}.json", json.dumps(catalog)):
                    self._catalog = catalog
                    return
        raise SchemaError("The graph is being changed by others all the time", "Try again.")

    def refresh(self) -> None:
        """See what other processes have published."""
        self._catalog = self._newest()

    def version(self) -> int:
        return self._catalog["version"]

    def at(self, version: int) -> GraphStore:
        """A reader of an earlier version that has not been vacuumed."""
        text = read_small(self.spark, f"{self.path}/catalog/v{version:08d}.json")
        if text is None:
            raise SchemaError(f"There is no version {version}", f"Kept: {', '.join(str(int(n[1:-5])) for n in self._versions())}")
        other = GraphStore.__new__(GraphStore)
        other.spark, other.path, other._lock, other._frames, other._catalog = self.spark, self.path, threading.RLock(), {}, json.loads(text)
        return other

    def _write(self, df: DataFrame, keys: list[str]) -> str:
        """Write a base, sorted by bucket in files of even size."""
        folder = f"{self.path}/tables/{uuid.uuid4().hex}"
        rows = df.withColumn(BUCKET, bucket_of([F.col(k) for k in keys])).hint("rebalance", F.col(BUCKET))
        rows.sortWithinPartitions(BUCKET, *keys).write.option("compression", "zstd").parquet(folder)
        return folder

    # schema

    def define(self, nodes: list[NodeTable], rels: list[RelTable], key_types: dict[str, str] | None = None) -> None:
        """Create tables; all is checked before any is written. A table that exists keeps its columns; its ``searchable`` flag may change."""
        kinds = key_types or {}
        names = [t.name for t in [*nodes, *rels]]
        if len(set(names)) != len(names):
            raise SchemaError("A table is defined twice")
        for t in [*nodes, *rels]:
            for name in (t.name, *t.properties, *([t.key] if isinstance(t, NodeTable) else [])):
                check_identifier(name)
            for name, kind in t.properties.items():
                if name.startswith("_") or name in VECTOR_COLUMNS:
                    raise SchemaError(f"Property {name} is reserved")
                if kind not in TYPES:
                    raise SchemaError(f"Unknown type {kind}", f"Known: {', '.join(TYPES)}")
            if isinstance(t, NodeTable) and (t.key.startswith("_") or t.key in VECTOR_COLUMNS or kinds.get(t.name, "STRING") not in TYPES):
                raise SchemaError(f"Key {t.key} of {t.name} is reserved or of an unknown type")

        def apply(catalog: dict) -> None:
            labels = {*catalog["nodes"], *(n.name for n in nodes)}
            for r in rels:
                if {r.source, r.target} - labels:
                    raise SchemaError(f"Relationship {r.name} refers to an unknown label", f"Known labels: {', '.join(sorted(labels))}")
                if (old := catalog["rels"].get(r.name)) and (old["from"], old["to"]) != (r.source, r.target):
                    raise SchemaError(f"Relationship {r.name} already joins {old['from']} to {old['to']}")
            for n in nodes:
                if n.name in catalog["nodes"]:
                    catalog["nodes"][n.name]["searchable"] = n.searchable
                else:
                    columns = {n.key: kinds.get(n.name, "STRING"), **{p: k for p, k in n.properties.items() if p != n.key}, **RESERVED_NODE}
                    catalog["nodes"][n.name] = {"key": n.key, "searchable": n.searchable, "folder": self._write(self._empty(columns), [n.key])}
            for r in rels:
                if r.name not in catalog["rels"]:
                    key = lambda label: self._key_kind(catalog, label)
                    schema = T.StructType([T.StructField("_src", key(r.source)), T.StructField("_dst", key(r.target)), *[T.StructField(p, TYPES[k]) for p, k in r.properties.items()], T.StructField("_source", T.StringType())])
                    catalog["rels"][r.name] = {"from": r.source, "to": r.target, "folder": self._write(self.spark.createDataFrame([], schema), ["_src", "_dst"])}

        self._change(apply)

    def add_columns(self, name: str, columns: dict[str, str]) -> None:
        """Add columns, null everywhere, to a table; those that it has stay as they are."""
        for column, kind in columns.items():
            check_identifier(column)
            if kind not in TYPES:
                raise SchemaError(f"Unknown type {kind}", f"Known: {', '.join(TYPES)}")
        self.provision(name, {c: TYPES[k].simpleString() for c, k in columns.items()})

    def provision(self, name: str, columns: dict[str, str]) -> None:
        """Add columns of Spark's types to a table in the catalog alone: rows written before have nulls."""
        have = self.table(name).columns
        new = {c: kind for c, kind in columns.items() if c not in have}
        if new:
            self._change(lambda catalog: self.entry(name, catalog).setdefault("added", {}).update(new))

    def entry(self, name: str, catalog: dict | None = None) -> dict:
        """What the catalog says of a table: ``folder``, ``deltas``, ``epoch`` (grows when the table is replaced), ``next`` (number of the next merge) and more."""
        catalog = catalog or self._catalog
        for kind in ("nodes", "rels"):
            if name in catalog[kind]:
                return catalog[kind][name]
        raise SchemaError(f"Unknown table {name}", f"Known: {', '.join([*catalog['nodes'], *catalog['rels']])}")

    def keys(self, name: str) -> list[str]:
        entry = self.entry(name)
        return [entry["key"]] if "key" in entry else ["_src", "_dst"]

    # reading

    def _frame(self, folder: str) -> DataFrame:
        if folder not in self._frames:
            self._frames[folder] = self.spark.read.parquet(folder)
        return self._frames[folder]

    def base(self, name: str) -> DataFrame:
        """The rows of a table's base, whatever deltas say, with their bucket."""
        entry = self.entry(name)
        df = self._frame(entry["folder"])
        return df.withColumns({c: F.lit(None).cast(kind) for c, kind in entry.get("added", {}).items() if c not in df.columns})

    def changes(self, name: str, deltas: list[dict] | None = None) -> DataFrame | None:
        """The newest row of each key that deltas hold, with ``_deleted`` and its bucket; None without deltas."""
        entry, keys = self.entry(name), self.keys(name)
        columns = [c for c in self.base(name).columns if c != BUCKET] + [DELETED, BUCKET]
        parts = []
        for delta in entry.get("deltas", []) if deltas is None else deltas:
            df = self._frame(delta["folder"])
            df = df.withColumns({c: F.lit(None).cast(kind) for c, kind in entry.get("added", {}).items() if c not in df.columns})
            parts.append(df.select(*[F.col(f"`{c}`") for c in columns], F.lit(delta["seq"]).alias("__seq")))
        if not parts:
            return None
        if len(parts) == 1:
            return parts[0].drop("__seq")
        rest = [c for c in columns if c not in keys]
        newest = reduce(DataFrame.unionByName, parts).groupBy(*keys).agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in rest]), "__seq").alias("__row"))
        return newest.select(*[F.col(f"`{c}`") if c in keys else F.col(f"__row.`{c}`") for c in columns])

    def table(self, name: str, buckets: list[int] | None = None) -> DataFrame:
        """The rows of a table, of some buckets only if given."""
        base, changes, keys = self.base(name), self.changes(name), self.keys(name)
        if buckets is not None and BUCKET in base.columns:
            base = base.where(F.col(BUCKET).isin(buckets))
            changes = changes.where(F.col(BUCKET).isin(buckets)) if changes is not None else None
        columns = [F.col(f"`{c}`") for c in base.columns if c != BUCKET]
        if changes is None:
            return base.select(*columns)
        gone = changes.select(*[F.col(k).alias(f"__{k}") for k in keys])
        return base.join(gone, _same(base, gone, keys), "left_anti").select(*columns).unionByName(changes.where(~F.col(DELETED)).select(*columns))

    def rows_of(self, name: str, wanted: DataFrame) -> DataFrame:
        """The rows whose keys ``wanted`` (columns named like the keys) has. Only the pages of its buckets are read."""
        keys = self.keys(name)
        types = self.base(name).schema
        wanted = wanted.select(*[F.col(k).cast(types[k].dataType).alias(f"__{k}") for k in keys]).distinct()
        buckets = [r["b"] for r in wanted.select(bucket_of([F.col(f"__{k}") for k in keys]).alias("b")).distinct().collect()]  # BUCKETS at the most
        rows = self.table(name, buckets if len(buckets) < BUCKETS else None)
        return rows.join(wanted, _same(rows, wanted, keys), "left_semi")

    def _empty(self, columns: dict[str, str]) -> DataFrame:
        return self.spark.createDataFrame([], T.StructType([T.StructField(c, TYPES[k]) for c, k in columns.items()]))

    def _key_kind(self, catalog: dict, label: str) -> T.DataType:
        table = catalog["nodes"][label]
        return self._frame(table["folder"]).schema[table["key"]].dataType

    def graph(self) -> Graph:
        graph = Graph()
        for name, t in self._catalog["nodes"].items():
            graph.add_nodes(name, self.table(name), t["key"], t["searchable"])
        for name, t in self._catalog["rels"].items():
            graph.add_rels(name, self.table(name), t["from"], t["to"])
        return graph

    # writing

    def replace(self, tables: dict[str, DataFrame]) -> None:
        """Swap the contents of tables, all in one version. A table that another process has changed meanwhile is an error."""
        with self._lock:
            seen = {name: dict(self.entry(name)) for name in tables}
            folders = {name: self._write(df, self.keys(name)) for name, df in tables.items()}

            def apply(catalog: dict) -> None:
                for name, folder in folders.items():
                    entry = self.entry(name, catalog)
                    if any(entry.get(k) != seen[name].get(k) for k in ("folder", "next")):
                        raise SchemaError(f"Table {name} was changed by another process", "Refresh and try again.")
                    entry |= {"folder": folder, "deltas": [], "added": {}, "log": [], "epoch": entry.get("epoch", 0) + 1}

            self._change(apply)

    def merge(self, tables: dict[str, DataFrame]) -> dict[str, int]:
        """Write changed rows, one a key, all in one version; where ``_deleted`` is true the key goes. Gives the number of rows of each table.

        What is written is as large as the changes. A row of the same bucket that another process has changed meanwhile is an error; other buckets are not.
        """
        with self._lock:
            seen = {name: dict(self.entry(name)) for name in tables}
            made, counts = {}, {}
            for name, df in tables.items():
                folder, keys = f"{self.path}/tables/{uuid.uuid4().hex}", self.keys(name)
                base = self.base(name)
                df = df.withColumns({c: F.lit(None).cast(base.schema[c].dataType) for c in base.columns if c not in df.columns and c != BUCKET} | ({} if DELETED in df.columns else {DELETED: F.lit(False)}))
                df = df.select(*[F.col(f"`{c}`").cast(base.schema[c].dataType).alias(c) for c in base.columns if c != BUCKET], DELETED, bucket_of([F.col(k).cast(base.schema[k].dataType) for k in keys]).alias(BUCKET))
                df.hint("rebalance", F.col(BUCKET)).sortWithinPartitions(BUCKET, *keys).write.parquet(folder)
                touched = self.spark.read.parquet(folder).groupBy(BUCKET).count().collect()  # BUCKETS at the most
                counts[name] = sum(r["count"] for r in touched)
                if touched:
                    made[name] = (folder, sorted(r[BUCKET] for r in touched))

            def apply(catalog: dict) -> None:
                for name, (folder, buckets) in made.items():
                    entry, mine = self.entry(name, catalog), seen[name]
                    log, number = entry.get("log", []), entry.get("next", 0)
                    since = [b for seq, b in log if seq >= mine.get("next", 0)]
                    if entry.get("epoch", 0) != mine.get("epoch", 0) or len(since) != number - mine.get("next", 0) or set(buckets) & {b for group in since for b in group}:
                        raise SchemaError(f"Rows of {name} were changed by another process", "Refresh and try again.")
                    entry["deltas"] = [*entry.get("deltas", []), {"folder": folder, "seq": number, "buckets": buckets}]
                    entry["log"], entry["next"] = [*log, [number, buckets]][-REMEMBERED:], number + 1

            if made:
                self._change(apply)
            return counts

    def crowded(self, name: str) -> bool:
        """Whether the table has so many deltas that they should be folded."""
        return len(self.entry(name).get("deltas", [])) > MOST_DELTAS

    def compact(self, name: str) -> int:
        """Fold a table's deltas into a new base; how many. Deltas that others add meanwhile stay, and nobody's write fails for it."""
        with self._lock:
            seen = dict(self.entry(name))
            folded = {d["seq"] for d in seen.get("deltas", [])}
            if not folded:
                return 0
            folder = self._write(self.table(name), self.keys(name))

            def apply(catalog: dict) -> None:
                entry = self.entry(name, catalog)
                if entry["folder"] != seen["folder"]:
                    raise SchemaError(f"Table {name} was replaced or compacted by another process", "Refresh and try again.")
                entry["folder"], entry["deltas"] = folder, [d for d in entry["deltas"] if d["seq"] not in folded]

            self._change(apply)
            return len(folded)

    # retention

    def _named(self, catalog: dict) -> set[str]:
        entries = [*catalog["nodes"].values(), *catalog["rels"].values()]
        return {f.rsplit("/", 1)[1] for e in entries for f in (e["folder"], *(d["folder"] for d in e.get("deltas", [])))}

    def vacuum(self, keep: int = 10, older_than_s: float = 86_400.0) -> int:
        """Remove catalogs but the newest ``keep``, and table folders that no kept one names; the number of folders removed.

        Folders younger than ``older_than_s`` stay: a writer may be about to publish them, a reader of a removed version may still be at work.
        """
        versions = self._versions()
        kept = versions[-max(1, keep) :]
        named: set[str] = set()
        for name in kept:
            text = read_small(self.spark, f"{self.path}/catalog/{name}")
            if text is None:  # it is being written: what it names is not known yet
                return 0
            named |= self._named(json.loads(text))
        limit, removed = time.time() * 1000 - older_than_s * 1000, 0
        for name in versions[: -len(kept)]:
            where, files = _place(self.spark, f"{self.path}/catalog/{name}")
            if files.getFileStatus(where).getModificationTime() <= limit:
                files.delete(where, False)
            elif (text := read_small(self.spark, f"{self.path}/catalog/{name}")) is not None:
                named |= self._named(json.loads(text))
        folder, files = _place(self.spark, f"{self.path}/tables")
        for status in files.listStatus(folder) if files.exists(folder) else []:
            if status.getPath().getName() not in named and status.getModificationTime() <= limit:
                files.delete(status.getPath(), True)
                removed += 1
        return removed
