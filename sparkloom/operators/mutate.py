"""Upserts, invalidation, pruning and deletion as joins. Each gives a new DataFrame; ``store`` swaps snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..catalog import VECTOR_COLUMNS
from ..errors import NotFoundError

ORDINAL = "_ordinal"
#: Beside a DATE or TIMESTAMP column: whether a row supplies it. A supplied null clears what is stored.
SUPPLIED = "_supplied_"
_NUMBERS = (T.LongType, T.IntegerType, T.ShortType, T.ByteType)


def sanitize(batch: DataFrame, table: DataFrame, keys: list[str]) -> tuple[DataFrame, list[str]]:
    """(the batch with what the table can take, warnings).

    Reserved, undeclared and wrongly typed columns are left out with a warning. Text becomes INT64 or DOUBLE where it reads as one, whole
    numbers become DOUBLE; booleans are never numbers. Values that do not read are left out, counted in one pass over the batch.
    """
    warnings, kept, doubtful = [], [], []
    declared = {f.name: f.dataType for f in table.schema.fields}
    for f in batch.schema.fields:
        name, given = f.name, f.dataType
        if name in keys or name in (ORDINAL, "_source", "_created_at") or name.startswith(SUPPLIED):
            kept.append(F.col(f"`{name}`"))
        elif name.startswith("_") or name in VECTOR_COLUMNS:
            warnings.append(f"Column {name} is reserved; left out")
        elif name not in declared:
            warnings.append(f"Column {name} is not declared; left out. Declared: {', '.join(sorted(c for c in declared if not c.startswith('_') and c not in VECTOR_COLUMNS))}")
        elif isinstance(declared[name], (T.LongType, T.DoubleType)) and isinstance(given, T.StringType):
            kept.append(F.trim(f"`{name}`").try_cast(declared[name]).alias(name))
            doubtful.append(name)
        elif declared[name] == given or isinstance(given, T.NullType) or isinstance(declared[name], (T.DateType, T.TimestampType)):
            kept.append(F.col(f"`{name}`").try_cast(declared[name]).alias(name))
        elif isinstance(given, _NUMBERS) and isinstance(declared[name], (T.LongType, T.DoubleType)) or isinstance(given, T.FloatType) and isinstance(declared[name], T.DoubleType):
            kept.append(F.col(f"`{name}`").cast(declared[name]).alias(name))
        else:
            warnings.append(f"Column {name} takes {declared[name].simpleString()}, not {given.simpleString()}; left out")
    if doubtful:
        bad = lambda c: F.sum((F.col(f"`{c}`").isNotNull() & F.trim(f"`{c}`").try_cast(declared[c]).isNull()).cast("long"))
        lost = batch.agg(*[bad(c).alias(c) for c in doubtful]).first()
        warnings += [f"Column {c} takes {declared[c].simpleString()}; {lost[c]} values do not read as one and are left out" for c in doubtful if lost[c]]
    return batch.select(*kept), warnings


def last_supplied(batch: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """One row per key: of each property the value of the last row that gives one.

    ``max_by`` over (given, ordinal) combines on the map side, so a key that fills a batch is no task's list.
    """

    def pick(c: str) -> list[Column]:
        flag = SUPPLIED + c
        if flag not in batch.columns:
            return [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(ORDINAL))).alias(c)]
        return [F.max_by(F.col(c), F.when(F.col(flag), F.col(ORDINAL))).alias(c), F.max(F.col(flag)).alias(flag)]

    if not columns:
        return batch.select(*keys).distinct()
    return batch.groupBy(*keys).agg(*[x for c in columns for x in pick(c)])


def upsert(table: DataFrame, batch: DataFrame, keys: list[str], created_at: Column | None = None, restore: bool = False) -> DataFrame:
    """Merge a batch (with ``_ordinal``) by key: given values win, missing ones keep what is stored.

    ``_created_at`` is set on creation only, unless ``restore`` takes the batch's own. Columns that the table does not have are ignored; see :func:`sanitize`.
    """
    given = [c for c in batch.columns if c in table.columns and c not in keys and c != "_created_at"]
    flags = [SUPPLIED + c for c in given if SUPPLIED + c in batch.columns]
    new = last_supplied(batch, keys, given).select(*[F.col(k).alias(f"__{k}") for k in keys], *[F.col(c).alias(f"__{c}") for c in [*given, *flags]], F.lit(True).alias("__new"))
    if restore:
        times = batch.groupBy(*keys).agg(F.max_by("_created_at", F.when(F.col("_created_at").isNotNull(), F.col(ORDINAL))).alias("__restored"))
        new = new.join(times.select(*[F.col(k).alias(f"__r{k}") for k in keys], "__restored"), [F.col(f"__{k}").eqNullSafe(F.col(f"__r{k}")) for k in keys], "left")
    joined = table.withColumn("__old", F.lit(True)).join(new, [table[k].eqNullSafe(new[f"__{k}"]) for k in keys], "full_outer")

    def value(c: str) -> Column:
        if c in keys:
            return F.coalesce(F.col(c), F.col(f"__{c}")).alias(c)
        if c == "_created_at":
            restored = F.col("__restored") if restore else F.lit(None)
            return F.when(F.col("__old").isNotNull(), F.coalesce(restored, F.col(c)) if restore else F.col(c)).otherwise(F.coalesce(restored, created_at if created_at is not None else F.current_timestamp())).alias(c)
        if SUPPLIED + c in flags:
            return F.when(F.col(f"__{SUPPLIED}{c}"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c)
        return (F.coalesce(F.col(f"__{c}"), F.col(c)) if c in given else F.col(c)).alias(c)

    return joined.select(*map(value, table.columns))


def invalidate_embeddings(old: DataFrame, new: DataFrame, key: str, text_columns: list[str], vector_columns: list[str]) -> DataFrame:
    """``new`` with the vectors nulled of rows of which any text differs from what ``old`` holds."""
    before = old.select(F.col(key).alias("__key"), *[F.col(c).alias(f"__{c}") for c in text_columns], F.lit(True).alias("__had"))
    joined = new.join(before, new[key] == before["__key"], "left")
    changed = F.lit(False)
    for c in text_columns:
        changed = changed | ~F.col(c).eqNullSafe(F.col(f"__{c}"))
    changed = changed & F.col("__had").isNotNull()
    return joined.select(*[F.when(~changed, F.col(c)).alias(c) if c in vector_columns else F.col(c) for c in new.columns])


def missing_endpoints(edges: DataFrame, sources: DataFrame, source_key: str, targets: DataFrame, target_key: str) -> DataFrame:
    """Edges of which an end does not exist: ``_src``, ``_dst``, ``missing``."""
    a = sources.select(F.col(source_key).alias("__a"))
    b = targets.select(F.col(target_key).alias("__b"))
    no_source = edges.join(a, edges["_src"] == a["__a"], "left_anti").select("_src", "_dst", F.lit("source").alias("missing"))
    no_target = edges.join(b, edges["_dst"] == b["__b"], "left_anti").select("_src", "_dst", F.lit("target").alias("missing"))
    return no_source.unionByName(no_target)


def check_ends(batch: DataFrame, sources: DataFrame, source_key: str, targets: DataFrame, target_key: str) -> None:
    """An error if an edge of the batch has a missing end."""
    lost = missing_endpoints(batch, sources, source_key, targets, target_key).limit(5).collect()
    if lost:
        raise NotFoundError(f"Missing ends of edges: {', '.join(f'{r._src}->{r._dst}' for r in lost)}", "Upsert the nodes first.")


def upsert_edges(table: DataFrame, batch: DataFrame, sources: DataFrame, source_key: str, targets: DataFrame, target_key: str) -> DataFrame:
    """Merge edges by their ends. No edge is written if any has a missing end."""
    check_ends(batch, sources, source_key, targets, target_key)
    return upsert(table, batch, ["_src", "_dst"])


def prune(table: DataFrame, keep: DataFrame, key: str, source: str) -> tuple[DataFrame, DataFrame]:
    """(kept, removed): rows of ``source`` whose key ``keep`` does not have are removed."""
    return _parted(table, F.col("_source") == source, keep, key)


def prune_sources(table: DataFrame, keep: DataFrame, key: str, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, removed): rows of any of the ``sources`` (``_source``) whose key ``keep`` does not have are removed."""
    mine = sources.select(F.col("_source").alias("__mine")).distinct()
    tagged = table.join(mine, table["_source"] == mine["__mine"], "left")
    kept, removed = _parted(tagged, F.col("__mine").isNotNull(), keep, key)
    return kept.drop("__mine"), removed.drop("__mine")


def prune_prefix(table: DataFrame, keep: DataFrame, key: str, prefixes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, removed): rows whose key is one of the ``prefixes`` (``prefix``), a ``#`` and a number, and is not in ``keep``, are removed."""
    mine = prefixes.select(F.col("prefix").alias("__mine")).distinct()
    tagged = table.withColumn("__own", F.regexp_replace(F.col(key), "#[0-9]+$", ""))
    tagged = tagged.join(mine, tagged["__own"] == mine["__mine"], "left")
    kept, removed = _parted(tagged, F.col("__mine").isNotNull(), keep, key)
    return kept.drop("__mine", "__own"), removed.drop("__mine", "__own")


def _parted(table: DataFrame, mine: Column, keep: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    wanted = keep.select(F.col(key).alias("__k")).distinct()
    tagged = table.join(wanted.withColumn("__in", F.lit(True)), table[key] == F.col("__k"), "left")
    gone = F.coalesce(mine, F.lit(False)) & F.col("__in").isNull()
    return tagged.where(~gone).select(*table.columns), tagged.where(gone).select(*table.columns)


def set_values(table: DataFrame, condition: Column, values: dict[str, Column]) -> DataFrame:
    """``table`` with columns set where the condition holds; a null clears."""
    return table.withColumns({c: F.when(condition, v.cast(table.schema[c].dataType)).otherwise(F.col(c)) for c, v in values.items()})


def detach(rels: DataFrame, removed: DataFrame, key: str, ends: list[str]) -> DataFrame:
    """Relationships without those that touch removed nodes at the given ends (``_src``, ``_dst``)."""
    gone = removed.select(F.col(key).alias("__gone")).distinct()
    for end in ends:
        rels = rels.join(gone, rels[end] == gone["__gone"], "left_anti")
    return rels
